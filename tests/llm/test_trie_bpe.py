import hashlib
import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from fieldweave.llm import trie_bpe as bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello's WORLD ÀÉÎ ßtraße ΟΔΥΣΣΕΥΣ 12345 <|endoftext|> x<|startoftext|>y 日本語テキスト ㎞ Ⅷ ½ İstanbul ﬁne é \x1c\x85\xa0 d 'S 'll don't 🤦🏼‍♂️!!",
    "", " ", "a" * 5000, "'" * 7, "it's'd've", "aaaa bbbb abababab " * 3, "\u0001\u0002 \x7f|~ _under_score_ --- ...", "‘quoted’ – “dashes” — €5…",
]


def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_words_as_the_library_encodes_them(spark, small):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzéüñçß0123456789'!?.,-_#$ \n\t"
    texts = TEXTS + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(80)) for _ in range(100)]
    texts += [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    vocabulary = bpe.Vocabulary(PATH)
    splitter = bpe.Splitter(PATH, vocabulary.special)
    split = [splitter.split(t) for t in texts]
    codes = dict(bpe.Encoder(vocabulary).encode(set().union(*split) - vocabulary.special.keys())) | {t: [i] for t, i in vocabulary.special.items()}
    for words, wanted in zip(split, library().encode_batch(texts, add_special_tokens=False)):
        assert [i for w in words for i in codes[w]] == wanted.ids


def test_encoder_is_the_same_when_tables_are_cleared():
    vocabulary = bpe.Vocabulary(PATH)
    words = set(re.findall(r"[a-z]+", " ".join(TEXTS).lower()))
    one = dict(bpe.Encoder(vocabulary).encode(words))
    small = bpe.Encoder(vocabulary, most_kept=1)
    assert {w: next(iter(small.encode({w})))[1] for w in words} == one


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "y"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.encoded(docs, PATH, block_chars=50, most_words=5).collect()
    tokenizer = library()
    wanted = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, wanted))
    assert bpe.encoded(docs.limit(0), PATH, keep=False).count() == 0
