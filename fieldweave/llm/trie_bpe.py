"""BPE encoding and decoding with a trie of distinct words.

The encoding of every prefix of a word ends in one token, its last-token state, and that token is the
only suffix of the prefix that is a token and that can follow the last token of what stands before it.
So a word's encoding follows from the states of its prefixes, and words with a common prefix share
those states. The distinct words of a block of texts are visited in sorted order, which is a
depth-first walk of their trie: only the path from the root to the current node is kept, and what a
word shares with the one before it is not computed again. Tokens are then read back along the path.

Two tokens can follow each other if no merge that reaches across their border comes before the merges
that make them. Tokens that their own merges don't yield are left out. Ids are those of the vocabulary
file, texts are normalised and split as that file says (NFC, lower case; letters, single digits,
other signs; white space dropped). The file's special tokens in a text are those tokens.

Null text counts as empty: no tokens, empty decoded text. Very long texts and words are processed
whole. Repeated rows and null ids stay rows of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldweave.llm.common import spread, table

_NEVER = 1 << 30
_END = 256  # the last byte of a word is the symbol byte + 256
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: Texts of the characters below this, and of the usual quotation marks, dashes and currency signs, are
#: split here. Others go through the tokenizers library's own normaliser and splitter, whose Unicode
#: version decides there; their words are encoded by the trie like all others.
_COMMON = 0x250


def _common_split() -> re.Pattern[str]:
    kinds = [unicodedata.category(chr(c))[0] for c in range(_COMMON)]
    some = lambda kind: "".join(re.escape(chr(c)) for c in range(_COMMON) if kinds[c] == kind)
    return re.compile(f"{_CONTRACTIONS}|[{some('L')}]+|[{some('N')}]|[^\t-\r \x85\xa0{some('L')}{some('N')}]+")


_SPLIT_COMMON = _common_split()
_RARE = re.compile(f"[^\x00-{chr(_COMMON - 1)}\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]")


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable letters: this gives the byte of a letter."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tables of a word-end BPE file: small, of fixed size, and sent to the tasks once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, suffix = _byte_letters(), spec["model"]["end_of_word_suffix"]

        def symbols(token: str) -> str:
            ends = token.endswith(suffix)
            body = [letters[c] for c in (token.removesuffix(suffix) if ends else token)]
            if ends:
                body[-1] += _END
            return "".join(map(chr, body))

        self.written = {i: t for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        own = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special and t != suffix}
        self.ids = {symbols(t): i for t, i in own.items()}
        self.ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[own[left], own[right]] = (rank, self.ids[symbols(left) + symbols(right)])
        #: By token: its halves and the rank of the merge that joins them; none for single symbols.
        self.halves: dict[int, tuple[int, int, int] | None] = {}
        for text, token in self.ids.items():
            made = self.merge(text)
            if made is not None:
                self.halves[token] = made or None
        self.tokens = {text: token for text, token in self.ids.items() if token in self.halves}
        self.prefixes = {text[:n] for text in self.tokens for n in range(1, len(text) + 1)}

    def merge(self, text: str) -> tuple[int, int, int] | tuple[()] | None:
        """The merge that completes the text; () for one symbol; None if merging doesn't end in the text's own token."""
        parts, last = [self.ids[c] for c in text], ()
        while len(parts) > 1:
            found = min(((self.ranks[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks), default=None)
            if found is None:
                return None
            at = found[1]
            last = (parts[at], parts[at + 1], found[0])
            parts[at : at + 2] = [self.ranks[parts[at], parts[at + 1]][1]]
        return last if parts == [self.ids[text]] else None


class Encoder:
    """Encodes sets of distinct words; keeps bounded tables of what it has found out between calls."""

    def __init__(self, vocabulary: Vocabulary, most_kept: int = 400_000):
        self.vocabulary, self.most_kept = vocabulary, most_kept
        self.states = [""]
        self.state_of = {"": 0}
        self.endings: list[list[tuple[int, int]]] = [[]]
        self.steps: dict[int, int] = {}
        self.fits: dict[int, bool] = {}

    def _state(self, text: str) -> int:
        """The automaton's state for the longest suffix of text that begins a token."""
        while text not in self.state_of and text not in self.vocabulary.prefixes:
            text = text[1:]
        if text not in self.state_of:
            self.state_of[text] = len(self.states)
            self.states.append(text)
            tokens = self.vocabulary.tokens
            self.endings.append([(tokens[text[k:]], len(text) - k) for k in range(len(text)) if text[k:] in tokens])
        return self.state_of[text]

    def _edges(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The token and the parts that stand at one of its edges before it is made: part, rank that makes it, rank that uses it."""
        out, used = [], _NEVER
        while True:
            halves = self.vocabulary.halves[token]
            out.append((token, halves[2] if halves else -1, used))
            if not halves:
                return out
            token, used = halves[side], halves[2]

    def _fit(self, left: int, right: int) -> bool:
        ranks, starts = self.vocabulary.ranks, self._edges(right, 0)
        for a, a_made, a_used in self._edges(left, 1):
            for b, b_made, b_used in starts:
                if found := ranks.get((a, b)):
                    when = max(found[0], a_made, b_made)
                    if when < a_used and when <= b_used:
                        return False
        return True

    def encode(self, words: set[str]) -> Iterator[tuple[str, list[int]]]:
        """Words and their token ids, by one depth-first walk over the trie of the words."""
        if len(self.steps) > self.most_kept or len(self.fits) > self.most_kept:
            self.steps.clear()
            self.fits.clear()
        steps, fits, endings = self.steps, self.fits, self.endings
        paths = []
        for word in words:
            symbols = word.encode().decode("latin-1")
            paths.append((symbols[:-1] + chr(ord(symbols[-1]) + _END), word))
        paths.sort()
        before, state, last, size = "", [0], [-1], [0]  # by depth on the current path
        for path, word in paths:
            n = min(len(path), len(before))
            depth = 0
            while depth < n and path[depth] == before[depth]:
                depth += 1
            del state[depth + 1 :], last[depth + 1 :], size[depth + 1 :]
            at = state[depth]
            for i in range(depth, len(path)):
                step = at << 9 | ord(path[i])
                if (found := steps.get(step)) is None:
                    found = steps[step] = self._state(self.states[at] + path[i])
                at = found
                for token, length in endings[at]:
                    start = i + 1 - length
                    if not start:
                        break
                    pair = last[start] << 16 | token
                    if (fit := fits.get(pair)) is None:
                        fit = fits[pair] = self._fit(last[start], token)
                    if fit:
                        break
                state.append(at)
                last.append(token)
                size.append(length)
            before = path
            out, i = [], len(path)
            while i:
                out.append(last[i])
                i -= size[i]
            out.reverse()
            yield word, out


class Splitter:
    """Normalises texts and splits them into words."""

    def __init__(self, path: str, special: dict[str, int]):
        self.special, self.any_special = special, re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.library = Tokenizer.from_file(path)
        self.letters = _byte_letters()

    def split(self, text: str) -> list[str]:
        """The words of a text, the vocabulary's special tokens among them."""
        if "<|" in text and self.any_special.search(text):
            return [w for part in self.any_special.split(text) for w in ([part] if part in self.special else self.plain(part))]
        return self.plain(text)

    def plain(self, text: str) -> list[str]:
        if not text.isascii():
            if _RARE.search(text):
                parts = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
                return [bytes([self.letters[c] for c in part]).decode() for part, _ in parts]
            text = unicodedata.normalize("NFC", text)
        return _SPLIT_COMMON.findall(text.lower())


def encoded(docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text", block_chars: int = 2_000_000, most_words: int = 300_000, keep: bool = True) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and, with keep, ids and decoded.

    Texts are taken in blocks of about ``block_chars``; codes of up to ``most_words`` words stay known
    from one block to the next.
    """
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = shared.value
        encoder, written = Encoder(vocabulary), vocabulary.written
        splitter = Splitter(vocabulary_path, vocabulary.special)
        always = {t: (i.to_bytes(4, "little"), t) for t, i in vocabulary.special.items()}
        known = dict(always)

        def block(ids: list, texts: list[str]) -> pd.DataFrame:
            nonlocal known
            words = [splitter.split(t) for t in texts]
            new = set().union(*words) - known.keys()
            if len(known) + len(new) > most_words:
                known = dict(always)
                new = set().union(*words) - known.keys()
            for word, code in encoder.encode(new):
                known[word] = array("I", code).tobytes(), " ".join([written[i] for i in code])
            rows = []
            for i, own in zip(ids, words):
                codes = [known[w] for w in own]
                raw, text = b"".join([c[0] for c in codes]), " ".join([c[1] for c in codes])
                row = (i, len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                rows.append((*row, list(array("I", raw)), text) if keep else row)
            return pd.DataFrame(rows, columns=columns)

        for batch in batches:
            ids, texts, chars = [], [], 0
            for i, t in zip(batch["id"], batch["text"]):
                ids.append(i)
                texts.append(t or "")
                chars += len(texts[-1])
                if chars >= block_chars:
                    yield block(ids, texts)
                    ids, texts, chars = [], [], 0
            if ids:
                yield block(ids, texts)

    columns = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if keep else [])]
    kinds = f"id {dict(narrow.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if keep else "")
    return spread(narrow).mapInPandas(run, kinds).withColumnRenamed("id", id_column)


def op10_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=False)
