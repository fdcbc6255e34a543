import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fieldweave.llm import packing

DOCS = "doc_id long, text string, note string"


def check(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_ids_match_the_library(spark):
    texts = ["", None, "plain words", "naïve ‘quotes’ 日本語 ́ <|endoftext|> x", "word " * 5000, "a" * 3000, "  \n\t "]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, "plain words", "y"), (None, "no id", None)], DOCS)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(docs).collect()
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i})
        assert [p[0] for p in own] == list(range(-(-len(ids) // 1024)))
        assert all(p[2] == 1024 for p in own[1:]) and sum(p[2] for p in own) == len(ids)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for _, s, n, c in own)
    assert sum(r.doc_id == 2 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    check(rows)
    assert packing.packed(docs.limit(0)).count() == 0


def brute(lengths, capacity, documents, attention, weights):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= n and b[1] >= 1 and b[2] >= n * n]
        score = lambda b: sum(w * (r / m) ** 2 for w, r, m in zip(weights, (b[0] - n, b[1] - 1, b[2] - n * n), (capacity, documents, attention)))
        if fits:
            b = min(fits, key=score)
        else:
            bins.append(b := [capacity, documents, attention])
        b[0], b[1], b[2] = b[0] - n, b[1] - 1, b[2] - n * n
    return len(bins)


@pytest.mark.parametrize("documents, attention", [(100, 100 * 100), (3, 100 * 100), (100, 4000), (2, 5000)])
def test_plan_is_best_fit_under_every_capacity(documents, attention):
    rng = np.random.default_rng(documents)
    lengths = rng.integers(1, 60, 3000).tolist()
    counts = {n: lengths.count(n) for n in set(lengths)}
    weights = (1.0, 1e-4, 1e-4)
    lines = packing.best_fit(counts, 100, documents, attention, weights)
    used = {}
    for length, low, high, first, many, offset in lines:
        for k in range(low, high):
            used.setdefault(first + (k - low) % many, []).append((offset + (k - low) // many * length, length))
    assert sum(map(len, used.values())) == 3000
    for places in used.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 100 and len(places) <= documents and sum(n * n for _, n in places) <= attention
    assert len(used) <= brute(lengths, 100, documents, attention, weights) * 1.02 + 1
    with pytest.raises(ValueError, match="101"):
        packing.best_fit({101: 1}, 100)


def test_few_sequences_on_documents(spark, small):
    rows = packing.op1_best_fit(spark, small).collect()
    assert check(rows) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1
