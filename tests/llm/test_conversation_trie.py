"""The trie against one that is built in Python from whole conversations."""

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from fieldweave.llm import conversation_trie as tries


def brute(rows):
    def ref(role, text):
        return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()

    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, ref(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    whole = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        whole[c] = tuple(own.get(base, [])[:h] + ts[h:])
    nodes = {}
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    below = {n: [] for n in nodes}
    for n in nodes:
        if n:
            below[n[:-1]].append(n)

    out, total = [], {}
    for n in sorted(nodes, key=len, reverse=True):
        kids = below[n]
        leaves = sum(total[k][0] for k in kids) or 1
        saved = sum(total[k][1] for k in kids) + ((len(nodes[n]) - 1) * len(n[-1][1]) if n else 0)
        total[n] = leaves, saved
        ends = ",".join(str(c) for c in sorted(nodes[n]) if whole[c] == n)
        out.append((min(nodes[n]), len(n), min(nodes[n[:-1]]) if n else None, len(nodes[n]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, chars string")
    return sorted(map(tuple, tries.trie(frame, **more).collect()), key=repr)


def made(rng, convs, turns=8, texts=4):
    return [(c, t, rng.choice(["user", "assistant"]), f"text {'x' * rng.randrange(texts)}") for c in convs for t in range(rng.randrange(1, turns))]


def test_odd_rows(spark):
    rows = [(0, None, None, "a"), (0, None, "", None), (0, 3, "user", "ü\n😀"), (0, 3, "user", "b"), (0, 3, "user", "b"), (0, 1, "user", ""), (None, 1, "user", "x"), (7, 1, "user", "a"), (7, 1, "use", "ra"), (8, 9, None, None),
            (-5, 1, "user", "a"), (-105, 1, "u", "a"), (-100, 0, "user", "base"), (250, 2, "user", "no base"), (250, 1, "user", "first"), (251, 1, "user", "no base, few turns"), (10**15 + 1, 1, "u", "far" * 50_000)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_long_and_copied_conversations_over_many_ranges(spark):
    rng = random.Random(2)
    rows = made(rng, range(130))
    rows += [(c, t, "user", "same") for c in range(5000, 5300) for t in range(3)]  # copies
    rows += [(c, t, "user", f"{t % 7}") for c in (0, 201) for t in range(10, 700)]  # conversations longer than a range
    rows += [(201, 5, "user", "tie")] * 400  # equal rows
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_ends_over_several_chunks(spark):
    rows = [(c, 0, "user", "same") for c in range(-9000, 9000, 3)]
    assert got(spark, rows) == brute(rows)


def test_equal_fingerprints_of_different_turns_are_found(spark):
    rows = made(random.Random(3), range(60), texts=200)
    assert got(spark, rows, bits=2) == brute(rows)  # the second attempt is right
    with pytest.raises(RuntimeError, match="fingerprints"):
        got(spark, rows, bits=2, attempts=1)


def test_products_are_those_of_parts():
    products = tries.Products()
    turns = np.random.default_rng(1).integers(0, 1 << 63, (9, 2)).astype(np.uint64)
    none, start = np.zeros(2, dtype=np.uint64), lambda n, *at: np.isin(np.arange(n), at)
    whole = products.along(turns, start(9, 0), none)
    plain = 0
    for t in turns:
        plain = (plain * int(products.factor[0]) + int(t[0])) % (1 << 64)
    assert int(whole[-1][0]) == plain
    parts = products.along(turns[:4], start(4, 0), none)
    assert (products.along(turns[4:], start(5), parts[-1]) == whole[4:]).all()
    both = products.along(np.concatenate([turns[4:], turns]), start(14, 5), parts[-1])
    assert (both == np.concatenate([whole[4:], whole])).all()
    assert (products.power(np.array([5])) * products.power(np.array([5]), inverse=True) == 1).all()
