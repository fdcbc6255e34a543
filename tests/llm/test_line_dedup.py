"""Cuckoo filters by themselves, and the index against a plain dictionary over insertions and deletions."""

import random

import numpy as np
import pytest

from fieldweave.llm.cuckoo import Cuckoo, buckets_for, is_full
from fieldweave.llm.line_dedup import LineIndex

BLANK = " \t\n\x0b\x0c\r"
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(there, docs):
    """doc_id, n_lines, n_dropped and kept of docs, where there are the documents of the index."""
    holders = {}
    for doc, text in there:
        for line in (text or "").split("\n"):
            if doc is not None:
                holders.setdefault(line.strip(BLANK).translate(UPPER), set()).add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        keys = [line.strip(BLANK).translate(UPPER) for line in lines]
        left = [line for line, key in zip(lines, keys) if doc is None or len(key) < 10 or len(holders[key]) < 2 or doc == min(holders[key])]
        out.append((doc, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id long, text string, key string, n int, pos int")


def told(index, spark, docs):
    return sorted(map(tuple, index.kept(frame(spark, docs)).collect()), key=repr)


def state(index):
    return sorted((bytes(r.key), r.n, r["first"], r["last"]) for r in index.counts().where("n > 0").collect())


def held(index, keys):
    filters = {r.shard: Cuckoo(r.buckets, bytes(r.cells)) for r in index.filters().collect()}
    return [filters[r.shard].holds(np.frombuffer(bytes(r.key), dtype=np.uint64).reshape(1, 2))[0] for r in keys]


@pytest.mark.parametrize("load", [0.3, 0.66, 0.95])
def test_filter_holds_all_and_forgets_what_is_removed(load):
    rng = np.random.default_rng(3)
    filter_ = Cuckoo(1024)
    keys = rng.integers(0, 1 << 63, (int(4096 * load), 2)).astype(np.uint64)
    for part in np.array_split(keys, 3):
        filter_.add(part)
    assert filter_.holds(keys).all() and (filter_.cells > 0).sum() + len(filter_.spare) == len(keys)
    others = rng.integers(0, 1 << 63, (20_000, 2)).astype(np.uint64)
    assert filter_.holds(others).mean() < 0.002
    again = Cuckoo(1024, filter_.to_bytes())
    again.remove(keys[::2])
    assert again.holds(keys[1::2]).all() and again.holds(keys[::2]).mean() < 0.01
    again.remove(keys[1::2])
    assert not again.cells.any() and not len(again.spare)
    with pytest.raises(KeyError):
        again.remove(keys[:1])


def test_filter_past_its_room():
    keys = np.random.default_rng(4).integers(0, 1 << 63, (40, 2)).astype(np.uint64)
    small = Cuckoo(4)
    small.add(keys)  # 16 slots; the rest are spare
    assert len(small.spare) == 24 and small.holds(keys).all()
    small = Cuckoo(4, small.to_bytes())
    small.remove(keys[:39])
    assert small.holds(keys[39:]).all()
    assert buckets_for(0) == 4 and not is_full(100, buckets_for(100)) and is_full(100, 16)


def test_same_fingerprint_many_times():
    keys = np.array([[7 << 48 | i, 2] for i in range(12)], dtype=np.uint64)  # two buckets have 8 slots
    filter_ = Cuckoo(64)
    filter_.add(keys)
    assert filter_.holds(keys).all()
    filter_.remove(keys)
    assert not filter_.holds(keys).any()


ODD = [(1, None), (2, ""), (None, "a line of its own\nx"), (None, "a line of its own"), (3, "A line of its OWN \n\nshort\nshort\na line of its own"), (4, "\ta line of its own\r\nother line 4"),
       (4, "a second row of four\na line of its own"), (4, "a second row of four\na line of its own"), (-5, "Ünïcode línê ten\n123456789\n 123456789 "), (6, "ünïcode línê ten\nÜnïcode línê TEN\n123456789"), (7, "\n\n\n"), (10**14, "w " * 200_000 + "\nother line 4")]


@pytest.mark.parametrize("passes", [1, 3])
def test_odd_rows(spark, tmp_path, passes):
    index = LineIndex(spark, f"{tmp_path}/i", shards=3)
    index.insert(frame(spark, ODD), passes=passes)
    assert told(index, spark, ODD) == brute(ODD, ODD)


def test_empty_tables(spark, tmp_path):
    index = LineIndex(spark, f"{tmp_path}/i", shards=2)
    index.insert(frame(spark, ODD).limit(0))
    index.delete(frame(spark, ODD))
    assert told(index, spark, ODD[:1]) == [(1, 1, 0, "")] and index.kept(frame(spark, ODD).limit(0)).count() == 0


def test_insertions_and_deletions(spark, tmp_path):
    rng = random.Random(8)
    lines = [f"line number {i}" for i in range(60)]
    made = lambda first, n: [(first + i, "\n".join(rng.choice(["the common line", f"own line {first + i}", rng.choice(lines)]) for _ in range(rng.randrange(6)))) for i in range(n)]
    one, two, three = made(100, 30), made(0, 40), made(200, 300)
    index = LineIndex(spark, f"{tmp_path}/i", shards=2)
    index.insert(frame(spark, one))
    after_one = state(index)
    index.insert(frame(spark, two))
    assert told(index, spark, one + two) == brute(one + two, one + two)
    index.delete(frame(spark, two))  # all is as before
    assert state(index) == after_one and told(index, spark, one) == brute(one, one)
    gone = index.counts().where("n = 0").collect()
    assert gone and sum(held(index, gone)) <= 1 and all(held(index, index.counts().where("n > 0").collect()))
    index.insert(frame(spark, two[::2]))  # some come back
    index = LineIndex(spark, f"{tmp_path}/i")  # and another session goes on
    assert index.shards == 2
    index.insert(frame(spark, three), passes=2)  # filters grow
    index.delete(frame(spark, one[:10]))
    there = one[10:] + two[::2] + three
    assert told(index, spark, there) == brute(there, there)
    assert all(held(index, index.counts().where("n > 0").collect()))


def test_a_generation_that_failed_is_not_seen(spark, tmp_path, monkeypatch):
    index = LineIndex(spark, f"{tmp_path}/i", shards=2)
    index.insert(frame(spark, ODD[:5]))
    for step in ("_refilter", "_complete"):
        with monkeypatch.context() as broken:
            def fail(*_):
                raise OSError("lost")

            broken.setattr(LineIndex, step, fail)
            with pytest.raises(OSError):
                index.insert(frame(spark, ODD[5:]), passes=2)
        assert told(index, spark, ODD[:5]) == brute(ODD[:5], ODD[:5])
    index.insert(frame(spark, ODD[5:]))
    assert told(index, spark, ODD) == brute(ODD, ODD)
