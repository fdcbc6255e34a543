import zlib

import pytest

from fieldweave.llm import sharding

DOCS = "doc_id long, text string, shard string"


def slots(rows):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return by


def test_bytes_are_near_equal(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows, texts = sharding.shard(docs).collect(), {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    size, groups = {}, {}
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        size[r.shard] = size.get(r.shard, 0) + r.size
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    largest = max(r.size for r in rows)
    weight = {t: sum(r.size for r in rows if texts[r.doc_id] == t) for t in groups}
    assert all(len(s) == 1 for t, s in groups.items() if weight[t] <= 0.02 * sum(size.values()) / 8)
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * largest
    slots(rows)


def test_rows_law_and_hot_group(spark):
    hot = [(i, "same text", "x") for i in range(700)] + [(1000 + i, f"text {i}", "x") for i in range(301)]
    by = slots(sharding.shard(spark.createDataFrame(hot, DOCS), law="rows").collect())
    counts = [len(v) for v in by.values()]
    assert sum(counts) == 1001 and max(counts) - min(counts) <= 1
    sizes = {}
    for r in sharding.shard(spark.createDataFrame(hot, DOCS)).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert max(sizes.values()) - min(sizes.values()) <= 40  # the group is split
    with pytest.raises(ValueError, match="unknown law"):
        sharding.shard(spark.createDataFrame(hot, DOCS), law="x")


def test_small_groups_stay_together_though_their_range_is_dealt_out(spark):
    made = [(i, f"group {i % 3}", "x") for i in range(90)] + [(7, "group 3", "x")] * 40 + [(1000 + i, f"text {i}", "x") for i in range(20_000)]
    shards = {}
    for r in sharding.shard(spark.createDataFrame(made, DOCS), shards=3, least_ranges=2048).collect():
        shards.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(shards[zlib.crc32(f"group {k}".encode())]) == 1 for k in range(4))


def test_odd_rows(spark):
    odd = [(1, None, "a"), (1, None, "a"), (None, "x", "b"), (None, None, None), (2, "", "c"), (3, "é" * 30000, "d")]
    rows = sharding.shard(spark.createDataFrame(odd, DOCS), shards=3).collect()
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in odd)
    slots(rows)
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def test_ranges_count_boundaries(spark):
    from pyspark.sql import functions as F

    for bounds in ([], [5], list(range(0, 640, 10)), list(range(0, 1000, 7))):
        got = spark.range(-5, 1010).select("id", sharding._range_of(F.col("id"), bounds).alias("r")).collect()
        assert all(r.r == sum(b <= r.id for b in bounds) for r in got)


def test_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    placed = sharding.shard(docs, shards=4)
    sharding.write_shards(docs, placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
