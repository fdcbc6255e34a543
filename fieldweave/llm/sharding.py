"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by a hash of their text and then by id, so that equal texts stand together. A
size-weighted sample of keys gives quantile boundaries; records are range-partitioned by them, and
ranges that hold too much (a text with very many copies, or sampling error) are subdivided. Exact
bytes and rows of the ranges then place every record on one global line, which is cut into shards.

Law ``bytes``: shard sizes near equal. Groups of equal texts stay in one shard unless they weigh more
than ``group_share`` of a shard; then the group is split. Law ``rows``: row counts at most one apart.

Null text counts as an empty one; null ids sort first; repeated rows each keep a slot of their own;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import cut, table

_LEVEL = 64  # boundaries are searched in two steps of up to so many comparisons


def _unit(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns only."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many boundaries are at most the key; bounds are sorted."""
    if not bounds:
        return F.lit(0)
    fine = [bounds[i : i + _LEVEL] for i in range(0, len(bounds), _LEVEL)]
    if len(bounds) % _LEVEL == 0:
        fine.append([])
    number = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.expr("cast(array() as array<bigint>)")
    at_most = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    coarse = at_most(number(bounds[_LEVEL - 1 :: _LEVEL]))
    return coarse * _LEVEL + at_most(F.element_at(F.array(*[number(x) for x in fine]), coarse + 1))


def splitters(narrow: DataFrame, total_bytes: int, total_rows: int, ranges: int, per_range: int = 64) -> tuple[list[int], list[int]]:
    """Quantile boundaries of a size-weighted key sample, and keys that alone hold more than a range's rows.

    Both lists have at most ``ranges`` entries: fewer than that many keys can each hold more than
    1/ranges of the rows.
    """
    wanted = ranges * per_range
    drawn = narrow.where(_unit(F.col("id"), F.col("key"), F.lit(7)) < F.col("size") * F.lit(wanted / max(total_bytes, 1)))
    points = [i / ranges for i in range(1, ranges)]
    got = drawn.agg(F.percentile_approx("key", points, 10 * ranges).alias("q")).first().q or []
    hot = [r.key for r in narrow.groupBy("key").count().where(F.col("count") > F.lit(max(total_rows / ranges, 1))).select("key").collect()]
    return sorted(set(got)), sorted(hot)


def shard(docs: DataFrame, shards: int = 8, law: str = "bytes", id_column: str = "doc_id", text_column: str = "text", rows_per_range: int = 250_000, least_ranges: int = 1024, group_share: float = 0.02) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of docs.

    ``least_ranges`` to 4096 ranges are cut, one for ``rows_per_range`` rows.
    """
    text = F.col(text_column)
    narrow = cut(
        docs.select(
            F.col(id_column).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
            F.monotonically_increasing_id().alias("no"),  # tells repeated rows apart; fixed, as the rows are written
        )
    )
    whole = narrow.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = int(min(4096, max(least_ranges, whole.rows // rows_per_range)))
    quantiles, hot = splitters(narrow, whole.bytes, whole.rows, ranges)
    bounds = sorted({*quantiles, *hot, *(h + 1 for h in hot if h < (1 << 63) - 1)})
    placed = narrow.withColumn("range", _range_of(F.col("key"), bounds))

    # At most 3 x 4096 ranges and as many subdivisions again: small enough to broadcast at any scale.
    mean = max(whole.rows / (len(bounds) + 1), 1.0)
    sizes = (
        placed.groupBy("range")
        .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        .withColumn("parts", F.when(F.col("n") > 2 * mean, F.ceil(F.col("n") / mean)).otherwise(1).cast("int"))
    )
    span = F.greatest(F.col("high").cast("double") - F.col("low").cast("double"), F.lit(1.0))
    along = F.floor((F.col("key").cast("double") - F.col("low").cast("double")) / span * F.col("parts"))
    part = F.when(F.col("parts") == 1, F.lit(0)).when(F.col("low") == F.col("high"), F.pmod(F.xxhash64("id", "no", F.lit(11)), F.col("parts"))).otherwise(F.least(along, F.col("parts") - 1))
    placed = placed.join(F.broadcast(sizes), "range").withColumn("part", part.cast("int")).withColumn("one_key", F.col("low") == F.col("high"))
    cells = placed.groupBy("range", "part").agg(F.count(F.lit(1)).alias("cell_rows"), F.sum("size").alias("cell_bytes"))
    before = Window.orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "range", "part",
        F.coalesce(F.sum("cell_rows").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("cell_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("cell_bytes").over(Window.partitionBy("range")).alias("range_bytes"),
    ).withColumn("range_start", F.min("bytes_before").over(Window.partitionBy("range")))
    inside = Window.partitionBy("range", "part").orderBy("key", F.asc_nulls_first("id"), "no")
    group = Window.partitionBy("range", "part", "key")
    line = (
        placed.join(F.broadcast(cells), ["range", "part"])
        .withColumn("row", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("start", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        # a group that is dealt over parts is its range
        .withColumn("group_bytes", F.when(F.col("one_key"), F.col("range_bytes")).otherwise(F.sum("size").over(group)))
        .withColumn("group_start", F.when(F.col("one_key"), F.col("range_start")).otherwise(F.min("start").over(group)))
    )
    if law == "rows":
        chosen = F.floor(F.col("row") * shards / F.lit(max(whole.rows, 1)))
    elif law == "bytes":
        whole_group = F.col("group_bytes") <= group_share * whole.bytes / shards
        middle = F.when(whole_group, F.col("group_start") + F.col("group_bytes") / 2).otherwise(F.col("start") + F.col("size") / 2)
        chosen = F.floor(middle * shards / F.lit(float(max(whole.bytes, 1))))
    else:
        raise ValueError(f"unknown law: {law}")
    line = cut(line.select("id", "size", "crc", "row", F.least(chosen, F.lit(shards - 1)).cast("int").alias("shard")))
    first = line.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return line.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_column),
        "size",
        F.col("crc").alias("text_crc32"),
        "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """Files of the documents in one folder a shard; ids must be unique here."""
    placed = docs.join(assigned.select(id_column, "shard", "slot"), id_column)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
