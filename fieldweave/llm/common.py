"""Reading tables and cutting lineage."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.session import shared_folder

#: The contract's word: a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_folder: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """What is written within goes to a folder of its own, which is deleted at the end; no frame that reads it may be used later.

    Gives a function that writes a frame outside of that folder, as written does: the result.
    """
    outer = _folder.get() or shared_folder(spark)
    path = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    before = _folder.set(path)
    try:
        yield lambda frame, **how: written(frame, outer, **how)
    finally:
        _folder.reset(before)
        delete(spark, path)
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of frames that are not used any more; it does so when the driver's JVM drops them."""
    gc.collect()
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the store, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(frame: DataFrame) -> DataFrame:
    """The frame as written to the shared folder, so that a lost executor costs a reread only.

    It keeps the size that its query was planned with, which for a join is a product: not for loops (see written).
    """
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, folder: str | None = None, by: str | None = None, plain: bool = False) -> DataFrame:
    """As cut, for larger frames: columns in a compressed file, of which later steps read what they need; by: the column that divides its files.

    Later joins are planned with the size of the files. plain: nothing is compressed, for a frame that a join may
    broadcast; compressed files can be a tenth of what the driver would then hold.
    """
    path = f"{folder or _folder.get() or shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    out = frame.write.options(**({"compression": "uncompressed", "parquet.enable.dictionary": "false"} if plain else {"compression": "zstd"}))
    (out.partitionBy(by) if by else out).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def reduced(big: DataFrame, small: DataFrame, columns: list[str], most_bits: int = 1 << 28) -> DataFrame:
    """big without most of the rows whose columns are not in small; a join is to follow.

    The keys of small are marked in a bitmap of 16 bits a key, ``most_bits`` (32 MB) at most, that is
    broadcast: rows that match nothing are then not shuffled. Beyond that bound fewer rows are spared.
    """
    bits = 1 << 19
    keys = small.count()
    while bits < min(16 * keys, most_bits):
        bits *= 2
    place = F.pmod(F.xxhash64(*columns), F.lit(bits))
    marks = small.select(place.alias("place")).groupBy(F.expr("bitmap_bucket_number(place)").alias("__bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("__marks"))
    byte = F.conv(F.hex(F.expr("substring(__marks, cast(bitmap_bit_position(__place) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(__place) % 8 as int))")) > 0
    placed = big.withColumn("__place", place).withColumn("__bucket", F.expr("bitmap_bucket_number(__place)"))
    return placed.join(F.broadcast(marks), "__bucket").where(marked).select(*big.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(frame: DataFrame, at_least: int | None = None) -> DataFrame:
    """Rows dealt evenly before costly work per row, for inputs that come in fewer splits than there are cores."""
    wanted = at_least or frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(wanted) if frame.rdd.getNumPartitions() < wanted else frame


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
