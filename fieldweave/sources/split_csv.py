"""CSV with line breaks in quoted fields, read by many tasks a file.

Spark splits a file into byte ranges at line ends, but a line may end within quotes. Whether a range starts within quotes is
told by the number of quotes before it: quotes are counted by range, summed over the ranges before (a row for each
range), and each task then knows which of its line ends end a record. Records inside a range are put together there; a
record that goes over from one range to later ones is put together from its pieces, at most two of each range.

Quotes in fields are doubled and fields that hold one are quoted (RFC 4180), so all quotes count alike. Records end with a line
feed, with or without a carriage return. Blank records are left out. Each file starts with a header; the first file's names hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: As Spark's CSV source reads the header: quotes doubled.
_OPTIONS = {"escape": '"', "header": "true", "multiLine": "true"}
_PIECES = "file string, start long, first boolean, kind string, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and where their range of it starts, in the order of the range."""
    return spark.read.option("lineSep", "\n").text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("start"), "value")


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """file, start and whether the range starts within quotes: a row for each range."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"')))
    counted = _lines(spark, path).groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = F.sum("quotes").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    return counted.select("file", "start", (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and pieces of those that another range has a part of: heads, middles and tails."""
    at, open_, inside, first, entered = None, [], False, False, False

    def piece(kind: str) -> tuple:
        return (*at, first, kind, "\n".join(open_))

    for batch in batches:
        out = []
        for file, start, value, starts_inside in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value", "inside"))):
            if (file, start) != at:
                if open_:
                    out.append(piece("middle" if entered else "head"))
                at, open_, inside, entered, first = (file, start), [], starts_inside, starts_inside, start == 0
            open_.append(value)
            if value.count('"') % 2:
                inside = not inside
            if not inside:
                out.append(piece("tail" if entered else "whole"))
                open_, entered, first = [], False, False
        yield _batch(out)
    if open_:
        yield _batch([piece("middle" if entered else "head")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in _PIECES.split(", ")])


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, first (whether it is the file's first record) and text of each record."""
    known = F.broadcast(ranges(spark, path))  # a row for each range
    pieces = _lines(spark, path).join(known, ["file", "start"]).select("file", "start", "value", "inside").mapInArrow(_pieces, _PIECES)
    # A range's tail or middle comes before its head.
    rank = F.when(F.col("kind") == "head", 1).otherwise(0)
    order = Window.partitionBy("file").orderBy("start", "rank")
    numbered = pieces.where("kind <> 'whole'").withColumn("rank", rank).withColumn("number", F.sum("rank").over(order))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "rank", "text"))), lambda p: p["text"]), "\n")
    joined = numbered.groupBy("file", "number").agg(F.bool_or("first").alias("first"), texts.alias("text"))
    every = pieces.where("kind = 'whole'").select("file", "first", "text").union(joined.select("file", "first", "text"))
    ended = F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, char_length(text) - 1)")).otherwise(F.col("text"))
    return every.select("file", "first", ended.alias("text")).where("first OR text <> ''")


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, under the header's names; empty fields are null."""
    names = spark.read.options(**_OPTIONS).csv(path).columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    fields = F.from_csv("text", schema, {"escape": '"'})
    return records(spark, path).where("NOT first").select(fields.alias("r")).select("r.*").toDF(*names)
