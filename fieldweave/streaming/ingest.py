"""Streaming ingestion of landed files with ids kept in the target table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldweave.operators.joins import incremental_append
from fieldweave.operators.rows import given


def appended(spark, target: str, schema: T.StructType) -> DataFrame:
    """Rows of earlier runs with the number of the batch that wrote them; none if there was no run."""
    try:
        return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(target)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("bigint"))


def ingest_available(source: DataFrame, target: str, checkpoint: str, key: str, order: Sequence[Column | str], shape: Callable[[DataFrame], DataFrame] = lambda rows: rows, metrics: str | None = None) -> None:
    """Append to the Parquet table at target what has landed since the last run: the first row of each key
    that is not there yet. The ids already known are the table itself, so no state grows in the stream.

    A batch that failed after writing is written again in its own place, so its rows appear once. With metrics, each batch also leaves
    a row there (see batch_metrics); rows are counted as they pass, without another look at them.
    """
    schema = shape(source).schema

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen, kept = Observation(), Observation()
        shaped = shape(batch)
        earlier = appended(spark, target, schema).where(F.col("batch") != number)
        if metrics:
            shaped = shaped.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.coalesce(given(shaped, key), F.lit(False))).alias("n_failed"))
        new = incremental_append(shaped, earlier, key, order)
        if metrics:
            new = new.observe(kept, F.count(F.lit(1)).alias("n_added"))
        new.write.mode("overwrite").parquet(f"{target}/batch={number}")
        if metrics:
            told = {**seen.get, **kept.get}  # a batch without rows may tell nothing
            n_rows, n_failed, n_added = (told.get(n) or 0 for n in ("n_rows", "n_failed", "n_added"))
            row = spark.createDataFrame([(n_rows, n_added, n_rows - n_added - n_failed, n_failed)], _METRICS)
            row.coalesce(1).write.mode("overwrite").parquet(f"{metrics}/batch={number}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


_METRICS = "n_rows long, n_added long, n_skipped long, n_failed long"


def batch_metrics(spark, metrics: str) -> DataFrame:
    """batch, and of its rows: how many there were, were added, were skipped (their key was there, or came twice), and failed (no key)."""
    return spark.read.schema(f"{_METRICS}, batch long").parquet(metrics)
