"""Activities: landed API answers, flat rows, and the object cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.dates import day_of
from fieldweave.functions.values import joined, text_of
from fieldweave.sources.schemas import ENVELOPE


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Landed answers, one JSON object a line."""
    return spark.read.schema(ENVELOPE).json(path)


def gate(answers: DataFrame) -> DataFrame:
    """Records of the answers. An answer with errors and no data fails the load; with some data its rows are kept."""
    broken = F.col("data").isNull() & (F.coalesce(F.size("errors"), F.lit(0)) > 0)
    first = F.get(F.col("errors"), F.lit(0))["message"]
    data = F.when(broken, F.raise_error(F.concat(F.lit("the API gave no data: "), F.coalesce(first, F.lit("no message")))).cast(answers.schema["data"].dataType)).otherwise(F.col("data"))
    return answers.select(F.explode_outer(data["activityReports"]).alias("record")).where("record is not null").select("record.*")


def records_of(pages: DataFrame) -> DataFrame:
    """Records of pages of JSON objects, as gate gives them."""
    kind = ENVELOPE.split("activityReports: array<", 1)[1].rsplit(">>, errors", 1)[0]
    return pages.select(F.from_json("record", kind).alias("r")).where("r is not null").select("r.*")


def skipped(answers: DataFrame) -> DataFrame:
    """How many errors came along with data."""
    return answers.where("data is not null").agg(F.coalesce(F.sum(F.greatest(F.size("errors"), F.lit(0))), F.lit(0)).alias("n_errors"))


def flatten(records: DataFrame, scraped_at: str | Column, zone: str = "UTC") -> DataFrame:
    """Nested activities as flat rows; a missing level gives an empty text. A duration of 0 stays."""
    run = scraped_at if isinstance(scraped_at, Column) else F.lit(scraped_at)
    return records.select(
        text_of("id").alias("id"),
        day_of(F.col("date"), zone).alias("date"),
        text_of("treeId").alias("treeId"),
        text_of("tree.species.commonName").alias("species"),
        text_of("tree.closestAddress").alias("address"),
        joined(F.col("stewardshipActivities"), "; ").alias("activitiesDone"),
        text_of("duration").alias("durationMinutes"),
        run.alias("scrapedAt"),
    )


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """key and obj of an object cache landed as one JSON object a line. Objects are VARIANT: they differ in their fields, and links may hold what they point to."""
    return spark.read.schema("key string, obj variant").json(path)
