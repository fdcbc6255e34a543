"""Tree inventories of differing schemas, brought to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.geo import wkt_point
from fieldweave.functions.values import first_given, mapped, split_at_first
from fieldweave.operators.rows import normalised_names, renamed
from fieldweave.sources.split_csv import read_split_csv

#: Source column to target column, where they differ.
COLUMNS = {
    "objectid": "tree_id",
    "dbh": "tree_dbh",
    "genusspecies": "spc_common",
    "tpcondition": "health",
    "tpstructure": "status",
    "condition": "health",
    "nta": "nta_name",
    "census_tract": "boro_ct",
}
#: Condition in the source to health.
HEALTH = {"excellent": "Good", "good": "Good", "fair": "Fair", "poor": "Poor", "critical": "Poor", "dead": "Poor", "alive": "Good"}
REQUIRED = ("latitude", "longitude", "spc_common")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header and all columns as text; names normalised. Line breaks in quotes are no record ends, and large files are still read by many tasks."""
    return normalised_names(read_split_csv(spark, path))


def normalise(rows: DataFrame) -> DataFrame:
    """Target names, coordinates from the point column where they are missing, species split, health mapped; unknown columns stay."""
    geometry = "geometry" in rows.columns
    out = renamed(rows, COLUMNS)
    if geometry:
        # A point may come as text or as a JSON object with coordinates.
        pair = F.from_json(F.col("geometry").cast("string"), "coordinates array<double>")["coordinates"]
        point = F.coalesce(F.when(pair.isNotNull(), F.struct(F.get(pair, F.lit(1)).alias("lat"), F.get(pair, F.lit(0)).alias("lng"))), wkt_point(F.col("geometry").cast("string")))
        out = out.withColumn("__point", point)
        had = first_given(F.col("latitude").cast("string")) if "latitude" in out.columns else F.lit(None).cast("string")
        own = F.col("longitude").cast("string") if "longitude" in out.columns else F.lit(None).cast("string")
        replaced = had.isNull() & F.col("__point.lat").isNotNull()
        out = out.withColumns({"longitude": F.when(replaced, F.col("__point.lng").cast("string")).otherwise(own), "latitude": F.when(replaced, F.col("__point.lat").cast("string")).otherwise(had)}).drop("__point")
    if "spc_common" in out.columns:
        parts = split_at_first(F.col("spc_common"))
        latin = F.col("spc_latin") if "spc_latin" in out.columns else F.lit(None).cast("string")
        out = out.withColumns({"spc_latin": F.coalesce(parts["head"], latin), "spc_common": parts["tail"]})
    if "health" in out.columns:
        out = out.withColumn("health", mapped(F.col("health"), HEALTH))
    if "tree_id" in out.columns:
        out = out.withColumn("tree_id", F.col("tree_id").cast("string"))
    return out
