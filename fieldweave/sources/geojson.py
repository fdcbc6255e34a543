"""GeoJSON layers and boundary rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions.geo import largest_ring, outer_rings

#: Properties differ in case between layers, so they are read as a map; coordinates differ in depth, so they are read as text.
COLLECTION = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string,string>>>"


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """pos, kind, coordinates (JSON text) and properties of each feature of a collection."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", COLLECTION).alias("c"))
    return whole.select(F.posexplode("c.features").alias("pos", "f")).select("pos", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def points(layer: DataFrame) -> DataFrame:
    pair = F.from_json("coordinates", "array<double>")
    return layer.where("kind = 'Point'").select("pos", "properties", F.get(pair, F.lit(0)).alias("lng"), F.get(pair, F.lit(1)).alias("lat"))


def lines(layer: DataFrame) -> DataFrame:
    """Lines with their points; lines without points are left out."""
    path = F.from_json("coordinates", "array<array<double>>")
    return layer.where("kind = 'LineString'").select("pos", "properties", path.alias("path")).where(F.size("path") > 0)


def first_given_property(properties: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(properties, F.lit(n)), F.lit("")) for n in names])


def find_feature(layer: DataFrame, names: list[str], value: str) -> DataFrame:
    """The first feature one of whose properties has the value; the first property that is given decides."""
    return layer.where(first_given_property(F.col("properties"), names) == value).orderBy("pos").limit(1)


def boundary(feature: DataFrame) -> DataFrame:
    """The largest outer ring of a polygon feature; other kinds raise."""
    return feature.select(largest_ring(outer_rings(F.col("kind"), F.col("coordinates"))).alias("ring"))


def read_ring(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one array of [lng, lat] pairs."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<double>>").alias("ring"))


def write_ring(ring: DataFrame, path: str) -> None:
    ring.select(F.to_json("ring").alias("value")).write.mode("overwrite").text(path)
