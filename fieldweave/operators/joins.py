"""Joins on keys: what is new, what is missing, where it can be found."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.functions.values import first_given, json_list, text_of, without_commas
from fieldweave.operators.rows import given, kept_once


def incremental_append(incoming: DataFrame, existing: DataFrame, key: str, order: Sequence[Column | str], existing_key: str | None = None) -> DataFrame:
    """The incoming rows to append: those whose key is given and not there yet, the first of each key."""
    known = existing.select(F.col(existing_key or key).alias(key))
    return kept_once(incoming.where(given(incoming, key)).join(known.where(given(known, key)), key, "left_anti"), [key], order)


def missing_keys(rows: DataFrame, key: str, known: DataFrame, known_key: str | None = None) -> DataFrame:
    """Distinct keys of the rows that are not known."""
    have = known.select(F.col(known_key or key).alias(key))
    return rows.select(key).where(given(rows, key)).distinct().join(have.where(given(have, key)), key, "left_anti")


def located(lat: str = "lat", lng: str = "lng") -> Column:
    """Both coordinates are given and not 0."""
    usable = lambda c: first_given(F.col(c).cast("string")).isNotNull() & (F.coalesce(F.col(c).try_cast("double"), F.lit(1.0)) != 0)
    return usable(lat) & usable(lng)


def lookup_cascade(keys: DataFrame, key: str, sources: Sequence[tuple[str, DataFrame]], backfill: tuple[str, str, set[str]] | None = None) -> DataFrame:
    """key, lat, lng, address, species and the name of the first source that has both coordinates.

    Each source has the key, lat, lng, address and species. A row is taken whole, never mixed from
    several sources, and keys that no source has are left out. backfill (source, column, of) fills a
    column of rows found in the sources ``of`` from another source's row where that has it.
    """
    out, chosen, fills = keys.select(key).distinct(), [], None
    for i, (name, source) in enumerate(sources):
        fields = [F.col(c).cast("string").alias(c) for c in ("lat", "lng", "address", "species")]
        one = kept_once(source, [key], ["lat", "lng", "address", "species"])
        row = F.struct(*fields, F.lit(name).alias("source"), located().alias("usable"))
        out = out.join(one.select(key, row.alias(f"s{i}")), key, "left")
        chosen.append(F.when(F.col(f"s{i}.usable"), F.col(f"s{i}")))
        if backfill and backfill[0] == name:
            fills = F.col(f"s{i}.{backfill[1]}")
    out = out.withColumn("__row", F.coalesce(*chosen)).where("__row is not null")
    told = {c: text_of(f"__row.{c}") if c in ("address", "species") else F.col(f"__row.{c}") for c in ("lat", "lng", "address", "species")}
    if backfill and fills is not None:
        column = backfill[1]
        told[column] = F.when(F.col("__row.source").isin(*backfill[2]), F.coalesce(F.nullif(fills, F.lit("")), told[column])).otherwise(told[column])
    return out.select(key, *[c.alias(n) for n, c in told.items()], F.col("__row.source").alias("source"))


def dereferenced(objects: DataFrame, reference: str, target: DataFrame, target_key: str = "key", prefix: str = "ref_") -> DataFrame:
    """objects with the columns of the row of target that a reference names; null where it names none."""
    named = target.select(*[F.col(c).alias(prefix + c) for c in target.columns])
    return objects.join(named, F.col(reference) == F.col(prefix + target_key), "left")


def variant_text(value: Column | str, path: str = "$") -> Column:
    """What stands at a path of a VARIANT, as text; null where there is nothing or a JSON null."""
    return F.try_variant_get(F.col(value) if isinstance(value, str) else value, path, "string")


def referenced(rows: DataFrame, reference: Column, target: DataFrame, target_key: str, own: Column | str) -> DataFrame:
    """rows with the columns of the target row that a reference names, null where it names none.

    Rows without a reference match nothing; they are dealt by a value of their own, as nulls would all go to one task.
    """
    asked = rows.withColumn("__there", reference.isNotNull()).withColumn("__at", F.coalesce(reference, own))
    named = target.withColumnRenamed(target_key, "__at").withColumn("__there", F.lit(True))
    return asked.join(named, ["__at", "__there"], "left").drop("__at", "__there")


def followed(objects: DataFrame, pointer: Column, cache: DataFrame, to: str) -> DataFrame:
    """objects with ``to``: the object of the cache that a pointer's __ref names, or, where it has none or names none, the pointer itself."""
    named = cache.select(F.col("key").alias("__key"), F.col("obj").alias("__named"), F.lit(True).alias("__found"))
    found = referenced(objects.withColumn("__pointer", pointer), variant_text("__pointer", "$.__ref"), named, "__key", "key")
    return found.withColumn(to, F.when(F.col("__found"), F.col("__named")).otherwise(F.col("__pointer"))).drop("__found", "__named", "__pointer")


def _as_tree(value: str, at: str = "$") -> Column:
    """What a location needs of the object at a path, as texts: no more is shuffled."""
    first = lambda *fields: first_given(*[variant_text(value, f"{at}.{f}") for f in fields])
    return F.struct(
        variant_text(value, f"{at}.id").alias("treeId"),
        first("latitude", "lat", "location.lat").alias("lat"),
        first("longitude", "lng", "lon", "location.lng").alias("lng"),
        text_of(without_commas(first("closestAddress", "address"))).alias("address"),
        variant_text(value, f"{at}.species.__ref").alias("kind"),
        variant_text(value, f"{at}.species.commonName").alias("species"),
    )


def _kinds(cache: DataFrame, salt: Column) -> DataFrame:
    """kind, salt and name of the objects of the cache that trees name as their species, once for each salt of the trees that do.

    However many trees have one species, a row of it meets no more than a salt's share of them.
    """
    told = F.array(*[F.struct(variant_text("obj", f"{at}.species.__ref").alias("kind"), variant_text("obj", f"{at}.id").alias("treeId")) for at in ("$", "$.tree")])
    asked = cache.select(F.inline(told)).where("kind is not null AND treeId is not null").select("kind", salt.alias("salt")).distinct()
    named = cache.select(F.col("key").alias("kind"), variant_text("obj", "$.commonName").alias("name"))
    return asked.join(named, "kind").groupBy("kind", "salt").agg(F.min("name").alias("name"), F.lit(True).alias("found"))


def cached_locations(cache: DataFrame) -> DataFrame:
    """treeId, lat, lng, address and species from the objects of a cache (key and obj, a VARIANT).

    Objects of a tree type come first; the tree of an activity, which it holds or points to, is used where no such
    object has its coordinates. Of several objects with one id the one with the smallest key counts. Fields that are not known don't matter.
    """
    present = first_given(variant_text("obj", "$.id")).isNotNull()
    tree = F.when(_kind().isin("tree", "streettree", "nyctree"), F.struct(F.lit(0).alias("rank"), F.lit(None).cast("string").alias("ref"), _as_tree("obj").alias("tree")))
    activity = F.when(is_activity(), F.struct(F.lit(1).alias("rank"), variant_text("obj", "$.tree.__ref").alias("ref"), _as_tree("obj", "$.tree").alias("tree")))
    told = cache.where(present).select("key", F.explode(F.array(tree, activity)).alias("t")).where("t is not null").select("key", "t.*")
    # Activities that point to one tree differ in nothing but their keys.
    told = told.where(F.col("ref").isNotNull() | located("tree.lat", "tree.lng")).groupBy("rank", "ref", "tree").agg(F.min("key").alias("key"))
    named = cache.select(F.col("key").alias("named_key"), _as_tree("obj").alias("named"), F.lit(True).alias("found"))
    told = referenced(told, F.col("ref"), named, "named_key", "key").select("rank", "key", F.when(F.col("found"), F.col("named")).otherwise(F.col("tree")).alias("tree"))
    kept = kept_once(told.select("rank", "key", "tree.*").where(located()), ["treeId"], ["rank", "key"]).drop("rank", "key")
    # Which row is kept does not depend on its species, so that one is looked up last.
    parts = 4 * int(cache.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.when(F.col("kind").isNull(), F.xxhash64("treeId")).otherwise(F.pmod(F.xxhash64("treeId"), F.lit(parts)))
    named = kept.withColumn("salt", salt).join(_kinds(cache, salt), ["kind", "salt"], "left")
    return named.select("treeId", "lat", "lng", "address", text_of(without_commas(F.when(F.col("found"), F.col("name")).otherwise(F.col("species")))).alias("species"))


def cached_activities(cache: DataFrame) -> DataFrame:
    """The cache's objects that are activities, in order of their keys: key, what records of answers have (see activities.flatten), and the object itself."""
    listed = F.coalesce(F.try_variant_get("obj", "$.stewardshipActivities", "array<string>"), json_list(variant_text("obj", "$.stewardshipActivities")))
    found = followed(cache.where(first_given(variant_text("obj", "$.id")).isNotNull() & is_activity()), F.variant_get("obj", "$.tree", "variant"), cache, "tree")
    found = followed(found, F.variant_get("tree", "$.species", "variant"), cache, "kind")
    species = F.struct(variant_text("kind", "$.commonName").alias("commonName"))
    tree = F.struct(variant_text("tree", "$.id").alias("id"), first_given(variant_text("tree", "$.closestAddress"), variant_text("tree", "$.address")).alias("closestAddress"), species.alias("species"))
    return found.select("key", *[variant_text("obj", f"$.{c}").alias(c) for c in ("id", "date", "treeId", "duration")], listed.alias("stewardshipActivities"), tree.alias("tree"), "obj").orderBy("key")


def _kind() -> Column:
    return F.lower(text_of(variant_text("obj", "$.__typename")))


def is_activity() -> Column:
    """By the type's name, or because it has what activities have."""
    there = lambda path: F.variant_get("obj", path, "variant").isNotNull()
    kind = _kind()
    return kind.contains("activity") | kind.contains("stewardship") | kind.contains("report") | (there("$.stewardshipActivities") & there("$.treeId"))


def renamed_values(rows: DataFrame, column: str, values: Mapping[str, str], to: str) -> DataFrame:
    """rows with ``to``: what the column's value is mapped to, or the value itself. The map is a literal of the plan."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return rows.withColumn(to, F.coalesce(F.try_element_at(pairs, F.col(column)), F.col(column)))
