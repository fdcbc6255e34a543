"""Grouping, counting and metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.dates import due_label
from fieldweave.functions.values import first_given, plural, text_of
from fieldweave.session import shared_folder


def group_collect(rows: DataFrame, key: Column, order: Sequence[Column], item: Column, key_name: str = "key", most: int = 1000) -> DataFrame:
    """key, part (from 0), n (items of the key) and items in order, at most so many: a larger group has several rows."""
    numbered = group_items(rows, key, order, item, key_name)
    part = F.floor((F.col("position") - 1) / most).cast("int")
    grouped = numbered.groupBy(key_name, part.alias("part"), "n").agg(F.sort_array(F.collect_list(F.struct("position", "item"))).alias("list"))
    return grouped.select(key_name, "part", "n", F.transform("list", lambda x: x["item"]).alias("items"))


def group_items(rows: DataFrame, key: Column, order: Sequence[Column], item: Column, key_name: str = "key") -> DataFrame:
    """key, position (from 1, in order), n (items of the key) and item: group_collect for groups of any size, a row for each item.

    Rows are dealt into ranges of key and order and numbered within them; numbers before a range are added from
    the ranges' counts. So a key with very many rows is spread over tasks. The order must tell a key's rows apart.
    """
    names = [f"o{i}" for i in range(len(order))]
    shared_folder(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(key.alias("key"), *[o.alias(n) for n, o in zip(names, order)], item.alias("item")).repartitionByRange(parts, "key", *names)
    dealt = ranged.withColumn("part", F.spark_partition_id()).checkpoint()  # ranges come from a sample, so they are kept
    counts = dealt.groupBy("key", "part").agg(F.count(F.lit(1)).alias("here"))
    of_key = Window.partitionBy("key")
    before = counts.select(F.col("key").alias("k"), F.col("part").alias("p"), (F.sum("here").over(of_key.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(of_key).alias("n"))
    numbered = dealt.withColumn("number", F.row_number().over(Window.partitionBy("key", "part").orderBy(*names)))
    met = numbered.join(before, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    return met.select(F.col("key").alias(key_name), (F.col("before") + F.col("number")).alias("position"), "n", "item")


def assigned_to(column: str = "assignee") -> Column:
    return F.coalesce(first_given(column), F.lit("Unassigned"))


def task_cards(tasks: DataFrame, today, team: Mapping[str, str], order: Sequence[Column]) -> DataFrame:
    """A message for each assignee: mention, subtitle and a line for each task in order; who has very many tasks gets several, numbered by part."""
    return _cards(group_collect(tasks, assigned_to(), order, _card_line(today), "who"), team, ["part", "items"])


def task_card_lines(tasks: DataFrame, today, team: Mapping[str, str], order: Sequence[Column]) -> DataFrame:
    """task_cards for assignees with any number of tasks: a row for each task, with its position and line and what its card says."""
    return _cards(group_items(tasks, assigned_to(), order, _card_line(today), "who"), team, ["position", "item.*"])


def _card_line(today) -> Column:
    return F.struct(
        F.concat_ws(" · ", text_of("phase"), F.coalesce(first_given("evName"), F.lit("Event"))).alias("topLabel"),
        text_of("title").alias("text"),
        F.concat(F.lit("Due: "), due_label(F.col("due").try_cast("date"), today), F.coalesce(F.concat(F.lit(" · Event: "), first_given("evDate")), F.lit(""))).alias("bottomLabel"),
    )


def _cards(grouped: DataFrame, team: Mapping[str, str], carried: Sequence[str]) -> DataFrame:
    address = F.try_element_at(F.create_map(*[F.lit(x) for pair in (team or {"": ""}).items() for x in pair]), F.col("who"))
    mention = F.coalesce(F.concat(F.lit("<users/"), F.nullif(address, F.lit("")), F.lit(">")), F.col("who"))
    return grouped.select(
        "who", "n", *carried,
        F.concat(F.lit("New tasks assigned to "), mention, F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("message"),
        F.concat(plural(F.col("n"), "task"), F.lit(" assigned")).alias("subtitle"),
        F.concat(F.lit("tasks_"), F.regexp_replace("who", r"\s", "")).alias("card_id"),
    )


def delivery_totals(cards: DataFrame, delivered: Column) -> DataFrame:
    """Tasks delivered and the number of assignees, in one row."""
    return cards.agg(F.coalesce(F.sum(F.when(delivered, F.size("items"))), F.lit(0)).alias("count"), F.count_distinct("who").alias("assignees"))


def ingest_metrics(rows: DataFrame, key: Column, accepted: Column) -> DataFrame:
    """rows, rows with a key, distinct keys, and rows accepted and skipped, in one row."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(key).alias("n_with_key"),
        F.count_distinct(key).alias("n_keys"),
        F.count_if(accepted).alias("n_accepted"),
        F.count_if(~F.coalesce(accepted, F.lit(False))).alias("n_skipped"),
    )


def status_counts(events: DataFrame, keys: Sequence[Column], date: Column, progress: Column, today) -> DataFrame:
    """total, upcoming, in_progress and completed events. The documents name these counts without a rule;
    here an event is completed when all its tasks are done, in progress when some are, and upcoming when
    its day has not passed."""
    return events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(date >= F.lit(today)).alias("upcoming"),
        F.count_if((progress > 0) & (progress < 100)).alias("in_progress"),
        F.count_if(progress >= 100).alias("completed"),
    )


def progress_percent(done: Column, total: Column) -> Column:
    """Done of total in whole per cent; none of none is 0."""
    return F.when(total > 0, F.round(100.0 * done / total).cast("int")).otherwise(0)


def checked_tasks(progress: Column) -> Column:
    """How many values of a map from task to boolean are true."""
    return F.size(F.filter(F.map_values(progress), lambda done: F.coalesce(done, F.lit(False))))
