"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.functions import dates, geo, values
from fieldweave.operators import groups, joins, rings, rows
from fieldweave.plans import workflow
from fieldweave.session import shared_folder
from fieldweave.sources import activities, paged
from fieldweave.streaming.ingest import appended, ingest_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = dt.date(1998, 6, 15)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prop():
    return F.get_json_object("props", "$.k")


# Activities: flatten, dates, duplicates, incremental append.


@query("SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%d') AS date, user_id::VARCHAR AS \"treeId\", coalesce(event_type, '') AS species, '' AS address, coalesce(json_extract_string(props, '$.k'), '') AS \"activitiesDone\", coalesce(value::VARCHAR, '') AS \"durationMinutes\", '2024-02-01' AS \"scrapedAt\" FROM events")
def flatten_activity(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    species = F.struct(F.col("event_type").alias("commonName"))
    nested = e.select(
        F.col("event_id").cast("string").alias("id"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("string").alias("date"),
        F.col("user_id").cast("string").alias("treeId"),
        F.col("value").cast("string").alias("duration"),
        F.when(_prop().isNotNull(), F.array(_prop())).alias("stewardshipActivities"),
        F.struct(F.lit(None).cast("string").alias("closestAddress"), species.alias("species")).alias("tree"),
    )
    return activities.flatten(nested, "2024-02-01")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date_utc(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    return table(spark, sf_dir, "events").select("event_id", dates.day_of(ms).alias("day"))


@query("SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d') AS day FROM events")
def date_new_york(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.day_of_timestamp(F.col("ts"), "America/New_York").alias("day"))


_LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice) = 1")
def dedup_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return rows.kept_once(lines, ["l_orderkey", "l_linenumber"], _LINE_ORDER)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1")
def dedup_last(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return rows.kept_once(lines, ["l_orderkey", "l_linenumber"], _LINE_ORDER, keep="last")


@query(
    "SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%d') AS date, coalesce(json_extract_string(props, '$.k'), '') AS done FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_id NOT IN (SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20') QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts, props) = 1"
)
def incremental_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), "ts", "props")
    new = joins.incremental_append(e.where("ts >= timestamp_ntz'2024-01-15'"), e.where("ts < timestamp_ntz'2024-01-20'"), "id", ["ts", "props"])
    return new.select("id", dates.day_of_timestamp(F.col("ts")).alias("date"), values.text_of(_prop()).alias("done")).orderBy("date", "id")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-02') GROUP BY user_id")
def incremental_append_by_user(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return joins.incremental_append(e.where("ts >= timestamp_ntz'2024-01-20'"), e.where("ts < timestamp_ntz'2024-01-02'"), "user_id", ["event_id"]).select("user_id", "event_id")


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def missing_keys(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    return joins.missing_keys(table(spark, sf_dir, "orders"), "o_custkey", known, "c_custkey")


@query(
    """
    WITH keys AS (SELECT DISTINCT user_id AS k FROM events),
    one AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS lat, c_nationkey + 1.0 AS lng, c_name AS address, '' AS species FROM customer WHERE c_custkey % 3 = 0),
    two AS (SELECT s_suppkey AS k, s_acctbal AS lat, s_nationkey + 1.0 AS lng, s_name AS address, 'two' AS species FROM supplier)
    SELECT keys.k AS "user_id",
      CASE WHEN one.lat <> 0 AND one.lng <> 0 THEN 'one' ELSE 'two' END AS source,
      CASE WHEN one.lat <> 0 AND one.lng <> 0 THEN one.address ELSE two.address END AS address,
      CASE WHEN one.lat <> 0 AND one.lng <> 0 THEN one.lat ELSE two.lat END::DOUBLE AS lat, CASE WHEN one.lat <> 0 AND one.lng <> 0 THEN one.lng ELSE two.lng END::DOUBLE AS lng,
      CASE WHEN one.lat <> 0 AND one.lng <> 0 THEN coalesce(two.species, '') ELSE two.species END AS species
    FROM keys LEFT JOIN one USING (k) LEFT JOIN two USING (k) WHERE (one.lat <> 0 AND one.lng <> 0) OR (two.lat <> 0 AND two.lng <> 0)
    """
)
def lookup_cascade(spark, sf_dir):
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    one = customer.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 4 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("lat"), (F.col("c_nationkey") + 1.0).alias("lng"), F.col("c_name").alias("address"), F.lit("").alias("species"))
    two = supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_acctbal").alias("lat"), (F.col("s_nationkey") + 1.0).alias("lng"), F.col("s_name").alias("address"), F.lit("two").alias("species"))
    found = joins.lookup_cascade(table(spark, sf_dir, "events"), "user_id", [("one", one), ("two", two)], backfill=("two", "species", {"one"}))
    return found.select("user_id", "source", "address", "species", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))


@query("SELECT a.c_custkey, b.s_name AS ref_s_name FROM customer a LEFT JOIN supplier b ON a.c_custkey = b.s_suppkey")
def dereference(spark, sf_dir):
    return joins.dereferenced(table(spark, sf_dir, "customer"), "c_custkey", table(spark, sf_dir, "supplier"), "s_suppkey").select("c_custkey", "ref_s_name")


@query("SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 200 OFFSET 400")
def page_offset(spark, sf_dir):
    return rows.page(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 200, 400)


@query("SELECT event_id, event_type FROM events WHERE event_id > 4999 ORDER BY event_id LIMIT 200")
def page_cursor(spark, sf_dir):
    return rows.page_after(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 200, 4999)


@query("SELECT event_id, event_type FROM events")
def union_pages(spark, sf_dir):
    """All events, as pages of 500 raw records in order, read up to the first page that is short."""
    e = table(spark, sf_dir, "events")
    record = F.to_json(F.struct("event_id", "event_type"))
    numbered = groups.group_items(e, F.lit("all"), [F.col("event_id"), F.col("ts"), F.col("event_type")], record)
    before = F.col("position") - 1
    pages = numbered.select((before - before % 500).alias("offset"), (before % 500).alias("position"), F.col("item").alias("record"))
    return paged.until_short(pages, 500).select(F.from_json("record", "event_id long, event_type string").alias("r")).select("r.*")


@query("SELECT event_id, event_type FROM events")
def union_all_pages(spark, sf_dir):
    return rows.union_pages(rows.key_pages(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 8))


@query("SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderstatus AS status FROM orders ORDER BY date, id")
def sorted_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderstatus").alias("status"))
    return o.orderBy(*rows.snapshot_order())


@query("SELECT p_partkey, p_brand FROM part WHERE p_size > 40 AND p_type = 'ECONOMY'")
def fallback_first_nonempty(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_type")
    tries = [F.col("p_size") > 1000, (F.col("p_size") > 40) & (F.col("p_type") == "ECONOMY"), F.col("p_size") > 0]
    return rows.first_nonempty_filter(part, tries).select("p_partkey", "p_brand")


# Filters.


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def where_conjunction(spark, sf_dir):
    clause = paged.where_clause({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return table(spark, sf_dir, "orders").where(clause).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def where_equalities(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(spark, sf_dir):
    return rows.in_list(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


def _points(spark, sf_dir):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", at(0).alias("lat"), at(1).alias("lng"))


@query("SELECT vec_id FROM embeddings WHERE embedding[1]::DOUBLE > -0.1::DOUBLE AND embedding[1]::DOUBLE < 0.1::DOUBLE AND embedding[2]::DOUBLE > -0.05::DOUBLE AND embedding[2]::DOUBLE < 0.15::DOUBLE")
def bbox(spark, sf_dir):
    return _points(spark, sf_dir).where(geo.in_box(F.col("lat"), F.col("lng"), geo.Box(-0.1, 0.1, -0.05, 0.15))).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE embedding[1]::DOUBLE <> 0 AND embedding[1]::DOUBLE > -0.1::DOUBLE AND embedding[1]::DOUBLE < 0.1::DOUBLE AND embedding[2]::DOUBLE < 0.15::DOUBLE AND embedding[2]::DOUBLE > CASE WHEN embedding[1]::DOUBLE > 0.02::DOUBLE THEN -0.03::DOUBLE ELSE -0.12::DOUBLE END")
def banded_bbox(spark, sf_dir):
    return _points(spark, sf_dir).where(geo.in_banded_box(F.col("lat"), F.col("lng"), geo.Box(-0.1, 0.1, -9.0, 0.15), 0.02, -0.03, -0.12)).select("vec_id")


@query("SELECT c_custkey, c_name FROM customer WHERE CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::VARCHAR WHEN c_custkey % 3 = 0 THEN '7' ELSE '' END = '7' ORDER BY c_custkey LIMIT 1")
def coalesce_match(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    even, third = F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey").cast("string")), F.when(F.col("c_custkey") % 3 == 0, "7")
    return c.where(values.first_given(even, third) == "7").orderBy("c_custkey").limit(1).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE '%widget%' OR (p_type IN ('STANDARD') AND p_size IS NOT NULL)")
def substring_predicate(spark, sf_dir):
    name = F.lower("p_name")
    return table(spark, sf_dir, "part").where(name.contains("ring") | name.contains("widget") | (F.col("p_type").isin("STANDARD") & F.col("p_size").isNotNull())).select("p_partkey", "p_name")


_RING = [(-0.2, -0.2), (0.2, -0.15), (0.05, 0.0), (0.2, 0.2), (-0.15, 0.18), (-0.2, -0.2)]


@query(
    "WITH ring(i, x1, y1, x2, y2) AS (VALUES "
    + ", ".join(f"({i}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for i, (a, b) in enumerate(zip(_RING, _RING[1:])))
    + "), p AS (SELECT vec_id, embedding[1]::DOUBLE AS lat, embedding[2]::DOUBLE AS lng FROM embeddings) SELECT vec_id, count(*) FILTER (((y1 > lat) <> (y2 > lat)) AND lng < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)) % 2 = 1 AS inside FROM p, ring GROUP BY vec_id"
)
def point_in_polygon(spark, sf_dir):
    return _points(spark, sf_dir).select("vec_id", geo.in_ring(F.col("lng"), F.col("lat"), geo.ring_literal(_RING)).alias("inside"))


@query(
    """
    WITH centres AS (SELECT n_nationkey, (n_nationkey % 5) * 0.05::DOUBLE - 0.1::DOUBLE AS x, (n_nationkey // 5) * 0.05::DOUBLE - 0.1::DOUBLE AS y FROM nation),
    corners AS (SELECT n_nationkey, [x - 0.07::DOUBLE, x, x + 0.07::DOUBLE, x, x - 0.07::DOUBLE] AS xs, [y, y + 0.06::DOUBLE, y, y - 0.03::DOUBLE, y] AS ys FROM centres),
    edges AS (SELECT n_nationkey, xs[i] AS x1, ys[i] AS y1, xs[i + 1] AS x2, ys[i + 1] AS y2 FROM corners, range(1, 5) r(i)),
    p AS (SELECT vec_id, embedding[1]::DOUBLE AS lat, embedding[2]::DOUBLE AS lng FROM embeddings)
    SELECT vec_id, n_nationkey FROM p, edges GROUP BY ALL HAVING count(*) FILTER (((y1 > lat) <> (y2 > lat)) AND lng < x1 + (lat - y1) / (y2 - y1) * (x2 - x1)) % 2 = 1
    """
)
def rings_of_points(spark, sf_dir):
    """A ring for each nation; they overlap."""
    n = table(spark, sf_dir, "nation")
    x, y = (F.col("n_nationkey") % 5) * F.lit(0.05) - F.lit(0.1), F.floor(F.col("n_nationkey") / 5) * F.lit(0.05) - F.lit(0.1)
    corners = [(x - 0.07, y), (x, y + 0.06), (x + 0.07, y), (x, y - 0.03), (x - 0.07, y)]
    nations = n.select("n_nationkey", F.array(*[F.array(a, b) for a, b in corners]).alias("ring"))
    return rings.points_in_rings(_points(spark, sf_dir).select("vec_id", "lng", "lat"), nations, 0.01, "n_nationkey").select("vec_id", "n_nationkey")


@query("SELECT title, description, due FROM (SELECT 'Order ' || o_orderkey || ' — ' || o_orderstatus AS title, 'Event: ' || o_orderstatus || chr(10) || 'Phase: ' || o_orderpriority || chr(10) || 'Assignee: ' || chr(10) || 'Event date: ' AS description, CASE WHEN o_orderkey % 3 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS due FROM orders) WHERE due IS NOT NULL")
def task_titles(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    none = F.lit(None).cast("string")
    due = F.when(F.col("o_orderkey") % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return workflow.task_titles(o.select(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("o_orderstatus").alias("evName"), F.col("o_orderpriority").alias("phase"), none.alias("assignee"), due.alias("due"), none.alias("evDate")))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate <= DATE '1998-12-31'")
def task_filter(spark, sf_dir):
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("assignee"), F.col("o_orderpriority").alias("phase"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("due"))
    return workflow.task_filter(tasks, "F", dt.date(1997, 1, 1), dt.date(1998, 12, 31), "2-HIGH").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%red%'")
def type_eligibility(spark, sf_dir):
    return table(spark, sf_dir, "part").where(workflow.is_kind("p_name", "ring", "red")).select("p_partkey")


# Groups and counts.


@query("SELECT o_orderkey::VARCHAR AS id FROM orders WHERE o_orderkey % 3 = 0")
def ticketed_events(spark, sf_dir):
    """Public events and workshops; here an order whose number 3 divides is a public one."""
    return _event_shape(spark, sf_dir).where(workflow.is_ticketed()).select("id")


@query("SELECT c_nationkey, c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY length(c_mktsegment) DESC, c_custkey) = 1")
def argmax_first_tie(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return rows.argmax_first(c, ["c_nationkey"], F.length("c_mktsegment"), F.col("c_custkey"), {"c_custkey": F.col("c_custkey"), "c_mktsegment": F.col("c_mktsegment")})


@query("SELECT who, part, n, string_agg(event_type, '; ' ORDER BY ts, event_id) AS items FROM (SELECT *, ((row_number() OVER (PARTITION BY who ORDER BY ts, event_id) - 1) // 1000)::INTEGER AS part, count(*) OVER (PARTITION BY who) AS n FROM (SELECT *, coalesce(user_id::VARCHAR, 'Unassigned') AS who FROM events)) GROUP BY who, part, n")
def group_collect(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    who = F.coalesce(values.first_given(F.col("user_id").cast("string")), F.lit("Unassigned"))
    return groups.group_collect(e, who, [F.col("ts"), F.col("event_id")], F.col("event_type"), "who").select("who", "part", values.joined(F.col("items")).alias("items"), "n")


@query("SELECT coalesce(user_id::VARCHAR, 'Unassigned') AS who, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, count(*) OVER (PARTITION BY user_id) AS n, event_type AS item FROM events")
def group_items(spark, sf_dir):
    who = F.coalesce(values.first_given(F.col("user_id").cast("string")), F.lit("Unassigned"))
    return groups.group_items(table(spark, sf_dir, "events"), who, [F.col("ts"), F.col("event_id")], F.col("event_type"), "who")


@query("SELECT user_id, string_agg(DISTINCT event_type, '; ' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def array_join(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(values.joined(F.array_sort(F.collect_set("event_type"))).alias("kinds"))


@query("SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'Unassigned' ELSE o_orderpriority END AS who, count(*) AS n FROM orders GROUP BY 1")
def group_count(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("assignee", F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")))
    return o.groupBy(groups.assigned_to().alias("who")).agg(F.count(F.lit(1)).alias("n"))


def _order_tasks(o):
    return o.select(F.col("o_orderkey").cast("string").alias("title"), F.col("o_orderstatus").alias("evName"), F.col("o_orderpriority").alias("phase"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority")).alias("assignee"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("due"), F.lit("").alias("evDate"), "o_orderkey")


_LINES_SQL = """
    SELECT who, n, position, 'New tasks assigned to ' || CASE who WHEN '1-URGENT' THEN '<users/a@example.org>' ELSE who END || ' (' || n || ')' AS message,
      n || ' task' || CASE WHEN n > 1 THEN 's' ELSE '' END || ' assigned' AS subtitle, 'tasks_' || replace(who, ' ', '') AS card_id,
      o_orderpriority || ' · ' || o_orderstatus AS "topLabel", o_orderkey::VARCHAR AS text,
      'Due: ' || CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Tomorrow' WHEN d = -1 THEN 'Yesterday' WHEN d < 0 THEN (-d) || ' days overdue' WHEN d <= 14 THEN 'In ' || d || ' days' ELSE strftime(o_orderdate, '%b %-d, %Y') END AS "bottomLabel"
    FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY o_orderkey) AS position, count(*) OVER (PARTITION BY who) AS n
      FROM (SELECT *, date_diff('day', DATE '1998-06-15', o_orderdate::DATE) AS d, CASE WHEN o_orderkey % 7 = 0 THEN 'Unassigned' ELSE o_orderpriority END AS who FROM orders))
"""


@query(_LINES_SQL)
def task_card_lines(spark, sf_dir):
    tasks = _order_tasks(table(spark, sf_dir, "orders"))
    return groups.task_card_lines(tasks, AS_OF, {"1-URGENT": "a@example.org"}, [F.col("o_orderkey")])


@query(
    f"""
    SELECT who, part, n, any_value(message) AS message, any_value(subtitle) AS subtitle, any_value(card_id) AS card_id, string_agg("topLabel" || ' | ' || text || ' | ' || "bottomLabel", chr(10) ORDER BY position) AS lines
    FROM (SELECT *, ((position - 1) // 1000)::INTEGER AS part FROM ({_LINES_SQL})) GROUP BY who, part, n
    """
)
def task_cards(spark, sf_dir):
    cards = groups.task_cards(_order_tasks(table(spark, sf_dir, "orders")), AS_OF, {"1-URGENT": "a@example.org"}, [F.col("o_orderkey")])
    line = lambda x: F.concat_ws(" | ", x["topLabel"], x["text"], x["bottomLabel"])
    return cards.withColumn("lines", F.array_join(F.transform("items", line), "\n")).drop("items")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS told FROM orders")
def map_lookup(spark, sf_dir):
    return joins.renamed_values(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", {"F": "finished", "O": "open"}, "told").select("o_orderkey", "told")


@query("SELECT c_custkey, CASE lower(c_mktsegment) WHEN 'machinery' THEN 'Good' WHEN 'household' THEN 'Poor' ELSE c_mktsegment END AS health FROM customer")
def value_map(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", values.mapped(F.col("c_mktsegment"), {"machinery": "Good", "household": "Poor"}).alias("health"))


@query("SELECT count(*) AS n_rows, count(user_id) AS n_with_key, count(DISTINCT user_id) AS n_keys, count(*) FILTER (event_type = 'click') AS n_accepted, count(*) FILTER (coalesce(event_type <> 'click', true)) AS n_skipped FROM events")
def ingest_metrics(spark, sf_dir):
    return groups.ingest_metrics(table(spark, sf_dir, "events"), F.col("user_id"), F.col("event_type") == "click")


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderdate >= DATE '1998-06-15') AS upcoming, count(*) FILTER (o_orderstatus = 'P') AS in_progress, count(*) FILTER (o_orderstatus = 'F') AS completed FROM orders GROUP BY o_orderpriority")
def status_counts(spark, sf_dir):
    progress = F.when(F.col("o_orderstatus") == "F", 100).when(F.col("o_orderstatus") == "P", 50).otherwise(0)
    return groups.status_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.to_date("o_orderdate"), progress, AS_OF)


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total, round(100.0::DOUBLE * count(*) FILTER (o_orderstatus = 'F') / count(*))::INTEGER AS progress FROM orders GROUP BY o_custkey")
def progress_pct(spark, sf_dir):
    counted = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("total"))
    return counted.withColumn("progress", groups.progress_percent(F.col("done").cast("double"), F.col("total")))


# Events and tasks.

_TEMPLATE_SQL = ", ".join(f"('{k}', '{p}', {c}, {'NULL' if workflow.PHASES[p] is None else workflow.PHASES[p]})" for k, cs in workflow.TEMPLATES.items() for p, c in zip(workflow.PHASES, cs))
_KINDS = ["Field Trip", "Private Volunteer", "Public Volunteer", "Public Program", "Other"]


@query(
    f"""
    WITH template(type, phase, tasks, day_offset) AS (VALUES {_TEMPLATE_SQL}),
    tasks AS (SELECT type, phase, day_offset, unnest(range(1, tasks + 1)) AS task FROM template),
    typed AS (SELECT o_orderkey, o_orderdate::DATE AS d, ['{"', '".join(_KINDS)}'][1 + (o_orderkey % 5)] AS type FROM orders)
    SELECT o_orderkey, type, phase, task::INTEGER AS task, CASE WHEN day_offset IS NULL THEN d - 60 ELSE d + day_offset::INTEGER END AS due FROM typed JOIN tasks USING (type)
    """
)
def task_expansion(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("o_orderkey") % 5).cast("int"))
    return workflow.expand_tasks(o, F.col("d"), kind, F.date_sub("d", 60), ["o_orderkey"])


@query(
    """
    SELECT o_orderkey, CASE WHEN d IS NULL THEN 'TBD' WHEN n = 0 THEN 'Today' WHEN n = 1 THEN 'Tomorrow' WHEN n = -1 THEN 'Yesterday' WHEN n < 0 THEN (-n) || ' days overdue' WHEN n <= 14 THEN 'In ' || n || ' days' ELSE strftime(d, '%b %-d, %Y') END AS label
    FROM (SELECT o_orderkey, d, date_diff('day', DATE '1998-06-15', d) AS n FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate::DATE END AS d FROM orders))
    """
)
def due_label(spark, sf_dir):
    due = F.when(F.col("o_orderkey") % 11 > 0, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.due_label(due, AS_OF).alias("label"))


_CLOCK_SQL = """
    SELECT event_id, CASE WHEN h IS NULL THEN NULL ELSE lpad((CASE WHEN lower(half) = 'pm' AND h < 12 THEN h + 12 WHEN lower(half) = 'am' AND h = 12 THEN 0 ELSE h END)::VARCHAR, 2, '0') || ':' || lpad(coalesce(m, 0)::VARCHAR, 2, '0') || ':00' END AS clock
    FROM (SELECT event_id, try_cast(regexp_extract(t, p, 1) AS INTEGER) AS h, try_cast(regexp_extract(t, p, 2) AS INTEGER) AS m, regexp_extract(t, p, 3) AS half
      FROM (SELECT event_id, '([0-9]{1,2})(?::([0-9]{2}))?[ ]*(am|pm|AM|PM)?' AS p, CASE event_id % 5 WHEN 0 THEN 'TBD' WHEN 1 THEN (event_id % 24) || ':30' WHEN 2 THEN (event_id % 12 + 1) || 'pm' WHEN 3 THEN (event_id % 12 + 1) || ':05 AM' ELSE (event_id % 100) || ' - 4Pm' END AS t FROM events))
"""


@query(_CLOCK_SQL)
def parse_time(spark, sf_dir):
    i = F.col("event_id")
    text = lambda *parts: F.concat(*[p.cast("string") for p in parts])
    t = F.when(i % 5 == 0, "TBD").when(i % 5 == 1, text(i % 24, F.lit(":30"))).when(i % 5 == 2, text(i % 12 + 1, F.lit("pm"))).when(i % 5 == 3, text(i % 12 + 1, F.lit(":05 AM"))).otherwise(text(i % 100, F.lit(" - 4Pm")))
    return table(spark, sf_dir, "events").select("event_id", dates.clock(t).alias("clock"))


@query(
    """
    SELECT event_id::VARCHAR AS id, event_type AS name, 'Join us for ' || event_type AS description,
      strftime((strptime(strftime(ts, '%Y-%m-%d') || ' ' || (event_id % 23) || ':15:00', '%Y-%m-%d %H:%M:%S') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS start,
      strftime(((strptime(strftime(ts, '%Y-%m-%d') || ' ' || (event_id % 23) || ':15:00', '%Y-%m-%d %H:%M:%S') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC') + INTERVAL 2 HOURS, '%Y-%m-%dT%H:%M:%SZ') AS "end",
      event_type LIKE '%error%' AND false AS online,
      CASE WHEN event_id % 90 = 0 THEN 50 ELSE (event_id % 90)::INTEGER END AS capacity
    FROM events
    """
)
def ticket_window(spark, sf_dir):
    none, i = F.lit(None).cast("string"), F.col("event_id")
    return workflow.ticket(
        table(spark, sf_dir, "events").select(
            i.cast("string").alias("id"), F.col("event_type").alias("name"), none.alias("extName"), none.alias("description"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
            F.concat((i % 23).cast("string"), F.lit(":15")).alias("time"), F.col("event_type").alias("type"), F.concat((i % 90).cast("string"), F.lit(" people")).alias("attendance"),
        )
    )


def _event_shape(spark, sf_dir):
    """Orders in the shape of events."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    given = {
        "id": key.cast("string"), "name": F.concat(F.lit("Order "), key.cast("string")), "owner": F.col("o_orderpriority"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "time": F.when(key % 2 == 0, "2pm"), "type": F.when(key % 3 == 0, "Public Volunteer").when(key % 3 == 1, "Private Virtual"), "collab": F.when(key % 4 == 0, "Other Organization").otherwise("None"),
        "collabNotes": F.col("o_orderstatus"), "categories": F.when(key % 5 > 0, F.array(F.col("o_orderstatus"), F.lit("x"))),
    }
    names = [p.split()[0] for p in workflow.EVENT.split(", ")]
    kinds = dict(p.split() for p in workflow.EVENT.split(", "))
    return o.select(*[given.get(n, F.lit(None).cast(kinds[n])).alias(n) for n in names])


_EVENT_SQL = """
    ev AS (SELECT o_orderkey::VARCHAR AS id, 'Order ' || o_orderkey AS name, o_orderpriority AS owner, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN '2pm' END AS time,
      CASE o_orderkey % 3 WHEN 0 THEN 'Public Volunteer' WHEN 1 THEN 'Private Virtual' END AS type, CASE WHEN o_orderkey % 4 = 0 THEN 'Other Organization' ELSE 'None' END AS collab,
      o_orderstatus AS notes, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus || ', x' ELSE '' END AS categories FROM orders)
"""


@query(
    f"""WITH {_EVENT_SQL} SELECT name AS c01, owner AS c02, date AS c03, coalesce(time, '') AS c04, '' AS c05, categories AS c06, type AS c07, collab AS c08, notes AS c09,
    CASE WHEN type LIKE '%Public%' THEN '' ELSE 'N/A (not a public event)' END AS c10, CASE WHEN type LIKE '%Public%' THEN '' ELSE 'N/A' END AS c11, '' AS c12, CASE WHEN type LIKE '%Public%' THEN '' ELSE 'N/A' END AS c13,
    false AS c14, false AS c15, '' AS c16, false AS c17, false AS c18, false AS c19, '' AS c20, '' AS c21 FROM ev"""
)
def tracker_row(spark, sf_dir):
    return workflow.tracker_row(_event_shape(spark, sf_dir))


def _brief_sql() -> str:
    known = {
        "Event Name (Internal)": "name", "Event Lead": "owner", "Program Category": "CASE WHEN categories = '' THEN 'TBD' ELSE categories END", "Date": "date", "Time": "coalesce(time, 'TBD')", "Status": "'CONFIRMED'",
        "Format": "CASE WHEN type LIKE '%Virtual%' THEN 'Virtual' ELSE 'In-person' END", "Partner/s": "CASE WHEN collab = 'Other Organization' THEN notes ELSE 'N/A' END",
        "Client/s": "CASE WHEN type LIKE '%Private%' OR type LIKE '%School%' THEN notes ELSE 'N/A' END", "Event Name (External)": "name", "Expenses": "'NO'",
    }
    parts = [f"SELECT id, {i} AS position, '{s}' AS section, '{n}' AS label, {known.get(n, chr(39) + 'TBD' + chr(39))} AS value FROM ev" for i, (s, n) in enumerate(_BRIEF_LABELS)]
    return f"WITH {_EVENT_SQL} " + " UNION ALL ".join(parts)


#: Labels of a brief.
_BRIEF_LABELS = [
    ("", "Status"), ("EVENT OVERVIEW", "Event Name (Internal)"), ("EVENT OVERVIEW", "Event Lead"), ("EVENT OVERVIEW", "On-Site Support"), ("EVENT OVERVIEW", "Program Category"), ("EVENT OVERVIEW", "Format"),
    ("EVENT OVERVIEW", "Date"), ("EVENT OVERVIEW", "Time"), ("EVENT OVERVIEW", "Location/Venue"), ("EVENT OVERVIEW", "Partner/s"), ("EVENT OVERVIEW", "Client/s"), ("EVENT OVERVIEW", "Primary Audience"),
    ("IMPACT", "Goals"), ("IMPACT", "Expected Attendance"), ("IMPACT", "Success Metrics"), ("COMMS", "Event Name (External)"), ("COMMS", "Description"), ("COMMS", "Marketing Channels"), ("COMMS", "Eventbrite"),
    ("LOGISTICS", "Vendors"), ("LOGISTICS", "Facilities"), ("LOGISTICS", "Supplies"), ("LOGISTICS", "Equipment"), ("LOGISTICS", "Compost"), ("LOGISTICS", "Mulch"), ("LOGISTICS", "Expenses"),
    ("RUN OF SHOW", ""), ("ACCESS NOTES", ""),
]


@query(_brief_sql())
def event_brief(spark, sf_dir):
    return workflow.event_brief(_event_shape(spark, sf_dir))


@query(f"""WITH {_EVENT_SQL} SELECT id, 'New event assigned to ' || owner AS message, name AS title, 'CONFIRMED · Owner: ' || owner AS subtitle, date || coalesce(' · ' || time, '') AS "when", 'TBD' AS "where", coalesce(type, '') AS type, 'TBD' AS attendance FROM ev""")
def event_card(spark, sf_dir):
    return workflow.event_card(_event_shape(spark, sf_dir))


# Scalar functions.


@query(
    "SELECT p_partkey, CASE WHEN instr(s, ' - ') > 0 THEN trim(substr(s, 1, instr(s, ' - ') - 1)) END AS head, CASE WHEN instr(s, ' - ') > 0 THEN trim(substr(s, instr(s, ' - ') + 3)) ELSE s END AS tail FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_type || ' - ' || p_name || ' - x' ELSE p_name END AS s FROM part)"
)
def split_first(spark, sf_dir):
    s = F.when(F.col("p_partkey") % 4 > 0, F.concat("p_type", F.lit(" - "), "p_name", F.lit(" - x"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", values.split_at_first(s).alias("s")).select("p_partkey", "s.head", "s.tail")


@query("SELECT vec_id, CASE WHEN vec_id % 9 > 0 THEN embedding[1]::DOUBLE END AS lat, CASE WHEN vec_id % 9 > 0 THEN embedding[2]::DOUBLE END AS lng FROM embeddings")
def wkt_parse(spark, sf_dir):
    p, i = _points(spark, sf_dir), F.col("vec_id")
    pair = F.concat_ws(" ", F.col("lng").cast("string"), F.col("lat").cast("string"))
    text = F.when(i % 9 == 0, "POINT (x y)").when(i % 3 == 1, F.concat(F.lit("POINT ("), pair, F.lit(")"))).when(i % 3 == 2, F.concat(F.lit("POINT("), pair, F.lit(")"))).otherwise(pair)
    return p.select("vec_id", geo.wkt_point(text).alias("p")).select("vec_id", "p.lat", "p.lng")


@query("SELECT o_orderkey, 'Dear ' || o_custkey || ', your order ' || o_orderkey || ' is ' || o_orderstatus || '.' AS told FROM orders")
def template_render(spark, sf_dir):
    told = values.filled(F.lit("Dear [WHO], your order [WHAT] is [STATE]."), {"WHO": F.col("o_custkey"), "WHAT": F.col("o_orderkey"), "STATE": F.col("o_orderstatus")})
    return table(spark, sf_dir, "orders").select("o_orderkey", told.alias("told"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '; b' WHEN 1 THEN event_type ELSE '' END AS told FROM events")
def json_array_coerce(spark, sf_dir):
    i = F.col("event_id")
    raw = F.when(i % 3 == 0, F.to_json(F.array(F.col("event_type"), F.lit("b")))).when(i % 3 == 1, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", values.joined(values.json_list(raw)).alias("told"))


@query("SELECT c_custkey, replace(c_name || ', ' || c_mktsegment || ',x', ',', ' ') AS told FROM customer")
def comma_scrub(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", values.without_commas(F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(",x"))).alias("told"))


@query("SELECT p_partkey, '\"' || replace(p_name || ', \"' || p_type || '\"', '\"', '\"\"') || '\"' AS field FROM part")
def csv_quote(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", values.csv_field(F.concat("p_name", F.lit(', "'), "p_type", F.lit('"'))).alias("field"))


@query("SELECT p_partkey, url_encode(p_name || ' / ' || p_brand) AS x, base64(encode(p_name)) AS b, p_name AS back FROM part")
def encodings(spark, sf_dir):
    encoded = values.percent_encoded(F.concat("p_name", F.lit(" / "), "p_brand"))
    b = values.to_base64(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", encoded.alias("x"), b.alias("b"), values.base64_text(b).alias("back"))


@query("SELECT p_partkey AS tree_id, p_name AS spc_common, p_brand AS health, p_type, p_size AS tree_dbh, p_retailprice FROM part")
def rename_passthrough(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("condition", F.lit("older"))
    ordered = p.select("condition", "p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
    return rows.renamed(ordered, {"p_partkey": "tree_id", "p_name": "spc_common", "condition": "health", "p_brand": "health", "p_size": "tree_dbh"})


@query("SELECT event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1")
def stream_ingest(spark, sf_dir):
    """The events table as a stream of files, ingested until all that is there has been taken."""
    work = f"{shared_folder(spark)}/ingest-{dt.datetime.now():%Y%m%d%H%M%S%f}"
    batch = table(spark, sf_dir, "events")
    source = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    shape = lambda e: e.select("event_id", "event_type", "ts")
    ingest_available(source, f"{work}/table", f"{work}/state", "event_id", ["ts"], shape)
    return appended(spark, f"{work}/table", shape(batch).schema).drop("batch")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental_append(spark, sf_dir)


from fieldweave.plans import landed  # noqa: E402,F401  its queries add themselves
