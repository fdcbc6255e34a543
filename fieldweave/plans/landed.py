"""Queries over the given tables in the forms in which sources land and sinks write: answers, pages, CSV, JSON, versions.

Each query first writes its table in that form to the shared folder, then reads it back through the source under test.
What it wrote is left there, as its result reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.functions import geo, values
from fieldweave.operators import joins, rows
from fieldweave.plans import workflow
from fieldweave.plans.catalog import _EVENT_SQL, ORACLE_SQL, _event_shape, _points, query, table
from fieldweave.session import shared_folder
from fieldweave.sources import activities, delivery, inventory, paged, split_csv, tables
from fieldweave.sources.schemas import TABLES
from fieldweave.streaming.ingest import batch_metrics, ingest_available


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


def _order_activities(spark, sf_dir, scraped: str = "2024-02-01") -> DataFrame:
    """Orders in the columns of activities."""
    given = {"id": F.col("o_orderkey").cast("string"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "treeId": F.col("o_custkey").cast("string"), "species": F.col("o_orderstatus"), "scrapedAt": F.lit(scraped)}
    return table(spark, sf_dir, "orders").select(*[given.get(c, F.lit("")).alias(c) for c in TABLES["activities"]])


_ACTIVITY_SQL = "SELECT o_orderkey::VARCHAR AS id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_custkey::VARCHAR AS \"treeId\", o_orderstatus AS species, '' AS address, '' AS \"activitiesDone\", '' AS \"durationMinutes\", {} AS \"scrapedAt\" FROM orders"


def _answers(spark, sf_dir) -> str:
    """Orders as API answers of up to a hundred records, one answer a line."""
    path = _folder(spark)
    tree = F.struct(F.lit(None).cast("string").alias("closestAddress"), F.struct(F.col("o_orderstatus").alias("commonName")).alias("species"))
    record = F.struct(F.col("o_orderkey").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("date"), F.col("o_custkey").alias("treeId"), tree.alias("tree"))
    reports = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 100)).agg(F.collect_list(record).alias("activityReports"))
    reports.select(F.struct("activityReports").alias("data"), F.array(F.struct(F.lit("partly").alias("message"))).alias("errors")).write.json(path)
    return path


@query(_ACTIVITY_SQL.format("'2024-02-01'"))
def landed_answers(spark, sf_dir):
    return activities.flatten(activities.gate(activities.read_answers(spark, _answers(spark, sf_dir))), "2024-02-01")


@query(_ACTIVITY_SQL.format("'2024-02-01'"))
def pages_or_one_shot(spark, sf_dir):
    """Pages are asked for first; as none have landed, all is taken from the answers. (See pages_before_one_shot for the other case.)"""
    whole = _answers(spark, sf_dir)
    found = rows.first_nonempty([lambda: paged.pages_of(spark, f"{whole}-pages"), lambda: activities.gate(activities.read_answers(spark, whole))])
    return activities.flatten(found, "2024-02-01")


@query(_ACTIVITY_SQL.format("'2024-02-01'"))
def pages_before_one_shot(spark, sf_dir):
    """Pages have landed, so the answers are not looked at (those here could not be read)."""
    pages = _folder(spark)
    record = F.struct(F.col("o_orderkey").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("date"), F.col("o_custkey").alias("treeId"), F.struct(F.struct(F.col("o_orderstatus").alias("commonName")).alias("species")).alias("tree"))
    table(spark, sf_dir, "orders").select(F.to_json(record).alias("value")).write.text(pages)
    landed = lambda: activities.records_of(paged.pages_of(spark, pages))
    found = rows.first_nonempty([landed, lambda: activities.gate(activities.read_answers(spark, f"{pages}-answers"))])
    return activities.flatten(found, "2024-02-01")


@query("""
    WITH given AS (SELECT o_orderkey, o_custkey, c_name, c_acctbal, n_name, c_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
    SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_custkey ELSE 'o' || o_orderkey END AS "treeId",
        CASE WHEN o_orderkey % 2 = 0 THEN c_custkey ELSE o_orderkey END::VARCHAR AS lat, CASE WHEN o_orderkey % 2 = 0 THEN -c_custkey ELSE -o_orderkey END::VARCHAR AS lng,
        CASE WHEN o_orderkey % 2 = 0 THEN replace(c_name, ',', ' ') ELSE '1  A St' END AS address, CASE WHEN o_orderkey % 2 = 0 THEN n_name ELSE 'own kind' END AS species
    FROM given WHERE o_orderkey % 2 = 1 OR c_custkey <> 0 GROUP BY ALL
""")
def object_cache(spark, sf_dir):
    """Orders as activities: those with an even key point to their customer, an object that points to its nation; the others hold a tree of their own, with other fields. A coordinate of 0 is none."""
    path = _folder(spark)
    ref = lambda kind, key: F.concat(F.lit('{"__ref":"' + kind), F.col(key).cast("string"), F.lit('"}'))
    line = lambda key, *pairs: F.concat(F.lit('{"key":"'), key, F.lit('","obj":{'), *[x for i, (n, v) in enumerate(pairs) for x in (F.lit(("," if i else "") + f'"{n}":'), v)], F.lit("}}")).alias("value")
    text = lambda column: F.concat(F.lit('"'), column.cast("string"), F.lit('"'))
    number = lambda column: column.cast("string")
    held = F.concat(F.lit('{"id":"o'), number(F.col("o_orderkey")), F.lit('","lat":'), number(F.col("o_orderkey")), F.lit(',"lon":-'), number(F.col("o_orderkey")), F.lit(',"address":"1, A St","species":{"commonName":"own kind"}}'))
    tree = F.when(F.col("o_orderkey") % 2 == 0, ref("c", "o_custkey")).otherwise(held)
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    written = o.select(line(F.concat(F.lit("a"), number(F.col("o_orderkey"))), ("__typename", F.lit('"ActivityReport"')), ("id", number(F.col("o_orderkey"))), ("tree", tree), ("extra", F.lit("[1,null]"))))
    at = F.concat(F.lit('{"lat":'), number(F.col("c_custkey")), F.lit(',"lng":"-'), number(F.col("c_custkey")), F.lit('"}'))
    written = written.union(c.select(line(F.concat(F.lit("c"), number(F.col("c_custkey"))), ("__typename", F.lit('"Customer"')), ("id", text(F.concat(F.lit("c"), number(F.col("c_custkey"))))), ("location", at), ("closestAddress", text(F.col("c_name"))), ("species", ref("n", "c_nationkey")))))
    written.union(n.select(line(F.concat(F.lit("n"), number(F.col("n_nationkey"))), ("commonName", text(F.col("n_name")))))).write.text(path)
    return joins.cached_locations(activities.read_cache(spark, path))


@query("SELECT p_partkey::VARCHAR AS tree_id, p_size AS tree_dbh, p_name AS spc_common, CASE lower(p_type) WHEN 'economy' THEN 'Good' ELSE p_type END AS health FROM part WHERE p_size > 10 AND p_type <> 'PROMO'")
def filtered_inventory(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "part").select(F.col("p_partkey").alias("objectid"), F.col("p_size").alias("dbh"), F.col("p_name").alias("genusspecies"), F.when(F.col("p_type") == "ECONOMY", "Excellent").otherwise(F.col("p_type")).alias("tpcondition")).write.json(path)
    read = paged.read_filtered(spark, path, "objectid long, dbh int, genusspecies string, tpcondition string", lambda f: f["dbh"] > 10, lambda f: f["tpcondition"] != "PROMO")
    return inventory.normalise(read).select("tree_id", "tree_dbh", "spc_common", "health")


@query("SELECT p_partkey::VARCHAR AS tree_id, p_type AS spc_latin, p_name || ', \"' || p_brand || '\"' AS spc_common, p_size::VARCHAR AS tree_dbh FROM part")
def csv_inventory(spark, sf_dir):
    path = _folder(spark)
    species = F.concat("p_type", F.lit(" - "), "p_name", F.lit(', "'), "p_brand", F.lit('"'))
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("﻿ObjectID"), species.alias("GenusSpecies"), F.col("p_size").alias(" DBH "))
    named.write.options(**tables.CSV).csv(path)
    return inventory.normalise(inventory.read_csv(spark, path)).select("tree_id", "spc_latin", "spc_common", "tree_dbh")


@query("SELECT o_orderkey::VARCHAR AS id, o_orderpriority || chr(10) || 'say \"' || o_orderstatus || '\",' || chr(10) || chr(10) || o_custkey AS note, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def csv_line_breaks(spark, sf_dir):
    """Notes with line breaks and quotes, in files that are read by ranges."""
    path = _folder(spark)
    note = F.concat("o_orderpriority", F.lit('\nsay "'), "o_orderstatus", F.lit('",\n\n'), F.col("o_custkey").cast("string"))
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), note.alias("note"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).write.options(**tables.CSV).csv(path)
    return split_csv.read_split_csv(spark, path)


@query(_ACTIVITY_SQL.format("CASE WHEN o_orderkey % 2 = 0 THEN '2024-02-01' ELSE '2024-03-01' END"))
def append_new_rows(spark, sf_dir):
    """Half of the orders are in the table; all come again on a later day."""
    store = tables.Tables(spark, _folder(spark))
    store.create_missing()
    store.append_new("activities", _order_activities(spark, sf_dir).where("id % 2 = 0"), "id", ["date"])
    store.append_new("activities", _order_activities(spark, sf_dir, "2024-03-01"), "id", ["date"])
    return store.read("activities")


@query(_ACTIVITY_SQL.format("CASE WHEN o_orderkey % 2 = 0 THEN '2024-02-01' ELSE '2024-03-01' END"))
def rewrite_sorted(spark, sf_dir):
    """The table is rewritten from its own rows and later ones of half of the orders, the last of each id."""
    store = tables.Tables(spark, _folder(spark))
    store.overwrite("activities", _order_activities(spark, sf_dir))
    store.rewrite_sorted("activities", store.read("activities").union(_order_activities(spark, sf_dir, "2024-03-01").where("id % 2 = 1")), "id", ["scrapedAt"])
    return store.read("activities")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS status FROM orders")
def versioned_update(spark, sf_dir):
    """Two versions: finished orders, and then all others with the finished ones renamed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    store = tables.Versions(spark, _folder(spark), "o_orderkey long, status string")
    store.update(lambda there: there.union(o.where("status = 'F'")))
    store.update(lambda there: there.withColumn("status", F.lit("closed")).union(o.where("status <> 'F'")))
    return store.read()


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'late' ELSE o_orderstatus END AS status, o_totalprice + CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS price, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 ELSE 4 END AS version FROM orders WHERE o_custkey % 7 > 0 OR o_orderstatus <> 'P'")
def two_writers(spark, sf_dir):
    """Three writers start from the version with all orders: two change different ones and both succeed; the last one changes orders of the second one, conflicts, and changes what that one left."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), "o_custkey", F.lit(1).alias("version"))
    store = tables.Versions(spark, _folder(spark), "o_orderkey long, status string, price double, o_custkey long, version int", ["o_orderkey"])
    store.put(o, 0)
    begun = store.read(1)
    store.change(begun.where("status = 'F'").withColumns({"status": F.lit("closed"), "version": F.lit(2)}), 1)
    store.change(begun.where("status = 'O'").withColumns({"status": F.lit("late"), "version": F.lit(3)}), 1, gone=begun.where("status = 'P' AND o_custkey % 7 = 0"))
    raised = lambda rows: rows.where("status IN ('O', 'late')").withColumns({"price": F.col("price") + 1, "version": F.lit(4)})
    try:
        store.change(raised(begun), 1)
    except tables.Conflict:
        store.update_keys(raised)
    return store.read().drop("o_custkey")


@query(_ACTIVITY_SQL.format("CASE WHEN o_orderkey % 50 = 0 THEN '2024-04-01' WHEN o_custkey % 3 = 0 THEN '2024-03-01' ELSE '2024-02-01' END").replace("strftime(o_orderdate, '%Y-%m-%d') AS date", "CASE WHEN o_orderkey % 50 = 0 THEN '2024-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date"))
def sorted_ranges(spark, sf_dir):
    """A sorted table takes orders of a third of the customers again, and then some with a date after all others, which take them out of their files."""
    store = tables.Tables(spark, _folder(spark))
    file_rows = max(1, table(spark, sf_dir, "orders").count() // 16)
    store.rewrite_sorted("activities", _order_activities(spark, sf_dir), "id", ["scrapedAt"], file_rows=file_rows)
    store.merge_sorted("activities", _order_activities(spark, sf_dir, "2024-03-01").where("treeId % 3 = 0"), "id", ["scrapedAt"], file_rows=file_rows)
    store.merge_sorted("activities", _order_activities(spark, sf_dir, "2024-04-01").where("id % 50 = 0").withColumn("date", F.lit("2024-01-01")), "id", ["scrapedAt"], file_rows=file_rows)
    return store.read("activities")


@query("SELECT p_partkey, p_name || chr(10) || 'ü' AS content, sha1('blob ' || strlen(p_name || chr(10) || 'ü') || chr(0) || p_name || chr(10) || 'ü') AS version FROM part")
def file_versions(spark, sf_dir):
    """Files as an API gives them, in base64 with line breaks, and the version that a writer has to name."""
    coded = F.regexp_replace(F.base64(F.encode(F.concat("p_name", F.lit("\nü")), "UTF-8")), "(.{8})", "$1\n")
    read = table(spark, sf_dir, "part").select("p_partkey", tables.decoded_file(coded).alias("content"))
    return read.withColumn("version", tables.version_id(F.col("content")))


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '{"error":"' || c_name || ' owes"}' WHEN c_custkey % 2 = 0 THEN '{"data":{"name":"' || c_name || '","nation":' || c_nationkey || '}}' ELSE '{"success":true}' END AS answer FROM customer""")
def answer_envelopes(spark, sf_dir):
    data = values.data_answer(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")))
    answer = F.when(F.col("c_acctbal") < 0, values.error_answer(F.concat("c_name", F.lit(" owes")))).when(F.col("c_custkey") % 2 == 0, data).otherwise(values.success_answer())
    return table(spark, sf_dir, "customer").select("c_custkey", answer.alias("answer"))


@query(
    f"""WITH {_EVENT_SQL} SELECT id, '{{"message":"New event assigned to ' || owner || '","title":"' || name || '","subtitle":"CONFIRMED · Owner: ' || owner || '","when":"' || date || coalesce(' · ' || time, '') || '","where":"TBD","type":"' || coalesce(type, '') || '","attendance":"TBD"}}' AS payload FROM ev"""
)
def card_payload(spark, sf_dir):
    return workflow.payload(workflow.event_card(_event_shape(spark, sf_dir)))


@query(
    f"""
    WITH {_EVENT_SQL}, started AS (SELECT *, (strptime(date || CASE WHEN time IS NULL THEN ' 12' ELSE ' 14' END, '%Y-%m-%d %H') AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' AS s FROM ev)
    SELECT id, '{{"name":"' || name || '","description":"Join us for ' || name || '","start":"' || strftime(s, '%Y-%m-%dT%H:%M:%SZ') || '","end":"' || strftime(s + INTERVAL 2 HOURS, '%Y-%m-%dT%H:%M:%SZ') || '","online":' || (coalesce(type, '') LIKE '%Virtual%') || ',"capacity":50}}' AS payload FROM started
    """
)
def ticket_payload(spark, sf_dir):
    return workflow.payload(workflow.ticket(_event_shape(spark, sf_dir)))


@query(ORACLE_SQL["tracker_row"].replace("SELECT name AS c01", "SELECT id, name AS c01"))
def tracker_append(spark, sf_dir):
    """Two runs bring the tracker events, some of them both times; each event's row is appended once."""
    events = _event_shape(spark, sf_dir)
    part = F.pmod(F.hash("id"), F.lit(3))
    tracker = tables.Versions(spark, _folder(spark), workflow.TRACKER, ["id"])
    for those in (events.where(part < 2), events.where(part > 0).union(events.where(part == 2))):
        workflow.append_tracker_rows(tracker, those)
    return tracker.read()


@query(
    """
    WITH landed AS (SELECT CASE WHEN event_type = 'click' THEN NULL ELSE event_id END AS id FROM events, range(2)), told AS (SELECT count(*) AS n_rows, count(DISTINCT id) AS n_added, count(*) FILTER (id IS NULL) AS n_failed FROM landed)
    SELECT n_rows, n_added, n_rows - n_added - n_failed AS n_skipped, n_failed FROM told
    """
)
def stream_metrics(spark, sf_dir):
    """All events land twice, and each time are taken as a batch; clicks lose their key. What the batches counted, added up."""
    work = _folder(spark)
    events = table(spark, sf_dir, "events").select(F.when(F.coalesce(F.col("event_type") != "click", F.lit(True)), F.col("event_id")).alias("id"), "ts")
    for name in ("one", "two"):
        events.write.parquet(f"{work}/in/{name}")
        source = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(f"{work}/in")
        ingest_available(source, f"{work}/table", f"{work}/state", "id", ["ts"], metrics=f"{work}/metrics")
    return batch_metrics(spark, f"{work}/metrics").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_added", "n_skipped", "n_failed")])


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 404 WHEN c_custkey % 7 > 0 THEN 200 END AS code, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 7 = 0 THEN 'no answer' END AS error, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 7 > 0 THEN 1 ELSE 2 END::BIGINT AS tries FROM customer")
def deliveries_once(spark, sf_dir):
    """Customers are delivered twice: what was accepted is not sent again, what was refused or failed is. The last answer to each and the number of tries."""
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    box = delivery.Outbox(spark, _folder(spark), "c_custkey", "long")
    for _ in range(2):
        box.deliver(customers, _answer)
    return box.answers().select("c_custkey", "code", "error", "tries")


def _answer(row: dict) -> int:
    """A service that refuses every fifth customer and does not answer every seventh."""
    if row["c_custkey"] % 5 == 0:
        return 404
    if row["c_custkey"] % 7 == 0:
        raise OSError("no answer")
    return 200


@query("SELECT o_orderpriority, count(*) AS n_before, count(*) FILTER (o_orderstatus = 'F') AS n_after FROM orders GROUP BY o_orderpriority")
def filter_counts(spark, sf_dir):
    return rows.filter_counts(table(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 9 > 0 AND embedding[1]::DOUBLE > -0.1::DOUBLE AND embedding[1]::DOUBLE < 0.1::DOUBLE AND embedding[2]::DOUBLE > -0.05::DOUBLE AND embedding[2]::DOUBLE < 0.15::DOUBLE")
def geometry_bbox(spark, sf_dir):
    text = F.when(F.col("vec_id") % 9 == 0, "POINT (x y)").otherwise(F.concat(F.lit("POINT ("), F.col("lng").cast("string"), F.lit(" "), F.col("lat").cast("string"), F.lit(")")))
    return _points(spark, sf_dir).where(geo.geometry_in_box(text, geo.Box(-0.1, 0.1, -0.05, 0.15))).select("vec_id")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000")
def predicate_scan(spark, sf_dir):
    return rows.scan(table(spark, sf_dir, "orders"), lambda f: f["o_orderstatus"] == "O", lambda f: f["o_totalprice"] > 1000).select("o_orderkey", "o_totalprice")


@query("SELECT CASE WHEN c_custkey % 10 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS id FROM customer ORDER BY try_cast(id AS BIGINT) NULLS LAST, id")
def numeric_key_order(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("id")).orderBy(*rows.numeric_order("id"))
