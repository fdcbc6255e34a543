import json

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import joins, rows
from fieldweave.session import problems
from fieldweave.sources import activities, delivery, geojson, inventory, paged, tables


def lines(path, *objects):
    path.write_text("\n".join(json.dumps(o) for o in objects), encoding="utf-8")
    return str(path)


def test_activities_flatten(spark, tmp_path):
    record = {"id": 7, "date": 1776655119560, "treeId": 3, "duration": 0, "stewardshipActivities": ["Watered", "Weeded"], "tree": {"closestAddress": '1 A St, "rear"', "species": {"commonName": "Oak"}}}
    path = lines(tmp_path / "a.json", {"data": {"activityReports": [record, None, {"id": None, "tree": None}, {"id": "8", "date": "2026-04-20T01:00:00Z", "tree": {"species": None}}]}, "errors": [{"message": "x"}]}, {"data": {"activityReports": []}})
    answers = activities.read_answers(spark, path)
    got = [tuple(r) for r in activities.flatten(activities.gate(answers), "2026-05-01").collect()]
    assert got[0] == ("7", "2026-04-20", "3", "Oak", '1 A St, "rear"', "Watered; Weeded", "0", "2026-05-01")
    assert got[1] == ("", "", "", "", "", "", "", "2026-05-01") and got[2][:2] == ("8", "2026-04-20") and len(got) == 3
    assert activities.flatten(activities.gate(answers), "x", "America/New_York").first().date == "2026-04-19"
    assert activities.skipped(answers).first().n_errors == 1
    with pytest.raises(Exception, match="denied"):
        activities.gate(activities.read_answers(spark, lines(tmp_path / "b.json", {"data": None, "errors": [{"message": "denied"}]}))).collect()


def test_object_cache(spark, tmp_path):
    path = lines(
        tmp_path / "c.json",
        {"key": "Tree:1", "obj": {"__typename": "Tree", "id": 1, "latitude": 40.1, "lng": -73.1, "closestAddress": "1, A", "species": {"__ref": "S:1"}}},
        {"key": "S:1", "obj": {"__typename": "Species", "id": 5, "commonName": "Oak, red"}},
        {"key": "X:2", "obj": {"__typename": "Other", "id": 2, "lat": 1, "lng": 2}},
        {"key": "T:9", "obj": {"__typename": "Unknown", "id": 9, "lat": 41, "lon": -74}},
        {"key": "A:1", "obj": {"__typename": "ActivityReport", "id": 3, "tree": {"__ref": "T:9"}}},
    )
    got = sorted(map(tuple, joins.cached_locations(activities.read_cache(spark, path)).collect()))
    assert got == [("1", "40.1", "-73.1", "1  A", "Oak  red"), ("9", "41", "-74", "", "")]
    assert [r.id for r in joins.cached_activities(activities.read_cache(spark, path)).collect()] == ["3"]


def test_object_cache_with_ragged_objects(spark, tmp_path):
    path = lines(
        tmp_path / "c.json",
        {"key": "A:1", "obj": {"__typename": "ActivityReport", "id": 1, "date": 1776655119560, "extra": {"deep": [1]}, "stewardshipActivities": ["Watered", "Weeded"], "tree": {"id": 21, "lat": 40.5, "lon": -73.5, "address": "embedded, here", "species": {"commonName": "Elm"}}}},
        {"key": "A:2", "obj": {"id": "2", "treeId": 22, "stewardshipActivities": '["x", "y"]', "tree": {"__ref": "gone", "id": 22, "latitude": "1", "longitude": "2"}}},
        {"key": "A:3", "obj": {"__typename": "StewardshipThing", "id": 3, "stewardshipActivities": "plain", "tree": None, "duration": 0}},
        {"key": "A:4", "obj": {"__typename": "report", "id": 4, "tree": {"id": 5, "lat": 9, "lng": 9}}},
        {"key": "A:5", "obj": {"__typename": "report", "id": "", "tree": {"id": 6, "lat": 9, "lng": 9}}},
        {"key": "A:6", "obj": {"__typename": "report", "id": 6, "tree": "not an object"}},
        {"key": "T:5", "obj": {"__typename": "NYCTree", "id": 5, "location": {"lat": 3, "lng": 4}, "species": {"__ref": "S:1"}, "other": [1, "two", None]}},
        {"key": "T:7", "obj": {"__typename": "Tree", "id": 7, "lat": 1}},
        {"key": "S:1", "obj": {"commonName": "Oak"}},
        {"key": "N:1", "obj": None},
        {"key": "N:2", "obj": [1, 2]},
    )
    cache = activities.read_cache(spark, path)
    got = sorted(map(tuple, joins.cached_locations(cache).collect()))
    assert got == [("21", "40.5", "-73.5", "embedded  here", "Elm"), ("22", "1", "2", "", ""), ("5", "3", "4", "", "Oak")]
    flat = activities.flatten(joins.cached_activities(cache), "2026-05-01")
    assert [(r.id, r.date, r.species, r.address, r.activitiesDone, r.durationMinutes) for r in flat.collect()] == [
        ("1", "2026-04-20", "Elm", "embedded, here", "Watered; Weeded", ""), ("2", "", "", "", "x; y", ""), ("3", "", "", "", "plain", "0"), ("4", "", "", "", "", ""), ("6", "", "", "", "", "")]


def test_object_cache_without_references_is_dealt_evenly(spark, tmp_path):
    """Trees that activities hold themselves name nothing: they must not meet in one task, nor must those of one species."""
    held = [{"key": f"A:{i}", "obj": {"__typename": "ActivityReport", "id": i, "tree": {"id": i, "lat": 1, "lng": 2, "species": {"commonName": "own"}}}} for i in range(400)]
    pointing = [{"key": f"B:{i}", "obj": {"__typename": "ActivityReport", "id": i, "tree": {"__ref": f"T:{i % 200}"}}} for i in range(400)]
    trees = [{"key": f"T:{i}", "obj": {"__typename": "Other", "id": f"t{i}", "lat": 3, "lng": 4, "species": {"__ref": "S:1"}}} for i in range(200)]
    gone = {"key": "B:x", "obj": {"__typename": "ActivityReport", "id": 1, "tree": {"__ref": "none", "id": "x", "lat": 5, "lng": 6, "species": {"__ref": "none", "commonName": "kept"}}}}
    cache = activities.read_cache(spark, lines(tmp_path / "c.json", *held, *pointing, *trees, gone, {"key": "S:1", "obj": {"commonName": "Oak"}}))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        pointed = joins.followed(cache.where(joins.is_activity()), F.variant_get("obj", "$.tree", "variant"), cache.where("key NOT LIKE 'A%'"), "tree")
        for frame, n in ((pointed.where("key LIKE 'A%'"), 400), (joins.cached_locations(cache).where("treeId LIKE 't%'"), 200)):
            shares = [r["count"] for r in frame.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
            assert sum(shares) == n and max(shares) < n / 2
        got = {r.treeId: (r.lat, r.species) for r in joins.cached_locations(cache).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {str(i): ("1", "own") for i in range(400)} | {f"t{i}": ("3", "Oak") for i in range(200)} | {"x": ("5", "kept")}


def test_tables(spark, tmp_path):
    store = tables.Tables(spark, str(tmp_path))
    assert store.read("TreeGuards").count() == 0 and store.read("Unknown").count() == 0
    assert "TreeGuards" in store.create_missing() and store.create_missing() == []
    kind = "treeId string, markedBy string, guardType string, markedAt string, note string"
    odd = [("1", "a,b", 'say "x"', "2026-01-01T00:00:00.000Z", "two\nlines"), ("2", "", "standard", "", "")]
    store.overwrite("TreeGuards", spark.createDataFrame(odd, kind))
    assert sorted(map(tuple, store.read("TreeGuards").collect())) == odd
    more = spark.createDataFrame([("2", "z", "", "", ""), ("3", "q", "", "", ""), ("3", "r", "", "", ""), ("", "n", "", "", "")], kind)
    assert store.append_new("TreeGuards", more, "treeId", ["markedBy"]) == 1
    assert sorted(r.treeId for r in store.read("TreeGuards").collect()) == ["1", "2", "3"]
    assert store.append_new("TreeGuards", more, "treeId", ["markedBy"]) == 0
    store.overwrite("TreeGuards", spark.createDataFrame([], kind))
    assert store.read("TreeGuards").count() == 0
    acts = spark.createDataFrame([("9", "2026-01-02", 1), ("10", "2026-01-02", 1), ("9", "2026-01-01", 2), ("7", "", 1)], "id string, date string, seq int")
    for c in ("treeId", "species", "address", "activitiesDone", "durationMinutes", "scrapedAt"):
        acts = acts.withColumn(c, F.lit(""))
    store.rewrite_sorted("activities", acts, "id", ["seq"])
    wanted = [("", "7"), ("2026-01-01", "9"), ("2026-01-02", "10")]
    assert [(r.date, r.id) for r in store.read("activities").coalesce(1).collect()] == wanted  # files are read in the order of their names
    store.rewrite_sorted("activities", store.read("activities"), "id", ["date"])  # from its own rows
    assert [(r.date, r.id) for r in store.read("activities").coalesce(1).collect()] == wanted


def test_json_forms(spark, tmp_path):
    tables.write_json_array(spark.range(2), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == [{"id": 0}, {"id": 1}]
    keyed = spark.createDataFrame([('{"5": [40.1, -73.9, "1 A", "Oak"], "6": [1]}',)], "value string")
    assert sorted(map(tuple, tables.keyed_rows(keyed).collect())) == [("5", "40.1", "-73.9", "1 A", "Oak"), ("6", "1", None, None, None)]
    assert spark.range(1).select(tables.decoded_file(F.lit("bmHD\nr3Zl")).alias("x")).first().x == "naïve"


def test_inventory(spark, tmp_path):
    (tmp_path / "i.csv").write_text('﻿ObjectID,GenusSpecies,TPCondition,Geometry,Other Field\n1,Quercus rubra - red oak,DEAD,POINT (-73.98 40.72),x\n2,plain,odd,"{""coordinates"": [-73.9, 40.7]}",\n3,,,,\n', encoding="utf-8")
    got = inventory.normalise(inventory.read_csv(spark, str(tmp_path / "i.csv"))).orderBy("tree_id")
    assert {"tree_id", "spc_common", "spc_latin", "health", "latitude", "longitude", "other_field", "geometry"} == set(got.columns)
    a, b, c = got.collect()
    assert (a.spc_common, a.spc_latin, a.health, a.latitude, a.longitude) == ("red oak", "Quercus rubra", "Poor", "40.72", "-73.98")
    assert (b.spc_common, b.spc_latin, b.health, b.latitude) == ("plain", None, "odd", "40.7") and c.latitude is None


def test_geojson(spark, tmp_path):
    layer = {"type": "FeatureCollection", "features": [
        {"geometry": {"type": "LineString", "coordinates": []}, "properties": {"fid": 1}},
        {"geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}, "properties": {"BoroCD": None, "borocd": 103}},
        {"geometry": {"type": "Point", "coordinates": [5, 6]}, "properties": {"BORO_CD": "103"}},
        {"geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 1], [0, 0]]], [[[0, 0], [1, 1], [2, 2], [0, 0]]]]}, "properties": {"BoroCD": 104}},
    ]}
    (tmp_path / "l.geojson").write_text(json.dumps(layer))
    read = geojson.read_layer(spark, str(tmp_path / "l.geojson"))
    assert geojson.lines(read).count() == 1 and [(r.lng, r.lat) for r in geojson.points(read).collect()] == [(5.0, 6.0)]
    names = ["BoroCD", "borocd", "BORO_CD", "boro_cd"]
    assert geojson.find_feature(read, names, "103").first().pos == 1 and geojson.find_feature(read, names, "9").count() == 0
    ring = geojson.boundary(geojson.find_feature(read, names, "104"))
    assert len(ring.first().ring) == 4
    geojson.write_ring(ring, str(tmp_path / "r"))
    assert geojson.read_ring(spark, str(tmp_path / "r")).first().ring == ring.first().ring


def test_paged_source(spark):
    def fetch(offset, limit):
        return [json.dumps({"id": i}) for i in range(offset, min(offset + limit, 7))]

    spark.dataSource.register(paged.paged_source("pages_for_tests", fetch))
    read = spark.read.format("pages_for_tests").option("limit", 3).option("total", 12).load()
    assert read.rdd.getNumPartitions() == 4 and read.count() == 7
    assert paged.until_short(read, 3).count() == 7
    for lanes in (1, 2, 8):  # without a total, all is read
        read = spark.read.format("pages_for_tests").option("limit", 2).option("lanes", lanes).load()
        assert read.rdd.getNumPartitions() == lanes and sorted(json.loads(r.record)["id"] for r in paged.until_short(read, 2).collect()) == list(range(7))
    gap = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (2, 0, "c"), (4, 0, "d"), (4, 1, "e")], "offset int, position int, record string")
    assert paged.until_short(gap, 2).count() == 3


def test_pages_have_a_cap_and_may_be_partial(spark):
    def endless(offset, limit):  # ignores the offset
        return ["{}"] * limit

    spark.dataSource.register(paged.paged_source("endless_for_tests", endless))
    for lanes in (1, 3):
        with pytest.raises(Exception, match="more than 20 pages of 5"):
            spark.read.format("endless_for_tests").option("limit", 5).option("lanes", lanes).option("max_pages", 20).load().count()

    def third_is_broken(offset, limit):
        if offset == 6:
            raise OSError("no third page")
        return [str(i) for i in range(offset, min(offset + limit, 20))]

    spark.dataSource.register(paged.paged_source("broken_for_tests", third_is_broken))
    for lanes in (1, 2, 8):
        read = spark.read.format("broken_for_tests").option("limit", 3).option("lanes", lanes)
        with pytest.raises(Exception, match="no third page"):
            read.load().count()
        partial = read.option("allow_partial", True).load()
        assert sorted(int(r.record) for r in paged.until_short(partial, 3).collect()) == list(range(6))
        assert [r.offset for r in paged.broken_pages(partial).collect()] == [6]


def test_exactly_as_many_pages_as_the_cap(spark):
    spark.dataSource.register(paged.paged_source("ten_for_tests", lambda offset, limit: [str(i) for i in range(offset, min(offset + limit, 10))]))
    read = spark.read.format("ten_for_tests").option("limit", 5).option("pause", 0.01)
    assert read.option("max_pages", 2).option("lanes", 1).load().count() == 10
    with pytest.raises(Exception, match="more than 1 pages"):
        read.option("max_pages", 1).option("lanes", 1).load().count()


def test_pages_as_a_stream(spark, tmp_path):
    there, lost = tmp_path / "there", tmp_path / "lost"
    there.write_text("7")

    def fetch(offset, limit):
        if lost.exists() and offset == int(lost.read_text()) and limit > 1:
            raise OSError("lost page")
        return [str(i) for i in range(offset, min(offset + limit, int(there.read_text())))]

    spark.dataSource.register(paged.paged_source("stream_for_tests", fetch))

    def run(**options):
        stream = spark.readStream.format("stream_for_tests").options(**{"limit": 3, **options}).load()
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    def got():
        return sorted(int(r.record) for r in spark.read.parquet(str(tmp_path / "out")).where("position >= 0").collect())

    run()
    assert got() == list(range(7))
    run()  # nothing new
    there.write_text("20")
    run()
    assert got() == list(range(20))  # the page that was short is gone on with
    there.write_text("29")
    lost.write_text("23")
    with pytest.raises(Exception, match="lost page"):
        run()
    assert got() == list(range(20))
    run(allow_partial=True)
    assert got() == [*range(23), 26, 27, 28]
    there.write_text("100")
    with pytest.raises(Exception, match="more than 20 pages"):
        run(max_pages=20)


def test_lookup_each_isolates_failures(spark):
    def fetch(key):
        if key == "bad":
            raise OSError("no answer")
        return {"lat": "1"} if key == "a" else None

    keys = spark.createDataFrame([("a",), ("bad",), ("none",), ("a",)], "treeId string")
    got = {r.treeId: (r.lat, r.error) for r in paged.lookup_each(keys, "treeId", fetch, "lat string").collect()}
    assert got == {"a": ("1", None), "bad": (None, "no answer"), "none": (None, None)}
    assert paged.where_clause({"cb": "3", "boro": 1, "n": "O'x"}) == "cb='3' AND boro=1 AND n='O''x'"


def test_deliveries(spark):
    def send(row):
        if row["n"] == 3:
            raise OSError("no network")
        return 201 if row["n"] < 3 else 404

    answers = delivery.deliver(spark.range(1, 5).selectExpr("cast(id as string) AS id", "id AS n"), "id", send)
    assert sorted((r.id, r.code, r.error) for r in answers.collect()) == [("1", 201, None), ("2", 201, None), ("3", None, "no network"), ("4", 404, None)]
    assert tuple(delivery.delivered(answers).first()) == (2, 1, 1)
    assert delivery.each(lambda n: 6 // n, [3, 0, 2], 4) == [(2, None), (None, "integer division or modulo by zero"), (3, None)]


def test_endpoints_in_order(spark):
    class Answer(OSError):
        def __init__(self, code):
            super().__init__(f"answer {code}")
            self.code = code

    asked = []

    def endpoint(name, *codes):
        def ask():
            asked.append(name)
            code = codes[min(asked.count(name), len(codes)) - 1]
            if code != 200:
                raise Answer(code)
            return spark.range(1)

        return lambda: rows.retried(ask, wait=0, worth=lambda failed: getattr(failed, "code", 500) >= 500)

    assert rows.first_nonempty([endpoint("a", 404), endpoint("b", 503, 503, 503), endpoint("c", 500, 200), endpoint("d", 200)]).count() == 1
    assert asked == ["a", "b", "b", "b", "c", "c"]


def test_sync_and_envelope(spark, tmp_path):
    store = tables.Tables(spark, str(tmp_path))
    acts = spark.createDataFrame([("1",)], "id string").selectExpr("id", *[f"'' AS {c}" for c in ("date", "treeId", "species", "address", "activitiesDone", "durationMinutes", "scrapedAt")])
    trees = spark.createDataFrame([("7", "1", "2", "", "")], "treeId string, latitude string, longitude string, address string, species string")
    assert store.sync(acts, trees) == (1, 1) and store.version("trees").number == 1
    assert store.sync(acts, trees) == (0, 0) and (store.version("activities").number, store.version("trees").number) == (1, 2)
    assert store.read("trees").count() == 1
    told = tables.envelope(store.read("trees"), "paginated").first()
    assert (told["count"], told.strategy, len(told.activities)) == (1, "paginated", 1)
    assert problems(spark) == []
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert len(problems(spark)) == 1 and "Asia/Tokyo" in problems(spark)[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_shared_folder_that_cannot_be_written_is_a_problem(spark, monkeypatch):
    from fieldweave import session

    monkeypatch.setattr(session, "shared_folder", lambda _: "/proc/none")
    assert [p.split(":")[0] for p in problems(spark)] == ["spark.checkpoint.dir"]


def test_versions(spark, tmp_path):
    kind = "k string, n int"
    store = tables.Versions(spark, str(tmp_path / "v"), kind)
    row = lambda k, n: spark.createDataFrame([(k, n)], kind)
    assert store.read().count() == 0 and store.update(lambda there: there.union(row("a", 1))) == 1
    tries = []

    def merge(there):
        if not tries:  # another writer is quicker
            assert store.put(there.union(row("b", 2)), 1)
        tries.append(there.count())
        return there.union(row("c", 3))

    assert store.update(merge) == 3 and tries == [1, 2]
    assert sorted(r.k for r in store.read().collect()) == ["a", "b", "c"] and store.read(1).count() == 1
    assert not store.put(row("z", 9), 1) and len(list((tmp_path / "v" / "data").glob("*"))) == 3


def test_filtered_scan_is_pushed_down(spark, tmp_path):
    path = lines(tmp_path / "f.json", {"a": 1, "b": "x"}, {"a": 5, "b": "y"}, {"b": "z"})
    read = paged.read_filtered(spark, path, "a long, b string", lambda f: f["a"] > 2, wait=0)
    assert [r.b for r in read.collect()] == ["y"] and "GreaterThan(a,2)" in read._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        paged.read_filtered(spark, str(tmp_path / "none"), "a long", wait=0)


def test_an_outbox_sends_nothing_twice(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def send(row):
        (calls / f"{row['id']}-{len(list(calls.iterdir()))}-{id(row)}").write_text("")
        if row["id"] == "3":
            raise OSError("no network")
        return 404 if row["id"] == "4" else 200

    def made():
        return sorted(p.name.split("-")[0] for p in calls.iterdir())

    box = delivery.Outbox(spark, str(tmp_path / "box"), "id")
    rows_ = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("4",), (None,)], "id string")
    assert box.answers().count() == 0 and box.deliver(rows_, send) == {"n_accepted": 2, "n_refused": 1, "n_failed": 1}
    assert box.answers().count() == box.answers().count() == 4 and made() == ["1", "2", "3", "4"]  # looking sends nothing
    assert box.deliver(rows_, lambda row: send(row) and 201 if row["id"] == "4" else send(row)) == {"n_accepted": 1, "n_refused": 0, "n_failed": 1}
    assert made() == ["1", "2", "3", "3", "4", "4"]
    assert sorted(map(tuple, box.answers().collect())) == [("1", 200, None, 1), ("2", 200, None, 1), ("3", None, "no network", 2), ("4", 201, None, 2)]
    assert box.totals().count() == 2
    assert box.deliver(rows_.where("id < '3'"), send) == {"n_accepted": 0, "n_refused": 0, "n_failed": 0}


def test_a_task_that_is_tried_again_sends_what_is_open(tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark.sql import Row

    class Here:
        @staticmethod
        def partitionId():
            return 0

    monkeypatch.setattr(delivery.TaskContext, "get", staticmethod(Here))
    sent = []
    writer = delivery.OutboxWriter(f"file://{tmp_path}/box", "1", "id", pa.int64(), lambda row: sent.append(row["id"]) or 200, 1, 4)

    def dies():
        yield from (Row(id=i) for i in range(10))
        raise MemoryError

    with pytest.raises(MemoryError):
        writer.write(dies())
    assert sent == list(range(8))  # two groups; what came after them was not sent
    told = writer.write(iter([Row(id=i) for i in range(12)]))
    assert sent == list(range(12)) and told.n_accepted == 12
