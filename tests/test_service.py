"""Filters that go with the request; the service here is DuckDB, whose language is near enough to the service's."""

import datetime as dt
import json

import duckdb
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from fieldweave.sources.service import literal, register_service, where_text


@pytest.fixture(scope="module")
def service(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("service")
    log = str(folder / "log")
    data = str(folder / "t.parquet")
    duckdb.sql("SELECT i AS id, CASE WHEN i % 10 = 0 THEN NULL ELSE 'it''s ' || i % 7 END AS name, i / 4.0 AS size, DATE '2026-01-01' + (i % 40)::INTEGER AS day, i % 3 = 0 AS even, {'a': i} AS box FROM range(500) r(i)").write_parquet(data)

    def fetch(params):
        import duckdb

        with open(log, "a") as f:
            f.write(json.dumps(params) + "\n")
        con = duckdb.connect()
        names = ", ".join(f"{c}" for c in params["$select"].split(","))
        read = con.sql(f"SELECT {names} FROM '{data}' WHERE {params.get('$where', 'true')} ORDER BY {params['$order']} LIMIT {params['$limit']} OFFSET {params['$offset']}")
        rows = [dict(zip(read.columns, r)) for r in read.fetchall()]
        return json.loads(json.dumps(rows, default=str))

    register_service(spark, "service_for_tests", "id long, name string, size double, day date, even boolean, box string", fetch)

    def asked():
        with open(log) as f:
            return [json.loads(x) for x in f]

    def clear():
        open(log, "w").close()

    return data, asked, clear


def load(spark, **options):
    return spark.read.format("service_for_tests").options(**{"order": "id", "wait": 0, **options})


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


CASES = [
    ("name = 'it''s 3' AND id > 100", "name = 'it''s 3'", "id > 100"),
    ("name IS NULL", "name is null"),
    ("name <=> 'it''s 1'", "(name = 'it''s 1' and name is not null)"),
    ("NOT name <=> 'it''s 1'", "(name != 'it''s 1' or name is null)"),
    ("NOT name = 'it''s 1'", "not (name = 'it''s 1')"),
    ("size BETWEEN 2.5D AND 40.25D", "size >= 2.5", "size <= 40.25"),
    ("day >= DATE '2026-01-20' AND even", "day >= '2026-01-20'"),
    ("id IN (3, 5, 499)", "id in (3, 5, 499)"),
    ("name LIKE 'it''s%'", "starts_with(name, 'it''s')"),
    ("name LIKE '%s 4%'", "contains(name, 's 4')"),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_conditions_go_with_the_request(spark, service, case):
    data, asked, clear = service
    condition, *told = case
    clear()
    frame = load(spark).schema("id long, name string, size double, day date, even boolean").load().where(condition)
    rows = sorted(r.id for r in frame.collect())
    wanted = sorted(r.id for r in spark.read.parquet(data).where(condition).collect())
    assert rows == wanted and rows
    texts = asked()[0]["$where"].split(" and ") if len(told) > 1 else [asked()[0]["$where"]]
    assert all(t in " and ".join(texts) for t in told)
    assert asked()[0]["$select"] == "id,name,size,day,even" and asked()[0]["$limit"] == "50000"


def test_nothing_is_left_for_spark_of_what_was_pushed(spark, service):
    frame = load(spark).load().where("id > 10 AND name = 'it''s 3'")
    assert "Filter" not in plan(frame).split("BatchScan")[0]
    mixed = load(spark).load().where("id > 10 AND length(name) > 2 AND name LIKE '%3'")
    left = plan(mixed).split("BatchScan")[0]
    assert "length" in left and "id" not in left.split("Filter")[1].split("\n")[0].replace("(id", "")
    assert sorted(r.id for r in mixed.collect()) == [i for i in range(11, 500) if i % 10 and i % 7 == 3]


def test_columns_and_pages(spark, service):
    _, asked, clear = service
    for lanes in (1, 3):
        clear()
        frame = load(spark, limit=100, lanes=lanes).schema("id long, box string").load()
        assert frame.rdd.getNumPartitions() == lanes and sorted(r.id for r in frame.collect()) == list(range(500))
        assert {a["$select"] for a in asked()} == {"id,box"} and "0" in {a["$offset"] for a in asked()} and "400" in {a["$offset"] for a in asked()}
    with pytest.raises(Exception, match="more than 2 pages"):
        load(spark, limit=100, max_pages=2).load().collect()


def test_tries(spark, tmp_path):
    count = tmp_path / "count"
    count.write_text("")

    def fetch(params):
        with open(count, "a") as f:
            f.write("x")
        if len(open(count).read()) < 3:
            raise OSError("busy")
        return [{"id": "7", "note": {"a": 1}}]

    register_service(spark, "busy_for_tests", "id long, note string, missing double", fetch)
    read = spark.read.format("busy_for_tests").option("wait", 0)
    assert [tuple(r) for r in read.load().collect()] == [(7, '{"a": 1}', None)]
    count.write_text("")
    with pytest.raises(Exception, match="busy"):
        read.option("tries", 2).load().collect()


def test_what_the_service_cannot_say():
    assert where_text(ds.EqualTo(("a", "b"), 1)) is None and where_text(ds.StringEndsWith(("a",), "x")) is None
    assert where_text(ds.Not(ds.StringEndsWith(("a",), "x"))) is None and where_text(ds.In(("a",), (1, None))) is None
    assert where_text(ds.EqualTo(("a",), b"x")) is None and literal(float("nan")) is None
    assert literal(dt.datetime(2026, 1, 2, 3, 4, 5)) == "'2026-01-02T03:04:05.000'" and literal(True) == "true"
    assert where_text(ds.EqualNullSafe(("a",), None)) == "a is null"
