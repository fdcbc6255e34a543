"""Queries with SQL against DuckDB, and each operator on odd rows."""

import duckdb
import pytest

import __spark_entry__
from fieldweave.llm import queries
from fieldweave.llm.common import reduced


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    frame, wanted = queries.QUERIES[name](spark, small), con.sql(queries.ORACLE_SQL[name])
    told = lambda names, rows: sorted(repr(sorted(zip(names, r), key=lambda p: p[0])) for r in rows)
    assert told(frame.columns, map(tuple, frame.collect())) == told(wanted.columns, wanted.fetchall())


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {"pipeline", *queries.QUERIES} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))


def test_reduced_keeps_all_that_match(spark):
    big = spark.range(5000).selectExpr("id", "cast(id as string) AS s")
    small = spark.range(0, 5000, 50).selectExpr("id", "cast(id as string) AS s")
    left = reduced(big, small, ["id", "s"])
    assert left.columns == ["id", "s"] and left.join(small, "id", "left_semi").count() == 100 and left.count() < 1000
    assert reduced(big, small.limit(0), ["id"]).count() == 0
