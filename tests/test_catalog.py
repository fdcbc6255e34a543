import duckdb
import pytest

import __spark_entry__
from fieldweave.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def told(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_gives_the_rows_of_its_sql(spark, duck, small, name):
    frame = catalog.QUERIES[name](spark, small)
    wanted = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert told(frame.columns, map(tuple, frame.collect())) == told(wanted.columns, wanted.fetchall())


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sorted_snapshot_is_sorted(spark, small):
    got = [(r.date, r.id) for r in catalog.QUERIES["sorted_snapshot"](spark, small).collect()]
    assert got == sorted(got)
