import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldweave.operators import groups, joins, rows
from fieldweave.plans import workflow


def test_kept_once_first_and_last(spark):
    given = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z"), ("", 1, "e"), (None, 1, "n")], "id string, seq int, v string")
    assert sorted(map(tuple, rows.kept_once(given, ["id"], ["seq"]).collect())) == [("a", 1, "x"), ("b", 1, "z")]
    assert sorted(map(tuple, rows.kept_once(given, ["id"], ["seq"], "last").collect())) == [("a", 2, "y"), ("b", 1, "z")]
    assert rows.kept_once(given.limit(0), ["id"], ["seq"]).count() == 0


def test_incremental_append_ignores_missing_ids(spark):
    new = spark.createDataFrame([("1", 1), ("2", 1), ("2", 2), ("", 1), (None, 1)], "id string, seq int")
    old = spark.createDataFrame([("1",), (None,), ("",)], "id string")
    assert [tuple(r) for r in joins.incremental_append(new, old, "id", ["seq"]).collect()] == [("2", 1)]
    assert joins.incremental_append(new, old.limit(0), "id", ["seq"]).count() == 2


def test_missing_keys(spark):
    have = spark.createDataFrame([("1",)], "treeId string")
    asked = spark.createDataFrame([("1",), ("10",), ("9",), ("9",), (None,), ("",)], "treeId string")
    assert sorted(r.treeId for r in joins.missing_keys(asked, "treeId", have).collect()) == ["10", "9"]


def test_lookup_cascade_takes_whole_rows(spark):
    keys = spark.createDataFrame([(k,) for k in "abcdef"], "treeId string")
    kind = "treeId string, lat string, lng string, address string, species string"
    cache = spark.createDataFrame([("a", "1", "2", "ca", "cs"), ("b", "", "2", "cb", "x"), ("e", "0", "2", "ce", "x")], kind)
    api = spark.createDataFrame([("b", "3", "4", None, None), ("c", "5", None, "ac", None)], kind)
    census = spark.createDataFrame([("a", "9", "9", "za", "zs"), ("b", "9", "9", "zb", "zs"), ("c", "7", "8", "zc", "zs"), ("e", "7", "8", None, None)], kind)
    got = {r.treeId: (r.lat, r.lng, r.address, r.species, r.source) for r in joins.lookup_cascade(keys, "treeId", [("cache", cache), ("api", api), ("census", census)], ("census", "species", {"api"})).collect()}
    assert got == {"a": ("1", "2", "ca", "cs", "cache"), "b": ("3", "4", "", "zs", "api"), "c": ("7", "8", "zc", "zs", "census"), "e": ("7", "8", "", "", "census")}


def test_renaming_keeps_the_last_of_a_name(spark):
    given = spark.createDataFrame([("old", "new", 1)], "condition string, tpcondition string, `odd name` int")
    out = rows.renamed(given, {"condition": "health", "tpcondition": "health"})
    assert out.columns == ["health", "odd name"] and out.first().health == "new"


def test_names_and_required_columns(spark):
    out = rows.normalised_names(spark.createDataFrame([(1, 2)], "`﻿Tree ID` int, ` Lat ` int"))
    assert out.columns == ["tree_id", "lat"]
    assert rows.missing_columns(out, ["lat", "lng"]) == ["lng"]
    with pytest.raises(ValueError, match="lng"):
        rows.require_columns(out, ["lng"])
    assert rows.in_list(out, "nta", ["x"]).count() == 1


def test_fallbacks(spark):
    nums = spark.range(10).toDF("n")
    fails = lambda: (_ for _ in ()).throw(OSError("gone"))
    assert rows.first_nonempty([fails, lambda: nums.where("n > 99"), lambda: nums.where("n > 7")]).count() == 2
    assert rows.first_nonempty([lambda: nums.where("n > 99")]) is None
    assert rows.first_nonempty([lambda: nums], accept=lambda f: "x" in f.columns) is None
    assert sorted(r.n for r in rows.first_nonempty_filter(nums, [F.col("n") > 99, F.col("n") > 7, F.col("n") > 0]).collect()) == [8, 9]
    assert rows.first_nonempty_filter(nums, [F.col("n") > 99]).count() == 0


def test_snapshot_order_is_by_characters(spark):
    given = spark.createDataFrame([("2026-01-01", "9"), ("2026-01-01", "10"), ("", "5"), (None, "4")], "date string, id string")
    assert [r.id for r in given.orderBy(*rows.snapshot_order()).collect()] == ["4", "5", "10", "9"]


def test_pages(spark):
    nums = spark.range(10).toDF("n")
    pages = [rows.page(nums, ["n"], 4, o) for o in (0, 4, 8)]
    assert [p.count() for p in pages] == [4, 4, 2]
    assert sorted(r.n for r in rows.union_pages(pages).collect()) == list(range(10))


def test_argmax_takes_the_first_of_equals(spark):
    given = spark.createDataFrame([("k", 3, 2, "b"), ("k", 3, 1, "a"), ("k", 1, 0, "c")], "k string, v int, pos int, w string")
    assert rows.argmax_first(given, ["k"], F.col("v"), F.col("pos"), {"w": F.col("w")}).first().w == "a"


def test_task_cards(spark):
    kind = workflow.TASK + ", seq int"
    tasks = spark.createDataFrame([("t2", "E", "P", "Ann", "1998-06-15", "1998-07-01", 2), ("t1", "", "P", "Ann", None, "", 1), ("t3", "E", "P", None, None, None, 3), ("t4", "E", "P", "", None, None, 4)], kind)
    got = {r.who: r for r in groups.task_cards(tasks, dt.date(1998, 6, 15), {"Ann": "ann@example.org"}, [F.col("seq")]).collect()}
    assert got["Ann"].message == "New tasks assigned to <users/ann@example.org> (2)"
    assert [tuple(x) for x in got["Ann"]["items"]] == [("P · Event", "t1", "Due: TBD"), ("P · E", "t2", "Due: Today · Event: 1998-07-01")]
    assert got["Unassigned"].n == 2 and got["Unassigned"].subtitle == "2 tasks assigned"
    total = groups.delivery_totals(groups.task_cards(tasks, dt.date(1998, 6, 15), {}, [F.col("seq")]), F.lit(True)).first()
    assert (total["count"], total.assignees) == (4, 2)


def test_key_pages_hold_every_row(spark):
    nums = spark.createDataFrame([(k,) for k in (5, 7, 7, 900, None, -3)], "n long")
    for pages in (1, 3, 8):
        assert sorted((r.n for r in rows.union_pages(rows.key_pages(nums, "n", pages)).collect()), key=str) == sorted([5, 7, 7, 900, None, -3], key=str)
    assert rows.union_pages(rows.key_pages(nums.where("n > 1000 or n is null"), "n", 3)).count() == 1
    assert rows.union_pages(rows.key_pages(nums.limit(0), "n", 3)).count() == 0


def test_items_of_a_large_group_are_numbered_over_parts(spark):
    given = spark.range(3000).selectExpr("CASE WHEN id % 10 > 0 THEN 'hot' WHEN id % 20 = 0 THEN cast(id % 7 AS string) END AS k", "3000 - id AS seq", "id AS v")
    got = groups.group_items(given, F.col("k"), [F.col("seq")], F.col("v")).collect()
    wanted = {}
    for r in given.orderBy("seq").collect():
        wanted.setdefault(r.k, []).append(r.v)
    assert len(got) == 3000 and {(r.key, r.position, r.n, r["item"]) for r in got} == {(k, i + 1, len(vs), v) for k, vs in wanted.items() for i, v in enumerate(vs)}


def test_progress(spark):
    given = spark.createDataFrame([({"a": True, "b": False, "c": None},), ({},)], "p map<string,boolean>")
    done = given.select(groups.checked_tasks(F.col("p")).alias("n"), groups.progress_percent(groups.checked_tasks(F.col("p")).cast("double"), F.size("p")).alias("x")).collect()
    assert [tuple(r) for r in done] == [(1, 33), (0, 0)]


def test_templates_have_the_documented_totals(spark):
    counts = {r.type: r["count"] for r in workflow.template_rows(spark).groupBy("type").count().collect()}
    assert counts == {"Field Trip": 17, "Private Volunteer": 16, "Public Volunteer": 19, "Public Program": 11}


def test_event_rows(spark):
    names = [p.split()[0] for p in workflow.EVENT.split(", ")]
    full = dict.fromkeys(names) | {"id": "1", "name": "N", "owner": "O", "date": "2026-04-20", "type": "Non-Public", "collab": "Other Organization", "collabNotes": "C", "attendance": "0"}
    bare = dict.fromkeys(names) | {"id": "2", "name": "M", "date": "2026-04-20", "type": "School Virtual", "collabNotes": "S", "categories": ["a", "b"], "attendance": "20 people"}
    events = spark.createDataFrame([tuple(e[n] for n in names) for e in (full, bare)], workflow.EVENT)
    first, second = workflow.tracker_row(events).collect()
    assert (first.c10, first.c11, first.c13, len(first)) == ("", "", "", 21)
    assert (second.c06, second.c10, second.c11) == ("a, b", "N/A (not a public event)", "N/A")
    brief = {(r.id, r.label): r.value for r in workflow.event_brief(events).collect()}
    assert brief["1", "Partner/s"] == "C" and brief["1", "Client/s"] == "N/A" and brief["1", "Format"] == "In-person"
    assert brief["2", "Client/s"] == "S" and brief["2", "Format"] == "Virtual" and brief["2", "Expenses"] == "NO" and brief["2", "Event Lead"] == "TBD"
    tickets = {r.id: r for r in workflow.ticket(events).collect()}
    assert tickets["1"].capacity == 50 and tickets["2"].capacity == 20 and tickets["2"].online and tickets["1"].end == "2026-04-20T18:00:00Z"
    assert events.where(workflow.is_ticketed()).count() == 1


def test_pages_by_cursor(spark):
    nums = spark.range(10).toDF("n")
    seen, after = [], None
    while got := [r.n for r in rows.page_after(nums, "n", 4, after).collect()]:
        seen, after = seen + got, got[-1]
    assert seen == list(range(10))


def test_scan_counts_and_numeric_order(spark):
    nums = spark.range(10).toDF("n")
    assert [r.n for r in rows.scan(nums, lambda f: f["n"] > 3, lambda f: f["n"] % 2 == 0).collect()] == [4, 6, 8] and rows.scan(nums).count() == 10
    kept, seen = rows.counted(nums, F.col("n") > 6)
    assert kept.count() == 3 and seen.get == {"n_before": 10, "n_after": 3}
    given = spark.createDataFrame([("10",), ("x",), ("9",), (None,), ("2",)], "id string")
    assert [r.id for r in given.orderBy(*rows.numeric_order("id")).collect()] == ["2", "9", "10", None, "x"]


def test_a_source_is_tried_again(spark):
    left = [OSError("busy"), OSError("busy")]

    def source():
        if left:
            raise left.pop()
        return spark.range(3)

    assert rows.retried(source, tries=3, wait=0).count() == 3
    left += [OSError("gone")] * 2
    with pytest.raises(OSError, match="gone"):
        rows.retried(source, tries=2, wait=0)
    with pytest.raises(ZeroDivisionError):  # not a read error
        rows.first_nonempty([lambda: 1 / 0, lambda: spark.range(1)])


def test_large_groups_have_several_rows(spark):
    given = spark.range(25).selectExpr("'k' AS k", "id")
    got = groups.group_collect(given, F.col("k"), [F.col("id")], F.col("id"), most=10).orderBy("part").collect()
    assert [(r.part, r.n, r["items"]) for r in got] == [(0, 25, list(range(10))), (1, 25, list(range(10, 20))), (2, 25, list(range(20, 25)))]
