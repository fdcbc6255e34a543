"""Writers that die at each step, writers that meet, sorted tables of which a part is written again."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from fieldweave.sources import tables
from fieldweave.sources.commits import Log
from fieldweave.sources.schemas import TABLES

KIND = "k string, n int"


class Killed(BaseException):
    """As if the process ended here: nothing may catch it."""


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), KIND)


def guards(spark, *ids):
    return spark.createDataFrame([(i, "", "", "", f"note {i}") for i in ids], ", ".join(f"{c} string" for c in TABLES["TreeGuards"]))


def told(frame):
    return sorted(map(tuple, frame.collect()))


def killed_at(monkeypatch, step):
    """From here on, a writer ends before or after a step."""
    name, when = step
    original = getattr(Log, name)

    def run(*args):
        if when == "after":
            original(*args)
        raise Killed

    monkeypatch.setattr(Log, name, staticmethod(run) if name == "_rename" else run)


STEPS = [("new_data", "before"), ("publish", "before"), ("_prepare", "before"), ("_prepare", "after"), ("_rename", "before"), ("_rename", "after")]


@pytest.mark.parametrize("step", STEPS)
def test_a_writer_that_dies_leaves_the_old_or_the_new_table(spark, tmp_path, monkeypatch, step):
    store, other = tables.Versions(spark, f"{tmp_path}/v", KIND, ["k"]), tables.Tables(spark, str(tmp_path))
    store.put(rows(spark, ("a", 1)), 0)
    other.overwrite("TreeGuards", guards(spark, "1"))
    with monkeypatch.context() as broken:
        killed_at(broken, step)
        for write in (lambda: store.put(rows(spark, ("b", 2)), 1), lambda: other.overwrite("TreeGuards", guards(spark, "2"))):
            with pytest.raises(Killed):
                write()
    done = step == ("_rename", "after")
    assert told(store.read()) == [("b", 2) if done else ("a", 1)]
    assert [r.treeId for r in other.read("TreeGuards").collect()] == ["2" if done else "1"]
    number = store.latest()  # the next writers are not held up
    assert number == 1 + done and store.change(rows(spark, ("c", 3)), number) == number + 1
    assert other.append_new("TreeGuards", guards(spark, "7"), "treeId", ["note"]) == 1
    store.clean(0), other.clean("TreeGuards", 0)
    assert ("c", 3) in told(store.read()) and other.read("TreeGuards").count() == 2
    assert not list((tmp_path / "v" / "pending").glob("*")) and len(list((tmp_path / "v" / "data").glob("*"))) == number + 1


def test_an_unfinished_entry_is_never_seen(spark, tmp_path, monkeypatch):
    log = Log(spark, f"{tmp_path}/l")
    assert log.latest() == 0 and log.version().number == 0 and log.publish(1, {"x": "ü"}) and log.entry(1)["x"] == "ü"
    monkeypatch.setattr(Log, "_rename", staticmethod(lambda store, a, b: None))
    assert log.publish(1, {"x": 2}) is False and log.entry(1)["x"] == "ü"
    monkeypatch.undo()
    # Both saw the number free: a rename into a number that is taken changes nothing.
    monkeypatch.setattr(Log, "_rename", staticmethod(lambda store, a, b: store.rename(a, b)))
    assert log.publish(1, {"x": 3}) is False and log.entry(1)["x"] == "ü" and log.latest() == 1
    assert [p.name for p in (tmp_path / "l" / "log" / "000000001").iterdir() if not p.name.startswith(".")] == ["entry.json"]


def test_many_writers_at_once(spark, tmp_path):
    log, won = Log(spark, f"{tmp_path}/l"), []

    def write(i):
        won.extend((n, i) for n in range(1, 6) if log.publish(n, {"by": i}))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(6)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(n for n, _ in won) == [1, 2, 3, 4, 5] and all(log.entry(n)["by"] == i for n, i in won)


def test_writers_of_different_keys_both_succeed(spark, tmp_path):
    store = tables.Versions(spark, f"{tmp_path}/v", KIND, ["k"])
    store.put(rows(spark, ("a", 1), ("b", 1), ("c", 1)), 0)
    first = store.version()
    assert store.change(rows(spark, ("a", 2)), 1) == 2
    assert store.change(rows(spark, ("b", 3), ("d", 3)), 1, gone=rows(spark, ("c", 0))) == 3
    assert told(store.read()) == [("a", 2), ("b", 3), ("d", 3)] and told(store.read(2)) == [("a", 2), ("b", 1), ("c", 1)]
    assert store.version() != first and store.version().number == 3 and store.log.version(1) == first
    for taken in (rows(spark, ("a", 9)), rows(spark, ("c", 9))):
        with pytest.raises(tables.Conflict):
            store.change(taken, 1)
    with pytest.raises(tables.Conflict):
        store.change(rows(spark, ("x", 1)), 2, gone=rows(spark, ("d", 0)))
    assert store.latest() == 3 and told(store.read()) == [("a", 2), ("b", 3), ("d", 3)]
    assert store.compact() == 4 and told(store.read()) == [("a", 2), ("b", 3), ("d", 3)]
    assert store.change(rows(spark, ("e", 1)), 3) == 5  # compaction is no change
    assert store.put(rows(spark, ("z", 0)), 5)
    with pytest.raises(tables.Conflict):
        store.change(rows(spark, ("y", 0)), 5)  # the whole table was replaced
    with pytest.raises(ValueError, match="key"):
        tables.Versions(spark, f"{tmp_path}/w", KIND).change(rows(spark, ("y", 0)), 0)
    kept = store.clean(0, keep_last=1)
    assert len(kept) == 5 and told(store.read()) == [("z", 0)]


def test_an_update_is_made_again_after_a_conflict(spark, tmp_path):
    store = tables.Versions(spark, f"{tmp_path}/v", KIND, ["k"])
    store.put(rows(spark, ("a", 1), ("b", 10)), 0)
    seen = []

    def more(there):
        if not seen:  # another writer is quicker, with the same key
            store.change(rows(spark, ("a", 5)), store.latest())
        seen.append(1)
        return there.where("k = 'a'").withColumn("n", F.col("n") + 1)

    assert store.update_keys(more) == 3 and len(seen) == 2 and told(store.read()) == [("a", 6), ("b", 10)]


def test_appends_of_two_writers_keep_each_key_once(spark, tmp_path, monkeypatch):
    store = tables.Tables(spark, str(tmp_path))
    original, first = Log.publish, []

    def slower(self, number, entry):
        if not first:
            first.append(1)
            assert store.append_new("TreeGuards", guards(spark, "1", "2"), "treeId", ["note"]) == 2
        return original(self, number, entry)

    monkeypatch.setattr(Log, "publish", slower)
    assert store.append_new("TreeGuards", guards(spark, "2", "3"), "treeId", ["note"]) == 1
    assert [r[0] for r in told(store.read("TreeGuards"))] == ["1", "2", "3"]
    before = store.version("TreeGuards")
    assert store.append_new("TreeGuards", guards(spark, "3"), "treeId", ["note"]) == 0 and store.version("TreeGuards") == before


def test_plain_files_count_until_the_first_change(spark, tmp_path):
    store = tables.Tables(spark, str(tmp_path))
    guards(spark, "1").write.options(**tables.CSV).csv(store.path("TreeGuards"))
    assert "TreeGuards" not in store.create_missing() and store.read("TreeGuards").count() == 1
    assert store.append_new("TreeGuards", guards(spark, "1", "2"), "treeId", ["note"]) == 1
    assert store.read("TreeGuards").count() == 2 and store.read("TreeGuards", 0).count() == 1


def acts(spark, *entries):
    return spark.createDataFrame([(i, d, *[""] * 5, s) for i, d, s in entries], ", ".join(f"{c} string" for c in TABLES["activities"]))


def check_sorted(store, wanted):
    parts = store.parts("activities", store.log("activities").latest())
    assert all(tuple(a["high"]) < tuple(b["low"]) for a, b in zip(parts, parts[1:]))
    read = []
    for p in parts:
        own = [(r.date or "0000-00-00", r.id, r.scrapedAt) for r in store._read("activities", [p]).coalesce(1).collect()]
        assert own == sorted(own) and list(own[0][:2]) == p["low"] and list(own[-1][:2]) == p["high"] and len(own) == p["rows"]
        read += own
    assert read == sorted((d or "0000-00-00", i, s) for i, (d, s) in wanted.items())
    return {p["path"] for p in parts}


def test_a_merge_writes_only_the_ranges_it_falls_into(spark, tmp_path):
    store = tables.Tables(spark, str(tmp_path))
    there = {f"{i:03d}": (f"2026-01-{1 + i // 10:02d}", "1") for i in range(200)}
    store.rewrite_sorted("activities", acts(spark, *[(i, d, s) for i, (d, s) in there.items()]), "id", ["scrapedAt"], file_rows=20)
    before = check_sorted(store, there)
    assert 8 <= len(before) <= 14
    new = [("x1", "2026-01-05", "2"), ("x1", "2026-01-05", "1"), ("x2", "2026-01-05", "2"), (None, "2026-01-05", "2"), ("", "2026-01-05", "2")]
    gone = store.merge_sorted("activities", acts(spark, *new), "id", ["scrapedAt"], file_rows=20)
    there |= {"x1": ("2026-01-05", "2"), "x2": ("2026-01-05", "2")}
    after = check_sorted(store, there)
    assert 1 <= len(gone) <= 2 and before - after == set(gone)
    # A row that moves to another range: both files are written again, those between are not.
    gone = store.merge_sorted("activities", acts(spark, ("001", "2026-01-20", "3"), ("y", "", "3")), "id", ["scrapedAt"], file_rows=20)
    there |= {"001": ("2026-01-20", "3"), "y": ("", "3")}
    last = check_sorted(store, there)
    assert 2 <= len(gone) <= 3 and after - last == set(gone)
    assert store.merge_sorted("activities", acts(spark).limit(0), "id", ["scrapedAt"]) == []
    # All keys of a file go elsewhere.
    store.merge_sorted("activities", acts(spark, *[(i, "2027-01-01", "4") for i in list(there)[:60]]), "id", ["scrapedAt"], file_rows=20)
    there |= {i: ("2027-01-01", "4") for i in list(there)[:60]}
    check_sorted(store, there)


def test_merges_at_random(spark, tmp_path):
    rng, store, there = random.Random(4), tables.Tables(spark, str(tmp_path)), {}
    for turn in range(5):
        new = {str(rng.randrange(60)): (rng.choice(["", "2026-01-01", f"2026-02-{rng.randrange(1, 28):02d}"]), str(turn)) for _ in range(15)}
        store.merge_sorted("activities", acts(spark, *[(i, d, s) for i, (d, s) in new.items()]), "id", ["scrapedAt"], file_rows=7)
        there |= new
        check_sorted(store, there)


@pytest.mark.parametrize("n", [1, 2, 5, 64, 65])
def test_places_in_few_and_many_ranges(spark, n):
    lows = sorted([f"2024-01-{random.Random(i).randint(1, 9):02d}", str(i)] for i in range(0, 2 * n, 2))
    spots = [(d, k) for low in lows for d, k in ((low[0], low[1]), (low[0], low[1] + "0"), (low[0], ""), ("0000-00-00", "x"), ("2025", "ü"))]
    got = spark.createDataFrame(spots, "d string, k string").select("d", "k", tables._range_of(lows, F.col("d"), F.col("k")).alias("i")).collect()
    assert [r.i for r in got] == [max(sum(tuple(low) <= s for low in lows) - 1, 0) for s in spots]


def test_a_merge_into_all_files_reads_them_once(spark, tmp_path, monkeypatch):
    """Where new rows fall into every file, none is asked for its keys, and no row goes through Python."""
    store = tables.Tables(spark, str(tmp_path))
    store.rewrite_sorted("activities", acts(spark, *[(str(i), f"2024-01-{i % 9 + 1:02d}", "old") for i in range(90)]), "id", ["scrapedAt"], file_rows=20)
    read, before = [], tables.Tables._read
    monkeypatch.setattr(tables.Tables, "_read", lambda self, name, parts: (read.append({p["path"].split("/run=")[0] for p in parts}), before(self, name, parts))[1])
    monkeypatch.setattr(F, "pandas_udf", lambda *a: pytest.fail("rows go through Python"))
    old = {p["path"].split("/run=")[0] for p in store.parts("activities", store.log("activities").latest())}
    assert len(store.merge_sorted("activities", acts(spark, *[(str(i), f"2024-01-{i % 9 + 1:02d}", "new") for i in range(0, 90, 2)]), "id", ["scrapedAt"], file_rows=20)) > 2
    assert sum(r == old for r in read) == 1
    check_sorted(store, {str(i): (f"2024-01-{i % 9 + 1:02d}", "old" if i % 2 else "new") for i in range(90)})


def test_a_merge_sorts_a_plain_table(spark, tmp_path):
    store = tables.Tables(spark, str(tmp_path))
    store.overwrite("activities", acts(spark, ("2", "b", "1"), ("1", "a", "1")))
    store.merge_sorted("activities", acts(spark, ("2", "0", "2")), "id", ["scrapedAt"])
    check_sorted(store, {"1": ("a", "1"), "2": ("0", "2")})


def test_version_ids_are_those_of_git(spark):
    got = spark.range(1).select(tables.version_id(F.lit("what is up, doc?")), tables.version_id(F.lit(""))).first()
    assert tuple(got) == ("bd9dbf5aae1a3862dd1526723246b20206e5fc37", "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391")
