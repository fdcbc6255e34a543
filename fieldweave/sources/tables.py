"""Flat CSV tables of fixed columns: read, overwrite, append new rows, create."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.operators.joins import incremental_append
from fieldweave.operators.rows import given, kept_once
from fieldweave.session import place
from fieldweave.sources.commits import Log, Version
from fieldweave.sources.schemas import TABLES, ddl

#: Quotes doubled, nothing written for an empty text, line breaks within quotes.
CSV = {"header": "true", "escape": '"', "emptyValue": "", "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Rows of a file of a sorted table, about.
FILE_ROWS = 1_000_000


class Tables:
    """The tables under a folder. Missing and unknown ones read as empty.

    What a table holds is named by the latest entry of its log (see commits): data folders, and for sorted tables their files
    with the least and the greatest place in the order. A change writes new data and publishes a new entry, so readers see the
    table before or after it, never between. A plain CSV folder of the table's name counts until the first change.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def log(self, name: str) -> Log:
        return Log(self.spark, f"{self.path(name)}.table")

    def parts(self, name: str, number: int) -> list[dict]:
        """What the table is made of at a number: path, and low, high and rows where it is a file of a sorted table."""
        if number:
            return self.log(name).entry(number)["parts"]
        store, plain = place(self.spark, self.path(name))
        return [{"path": self.path(name)}] if store.exists(plain) else []

    def read(self, name: str, number: int | None = None) -> DataFrame:
        """The table as it is, or as it was at a number."""
        if name not in TABLES:
            return self.spark.createDataFrame([], "value string")
        return self._read(name, self.parts(name, self.log(name).latest() if number is None else number))

    def _read(self, name: str, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], ddl(name))
        return self.spark.read.schema(ddl(name)).options(**CSV).csv([p["path"] for p in parts]).na.fill("")

    def version(self, name: str) -> Version:
        """Number and id of what read gives now."""
        return self.log(name).version()

    def _write(self, name: str, rows: DataFrame) -> dict:
        path = f"{self.log(name).folder}/{self.log(name).new_data()}"
        rows.select(*TABLES[name]).write.options(**CSV).csv(path)
        return {"path": path}

    def overwrite(self, name: str, rows: DataFrame) -> int:
        """Replace the table; no rows leave it empty. The number it has then. The rows may come from the table itself."""
        part = self._write(name, rows)
        return self._publish(name, lambda _: [part])

    def _publish(self, name: str, parts: Callable[[int], list[dict]], tries: int = 5) -> int:
        """Publish the parts made for the number that is the latest; again for a later one if another writer was quicker."""
        log = self.log(name)
        for _ in range(tries):
            number = log.latest()
            if log.publish(number + 1, {"parts": parts(number)}):
                return number + 1
        raise RuntimeError(f"other writers of {name} were quicker {tries} times")

    def create_missing(self) -> list[str]:
        """Tables that were not there, now empty."""
        made = [n for n in TABLES if not self.log(n).latest() and not self.parts(n, 0)]
        for name in made:
            self.log(name).publish(1, {"parts": []})
        return made

    def known_keys(self, name: str, key: str) -> DataFrame:
        return self.read(name).select(key).where(F.col(key) != "").distinct()

    def append_new(self, name: str, rows: DataFrame, key: str, order: Sequence[Column | str]) -> int:
        """Append the rows whose key is not there yet, the first of each key; how many those were.

        If another writer was quicker, its rows are taken into account and what is left is appended after them.
        """
        log = self.log(name)
        for _ in range(5):
            number = log.latest()
            parts = self.parts(name, number)
            part = self._write(name, incremental_append(rows, self._read(name, parts), key, order))
            count = self._read(name, [part]).count()
            if not count or log.publish(number + 1, {"parts": [*parts, part]}):
                return count
        raise RuntimeError(f"other writers of {name} were quicker 5 times")

    def rewrite_sorted(self, name: str, rows: DataFrame, key: str, order: Sequence[Column | str], date: str = "date", keep: str = "last", file_rows: int = FILE_ROWS) -> None:
        """Replace the table by the last row of each key, sorted by date and key over all its files."""
        n_rows = rows.select(key).where(given(rows, key)).distinct().count()
        whole = self._sorted_files(name, kept_once(rows, [key], order, keep).withColumn("run", F.lit(0)), n_rows, key, date, file_rows)
        self._publish(name, lambda _: whole)

    def merge_sorted(self, name: str, rows: DataFrame, key: str, order: Sequence[Column | str], date: str = "date", keep: str = "last", file_rows: int = FILE_ROWS) -> list[str]:
        """Put the last row of each key into a sorted table, in place of rows that have the key there. The paths of the files that were replaced.

        Only files between whose least places and those of the next files new rows fall, and files that hold one of their keys, are
        written again; all others stay as they are and keep their names. Rows before the first file go to it. Rows without a
        key are left out. A table that is not sorted yet is sorted.
        """
        new = kept_once(rows, [key], order, keep).select(*TABLES[name]).na.fill("").persist()
        replaced: list[str] = []

        def merged(number: int) -> list[dict]:
            parts = self.parts(name, number)
            ranged = bool(parts) and all("low" in p for p in parts)
            touched = self._touched(name, parts, new, key, date) if ranged else list(range(len(parts)))
            replaced[:] = [parts[i]["path"] for i in touched]
            # Neighbouring touched files are one run; a new file never holds rows of two runs, so it overlaps no file that stays.
            lows = [parts[i]["low"] for k, i in enumerate(touched) if k == 0 or touched[k - 1] != i - 1] if ranged else []
            old = self._read(name, [parts[i] for i in touched])
            n_rows = new.count() + (sum(parts[i]["rows"] for i in touched) if ranged else old.count())
            runs = old.join(new, key, "left_anti").unionByName(new).withColumn("run", _range_of(lows, *_spot(key, date)))
            fresh = self._sorted_files(name, runs, n_rows, key, date, file_rows)
            return sorted([p for i, p in enumerate(parts) if i not in set(touched)] + fresh, key=lambda p: (p["low"], p["high"]))

        try:
            if not new.isEmpty():
                self._publish(name, merged)
        finally:
            new.unpersist()
        return replaced

    def _touched(self, name: str, parts: list[dict], new: DataFrame, key: str, date: str) -> list[int]:
        """Positions of the files that new rows fall into or that hold their keys. Keys are read of the files into which none fall."""
        into = {r.i for r in new.select(_range_of([p["low"] for p in parts], *_spot(key, date)).alias("i")).distinct().collect()}  # a row for each file at most
        others = {_short(p["path"]): i for i, p in enumerate(parts) if i not in into}
        if not others:
            return sorted(into)
        there = self._read(name, [parts[i] for i in others.values()]).select(key, F.substring_index(F.input_file_name(), "/", -_SHORT).alias("file"))
        holding = there.join(new.select(key), key, "left_semi").select("file").distinct().collect()
        return sorted(into | {others[r.file] for r in holding})

    def _sorted_files(self, name: str, rows: DataFrame, n_rows: int, key: str, date: str, file_rows: int) -> list[dict]:
        """Write rows of runs as files that are sorted within and against each other; their paths, least and greatest places and numbers of rows."""
        path = f"{self.log(name).folder}/{self.log(name).new_data()}"
        spot = [c.alias(n) for c, n in zip(_spot(key, date), ("__date", "__key"))]
        dealt = rows.select(*TABLES[name], "run", *spot).repartitionByRange(max(1, -(-n_rows // file_rows)), "run", "__date", "__key")
        dealt.sortWithinPartitions("run", "__date", "__key").drop("__date", "__key").write.partitionBy("run").options(**CSV).csv(path)
        store, top = place(self.spark, path)
        runs = [f"{path}/{f.getPath().getName()}" for f in store.listStatus(top) if f.isDirectory()]
        if not runs:
            return []
        there = self._read(name, [{"path": run} for run in runs])
        low_high = F.struct(*[c.alias(n) for c, n in zip(_spot(key, date), ("date", "key"))])
        found = there.groupBy(F.substring_index(F.input_file_name(), "/", -_SHORT).alias("file")).agg(F.min(low_high).alias("low"), F.max(low_high).alias("high"), F.count(F.lit(1)).alias("n"))
        return sorted(({"path": f"{path.rsplit('/', 1)[0]}/{r.file}", "low": list(r.low), "high": list(r.high), "rows": r.n} for r in found.collect()), key=lambda p: (p["low"], p["high"]))

    def clean(self, name: str, older_than: float = 86_400.0, keep_last: int = 1) -> list[str]:
        """Delete data that the last entries do not name, once it is older than any writer takes; what was deleted."""
        log = self.log(name)
        last = log.latest()
        parts = [p["path"] for n in range(max(1, last - keep_last + 1), last + 1) for p in self.parts(name, n)]
        return log.clean(older_than, {"/".join(p.split(".table/")[1].split("/")[:2]) for p in parts if ".table/" in p})

    def sync(self, activities: DataFrame, trees: DataFrame, order: Sequence[Column | str] = ("date", "id")) -> tuple[int, int]:
        """Append new activities, then new trees; how many of each. Without new activities that table isn't written; trees always are, as a version of their own."""
        counts = self.append_new("activities", activities, "id", order), self.append_new("trees", trees, "treeId", ["treeId"])
        if not counts[1]:
            self._publish("trees", lambda number: self.parts("trees", number))
        return counts


def _spot(key: str, date: str) -> tuple[Column, Column]:
    """Where a row stands in a sorted table."""
    return F.coalesce(F.nullif(F.col(date), F.lit("")), F.lit("0000-00-00")), F.coalesce(F.col(key), F.lit(""))


#: Names at the end of a file's path that tell it apart: data folder, run and file.
_SHORT = 3


def _short(path: str) -> str:
    return "/".join(path.split("/")[-_SHORT:])


def _range_of(lows: list[list[str]], date: Column, key: Column) -> Column:
    """The position of the last of some ascending places that is not after a row's; 0 if all are. There are as many as the log has files."""
    if len(lows) <= _FEW:
        return _halved(lows, F.struct(date, key), 0, len(lows))
    bounds = [tuple(low) for low in lows]

    @F.pandas_udf("int")
    def found(date: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([max(bisect_right(bounds, spot) - 1, 0) for spot in zip(date, key)], dtype="int32")

    return found(date, key)


#: So many places are compared in an expression, more in Python.
_FEW = 64


def _halved(lows: list[list[str]], spot: Column, first: int, end: int) -> Column:
    """The position, from first to before end, as comparisons that halve what is left."""
    if end - first <= 1:
        return F.lit(first)
    middle = (first + end) // 2
    return F.when(spot < F.struct(*map(F.lit, lows[middle])), _halved(lows, spot, first, middle)).otherwise(_halved(lows, spot, middle, end))


class Conflict(RuntimeError):
    """Another writer has changed the same keys."""


class Versions:
    """A Parquet table as numbered versions under a folder.

    A version is the whole table, or a change of the one before it: rows by key, and keys that go. Two writers who
    started from the same version both succeed if they changed different keys; if they changed the same one, the later one conflicts.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Sequence[str] = ()):
        self.spark, self.folder, self.schema, self.key = spark, folder, schema, list(key)
        self.log = Log(spark, folder)

    def latest(self) -> int:
        return self.log.latest()

    def version(self) -> Version:
        """Number and id of the newest version, for readers who want to know whether theirs still is."""
        return self.log.version()

    def read(self, number: int | None = None) -> DataFrame:
        number = self.latest() if number is None else number
        changes = []
        while number:
            entry = self.log.entry(number)
            rows = self._data(entry)
            if entry["kind"] != "change":
                break
            changes.append((number, rows))
            number -= 1
        else:
            rows = self.spark.createDataFrame([], self.schema)
        if not changes:
            return rows
        names = rows.columns
        whole = rows.withColumns({"__gone": F.lit(False), "__number": F.lit(0)})
        steps = reduce(lambda a, b: a.unionByName(b), [c.withColumn("__number", F.lit(n)) for n, c in changes], whole)
        newest = F.row_number().over(Window.partitionBy(*self.key).orderBy(F.desc("__number")))
        return steps.withColumn("__newest", newest).where("__newest = 1 AND NOT __gone").select(*names)

    def _data(self, entry: dict) -> DataFrame:
        schema = self.schema + (", __gone boolean" if entry["kind"] == "change" else "")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{entry['data']}")

    def _write(self, rows: DataFrame) -> str:
        data = self.log.new_data()
        rows.write.parquet(f"{self.folder}/{data}")
        return data

    def put(self, rows: DataFrame, after: int) -> bool:
        """Write the version after the one that was read, whole; False if another writer was quicker, and then nothing changes."""
        data = self._write(rows)
        if self.log.publish(after + 1, {"kind": "whole", "data": data}):
            return True
        self._forget(data)
        return False

    def _forget(self, data: str) -> None:
        store, path = place(self.spark, f"{self.folder}/{data}")
        store.delete(path, True)

    def update(self, merge: Callable[[DataFrame], DataFrame], tries: int = 2) -> int:
        """Put what merge makes of the newest version; if another writer was quicker, merge again with what that one wrote."""
        for _ in range(tries):
            number = self.latest()
            if self.put(merge(self.read(number)), number):
                return number + 1
        raise RuntimeError(f"other writers were quicker {tries} times")

    def change(self, rows: DataFrame, after: int, gone: DataFrame | None = None, tries: int = 100) -> int:
        """Change the version that was read by key: rows come in place of those of their keys, and keys of ``gone`` go. The number of the new version.

        Versions that others wrote since are kept if none of their keys is changed here; else it is a Conflict and nothing changes.
        A key with several rows, or in both rows and gone, is an error of the caller.
        """
        if not self.key:
            raise ValueError("a table that is changed by key needs one")
        names = self.spark.createDataFrame([], self.schema).columns
        changed = rows.select(*names, F.lit(False).alias("__gone"))
        if gone is not None:
            changed = changed.unionByName(gone.select(*self.key, F.lit(True).alias("__gone")), allowMissingColumns=True)
        data = self._write(changed)
        own = self.spark.read.schema(self.schema + ", __gone boolean").parquet(f"{self.folder}/{data}").select(*self.key)
        number = after
        for _ in range(tries):
            if self.log.publish(number + 1, {"kind": "change", "data": data}):
                return number + 1
            number += 1
            entry = self.log.entry(number)
            if entry["kind"] == "whole" or entry["kind"] == "change" and not self._data(entry).select(*self.key).join(own, self.key, "left_semi").isEmpty():
                self._forget(data)
                raise Conflict(f"version {number} has changed the same keys")
        self._forget(data)
        raise RuntimeError(f"other writers were quicker {tries} times")

    def update_keys(self, make: Callable[[DataFrame], DataFrame], tries: int = 5) -> int:
        """Change by the rows that ``make`` gives for the newest version; after a conflict they are made again from what the other writer left."""
        for left in reversed(range(tries)):
            number = self.latest()
            try:
                return self.change(make(self.read(number)), number)
            except Conflict:
                if not left:
                    raise
        raise ValueError("tries must be 1 or more")

    def compact(self) -> int:
        """Write the newest version whole, so that reading it takes no changes; its rows, and what counts as a conflict, stay the same."""
        while True:
            number = self.latest()
            data = self._write(self.read(number))
            if self.log.publish(number + 1, {"kind": "compacted", "data": data}):
                return number + 1
            self._forget(data)

    def clean(self, older_than: float = 86_400.0, keep_last: int | None = None) -> list[str]:
        """Delete data that no version names (of the last ones, if given) once it is older than any writer takes; what was deleted."""
        last = self.latest()
        first = 1 if keep_last is None else max(1, last - keep_last + 1)
        entries = []
        for number in range(last, 0, -1):
            entries.append(self.log.entry(number))
            if number <= first and entries[-1]["kind"] != "change":  # older ones are not needed to read those kept
                break
        return self.log.clean(older_than, {e["data"] for e in entries})


def envelope(rows: DataFrame, strategy: str) -> DataFrame:
    """One row with the number of rows, the strategy that gave them, and the rows: an answer to a caller, so for small results."""
    return rows.agg(F.count(F.lit(1)).alias("count"), F.lit(strategy).alias("strategy"), F.collect_list(F.struct(*rows.columns)).alias("activities"))


def write_json_array(rows: DataFrame, path: str) -> None:
    """One line with one array of all rows. This is one value, so it is for small tables; larger ones go to write.json."""
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def keyed_rows(text: DataFrame, column: str = "value") -> DataFrame:
    """treeId, lat, lng, address and species of a JSON object from id to [lat, lng, address, species]."""
    return text.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("treeId", "v")).select("treeId", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("lat", "lng", "address", "species"))])


def decoded_file(text: Column) -> Column:
    """A file's text from base64, line breaks in it ignored."""
    return F.decode(F.unbase64(F.regexp_replace(text, r"\s", "")), "UTF-8")


def version_id(text: Column) -> Column:
    """The id by which Git knows a file's text: a writer who names it can tell whether the file is still the one that was read."""
    content = F.encode(text, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.lit(b"\x00"), content))
