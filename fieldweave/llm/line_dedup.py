"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

An index keeps, under a folder that all machines share, three things by generation, one for each insertion or deletion:

- references: key, document and place of every line that is long enough to count (a key is 128 bits of SHA-256);
- counts: for every key that a generation touched, how many lines hold it and its least and greatest document;
- filters: a cuckoo filter for each shard of the keys, holding the keys with a count above 0.

An insertion asks the filters first: keys that they don't hold are new for certain, and only the others are looked up in the
counts, which decide. Keys whose count rises from 0 enter their shard's filter. A deletion counts the lines left of the
keys of the deleted documents; keys with none left leave their filter, so that all is as if the documents had never come. A
filter that gets too full is built again, larger, from the counts. Counts are summed before they are shuffled, so a very
common line is one row a task, and a shard holds only distinct keys. An insertion or deletion counts once its marker is there;
one that failed halfway, in whichever pass, is not seen and is written over.

A line whose key at least two documents hold stays in the least of them only. Null text is one empty line, as is empty
text. Documents with a null id are not indexed, and keep all lines. Rows of one id are one document, each row
with its own lines; repeated rows are kept. Inserting a document that is there already adds its lines once more; deleting an id deletes
all its rows. Ids are whole numbers. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import delete, reduced, shared_folder, shuffle_partitions, spread, table, text_or_empty, workspace, written
from fieldweave.llm.cuckoo import Cuckoo, buckets_for, is_full
from fieldweave.session import place

_BLANK = " \t\n\x0b\x0c\r"
_REFS = "key binary, doc_id long, row long, pos int, generation int"
_COUNTS = "shard int, key binary, n long, first long, last long, generation int"
_FILTERS = "shard int, keys long, buckets long, cells binary, generation int"


def line_key(line: Column) -> Column:
    stripped = F.btrim(line, F.lit(_BLANK))
    return F.unhex(F.substring(F.sha2(F.translate(stripped, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256), 1, 32))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def references(docs: DataFrame, id_column: str, text_column: str, least_chars: int) -> DataFrame:
    """key, doc_id, row (a hash of the row's text) and pos of every line with a key of so many code points."""
    text = text_or_empty(text_column)
    rows = spread(docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text")))
    lines = rows.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    long = lines.where((F.octet_length("line") >= least_chars) & (F.char_length(F.btrim("line", F.lit(_BLANK))) >= least_chars))
    return long.select(line_key(F.col("line")).alias("key"), "doc_id", "row", "pos")


def _keys(column: pa.ChunkedArray) -> np.ndarray:
    """Keys of 16 bytes as two numbers a row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, 2)


def _filter(row: pa.Table) -> Cuckoo:
    return Cuckoo(row["buckets"][0].as_py(), row["cells"][0].as_py())


def _screen(key, fresh: pa.Table, held: pa.Table) -> pa.Table:
    """fresh with a column that says whether the shard's filter holds the key."""
    known = _filter(held).holds(_keys(fresh["key"])) if held.num_rows and fresh.num_rows else np.zeros(fresh.num_rows, dtype=bool)
    return fresh.append_column("known", pa.array(known))


def _change(key, moved: pa.Table, held: pa.Table) -> pa.Table:
    """The shard's filter after keys came in, went out, or, where it is to be rebuilt, anew of all its keys."""
    into = _keys(moved.filter(moved["enters"])["key"])
    out = _keys(moved.filter(pc.invert(moved["enters"]))["key"])
    if held.num_rows and not held["rebuild"][0].as_py():
        own, keys = _filter(held), held["keys"][0].as_py()
        own.remove(out)
        own.add(into)
        keys += len(into) - len(out)
        buckets = held["buckets"][0].as_py()
    else:
        buckets, keys = buckets_for(len(into)), len(into)
        own = Cuckoo(buckets)
        own.add(into)
    shard = (held if held.num_rows else moved)["shard"][0].as_py()
    return pa.table({"shard": pa.array([shard], pa.int32()), "keys": [keys], "buckets": [buckets], "cells": pa.array([own.to_bytes()], pa.binary())})


class LineIndex:
    def __init__(self, spark: SparkSession, folder: str, shards: int | None = None, least_chars: int = 10):
        """An index in a folder, new or there already; shards are set when it is made and stay."""
        self.spark, self.folder, self.least_chars = spark, folder, least_chars
        self.begun: list[int] = []  # generations of an insertion that is not complete yet
        store, made = place(spark, f"{folder}/shards")
        if store.exists(made):
            self.shards = spark.read.parquet(f"{folder}/shards").first().shards
        else:
            self.shards = shards or shuffle_partitions(spark)
            spark.range(1).select(F.lit(self.shards).alias("shards")).coalesce(1).write.parquet(f"{folder}/shards")

    def generations(self) -> list[int]:
        """Those of complete insertions and deletions: a marker names the first and the last of one."""
        store, done = place(self.spark, f"{self.folder}/done")
        ends = [map(int, f.getPath().getName().split("-")) for f in store.listStatus(done)] if store.exists(done) else []
        return sorted([g for first, last in ends for g in range(first, last + 1)] + self.begun)

    def _read(self, kind: str, schema: str, only: list[int] | None = None) -> DataFrame:
        wanted = self.generations() if only is None else only
        store = place(self.spark, self.folder)[0]
        paths = [p for p in (f"{self.folder}/{kind}/generation={g}" for g in wanted) if store.exists(place(self.spark, p)[1])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{kind}").parquet(*paths)

    def _write(self, kind: str, generation: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/{kind}/generation={generation}")

    def _complete(self, first: int, last: int) -> None:
        store, marker = place(self.spark, f"{self.folder}/done/{first}-{last}")
        store.create(marker, True).close()

    def live(self, references: DataFrame | None = None) -> DataFrame:
        """References of documents that have not been deleted since."""
        refs = self._read("refs", _REFS) if references is None else references
        gone = self._read("gone", "doc_id long, generation int").groupBy("doc_id").agg(F.max("generation").alias("until"))
        return refs.join(gone, "doc_id", "left").where("until IS NULL OR generation > until").drop("until")

    def counts(self) -> DataFrame:
        """shard, key, n, first and last of each key, as its latest generation has them; n is 0 for keys that are gone."""
        latest = self._read("counts", _COUNTS).groupBy("shard", "key").agg(F.max_by(F.struct("n", "first", "last"), "generation").alias("c"))
        return latest.select("shard", "key", "c.*")

    def filters(self) -> DataFrame:
        """The filters as the latest generation has them, a row for each shard."""
        latest = [g for g in self.generations() if place(self.spark, self.folder)[0].exists(place(self.spark, f"{self.folder}/filters/generation={g}")[1])][-1:]
        return self._read("filters", _FILTERS, latest).drop("generation")

    def _by_key(self, refs: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        return refs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).select(shard.alias("shard"), "key", "n", "first", "last")

    def insert(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", passes: int = 1) -> None:
        """Add documents. A large load can be taken in several passes, each over a share of the documents and a generation of its own; lines are split once."""
        first = max(self.generations(), default=0) + 1
        refs = references(docs, id_column, text_column, self.least_chars).withColumn("generation", first + F.pmod(F.hash("doc_id"), F.lit(passes)))
        out = refs.write.partitionBy("generation").mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
        out.parquet(f"{self.folder}/refs")
        try:
            for generation in range(first, first + passes):
                with workspace(self.spark):
                    self._insert(generation)
                self.begun.append(generation)
            self._complete(first, first + passes - 1)
        finally:
            self.begun = []

    def _insert(self, generation: int) -> None:
        fresh = written(self._by_key(self._read("refs", _REFS, [generation])))
        filters = self.filters()
        kinds = "shard int, key binary, n long, first long, last long, known boolean"
        screened = fresh.withColumn("known", F.lit(False)) if filters.isEmpty() else written(fresh.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(_screen, kinds))
        asked = screened.where("known").select("key")
        old = self._read("counts", _COUNTS)
        old = reduced(old, asked, ["key"]).join(asked, "key", "left_semi").groupBy("key").agg(F.max_by(F.struct("n", "first", "last"), "generation").alias("old"))
        both = screened.join(old, "key", "left")
        there = F.col("known") & (F.coalesce(F.col("old.n"), F.lit(0)) > 0)
        merged = written(
            both.select(
                "shard", "key", F.when(there, F.col("n") + F.col("old.n")).otherwise(F.col("n")).alias("n"),
                F.when(there, F.least("first", "old.first")).otherwise(F.col("first")).alias("first"),
                F.when(there, F.greatest("last", "old.last")).otherwise(F.col("last")).alias("last"), (~there).alias("enters"),
            )
        )
        self._write("counts", generation, merged.drop("enters"))
        self._refilter(generation, merged.where("enters").select("shard", "key", "enters"))

    def delete(self, ids: DataFrame, id_column: str = "doc_id") -> None:
        """Take documents out again, by their ids."""
        generation = max(self.generations(), default=0) + 1
        with workspace(self.spark):
            gone = written(ids.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id")).distinct())
            refs = self.live()
            keys = written(refs.join(gone, "doc_id", "left_semi").select("key").distinct())
            left = reduced(refs, keys, ["key"]).join(keys, "key", "left_semi").join(gone, "doc_id", "left_anti")
            shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
            now = keys.join(self._by_key(left).drop("shard"), "key", "left").select(shard.alias("shard"), "key", F.coalesce("n", F.lit(0)).alias("n"), "first", "last")
            now = written(now)
            self._write("counts", generation, now)
            self._write("gone", generation, gone)
            self._refilter(generation, now.where("n = 0").select("shard", "key", F.lit(False).alias("enters")))
            self._complete(generation, generation)

    def _refilter(self, generation: int, moved: DataFrame) -> None:
        """Write the filters of a generation from those before it and the keys that enter or leave."""
        before = self.filters()
        growth = moved.groupBy("shard").agg(F.sum(F.when(F.col("enters"), 1).otherwise(-1)).alias("more"))
        sizes = growth.join(before.select("shard", "keys", "buckets"), "shard", "left").collect()  # a row for each shard
        rebuilt = [r.shard for r in sizes if r.buckets is None or is_full(r["keys"] + r.more, r.buckets)]
        held = before.withColumn("rebuild", F.col("shard").isin(rebuilt) if rebuilt else F.lit(False))
        if not before.isEmpty() and rebuilt:
            known = self._read("counts", _COUNTS, [*self.generations(), generation]).where(F.col("shard").isin(rebuilt))
            alive = known.groupBy("shard", "key").agg(F.max_by("n", "generation").alias("n")).where("n > 0").select("shard", "key", F.lit(True).alias("enters"))
            moved = moved.where(~F.col("shard").isin(rebuilt)).union(alive)
        changed = moved.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_change, "shard int, keys long, buckets long, cells binary")
        self._write("filters", generation, changed)

    def repeated(self) -> DataFrame:
        """key and first of the keys that several documents hold."""
        return self.counts().where("n > 0 AND first < last").select("key", "first")

    def dropped(self) -> DataFrame:
        """doc_id, row and places (ascending) of the lines that go."""
        keys = written(self.repeated())
        refs = reduced(self.live(), keys, ["key"]).join(keys, "key").where(F.col("doc_id") != F.col("first"))
        return refs.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("places"))

    def kept(self, docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
        """doc_id, n_lines, n_dropped and kept (the text without the lines that go) of documents that are in the index."""
        rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("text")).withColumn("row", F.xxhash64("text"))
        found = rows.join(self.dropped(), ["doc_id", "row"], "left").select("doc_id", "text", "places", lines_of(F.col("text")).alias("lines"))
        # What stays are the runs between places that go, so this takes as long as the text is.
        ends = F.concat(F.array(F.lit(-1)), F.col("places"), F.array(F.size("lines")))
        runs = F.transform(F.arrays_zip(F.slice(ends, 1, F.size(ends) - 1).alias("a"), F.slice(ends, 2, F.size(ends) - 1).alias("b")), lambda e: F.slice(F.col("lines"), e["a"] + 2, e["b"] - e["a"] - 1))
        left = F.when(F.col("places").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(runs), "\n"))
        n_lines, n_dropped = F.size("lines").cast("long"), F.coalesce(F.size("places"), F.lit(0)).cast("long")
        return found.select("doc_id", n_lines.alias("n_lines"), F.when(F.col("places").isNull(), F.lit(0)).otherwise(n_dropped).cast("long").alias("n_dropped"), left.alias("kept"))


def op12_reversible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in two passes, so that the second one meets the filters of the first."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    with workspace(spark) as result:
        index = LineIndex(spark, folder)
        index.insert(docs, passes=2)
        kept = result(index.kept(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")))
    delete(spark, folder)
    return kept


SQL = r"""
    WITH texts AS (SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    lines AS (SELECT doc, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM texts),
    keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
    repeated AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
    told AS (SELECT doc, k.doc_id, pos, line, coalesce(k.doc_id <> first, false) AS goes FROM keyed k LEFT JOIN repeated USING (key))
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
    FROM told GROUP BY doc
"""
