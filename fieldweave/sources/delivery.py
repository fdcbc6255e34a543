"""Deliveries of rows to a service: one call a row, some at a time, failures kept apart, none sent twice."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from fieldweave.session import place


def accepted(code):
    """Whether an answer's status is a success."""
    return (code >= 200) & (code < 300)


def each(call: Callable[[Any], Any], items: Iterable, at_once: int) -> list[tuple[Any, str | None]]:
    """For each item, in order, what call gives and None, or None and the message of its failure; up to at_once calls run together."""

    def one(item: Any) -> tuple[Any, str | None]:
        try:
            return call(item), None
        except Exception as failed:  # noqa: BLE001  one item must not stop the others
            return None, str(failed)

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, items))


def deliver(rows: DataFrame, key: str, send: Callable[[dict], int], at_once: int = 8) -> DataFrame:
    """key, code and error for each row. send gets the row and gives the status code of the answer; it is
    all that knows the network. A row whose call fails has a message and no code; others are not touched.

    A task makes up to at_once calls together, so send must be safe to call from several threads. Tasks may be
    tried again, so it must also be safe to repeat for a key, and the result should be written before it is looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = each(send, batch.to_dict("records"), at_once)
            out = [(k, code, error) for k, (code, error) in zip(batch[key], told)]
            yield pd.DataFrame(out, columns=[key, "code", "error"]).astype({"code": "Int32"})

    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, code int, error string")


def delivered(answers: DataFrame) -> DataFrame:
    """How many were accepted, refused and failed, in one row."""
    good = F.coalesce(accepted(F.col("code")), F.lit(False))
    return answers.agg(F.count_if(good).alias("n_accepted"), F.count_if(~good & F.col("code").isNotNull()).alias("n_refused"), F.count_if(F.col("code").isNull()).alias("n_failed"))


@dataclass
class Sent(WriterCommitMessage):
    """What a task has sent, and how it was answered."""

    n_accepted: int = 0
    n_refused: int = 0
    n_failed: int = 0


class OutboxWriter(DataSourceWriter):
    """Sends the rows of a task in groups, and writes a file with the answers to each group before the next one is sent.

    A task that is tried again reads the files of its earlier attempts and sends only what they don't have.
    """

    def __init__(self, folder: str, run: str, key: str, kind: pa.DataType, send: Callable[[dict], int], at_once: int, group: int):
        self.folder, self.run, self.key, self.kind, self.send, self.at_once, self.group = folder, run, key, kind, send, at_once, group

    def write(self, rows: Iterator[Row]) -> Sent:
        store, top = pyarrow.fs.FileSystem.from_uri(self.folder)
        own = f"{top}/answers/run={self.run}/part={TaskContext.get().partitionId()}"
        store.create_dir(own, recursive=True)
        answered: dict = {}
        for found in store.get_file_info(pyarrow.fs.FileSelector(own)):
            if found.path.endswith(".parquet"):
                answered |= {r[self.key]: r for r in pyarrow.parquet.read_table(found.path, filesystem=store, partitioning=None).to_pylist()}
        total = Sent()
        for group in iter(lambda: list(islice(rows, self.group)), []):
            told = [answered[r[self.key]] for r in group if r[self.key] in answered]
            still = [r.asDict() for r in group if r[self.key] not in answered]
            new = [{self.key: r[self.key], "code": code, "error": error} for r, (code, error) in zip(still, each(self.send, still, self.at_once))]
            if new:
                schema = pa.schema([(self.key, self.kind), ("code", pa.int32()), ("error", pa.string())])
                name = f"{own}/{uuid.uuid4().hex}"
                pyarrow.parquet.write_table(pa.Table.from_pylist(new, schema), f"{name}.part", filesystem=store)
                store.move(f"{name}.part", f"{name}.parquet")
            for answer in told + new:
                total.n_failed += answer["code"] is None
                total.n_accepted += answer["code"] is not None and accepted(answer["code"])
                total.n_refused += answer["code"] is not None and not accepted(answer["code"])
        return total

    def commit(self, messages: list[Sent | None]) -> None:
        """Once all tasks have ended: their totals, in a file."""
        store, top = pyarrow.fs.FileSystem.from_uri(self.folder)
        store.create_dir(f"{top}/totals", recursive=True)
        told = [m for m in messages if m]
        row = {"run": self.run, **{c: sum(getattr(m, c) for m in told) for c in ("n_accepted", "n_refused", "n_failed")}}
        pyarrow.parquet.write_table(pa.Table.from_pylist([row]), f"{top}/totals/{self.run}.parquet", filesystem=store)

    def abort(self, messages: list[Sent | None]) -> None:
        """What was sent stays recorded, so the next delivery does not send it again."""


class Outbox:
    """What has been delivered, in a folder that all machines share: the answer to each key of each run, and totals of runs.

    Tasks write there themselves, so the folder's store must be one that pyarrow knows (local or shared disks, HDFS, S3). If a task
    dies, what it sent since its last file, a group at most, is sent again. Tasks must not be speculated. Keys are of a Spark type that has one text form.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str = "string"):
        self.spark, self.folder, self.key, self.kind = spark, folder if "://" in folder or folder.startswith("file:") else f"file://{folder}", key, kind

    def _runs(self, what: str, schema: str) -> DataFrame:
        store, path = place(self.spark, f"{self.folder}/{what}")
        if not store.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", what == "totals").option("pathGlobFilter", "*.parquet").parquet(f"{self.folder}/{what}")

    def _answers(self) -> DataFrame:
        return self._runs("answers", f"{self.key} {self.kind}, code int, error string, run string, part int")

    def totals(self) -> DataFrame:
        """run, n_accepted, n_refused and n_failed of each delivery that ended."""
        return self._runs("totals", "run string, n_accepted long, n_refused long, n_failed long")

    def answers(self) -> DataFrame:
        """The last answer to each key, and how often it was sent."""
        last = F.max_by(F.struct("code", "error"), "run").alias("last")
        return self._answers().groupBy(self.key).agg(last, F.count(F.lit(1)).alias("tries")).select(self.key, "last.code", "last.error", "tries")

    def deliver(self, rows: DataFrame, send: Callable[[dict], int], at_once: int = 8, group: int = 256) -> dict[str, int]:
        """Send the rows whose key has not been accepted yet, one of each key; rows with a null key are left out. The totals of this run."""
        done = self._answers().where(accepted(F.col("code"))).select(self.key)
        open_ = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).join(done, self.key, "left_anti")
        before = self._answers().agg(F.max("run")).first()[0]
        run = f"{int(before.split('-')[0]) + 1 if before else 1:09d}-{uuid.uuid4().hex[:8]}"
        kind = pa.int64() if self.kind in ("long", "bigint") else pa.string()
        folder, key, name = self.folder, self.key, f"outbox_{uuid.uuid4().hex}"

        class Delivery(DataSource):
            @classmethod
            def name(cls) -> str:
                return name

            def writer(self, schema, overwrite):
                return OutboxWriter(folder, run, key, kind, send, at_once, group)

        self.spark.dataSource.register(Delivery)
        open_.write.format(name).mode("append").save()
        return self.totals().where(F.col("run") == run).drop("run").first().asDict()
