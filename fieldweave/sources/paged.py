"""A paged JSON source, read at once or as a stream: an input partition for each page, offline over landed page files."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from fieldweave.operators.rows import retried, scan
from fieldweave.sources.delivery import each

Fetch = Callable[[int, int], list[str]]
#: The position in the one row of a page that could not be read.
BROKEN = -1


class Pages(InputPartition):
    """Every so many pages from a first one on, to the last one that may be there."""

    def __init__(self, first: int, step: int, last: int | None):
        self.first, self.step, self.last = first, step, last


class TooManyPages(ValueError):
    """A service gave full pages beyond the cap: it may be ignoring the offset."""


class Asked:
    """Pages of a service: how large they are, how many there may be, and what happens if one can't be read."""

    def __init__(self, options: dict, fetch: Fetch):
        self.fetch = fetch
        self.limit, self.lanes, self.most = (int(options.get(k, d)) for k, d in (("limit", 500), ("lanes", 8), ("max_pages", 500)))
        self.pause = float(options.get("pause", 0))
        self.partial = str(options.get("allow_partial", "false")).lower() == "true"

    def page(self, offset: int, limit: int) -> tuple[list[tuple[int, int, str | None]], bool]:
        """Rows of a page and whether it is full. With allow_partial, a page that can't be read is one row with position -1."""
        if offset >= self.most * self.limit and self.fetch(offset, 1):
            raise TooManyPages(f"there are more than {self.most} pages of {self.limit} records; raise max_pages if that is right")
        try:
            found = self.fetch(offset, limit) if offset < self.most * self.limit else []
        except Exception:
            if not self.partial:
                raise
            return [(offset, BROKEN, None)], False
        if self.pause:
            time.sleep(self.pause)
        return [(offset, i, record) for i, record in enumerate(found)], len(found) >= limit


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Fetch):
        self.asked, self.total = Asked(options, fetch), options.get("total")

    def partitions(self) -> list[Pages]:
        if self.total is None:
            return [Pages(lane, self.asked.lanes, None) for lane in range(self.asked.lanes)]
        pages = -(-int(self.total) // self.asked.limit)
        return [Pages(page, 1, page) for page in range(max(pages, 1))]

    def read(self, part: Pages) -> Iterator[tuple[int, int, str | None]]:
        page = part.first
        while part.last is None or page <= part.last:
            rows, full = self.asked.page(page * self.asked.limit, self.asked.limit)
            yield from rows
            if not full:
                return
            page += part.step


class Slice(InputPartition):
    """Records from an offset on, of one page at most."""

    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


class PagedStream(DataSourceStreamReader):
    """Records by their number: a batch takes those that have come since the last one, each page by a task. The number that was
    reached is kept in the stream's checkpoint, so a stream that starts again goes on behind it."""

    def __init__(self, options: dict, fetch: Fetch):
        self.asked = Asked(options, fetch)
        self.reached = 0

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        """How many records there are: one that is there is looked for twice as far, again and again, and then between."""
        there = lambda n: n == 0 or bool(self.asked.fetch(n - 1, 1))
        low, step = self.reached, 1
        if not there(low):
            return {"records": low}
        most = self.asked.most * self.asked.limit
        while there(low + step):
            low, step = low + step, step * 2
            if low > most:
                raise TooManyPages(f"there are more than {self.asked.most} pages of {self.asked.limit} records; raise max_pages if that is right")
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        if low > most:
            raise TooManyPages(f"there are more than {self.asked.most} pages of {self.asked.limit} records; raise max_pages if that is right")
        self.reached = low
        return {"records": low}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        limit = self.asked.limit
        return [Slice(n, min(limit, end["records"] - n)) for n in range(start["records"], end["records"], limit)]

    def read(self, part: Slice) -> Iterator[tuple[int, int, str | None]]:
        rows, full = self.asked.page(part.offset, part.size)
        if not full and not (self.asked.partial and rows and rows[0][1] == BROKEN):
            raise OSError(f"of records {part.offset} to {part.offset + part.size - 1} only {len(rows)} were given")
        return iter(rows)

    def commit(self, end: dict) -> None:
        self.reached = max(self.reached, end["records"])


def paged_source(name: str, fetch: Fetch) -> type[DataSource]:
    """A data source of that name to register with spark.dataSource; fetch(offset, limit) gives JSON texts.

    Options: limit (records a page), total (records there are: a task for each page), max_pages (500; more are an error, so a service
    that ignores the offset does not run for ever), pause (seconds after each page of a task) and allow_partial. Without a total, pages are dealt to
    ``lanes`` tasks in turn, and each goes on until one of its pages is short, so all is read however much there is.

    fetch is all that knows the network. Its failure fails the task and is retried by Spark; a page that can't be read then
    fails the load, so no part of it is taken for the whole. With allow_partial it is a mark instead, and
    until_short gives the pages before the first such mark. As a stream (readStream) each batch has the records that came since the last one;
    there, a page that can't be read is left out with allow_partial, and its mark says so.
    """

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "offset int, position int, record string"

        def reader(self, schema):
            return PagedReader(self.options, fetch)

        def streamReader(self, schema):
            return PagedStream(self.options, fetch)

    return Paged


def until_short(pages: DataFrame, limit: int) -> DataFrame:
    """Records of pages up to the first that is short by its raw count or could not be read, as a reader that stops there would have them."""
    sizes = pages.groupBy("offset").agg(F.count_if(F.col("position") > BROKEN).alias("n"))
    stop = sizes.agg(F.min(F.when(F.col("n") < limit, F.col("offset")))).scalar()
    return pages.where((stop.isNull() | (F.col("offset") <= stop)) & (F.col("position") > BROKEN))


def broken_pages(pages: DataFrame) -> DataFrame:
    """Offsets of the pages that could not be read (see allow_partial)."""
    return pages.where(F.col("position") == BROKEN).select("offset")


def lookup_each(keys: DataFrame, key: str, fetch_one: Callable[[str], dict | None], schema: str, at_once: int = 8) -> DataFrame:
    """A row for each key from a lookup; a key whose lookup fails gives nulls and a message, others are not touched.

    A task makes up to at_once lookups together, so fetch_one must be safe to call from several threads.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            told = each(lambda k: {**(fetch_one(k) or {})}, batch[key], at_once)
            yield pd.DataFrame([{key: k, **(found or {}), "error": error} for k, (found, error) in zip(batch[key], told)], columns=names)

    names = [key, *[p.split()[0] for p in schema.split(",")], "error"]
    return keys.select(key).distinct().mapInPandas(run, f"{key} {dict(keys.dtypes)[key]}, {schema}, error string")


def where_clause(conditions: dict[str, str | int]) -> str:
    """Equalities joined by AND, texts quoted, for a remote service that filters."""
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return " AND ".join(f"{k}={quoted(v)}" for k, v in conditions.items())


def read_filtered(spark: SparkSession, path: str, schema: str, *predicates: Callable[[DataFrame], Column], tries: int = 3, wait: float = 5.0) -> DataFrame:
    """Landed JSON records for which all predicates hold, which are pushed down to the scan; what can't be read is tried again."""
    return retried(lambda: scan(spark.read.schema(schema).json(path), *predicates), tries, wait)


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages, one file a page, one JSON object a line, as raw records with their file."""
    return spark.read.text(folder).select(F.input_file_name().alias("page"), F.col("value").alias("record"))
