"""Choosing, renaming and limiting rows and columns."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def given(frame: DataFrame, column: str) -> Column:
    """The column is not null and, if it is text, not empty."""
    there = F.col(column).isNotNull()
    return there & (F.col(column) != "") if dict(frame.dtypes)[column] == "string" else there


def normalised_names(frame: DataFrame) -> DataFrame:
    """Column names without a byte order mark, trimmed, in lower case, with _ for spaces."""
    return frame.toDF(*[c.lstrip("﻿").strip().lower().replace(" ", "_") for c in frame.columns])


def renamed(frame: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed by the map, others as they are. Of several that get one name the last in order is kept, at the place of the first."""
    source: dict[str, str] = {}
    for column in frame.columns:
        source[names.get(column, column)] = column
    return frame.select(*[F.col(f"`{old}`").alias(new) for new, old in source.items()])


def missing_columns(frame: DataFrame, required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(frame.columns))


def require_columns(frame: DataFrame, required: Iterable[str]) -> DataFrame:
    """The frame, if its schema has the columns; else an error that names those missing."""
    if missing := missing_columns(frame, required):
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(sorted(frame.columns))}")
    return frame


def in_list(frame: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose column is one of the values; all rows if there is no such column."""
    return frame.where(F.col(column).isin(*values)) if column in frame.columns else frame


def page(frame: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """Rows by offset. Limit and offset rows come together in one task, so deep pages are for page_after."""
    return frame.orderBy(*order).offset(offset).limit(limit)


def page_after(frame: DataFrame, key: str, limit: int, after=None) -> DataFrame:
    """The next rows in order of a key that tells them apart, after the last one that was seen: as cheap for the last page as for the first."""
    return (frame if after is None else frame.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)


def scan(frame: DataFrame, *predicates: Callable[[DataFrame], Column]) -> DataFrame:
    """The frame's rows for which all predicates hold; what they say of columns reaches the scan."""
    return reduce(lambda rows, holds: rows.where(holds(rows)), predicates, frame)


def filter_counts(frame: DataFrame, keys: Sequence[Column | str], condition: Column) -> DataFrame:
    """keys and how many rows there are before and after a filter."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_before"), F.count_if(condition).alias("n_after"))


def counted(frame: DataFrame, condition: Column) -> tuple[DataFrame, Observation]:
    """The filtered rows, and an observation of n_before and n_after that is filled when they are first used."""
    seen = Observation()
    return frame.observe(seen, F.count(F.lit(1)).alias("n_before"), F.count_if(condition).alias("n_after")).where(condition), seen


def numeric_order(key: str) -> list[Column]:
    """By the number that a key's text is, 9 before 10; others follow by their characters."""
    return [F.col(key).try_cast("bigint").asc_nulls_last(), F.col(key)]


def key_pages(frame: DataFrame, key: str, pages: int) -> list[DataFrame]:
    """The whole frame as pages of equal ranges of a whole-numbered key; rows without a key are on the first page."""
    low, high = frame.agg(F.min(key), F.max(key)).first()
    if low is None:
        return [frame]
    bounds = [low + (high - low) * i // pages for i in range(1, pages)]
    column = F.col(key)
    inside = [(column > a if a is not None else F.lit(True)) & (column <= b if b is not None else F.lit(True)) for a, b in zip([None, *bounds], [*bounds, None])]
    return [frame.where(inside[0] | column.isNull()), *[frame.where(c) for c in inside[1:]]]


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """All rows of all pages, matched by name; columns that a page lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


READ_ERRORS = (OSError, PySparkException, Py4JJavaError)


def retried(source: Callable[[], DataFrame], tries: int = 3, wait: float = 5.0, worth: Callable[[Exception], bool] = lambda _: True) -> DataFrame:
    """The source's frame; if it can't be read it is asked again, after ``wait`` seconds, then twice as many, and so on.

    A failure that is not ``worth`` another try is raised at once.
    """
    for number in range(1, tries + 1):
        try:
            return source()
        except READ_ERRORS as failed:
            if number == tries or not worth(failed):
                raise
            time.sleep(wait * number)
    raise ValueError("tries must be 1 or more")


def first_nonempty(sources: Sequence[Callable[[], DataFrame]], accept: Callable[[DataFrame], bool] = lambda _: True) -> DataFrame | None:
    """The first source that can be read, is accepted and has a row; later ones are not touched. None if there is none."""
    for source in sources:
        try:
            frame = source()
            if accept(frame) and not frame.isEmpty():
                return frame
        except READ_ERRORS as failed:  # such a source counts as empty
            print(f"source failed, trying the next: {str(failed).splitlines()[0]}")
    return None


def first_nonempty_filter(frame: DataFrame, filters: Sequence[Column]) -> DataFrame:
    """Rows of the first filter that keeps any, in one plan: which one that is comes from a scalar subquery over the filters' counts."""
    matched = frame.agg(*[F.count_if(f).alias(f"f{i}") for i, f in enumerate(filters)])
    chosen = matched.select(F.coalesce(*[F.when(F.col(f"f{i}") > 0, F.lit(i)) for i in range(len(filters))])).scalar()
    return frame.where(reduce(lambda a, b: a | b, [(chosen == i) & f for i, f in enumerate(filters)]))


def snapshot_order(date: str = "date", key: str = "id") -> list[Column]:
    """By date text (missing ones first, as 0000-00-00), then id text; both by characters, so that 10 comes before 9."""
    return [F.coalesce(F.nullif(F.col(date), F.lit("")), F.lit("0000-00-00")), F.col(key)]


def kept_once(frame: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "first") -> DataFrame:
    """One row for each key: the first or the last in the order. Keys that are null or empty are left out.

    Spark cuts to the first row of each key before the shuffle, too, so a key with very many rows sends one row a task.
    """
    if keep not in ("first", "last"):
        raise ValueError(keep)
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(by if keep == "first" else [o.desc() for o in by])))
    there = frame.where(reduce(lambda a, b: a & b, [given(frame, k) for k in keys]))
    return there.withColumn("__place", place).where("__place = 1").drop("__place")


def argmax_first(frame: DataFrame, keys: Sequence[str], value: Column, tie: Column, returned: Mapping[str, Column]) -> DataFrame:
    """For each key what the row with the largest value has; of equal values the row with the smallest tie."""
    chosen = F.min_by(F.struct(*[c.alias(n) for n, c in returned.items()]), F.struct((-value).alias("v"), tie.alias("t")))
    return frame.groupBy(*keys).agg(chosen.alias("__row")).select(*keys, "__row.*")
