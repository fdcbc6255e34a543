"""A data source over a service that filters: conditions and columns go with the request.

What Spark asks of the rows becomes the request's where text, as far as the service can say it; the rest is left to
Spark. A user who gives a schema gets its columns only. Pages are asked for by tasks, each a share of them.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

#: Gives the rows that the service has for some parameters ($select, $where, $order, $limit, $offset); all that knows the network.
Fetch = Callable[[dict[str, str]], list[dict]]

_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
_SPARK_SWITCH = "spark.sql.python.filterPushdown.enabled"


def literal(value) -> str | None:
    """A value as the service writes it; None if it can't."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, decimal.Decimal)):
        return str(value)
    if isinstance(value, float):
        return repr(value) if value - value == 0 else None
    if isinstance(value, dt.datetime):
        return f"'{value.isoformat(timespec='milliseconds')}'" if value.tzinfo is None else None
    if isinstance(value, dt.date):
        return f"'{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return None


def where_text(condition: ds.Filter) -> str | None:
    """What the condition is in the service's language; None if the service can't say exactly that."""
    if isinstance(condition, ds.Not):
        inner = condition.child
        if isinstance(inner, ds.EqualNullSafe) and inner.value is not None and literal(inner.value) and len(inner.attribute) == 1:
            return f"({inner.attribute[0]} != {literal(inner.value)} or {inner.attribute[0]} is null)"
        told = where_text(inner)
        return told and f"not ({told})"
    if len(condition.attribute) != 1:  # a field of a struct
        return None
    name = condition.attribute[0]
    if isinstance(condition, ds.IsNull):
        return f"{name} is null"
    if isinstance(condition, ds.IsNotNull):
        return f"{name} is not null"
    if isinstance(condition, ds.In):
        told = [literal(v) for v in condition.value if v is not None]  # a null in the list matches no row
        return f"{name} in ({', '.join(told)})" if told and all(told) and len(told) == len(condition.value) else None
    if isinstance(condition, ds.EqualNullSafe) and condition.value is None:
        return f"{name} is null"
    told = literal(condition.value)
    if told is None:
        return None
    if isinstance(condition, ds.EqualNullSafe):
        return f"({name} = {told} and {name} is not null)"
    if type(condition) in _COMPARED:
        return f"{name} {_COMPARED[type(condition)]} {told}"
    if isinstance(condition, ds.StringStartsWith):
        return f"starts_with({name}, {told})"
    if isinstance(condition, ds.StringContains):
        return f"contains({name}, {told})"
    return None


def _valued(kind: T.DataType) -> Callable:
    """Makes a column's value of what stands in JSON, where numbers may be texts."""
    if isinstance(kind, T.StringType):
        return lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if isinstance(kind, T.IntegralType):
        return int
    if isinstance(kind, T.FractionalType):
        return decimal.Decimal if isinstance(kind, T.DecimalType) else float
    if isinstance(kind, T.BooleanType):
        return lambda v: v if isinstance(v, bool) else v.lower() == "true"
    if isinstance(kind, T.DateType):
        return lambda v: dt.date.fromisoformat(v[:10])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime.fromisoformat
    raise TypeError(f"columns of a service can't be of type {kind.simpleString()}")


class Lane(ds.InputPartition):
    """Every so many pages from a first one on."""

    def __init__(self, first: int):
        self.first = first


class ServiceReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType, fetch: Fetch):
        self.fetch, self.where = fetch, []
        self.names = schema.fieldNames()
        self.valued = [_valued(f.dataType) for f in schema.fields]
        self.limit, self.lanes, self.most = (int(options.get(k, d)) for k, d in (("limit", 50_000), ("lanes", 1), ("max_pages", 500)))
        self.order, self.tries, self.wait = options.get("order", ":id"), int(options.get("tries", 3)), float(options.get("wait", 5))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for condition in filters:
            told = where_text(condition)
            if told is None:
                yield condition
            else:
                self.where.append(told)

    def partitions(self) -> list[Lane]:
        return [Lane(i) for i in range(self.lanes)]

    def params(self, page: int) -> dict[str, str]:
        where = {"$where": " and ".join(self.where)} if self.where else {}
        return {"$select": ",".join(self.names), **where, "$order": self.order, "$limit": str(self.limit), "$offset": str(page * self.limit)}

    def read(self, lane: Lane) -> Iterator[tuple]:
        page = lane.first
        while True:
            rows = self._asked(self.params(page))
            if page >= self.most and rows:
                raise ValueError(f"the service has more than {self.most} pages of {self.limit} rows; raise max_pages or limit if that is right")
            for row in rows:
                yield tuple(None if row.get(n) is None else value(row[n]) for n, value in zip(self.names, self.valued))
            if len(rows) < self.limit:
                return
            page += self.lanes

    def _asked(self, params: dict[str, str]) -> list[dict]:
        for number in range(1, self.tries + 1):
            try:
                return self.fetch(params)
            except Exception:
                if number == self.tries:
                    raise
                time.sleep(self.wait * number)
        raise ValueError("tries must be 1 or more")


def register_service(spark: SparkSession, name: str, schema: str, fetch: Fetch) -> None:
    """Make a service known as a format: spark.read.format(name).schema(columns).load().where(...).

    Options: limit (rows a page), lanes (tasks), max_pages (more are an error, so that a service that ignores $offset does not run
    for ever), order (of the pages), tries and wait (seconds before the second try, then twice as many, and so on). Column names are the service's.
    """

    class Service(ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: T.StructType) -> ServiceReader:
            return ServiceReader(self.options, schema, fetch)

    spark.conf.set(_SPARK_SWITCH, "true")
    spark.dataSource.register(Service)
