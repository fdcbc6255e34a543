"""Column builders for missing values, lists and text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_given(*columns: Column | str) -> Column:
    """The first that is neither null nor an empty text."""
    asked = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in asked])


def text_of(column: Column | str) -> Column:
    """Null as an empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def joined(items: Column, separator: str = "; ") -> Column:
    """A list as text; a null list gives an empty text."""
    return F.coalesce(F.array_join(items, separator), F.lit(""))


def json_list(column: Column) -> Column:
    """A list that may come as a JSON array, as plain text, or not at all."""
    parsed = F.from_json(column, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(first_given(column).isNull(), F.array().cast("array<string>")).when(F.ltrim(column).startswith("["), F.coalesce(parsed, F.array(column))).otherwise(F.array(column))


def without_commas(column: Column) -> Column:
    return F.regexp_replace(column, ",", " ")


def split_at_first(column: Column, separator: str = " - ") -> Column:
    """struct(head, tail) at the first separator, trimmed; without one head is null and tail the text as it is."""
    at = F.instr(column, separator)
    head = F.when(at > 0, F.trim(F.substring(column, F.lit(1), at - 1)))
    tail = F.when(at > 0, F.trim(F.substring(column, at + len(separator), F.length(column)))).otherwise(column)
    return F.struct(head.alias("head"), tail.alias("tail"))


def mapped(column: Column, values: Mapping[str, str]) -> Column:
    """Lower-case values looked up; those not listed pass through."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(column)), column)


def leading_int(column: Column, default: int | None = None) -> Column:
    """The integer that a text begins with; the default also replaces 0, as a zero counts as not given."""
    number = F.regexp_extract(column, r"^\s*([+-]?\d+)", 1).try_cast("int")
    return number if default is None else F.coalesce(F.nullif(number, F.lit(0)), F.lit(default))


def plural(count: Column, word: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {word}"), F.when(count > 1, "s").otherwise(""))


def filled(template: Column, values: Mapping[str, Column]) -> Column:
    """A template with each [NAME] replaced; a null value leaves an empty place."""
    for name, value in values.items():
        template = F.replace(template, F.lit(f"[{name}]"), text_of(value.cast("string")))
    return template


def percent_encoded(column: Column) -> Column:
    """Percent-encoding with %20 for spaces."""
    return F.replace(F.url_encode(column), F.lit("+"), F.lit("%20"))


def csv_field(column: Column) -> Column:
    """A field as CSV writes it: quoted only if it holds a comma, a quote or a line break."""
    quoted = F.concat(F.lit('"'), F.replace(column, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(column.rlike('[,"\n]'), quoted).otherwise(column)


def data_answer(data: Column) -> Column:
    """The JSON answer that carries data."""
    return F.to_json(F.struct(data.alias("data")))


def error_answer(message: Column) -> Column:
    """The JSON answer that says what went wrong."""
    return F.to_json(F.struct(message.alias("error")))


def success_answer() -> Column:
    return F.to_json(F.struct(F.lit(True).alias("success")))


def base64_text(column: Column) -> Column:
    """The UTF-8 text that a base64 text holds."""
    return F.decode(F.unbase64(column), "UTF-8")


def to_base64(column: Column) -> Column:
    return F.base64(F.encode(column, "UTF-8"))
