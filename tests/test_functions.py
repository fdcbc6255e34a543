import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldweave.functions import dates, geo, values


def one(spark, column, **given):
    kinds = {str: "string", int: "bigint", float: "double", bool: "boolean", dt.date: "date", list: "array<string>"}
    frame = spark.range(1)
    for name, (value, kind) in given.items():
        frame = frame.withColumn(name, F.lit(value).cast(kind) if not isinstance(value, list) else F.array(*map(F.lit, value)))
    return frame.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, zone, day",
    [
        (None, "UTC", ""), ("", "UTC", ""), ("0", "UTC", ""), ("1776655119560", "UTC", "2026-04-20"), ("1776655119560", "America/New_York", "2026-04-19"),
        ("2026-04-20T10:00:00.000Z", "America/New_York", "2026-04-20"), ("2026-04-20", "UTC", "2026-04-20"),
    ],
)
def test_day_of(spark, text, zone, day):
    assert one(spark, dates.day_of(F.col("t"), zone), t=(text, "string")) == day


@pytest.mark.parametrize("days, label", [(0, "Today"), (1, "Tomorrow"), (-1, "Yesterday"), (-2, "2 days overdue"), (14, "In 14 days"), (15, "Jun 30, 1998"), (None, "TBD")])
def test_due_label(spark, days, label):
    today = dt.date(1998, 6, 15)
    due = None if days is None else str(today + dt.timedelta(days))
    assert one(spark, dates.due_label(F.col("d"), today), d=(due, "date")) == label


@pytest.mark.parametrize(
    "text, clock",
    [("2:30pm", "14:30:00"), ("12am", "00:00:00"), ("12 PM", "12:00:00"), ("14", "14:00:00"), ("2 - 4pm", "02:00:00"), ("2Pm", "02:00:00"), ("99", "99:00:00"), ("TBD", None), ("", None), (None, None)],
)
def test_clock(spark, text, clock):
    assert one(spark, dates.clock(F.col("t")), t=(text, "string")) == clock


def test_moment_is_in_the_zone(spark):
    at = dates.iso_utc(dates.moment(F.col("d"), F.col("t"), "America/New_York"))
    assert one(spark, at, d=("2026-04-20", "string"), t=("2pm", "string")) == "2026-04-20T18:00:00Z"
    assert one(spark, at, d=("2026-01-20", "string"), t=(None, "string")) == "2026-01-20T17:00:00Z"
    assert one(spark, at, d=("2026-01-20", "string"), t=("99", "string")) is None


@pytest.mark.parametrize("text, number", [("20 people", 20), ("0", 50), ("abc", 50), (None, 50), (" -3x", -3)])
def test_leading_int(spark, text, number):
    assert one(spark, values.leading_int(F.col("t"), 50), t=(text, "string")) == number


@pytest.mark.parametrize("text, items", [('["a","b"]', ["a", "b"]), ("plain", ["plain"]), ("[broken", ["[broken"]), ("", []), (None, [])])
def test_json_list(spark, text, items):
    assert one(spark, values.json_list(F.col("t")), t=(text, "string")) == items


@pytest.mark.parametrize("text, head, tail", [("Genus species - Common", "Genus species", "Common"), ("a - b - c", "a", "b - c"), ("none", None, "none"), (None, None, None)])
def test_split_at_first(spark, text, head, tail):
    got = one(spark, values.split_at_first(F.col("t")), t=(text, "string"))
    assert (got.head, got.tail) == (head, tail)


def test_text_helpers(spark):
    assert one(spark, values.mapped(F.col("t"), {"dead": "Poor"}), t=("DEAD", "string")) == "Poor"
    assert one(spark, values.mapped(F.col("t"), {"dead": "Poor"}), t=("Other", "string")) == "Other"
    assert one(spark, values.mapped(F.col("t"), {"dead": "Poor"}), t=(None, "string")) is None
    assert one(spark, values.csv_field(F.col("t")), t=('a,"b"', "string")) == '"a,""b"""'
    assert one(spark, values.csv_field(F.col("t")), t=("plain", "string")) == "plain"
    assert one(spark, values.percent_encoded(F.col("t")), t=("a b&c", "string")) == "a%20b%26c"
    assert one(spark, values.base64_text(values.to_base64(F.col("t"))), t=("naïve", "string")) == "naïve"
    assert one(spark, values.filled(F.lit("Hi [A], [B]"), {"A": F.col("t"), "B": F.lit(None).cast("string")}), t=("x", "string")) == "Hi x, "
    assert one(spark, values.plural(F.col("n"), "task"), n=(1, "int")) == "1 task"
    assert one(spark, values.plural(F.col("n"), "task"), n=(2, "int")) == "2 tasks"
    assert one(spark, values.joined(F.col("t")), t=(None, "array<string>")) == ""


@pytest.mark.parametrize(
    "text, point",
    [("POINT (-73.98 40.72)", (40.72, -73.98)), ("POINT(-73.98 40.72)", (40.72, -73.98)), ("-73.98 40.72", (40.72, -73.98)), ("point (-73.98 40.72)", (None, None)), ("", (None, None)), ("x y", (None, None)), (None, (None, None))],
)
def test_wkt_point(spark, text, point):
    got = one(spark, geo.wkt_point(F.col("t")), t=(text, "string"))
    assert (got.lat, got.lng) == point


@pytest.mark.parametrize("lat, lng, inside", [(40.728, -74.0, True), (40.7281, -74.0, False), (40.7281, -73.99, True), (0.0, -73.99, False), (None, -73.99, False), (40.70, -73.99, False), (40.72, -73.97, False)])
def test_banded_box(spark, lat, lng, inside):
    box = geo.Box(40.70, 40.74, -80.0, -73.97)
    assert one(spark, geo.in_banded_box(F.col("lat"), F.col("lng"), box, 40.728, -73.993, -74.003), lat=(lat, "double"), lng=(lng, "double")) is inside


def test_box_is_strict(spark):
    box = geo.Box(0, 1, 0, 1)
    assert one(spark, geo.in_box(F.lit(0.5), F.lit(0.5), box)) is True
    assert one(spark, geo.in_box(F.lit(0.0), F.lit(0.5), box)) is False
    assert one(spark, geo.in_box(F.lit(None).cast("double"), F.lit(0.5), box)) is False


def test_ring_and_largest_ring(spark):
    square = geo.ring_literal([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)])
    assert one(spark, geo.in_ring(F.lit(1.0), F.lit(1.0), square)) is True
    assert one(spark, geo.in_ring(F.lit(2.0), F.lit(3.0), square)) is False
    assert one(spark, geo.in_ring(F.lit(5.0), F.lit(1.0), square)) is False
    assert one(spark, geo.in_ring(F.lit(5.0), F.lit(1.0), F.expr("cast(array() as array<array<double>>)"))) is False
    several = '[[[[0,0],[1,0],[0,0]]],[[[5,5],[6,5],[5,5]]]]'
    assert one(spark, geo.largest_ring(geo.outer_rings(F.lit("MultiPolygon"), F.lit(several))))[0] == [0.0, 0.0]  # of equal ones the first
    holed = "[[[0,0],[9,0],[9,9],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]"
    assert len(one(spark, geo.largest_ring(geo.outer_rings(F.lit("Polygon"), F.lit(holed))))) == 4  # a hole is no outer ring
    with pytest.raises(Exception, match="unexpected geometry"):
        one(spark, geo.largest_ring(geo.outer_rings(F.lit("Point"), F.lit("[1,2]"))))
