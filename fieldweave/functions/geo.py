"""Column builders for points, boxes and polygons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    south: float
    north: float
    west: float
    east: float


def wkt_point(column: Column) -> Column:
    """struct(lat, lng) of ``POINT (lng lat)``, ``POINT(lng lat)`` or bare ``lng lat``; nulls if it can't be read."""
    text = F.trim(column)
    inside = F.when(text.startswith("POINT"), F.regexp_replace(F.regexp_replace(text, r"^POINT ?\(", ""), r"\)+$", "")).otherwise(text)
    parts = F.split(F.trim(inside), r"\s+")
    lng, lat = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    sound = lat.isNotNull() & lng.isNotNull()
    return F.struct(F.when(sound, lat).alias("lat"), F.when(sound, lng).alias("lng"))


def in_box(lat: Column, lng: Column, box: Box) -> Column:
    """Strictly inside; a missing coordinate is outside."""
    return F.coalesce((lat > box.south) & (lat < box.north) & (lng > box.west) & (lng < box.east), F.lit(False))


def geometry_in_box(geometry: Column, box: Box) -> Column:
    """in_box of a point given as text; one that can't be read is outside."""
    point = wkt_point(geometry)
    return in_box(point["lat"], point["lng"], box)


def in_banded_box(lat: Column, lng: Column, box: Box, band: float, west_above: float, west_below: float) -> Column:
    """Inside the box with another western limit above and up to a latitude; the box's own one is not used. Latitude 0 counts as missing."""
    west = F.when(lat > band, F.lit(west_above)).otherwise(F.lit(west_below))
    inside = (lat != 0) & (lat > box.south) & (lat < box.north) & (lng < box.east) & (lng > west)
    return F.coalesce(inside, F.lit(False))


def in_ring(lng: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is inside a closed ring of [lng, lat] pairs, by counting crossed edges.

    Edges are half open, so a point on a shared border belongs to one side only. The ring may be a
    literal or a column.
    """

    def crossed(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        ax, ay, bx, by = F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(b, F.lit(0)), F.get(b, F.lit(1))
        at = ax + (lat - ay) / F.nullif(by - ay, F.lit(0.0)) * (bx - ax)
        return F.coalesce(((ay > lat) != (by > lat)) & (lng < at), F.lit(False))

    edges = F.when(F.size(ring) > 1, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(edges, F.lit(False), lambda inside, i: inside != crossed(i))


def ring_literal(points: list[tuple[float, float]]) -> Column:
    return F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def largest_ring(rings: Column) -> Column:
    """The outer ring with the most points of an array of rings; of several the first."""
    places = F.transform(rings, lambda ring, i: F.struct(F.size(ring).alias("n"), (-i).alias("first"), ring.alias("ring")))
    return F.array_max(places)["ring"]


def outer_rings(kind: Column, coordinates: Column) -> Column:
    """Outer rings of a Polygon's or MultiPolygon's coordinates (JSON text); other kinds raise."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    several = F.from_json(coordinates, "array<array<array<array<double>>>>")
    wrong = F.raise_error(F.concat(F.lit("unexpected geometry: "), F.coalesce(kind, F.lit("null")))).cast("array<array<array<double>>>")
    return F.when(kind == "Polygon", F.slice(polygon, 1, 1)).when(kind == "MultiPolygon", F.transform(several, lambda p: F.get(p, F.lit(0)))).otherwise(wrong)
