"""Points and many rings: which point is in which ring, by cells of a grid.

Each ring marks the cells that its edges touch as border, and the runs of cells between them, row by row, as inside or outside by
one point of the run. Points meet the marks of their own cell only (an equi-join). What is in an inside cell needs no
further look; edges are counted for points in border cells alone. The result is that of in_ring for all pairs, whatever the size of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.functions.geo import in_ring


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def border_cells(rings: DataFrame, ring_id: str, ring: str, size: float) -> DataFrame:
    """ring_id, cx and cy of the cells that a ring's edges touch (some that they nearly touch, too)."""
    at = lambda point, i: F.get(F.get(F.col(ring), point), F.lit(i))
    steps = F.when(F.size(ring) > 1, F.sequence(F.lit(0), F.size(ring) - 2))
    edges = rings.select(ring_id, ring, F.explode(steps).alias("i")).select(ring_id, at(F.col("i"), 0).alias("ax"), at(F.col("i"), 1).alias("ay"), at(F.col("i") + 1, 0).alias("bx"), at(F.col("i") + 1, 1).alias("by"))
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = edges.where("ax + ay + bx + by IS NOT NULL").withColumn("cy", F.explode(F.sequence(_cell(low, size), _cell(high, size))))
    # Where the edge enters and leaves the row of cells; a level edge is in it from end to end.
    x_at = lambda y: F.col("ax") + (y - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) * (F.col("bx") - F.col("ax"))
    one = F.coalesce(x_at(F.greatest(low, F.col("cy") * size)), F.col("ax"))
    two = F.coalesce(x_at(F.least(high, (F.col("cy") + 1) * size)), F.col("bx"))
    slack = size * 1e-6
    spans = rows.select(ring_id, "cy", _cell(F.least(one, two) - slack, size).alias("from"), _cell(F.greatest(one, two) + slack, size).alias("to"))
    return spans.select(ring_id, "cy", F.explode(F.sequence("from", "to")).alias("cx")).distinct()


def ring_cells(rings: DataFrame, ring_id: str, ring: str, size: float) -> DataFrame:
    """ring_id, cx, cy and border of the cells that are inside a ring or on its border."""
    border = border_cells(rings, ring_id, ring, size)
    after = F.lead("cx").over(Window.partitionBy(ring_id, "cy").orderBy("cx"))
    runs = border.withColumn("next", after).where("next > cx + 1").join(rings.select(ring_id, ring), ring_id)
    middle = lambda c: (F.col(c) + 0.5) * F.lit(float(size))
    within = runs.where(in_ring(middle("cx") + F.lit(float(size)), middle("cy"), F.col(ring)))
    inside = within.select(ring_id, "cy", F.explode(F.sequence(F.col("cx") + 1, F.col("next") - 1)).alias("cx"))
    return border.select(ring_id, "cx", "cy", F.lit(True).alias("border")).union(inside.select(ring_id, "cx", "cy", F.lit(False)))


def points_in_rings(points: DataFrame, rings: DataFrame, size: float, ring_id: str = "ring_id", ring: str = "ring", lng: str = "lng", lat: str = "lat") -> DataFrame:
    """points with the ring_id of each ring that they are in, a row for each pair. Points without coordinates are in none.

    A cell of a tenth of a usual ring's width or so is good: smaller ones make more cells, larger ones leave more points to the edges.
    """
    cells = ring_cells(rings, ring_id, ring, size)
    placed = points.where(F.col(lng).isNotNull() & F.col(lat).isNotNull()).withColumns({"cx": _cell(F.col(lng), size), "cy": _cell(F.col(lat), size)})
    met = placed.join(cells, ["cx", "cy"]).drop("cx", "cy")
    sure = met.where("NOT border").drop("border")
    looked = met.where("border").drop("border").join(rings.select(ring_id, F.col(ring).alias("__ring")), ring_id)
    return sure.unionByName(looked.where(in_ring(F.col(lng), F.col(lat), F.col("__ring"))).drop("__ring"))
