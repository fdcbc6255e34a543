"""The grid against the edge test for every pair of a point and a ring."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldweave.functions.geo import in_ring
from fieldweave.operators.rings import points_in_rings

RINGS = [
    ("square", [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]),
    ("beside", [[1, 0], [2, 0], [2, 1], [1, 1], [1, 0]]),
    ("notched", [[-3, -3], [3, -3], [3, 3], [0, -2.5], [-3, 3], [-3, -3]]),
    ("thin", [[-4, 0.501], [4, 0.502], [4, 0.503], [-4, 0.501]]),
    ("small", [[0.31, 0.31], [0.32, 0.31], [0.32, 0.32], [0.31, 0.31]]),
    ("round", [[2 * math.cos(i / 20 * math.pi), 1.5 * math.sin(i / 20 * math.pi)] for i in range(40)] + [[2, 0]]),
    ("none", []),
    ("point", [[1, 1]]),
    ("missing", None),
]


@pytest.mark.parametrize("size", [0.07, 0.25, 1.0, 50.0])
def test_same_as_all_pairs(spark, size):
    rng = random.Random(7)
    spots = [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(400)] + [(x / 4, y / 4) for x in range(-8, 9) for y in range(-8, 9)] + [(None, 1.0), (1.0, None)] + [(0.5, 0.5)] * 50
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots)], "id int, lng double, lat double")
    rings = spark.createDataFrame([(n, r and [[float(v) for v in p] for p in r]) for n, r in RINGS], "ring_id string, ring array<array<double>>")
    got = sorted((r.id, r.ring_id) for r in points_in_rings(points, rings, size).collect())
    pairs = points.crossJoin(rings).where("lng IS NOT NULL AND lat IS NOT NULL AND ring IS NOT NULL").where(in_ring(F.col("lng"), F.col("lat"), F.col("ring")))
    assert got == sorted((r.id, r.ring_id) for r in pairs.collect()) and len(got) > 500


def test_no_nested_loop(spark):
    points = spark.range(10).selectExpr("id", "id / 3.0D AS lng", "id / 5.0D AS lat")
    rings = spark.range(5).selectExpr("id AS ring_id", "array(array(0D, 0D), array(id + 1D, 0D), array(0D, 1D), array(0D, 0D)) AS ring")
    plan = points_in_rings(points, rings, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert points_in_rings(points, rings.limit(0), 0.5).count() == points_in_rings(points.limit(0), rings, 0.5).count() == 0
