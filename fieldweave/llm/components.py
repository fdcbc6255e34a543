"""Connected components by spreading smallest labels along edges and jumping to labels of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import workspace, written


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node of it) for every node in edges a, b.

    Edges and labels stay distributed; each round is a table in the shared folder, so that the next one is planned
    with its size. Planned over checkpoints, sizes would be products of all earlier ones: their digits double with
    each round, until they fill the driver's memory. Rounds grow with the logarithm of a component's width. Edges
    with a null end, or from a node to itself, are left out.
    """
    with workspace(edges.sparkSession) as result:
        # Each node keeps one edge, to its smallest neighbour, which takes over those to its other smaller
        # neighbours: the same components with about one edge a node.
        down = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), plain=True)
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
        own = F.array(pair("a", "least"), pair("least", "a"), pair("a", "a"), pair("least", "least"))  # each is its own neighbour, too
        taken = F.when(F.col("b") == F.col("least"), own).otherwise(F.concat(own, F.array(pair("b", "least"), pair("least", "b"), pair("b", "b"))))
        both = written(down.join(least, "a").select(F.explode(taken).alias("e")).select("e.a", "e.b").distinct(), plain=True)
        labels = written(both.groupBy("a").agg(F.min("b").alias("label")), plain=True)
        rounds = 0
        while True:
            near = both.join(labels.select(F.col("a").alias("b"), "label"), "b").groupBy("a")
            spread_once = written(near.agg(F.min("label").alias("label"), F.min(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("was")), plain=True)
            if spread_once.where("label <> was").isEmpty():
                return result(spread_once.select(F.col("a").alias("node"), F.col("label").alias("component")), plain=True)
            labels, rounds = spread_once.select("a", "label"), rounds + 1
            if rounds > 1:  # wide components: also take the label of one's label
                jump = labels.select(F.col("a").alias("label"), F.col("label").alias("further"))
                labels = written(labels.join(jump, "label").select("a", F.least("label", "further").alias("label")), plain=True)
