"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

A tree is fitted to a bounded sample of the vectors (``sample_rows``) and sent to the tasks; every
vector is put into a leaf by going down to the nearest centre. A query walks the tree through a
priority queue that always opens the node whose centre has the largest inner product with it, and
visits leaves in that order. How many it visits is calibrated: for a bounded sample of the queries
(``calibration_queries``) the exact neighbours among all vectors are found in blocks, and visits are
widened until the wanted share of those neighbours lies in visited leaves. A query goes on beyond that number
until the leaves it has visited hold k other vectors, so none gets fewer while there are more.

Vectors and queries meet in cells: a group of neighbouring leaves, dealt into parts by its number of
rows and into parts by its number of queries, so that no cell outgrows a task however common a vector
is. In a cell only rows of leaves that a query visits are scored for it. A cell returns each query's best rows; a window keeps the best of all.

Nearness is the inner product in double precision on the vectors as given; a candidate's score is
summed in one fixed order, so equal vectors tie exactly, and ties go to the smaller id. Rows whose
vector is null, zero, of another length than most, or holds null or non-finite components, and rows
without an id take no part. Repeated rows are candidates each; a repeated query counts once (of several vectors of one id the first in array order is asked for). An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import cut, spread, table

_BLOCK = 2048
_TOGETHER = 64  # queries scored at once


class Tree:
    """Centres by node; leaves are numbered from left to right."""

    def __init__(self, points: np.ndarray, leaves: int, branch: int = 8, seed: int = 5):
        self.rng, self.branch = np.random.default_rng(seed), branch
        self.centres: list[np.ndarray] = []  # of the children of each inner node
        self.children: list[list[int]] = []  # an inner node, or -1 - leaf
        self.leaves = 0
        self.root = self._grow(np.unique(points, axis=0), leaves)

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        if leaves <= 1 or len(points) <= 1:
            self.leaves += 1
            return -self.leaves
        centres, member = self._split(points, min(self.branch, leaves, len(points)))
        if len(centres) == 1:
            self.leaves += 1
            return -self.leaves
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        for k in range(len(centres)):
            own = points[member == k]
            self.children[node].append(self._grow(own, round(leaves * len(own) / len(points))))
        return node

    def _split(self, points: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
        centres = points[self.rng.choice(len(points), k, replace=False)]
        member = np.zeros(len(points), dtype=int)
        for _ in range(rounds):
            member = nearest(points, centres)
            kept = np.unique(member)
            centres = np.array([points[member == i].mean(axis=0) for i in kept])
        member = nearest(points, centres)
        kept, member = np.unique(member, return_inverse=True)
        return centres[kept], member

    def assign(self, points: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(points), dtype=np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = -1 - node
            elif len(rows):
                member = nearest(points[rows], self.centres[node])
                todo += [(child, rows[member == k]) for k, child in enumerate(self.children[node])]
        return leaf

    def visits(self, query: np.ndarray, most: int, sizes: np.ndarray | None = None, least: int = 0) -> list[int]:
        """The first leaves in best-bin-first order: so many, and more until they hold at least so many vectors."""
        queue, out = [(0.0, 0, self.root)], []
        pushed, seen = 0, 0
        while queue and (len(out) < most or seen < least):
            _, _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                seen += int(sizes[-1 - node]) if sizes is not None else 0
                continue
            for near, child in zip((self.centres[node] @ query).tolist(), self.children[node]):
                pushed += 1
                heapq.heappush(queue, (-near, pushed, child))
        return out


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(points[i : i + _BLOCK] @ centres.T - half).argmax(axis=1) for i in range(0, len(points), _BLOCK)] or [np.zeros(0, dtype=int)])


def best_rows(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, leaf: np.ndarray | None = None, visited: list[np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its number, the places of its k best points (ties to smaller ids, own id left out) and their scores.

    With leaf (of each point) and visited (leaves, by query) only points of visited leaves are scored.
    """
    leaf = np.zeros(len(ids), dtype=np.int32) if leaf is None else leaf
    order = np.lexsort((ids, leaf))
    points, ids = points[order], ids[order]
    names, first = np.unique(leaf[order], return_index=True)
    ranges = list(zip(first.tolist(), [*first[1:].tolist(), len(ids)]))
    parts = [np.unique(points[a:b], axis=0, return_inverse=True) for a, b in ranges]  # equal vectors get equal scores
    sees = np.ones((len(queries), len(names)), dtype=bool)
    if visited is not None:
        for q, own in enumerate(visited):
            sees[q] = np.isin(names, own)
    for begin in range(0, len(queries), _TOGETHER):
        some = slice(begin, begin + _TOGETHER)
        scores = np.full((len(queries[some]), len(ids)), -np.inf)
        for n, ((a, b), (distinct, same)) in enumerate(zip(ranges, parts)):
            rows = np.flatnonzero(sees[some, n])
            if len(rows):
                scores[rows, a:b] = (queries[begin + rows] @ distinct.T)[:, same.reshape(-1)]
        for q, score in enumerate(scores, begin):
            score[ids == query_ids[q]] = -np.inf
            if len(score) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                above, level = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
                take = np.concatenate([above, level[np.argsort(ids[level], kind="stable")[: k - len(above)]]])
            else:
                take = np.arange(len(score))
            take = take[score[take] > -np.inf]
            yield q, order[take], (points[take] * queries[q]).sum(axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def sound(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id and v of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = rows.select(F.col(id_column).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    usual = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return kept.where(F.size("v") == (usual.d if usual else -1))


def search(rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", sample_rows: int = 32_768, calibration_queries: int = 256, recall: float = 0.97, most_leaves: int = 4096, cell_rows: int = 8192, cell_queries: int = 4096) -> DataFrame:
    """query_id, rank, id_column and score of each query's k nearest found. is_query is a condition on the column ``id``."""
    spark = rows.sparkSession
    vectors = sound(rows, id_column, vector_column)
    count = vectors.count()
    out = f"query_id long, {id_column} long, score double"
    if not count:
        return spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score double")
    share = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / count))
    sample = vectors.where(share).select("v").limit(2 * sample_rows).toPandas() if count > 2 * sample_rows else vectors.select("v").toPandas()
    tree = spark.sparkContext.broadcast(Tree(_matrix(sample["v"]), leaves=int(min(most_leaves, max(8, count**0.5), max(8, len(sample) // 16)))))
    leaves = tree.value.leaves

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(leaf=tree.value.assign(_matrix(batch["v"])))

    placed = cut(spread(vectors).mapInPandas(assign, "id long, v array<double>, leaf int"))
    asked = placed.where(is_query).groupBy("id").agg(F.min("v").alias("v"))

    # Calibration: exact neighbours of a bounded number of queries, found in blocks of all vectors.
    probes = asked.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(calibration_queries).toPandas()
    probe_ids, probe_vectors = probes["id"].to_numpy(), _matrix(probes["v"]) if len(probes) else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast((probe_ids, probe_vectors))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, points = shared.value
        for batch in batches:
            own, leaf = batch["id"].to_numpy(), batch["leaf"].to_numpy()
            found = [pd.DataFrame({"query_id": ids[q], "id": own[at], "leaf": leaf[at], "score": score}) for q, at, score in best_rows(points, ids, _matrix(batch["v"]), own, k)]
            if found:
                yield pd.concat(found)

    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    truth = placed.mapInPandas(exact, "query_id long, id long, leaf int, score double").withColumn("n", F.row_number().over(nearest_first)).where(F.col("n") <= k).select("query_id", "leaf").toPandas()
    place = {i: {leaf: n for n, leaf in enumerate(tree.value.visits(v, leaves))} for i, v in zip(probe_ids.tolist(), probe_vectors)}
    needed = np.sort([place[q][leaf] + 1 for q, leaf in zip(truth["query_id"], truth["leaf"])])
    most = int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else leaves

    sizes = np.zeros(leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").agg(F.count_distinct("id").alias("n")).collect():  # a row a leaf
        sizes[r.leaf] = r.n

    # Cells: groups of leaves by parts of rows and parts of queries; these tables have a row a group at most.
    together = max(1, leaves // 32)
    groups = -(-leaves // together)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = []
            for i, v in zip(batch["id"], batch["v"]):
                by_group: dict[int, list[int]] = {}
                for leaf in tree.value.visits(np.asarray(v), most, sizes, k + 1):
                    by_group.setdefault(leaf // together, []).append(leaf)
                own += [(i, v, g, ls) for g, ls in by_group.items()]
            yield pd.DataFrame(own, columns=["id", "v", "grp", "leaves"])

    walks = cut(asked.mapInPandas(walk, "id long, v array<double>, grp int, leaves array<int>"))
    placed = placed.withColumn("grp", F.floor(F.col("leaf") / together).cast("int"))
    parts = {r.grp: -(-r["count"] // cell_rows) for r in placed.groupBy("grp").count().collect()}
    query_parts = {r.grp: -(-r["count"] // cell_queries) for r in walks.groupBy("grp").count().collect()}
    number = lambda of: F.element_at(F.array(*[F.lit(int(of.get(g, 1))) for g in range(groups)]), F.col("grp") + 1)
    every = lambda of: F.explode(F.sequence(F.lit(0), number(of) - 1))
    dealt = lambda of, seed: F.pmod(F.xxhash64("id", F.lit(seed)), number(of)).cast("int")
    left = walks.withColumn("query_part", dealt(query_parts, 21)).withColumn("part", every(parts))
    right = placed.withColumn("part", dealt(parts, 22)).withColumn("query_part", every(query_parts))

    def meet(queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(points):
            return pd.DataFrame({"query_id": [], id_column: [], "score": []})
        ids, query_ids = points["id"].to_numpy(), queries["id"].to_numpy()
        best = best_rows(_matrix(queries["v"]), query_ids, _matrix(points["v"]), ids, k, points["leaf"].to_numpy(), queries["leaves"].tolist())
        found = [pd.DataFrame({"query_id": query_ids[q], id_column: ids[at], "score": score}) for q, at, score in best]
        return pd.concat(found)

    cell = ["grp", "part", "query_part"]
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(meet, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_column)
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id_column, "score")


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
