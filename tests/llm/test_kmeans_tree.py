import numpy as np
from pyspark.sql import functions as F

from fieldweave.llm import kmeans_tree as knn


def exact(ids, vectors, query_ids, k):
    out = {}
    for q in query_ids:
        score = (vectors * vectors[ids == q][0]).sum(axis=1)
        order = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist()) if i != q)[:k]
        out[q] = [i for _, i in order]
    return out


def test_recall_on_embeddings(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    ids, vectors = rows["vec_id"].to_numpy(), knn._matrix(rows["embedding"])
    want = exact(ids, vectors, [i for i in ids.tolist() if i % 20 == 0], 20)
    got = {}
    for r in knn.op9_kmeans_tree(spark, small).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        a, b = vectors[ids == r.query_id][0], vectors[ids == r.vec_id][0]
        assert abs(r.score - float((a * b).sum())) < 1e-12
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 20 * len(want)


def test_equal_vectors_tie_to_smaller_ids_over_cells(spark):
    rng = np.random.default_rng(2)
    data = [(i, [1.0, 2.0, 2.0]) for i in range(300)] + [(1000 + i, (rng.normal(size=3) * 0.3).tolist()) for i in range(200)]
    got = knn.search(spark.createDataFrame(data, "vec_id long, embedding array<float>"), F.col("id") == 40, k=5, cell_rows=50, cell_queries=1)
    assert [(r["rank"], r.vec_id, r.score) for r in got.orderBy("rank").collect()] == [(1, 0, 9.0), (2, 1, 9.0), (3, 2, 9.0), (4, 3, 9.0), (5, 4, 9.0)]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (None, [1.0, 1.0]), (120, [1.0]), (140, [])]
    good = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.9, 0.1]), (3, [0.9, 0.1])]
    kind = "vec_id long, embedding array<double>, score string"
    rows = spark.createDataFrame([(*r, "x") for r in bad + good], kind)
    got = knn.search(rows, F.col("id") % 20 == 0, k=20).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 2), (0, 2, 3), (0, 3, 1)]
    assert knn.search(rows.limit(0), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]


def test_no_query_gets_fewer_than_there_are(spark):
    rng = np.random.default_rng(4)
    crowd = [(i, (np.array([5.0, 5.0, 5.0]) + rng.normal(size=3) * 0.01).tolist()) for i in range(1000, 1400)]
    far = [(i, (np.array([-5.0, 5.0, -5.0]) + rng.normal(size=3)).tolist()) for i in range(12)]  # alone in their leaves
    rows = spark.createDataFrame(crowd + far + [(0, [9.0, 9.0, 9.0])], "vec_id long, embedding array<double>")
    got = knn.search(rows, (F.col("id") % 20 == 0) | (F.col("id") < 12), k=20, recall=0.01)
    assert {r["count"] for r in got.groupBy("query_id").count().collect()} == {20}
    tree = knn.Tree(np.array([v for _, v in crowd + far]), 40)
    sizes = np.bincount(tree.assign(np.array([v for _, v in crowd + far])), minlength=tree.leaves)
    assert sizes[tree.visits(np.array([-5.0, 5.0, -5.0]), 1, sizes, 30)].sum() >= 30


def test_best_bin_first_reaches_every_leaf():
    rng = np.random.default_rng(0)
    points = rng.normal(size=(500, 8))
    tree = knn.Tree(points, 40)
    assert sorted(tree.visits(points[0], 10_000)) == list(range(tree.leaves))
    assert set(tree.assign(points)) <= set(range(tree.leaves)) and len(set(tree.visits(points[1], 5))) == 5


def test_only_visited_leaves_are_scored():
    rng = np.random.default_rng(7)
    points, ids = np.repeat(rng.normal(size=(300, 6)), 2, axis=0), rng.permutation(600)
    leaf = np.repeat(rng.integers(10, 22, 300), 2)
    queries, query_ids = rng.normal(size=(150, 6)), np.concatenate([ids[:75], np.arange(1000, 1075)])
    visited = [rng.choice(np.arange(10, 24), rng.integers(0, 6), replace=False) for _ in queries]
    for q, at, score in knn.best_rows(queries, query_ids, points, ids, 7, leaf, visited):
        seen = np.flatnonzero(np.isin(leaf, visited[q]) & (ids != query_ids[q]))
        want = sorted((-s, i) for s, i in zip((points[seen] * queries[q]).sum(axis=1).tolist(), ids[seen].tolist()))[:7]
        assert sorted(zip((-score).tolist(), ids[at].tolist())) == want
