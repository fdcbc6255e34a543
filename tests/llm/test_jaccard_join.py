import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldweave.llm import jaccard_join as join
from fieldweave.llm.common import workspace, written
from fieldweave.llm.components import components
from fieldweave.llm.words import Words


def brute(rows, n=5, threshold=0.8):
    """class and number of links by comparing all pairs."""
    sets = [set(join.shingles(t, Words(), n).tolist()) for _, t in rows]
    label = list(range(len(rows)))
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            equal = rows[i][1] is not None and rows[i][1] == rows[j][1]
            shared = len(sets[i] & sets[j])
            if equal or (shared and shared >= threshold * (len(sets[i]) + len(sets[j]) - shared)):
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    names = {c: min((r[0] for r, x in zip(rows, label) if x == c and r[0] is not None), default=None) for c in set(label)}
    return sorted(str((r[0], names[c], n)) for r, c, n in zip(rows, label, links))


def made(seed, groups=12, copies=6):
    rng = random.Random(seed)
    rows, word = [], lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                text[rng.randrange(len(text))] = word()
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_rows", [500, 3])
def test_against_all_pairs(spark, block_rows):
    rows = made(4) + [(900, None), (901, None), (902, ""), (903, ""), (904, "one two"), (905, "one  two"), (None, made(4)[0][1]), (None, "lonely text without an id here"), (7, "x " * 30000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = join.similar(docs, ["id"], block_rows=block_rows)
    assert sorted(str((r.id, r.class_key.id, r.n_links)) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("block_rows", [500, 7])
def test_chains_are_compared_by_bucket(spark, block_rows):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(600)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 100])) for k in range(50)]  # each like its neighbours, far ones not
    rows += [(200 + k, " ".join(words[:60] + words[k : k + 3])) for k in range(0, 30, 3)] + [(300, rows[5][1])]
    docs = spark.createDataFrame(rows, "id long, text string")
    got = join.similar(docs, ["id"], block_rows=block_rows)
    assert sorted(str((r.id, r.class_key.id, r.n_links)) for r in got.collect()) == brute(rows)


def test_query_against_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(str((r.doc_id, r.class_id, r.n_links)) for r in join.op5_jaccard_join(spark, small).collect()) == brute(rows)


def test_keep_one(spark):
    rows = [(i, t, 1) for i, t in made(9)] + [(0, dict(made(9))[0], 1), (None, "no id", 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    kept = join.keep_one(docs)
    classes = {r.class_id for r in join.near_duplicates(docs).collect()}
    assert kept.columns == docs.columns and kept.count() == len(classes) and {r.doc_id for r in kept.collect()} == classes
    assert join.keep_one(docs.limit(0)).count() == 0


def test_pruning_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    for compared in (25, 50, 125):
        least = join.least_matches(compared, 0.8, 1e-6)
        assert 0 < least < 0.8 * compared and (rng.binomial(compared, 0.8, 20000) >= least).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(5, 5), (70, 71), (71, 70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[n] == 100 for n in range(100, 141)) and all(got[n] == 1 for n in range(1, 60)) and got[71] == 70
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_size_that_components_are_planned_with_stays_small(spark):
    """Planned as a product of all rounds, it had 6,383 bits here, and fills the driver of longer chains."""
    edges = spark.range(1, 500).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    with workspace(spark):
        found = components(edges)
        assert found.agg(F.count("node"), F.max("component")).first() == (500, 0)
        assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20


def test_plain_tables_are_planned_with_what_they_hold(spark):
    frame = spark.range(100_000).select((F.col("id") % 10).alias("a"), F.array(F.struct(F.lit(7).alias("b"), F.lit(8).alias("c"))).alias("d"))
    planned = lambda f: f._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    with workspace(spark):
        assert planned(written(frame, plain=True)) >= 1_600_000 > 10 * planned(written(frame))


def test_words_are_hashed_where_they_stand():
    rng = random.Random(8)
    letters = "ab é日\x1c\x85\xa0\t\n\x0b"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + [None, "", "ab" * 5000]
    import re

    from fieldweave.llm.common import WORD

    codes, counts = Words().of(texts)
    words = [re.findall(WORD, t or "") for t in texts]
    assert counts.tolist() == [len(w) for w in words]
    flat = [w for own in words for w in own]
    assert len(set(zip(flat, codes.tolist()))) == len(set(flat)) == len(set(codes.tolist()))


def test_profiles_of_many_texts_are_those_of_each():
    words, minhash = Words(), join.MinHash(27)
    texts = ["a", "a b c d", "a b c d e", " ".join("abcdefgh" * 20), "ü x\ny  z w v", "a b c d e a b c d e"] * 3 + ["w" * 500_000, "b"]
    sets, signs = join.profiles(texts, words, minhash, 5)
    for text, own, values in zip(texts, sets, signs):
        alone = join.shingles(text, words)
        assert (own == alone).all() and len(own) == len(alone) and (values == minhash.of(alone)).all()
