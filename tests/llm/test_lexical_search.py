"""Term pipeline against a plain ranking in Python."""

import math
import random
import re
from collections import Counter

import pytest

from fieldweave.llm import lexical_search as search

_LOWER = str.maketrans(search._UPPER, search._LOWER)


def split(text):
    return re.findall(search.TERM, (text or "").translate(_LOWER))


def brute(docs, items, top=20):
    texts = [(i, Counter(split(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in texts]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in texts for t in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(split(text))
    out = []
    for item, terms in asked.items():
        scores = []
        for (doc, counts), n in zip(texts, sizes):
            score = 0
            for term, times in terms.items():
                if tf := counts[term]:
                    m = 75 + 25 * n * n_docs // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out += [(item, rank, doc, -score) for rank, (score, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out)


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, term string, block int"), spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, count int")


ODD = [(3, None), (None, "oak elm elm"), (5, ""), (5, "Oak elm"), (5, "Oak elm"), (4, "oak ELM"), (9, "§×ß naïve İOAK oak_elm 7"), (10**12, "\x7f oak\x00elm"), (-2, "birch " * 50_000 + "oak"), (11, "Ωmega ωmega É é")]
ASKED = [(1, "oak oak elm"), (2, None), (None, "oak"), (7, "é ωmega İoak"), (7, "7 7"), (8, "missing"), (1, "naïve"), (-4, "BIRCH birch")]


@pytest.mark.parametrize("owners, block_docs, bundle_items", [(1, 2048, 256), (4, 2, 1), (3, 1, 2)])
def test_odd_rows(spark, owners, block_docs, bundle_items):
    got = search.ranked(*frames(spark, ODD, ASKED), owners=owners, block_docs=block_docs, bundle_items=bundle_items)
    assert sorted(map(tuple, got.collect())) == brute(ODD, ASKED)


def test_ties_and_frequent_terms(spark):
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(400)]
    docs = [(i // 2, " ".join(["the", *rng.choices(words, k=rng.randrange(30))])) for i in range(600)] + [(i, "copy w1 w2") for i in range(1000, 1100)]
    items = [(i, " ".join(["The", *rng.choices(words, k=12)])) for i in range(40)] + [(77, "copy")]
    got = search.ranked(*frames(spark, docs, items), top=7, block_docs=64, bundle_items=9, block_chars=2000)
    assert sorted(map(tuple, got.collect())) == brute(docs, items, 7)


def test_a_bitmap_that_is_too_small_only_costs_work(spark):
    docs = [(i, f"a{i} b{i % 7} c") for i in range(50)]
    items = [(1, "a3 b3"), (2, "c a9")]
    assert sorted(map(tuple, search.ranked(*frames(spark, docs, items), bits=1 << 4).collect())) == brute(docs, items)


def test_nothing_to_search(spark):
    docs, items = frames(spark, ODD, ASKED)
    assert search.ranked(docs.limit(0), items).count() == search.ranked(docs, items.limit(0)).count() == search.ranked(docs.where("text = ''"), items).count() == 0
