import zlib

from pyspark.sql import functions as F

from fieldweave.llm import language_id as lid


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = {r.doc_id: r for r in lid.op6_hyperdimensional(spark, small).collect()}
    told = docs.collect()
    assert len(got) == len(told)
    held = [d for d in told if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    wrong = docs.withColumn("lang", F.when(lid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    run = lambda d: {r.doc_id: r.lang_pred for r in lid.identify(d, d.where(~lid.held_out()), [F.col("doc_id")]).collect()}
    assert run(docs) == run(wrong)


def test_products_are_the_cosines_of_bundles():
    import numpy as np

    space = lid.Space(dimensions=256)
    texts = ["the cat sat on the mat", "der Hund und die Katze"]
    bundle = lambda t: (space.grams(t)[1][:, None] * space.vectors(space.grams(t)[0]).astype(float)).sum(axis=0)
    a, b = bundle(texts[0]), bundle(texts[1])
    codes, counts = space.grams(texts[0])
    assert np.isclose((space.vectors(codes).astype(float) @ b) @ counts, a @ b)


def test_odd_rows(spark):
    kind = "doc_id long, text string, lang string, score string"
    rows = [(1, "the cat and the dog are on the mat", "en", "x"), (2, "der Hund und die Katze sind auf der Matte", "de", "x"), (3, None, "en", "x"), (4, "123 !?", "en", "x"), (5, "", None, "x"), (None, "the dog", None, "x"), (2, "und die Katze " * 5000, None, "x"), (7, "日本語", None, "x")]
    docs = spark.createDataFrame(rows, kind)
    got = [(r.doc_id, r.lang_pred) for r in lid.identify(docs, docs, [F.col("doc_id")]).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (2, "de"), (7, dict(got)[7])], key=str)
    kept = lid.keep_known(docs, docs)
    assert kept.columns == docs.columns and kept.count() == 4  # the text in letters never learned goes, too
    assert lid.identify(docs.limit(0), docs, [F.col("doc_id")]).count() == 0
    none = lid.identify(docs, docs.where("lang = 'zz'"), [F.col("doc_id")]).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_predictions_by_explicit_bundles(spark):
    """Cosines of vectors made n-gram by n-gram."""
    import math
    import unicodedata

    import numpy as np

    space = lid.Space()
    labelled = [("en", "The cat sat on the mat, and the dog ran off."), ("en", "What is this that they have there?"), ("de", "Der Hund und die Katze; das ist schön."), ("fr", "Le chat est là où le chien était.")]
    asked = ["the hat", "die Matte und der Hund", "le chien là", "½ ²", "Ⅷ", "123", "_ _", "ªº", "A1b2", "zzz qqq xxx", ""]

    def bundle(text):
        total, n, square = np.zeros(space.dimensions), 0, {}
        words = "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower()).split()
        padded = " " + " ".join(words) + " "
        for i in range(len(padded) - 2):
            gram = padded[i : i + 3]
            if words and gram[1] != " ":
                bound = np.ones(space.dimensions)
                for k, c in enumerate(gram):
                    bound = bound * np.roll(space.letters[0 if c == " " else 1 + ord(c) % 255], k)
                total, n, square[gram] = total + bound, n + 1, square.get(gram, 0) + 1
        return total, n, sum(x * x for x in square.values())

    langs = sorted({lang for lang, _ in labelled})
    parts = {lang: [bundle(t) for own, t in labelled if own == lang] for lang in langs}
    prototypes = {lang: (sum(v for v, _, _ in own), sum(n for _, n, _ in own)) for lang, own in parts.items()}
    rows = spark.createDataFrame([(i, t, None) for i, t in enumerate(asked)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in lid.identify(rows, spark.createDataFrame(labelled, "lang string, text string"), [F.col("doc_id")]).collect()}
    assert [got[i].lang_pred for i in range(9)] == ["en", "de", "fr", "und", "und", "und", "und", got[7].lang_pred, "en"] and got[7].lang_pred != "und"
    for i, text in enumerate(asked):
        vector, n, squares = bundle(text)
        if not n:
            assert (got[i].lang_pred, got[i].score, got[i].evidence) == ("und", 0, 0)
            continue
        near = {lang: vector @ p / np.linalg.norm(p) for lang, (p, _) in prototypes.items()}
        best = max(langs, key=lambda lang: max(near[lang], 0))
        whole = sum(max(x, 0) ** 2 for x in near.values())
        p, total = prototypes[best]
        equal = p @ p / space.dimensions / total**2
        assert got[i].lang_pred == best
        assert math.isclose(got[i].score, max(near[best], 0) ** 2 / whole if whole else 0, rel_tol=1e-4, abs_tol=1e-6)
        assert math.isclose(got[i].evidence, near[best] / math.sqrt(space.dimensions * squares) / math.sqrt(n * equal / (1 + n * equal)), rel_tol=1e-4, abs_tol=1e-6)


def test_texts_in_no_learned_language_are_rejected(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    strange = spark.createDataFrame([(10**6 + i, t, "en") for i, t in enumerate(["Щука плывёт под мостом и молчит весь долгий зимний день", "zzqx vvkj qqwx xkcd zzzq jjkv " * 20, "½ ² ³ 123 Ⅷ"])], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in lid.keep_known(docs.union(strange), docs).collect()}
    assert max(kept) < 10**6 and len(kept) >= 0.98 * docs.count()
