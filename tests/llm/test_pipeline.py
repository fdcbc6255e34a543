import corpus_pipeline
from fieldweave.llm import jaccard_join, quality_rules, substring_dedup
from fieldweave.llm.words import Words


def test_stages_are_the_ones_agreed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["languages", "quality", "near_duplicates", "repeated_passages", "sequences"]


def test_run_against_plain_python(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if name != "sequences":
            assert docs.columns == columns and docs.count() <= before.count()
    text = lambda name: {r.doc_id: r.text for r in kept[name].collect()}
    first, good, one, clean = (text(n) for n in ("languages", "quality", "near_duplicates", "repeated_passages"))
    passes = lambda m: m[0] >= 50 and 100 * m[4] <= 50 * m[0]
    assert {i for i, t in first.items() if passes(quality_rules.measure(t))} == set(good)
    sets = {i: set(jaccard_join.shingles(t, Words()).tolist()) for i, t in one.items()}
    assert all(len(a & b) < 0.8 * len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j)
    assert set(clean) == set(one)
    seen = {}
    for i, t in clean.items():
        words = substring_dedup._WORD.findall(t)
        for k in range(len(words) - 49):
            assert seen.setdefault(tuple(words[k : k + 50]), i) == i
    assert {r.doc_id for r in kept["sequences"].collect()} == set(clean)
    assert all(r.n_chars == len(r.text) for r in kept["repeated_passages"].collect())
    whole = corpus_pipeline.run(spark, small)
    assert sorted(map(str, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(str, kept["sequences"].select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_odd_documents(spark, tmp_path):
    good = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))
    rows = [(1, good, "en", "a", 1, "x"), (1, good, "en", "a", 1, "x"), (2, None, None, None, None, None), (3, "", "en", "a", 0, None), (None, good + " more", "en", None, 5, "y"), (5, good.upper(), "en", "b", 5, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, host string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} >= {1, 5} and sum(r.doc_id == 1 for r in out) == 1
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
