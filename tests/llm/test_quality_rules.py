from fieldweave.llm import quality_rules as quality


def brute(text):
    words = quality._WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(covered)


def test_repeated_words_by_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(300):
        text = " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 25)))
        assert quality.measure(text)[4] == brute(text)
    assert quality.measure("# a\n\n# a\n \n b$") == (5, 6, 3, 1, 0)
    assert quality.measure(None) == quality.measure("") == quality.measure(" \n") == (0, 0, 0, 0, 0)


def rows_of(spark, hosts):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(n, host, good if k < ok else bad, "x") for n, (host, ok, k) in enumerate((h, ok, k) for h, total, ok in hosts for k in range(total))]
    return spark.createDataFrame(rows, "doc_id long, source string, text string, kept string")


def test_hosts_with_high_shrunken_rates_are_rejected(spark):
    docs = rows_of(spark, [("good", 200, 190), ("bad", 200, 20), ("few", 2, 1), (None, 10, 9)])
    got = {(r.host, r.base_failed): r.kept for r in quality.judge(docs).collect()}
    assert got["good", False] and not got["bad", False] and got["few", False] and got[None, False] and not got["good", True]
    kept = quality.keep_passed(docs)
    assert kept.columns == docs.columns and kept.count() == 190 + 1 + 9


def test_bound_comes_from_the_hosts(spark):
    alike = [(f"h{i}", 100, 97 - i % 3) for i in range(30)]
    docs = rows_of(spark, [*alike, ("worse", 400, 250)])
    got = {r.host: r.kept for r in quality.judge(docs).where("not base_failed").collect()}
    assert not got["worse"] and all(got[h] for h, _, _ in alike)  # 0.375 of its documents fail, 0.04 of the others'
    again = {r.host: r.kept for r in quality.judge(docs, spared_host_rate=0.4).where("not base_failed").collect()}
    assert again["worse"]
    assert all(r.kept for r in quality.judge(rows_of(spark, alike)).where("not base_failed").collect())


def test_odd_rows(spark):
    odd = [(1, None, None, "x"), (1, "h", "", "x"), (None, "h", "a " * 30000, "x"), (2, "h", " ".join(map(str, range(70))), "x"), (2, "h", " ".join(map(str, range(70))), "x")]
    docs = spark.createDataFrame(odd, "doc_id long, source string, text string, m string")
    assert sorted(str((r.doc_id, r.n_words, r.base_failed)) for r in quality.judge(docs).collect()) == sorted(map(str, [(1, 0, True), (1, 0, True), (None, 30000, True), (2, 70, False), (2, 70, False)]))
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep_passed(docs.limit(0)).count() == 0
