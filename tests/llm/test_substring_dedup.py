import random

from fieldweave.llm import substring_dedup as sub


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(n)]


def test_planted_passages_go_from_all_but_the_first(spark):
    rng = random.Random(2)
    long, short = words(rng, 60), words(rng, 40)
    texts = {}
    for i in range(30):
        body = words(rng, 200)
        if i % 3 == 0:
            at = rng.randrange(0, 200)
            body[at:at] = long
        if i % 4 == 0:
            body[50:50] = short
        texts[i] = " ".join(body[:100]) + "\n" + "  ".join(body[100:])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen, removed = {}, {}
    for i, t in texts.items():  # every run of fifty words that an earlier document has
        w = t.split()
        for k in range(len(w) - 49):
            if seen.setdefault(tuple(w[k : k + 50]), i) != i:
                removed.setdefault(i, set()).update(range(k, k + 50))
    found = sub.removed_spans(docs).collect()
    assert len(removed) > 5 and {r.doc_id for r in found} == set(removed)
    for i in removed:
        own = [(len(texts[i][: r.start].split()), r.n_words) for r in found if r.doc_id == i]
        assert {k for at, n in own for k in range(at, at + n)} == removed[i]
    cleaned = {r.doc_id: r.text for r in sub.remove_repeats(docs).collect()}
    for i, t in texts.items():
        if i not in removed:
            assert cleaned[i] == t
        else:
            assert cleaned[i].split() == [w for k, w in enumerate(t.split()) if k not in removed[i]]


def test_similar_paragraphs_go(spark):
    rng = random.Random(6)
    line = words(rng, 120)
    near = list(line)
    near[60] = "zzz"
    rows = [(1, "first line\n" + " ".join(line)), (2, " ".join(words(rng, 60)) + "\n" + " ".join(near) + "\nend"), (3, " ".join(words(rng, 130)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in sub.remove_repeats(docs).collect()} == {1: rows[0][1], 2: rows[1][1].split("\n")[0] + "\nend", 3: rows[2][1]}


def test_query_against_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    spans = {}
    for r in sub.op8_paragraph_banding(spark, small).collect():
        assert r.kept_doc_id < r.doc_id and r.n_words == len(sub._WORD.findall(texts[r.doc_id][r.start : r.end])) >= 50
        spans.setdefault(r.doc_id, []).append({"start": r.start, "end": r.end})

    def where(texts):
        seen = {}
        for i, t in texts.items():
            w = sub._WORD.findall(t)
            for k in range(len(w) - 49):
                seen.setdefault(tuple(w[k : k + 50]), set()).add(i)
        return seen

    repeated = set().union(*(s - {min(s)} for s in where(texts).values() if len(s) > 1))
    assert repeated <= set(spans)
    left = where({i: sub.without(t, spans.get(i, [])) for i, t in texts.items()})
    assert not [s for s in left.values() if len(s) > 1]


def test_odd_rows(spark):
    text = " ".join(words(random.Random(1), 80))
    rows = [(1, text, "a"), (2, text, "b"), (2, text, "b"), (None, text, "c"), (4, None, "d"), (5, "", "e"), (6, "w " * 20000, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = sub.remove_repeats(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, [(1, text), (2, ""), (2, ""), (None, text), (4, None), (5, ""), (6, "w " * 20000)]))
    assert sub.removed_spans(docs.limit(0)).count() == 0


def test_tuning():
    rows = sub.tuned_rows(27, 0.8, 0.998)
    assert 1 - (1 - 0.8**rows) ** (27 // rows) >= 0.998 and sub.tuned_rows(4, 0.1, 0.999) == 1


def test_any_common_run_has_a_common_anchor():
    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        run = rng.integers(0, 1 << 60, 50).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(0, 1 << 60, rng.integers(0, 60)).astype(np.uint64), run, rng.integers(0, 1 << 60, rng.integers(0, 60)).astype(np.uint64)]) for _ in "ab")
        assert set(sub.anchors(a, 16, 35)[1].tolist()) & set(sub.anchors(b, 16, 35)[1].tolist())


def test_similar_paragraphs_of_short_lines_go(spark):
    rng = random.Random(8)
    lines = [words(rng, 30) for _ in range(3)]
    near = [list(line) for line in lines]
    near[1][15] = "zzz"
    told = lambda ls: "\n".join(" ".join(line) for line in ls)
    long = [words(rng, 60) for _ in range(2)]
    many = [words(rng, 9) for _ in range(120)]
    edited = [list(line) for line in many]
    edited[40][5] = edited[80][5] = "zzz"
    rows = [(1, told(lines)), (2, told([long[0], *near, long[1]])), (3, told(words(rng, 9) for _ in range(20))), (4, told(many)), (5, told([*(words(rng, 9) for _ in range(15)), *edited]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sub.remove_repeats(docs).collect()}
    assert [got[i] for i in (1, 3, 4)] == [rows[i - 1][1] for i in (1, 3, 4)]
    assert got[2] == told(long)
    assert "zzz" not in got[5] and got[5].startswith(told([rows[4][1].split("\n")[0].split()]))


def test_joined_lines_hold_enough_words_and_are_cut_alike():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(100):
        counts, heads = rng.integers(0, 60, 300), rng.integers(0, 1 << 60, 300).astype(np.uint64)
        counts[rng.random(300) < 0.9] %= 12
        found = sub.joined_lines(counts, heads, 50)
        assert all(counts[a:b].sum() >= 50 and (counts[a:b] < 50).all() for a, b in found)
        assert all(b <= c for (_, b), (c, _) in zip(found, found[1:]))
        covered = {i for a, b in found for i in range(a, b)}
        bounds = [-1, *np.flatnonzero(counts >= 50), 300]
        for a, b in zip(bounds, bounds[1:]):
            if counts[a + 1 : b].sum() >= 50:
                assert {i for i in range(a + 1, b) if counts[i]} <= covered
    counts, heads = rng.integers(1, 12, 400), rng.integers(0, 1 << 60, 400).astype(np.uint64)
    alone = {(a + 40, b + 40) for a, b in sub.joined_lines(counts, heads, 50)}
    within = set(sub.joined_lines(np.concatenate([rng.integers(1, 12, 40), counts]), np.concatenate([rng.integers(0, 1 << 60, 40).astype(np.uint64), heads]), 50))
    assert len(alone & within) >= 0.8 * len(alone)


def test_what_a_removed_paragraph_would_keep_for_others_is_left_somewhere(spark):
    rng = random.Random(11)
    base, insert = words(rng, 450), words(rng, 55)
    changed = base[:200] + insert + base[200:]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(words(rng, 70) + insert + words(rng, 70)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in sub.remove_repeats(docs).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1]}


def test_pieces_are_equal_where_words_are():
    import numpy as np

    from fieldweave.llm.words import Words

    rng, made = random.Random(13), Words()
    run = words(rng, 300)
    found = []
    for before in (20, 77):
        own = made.one(" ".join(words(rng, before) + run + words(rng, 30)))
        at, _ = sub.anchors(own, 16, 35)
        code, end = sub.pieces(own, at, 16, 50, made.power, made.inverse)
        assert all(50 <= e - a <= 85 for a, e in zip(at, end) if e) and (end[-1] == 0) == (code[-1] == 0)
        found.append({(a - before, e - before, c) for a, e, c in zip(at.tolist(), end.tolist(), code.tolist()) if a >= before and 0 < e <= before + 300})
    assert len(found[0] & found[1]) >= 10
    assert np.array_equal(sub.marked(np.array([-3, 4, 9]), np.array([2, 6, 30]), 10), [True, True, False, False, True, True, False, False, False, True])


def test_tables_of_the_work_are_deleted(spark, small):
    from pathlib import Path

    from fieldweave.llm.common import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    found = sub.op8_paragraph_banding(spark, small)
    assert not [p for p in set(folder.iterdir()) - before if p.name.startswith(("work-", "table-"))]
    assert found.count() > 0


def like_by_brute_force(a, b):
    """Words of b in stretches of fifty or more that are 0.8 alike to one of a: every pair of ends of equal runs is tried."""
    from difflib import SequenceMatcher

    runs = [m for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size >= 5]
    shingled = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    out = set()
    for i, x in enumerate(runs):
        for y in runs[i:]:
            own, other = b[x.b : y.b + y.size], a[x.a : y.a + y.size]
            p, q = shingled(own), shingled(other)
            if min(len(own), len(other)) >= 50 and len(p & q) >= 0.8 * len(p | q):
                out |= set(range(x.b, y.b + y.size))
    return out


def test_near_copies_within_other_text_are_found_as_by_brute_force(spark):
    rng = random.Random(21)
    cases = {"in a line": (None, 90, 1), "8 lines": (8, 0, 1), "12 lines": (12, 0, 1), "25 lines": (25, 0, 2), "60 lines": (60, 0, 4)}
    rows, pairs, clean = [], [], []
    for case, (lines, size, edits) in cases.items():
        for _ in range(30):
            passage = [words(rng, size)] if lines is None else [words(rng, rng.randrange(6, 13)) for _ in range(lines)]
            copy = [list(line) for line in passage]
            for e in range(edits):
                line = copy[(e + 1) * len(copy) // (edits + 1)]
                line[len(line) // 2] = f"changed{e}"
            told = []
            for lines_of in (passage, copy):
                before, after = ([words(rng, 6 + rng.randrange(7)) for _ in range(rng.randrange(3, 12))] for _ in "ab")
                if lines is None:
                    told.append(" ".join(w for line in before + lines_of + after for w in line))
                else:
                    told.append("\n".join(" ".join(line) for line in before + lines_of + after))
            pairs.append((case, len(rows), len(rows) + 1))
            rows += [(len(rows), told[0]), (len(rows) + 1, told[1])]
        clean.append(len(rows))
        rows.append((len(rows), "\n".join(" ".join(words(rng, 9)) for _ in range(30))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = {}
    for r in sub.removed_spans(docs).collect():
        at = len(rows[r.doc_id][1][: r.start].split())
        removed.setdefault(r.doc_id, set()).update(range(at, at + r.n_words))
    assert not [i for i in removed if i in clean or i in {a for _, a, _ in pairs}]
    wanted, found, extra = {}, {}, 0
    for case, a, b in pairs:
        true = like_by_brute_force(rows[a][1].split(), rows[b][1].split())
        wanted[case] = wanted.get(case, 0) + len(true)
        found[case] = found.get(case, 0) + len(true & removed.get(b, set()))
        extra += len(removed.get(b, set()) - true)
    recall = {case: found[case] / wanted[case] for case in cases}
    print(recall, extra)
    assert min(recall.values()) >= 0.9 and extra <= 0.01 * sum(wanted.values()), (recall, extra)


def test_alignment_takes_edits_and_stops_at_other_text():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 70, dtype=np.uint32)
    changed = np.concatenate([base[:30], base[31:]])  # a word is missing
    other = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint32)
    a, b = np.concatenate([other(20), changed, other(20)]), np.concatenate([other(9), base, other(40)])
    assert sub.like_stretch(a, 20 + 40, b, 9 + 41, 8, 50, 0.8) == (20, 89)
    assert sub.like_stretch(a, 20 + 40, b, 9 + 41, 8, 70, 0.8) is None
    assert sub.like_stretch(a[:60], 52, b[:50], 42, 8, 50, 0.8) is None
