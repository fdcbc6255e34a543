"""Removal of passages that repeat across documents, by paragraph MinHash banding.

Paragraphs are the lines of at least ``least_words`` words, and consecutive shorter lines joined until
they hold as many. Where shorter lines follow one another for long, joining begins anew at lines whose
first words have the smallest hash around, so that copies are cut alike. Every shorter line is in one
joined paragraph, unless the shorter lines it stands among have fewer words together. MinHash values of paragraphs are cut into bands
tuned for high recall, paragraphs that collide in a band are joined, exact Jaccard similarity of their
5-word shingles is verified, and connected components of similar paragraphs keep the paragraph of the
smallest document id; the others are removed.

A passage can also lie inside paragraphs that are otherwise different. That is not banding but exact
matching of runs, in two steps. Each text is covered by places where the hash of ``window`` words is
the smallest around: two texts with a common run of ``least_words`` words have such a place in common.
First, the words from each shared place to the place where they are ``least_words`` or more make one
piece: a piece that an earlier document has is removed at once. Second, of the other runs of
``least_words`` words around shared places those that an earlier document has are removed, so the
extent of a passage is exact to the word, and only its ends are looked at run by run. Runs and pieces that touch
a paragraph to be removed take no part, so that what a document keeps for others is left in it.

Last, passages copied with a few changed words, in whatever lines or sentences they stand. A place is the
least hash of ``window``-word shingles around, so a place that two texts share is a collision of MinHash values of
paragraphs that begin anywhere. The words around each shared place that is not removed yet are aligned with those
around the same place in the earliest document that has it: runs of equal words, edits of up to three
words between them. The longest stretch of ``least_words`` or more whose 5-word shingles have an exact Jaccard
similarity of the threshold or more is removed. Words up to ``reach`` from a place are looked at; longer
passages have more places. A near copy is missed where no place is shared, or only with an earlier document that is unlike around it.

What is removed always has an equal or similar passage in a document with a smaller id; passages that
repeat within one document only are left alone. Words are runs of characters other than white space.

Null texts and texts without long runs have no spans. Rows with a null id take no part and stay as
they are; rows with equal ids count as one document. Very long texts are read whole; an empty table
gives an empty result; other columns, whatever their names, come through unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import WORD, cut, reduced, spread, table, workspace, written
from fieldweave.llm.jaccard_join import similar
from fieldweave.llm.words import Words, blocks, mixed, rolling

_WORD = re.compile(WORD)
_END = (1 << 31) - 1  # behind the last word of any text


def tuned_rows(values: int, threshold: float, recall: float) -> int:
    """The most rows a band can have (the fewest false collisions) while a pair at the threshold still collides with this probability."""
    fine = [r for r in range(1, values + 1) if 1 - (1 - threshold**r) ** (values // r) >= recall]
    return max(fine, default=1)


def _slide(x: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """The best of every run of so many neighbours, by doubling."""
    n = 1
    while n * 2 <= window:
        x = best(x[: len(x) - n], x[n:])
        n *= 2
    return best(x[: len(x) - (window - n)], x[window - n :]) if n < window else x


def anchors(words: np.ndarray, window: int, around: int) -> tuple[np.ndarray, np.ndarray]:
    """Where short paragraphs begin, and their hashes: of every ``around`` neighbouring begins, those of the smallest hash."""
    rolled = rolling(words, window)
    if not len(rolled):
        return np.zeros(0, dtype=np.int64), rolled
    width = min(around, len(rolled))
    least = _slide(rolled, width, np.minimum)
    edge = np.zeros(width - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == rolled)
    return at, rolled[at]


def joined_lines(counts: np.ndarray, heads: np.ndarray, least_words: int) -> list[tuple[int, int]]:
    """Paragraphs (first line, line behind the last) of at least least_words words made of consecutive shorter lines.

    Lines have these numbers of words and hashes of their first words.
    """
    out = []
    bounds = [-1, *np.flatnonzero(counts >= least_words).tolist(), len(counts)]
    for before, after in zip(bounds, bounds[1:]):
        at = before + 1 + np.flatnonzero(counts[before + 1 : after])
        own, head = counts[at], heads[at]
        whole = int(own.sum())
        if whole < least_words:
            continue
        done = np.cumsum(own) - own  # words before each line
        starts = [0]
        if whole >= 2 * least_words:
            low, high = np.searchsorted(done, done - least_words, side="right"), np.searchsorted(done, done + least_words)
            far = np.flatnonzero((done >= least_words) & (whole - done >= least_words))
            starts += [i for i in far.tolist() if low[i] + head[low[i] : high[i]].argmin() == i]
        places, words = at.tolist(), [*done.tolist(), whole]
        for start, stop in zip(starts, [*starts[1:], len(places)]):
            begin = start
            for i in range(start + 1, stop):
                if words[i] - words[begin] >= least_words and words[stop] - words[i] >= least_words:
                    out.append((places[begin], places[i - 1] + 1))
                    begin = i
            out.append((places[begin], places[stop - 1] + 1))
    return out


def paragraphs(docs: DataFrame, least_words: int, head: int = 3) -> DataFrame:
    """id, begin and end (in words) and text of the lines of least_words words or more, and of joined shorter ones."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            for begin, texts in blocks(batch["text"].tolist()):
                lines_of = [t.split("\n") for t in texts]
                codes, counts = words.of([line for lines in lines_of for line in lines])
                first = np.cumsum(counts) - counts
                padded = np.concatenate([codes, np.zeros(head, dtype=np.uint64)])
                heads = np.zeros(len(counts), dtype=np.uint64)
                for k in range(head):
                    heads = mixed(heads + np.where(counts > k, padded[first + k], np.uint64(0)))
                rows, at = [], 0
                for i, lines in zip(batch["id"].iloc[begin : begin + len(texts)], lines_of):
                    here = slice(at, at := at + len(lines))
                    own = counts[here]
                    ends = np.cumsum(own)
                    found = [(k, k + 1) for k in np.flatnonzero(own >= least_words).tolist()] + joined_lines(own, heads[here], least_words)
                    rows += [(i, ends[a] - own[a], ends[b - 1], "\n".join(lines[a:b])) for a, b in found]
                yield pd.DataFrame(rows, columns=["id", "begin", "end", "text"])

    long = docs.select("id", "text").where(F.length("text") >= 2 * least_words - 1)  # so many words have so many characters at least
    return long.mapInPandas(split, f"id {dict(docs.dtypes)['id']}, begin int, end int, text string")


def pieces(words: np.ndarray, at: np.ndarray, window: int, least_words: int, power: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the hash of the words from there to the end of the next place that makes them least_words or more, and that end; 0 and 0 where there is none."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * power[: len(words)], out=sums[1:])
    stop = np.searchsorted(at, at + (least_words - window))
    there = stop < len(at)
    end = np.where(there, at[np.minimum(stop, len(at) - 1)] + window, 0)
    code = mixed((sums[end] - sums[at]) * inverse[at] + (end - at).astype(np.uint64))
    return np.where(there, code, np.uint64(0)), end


def removed_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_words: int = 50, window: int = 8, threshold: float = 0.8, values: int = 27, recall: float = 0.998, reach: int = 80) -> DataFrame:
    """id, start, end (characters), n_words and kept_id (the document that keeps the passage) of what is to be removed.

    Spans of a document don't overlap.
    """
    flat = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where("id is not null and text is not null")
    kind = dict(flat.dtypes)["id"]
    with workspace(docs.sparkSession):
        cases = cut(repeats(flat, least_words, window, threshold, values, recall, reach))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, text, *own in batch.itertuples(index=False):
                rows += [(i, *span) for span in spans(text, list(zip(*own)), least_words)]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "n_words", "kept_id"])

    out = reduced(flat, cases, ["id"]).join(cases, "id").select("id", "text", *[F.col(f"cases.{c}").alias(c) for c in ("begin", "end", "kept")])
    return out.mapInPandas(settle, f"id {kind}, start long, end long, n_words long, kept_id {kind}").withColumnRenamed("id", id_column)


def repeats(flat: DataFrame, least_words: int, window: int, threshold: float, values: int, recall: float, reach: int) -> DataFrame:
    """id and cases (ranges of words and the document that keeps them) of the documents of flat (id, text) with something to be removed."""
    kind = dict(flat.dtypes)["id"]
    around = least_words - window + 1

    # Equal texts: the one of the smallest id stays, and only it is looked at further.
    digests = cut(flat.select("id", F.md5(F.col("text").cast("binary")).alias("digest")))
    copied = cut(digests.groupBy("digest").agg(F.min("id").alias("kept"), F.max("id").alias("high")).where("kept <> high").select("digest", "kept"))
    copies = cut(digests.join(copied, "digest").where("id <> kept").select("id", "kept"))

    # Paragraphs that are similar to one of an earlier document.
    with workspace(flat.sparkSession):
        units = written(paragraphs(spread(flat), least_words))
        classes = similar(units, ["id", "begin", "end"], threshold=threshold, values=values, band_rows=tuned_rows(values, threshold, recall), step=values // 3, only_linked=True)
        alike = cut(classes.where(F.col("class_key.id") != F.col("id")).select("id", "begin", "end", F.col("class_key.id").alias("kept")))
    gone = alike.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("gone"))

    # Places, and which of them different texts share.
    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            for begin, texts in blocks(batch["text"].tolist(), 1_000_000):
                codes, counts = words.of(texts)
                ids, which, found = [], [], []
                for i, w, own in zip(batch["id"].iloc[begin : begin + len(texts)], batch["which"].iloc[begin : begin + len(texts)], np.split(codes, np.cumsum(counts)[:-1])):
                    at, code = anchors(own, window, around)
                    if len(at):
                        ids.append(np.repeat(i, len(at)))
                        which.append(np.repeat(w, len(at)))
                        found.append((at, code, *pieces(own, at, window, least_words, words.power, words.inverse)))
                if found:
                    at, code, piece, to = (np.concatenate(x) for x in zip(*found))
                    yield pd.DataFrame({"id": np.concatenate(ids), "which": np.concatenate(which), "at": at.astype(np.int32), "code": code.astype(np.int64), "piece": piece.astype(np.int64), "to": to.astype(np.int32)})

    short = written(spread(flat).withColumn("which", F.xxhash64("text")).mapInPandas(cover, f"id {kind}, which long, at int, code long, piece long, to int"))
    shared = cut(short.groupBy("code").agg(F.min("which").alias("low"), F.max("which").alias("high")).where("low <> high").select("code"))
    near = reduced(short, shared, ["code"]).join(shared, "code").groupBy("id").agg(F.collect_list(F.struct("at", "to", "piece", "code")).alias("places"))
    near = written(near.join(copies, "id", "left_anti").join(gone, "id", "left"))

    # Pieces that an earlier document has.
    touched = lambda begin, end: F.exists("gone", lambda g: (g["begin"] < end) & (g["end"] > begin))
    whole = near.select("id", "gone", F.explode("places").alias("p")).select("id", "gone", "p.*").where(F.col("to") > 0)
    whole = written(whole.where(F.col("gone").isNull() | ~touched(F.col("at"), F.col("to"))).select("id", "at", "to", "piece"))
    first = cut(whole.groupBy("piece").agg(F.min("id").alias("kept"), F.max("id").alias("high")).where("kept <> high").select("piece", "kept"))
    later = cut(reduced(whole, first, ["piece"]).join(first, "piece").where("id <> kept").select("id", F.col("at").alias("begin"), F.col("to").alias("end"), "kept"))
    done = later.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("told"))

    # Every other run of least_words words around the places.
    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            for begin in range(0, len(batch), 512):
                ids, places, codes = [], [], []
                for i, text, at, told_begin, told_end, gone_begin, gone_end in batch.iloc[begin : begin + 512].itertuples(index=False):
                    rolled = rolling(words.one(text), least_words)
                    wanted = marked(at - around + 1, at + 1, len(rolled))
                    if told_begin is not None:
                        wanted &= ~marked(told_begin, told_end - least_words + 1, len(rolled))
                    if gone_begin is not None:
                        wanted &= ~marked(gone_begin - least_words + 1, gone_end, len(rolled))
                    begins = np.flatnonzero(wanted)
                    ids.append(np.repeat(i, len(begins)))
                    places.append(begins)
                    codes.append(rolled[begins])
                yield pd.DataFrame({"id": np.concatenate(ids), "at": np.concatenate(places).astype(np.int32), "code": np.concatenate(codes).astype(np.int64)})

    placed = near.select("id", F.col("places.at").alias("at"), *ranges("gone"))  # before the join, so that no more is shuffled
    looked_at = reduced(flat, near, ["id"]).join(placed, "id").join(done.select("id", *ranges("told")), "id", "left")
    looked_at = looked_at.select("id", "text", "at", "told_begin", "told_end", "gone_begin", "gone_end")
    single = written(looked_at.mapInPandas(runs, f"id {kind}, at int, code long"))
    first = cut(single.groupBy("code").agg(F.min("id").alias("kept"), F.max("id").alias("high")).where("kept <> high").select("code", "kept"))
    ends = written(reduced(single, first, ["code"]).join(first, "code").where("id <> kept").select("id", F.col("at").alias("begin"), (F.col("at") + least_words).alias("end"), "kept"))
    edited = near_copies(flat, near, later.union(ends), least_words, window, threshold, reach)
    told = later.union(ends).union(edited).union(alike).union(copies.select("id", F.lit(0), F.lit(_END), "kept"))
    return told.groupBy("id").agg(F.collect_list(F.struct("begin", "end", "kept")).alias("cases"))


def near_copies(flat: DataFrame, near: DataFrame, exact: DataFrame, least_words: int, window: int, threshold: float, reach: int) -> DataFrame:
    """id, begin, end, kept of passages like one of an earlier document around places that no range of exact covers."""
    kind = dict(flat.dtypes)["id"]

    def uncovered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 512):
                found = []
                for i, at, code, told_begin, told_end, gone_begin, gone_end in batch.iloc[begin : begin + 512].itertuples(index=False):
                    n = int(at.max()) + window

                    def inside(begin: np.ndarray | None, end: np.ndarray | None) -> np.ndarray:
                        """How many words of each place are in the ranges."""
                        if begin is None:
                            return np.zeros(len(at), dtype=np.int64)
                        sums = np.concatenate([[0], np.cumsum(marked(begin, end, n))])
                        return sums[at + window] - sums[at]

                    free = inside(gone_begin, gone_end) == 0
                    left = (inside(told_begin, told_end) < window)[free]
                    found.append((np.repeat(i, len(left)), at[free], code[free], left))
                yield pd.DataFrame(dict(zip(("id", "at", "code", "left"), map(np.concatenate, zip(*found)))))

    done = exact.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("told"))
    ranged = near.select("id", F.col("places.at").alias("at"), F.col("places.code").alias("code"), *ranges("gone")).join(done.select("id", *ranges("told")), "id", "left")
    ranged = ranged.select("id", "at", "code", "told_begin", "told_end", "gone_begin", "gone_end")
    places = written(ranged.mapInPandas(uncovered, f"id {kind}, at int, code long, left boolean"))
    first = places.groupBy("code").agg(F.min(F.struct("id", "at")).alias("first"), F.max(F.when(F.col("left"), F.col("id"))).alias("high")).where("first.id <> high")
    first = cut(first.select("code", F.col("first.id").alias("kept"), F.col("first.at").alias("kept_at")))
    met = reduced(places.where("left"), first, ["code"]).join(first, "code").where("id <> kept")
    block, kept_block = (F.expr(f"{c} div {_BLOCK}").cast("int") for c in ("at", "kept_at"))
    pairs = written(met.groupBy("id", block.alias("block"), "kept", kept_block.alias("kept_block")).agg(F.collect_list(F.struct("at", "kept_at")).alias("places")), plain=True)

    def surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in batches:
            for begin, texts in blocks(batch["text"].tolist()):
                codes, counts = words.of(texts)
                rows = []
                for i, wanted, own in zip(batch["id"].iloc[begin : begin + len(texts)], batch["blocks"].iloc[begin : begin + len(texts)], np.split((codes >> np.uint64(32)).astype(np.uint32), np.cumsum(counts)[:-1])):
                    rows += [(i, b, own[begins(b) : (b + 1) * _BLOCK + window + reach].tobytes()) for b in wanted.tolist()]
                yield pd.DataFrame(rows, columns=["id", "block", "words"])

    # Words are shipped once for all places of a block of a text.
    begins = lambda b: max(b * _BLOCK - reach, 0)
    wanted = pairs.select("id", "block").union(pairs.select("kept", "kept_block").distinct()).groupBy("id").agg(F.collect_set("block").alias("blocks"))
    wanted = cut(wanted)
    around = reduced(flat, wanted, ["id"]).join(wanted, "id").select("id", "text", "blocks")
    around = written(around.mapInPandas(surroundings, f"id {kind}, block int, words binary"))
    kept = around.select(F.col("id").alias("kept"), F.col("block").alias("kept_block"), F.col("words").alias("kept_words"))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, block, own, k, kept_block, other, at, kept_at in batch.itertuples(index=False):
                own, other = np.frombuffer(own, np.uint32), np.frombuffer(other, np.uint32)
                for a, b in zip((at - begins(block)).tolist(), (kept_at - begins(kept_block)).tolist()):
                    low, kept_low = max(a - reach, 0), max(b - reach, 0)
                    found = like_stretch(own[low : a + window + reach], a - low, other[kept_low : b + window + reach], b - kept_low, window, least_words, threshold)
                    if found is not None:
                        rows.append((i, begins(block) + low + found[0], begins(block) + low + found[1], k))
            yield pd.DataFrame(rows, columns=["id", "begin", "end", "kept"]).drop_duplicates()

    both = pairs.join(around, ["id", "block"]).join(kept, ["kept", "kept_block"])
    both = both.select("id", "block", "words", "kept", "kept_block", "kept_words", "places.at", "places.kept_at")
    return both.mapInPandas(extend, f"id {kind}, begin int, end int, kept {kind}")


#: Words of a text whose places share one row.
_BLOCK = 256
#: Words of one side and of the other that one edit replaces.
_EDITS = [(1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3), (3, 0), (0, 3)]


def equal_ends(a: np.ndarray, b: np.ndarray, edits: int = 3, again: int = 5) -> list[tuple[int, int]]:
    """Words of a and of b up to the end of each run of equal words; an edit stands between runs, and the next one has ``again`` words or more."""
    i = j = 0
    out = []
    while True:
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        run = int(differ[0]) if len(differ) else n
        i, j = i + run, j + run
        out.append((i, j))
        if len(out) > edits:
            return out
        for p, q in _EDITS:
            x, y = a[i + p : i + p + again], b[j + q : j + q + again]
            if len(x) == len(y) == again and (x == y).all():
                i, j = i + p, j + q
                break
        else:
            return out


def like_stretch(a: np.ndarray, at: int, b: np.ndarray, b_at: int, window: int, least_words: int, threshold: float, n: int = 5) -> tuple[int, int] | None:
    """Begin and end in a of the longest stretch of least_words or more around a place that is so similar to one of b around its place."""
    left = equal_ends(a[:at][::-1], b[:b_at][::-1])
    right = equal_ends(a[at + window :], b[b_at + window :])
    cases = [(at - i, at + window + k, b_at - j, b_at + window + m) for i, j in left for k, m in right]
    for begin, end, low, high in sorted(cases, key=lambda c: c[0] - c[1]):
        if min(end - begin, high - low) < least_words:
            continue
        own, other = ({w[4 * k : 4 * (k + n)] for k in range(len(w) // 4 - n + 1)} for w in (a[begin:end].tobytes(), b[low:high].tobytes()))
        shared = len(own & other)
        if shared >= threshold * (len(own) + len(other) - shared) - 1e-9:
            return begin, end
    return None


def ranges(column: str) -> list[Column]:
    """The begins and the ends of an array of ranges."""
    return [F.col(f"{column}.{e}").alias(f"{column}_{e}") for e in ("begin", "end")]


def marked(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    begins, ends = np.clip(begins, 0, n), np.clip(ends, 0, n)
    there = begins < ends
    change = np.bincount(begins[there], minlength=n + 1) - np.bincount(ends[there], minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def spans(text: str, cases: list[tuple], least_words: int) -> list[tuple[int, int, int, object]]:
    """Disjoint spans of the text: start, end, words, document that keeps their begin. A case is a range of words and such a document."""
    found = list(_WORD.finditer(text))
    out: list[list] = []
    for begin, end, kept in sorted(cases):
        end = min(end, len(found))
        if end - begin < least_words:
            continue
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end, kept])
    return [(found[b].start(), found[e - 1].end(), int(e - b), kept) for b, e, kept in out]


def without(text: str, taken: list) -> str:
    """The text without the spans; of white space around a span what stood before it is left, emptied lines go."""
    out, at = [], 0
    for start, end in sorted((s["start"], s["end"]) for s in taken):
        out.append(text[at:start])
        at = end
        while at < len(text) and text[at] in " \t":
            at += 1
        if at < len(text) and text[at] == "\n" and (start == 0 or text[start - 1] == "\n"):
            at += 1
    out.append(text[at:])
    return "".join(out)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """docs with repeated passages taken out of the text; columns and rows stay."""
    found = removed_spans(docs, id_column, text_column, **parameters)
    taken = cut(found.groupBy(id_column).agg(F.collect_list(F.struct("start", "end")).alias("__taken")).withColumnRenamed(id_column, "__id"))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, s) if t is not None and s is not None and len(s) else t for t, s in zip(texts, spans)], dtype=object)

    joined = docs.join(taken, docs[id_column] == taken["__id"], "left")
    text = F.when(F.col("__taken").isNull(), F.col(text_column)).otherwise(cleaned(F.col(text_column), F.col("__taken")))
    return joined.withColumn(text_column, text).select(*docs.columns)


def op8_paragraph_banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_words", F.col("kept_id").alias("kept_doc_id"))
