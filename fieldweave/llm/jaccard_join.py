"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of n-word shingles. Equal texts are joined first, by digest, so that a text with many
copies is compared once. MinHash values of the distinct texts are banded; texts that share a band are
linked to the smallest of their bucket, and connected components of these links say which texts can be
similar at all. Small components are compared as a whole. Of a component too large for one block either
all texts or only those of each bucket are compared with one another, whichever is less work: long
chains of texts that are each like the next have small buckets, groups of copies of one text share most
of them. A pair that meets in several buckets counts in the first. Such a group is compared pair by pair
in blocks, and each pair of blocks is a task of its own: MinHash values are
compared a few at a time, and a pair is dropped as soon as the posterior probability that its Jaccard
similarity reaches the threshold falls below the tolerance (uniform prior, so the posterior is a
binomial sum). The pairs that are left are verified on the shingle sets.

Pairs never leave the block they are compared in: a block returns for each text the number of its links
and one member of its cluster, so the output grows with the texts and not with the pairs.

With 125 values in 25 bands of 5, a pair at similarity 0.8 shares a band with probability 0.99995.

A word is a run of characters other than white space; a text of fewer than n words has its whole word
sequence as its only shingle. Null text, and text without a word, is similar to nothing: such a row is
a class of its own, but equal texts (the empty one too) are copies. Null ids take part, but a class is
named by its smallest id that is not null. Repeated rows are copies. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import cut, reduced, shuffle_partitions, spread, table, workspace, written
from fieldweave.llm.components import components
from fieldweave.llm.words import Words, blocks, mixed, rolling

_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: Words, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    codes = words.one(text)
    return np.unique(rolling(codes, min(n, len(codes)))) if len(codes) else codes


class MinHash:
    def __init__(self, values: int = 125, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.factor = rng.integers(1, 1 << 63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.term = rng.integers(0, 1 << 63, values, dtype=np.uint64)

    def of(self, found: np.ndarray) -> np.ndarray:
        """The values of one text's shingles."""
        return self.of_many(found, np.zeros(1, dtype=np.int64))[0]

    def of_many(self, found: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of values for each text; the texts' shingles stand one behind another."""
        out = np.empty((len(starts), len(self.factor)), dtype=np.uint32)
        for k, (factor, term) in enumerate(zip(self.factor, self.term)):
            hashed = found * factor
            hashed += term
            hashed >>= np.uint64(32)
            out[:, k] = np.minimum.reduceat(hashed, starts)
        return out

    def bands(self, values: np.ndarray, rows: int) -> np.ndarray:
        """64-bit buckets by text and band, of values by text."""
        count = values.shape[1] // rows
        parts = values[:, : count * rows].reshape(len(values), count, rows).astype(np.uint64)
        out = np.tile(np.arange(1, count + 1, dtype=np.uint64), (len(values), 1))
        for k in range(rows):
            out = mixed(out * _ODD + parts[:, :, k])
        return out.astype(np.int64)


def signatures(texts: list[str | None], words: Words, minhash: MinHash, n: int, band_rows: int) -> tuple[np.ndarray, list]:
    """Number of shingles and bands of each text; 0 and none for texts without words."""
    sizes, bands = np.zeros(len(texts), dtype=np.int32), [[]] * len(texts)
    for first, some in blocks(texts):
        codes, length = words.of(some)
        begin = np.cumsum(length) - length
        long = np.flatnonzero(length >= n)
        if len(long):
            rolled = rolling(codes, n)
            count = length[long] - n + 1
            starts = np.cumsum(count) - count
            at = np.repeat(begin[long] - starts, count) + np.arange(count.sum())
            for row, size, own in zip(first + long, count, minhash.bands(minhash.of_many(rolled[at], starts), band_rows)):
                sizes[row], bands[row] = size, own
        for k in np.flatnonzero((length > 0) & (length < n)):  # shorter than a shingle
            whole = rolling(codes[begin[k] : begin[k] + length[k]], length[k])
            sizes[first + k], bands[first + k] = 1, minhash.bands(minhash.of(whole)[None, :], band_rows)[0]
    return sizes, bands


def profiles(texts: list[str | None], words: Words, minhash: MinHash, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The shingles (see shingles) and the MinHash values of each of many texts, each with a word."""
    sets: list[np.ndarray] = []
    signs = np.empty((len(texts), len(minhash.factor)), dtype=np.uint32)
    for first, some in blocks(texts):
        codes, length = words.of(some)
        rolled, ends = rolling(codes, n), np.cumsum(length)
        own = [np.unique(rolled[end - k : end - n + 1] if k >= n else rolling(codes[end - k : end], k)) for end, k in zip(ends.tolist(), length.tolist())]
        sizes = np.array([len(o) for o in own])
        signs[first : first + len(some)] = minhash.of_many(np.concatenate(own), np.cumsum(sizes) - sizes)
        sets += own
    return sets, signs


def least_matches(compared: int, threshold: float, tolerance: float) -> int:
    """The fewest equal values of so many at which the posterior of similarity >= threshold reaches the tolerance."""
    below = 0.0
    for m in range(compared + 1):
        below += math.comb(compared + 1, m) * threshold**m * (1 - threshold) ** (compared + 1 - m)
        if below >= tolerance:
            return m
    return compared


class Comparer:
    """Compares the texts of a block; step values at a time, tile rows against all."""

    def __init__(self, threshold: float, tolerance: float, values: int, step: int = 25, tile: int = 128):
        self.threshold, self.step, self.tile = threshold, step, tile
        self.least = {c: least_matches(c, threshold, tolerance) for c in range(step, values + 1, step)}

    def pairs(self, values: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, others: np.ndarray, first_met: tuple[np.ndarray, int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Similar pairs (row, other), tile by tile; where rows and others are the same, each pair once.

        first_met has the buckets of all rows by band, and a band: only pairs that share no earlier one are given.
        """
        same = rows is others
        sizes = np.array([len(s) for s in sets])
        for start in range(0, len(rows), self.tile):
            own = rows[start : start + self.tile]
            matches = np.zeros((len(own), len(others)), dtype=np.int16)
            for k in range(self.step):
                matches += values[own, k][:, None] == values[others, k][None, :]
            alive = matches >= self.least[self.step]
            if same:
                alive &= (start + np.arange(len(own)))[:, None] < np.arange(len(others))[None, :]
            p, q = np.nonzero(alive)
            found, p, q = matches[p, q].astype(np.int64), own[p], others[q]
            for done in range(2 * self.step, values.shape[1] + 1, self.step):
                found = found + (values[p, done - self.step : done] == values[q, done - self.step : done]).sum(axis=1)
                keep = found >= self.least[done]
                found, p, q = found[keep], p[keep], q[keep]
            if first_met is not None and len(p):
                keep = (first_met[0][p] == first_met[0][q]).argmax(axis=1) == first_met[1]
                p, q = p[keep], q[keep]
            if len(p):
                shared = self._shared(sets, p, q)
                keep = shared >= self.threshold * (sizes[p] + sizes[q] - shared) - 1e-9
                yield p[keep], q[keep]

    def _shared(self, sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Sizes of intersections."""
        left, at_left = np.unique(p, return_inverse=True)
        right, at_right = np.unique(q, return_inverse=True)
        if len(p) < 8 * (len(left) + len(right)):
            return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(p, q)])
        # Many pairs among few texts: products of 0/1 matrices, some columns at a time.
        columns = np.intersect1d(np.concatenate([sets[a] for a in left]), np.concatenate([sets[b] for b in right]))
        total = np.zeros((len(left), len(right)), dtype=np.float32)
        for start in range(0, len(columns), 4096):
            some = columns[start : start + 4096]
            total += self._presence(sets, left, some) @ self._presence(sets, right, some).T
        return total[at_left, at_right].astype(np.int64)

    @staticmethod
    def _presence(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(columns)), dtype=np.float32)
        for i, r in enumerate(rows):
            part = sets[r][np.searchsorted(sets[r], columns[0]) : np.searchsorted(sets[r], columns[-1], side="right")]
            at = np.searchsorted(columns, part)
            out[i, at[columns[np.minimum(at, len(columns) - 1)] == part]] = 1
        return out


def similar(units: DataFrame, keys: list[str], text_column: str = "text", n: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, values: int = 125, band_rows: int = 5, step: int = 25, block_rows: int = 500, block_shingles: int = 2_000_000, only_linked: bool = False) -> DataFrame:
    """keys, digest, class_key (struct of the class's smallest keys), n_links, copies for every row of units.

    With ``only_linked`` rows that are linked to no other are left out.
    """
    spark = units.sparkSession
    flat = units.select(*keys, F.unhex(F.md5(F.col(text_column).cast("binary"))).alias("digest"), F.col(text_column).alias("text"))
    kinds = dict(flat.dtypes)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, minhash = Words(), MinHash(values)
        for batch in batches:
            sizes, bands = signatures(batch["text"].tolist(), words, minhash, n, band_rows)
            yield batch.drop(columns="text").assign(size=sizes, bands=bands)

    signed = written(spread(flat).mapInPandas(sign, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", digest binary, size int, bands array<long>"))
    key = F.struct(*keys)
    texts = cut(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(F.min(F.when(F.col(keys[0]).isNotNull(), key)).alias("key"), F.min(key).alias("any_key"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.max("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )

    # Which texts can be similar: components of links within buckets.
    banded = texts.where(F.size("bands") > 0).select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    leaders = cut(banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "leader"))
    links = reduced(banded, leaders, ["bucket"]).join(leaders, "bucket").where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    could = components(links)
    candidates = cut(reduced(texts.drop("bands"), could, ["node"]).join(could, "node"))

    # What is compared with one another: the texts of a component (band -1), or of a bucket of it.
    blocks = F.greatest(F.ceil(F.col("n") / block_rows), F.ceil(F.col("s") / block_shingles)).cast("int").alias("blocks")
    sums = cut(candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).select("component", "n", blocks))
    member = candidates.select("node", "digest", "any_key", "copies", F.col("component").alias("group"), F.lit(-1).alias("band")).join(sums.select(F.col("component").alias("group"), "blocks"), "group")
    large = sums.where("blocks > 1")
    if not large.isEmpty():
        in_large = cut(could.join(large.select("component", F.col("n").alias("all")), "component"))
        met = cut(reduced(banded, in_large, ["node"]).join(in_large, "node"))
        buckets = cut(met.groupBy("component", "all", "band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).where("n > 1").select("component", "all", "band", "bucket", "n", blocks))
        chained = buckets.groupBy("component", "all").agg(F.sum(F.col("n") * F.col("n")).alias("pairs")).where(F.col("pairs") < F.col("all") * F.col("all")).select("component")
        apart = buckets.join(chained, "component").select(F.col("bucket").alias("group"), "band", "blocks")
        apart = met.select("node", "band", F.col("bucket").alias("group")).join(apart, ["group", "band"]).join(candidates.select("node", "digest", "any_key", "copies"), "node")
        member = member.join(chained.select(F.col("component").alias("group")), "group", "left_anti").unionByName(apart)
    placed = cut(member.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    # Small groups share tasks; large ones have a task for each pair of their blocks.
    cells = 8 * shuffle_partitions(spark)
    alone = F.col("blocks") > 1
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    wanted = flat.select(F.col("digest"), F.struct(*keys).alias("any_key"), "text")
    dealt = (
        placed.select("digest", "any_key", "node", "group", "band", "copies", "block", alone.alias("alone"), other)
        .withColumn("cell", F.when(F.col("alone"), F.xxhash64("group", "band")).otherwise(F.pmod(F.xxhash64("group", "band"), F.lit(cells))))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
    )
    wanted = reduced(wanted, candidates, ["digest", "any_key"])  # few texts are candidates
    same_row = (wanted["digest"] == dealt["digest"]) & wanted["any_key"].eqNullSafe(dealt["any_key"])
    with_text = wanted.join(dealt, same_row).select("text", "node", "group", "band", "copies", "block", "alone", "cell", "i", "j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["group", "band", "node"]).reset_index(drop=True)
        words, minhash, comparer = Words(), MinHash(values), Comparer(threshold, tolerance, values, step)
        all_sets, all_signs = profiles(rows["text"].tolist(), words, minhash, n)
        nodes, all_copies, all_blocks = (rows[c].to_numpy() for c in ("node", "copies", "block"))
        i, j = rows["i"].iloc[0], rows["j"].iloc[0]  # the same in all rows
        out = []
        for (_, band), part in rows.groupby(["group", "band"]).indices.items():
            sets, signs = [all_sets[k] for k in part.tolist()], all_signs[part]
            node, copies, block = nodes[part], all_copies[part], all_blocks[part]
            own = np.flatnonzero(block == i)
            others = own if i == j else np.flatnonzero(block == j)
            linked, label = np.zeros(len(part), dtype=np.int64), np.arange(len(part))
            first_met = None if band < 0 else (minhash.bands(signs, band_rows), band)
            for p, q in comparer.pairs(signs, sets, own, others, first_met):
                np.add.at(linked, p, copies[q])
                np.add.at(linked, q, copies[p])
                while len(p):
                    low = np.minimum(label[p], label[q])
                    np.minimum.at(label, label[p], low)
                    np.minimum.at(label, label[q], low)
                    label = label[label]
                    differ = label[p] != label[q]
                    p, q = p[differ], q[differ]
            while (label[label] != label).any():
                label = label[label]
            there = linked > 0
            out.append((node[there], linked[there], node[label][there]))
        return pd.DataFrame(dict(zip(("node", "linked", "toward"), map(np.concatenate, zip(*out)))))

    found = cut(with_text.groupBy("cell", "alone", "i", "j").applyInPandas(compare, "node long, linked long, toward long"))
    classes = components(found.where("node <> toward").select(F.col("node").alias("a"), F.col("toward").alias("b")))
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    if only_linked:  # others have no copies and no links
        texts = texts.drop("bands")
        texts = texts.where("copies > 1").union(reduced(texts.where("copies = 1"), found, ["node"]))
    told = texts.join(classes, "node", "left").join(linked, "node", "left").select("digest", "key", "copies", F.coalesce("component", "node").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = cut(told)
    named = told.groupBy("component").agg(F.min("key").alias("class_key"))
    told = cut(told.select("digest", "copies", "component", "n_links").join(cut(named), "component"))
    rows, how = signed.select(*keys, "digest", "size"), "left"
    if only_linked:
        told = told.where("n_links > 0")
        rows, how = reduced(rows, told, ["digest"]), "inner"
    return rows.join(told.select("digest", "copies", "n_links", "class_key"), "digest", how).select(
        *keys, "digest", "size", F.coalesce("class_key", key).alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies")
    )


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """id, class_id (the smallest id of its class), n_links (other rows at the threshold or above, copies included), copies, digest."""
    found = similar(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), ["id"], n=n, threshold=threshold)
    return found.select(F.col("id").alias(id_column), F.col("class_key.id").alias("class_id"), "n_links", "copies", "digest")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with one row left of each class: that of the smallest id. Null ids that name no class keep their rows."""
    with workspace(docs.sparkSession):
        found = near_duplicates(docs, id_column, text_column)
        keepers = cut(found.where(F.col(id_column).eqNullSafe(F.col("class_id"))).select(F.col(id_column).alias("__id"), F.coalesce("digest", F.lit(b"")).alias("__digest")).distinct())
    digest = F.coalesce(F.unhex(F.md5(F.col(text_column).cast("binary"))), F.lit(b""))
    kept = docs.withColumn("__digest", digest).withColumn("__id", F.col(id_column))
    met = kept.join(keepers, (kept["__digest"] == keepers["__digest"]) & kept["__id"].eqNullSafe(keepers["__id"]), "left_semi")
    return met.dropDuplicates(["__id", "__digest"]).select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")
