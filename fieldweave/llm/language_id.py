"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its letters'
vectors, each permuted (rotated) by its place in the n-gram. A text's vector bundles (adds) its
n-grams' vectors; a language's prototype bundles those of its labelled texts. The language whose
prototype has the largest cosine with the text is predicted. Words are padded with a space, case is
folded, and all characters that are not letters (Unicode categories L) separate words.

A dot product with a bundle is the sum of the dot products with what it bundles, so the cosine of a
text and a prototype needs one product of each distinct n-gram of a block with each prototype; the
length of the text's own vector is the same for all languages.

The score is the best language's share of the cosines above zero, squared: 1 if no other language is
near, 1/k if k are equally near. It says nothing of texts in a language that was never learned, so
there is also the evidence: the best cosine, divided by the cosine that a text of so many n-grams drawn from the
language itself would have. It is near 1 for texts of the language, whatever their length, and near 0
for texts of others. (The text's length is taken as that of a sum of orthogonal n-gram vectors, which random ones nearly are.)

Ties go to the language that sorts first. Null text, or text without
a letter, gives ``und``, score 0 and evidence 0, as does every text when nothing is labelled. Very long texts are
read whole; null ids and repeated rows stay rows of their own; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import spread, table

_LETTERS = 256  # letters beyond share vectors
_BLOCK = 256  # texts looked at together


@cache
def _is_letter() -> np.ndarray:
    """By code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


class Space:
    """Random vectors, fixed by the seed."""

    def __init__(self, dimensions: int = 2048, n: int = 3, seed: int = 17):
        self.n, self.dimensions = n, dimensions
        self.letters = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int8), (_LETTERS, dimensions))

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the text's words, as numbers, and how often they occur."""
        points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le"), dtype="<u4")
        letters = np.where(_is_letter()[points], 1 + points % (_LETTERS - 1), 0).astype(np.int64)
        letters = letters[(letters != 0) | (np.append(1, letters[:-1]) != 0)]  # one separator between words
        if len(letters) < 2:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        codes = np.zeros(max(len(letters) - self.n + 1, 0), dtype=np.int64)
        for k in range(self.n):
            codes = codes * _LETTERS + letters[k : k + len(codes)]
        middle = letters[self.n // 2 : self.n // 2 + len(codes)]
        return np.unique(codes[middle != 0], return_counts=True)  # none that stands between two words

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        bound = np.ones((len(codes), self.dimensions), dtype=np.int8)
        for k in range(self.n):
            letter = codes // _LETTERS ** (self.n - 1 - k) % _LETTERS
            bound *= np.roll(self.letters, k, axis=1)[letter]
        return bound


def profiles(labelled: DataFrame, space: Space, lang_column: str = "lang", text_column: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their prototypes (of length 1), and how probable it is that two n-grams drawn from a language are equal. The driver gets one row for each language."""
    narrow = labelled.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                for i in range(0, len(texts), _BLOCK):
                    found = [space.grams(t) for t in texts.iloc[i : i + _BLOCK]]
                    codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                    yield pd.DataFrame({"lang": lang, "gram": codes, "n": np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype("int64")})

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for i in range(0, len(rows), 1024):
                    part = rows.iloc[i : i + 1024]
                    own = part["n"].to_numpy(dtype=np.float64) @ space.vectors(part["gram"].to_numpy()).astype(np.float64)
                    sums[lang] = sums.get(lang, 0) + np.append(own, part["n"].sum())  # last the number of n-grams
        for lang, total in sums.items():
            yield pd.DataFrame({"lang": lang, "place": np.arange(space.dimensions + 1), "v": total})

    grams = spread(narrow).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    summed = grams.mapInPandas(bundle, "lang string, place int, v double").groupBy("lang", "place").agg(F.sum("v").alias("v"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("vs")).orderBy("lang").collect()
    langs = [r.lang for r in rows if any(x.v for x in r.vs[:-1])]
    told = np.array([[x.v for x in r.vs] for r in rows if r.lang in langs]).reshape(len(langs), space.dimensions + 1)
    made, number = told[:, :-1], told[:, -1]
    length = np.linalg.norm(made, axis=1, keepdims=True)
    return langs, made / np.maximum(length, 1e-300), length[:, 0] ** 2 / space.dimensions / number**2


def predictor(labelled: DataFrame, lang_column: str = "lang", text_column: str = "text", space: Space | None = None):
    """A function of a text column that gives struct(lang_pred, score, evidence), learned from the labelled rows."""
    space = space or Space()
    langs, prototypes, equal = profiles(labelled, space, lang_column, text_column)

    def judged(texts: pd.Series, known: np.ndarray, products: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        found = [space.grams(t) for t in texts]
        sizes = np.array([len(c) for c, _ in found])
        codes = np.concatenate([c for c, _ in found])
        new = np.setdiff1d(codes, known)
        if len(new):
            made = np.concatenate([space.vectors(new[i : i + 1024]).astype(np.float32) @ prototypes.T for i in range(0, len(new), 1024)])
            known, products = np.concatenate([known, new]), np.concatenate([products, made])
            order = np.argsort(known)
            known, products = known[order], products[order]
        counts = np.concatenate([n for _, n in found]).astype(np.float64)
        # Of each text: products with the prototypes, number of n-grams, and squares of their counts.
        each = np.column_stack([products[np.searchsorted(known, codes)] * counts[:, None], counts, counts * counts])
        sums = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0)])
        ends = np.cumsum(sizes)
        told = sums[ends] - sums[ends - sizes]
        product, number, squares = told[:, : len(langs)], told[:, -2], told[:, -1]
        near = np.maximum(product, 0) ** 2
        total = near.sum(axis=1)
        best = near.argmax(axis=1) if langs else np.zeros(len(near), dtype=int)
        score = np.divide(near.max(axis=1, initial=0), total, out=np.zeros(len(near)), where=total > 0)
        pred = [langs[b] if n and langs else "und" for b, n in zip(best, sizes)]
        evidence = np.zeros(len(near))
        if langs:
            own = number * equal[best]
            some = (sizes > 0) & (own > 0)
            evidence[some] = (product[np.arange(len(near)), best] / np.sqrt(space.dimensions * np.maximum(squares, 1)))[some] / np.sqrt(own / (1 + own))[some]
        return pd.DataFrame({"lang_pred": pred, "score": score, "evidence": evidence}), known, products

    @F.pandas_udf("lang_pred string, score double, evidence double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, products = np.zeros(0, dtype=np.int64), np.zeros((0, len(langs)))
        for texts in batches:
            parts = [pd.DataFrame({"lang_pred": pd.Series([], dtype=object), "score": pd.Series([], dtype=float), "evidence": pd.Series([], dtype=float)})]
            for i in range(0, len(texts), _BLOCK):
                out, known, products = judged(texts.iloc[i : i + _BLOCK], known, products)
                parts.append(out)
                if len(known) > 500_000:  # texts in many scripts: start over, so that memory stays bounded
                    known, products = known[:0], products[:0]
            yield pd.concat(parts[1:] or parts, ignore_index=True)

    return predict


def identify(docs: DataFrame, labelled: DataFrame, carry: list[Column], lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """The carried columns with lang_pred, score and evidence for every row of docs."""
    predict = predictor(labelled, lang_column, text_column)
    told = spread(docs).select(*carry, predict(F.col(text_column)).alias("__told"))
    return told.select(*told.columns[:-1], "__told.lang_pred", "__told.score", "__told.evidence")


def keep_known(docs: DataFrame, labelled: DataFrame, least_evidence: float = 0.4, lang_column: str = "lang", text_column: str = "text") -> DataFrame:
    """docs without the rows that are ``und`` or whose evidence is below the bound, as that of texts in no learned language is; columns stay as they are."""
    predict = predictor(labelled, lang_column, text_column)
    told = spread(docs).withColumn("__told", predict(F.col(text_column)))
    return told.where((F.col("__told.lang_pred") != "und") & (F.col("__told.evidence") >= least_evidence)).drop("__told")


def held_out(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op6_hyperdimensional(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, docs.where(~held_out()), carry=[F.col("doc_id"), held_out().alias("held_out")]).drop("evidence")
