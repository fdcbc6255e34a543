"""Packing documents into token sequences by vector best-fit.

Documents become token ids with an end id behind them; those longer than a sequence are cut into full
pieces, the first piece taking what is left over. A sequence has three capacities: tokens, documents
and attention cost (the sum of squared piece lengths). Pieces are placed longest first; each goes into
the open sequence that fits under every capacity and is left with the smallest weighted norm of
residual capacities, or else into a new one.

What a piece asks of a sequence depends on its length only, and there are at most ``capacity``
lengths. So best-fit runs over the counts of lengths, places equal pieces into equal sequences many
at a time, and gives a plan of some thousand lines whatever the size of the corpus. Pieces are then
numbered within their length (in salted parts, as one length may be very common) and find their place
in the plan by a join on length and number.

Null text counts as empty: such a document is its end id alone. Null ids and repeated rows are packed
as documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldweave.llm.common import cut, shuffle_partitions, spread, table


class ByteTokenizer:
    """Ids as the tokenizers library gives them for a byte-level file.

    The same vocabulary as ranks gives the same ids several times faster; it is used for texts of
    characters whose classes all Unicode versions agree on, the library itself for all others.
    """

    _rare = re.compile("[^\t\n\r -~\x85\xa0-ɏ‐-‧‰-⁞₠-₿]")

    def __init__(self, name: str = "byte_bpe_50k"):
        self.library = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.ranked = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> list[int]:
        if self._rare.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.ranked.encode(text, allowed_special="all")


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 and, with keep_ids, ids."""
    narrow = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    columns = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = ByteTokenizer()
        for batch in batches:
            rows = []
            for i, text in zip(batch["id"], batch["text"]):
                ids = np.array([*tokenizer.ids(text or ""), end_id], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if piece else 0
                    part = ids[start:stop]
                    row = (i, piece, start, len(part), zlib.crc32(part.tobytes()))
                    rows.append((*row, part.astype("int64")) if keep_ids else row)
            yield pd.DataFrame(rows, columns=columns)

    kinds = f"id {dict(narrow.dtypes)['id']}, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")
    return spread(narrow).mapInPandas(run, kinds)


@dataclass
class _Open:
    """Equal sequences, numbered from first."""

    first: int
    many: int
    tokens: int
    documents: int
    attention: int


def best_fit(counts: dict[int, int], capacity: int = 1024, most_documents: int = 1024, most_attention: int = 1024 * 1024, weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)) -> list[tuple[int, int, int, int, int, int]]:
    """Lines (length, number_from, number_to, sequence, sequences, offset).

    Piece number k of a length, number_from <= k < number_to, goes to sequence + (k - number_from) %
    sequences, behind offset tokens and (k - number_from) // sequences pieces of its own length.
    """
    lines, opened, sequences = [], [], 0
    at_most = (capacity, most_documents, most_attention)
    lengths = sorted(counts, reverse=True)
    for place, length in enumerate(lengths):
        left, number = counts[length], 0
        if length > capacity or length * length > most_attention:
            raise ValueError(f"no sequence can hold a piece of {length} tokens")

        def fits(s: _Open) -> int:
            return min(s.tokens // length, s.documents, s.attention // (length * length))

        def residual(s: _Open) -> float:
            rest = (s.tokens - length, s.documents - 1, s.attention - length * length)
            return sum(w * (r / m) ** 2 for w, r, m in zip(weights, rest, at_most))

        while left:
            chosen = min((s for s in opened if fits(s)), key=lambda s: (residual(s), s.first), default=None)
            if chosen is None:
                new = _Open(sequences, 0, *at_most)
                new.many = -(-left // fits(new))
                sequences += new.many
                opened.append(new)
                chosen = new
            each = fits(chosen)
            if left < each:  # the last ones go into one sequence
                each, used = left, 1
            else:
                used = min(chosen.many, left // each)
            lines.append((length, number, number + each * used, chosen.first, used, capacity - chosen.tokens))
            opened.append(_Open(chosen.first, used, chosen.tokens - each * length, chosen.documents - each, chosen.attention - each * length * length))
            chosen.first, chosen.many = chosen.first + used, chosen.many - used
            number, left = number + each * used, left - each * used
            opened = [s for s in opened if s.many]
        least = lengths[-1] if place + 1 < len(lengths) else capacity + 1
        opened = [s for s in opened if s.tokens >= least and s.documents]
    return lines


def pack(cut_pieces: DataFrame, capacity: int = 1024, most_documents: int = 1024, most_attention: int = 1024 * 1024, weights: tuple[float, float, float] = (1.0, 1e-4, 1e-4)) -> DataFrame:
    """The pieces with sequence_id and offset. cut_pieces must give the same rows when read again."""
    spark = cut_pieces.sparkSession
    salts = 2 * shuffle_partitions(spark)
    order = [c for c in ("id", "piece", "start", "ids_crc32") if c in cut_pieces.columns]
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    by_part = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    plan = spark.createDataFrame(best_fit(counts, capacity, most_documents, most_attention, weights), "length long, number_from long, number_to long, sequence long, sequences long, before long")
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("numbers_before"))
    numbered = salted.withColumn("number", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1).join(offsets, ["length", "salt"]).withColumn("number", F.col("number") + F.col("numbers_before"))
    spot = F.col("number") - F.col("number_from")
    inside = (numbered["length"] == plan["length"]) & (F.col("number") >= F.col("number_from")) & (F.col("number") < F.col("number_to"))
    return numbered.join(F.broadcast(plan), inside).select(
        *[numbered[c] for c in cut_pieces.columns],
        (F.col("sequence") + spot % F.col("sequences")).alias("sequence_id"),
        (F.col("before") + F.floor(spot / F.col("sequences")) * numbered["length"]).alias("offset"),
    )


def packed(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return pack(cut(pieces(docs, capacity, end_id, id_column, text_column)), capacity).withColumnRenamed("id", id_column)


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
