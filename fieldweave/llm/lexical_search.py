"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in blocks of up to ``block_docs``: a row for each block and query term, with the places
in the block and the counts packed in arrays. Each term has an owner, the rarest terms the first one. Items go
in bundles of about ``bundle_items``. A bundle visits each block with a sparse accumulator of its items' scores, and
passes the owners one after another; at each one it meets that owner's postings of the block (cogroup), whose
whole-number contributions are added. Behind the last owner each block gives the best of each item, and the
best of all blocks are selected. As rare terms come first, few places are carried until the last owner.

A group is one bundle and one block, so its size does not grow with the table or with a frequent term. Nothing is pruned:
scores are those of all terms over all documents.

Null text has no terms. Documents with a null id count in all statistics but are not ranked; items with a null id are left
out. Ids are whole numbers. Repeated rows of documents are separate documents; rows of one item id are one item whose
terms add up. Equal scores are in ascending order of doc_id. An item without a match has no rows, nor has any over an empty
table. Columns other than ids and texts are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import spread, table, workspace, written

#: The contract's term, and the same over UTF-8 bytes: all beyond ASCII, digits and letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDEX = "block long, term string, n long, total long, a binary, b binary"
_STATE = "bundle int, block long, ids binary, norms binary, items binary, sizes binary, places binary, scores binary"
_FOUND = "item_id long, doc_id long, score long"
_NO_ID = np.iinfo(np.int64).min


def item_terms(items: DataFrame, item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item_id, term and count of every term of every item."""
    lowered = F.translate(F.coalesce(F.col(text_column), F.lit("")), _UPPER, _LOWER)
    terms = items.where(F.col(item_column).isNotNull()).select(F.col(item_column).cast("long").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("count"))


def _marks(terms: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of so many bits with those of the terms' checksums set: of this size however many terms there are."""
    place = F.crc32(F.col("term").cast("binary")) % bits + 1
    rows = terms.select(place.alias("place")).groupBy(F.expr("bitmap_bucket_number(place)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("marks"))
    out, per = np.zeros(bits, dtype=bool), 1 << 15
    for row in rows.collect():
        marked = np.unpackbits(np.frombuffer(row.marks, dtype=np.uint8), bitorder="little")
        at = (row.bucket - 1) * per
        out[at : at + per] = marked[: bits - at]
    return out


def index(docs: DataFrame, terms: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_docs: int = 2048, block_chars: int = 16_000_000, bits: int = 1 << 23) -> DataFrame:
    """Rows of a block: one without a term (documents with a term, all their terms, ids, numbers of terms), and one for each
    of its terms that the bitmap of terms holds (documents, occurrences, places, counts). Some terms may be others than those
    asked for, as the bitmap is of one size; the join with the terms leaves them out."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(terms, bits))
    narrow = spread(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, mask, block = marks.value, bits - 1, TaskContext.get().partitionId() << 32
        ids, sizes, chars, postings = [], [], 0, {}

        def done() -> pa.RecordBatch:
            terms = [t for t, p in postings.items() if p]
            ends = [postings[t] for t in terms]
            counts = np.array(sizes, dtype=np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (len(terms) + 1), pa.int64()),
                    pa.array([None, *[t.decode() for t in terms]], pa.string()),
                    pa.array([int((counts > 0).sum()), *[len(p) // 2 for p in ends]], pa.int64()),
                    pa.array([int(counts.sum(dtype=np.int64)), *[sum(p[1::2]) for p in ends]], pa.int64()),
                    pa.array([np.array(ids, dtype=np.int64).tobytes(), *[np.array(p[::2], dtype=np.uint16).tobytes() for p in ends]], pa.binary()),
                    pa.array([counts.tobytes(), *[np.array(p[1::2], dtype=np.int32).tobytes() for p in ends]], pa.binary()),
                ],
                names=["block", "term", "n", "total", "a", "b"],
            )

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = (text.as_py() or b"").lower()  # of bytes: A to Z only
                found = _TERM_BYTES.findall(raw)
                for term, n in Counter(found).items():
                    own = postings.get(term)
                    if own is None:  # seen for the first time in this block; an empty tuple says that it isn't asked for
                        own = postings[term] = [] if marked[crc32(term) & mask] else ()
                    if own != ():
                        own += (len(ids), n)
                ids.append(_NO_ID if i is None else i)
                sizes.append(len(found))
                chars += len(raw)
                if len(ids) >= block_docs or chars >= block_chars:
                    yield done()
                    block, ids, sizes, chars, postings = block + 1, [], [], 0, {}
        if ids:
            yield done()

    return narrow.mapInArrow(run, _INDEX)


def _array(value, kind) -> np.ndarray:
    return np.frombuffer(value.as_py(), dtype=kind)


def _visit(state: pa.Table, postings: pa.Table) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """ids of the block, and places and scores of each item after this owner's postings are added."""
    ids, norms = _array(state["ids"][0], np.int64), _array(state["norms"][0], np.int64)
    sizes = _array(state["sizes"][0], np.int64)
    cuts = np.cumsum(sizes)[:-1]
    items = _array(state["items"][0], np.int64).tolist()
    held = dict(zip(items, zip(np.split(_array(state["places"][0], np.uint16), cuts), np.split(_array(state["scores"][0], np.int64), cuts)))) if items else {}
    more: dict[int, list] = {}
    for a, b, weight, users in zip(postings["a"], postings["b"], postings["weight"].to_pylist(), postings["users"].to_pylist()):
        places, counts = _array(a, np.uint16), _array(b, np.int32).astype(np.int64)
        gain = weight * (1_000_000_000 * counts // (1000 * counts + norms[places]))
        for user in users:
            more.setdefault(user["item_id"], []).append((places, user["count"] * gain))
    for item, gains in more.items():
        whole = np.zeros(len(ids), dtype=np.int64)
        if item in held:
            whole[held[item][0]] = held[item][1]
        for places, gain in gains:
            whole[places] += gain
        places = np.flatnonzero(whole)
        held[item] = places.astype(np.uint16), whole[places]
    return ids, held


def _carry(key, state: pa.Table, postings: pa.Table) -> pa.Table:
    if not postings.num_rows or not state.num_rows:
        return state
    _, held = _visit(state, postings)
    own = {
        "items": np.array(list(held), dtype=np.int64),
        "sizes": np.array([len(p) for p, _ in held.values()], dtype=np.int64),
        "places": np.concatenate([p for p, _ in held.values()]),
        "scores": np.concatenate([s for _, s in held.values()]),
    }
    for name, value in own.items():
        state = state.set_column(state.schema.get_field_index(name), name, pa.array([value.tobytes()], pa.binary()))
    return state


def _select(top: int):
    def best(key, state: pa.Table, postings: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if state.num_rows:
            ids, held = _visit(state, postings)
            for item, (places, scores) in held.items():
                own = ids[places]
                named = own != _NO_ID
                own, scores = own[named], scores[named]
                order = np.lexsort((own, -scores))[:top]
                order = order[scores[order] > 0]
                for column, values in zip(out, (np.full(len(order), item), own[order], scores[order])):
                    column.append(values)
        return pa.table({n: np.concatenate([np.zeros(0, dtype=np.int64), *c]) for n, c in zip(("item_id", "doc_id", "score"), out)})

    return best


def ranked(docs: DataFrame, items: DataFrame, top: int = 20, owners: int = 4, bundle_items: int = 256, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", **blocks: int) -> DataFrame:
    """item_id, rank, doc_id and score of each item's best documents; blocks are parameters of index()."""
    spark = docs.sparkSession
    with workspace(spark) as result:
        wanted = written(item_terms(items, item_column, item_text_column))
        bundles = max(1, -(-wanted.select("item_id").distinct().count() // bundle_items))
        indexed = written(index(docs, wanted, id_column, text_column, **blocks))
        whole = indexed.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
        found = _found(spark, indexed, wanted, whole.n, whole.total, top, owners, bundles) if whole.n else spark.createDataFrame([], _FOUND)
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
        return result(found.select("item_id", place.alias("rank"), "doc_id", "score").where(F.col("rank") <= top))


def _found(spark: SparkSession, indexed: DataFrame, wanted: DataFrame, n_docs: int, n_terms: int, top: int, owners: int, bundles: int) -> DataFrame:
    """The best of each item in each block, from a corpus of so many documents with so many terms."""
    known = indexed.where("term is not null")
    rarity = F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1))
    most = np.log((2 * n_docs + 2) / 3)
    owner = F.least(F.greatest(F.floor(owners * (1 - rarity / F.lit(float(most)))), F.lit(0)), F.lit(owners - 1)) if most > 0 else F.lit(0)
    weights = known.groupBy("term").agg(F.sum("n").alias("df")).select("term", F.floor(1000 * rarity).alias("weight"), owner.cast("int").alias("owner")).where("weight > 0")
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("int")
    users = wanted.groupBy(bundle.alias("bundle"), "term").agg(F.collect_list(F.struct("item_id", "count")).alias("users"))
    postings = written(known.join(weights.join(users, "term"), "term").select("bundle", "block", "a", "b", "weight", "users", "owner"), by="owner")
    norm = _norms(n_docs, n_terms)
    nothing = F.lit(b"")
    state = indexed.where("term is null").select(F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"), "block", F.col("a").alias("ids"), norm("b").alias("norms"), *[nothing.alias(c) for c in ("items", "sizes", "places", "scores")])
    for owner in range(owners):
        met = state.groupBy("bundle", "block").cogroup(postings.where(F.col("owner") == owner).drop("owner").groupBy("bundle", "block"))
        state = met.applyInArrow(_carry, _STATE) if owner < owners - 1 else met.applyInArrow(_select(top), _FOUND)
    return state


def _norms(n_docs: int, n_terms: int):
    """12 m of each document of a block, from its numbers of terms."""

    @F.arrow_udf("binary")
    def norms(sizes: pa.Array) -> pa.Array:
        m = lambda n: 100 - 25 + (25 * n * n_docs) // n_terms
        return pa.array([(12 * m(_array(s, np.int32).astype(np.int64))).tobytes() for s in sizes], pa.binary())

    return norms


def op11_term_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = rf"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')"
SQL = rf"""
    WITH words AS (SELECT row_number() OVER () AS doc, doc_id, {_SPLIT} AS terms FROM documents),
    sizes AS (SELECT doc, doc_id, len(terms) AS n FROM words WHERE len(terms) > 0),
    whole AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
    asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_SPLIT}) AS term FROM benchmark) GROUP BY ALL),
    places AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM places, whole GROUP BY term, n_docs),
    gains AS (SELECT doc, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // n_terms)))) AS gain FROM places JOIN weights USING (term) JOIN sizes USING (doc), whole),
    scores AS (SELECT item_id, doc, sum(times * gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL HAVING sum(times * gain) > 0),
    placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores JOIN sizes USING (doc))
    SELECT * FROM placed WHERE rank <= 20
"""
