"""Conversation prefix trie by composable monoid fingerprints.

Every conversation is rebuilt: the first turns of its base conversation (the head), then its own turns behind as many. Rebuilt
texts are never made. A turn is known by its reference, the SHA-256 of its role and text, which stands for two numbers; a
sequence of turns has the product of its turns, (value, power) with (a, p)(b, q) = (a q + b, p q) modulo 2^64 in two lanes.
Products of parts give that of the whole, so a prefix of a rebuilt conversation is the product of a head's
prefix and of a segment of the conversation's own turns, which is taken from two prefixes of it.

Products along a conversation are a distributed prefix sum: turns are dealt by ranges of (conversation, turn), each task
multiplies within its range, and what ranges before it hold of the same conversation comes in by one more product.
No conversation has to fit in a task, however long. Prefixes of one depth and fingerprint are a node. Equality
is verified by references: all members of a node must have the same last turn, which with their
parents (verified alike, one level up) makes the whole prefixes equal. Should a node fail that, all is multiplied anew by other factors.

What a node sums over its subtree is gathered by doubling: each round adds the sums of descendants twice as far away, so rounds
grow with the logarithm of the depth. Ids of conversations that end at a node are joined in chunks of 4096 neighbouring
ids and hashed as a stream, chunk by chunk; SHA-256 takes a node's chunks one after another.

Rows with a null conv_id are left out. Turns of a conversation are ordered by turn, nulls first; ties are ordered by
their references. Repeated rows are turns of their own. Null role and text are empty. Remainders of negative ids are negative or
0, as in SQL. An empty table gives no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm.common import shuffle_partitions, table, workspace, written

FAMILY = 100  # conversations c - c % FAMILY up to the next one share a base
HEADS = 6  # heads have fewer turns than this
_CHUNK_BITS = 12
_STEPS = "part int, conv long, local long, ref binary, chars long, v1 long, v2 long"
_NODE = ("depth", "v1", "v2")
_VALUES = "v1 long, v2 long"
_NONE = hashlib.sha256(b"").hexdigest()


class Products:
    """Powers of the two factors modulo 2^bits; values are pairs of unsigned numbers, a row each."""

    def __init__(self, attempt: int = 0, bits: int = 64):
        draw = np.random.default_rng([13, attempt]).integers(0, 1 << 63, 2)
        factor = [int(x) * 8 + 5 & (1 << 64) - 1 for x in draw]  # 5 modulo 8: of the greatest order
        self.factor = np.array(factor, dtype=np.uint64)
        self.inverse = np.array([pow(f, -1, 1 << 64) for f in factor], dtype=np.uint64)
        self.mask = np.uint64((1 << bits) - 1)

    def power(self, n: np.ndarray, inverse: bool = False) -> np.ndarray:
        out, square, n = np.ones((len(n), 2), dtype=np.uint64), self.inverse if inverse else self.factor, n.astype(np.uint64)
        while n.any():
            odd = (n & np.uint64(1)).astype(bool)
            out[odd] *= square
            square, n = square * square, n >> np.uint64(1)
        return out

    def turns(self, refs: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """What turns stand for, from their references of 32 bytes."""
        whole = np.frombuffer(b"".join(refs.to_pylist()), dtype=np.uint64).reshape(-1, 4)
        return whole[:, :2] & self.mask

    def along(self, turns: np.ndarray, first: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Products from each run's start to each turn; first: where runs start, before: what the first run continues."""
        at = np.arange(len(turns))
        up = self.power(at)
        sums = np.zeros((len(turns) + 1, 2), dtype=np.uint64)
        np.cumsum(turns * self.power(at, inverse=True), axis=0, out=sums[1:])
        starts = np.maximum.accumulate(np.where(first, at, 0))
        out = (sums[1:] - sums[starts]) * up
        goes_on = np.cumsum(first) == 0
        out[goes_on] += before * self.power(at[goes_on] + 1)
        return out & self.mask


def _signed(values: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(values[:, i]).view(np.int64)) for i in (0, 1)]


def _unsigned(one: pa.Array, two: pa.Array) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).view(np.uint64) for c in (one, two)], axis=1)


def _composed(products: Products):
    """(left - less) times the power of n, plus right: the product of a sequence and another one of n turns."""

    @F.arrow_udf(f"struct<{_VALUES.replace(' ', ':')}>".replace(",:", ","))
    def composed(l1: pa.Array, l2: pa.Array, s1: pa.Array, s2: pa.Array, r1: pa.Array, r2: pa.Array, n: pa.Array) -> pa.Array:
        out = (_unsigned(l1, l2) - _unsigned(s1, s2)) * products.power(n.to_numpy(zero_copy_only=False)) + _unsigned(r1, r2)
        return pa.StructArray.from_arrays(_signed(out & products.mask), names=["v1", "v2"])

    return composed


def _shortened(products: Products):
    """The product without its last turn."""

    @F.arrow_udf(f"struct<{_VALUES.replace(' ', ':')}>".replace(",:", ","))
    def shortened(v1: pa.Array, v2: pa.Array, refs: pa.Array) -> pa.Array:
        out = (_unsigned(v1, v2) - products.turns(refs)) * products.inverse
        return pa.StructArray.from_arrays(_signed(out & products.mask), names=["v1", "v2"])

    return shortened


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv, turn, ref and chars (code points of the text) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    ref = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    given = conversations.where("conv_id IS NOT NULL")
    return given.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), ref.alias("ref"), F.char_length(text).cast("long").alias("chars"))


def prefixes(turns: DataFrame, products: Products) -> DataFrame:
    """conv, pos (from 0), ref, chars and the product of the conversation's turns up to this one."""
    order = ["conv", F.col("turn").asc_nulls_first(), "ref", "tie"]
    dealt = turns.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, local, before = TaskContext.get().partitionId(), None, -1, np.zeros(2, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv").to_numpy()
            first = np.concatenate([[last is None or conv[0] != last], conv[1:] != conv[:-1]])
            at = np.arange(len(conv))
            starts = np.maximum.accumulate(np.where(first, at, -1))
            place = np.where(starts < 0, at + local + 1, at - starts)
            values = products.along(products.turns(batch.column("ref")), first, before)
            last, local, before = conv[-1], place[-1], values[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), part, dtype=np.int32)), batch.column("conv"), pa.array(place), batch.column("ref"), batch.column("chars"), *_signed(values)], names=[c.split()[0] for c in _STEPS.split(", ")])

    steps = written(dealt.select("conv", "ref", "chars").mapInArrow(run, _STEPS))
    ranges = steps.groupBy("conv", "part").agg(F.max_by(F.struct((F.col("local") + 1).alias("n"), "v1", "v2"), "local").alias("end"))
    # Conversations that go over from one range to the next: at most one for each range.
    split = ranges.groupBy("conv").agg(F.collect_list(F.struct("part", "end")).alias("ends")).where(F.size("ends") > 1).collect()
    carried = []
    for row in split:
        n, value = 0, np.zeros((1, 2), dtype=np.uint64)
        for e in sorted(row.ends, key=lambda e: e.part):
            carried.append((row.conv, e.part, n, *(int(x) for x in value.view(np.int64)[0])))
            value = (value * products.power(np.array([e.end.n])) + np.array([[e.end.v1, e.end.v2]], dtype=np.int64).view(np.uint64)) & products.mask
            n += e.end.n
    if not carried:
        return steps.select("conv", F.col("local").alias("pos"), "ref", "chars", "v1", "v2")
    before = turns.sparkSession.createDataFrame(carried, "conv long, part int, n long, b1 long, b2 long")
    both = steps.join(F.broadcast(before), ["conv", "part"], "left").na.fill(0, ["n", "b1", "b2"])
    zero = F.lit(0).cast("long")
    whole = _composed(products)("b1", "b2", zero, zero, "v1", "v2", F.col("local") + 1)
    return both.select("conv", (F.col("local") + F.col("n")).alias("pos"), "ref", "chars", whole.alias("v")).select("conv", "pos", "ref", "chars", "v.*")


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def members(steps: DataFrame, products: Products) -> DataFrame:
    """A row for each depth of each rebuilt conversation: conv, depth, v1, v2, ref and chars of its last turn, and whether it ends there."""
    zero = F.lit(0).cast("long")
    own = F.struct("v1", "v2")
    none = F.struct(zero.alias("v1"), zero.alias("v2"))
    convs = steps.withColumn("h", head_length(F.col("conv"))).groupBy("conv", "h").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("pos") == F.col("h") - 1, own)).alias("skipped"))
    heads = steps.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < HEADS - 1)).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(F.struct("pos", "ref", "chars", "v1", "v2"))).alias("head"))
    taken = F.when(F.col("head").isNull(), F.lit(0)).otherwise(F.least(F.size("head"), F.col("h").cast("int")))
    based = convs.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(heads, "base", "left").withColumn("taken", taken)
    length = F.col("taken") + F.greatest(F.col("n") - F.col("h"), zero)
    end = F.get("head", F.col("taken") - 1)
    info = written(based.select("conv", "h", "taken", length.alias("length"), F.coalesce("skipped", none).alias("skipped"), F.when(F.col("taken") > 0, F.struct(end["v1"].alias("v1"), end["v2"].alias("v2"))).otherwise(none).alias("joined"), F.slice("head", 1, F.greatest("taken", F.lit(0))).alias("head")))
    root = info.select("conv", zero.alias("depth"), zero.alias("v1"), zero.alias("v2"), F.lit(None).cast("binary").alias("ref"), zero.alias("chars"), (F.col("length") == 0).alias("ends"))
    in_head = info.where("taken > 0").select("conv", "length", F.explode("head").alias("t"))
    in_head = in_head.select("conv", (F.col("t.pos") + 1).alias("depth"), "t.v1", "t.v2", "t.ref", "t.chars", (F.col("t.pos") + 1 == F.col("length")).alias("ends"))
    behind = steps.join(info.drop("head"), "conv").where("pos >= h")
    n = F.col("pos") - F.col("h") + 1
    value = _composed(products)("joined.v1", "joined.v2", "skipped.v1", "skipped.v2", "v1", "v2", n)
    behind = behind.select("conv", (F.col("taken") + n).alias("depth"), value.alias("v"), "ref", "chars", (F.col("taken") + n == F.col("length")).alias("ends"))
    return root.union(in_head).union(behind.select("conv", "depth", "v.v1", "v.v2", "ref", "chars", "ends"))


def grouped(rows: DataFrame) -> DataFrame:
    """The nodes: conv_id, n_convs, and the last turn's reference (least and greatest, which must be equal) and length."""
    return rows.groupBy(*_NODE).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("ref").alias("ref"), F.max("ref").alias("other"), F.max("chars").alias("chars"))


def ends_hashed(rows: DataFrame) -> DataFrame:
    """ends_sha256 of the nodes at which conversations end."""
    chunk = F.shiftright("conv", _CHUNK_BITS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = rows.where("ends").groupBy(*_NODE, chunk.alias("chunk")).agg(ids.alias("ids"))
    sorted_ = chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        done = lambda found: pa.RecordBatch.from_pylist([{**dict(zip(_NODE, n)), "ends_sha256": s} for n, s in found], schema=schema)
        for batch in batches:
            found = []
            for own, ids in zip(zip(*(batch.column(c).to_pylist() for c in _NODE)), batch.column("ids")):
                if own != node:
                    if node is not None:
                        found.append((node, state.hexdigest()))
                    node, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield done(found)
        if node is not None:
            yield done([(node, state.hexdigest())])

    schema = pa.schema([(c, pa.int64()) for c in _NODE] + [("ends_sha256", pa.string())])
    return sorted_.select(*_NODE, "ids").mapInArrow(run, "depth long, v1 long, v2 long, ends_sha256 string")


def summed(nodes: DataFrame, deepest: int, sums: list[str]) -> DataFrame:
    """nodes (conv_id, depth, parent_conv_id) below the root, with each of sums added up over the node's subtree."""
    trees = nodes.select("conv_id", "depth", F.when(F.col("depth") > 1, F.col("parent_conv_id")).alias("up"), *sums)
    far = 1
    while far < deepest:
        trees = written(trees)
        gains = trees.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), (F.col("depth") - far).alias("depth")).agg(*[F.sum(s).alias(f"more_{s}") for s in sums])
        above = trees.select(F.col("conv_id").alias("up"), (F.col("depth") + far).alias("depth"), F.col("up").alias("further"))
        trees = trees.join(gains, ["conv_id", "depth"], "left").join(above, ["up", "depth"], "left")
        trees = trees.select("conv_id", "depth", F.col("further").alias("up"), *[(F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums])
        far *= 2
    return trees.select("conv_id", "depth", *sums)


def trie(conversations: DataFrame, attempts: int = 4, bits: int = 64) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node. bits is of the first attempt only."""
    spark = conversations.sparkSession
    with workspace(spark) as result:
        turns = turn_rows(conversations)
        for attempt in range(attempts):
            products = Products(attempt, 64 if attempt else bits)
            rows = written(members(written(prefixes(turns, products)), products))
            groups = written(grouped(rows))
            if groups.where("ref <> other").isEmpty():
                break
        else:
            raise RuntimeError(f"different prefixes had equal fingerprints {attempts} times")
        deepest = groups.agg(F.max("depth")).first()[0] or 0
        parent = _shortened(products)("v1", "v2", "ref")
        below = groups.where("depth > 0").withColumn("p", parent).select(*_NODE, "conv_id", "n_convs", "chars", (F.col("depth") - 1).alias("p_depth"), F.col("p.v1").alias("p1"), F.col("p.v2").alias("p2"))
        above = groups.select(F.col("depth").alias("p_depth"), F.col("v1").alias("p1"), F.col("v2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
        below = written(below.join(above, ["p_depth", "p1", "p2"]).drop("p_depth", "p1", "p2"))
        children = below.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = groups.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*below.columns).union(below)
        nodes = nodes.join(ends_hashed(rows), list(_NODE), "left").join(children, ["conv_id", "depth"], "left").na.fill(0, ["n_children"]).na.fill(_NONE, ["ends_sha256"])
        nodes = written(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}))
        sums = ["n_leaves", "saved_tokens"]
        root = nodes.groupBy().agg(F.min("conv_id").alias("conv_id"), F.lit(0).cast("long").alias("depth"), *[F.sum(s).alias(s) for s in sums]).where("conv_id IS NOT NULL")
        trees = root.union(summed(nodes.where("depth > 0"), deepest, sums))
        return result(nodes.drop(*sums).join(trees, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


#: DuckDB has no CRC-32: that of the decimal digits, bit by bit.
_CRC = "xor(list_reduce(list_transform(string_split(conv::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295), 4294967295)"
SQL = f"""
    WITH given AS (SELECT conv_id AS conv, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS ref, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
    turns AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, ref) AS pos FROM given),
    convs AS (SELECT conv, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv FROM turns)),
    joined AS (
        SELECT c.conv, 0 AS part, pos, ref, chars FROM convs c JOIN turns t ON t.conv = c.conv - c.conv % {FAMILY} AND pos <= h
        UNION ALL SELECT c.conv, 1, pos, ref, chars FROM convs c JOIN turns t ON t.conv = c.conv AND pos > h),
    steps AS (SELECT conv, row_number() OVER w AS depth, sha256(string_agg(ref, ' ') OVER w) AS node, chars FROM joined WINDOW w AS (PARTITION BY conv ORDER BY part, pos)),
    rebuilt AS (SELECT conv, 0 AS depth, '' AS node, 0 AS chars FROM convs UNION ALL SELECT * FROM steps),
    members AS (SELECT *, lag(node) OVER (PARTITION BY conv ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv) AS ends FROM rebuilt),
    nodes AS (SELECT node, any_value(parent) AS parent, any_value(depth) AS depth, min(conv) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv::VARCHAR, ',' ORDER BY conv) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY node),
    told AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS n_children FROM nodes n LEFT JOIN nodes p ON p.node = n.parent),
    trees AS (SELECT m.node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * t.chars)::BIGINT AS saved_tokens FROM told t JOIN members m ON m.conv = t.conv_id AND m.depth <= t.depth GROUP BY m.node)
    SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM told JOIN trees USING (node)
"""
