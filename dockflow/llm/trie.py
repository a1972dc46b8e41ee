"""Conversation prefix tree with subtree totals by parallel tree contraction.

Turns are numbered and prefixes hashed as running sums over range-sorted partitions (``running``), so that a conversation of any length spreads over tasks: a prefix's
128-bit key is the sum of the hashes of its turns with their places, and a node's parent is the sum before its last turn.

Totals come from rounds of joins over the tree alone. Compress: every maximal chain of nodes with one child is folded into the node below it, by pointer
doubling; the folded nodes keep what lies between them and that node. Rake: all leaves go, and what they have gathered is added to their
parents. After a compress every inner node has two children or more, so each rake takes at least half of the nodes and the rounds are logarithmic in the tree's size, whatever its
depth. When the root is raked all leaves' totals are known, and the folded nodes get theirs, last round first. Sums over the children of one node are partial aggregates,
joins have one row a node, and lookups of a parent or a chain's end that very many nodes share are salted.

A node's digest of ends is one SHA-256 stream over its sorted ids. Ids are joined to pieces of ENDS where they are sorted, and the pieces of a node pass through one
digest in order, which holds no more than a batch.

Defined cases: a null conv_id names no conversation and its rows are left out; null roles and texts are empty; turns without number come first; rows with equal turns are
ordered by role, then by the hash of their content, and repeated rows are turns of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import looked_up, staged, unstage
from dockflow.llm.spelling import CRC32_SQL

FAMILY = 5
HEADS = 9
#: Ids that are joined to one piece of text before they are digested.
ENDS = 4096
_SUMS = ("leaves", "saved")


def running(df: DataFrame, key: str, order: list[Column], sums: list[str], name: str) -> DataFrame:
    """``df`` with, for each column of ``sums``, its sum over the rows of the same bigint ``key`` up to this one (``sum_``) and before it (``before_``), modulo 2**64.

    Rows are sorted over range partitions, so one key may span any number of them. Every partition but the last passes on its last key's sums; these, at most one row a
    partition, go through the driver.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    at, of, width = df.columns.index(key), [df.columns.index(c) for c in sums], len(df.columns)
    added = [f"{kind}_{c}" for c in sums for kind in ("before", "sum")]
    names = [*df.columns, *added, "part", "tail"]
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), *(f"{c} bigint" for c in added), "part int", "tail boolean"])

    def flagged(columns, last):
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*columns, pa.array((np.arange(n) == n - 1) & last)], names=names)

    def summed(batches):
        part, last, carried, held = TaskContext.get().partitionId(), None, np.zeros(len(of), np.uint64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(at))
            new = np.flatnonzero(np.concatenate([[keys[0] != last], keys[1:] != keys[:-1]]))
            group = np.searchsorted(new, np.arange(len(keys)), "right")
            columns = []
            for j, c in enumerate(of):
                own = np.asarray(batch.column(c)).view(np.uint64)
                total = np.cumsum(own, dtype=np.uint64)
                start = np.concatenate([[np.uint64(0) - carried[j]], (total - own)[new]])
                total = total - start[group]
                columns += [pa.array((total - own).view(np.int64)), pa.array(total.view(np.int64))]
                carried[j] = total[-1]
            last = keys[-1]
            # Only a partition's last row is its tail, so a batch waits for the next one.
            if held is not None:
                yield flagged(held, False)
            held = [*batch.columns, *columns, pa.array(np.full(len(keys), part, np.int32))]
        if held is not None:
            yield flagged(held, True)

    rows = staged(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(summed, schema), name)
    tails = sorted(rows.where("tail").select("part", key, *(f"sum_{c}" for c in sums)).collect())
    offsets, carry = {}, (None, np.zeros(len(sums), np.uint64))
    for part, last, *total in tails:
        if carry[0] is not None:
            offsets[part] = carry
        total = np.array(total, np.int64).view(np.uint64)
        carry = (last, total + carry[1] if carry[0] == last else total)

    def shifted(batches):
        for batch in batches:
            parts, keys, columns = np.asarray(batch.column(width + len(added))), np.asarray(batch.column(at)), list(batch.columns)
            for part in np.unique(parts):
                if int(part) not in offsets:
                    continue
                last, more = offsets[int(part)]
                use = (parts == part) & (keys == last)
                for j in range(len(added)):
                    value = np.asarray(columns[width + j]).view(np.uint64).copy()
                    value[use] += more[j // 2]
                    columns[width + j] = pa.array(value.view(np.int64))
            yield pa.RecordBatch.from_arrays(columns[:-2], names=names[:-2])

    return rows.mapInArrow(shifted, schema.rsplit(", ", 2)[0])


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, a, b, bytes, one): a turn's 128-bit hash and its text's length."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    hashes = [F.xxhash64(F.lit(seed), role, text).alias(c) for seed, c in ((1, "a"), (2, "b"))]
    row = [F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), role.alias("role"), *hashes, F.octet_length(text).cast("bigint").alias("bytes")]
    return conversations.where("conv_id IS NOT NULL").select(*row, F.lit(1).cast("bigint").alias("one"))


def rebuilt(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Staged turns (conv_id, depth, a, b, bytes, last) and conversations (conv_id, turns) after every one took its family's head."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")]
    placed = running(staged(_turns(conversations), "turns"), "conv_id", order, ["one"], "placed").withColumnRenamed("sum_one", "place")
    own = placed.groupBy("conv_id").agg(F.count("*").alias("n_own"))
    base = F.col("conv_id") - F.col("conv_id") % family
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = staged(own.select("conv_id", "n_own", base.alias("base"), taken.alias("taken")), "conversations")
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    head = F.least("taken", F.coalesce("n_base", F.lit(0).cast("bigint")))
    length = F.col("head") + F.greatest(F.col("n_own") - F.col("taken"), F.lit(0).cast("bigint"))
    convs = staged(convs.join(sizes, "base", "left").withColumn("head", head).withColumn("turns", length).drop("n_base"), "conversations")
    row = ["conv_id", "depth", "a", "b", "bytes", (F.col("depth") == F.col("turns")).alias("last")]
    first = placed.where(F.col("place") < heads).select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "a", "b", "bytes")
    copied = first.join(convs, "base").where(F.col("depth") <= F.col("head")).select(row)
    total = convs.agg(F.coalesce(F.sum("n_own"), F.lit(0))).first()[0]
    kept = looked_up(placed.select("conv_id", "place", "a", "b", "bytes"), convs, "conv_id", "n_own", total, ["place"], "inner").where("place > taken")
    moved = kept.withColumn("depth", F.col("place") - F.col("taken") + F.col("head")).select(row)
    return copied.unionByName(moved), convs.select("conv_id", "turns")


def _node(a: str, b: str) -> Column:
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


_ROOT = "named_struct('a', 0L, 'b', 0L)"


def paths(turns: DataFrame) -> DataFrame:
    """Staged (conv_id, depth, node, parent, bytes, last): the node of every rebuilt turn."""
    keyed = [F.xxhash64(F.lit(seed), F.col("a"), F.col("b"), F.col("depth")).alias(c) for seed, c in ((3, "x"), (4, "y"))]
    sums = running(turns.select("conv_id", "depth", "bytes", "last", *keyed), "conv_id", [F.col("depth")], ["x", "y"], "prefixes")
    return staged(sums.select("conv_id", "depth", _node("sum_x", "sum_y").alias("node"), _node("before_x", "before_y").alias("parent"), "bytes", "last"), "paths")


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): the digest of a node's ids in ascending order, joined by commas."""

    def joined(batches):
        for batch in batches:
            a, b, ids = (np.asarray(batch.column(i)) for i in range(3))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            starts = sorted({*np.flatnonzero(new).tolist(), *range(0, len(a), ENDS)})
            texts = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(starts, [*starts[1:], len(a)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(v[starts]) for v in (a, b, ids)), pa.array(texts, pa.string())], names=["a", "b", "first", "ids"])

    def digested(batches):
        node, sha = None, None
        for batch in batches:
            out = []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (a, b) != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (a, b), hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            yield _digests(out)
        if node is not None:
            yield _digests([(*node, sha.hexdigest())])

    flat = ends.select("node.a", "node.b", "conv_id").repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    pieces = flat.mapInArrow(joined, "a bigint, b bigint, first bigint, ids string").repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return pieces.mapInArrow(digested, "a bigint, b bigint, ends_sha256 string").select(_node("a", "b").alias("node"), "ends_sha256")


def _digests(rows: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["a", "b", "ends_sha256"])


def _children(tree: DataFrame) -> DataFrame:
    """(node, n, only): how many children every inner node has, and one of them with what lies between it and the node."""
    only = F.min(F.struct("node", *(f"up_{c}" for c in _SUMS))).alias("only")
    return tree.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n"), only).withColumnRenamed("of", "node")


def _folded(tree: DataFrame) -> DataFrame:
    """Staged (node, depth, parent, end, leaves, saved, up_*) of all nodes with one child but the root: the node below their chain, and the sums on the way there."""
    single = tree.where("parent IS NOT NULL").join(_children(tree).where("n = 1"), "node")
    sums = [(F.col(c) + F.col(f"only.up_{c}")).alias(c) for c in _SUMS]
    row = ["node", "depth", "parent", "end", *_SUMS, *(f"up_{c}" for c in _SUMS), "open"]
    now = staged(single.select("node", "depth", "parent", F.col("only.node").alias("end"), *sums, *(f"up_{c}" for c in _SUMS), F.lit(True).alias("open")), "chains")
    while not now.where("open").isEmpty():
        below = now.select(F.col("node").alias("end"), F.col("end").alias("next"), *(F.col(c).alias(f"more_{c}") for c in _SUMS), F.col("open").alias("further"))
        more = [(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0).cast("bigint"))).alias(c) for c in _SUMS]
        jumped = now.where("open").drop("open").join(below, "end", "left").withColumns({c: m for c, m in zip(_SUMS, more, strict=True)})
        jumped = jumped.withColumn("end", F.coalesce("next", "end")).withColumn("open", F.coalesce("further", F.lit(False))).select(row)
        after = staged(jumped.unionByName(now.where("NOT open").select(row)), "chains")
        unstage(now)
        now = after
    return now


def totals(tree: DataFrame) -> DataFrame:
    """(node, leaves, saved): the sums over every node's subtree, of (node, depth, parent, leaves, saved); the root's parent is null."""
    zero = [F.lit(0).cast("bigint").alias(f"up_{c}") for c in _SUMS]
    now = staged(tree.select("node", "depth", "parent", *_SUMS, *zero), "tree")
    raked, chains = [], []
    while not now.isEmpty():
        folded = _folded(now)
        top = F.min(F.struct("depth", "parent", *((F.col(c) + F.col(f"up_{c}")).alias(c) for c in _SUMS))).alias("top")
        tops = folded.groupBy(F.col("end").alias("node")).agg(top)
        kept = now.join(folded.select("node"), "node", "left_anti").join(tops, "node", "left")
        up = [F.coalesce(F.col(f"top.{c}"), F.col(f"up_{c}")).alias(f"up_{c}") for c in _SUMS]
        short = staged(kept.select("node", "depth", F.coalesce("top.parent", "parent").alias("parent"), *_SUMS, *up), "tree")
        unstage(now)
        inner = short.where("parent IS NOT NULL").groupBy("parent").count().select(F.col("parent").alias("node"))
        leaves = staged(short.join(inner, "node", "left_anti"), "leaves")
        gains = leaves.groupBy(F.col("parent").alias("node")).agg(*(F.sum(F.col(c) + F.col(f"up_{c}")).alias(f"more_{c}") for c in _SUMS))
        rest = short.join(leaves.select("node"), "node", "left_anti").join(gains, "node", "left")
        more = [(F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0).cast("bigint"))).alias(c) for c in _SUMS]
        now = staged(rest.select("node", "depth", "parent", *more, *(f"up_{c}" for c in _SUMS)), "tree")
        unstage(short)
        raked.append(leaves.select("node", *_SUMS))
        chains.append(folded)
    unstage(now)
    found = raked[0] if raked else tree.select("node", *_SUMS)
    for part in raked[1:]:
        found = found.unionByName(part)
    for folded in reversed(chains):
        if folded.isEmpty():
            continue
        sizes = folded.groupBy("end").agg(F.count("*").alias("size"))
        ends = found.select(F.col("node").alias("end"), *(F.col(c).alias(f"more_{c}") for c in _SUMS)).join(sizes, "end")
        whole = looked_up(folded.select("node", "end", *_SUMS), ends, "end", "size", folded.count(), ["node"], "inner")
        found = found.unionByName(staged(whole.select("node", *((F.col(c) + F.col(f"more_{c}")).alias(c) for c in _SUMS)), "expanded"))
    return found


def prefix_tree(conversations: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations, family, heads)
    rows = paths(turns)
    at_root = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.expr(_ROOT).alias("node"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("bigint").alias("bytes"))
    every = rows.select(at_root.columns).unionByName(at_root)
    firsts = [F.min(c).alias(c) for c in ("depth", "conv_id", "parent", "bytes")]
    nodes = staged(every.groupBy("node").agg(*firsts, F.count("*").alias("n_convs")), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children")).withColumnRenamed("of", "node")
    nodes = staged(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "nodes")
    own = [(F.col("n_children") == 0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")]
    sums = totals(nodes.select("node", "depth", "parent", *own))
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    named = looked_up(nodes, above, "parent", "size", nodes.count(), ["node"])
    ends = rows.where("last").select("node", "conv_id").unionByName(convs.where("turns = 0").select(F.expr(_ROOT).alias("node"), "conv_id"))
    out = named.join(sums, "node").join(end_digests(ends), "node", "left")
    digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), digest)


_DIGITS = "list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: unicode(ch)::BIGINT)"

ORACLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {CRC32_SQL.format(bytes=_DIGITS)} % 9 AS h, count(*) AS n FROM t GROUP BY conv_id),
s AS (SELECT c.*, least(h, coalesce((SELECT b.n FROM c b WHERE b.conv_id = c.base), 0)) AS head FROM c),
rebuilt AS (
  SELECT s.conv_id, place AS depth, role, text FROM s JOIN t ON t.conv_id = s.base AND place <= h
  UNION ALL SELECT s.conv_id, place - h + head, role, text FROM s JOIN t ON t.conv_id = s.conv_id AND place > h),
path AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS node, NULL::VARCHAR AS parent, 0::BIGINT AS bytes FROM s
  UNION ALL
  SELECT p.conv_id, r.depth::BIGINT, sha256(p.node || strlen(r.role) || ':' || r.role || r.text), p.node, strlen(r.text)
  FROM path p JOIN rebuilt r ON r.conv_id = p.conv_id AND r.depth = p.depth + 1),
nodes AS (SELECT node, min(depth) AS depth, min(parent) AS parent, min(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs FROM path GROUP BY node),
children AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT p.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens
  FROM nodes n LEFT JOIN children k ON k.node = n.node JOIN path p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.node),
ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest
  FROM (SELECT * FROM path QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1) GROUP BY node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.node = n.parent LEFT JOIN children k ON k.node = n.node JOIN sums s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
