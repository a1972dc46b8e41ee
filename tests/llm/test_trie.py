"""The prefix tree against a plain tree of tuples, and its running sums and totals by themselves."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dockflow.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def rows():
    rng = random.Random(7)
    out = []
    for c in [*range(40), -3, 100, 101, 104, 207, 10**12 + 3]:
        for t in range(rng.randint(1, 12)):
            out.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "héllo", "yes", ""])))
    out += [(300 + i, t, "user", "same") for i in range(60) for t in range(3)]
    out += [(501, t, "user", f"long {t // 2}") for t in range(700)]
    # Without numbers, roles or texts; ties by role; rows that repeat.
    out += [(600, None, None, None), (600, None, "a", "x"), (600, 1, "b", "y"), (600, 1, "a", "z"), (605, 2, "r", "t"), (605, 2, "r", "t")]
    return out + [(None, 0, "user", "nobody's"), (None, None, None, None)]


def expected(of, family=5, heads=9):
    convs = {}
    for c, t, r, x in of:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda v: v[:3])] for c, v in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % heads
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    out = []
    for node, of_node in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in of_node if made[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(of_node), len(node), parent, len(of_node), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(spark, of):
    return spark.createDataFrame(of, SCHEMA).repartition(5).selectExpr("*", "1 AS node", "'x' AS place", "2 AS size", "3 AS a", "4 AS depth")


def test_tree(spark):
    got = sorted((tuple(r) for r in trie.prefix_tree(table(spark, rows())).collect()), key=repr)
    assert got == expected(rows())


def test_empty_table(spark):
    assert trie.prefix_tree(table(spark, [])).count() == 0
    assert trie.prefix_tree(table(spark, [(None, 1, "r", "t")])).count() == 0


def test_only_root(spark):
    # Conversation 1's head is its base's, which does not exist; its own turn is within that head.
    assert zlib.crc32(b"1") % 9 >= 1
    got = [tuple(r) for r in trie.prefix_tree(table(spark, [(1, 0, "user", "gone")])).collect()]
    assert got == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]


def test_running_sums_of_one_key_over_many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        values = [(k, i, (1 << 62) + i) for k, n in ((1, 900), (2, 3), (5, 1)) for i in range(n)]
        df = spark.createDataFrame(values, "k bigint, i bigint, v bigint").repartition(7)
        got = {(r.k, r.i): (r.before_v, r.sum_v) for r in trie.running(df, "k", [F.col("i")], ["v"], "t").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    total, signed = {}, lambda v: v - (1 << 64) if v >= 1 << 63 else v
    for k, i, v in values:
        before = total.get(k, 0)
        total[k] = (before + v) % (1 << 64)
        assert got[k, i] == (signed(before), signed(total[k]))


@pytest.mark.parametrize("shape", ["chain", "comb", "random"])
def test_totals(spark, shape):
    rng = random.Random(2)
    n = 80
    parent = {
        "chain": lambda i: i - 1, "star": lambda i: 0, "comb": lambda i: i - 1 if i % 2 else max(0, i - 2), "random": lambda i: rng.randrange(i),
    }[shape]
    up = [None] + [parent(i) for i in range(1, n)]
    depth, leaves, saved = [0] * n, [1] * n, [i * 7 % 11 for i in range(n)]
    inner = {p for p in up if p is not None}
    for i in range(n):
        depth[i] = depth[up[i]] + 1 if i else 0
        leaves[i] = int(i not in inner)
    tree = spark.createDataFrame([(i, d, p, x, s) for i, (d, p, x, s) in enumerate(zip(depth, up, leaves, saved, strict=True))], "node bigint, depth bigint, parent bigint, leaves bigint, saved bigint")
    for i in range(n - 1, 0, -1):
        leaves[up[i]] += leaves[i]
        saved[up[i]] += saved[i]
    got = {r.node: (r.leaves, r.saved) for r in trie.totals(tree).collect()}
    assert got == {i: (leaves[i], saved[i]) for i in range(n)}
