"""Near copies by the Jaccard similarity of word shingles: candidates from SimHash fingerprints and banded MinHash, every candidate verified exactly.

Two texts are near copies if their sets of SHINGLE-word shingles have similarity SIMILAR or more. ``simhash``, over shingles of SHINGLE words, links
fingerprints by anchor-point covering; every set is compared with the least set of its linked component. At 0.8 fingerprints
differ in about ten bits and up to twenty, more than any covering with small balls reaches, so the near copies that the fingerprints leave come from
BANDS keys of ROWS MinHash values each. A pair at similarity s shares no key with probability (1 - s**ROWS)**BANDS: 2.5e-5 at 0.8 and
less above. Exact similarity decides, so nothing else is dropped.

Equal sets are grouped first, so copies never form pairs. Pairs within a key are never listed unless the key is small:

1. Every set is compared with the least set of its fingerprint's component and with its key's least set, which joins most groups of near copies.
2. Keys that still hold several components and at most SMALL sets compare the sets of different components.
3. In larger ones the sets outside the key's largest component are compared with PIVOTS of that component's sets, the same ones in all keys as far as they
   hold them; that is linear in the key and joins what near copies are left.
4. Sets of larger keys that then still differ are compared only if they share one of their rarest shingles: sets of similarity SIMILAR have a common one among their
   n - ceil(SIMILAR * n) + 1 rarest, whatever order is agreed on, and enough shingles from there on. Passages that many texts share are frequent and so never a reason to compare.

No key is capped. Components are those of ``simhash``.

Defined cases: a null text counts as empty; texts without a word are copies of each other; a text of fewer than SHINGLE words is one shingle;
a null id sorts after all others; one of the rows that repeat id and text stays; an empty table gives an empty result; further columns are passed through
and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.llm.common import byte_array, lowered, mixed, settings, slices, span_hashes, staged, unstage, word_bytes, words
from dockflow.llm.simhash import ROW, components, fingerprint, keyed_rows, least_of_each, links

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 45, 7
#: Open keys with at most so many sets compare all their components.
SMALL = 32
#: Sets of the largest component that a larger key's other sets are compared with.
PIVOTS = 6
#: Text bytes that a task works on at once, and rows that it gets at once: by Spark's 10,000 a task would hold some 34 MB of texts several times over.
SLICE = 1 << 18
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_INSIDE = word_bytes(True)


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles, ascending, and each text's first place among them."""
    start, end, first = words(raw, at, _INSIDE)
    h, size = span_hashes(lowered(raw), start, end), np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    # From every word up to SHINGLE words on; of a shorter text all words from its first.
    left = np.repeat(first[1:], size) - np.arange(len(h))
    g = h.copy()
    for j in range(1, SHINGLE):
        more = np.flatnonzero(left > j)
        g[more] = mixed(g[more]) + h[more + j]
    use = (left >= SHINGLE) | (np.arange(len(h)) == first[text])
    g, text = mixed(g[use]), text[use]
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    return g[new], np.searchsorted(text[new], np.arange(len(size) + 1))


def sketches(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's set identity, size and BANDS keys."""
    ids, sizes, keys = [], [], []
    salt = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
    for *_, part, offsets in slices(raw, at, SLICE):
        g, first = shingle_sets(part, offsets)
        n = np.diff(first)
        own = np.flatnonzero(n)
        total = np.zeros(len(n), np.uint64)
        key = np.zeros((len(n), BANDS), np.uint64)
        if len(own):
            # MinHash values need 32 bits only, which numpy handles several at a time.
            short = (g >> np.uint64(16)).astype(np.uint32)
            total[own] = np.add.reduceat(mixed(g), first[own])
            for band in range(BANDS):
                got = np.full(len(own), band + 1, np.uint64)
                for p in range(band * ROWS, (band + 1) * ROWS):
                    least = np.minimum.reduceat((short ^ salt[2 * p]) * (salt[2 * p + 1] | np.uint32(1)), first[own])
                    got = mixed(got + least)
                key[own, band] = got
        ids.append(mixed(total + n.astype(np.uint64)))
        sizes.append(n)
        keys.append(key)
    return (np.concatenate(ids), np.concatenate(sizes), np.concatenate(keys)) if ids else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint64))


def sketched(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, set, n, keys, fp) of every row."""

    def run(batches):
        for batch in batches:
            raw, at = byte_array(batch.column(1))
            ids, n, keys = sketches(raw, at)
            data = memoryview(raw)
            fp = np.array([fingerprint(bytes(data[a:b]), SHINGLE) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids.view(np.int64)), pa.array(n), lists, pa.array(fp)], names=["doc_id", "set", "n", "keys", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, set bigint, n bigint, keys array<bigint>, fp bigint")


def similarities(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The similarity of every set of ``a`` (hashes, first places) and the set of ``b`` at the same place; of two empty ones 1."""
    n = [np.diff(first) for _, first in (a, b)]
    pair = np.concatenate([np.repeat(np.arange(len(k)), k) for k in n])
    g = np.concatenate([a[0], b[0]])
    order = np.lexsort((g, pair))
    g, pair = g[order], pair[order]
    # Within one side every hash is there once, so a repeat is common to both.
    both = np.bincount(pair[1:][(g[1:] == g[:-1]) & (pair[1:] == pair[:-1])], minlength=len(n[0]))
    either = n[0] + n[1] - both
    return np.where(either > 0, both / np.maximum(either, 1), 1.0)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches):
        for batch in batches:
            one, (other, place) = byte_array(batch.column(2)), byte_array(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i, j, part, at in slices(*one, SLICE):
                second = other[place[i] : place[j]], place[i : j + 1] - place[i]
                keep[i:j] = similarities(shingle_sets(part, at), shingle_sets(*second)) >= SIMILAR - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    of = lambda c: texts.select(F.col("set").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


def _alike(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) >= F.greatest(a, b) * (SIMILAR - 1e-12)


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``roots`` (set, root) after the components of the found pairs are joined; a set that is its own root has no row."""
    at = lambda c: roots.select(F.col("set").alias(c), F.col("root").alias(f"root_{c}"))
    ends = found.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = staged(components(ends.where("a <> b").distinct()), "joined")
    moved = roots.join(joined.select(F.col("u").alias("root"), F.col("root").alias("further")), "root", "left").select("set", F.coalesce("further", "root").alias("root"))
    new = joined.select(F.col("u").alias("set"), "root").join(roots.select("set"), "set", "left_anti")
    after = staged(moved.unionByName(new), "roots")
    unstage(joined)
    return after


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Staged members (key, set, n, root, top, sets) of the keys that hold several components; ``top`` is the root of the largest."""
    named = staged(members.select("key", "set", "n").join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")), "named")
    parts = named.groupBy("key", "root").agg(F.count("*").alias("size"))
    tops = parts.groupBy("key").agg(F.max(F.struct("size", "root")).alias("top"), F.count("*").alias("parts"), F.sum("size").alias("sets"))
    wide = tops.where("parts > 1").select("key", F.col("top.root").alias("top"), "sets")
    open_ = staged(named.join(wide.hint("merge"), "key"), "open")
    unstage(named)
    return open_


def _met(left: DataFrame, right: DataFrame, on: str, ordered: bool, rest: str = "n") -> DataFrame:
    """Pairs (a, b), a < b, of sets in different components that meet in ``on`` and can be similar enough; they have at most the lesser ``rest`` in common."""
    of = lambda df, c: df.select(on, F.col("set").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in {"n", "root", rest}))
    wanted = (F.col("n_a") + F.col("n_b")) * (SIMILAR / (1 + SIMILAR)) - 1e-6
    fits = _alike("n_a", "n_b") & (F.least(f"{rest}_a", f"{rest}_b") >= wanted)
    # A row takes a few bytes in the staged file, as keys and sets repeat, and ten times that in a broadcast table.
    pairs = of(left, "a").join(of(right, "b").hint("merge"), on).where((F.col("root_a") != F.col("root_b")) & fits)
    pairs = pairs.where("a < b") if ordered else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.select("a", "b").distinct()


def _pivots(named: DataFrame) -> DataFrame:
    """Of each key's largest component PIVOTS sets, in an order that is the same for all keys."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("set"), "set")
    return named.where("root = top").withColumn("place", F.row_number().over(order)).where(F.col("place") <= PIVOTS).drop("place")


def _rarest(open_sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(shingle, set, n, root, rest): the rarest shingles of every set, so many that sets similar enough have a common one.

    If it is the first that two sets have in common, they have at most ``rest`` shingles in common: itself and the less rare ones.
    """

    def run(batches):
        for batch in batches:
            raw, at = byte_array(batch.column(1))
            for a, b, part, offsets in slices(raw, at, SLICE):
                g, first = shingle_sets(part, offsets)
                row = pa.array(np.repeat(np.arange(a, b), np.diff(first)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(g.view(np.int64))], names=["set", "shingle"])

    with settings(texts.sparkSession, BATCH):
        rows = staged(texts.join(open_sets.select("set"), "set").mapInArrow(run, "set bigint, shingle bigint"), "shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("held")).where("held > 1")
    # A shingle that no other set has cannot be common, but takes its place among the rarest.
    ranked = rows.join(counts, "shingle", "left").withColumn("place", F.row_number().over(Window.partitionBy("set").orderBy(F.col("held").asc_nulls_first(), "shingle")))
    least = F.col("n") - F.ceil(F.col("n") * F.lit(SIMILAR) - 1e-9) + 1
    return ranked.where("held IS NOT NULL").join(open_sets.select("set", "n", "root"), "set").where(F.col("place") <= least).select(
        "shingle", "set", "n", "root", (F.col("n") - F.col("place") + 1).alias("rest")
    )


def _linked(groups: DataFrame) -> DataFrame:
    """Staged pairs (a, b) of every set and the least set of the component that SimHash links give its fingerprint, if their sizes allow it."""
    root = components(links(groups.select("fp").distinct()))
    named = staged(groups.select("set", "n", "fp").join(root.withColumnRenamed("u", "fp"), "fp", "left").select("set", "n", F.coalesce("root", "fp").alias("root")), "linked")
    least = named.groupBy("root").agg(F.min(F.struct("set", "n")).alias("least"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    pairs = named.join(least.hint("merge"), "root").where((F.col("set") != F.col("least.set")) & _alike("n", "least.n"))
    kept = staged(pairs.select(F.col("least.set").alias("a"), F.col("set").alias("b")), "pairs")
    unstage(named)
    return kept


def _members(groups: DataFrame) -> DataFrame:
    """(key, set, n, least) of the sets whose key another set has too; ``least`` is the key's least set.

    Spark sizes the keys of a set as one, so nothing here is broadcast by its estimate.
    """
    places = groups.select("set", "n", F.explode("keys").alias("key"))
    shared = places.groupBy("key").agg(F.min(F.struct("set", "n")).alias("least"), F.count("*").alias("sets")).where("sets > 1").drop("sets")
    return places.join(shared.hint("merge"), "key")


def _roots(groups: DataFrame, keyed: DataFrame) -> DataFrame:
    """(set, root) of every set in a component of several but the root."""
    linked = _linked(groups)
    members = staged(_members(groups), "members")
    close = members.where((F.col("set") != F.col("least.set")) & _alike("n", "least.n"))
    first = staged(close.select(F.col("least.set").alias("a"), F.col("set").alias("b")).unionByName(linked).distinct(), "pairs")
    met = members.select("set").union(linked.select("a")).union(linked.select("b")).distinct()
    wanted = groups.join(met, "set").select("set", F.col("first").alias(ROW))
    texts = staged(keyed.select(ROW, "text").join(wanted, ROW).dropDuplicates(["set"]).select("set", "text"), "texts")
    none = keyed.sparkSession.createDataFrame([], "set bigint, root bigint")

    def compare(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        with settings(pairs.sparkSession, BATCH):
            found = staged(verified(pairs, texts), "similar")
        after = _merged(roots, found)
        unstage(found, roots)
        return after

    roots = compare(none, first)
    named = _named(members, roots)
    small, large = named.where(F.col("sets") <= SMALL), named.where(F.col("sets") > SMALL)
    pairs = _met(small, small, "key", True).unionByName(_met(large.where("root <> top"), _pivots(large), "key", False)).distinct()
    second = staged(pairs.join(first, ["a", "b"], "left_anti"), "pairs")
    roots = compare(roots, second)
    unstage(named)
    named = _named(members, roots)
    large = named.where(F.col("sets") > SMALL)
    if not large.isEmpty():
        rare = staged(_rarest(large.select("set", "n", "root").distinct(), texts), "rarest")
        pairs = _met(rare, rare, "shingle", True, "rest")
        roots = compare(roots, staged(pairs.join(first, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"), "pairs"))
        unstage(rare)
    unstage(members, texts, named, first, linked, second)
    return roots


def near_copies(keyed: DataFrame) -> DataFrame:
    """One row per row of ``keyed``: doc_id (its ROW) and component_id, the least of its component."""
    with settings(keyed.sparkSession, BATCH):
        rows = staged(sketched(keyed, ROW), "sketches")
    least = rows.groupBy("set").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("fp").alias("fp"))
    groups = staged(least, "sets")
    named = groups.join(_roots(groups.where("n > 0"), keyed), "set", "left").select("set", "first", F.coalesce("root", "set").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.select("doc_id", "set").join(named.join(ids, "root").select("set", "component_id"), "set").select("doc_id", "component_id")


def without_similar(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component of near copies: the one with the smallest id."""
    keyed = keyed_rows(docs)
    return least_of_each(keyed, staged(near_copies(keyed), "near-duplicates"))
