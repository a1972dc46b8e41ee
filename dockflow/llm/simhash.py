"""SimHash near-duplicates: anchor-point covering finds all fingerprints that differ in at most three bits.

Anchors are the codewords of the Hamming code of 31 bits, a perfect covering code of radius 1, laid over each half of the 64-bit
fingerprint. If two fingerprints differ in at most three bits, one of their halves differs in at most one. In that half the
first fingerprint's nearest anchor is within 1, so it is within 1 + 1 of the second. Every distinct fingerprint is therefore sent once to its
nearest anchor and replicated to all anchors within radius + threshold (1 or 16 of them) in each half; fingerprints that meet
at an anchor are compared exactly. No pair can be missed and no bucket is capped.

Documents with equal fingerprints are grouped before anything is compared, so copies never form pairs. Components come from
alternating large-star and small-star steps over the fingerprint links, all in Spark; nothing is collected.

Defined cases: a null text counts as empty; texts without a word have fingerprint zero and are linked like any other; a null id
sorts after all others as a component's id; repeated rows are reported each; an empty table gives an empty result; further columns
are ignored (``near_duplicates``) or passed through (``without_near_copies``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import byte_array, staged, unstage

SHINGLE = 3
BITS_APART = 3
SEED = 42


def shingles(text: bytes, k: int = SHINGLE) -> list:
    """The k-word shingles of a text, repeats included; the whole word sequence if it is shorter."""
    own = text.lower().split()
    if not own:
        return []
    line = b" ".join(own)
    end, ends = -1, []
    for w in own:
        end += len(w) + 1
        ends.append(end)
    if len(own) <= k:
        return [line]
    return [line[0 : ends[k - 1]]] + [line[a + 1 : b] for a, b in zip(ends, ends[k:], strict=False)]


#: Shingle hashes whose bits are counted at once, so that long texts need no more memory than short ones.
_COUNTED = 1 << 16


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingles' XXH64 values."""
    digest = xxhash.xxh64_intdigest
    h = [digest(s, SEED) for s in shingles(text, k)]
    if not h:
        return 0
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), _COUNTED):
        part = np.array(h[a : a + _COUNTED], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            raw, at = byte_array(batch.column(1))
            data = memoryview(raw)
            got = [fingerprint(bytes(data[a:b]), k) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(got, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _parity_columns() -> np.ndarray:
    """syndrome -> mask of the bit it points at; bit i of 31 has syndrome i + 1."""
    return np.array([0] + [1 << i for i in range(31)], np.uint32)


def anchors(half: np.ndarray, reach: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): the nearest codeword of each 31-bit half, or all codewords within distance 2."""
    flip = _parity_columns()
    syndrome = np.zeros(len(half), np.uint8)
    for i in range(31):
        syndrome ^= ((half >> np.uint32(i)) & np.uint32(1)).astype(np.uint8) * np.uint8(i + 1)
    row = np.arange(len(half))
    rows, found = [row], [half ^ flip[syndrome]]
    if reach:
        # Two flips i, j with syndromes that cancel: s_i ^ s_j = syndrome, each pair once.
        for s in range(1, 32):
            other = syndrome ^ np.uint8(s)
            use = (syndrome > 0) & (other > s)
            rows.append(row[use])
            found.append(half[use] ^ flip[s] ^ flip[other[use]])
    return np.concatenate(rows), np.concatenate(found)


def _placed(distinct: DataFrame, reach: bool) -> DataFrame:
    """(side, anchor, fp) for the nearest anchor, or every anchor within reach, of both halves."""

    def run(batches):
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for side in (0, 1):
                half = ((fp >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)
                row, anchor = anchors(half, reach)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.astype(np.int64) * 2 + side), pa.array(fp[row].view(np.int64))], names=["anchor", "fp"]
                )

    return distinct.mapInArrow(run, "anchor bigint, fp bigint")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): every two distinct fingerprints at most BITS_APART bits apart, in both directions at least once.

    Spark does not see that a fingerprint comes out at up to 32 anchors and would size that side at a thirtieth, so the join is always a merge join.
    """
    home = _placed(distinct, False).withColumnRenamed("fp", "a")
    near = _placed(distinct, True).withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS_APART
    return home.join(near.hint("merge"), "anchor").where((F.col("a") != F.col("b")) & close).select("a", "b")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        step = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        step = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return step.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every node but the roots: the smallest node it is linked to, directly or not."""
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(now)
    while True:
        after = staged(_star(_star(now, True), False), "links")
        unstage(now)
        now, seen = after, mark(after)
        if seen == before:
            return now.select("u", F.col("v").alias("root"))
        before = seen


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, group_size of equal fingerprints."""
    rows = staged(fingerprints(docs, id_col, text_col, k), "fingerprints")
    groups = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("group_size")), "distinct")
    root = components(links(groups.select("fp"))).withColumnRenamed("u", "fp")
    named = groups.join(root, "fp", "left").select("fp", "least", "group_size", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = named.join(ids, "root").select("fp", "component_id", "group_size")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


#: The key of ``keyed_rows``.
ROW = "_row"


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(ROW, text, row): ROW orders rows by id and tells them apart by id and text; ``row`` holds all columns of ``docs``, whatever their names are."""
    text = F.coalesce("text", F.lit(""))
    # 128 bits tell the texts of one id apart in any table.
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("text"), F.xxhash64(F.lit(1), text).alias("more"))
    return docs.select(row.alias(ROW), "text", F.struct(*docs.columns).alias("row"))


def least_of_each(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``keyed`` that are the least of their component in ``found`` (doc_id, component_id: a ROW each), one row each."""
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias(ROW)).distinct()
    kept = keyed.join(drop, ROW, "left_anti")
    again = staged(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(ROW)).count().where("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(again, ROW, "left_semi").dropDuplicates([ROW])
    return kept.join(again, ROW, "left_anti").select("row.*").unionByName(once.select("row.*"))


def without_near_copies(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id; one of the rows that repeat its id and text.

    Rows are told apart by id and text, so repeated or null ids with other texts do not answer for each other. The rows to drop
    are anti-joined; Spark broadcasts them only where their measured size allows it.
    """
    keyed = keyed_rows(docs)
    return least_of_each(keyed, staged(near_duplicates(keyed, ROW, "text", k), "near-duplicates"))
