"""Exact de-duplication with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries summary (Spark's frequent-items sketch, ``approx_top_k``) finds the digests that may be frequent. Their
exact count and smallest id come from a map-side aggregate over those digests alone; only verified winners, of which there
are at most ``TRACKED``, are broadcast, and rows of a frequent digest get their result without a shuffle. All other digests
have few rows each and go through an ordinary shuffle.

Defined cases: a null text counts as empty; an id that is null sorts after all others; rows that repeat both id and text
count in ``group_size`` and are all marked like their first (``exact_dedup``), while ``without_copies`` keeps one row of
them; an empty table gives an empty result; further columns are ignored or passed through and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import staged

#: Counters of the summary: any digest with more than rows / (0.75 * TRACKED) rows is found, whatever the table's size.
TRACKED = 4096
#: Winners that are broadcast at most; each row has about 60 bytes.
WINNERS = 1024


def digest(text: Column) -> Column:
    """SHA-256 of the text with every run of ASCII white space as one space, in hex."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(plain.cast("binary"), 256)


def _first(value: Column, size: Column) -> list[Column]:
    return [F.min(value).alias("keep_id"), F.sum(size).alias("group_size")]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (doc_id, sha, h): read the texts once; ``h`` is the summary's short key."""
    sha = docs.select(F.col(id_col).alias("doc_id"), F.unhex(digest(F.col(text_col))).alias("sha"))
    return staged(sha.withColumn("h", F.xxhash64("sha")), "digests")


def frequent(rows: DataFrame) -> DataFrame:
    """Exact count and smallest id of the digests that the summary names."""
    top = rows.agg(F.expr(f"approx_top_k(h, {WINNERS}, {TRACKED})").alias("top")).select(F.explode("top.item").alias("h"))
    named = rows.join(F.broadcast(top.distinct()), "h", "left_semi")
    winners = named.groupBy("sha").agg(*_first(F.col("doc_id"), F.lit(1)))
    return staged(winners.where("group_size > 1"), "frequent")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, id_col, text_col).select("doc_id", "sha", "h")
    winners = frequent(rows)
    # At most WINNERS rows by construction, so the broadcast does not grow with the data.
    marked = rows.drop("h").join(F.broadcast(winners), "sha", "left")
    heavy = marked.where("group_size IS NOT NULL")
    rest = marked.where("group_size IS NULL").select("doc_id", "sha")
    light = rest.join(rest.groupBy("sha").agg(*_first(F.col("doc_id"), F.lit(1))), "sha")
    return heavy.select(light.columns).unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without every row whose text an earlier id has; of rows that repeat id and text, one stays.

    The dropped (id, digest) pairs are anti-joined; Spark broadcasts them only where their measured size allows it.
    """
    found = staged(exact_dedup(docs, id_col, text_col), "exact-dedup")
    key = [F.col(id_col).alias("_id"), F.unhex(digest(F.col(text_col))).alias("_sha")]
    pair = [F.col("doc_id").alias("_did"), F.unhex("text_sha256").alias("_dsha")]
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *key)
    same = lambda other: F.col("_id").eqNullSafe(other["_did"]) & (F.col("_sha") == other["_dsha"])
    dropped = found.where("NOT kept").select(*pair)
    kept = keyed.join(dropped, same(dropped), "left_anti")
    again = staged(found.where("kept").groupBy(*pair).count().where("count > 1").drop("count"), "repeated")
    if again.isEmpty():
        return kept.select("row.*")
    once = kept.join(again, same(again), "left_semi").dropDuplicates(["_id", "_sha"])
    return kept.join(again, same(again), "left_anti").unionByName(once).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
