"""Helpers shared by the operators: staged tables, text batches, word hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that are worked on at once inside a task; a longer single text is taken alone.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; the warehouse where the cluster names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"


def run_folder(spark: SparkSession) -> str:
    """Everything that this application stages lies here, so that one call of ``clear_staged`` removes it."""
    return f"{shared_folder(spark)}/dockflow-{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete_folder(df.sparkSession, folder)


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this application staged; results that are still to be read must have been written elsewhere."""
    delete_folder(spark, run_folder(spark))


#: Spark's own limit for the bits of a runtime filter, 8 MB.
BLOOM_BITS = 1 << 26


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """These settings for the actions inside; those of before afterwards."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def bloom_settings(keys: int) -> dict[str, str]:
    """Joins are shuffled, and a Bloom filter over the ``keys`` keys of a filtered side first drops rows of the other side that it rules out.

    The join stays exact. The filter takes 16 bits a key up to BLOOM_BITS; beyond, more rows get through to the shuffle, and the join drops them.
    """
    bits = min(BLOOM_BITS, max(1 << 16, 16 * keys))
    of = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": str((1 << 63) - 1), "expectedNumItems": str(bits // 16), "numBits": str(bits)}
    return {"spark.sql.autoBroadcastJoinThreshold": "-1", **{f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in of.items()}}


#: A key with more than this share of the rows is spread over SALTS tasks by ``looked_up``.
HEAVY_SHARE = 1024
SALTS = 64


def looked_up(left: DataFrame, right: DataFrame, key: str, size: str, total: int, spread: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has one row a ``key`` and the number of left rows with that key in ``size``.

    Keys with more than ``total`` / HEAVY_SHARE rows, of which there are at most HEAVY_SHARE, get a salt from the ``spread`` columns of
    ``left``; their right rows are repeated for every salt. Only those keys are broadcast.
    """
    heavy = F.col(size) * HEAVY_SHARE > total
    hot = right.where(heavy).select(key, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    one = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_hot")
    salts = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return one.join(right.withColumn("_salt", F.explode(salts)), [key, "_salt"], how).drop("_salt")


def held_out(id_column: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text has this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sample_texts(labelled: DataFrame, label: str, per_label: int, seed: int) -> list:
    """At most about ``per_label`` texts of each label value, chosen by a hash of the text alone, in a fixed order.

    ``labelled`` has columns ``text`` and ``label``. The bound limits what reaches the driver; the choice does not
    depend on partitioning. Repeated texts with one label count once per row in the share and are kept once.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    if not counts:
        return []
    rate = F.lit(0.0)
    for value, n in counts.items():
        rate = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(rate)
    place = F.xxhash64("text", F.lit(seed)).bitwiseAND((1 << 30) - 1) / F.lit(float(1 << 30))
    chosen = labelled.where(place < rate).select("text", label).distinct().collect()
    return sorted(((r[0], r[1]) for r in chosen), key=lambda r: (str(r[1]), r[0]))


def byte_array(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow text column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = binary.buffers()
    at = np.frombuffer(offsets, np.int64)[binary.offset : binary.offset + len(binary) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
    return raw, at


def encoded(texts: list) -> tuple[np.ndarray, np.ndarray]:
    return byte_array(pa.array(texts, pa.string()))


def slices(raw: np.ndarray, at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of consecutive texts with at most ``limit`` bytes together, or of one longer text."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def in_slices(of, texts: list, *args) -> tuple[np.ndarray, np.ndarray]:
    """``of(bytes, offsets, *args)``, values and their offsets by text, for a list of texts, in slices."""
    values, offsets, done = [], [np.zeros(1, np.int64)], 0
    for *_, part, at in slices(*encoded(texts)):
        got, rows = of(part, at, *args)
        values.append(got)
        offsets.append(rows[1:] + done)
        done += len(got)
    return np.concatenate(values) if values else np.zeros(0, np.int64), np.concatenate(offsets)


def word_bytes(keep_symbols: bool) -> np.ndarray:
    """Which bytes belong to words: all but ASCII white space, or ASCII letters and digits and all non-ASCII bytes."""
    inside = np.ones(256, bool)
    if keep_symbols:
        inside[[0x20, *range(0x09, 0x0E)]] = False
    else:
        inside[:128] = False
        for a, b in ((48, 58), (65, 91), (97, 123)):
            inside[a:b] = True
    return inside


def lowered(raw: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters, byte by byte in UTF-8."""
    out = raw.copy()
    out[(raw >= 65) & (raw <= 90)] += 32
    if len(raw) > 1:
        accented = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        out[1:][accented] += 0x20
    return out


class _Cache(dict):
    """Tables that a task computes for itself; it travels empty."""

    def __reduce__(self):
        return _Cache, ()


_powers = _Cache()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes, not crossing texts, and each text's first word number."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    w = inside[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    begins = w.copy()
    begins[1:] &= ~w[:-1] | cut[1:n]
    ends = w.copy()
    ends[:-1] &= ~w[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, at, "left")


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same for the same bytes anywhere."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
