"""Suffix-array de-duplication by column-wise construction over a collection of pieces.

A byte goes if a LENGTH-byte string that covers it also starts anywhere else. The suffix order of the collection is built column by column
from the right: every round inserts one symbol of every piece, derives the order of the new suffixes from the last round's order
by a stable sort on the inserted symbols (the Burrows-Wheeler step), and their longest common prefixes from the last round's
by range minima. A suffix whose neighbour shares LENGTH bytes repeats. Columns live in an external file that is read sequentially, one
column a round.

Texts become pieces so that equal strings meet and the rounds are bounded. The anchor of a LENGTH-byte string is its K-gram with the
least hash, the leftmost of equals. Neighbouring strings with the same anchor form one piece, of at most 2 * LENGTH bytes. Equal strings have
equal anchors at equal places, so pieces are laid out with their anchors in one column and only suffixes of the same column
need comparing: each round sorts the pieces, not all suffixes so far. Pieces whose anchor occurs once in the corpus cannot
repeat and are left out; equal pieces go through the rounds once, with their count.

Partitions hold whole anchors and about PART_BYTES of pieces; their number follows the input. An anchor with more than HOT distinct
pieces would be an unbounded group: its strings are counted one by one by their digests instead, with map-side sums. (With
any smaller number this exact way and the rounds give the same answer.)

Defined cases: null and empty texts have no bytes and nothing removed; texts shorter than LENGTH lose nothing; rows that repeat an id and text
repeat each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import byte_array, mixed, powers, slices, staged

LENGTH = 400
K = 32
PART_BYTES = 24 << 20
HOT = 50_000
#: Bytes of one text that are looked at together; longer texts overlap by LENGTH - 1 bytes.
CHUNK = 4 << 20
_PLACE = np.uint64((1 << 24) - 1)


def _gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    n = len(raw) - k + 1
    return mixed((total[k:] - total[:n]) * down[:n])


def pieces(raw: np.ndarray, at: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """Of every piece: first start, number of starts, anchor's distance from the first start, anchor's hash, text number."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none, none, none.astype(np.uint64), none
    h = _gram_hashes(raw, k)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    span, reach, have = length - k + 1, low, 1
    while 2 * have <= span:
        reach = np.minimum(reach[:-have], reach[have:])
        have *= 2
    if have < span:
        reach = np.minimum(reach[: len(low) - span + 1], reach[span - have :][: len(low) - span + 1])
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(reach)]
    valid = np.arange(len(reach)) + length <= at[1:][text]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (reach[1:] != reach[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(begin)
    stop = np.ones(len(reach) + 1, bool)
    stop[:-1] = begin | ~valid
    ends = np.flatnonzero(stop)
    run = ends[np.searchsorted(ends, start, "right")] - start
    anchor = (reach[start] & _PLACE).astype(np.int64)
    return start, run, anchor - start, h[anchor], text[start]


def repeated(held: list[bytes], left: np.ndarray, run: np.ndarray, count: np.ndarray, length: int = LENGTH, k: int = K) -> np.ndarray:
    """(starts, pieces) booleans: whether the string at each start occurs again; start s of a piece is column span - 1 - left + s."""
    m, span = len(held), length - k + 1
    width = span - 1 + length
    out = np.zeros((span, m), bool)
    with tempfile.TemporaryFile() as file:
        columns = np.memmap(file, np.uint16, "w+", shape=(width, m))
        for a in range(0, m, 1024):
            block = np.zeros((min(1024, m - a), width), np.uint16)
            for i, piece in enumerate(held[a : a + 1024]):
                c = span - 1 - left[a + i]
                block[i, c : c + len(piece)] = np.frombuffer(piece, np.uint8)
                block[i, c : c + len(piece)] += 1
            columns[:, a : a + len(block)] = block.T
        order, common = np.arange(m), np.zeros(m + 1, np.int32)
        for c in range(width - 1, -1, -1):
            symbol = np.asarray(columns[c])[order]
            step = np.argsort(symbol, kind="stable")
            order, symbol = order[step], symbol[step]
            if m > 1:
                pairs = np.empty(2 * m - 2, np.int64)
                pairs[0::2], pairs[1::2] = step[:-1] + 1, step[1:] + 1
                least = np.minimum.reduceat(common, pairs)[0::2]
                same = (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0)
                common = np.zeros(m + 1, np.int32)
                common[1:m][same] = np.minimum(least[same] + 1, 2 * length)
            if c < span:
                again = common >= length
                out[c, order] = again[:-1] | again[1:]
        del columns
    place = np.arange(span)[:, None]
    inside = (place >= span - 1 - left) & (place < span - 1 - left + run)
    return inside & (out | (count > 1))


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, first row, number) of every maximal run of true rows in each column."""
    edge = np.diff(np.pad(flags, ((1, 1), (0, 0))).astype(np.int8), axis=0)
    column, first = np.nonzero(edge.T == 1)
    _, last = np.nonzero(edge.T == -1)
    return column, first, last - first


def _occurrences(docs: DataFrame, length: int, k: int) -> DataFrame:
    """(key, start, run, left, anchor, digest) of every piece of every text."""

    def run(batches):
        for batch in batches:
            keys = np.asarray(batch.column(0))
            raw, at = byte_array(batch.column(1))
            for a, b, part, offsets in slices(raw, at):
                step = CHUNK if b - a == 1 else len(part)
                for c in range(0, max(1, len(part) - length + 1), max(1, step)):
                    sub = part[c : c + step + length - 1] if b - a == 1 else part
                    own = np.array([0, len(sub)]) if b - a == 1 else offsets
                    start, n, left, anchor, text = pieces(sub, own, length, k)
                    data = sub.tobytes()
                    digest = [xxhash.xxh3_128_digest(data[s : s + r + length - 1]) for s, r in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[a:b][text]), pa.array(start - own[text] + c), pa.array(n.astype(np.int32)),
                            pa.array(left.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(digest, pa.binary()),
                        ],
                        names=["key", "start", "run", "left", "anchor", "digest"],
                    )

    return docs.where(F.octet_length("text") >= length).select("key", "text").mapInArrow(
        run, "key bigint, start bigint, run int, left int, anchor bigint, digest binary"
    )


def _cut(keyed: DataFrame, wanted: DataFrame, length: int, single: bool) -> DataFrame:
    """The wanted pieces' bytes: (anchor, digest, left, run, n, piece), or every string's digest (key, start, digest) if ``single``."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("start", "run", "left", "anchor", "digest", "n")).alias("of"))
    rows = keyed.where(F.octet_length("text") >= length).join(lists, "key")

    def run(batches):
        for batch in batches:
            raw, at = byte_array(batch.column(1))
            keys, lists = batch.column(0).to_pylist(), batch.column(2)
            for i in range(batch.num_rows):
                data, got = raw[at[i] : at[i + 1]].tobytes(), lists[i].as_py()
                if single:
                    place = [s for p in got for s in range(p["start"], p["start"] + p["run"])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([keys[i]] * len(place), pa.int64()), pa.array(place, pa.int64()),
                            pa.array([xxhash.xxh3_128_digest(data[s : s + length]) for s in place], pa.binary()),
                        ],
                        names=["key", "start", "digest"],
                    )
                    continue
                columns = [[p[c] for p in got] for c in ("anchor", "digest", "left", "run", "n")]
                columns.append([data[p["start"] : p["start"] + p["run"] + length - 1] for p in got])
                types = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=["anchor", "digest", "left", "run", "n", "piece"]
                )

    schema = "key bigint, start bigint, digest binary" if single else "anchor bigint, digest binary, left int, run int, n bigint, piece binary"
    return rows.select("key", "text", "of").mapInArrow(run, schema)


def _found(cut: DataFrame, parts: int, length: int, k: int) -> DataFrame:
    """(digest, first, number): the maximal runs of repeated starts of every distinct piece."""

    def run(batches):
        digest, left, number, count, held = [], [], [], [], []
        for batch in batches:
            digest += batch.column(1).to_pylist()
            left.append(np.asarray(batch.column(2)))
            number.append(np.asarray(batch.column(3)))
            count.append(np.asarray(batch.column(4)))
            held += batch.column(5).to_pylist()
        if not held:
            return
        left, number, count = (np.concatenate(v).astype(np.int64) for v in (left, number, count))
        piece, first, n = _runs(repeated(held, left, number, count, length, k))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([digest[i] for i in piece], pa.binary()),
                pa.array(first - (length - k - left[piece])), pa.array(n),
            ],
            names=["digest", "first", "number"],
        )

    return cut.repartition(parts, "anchor").mapInArrow(run, "digest binary, first bigint, number bigint")


def spans(keyed: DataFrame, length: int = LENGTH, k: int = K, hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """(key, start, number): runs of starts whose ``length``-byte strings occur again, of (key, text) rows."""
    seen = staged(_occurrences(keyed, length, k), "pieces")
    again = staged(seen.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    candidates = staged(seen.join(again, "anchor"), "candidates")
    one = F.min_by(F.struct("key", "start", "run", "left"), F.struct("key", "start")).alias("one")
    distinct = staged(candidates.groupBy("anchor", "digest").agg(F.count("*").alias("n"), one).select("anchor", "digest", "n", "one.*"), "distinct")
    crowded = staged(distinct.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "crowded")
    usual, many = distinct, not crowded.isEmpty()
    if many:
        usual = distinct.join(crowded, "anchor", "left_anti")
    size = usual.agg(F.sum(F.col("run") + length - 1)).first()[0] or 0
    parts = max(1, -(-size // part_bytes), min(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // (1 << 20)))
    found = staged(_found(_cut(keyed, usual, length, False), int(parts), length, k), "repeats")
    out = candidates.join(found, "digest").select("key", (F.col("start") + F.col("first")).alias("start"), "number")
    if many:
        each = candidates.join(crowded, "anchor").withColumn("n", F.lit(1).cast("long"))
        strings = staged(_cut(keyed, each, length, True), "strings")
        twice = strings.groupBy("digest").count().where("count > 1").select("digest")
        out = out.unionByName(strings.join(twice, "digest").select("key", "start", F.lit(1).cast("long").alias("number")))
    return out


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id, text); the key stands for id and text together, null and empty ones included."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull(), text)
    return docs.select(key.alias("key"), F.col(id_col).alias("doc_id"), text.alias("text"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = K, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept_text (bytes, null unless ``with_text``)."""
    keyed = keyed_texts(docs, id_col, text_col)
    cover = spans(keyed.select("key", "text"), length, k, hot).groupBy("key").agg(F.collect_set(F.struct("start", "number")).alias("of"))
    rows = keyed.join(cover, "key", "left").select("doc_id", "text", "of")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, at = byte_array(batch.column(1))
            kept, counts = [], []
            for i in range(batch.num_rows):
                data, of = raw[at[i] : at[i + 1]], batch.column(2)[i].as_py()
                if not of:
                    kept.append(data.tobytes())
                    counts.append((len(data), 0, 0))
                    continue
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, [p["start"] for p in of], 1)
                np.add.at(edge, [p["start"] + p["number"] + length - 1 for p in of], -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept.append(data[~gone].tobytes())
                counts.append((len(data), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())))
            counts = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, j]) for j in range(3))]
                + [pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
                + [pa.array(kept if with_text else [None] * len(kept), pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept_text binary")
