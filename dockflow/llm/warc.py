"""WARC archives: a writer with revisit records and a splittable reader of compressed archives.

Every row becomes one WARC/1.1 record in a gzip member of its own. Of rows with equal payloads of at least ``least`` bytes the one with the largest
page_id is a ``response``, the others are ``revisit`` records that name it and hold no payload. Archives are written by Spark's text sink,
whose committer copes with lost and repeated tasks. The sink ends every row with one byte; that byte is the zero which ends a member's
length field, so the rows are members without their last byte. (A record of 16 MiB or more, whose length may not end with zero, is followed by
an empty member.)

The reader needs no index. Archives are cut into byte ranges of SPLIT_BYTES; a task looks for the gzip magic in its range and takes a place as a member's start
if what follows inflates to a WARC header. It owns the records that start in its range and reads the last of them beyond the range's end. A payload may itself
hold gzip members: a start counts only if its member is followed by another member or the file's end, and so on through the range; else the
whole chain lies inside a payload and the search goes on behind it. Members are inflated in pieces and digested as they pass. Lengths, checksums and
payload digests must be right, and the members found must tile every file (``check_tiled``), so a damaged archive is an error and never a lost row.

Defined cases: a null html counts as empty; a null page_id is smaller than all others and reads back as null; rows that repeat the largest page_id with
one payload are all responses; a null url has no target header; control characters and blanks of a url are percent-encoded; an empty table gives
archives without records and an empty result; further columns are ignored and may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.llm.common import byte_array, delete_folder, looked_up, staged, staging_path, unstage

#: Payloads of fewer bytes are never revisits.
LEAST = 0
SPLIT_BYTES = 8 << 20
#: Tasks of one read at most; each then takes several ranges.
READ_TASKS = 20_000
DATE = "1970-01-01T00:00:00Z"
_STEP = 1 << 18
_HEADER_BYTES = 1 << 16
_MAGIC = b"\x1f\x8b\x08"
_END = b"\r\n\r\n"
_PAGE = re.compile(r"<urn:page:(.*)>")


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _member(record: bytes) -> bytes:
    """A gzip member, or two, that ends with a zero byte."""

    def packed(data):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    out = packed(record)
    return out if out[-1] == 0 else out + packed(b"")


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    """One record: a response with its payload, or a revisit with the length and digest of the payload it leaves out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + _base32(hashlib.sha1(payload).digest())),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + _END


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> None:
    """Every row of ``pages`` (page_id, url, html) as a record of compressed archives in ``folder``."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("sha", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    payload = keyed.select("page_id", "sha", F.octet_length("html").alias("bytes"))
    groups = payload.where(F.col("bytes") >= least).groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("size"))
    repeats = staged(groups.where("size > 1"), "payloads")
    total = repeats.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    named = looked_up(keyed, repeats, "sha", "size", total, ["page_id", "url"])
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    text = [F.col(c).cast("string").alias(c) for c in ("page_id", "url", "html", "first")]

    def run(batches):
        for batch in batches:
            ids, urls, first, again = (batch.column(c).to_pylist() for c in (0, 1, 3, 4))
            raw, at = byte_array(batch.column(2))
            for i in range(batch.num_rows):
                out = _member(record(ids[i], urls[i], raw[at[i] : at[i + 1]].tobytes(), first[i], again[i]))
                yield pa.RecordBatch.from_arrays([pa.array([out[:-1]], pa.binary())], names=["value"])

    members = named.select(*text, revisit.alias("revisit")).mapInArrow(run, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\x00").text(folder)
    unstage(repeats)


def _opened(path: str):
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


class _Damaged(Exception):
    pass


class _Inflated:
    """The bytes of the gzip member that starts at ``at``, in pieces; ``end`` is where it ends."""

    def __init__(self, file, at: int):
        self.file, self.place, self.end = file, at, None
        self.zip = zlib.decompressobj(31)

    def __iter__(self):
        try:
            while not self.zip.eof:
                data = self.zip.unconsumed_tail
                if not data:
                    data = self.file.read_at(_STEP, self.place)
                    self.place += len(data)
                    if not data:
                        raise _Damaged("ends early")
                yield self.zip.decompress(data, _STEP)
        except zlib.error as bad:
            raise _Damaged(str(bad)) from bad
        self.end = self.place - len(self.zip.unused_data)


def _fields(head: bytes) -> dict:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _page(value: str | None) -> str | None:
    found = _PAGE.fullmatch(value or "")
    return found[1] or None if found else None


def read_record(file, at: int, with_payload: bool = False) -> dict | None:
    """The record in the member at ``at``, an empty dict with its end for an empty member, None if none starts there."""
    pieces, held = _Inflated(file, at), b""
    source = iter(pieces)
    try:
        for piece in source:
            held += piece
            if _END in held or len(held) > _HEADER_BYTES:
                break
    except _Damaged:
        return None
    if not held:
        return {"end": pieces.end}
    head, found, rest = held.partition(_END)
    if not found or not head.startswith(b"WARC/1."):
        return None
    fields = _fields(head)
    if "warc-type" not in fields or "warc-record-id" not in fields or not fields.get("content-length", "").isdigit():
        return None
    kind, size = fields["warc-type"], int(fields["content-length"])
    # Only responses and revisits wrap their payload in an HTTP message.
    http = None if kind in ("response", "revisit") else {}
    seen, counted, sha, kept, tail, top = 0, 0, hashlib.sha1(), [], b"", b""
    try:
        for piece in _chained(rest, source):
            use = piece[: max(0, size - seen)]
            tail += piece[len(use) :]
            seen += len(use)
            if len(tail) > len(_END):
                raise _Damaged("the block is longer than it says")
            if http is None:
                top, complete, use = (top + use).partition(_END)
                if not complete:
                    if len(top) > _HEADER_BYTES:
                        raise _Damaged("no HTTP header")
                    continue
                http = _fields(top)
            sha.update(use)
            counted += len(use)
            if with_payload:
                kept.append(use)
        if seen != size or tail != _END or http is None:
            raise _Damaged("the block's length is wrong")
        named, digest = fields.get("warc-payload-digest", ""), _base32(sha.digest())
        if kind != "revisit" and named.startswith("sha1:") and named != "sha1:" + digest:
            raise _Damaged("the payload's digest is wrong")
    except _Damaged as bad:
        return {"damaged": str(bad)}
    revisit = kind == "revisit"
    return {
        "offset": at, "end": pieces.end, "record_id": fields["warc-record-id"], "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": _page(fields.get("warc-refers-to")),
        "payload_bytes": int(http.get("content-length", "0")) if revisit else counted,
        "payload_digest": named.removeprefix("sha1:") if revisit else digest,
        "payload": b"".join(kept) if with_payload and not revisit else None,
    }


def _chained(first, rest):
    yield first
    yield from rest


def records_of_range(file, start: int, stop: int, with_payload: bool = False) -> list[dict]:
    """The records whose members start in bytes ``start`` to ``stop`` of an archive."""
    size = file.size()
    stop = min(stop, size)
    view = file.read_at(stop - start + len(_MAGIC) - 1, start)
    place = start
    while True:
        hit = view.find(_MAGIC, place - start)
        if hit < 0 or start + hit >= stop:
            return []
        chain, here = [], start + hit
        while here < stop:
            got = read_record(file, here, with_payload)
            if got is None or "damaged" in got or (not chain and "offset" not in got):
                break
            if "offset" in got:
                chain.append(got)
            else:
                chain[-1]["end"] = got["end"]
            here = got["end"]
        # Empty members behind the last record belong to it, even beyond the range.
        while chain and stop <= here < size and (got := read_record(file, here)) is not None and "offset" not in got and "damaged" not in got:
            chain[-1]["end"] = here = got["end"]
        if chain and (here == size or (here >= stop and read_record(file, here) is not None)):
            return chain
        place = max(here, start + hit + 1)


RECORD = "file string, offset bigint, length bigint, record_id string, page_id string, url string, record_type string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, size) of the archives in ``folder``; their content is not read."""
    return spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file"), F.col("length").alias("size"))


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``folder``; ``payload`` is null for revisits and unless ``with_payload``."""
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split_bytes).cast("bigint")))
    ranges = archives(spark, folder).where("size > 0").select("file", starts.alias("start"))
    tasks = max(1, min(READ_TASKS, ranges.count()))
    names = [c.split()[0] for c in RECORD.split(", ")]

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with _opened(path) as file:
                    found = records_of_range(file, start, start + split_bytes, with_payload)
                rows = [{**r, "file": path, "length": r["end"] - r["offset"]} for r in found]
                types = {"payload": pa.binary(), "offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in names], names=names)

    return ranges.repartition(tasks, "file", "start").mapInArrow(run, RECORD)


def check_tiled(records: DataFrame, files: DataFrame) -> None:
    """Refuse archives whose records do not fill them from their first to their last byte."""
    found = records.groupBy("file").agg(F.sum("length").alias("found"))
    short = files.where("size > 0").join(found, "file", "left").where("found IS NULL OR found <> size")
    bad = short.limit(5).collect()
    if bad:
        raise ValueError("damaged archives: " + ", ".join(f"{r.file} ({r.found} of {r['size']} bytes)" for r in bad))


def dangling(records: DataFrame) -> DataFrame:
    """Revisits whose response is missing or has another digest."""
    pair = lambda c: [F.coalesce(F.col(c), F.lit("")).alias("of"), "payload_digest"]
    held = records.where("record_type = 'response'").select(*pair("page_id")).distinct()
    wanted = records.where("record_type = 'revisit'").groupBy(*pair("refers_to")).count()
    return wanted.join(held, ["of", "payload_digest"], "left_anti").select(F.col("of").alias("refers_to"), "payload_digest", "count")


def archived(pages: DataFrame, least: int = LEAST, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` to archives, read them back and check them: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    spark = pages.sparkSession
    folder = staging_path(spark, "archives")
    write_archives(pages, folder, least)
    kind = pages.schema["page_id"].dataType
    found = staged(read_archives(spark, folder, split_bytes), "records")
    check_tiled(found, archives(spark, folder))
    delete_folder(spark, folder)
    ids = [F.col(c).cast(kind).alias(c) for c in ("page_id", "refers_to")]
    return found.select(ids[0], "payload_bytes", "payload_digest", "record_type", ids[1], "url")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(sha, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url
FROM p
"""
