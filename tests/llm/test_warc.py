"""Archives: round trips against plain Python, ranges of any size, payloads that hold archives, damage."""

import base64
import hashlib
import os
import random

import pytest

from dockflow.llm import warc
from dockflow.llm.common import looked_up, staging_path

PAGES = "page_id bigint, url string, html string"


def rows():
    rng = random.Random(3)
    out = [(i, f"http://h{i}.net/a b\n?q={i}", "".join(rng.choice("abcé<>\x00\r\n") for _ in range(rng.randint(0, 400)))) for i in range(60)]
    out += [(100 + i, f"http://h.org/{i}", "<p>again</p>") for i in range(90)]
    out += [(200, None, None), (201, "", ""), (None, "http://n/", "<p>again</p>"), (None, None, "alone"), (300, "u", "tie"), (300, "v", "tie"), (150, "w", "tie")]
    out += [(400, "http://long/", "0123456789abcdef" * (1 << 16)), (401, "http://random/", rng.randbytes(200_000).hex())]
    return out


def expected(of, least=0):
    groups = {}
    for i, _, html in of:
        groups.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in of:
        data = (html or "").encode()
        first = max((j for j in groups[html or ""] if j is not None), default=None) if len(data) >= least else i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=repr)


def pages(spark, of):
    return spark.createDataFrame(of, PAGES).repartition(3).selectExpr("*", "'x' AS sha", "1 AS first", "2 AS size", "3 AS _salt", "true AS _hot")


def result(df):
    return sorted((tuple(r)[:5] for r in df.collect()), key=repr)


@pytest.mark.parametrize(("least", "split"), [(0, 1 << 23), (11, 3000)])
def test_round_trip(spark, least, split):
    assert result(warc.archived(pages(spark, rows()), least, split)) == expected(rows(), least)


def test_empty_table(spark):
    got = warc.archived(pages(spark, []))
    assert got.count() == 0 and got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]


def test_payloads_and_urls_come_back(spark, folder):
    warc.write_archives(pages(spark, rows()), folder + "/w")
    got = warc.read_archives(spark, folder + "/w", 4096, with_payload=True).collect()
    html = {(i, u): (h or "").encode() for i, u, h in rows()}
    assert {r.page_id: bytes(r.payload) for r in got if r.page_id == "400"} == {"400": html[400, "http://long/"]}
    assert {r.url for r in got if r.page_id == "7"} == {"http://h7.net/a%20b%0A?q=7"}
    assert all(r.payload is None for r in got if r.record_type == "revisit") and len(got) == len(rows())
    assert warc.dangling(spark.createDataFrame(got, warc.RECORD)).count() == 0
    lost = spark.createDataFrame([r for r in got if r.page_id != "189"], warc.RECORD)
    assert [(r.refers_to, r["count"]) for r in warc.dangling(lost).collect()] == [("189", 90)]


def test_long_records_end_with_zero(tmp_path):
    body = b"x" * (17 << 20)
    member = warc._member(warc.record("1", None, body, None, False))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(member + warc._member(warc.record("2", None, b"y", None, False)))
    assert member[-1] == 0
    with warc._opened(str(path)) as file:
        for step in (500, 7000, 1 << 20):
            got = [r for s in range(0, file.size(), step) for r in warc.records_of_range(file, s, s + step)]
            assert [(r["page_id"], r["payload_bytes"]) for r in got] == [("1", len(body)), ("2", 1)]
            assert sum(r["end"] - r["offset"] for r in got) == file.size()


def test_archives_inside_payloads(tmp_path):
    inner = b"".join(warc._member(warc.record(f"inner{i}", None, os.urandom(300), None, False)) for i in range(4))
    noise = b"\x1f\x8b\x08" * 50
    import zlib

    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # level 0 keeps the inner members' bytes as they are
    outer = stored.compress(warc.record("outer", None, noise + inner + noise, None, False)) + stored.flush()
    data = warc._member(warc.record("before", None, b"b", None, False)) + outer + warc._member(warc.record("after", None, b"a", None, False))
    path = tmp_path / "a.warc.gz"
    path.write_bytes(data)
    at = data.index(inner) - 10
    with warc._opened(str(path)) as file:
        for cut in (at, data.index(inner) + 3, 20):
            got = [r["page_id"] for a, b in ((0, cut), (cut, file.size())) for r in warc.records_of_range(file, a, b)]
            assert got == ["before", "outer", "after"]


@pytest.mark.parametrize("damage", ["flip", "cut"])
def test_damage_is_an_error(spark, folder, damage):
    warc.write_archives(pages(spark, rows()).coalesce(1), folder + "/w")
    path = next(f"{folder}/w/{n}" for n in sorted(os.listdir(folder + "/w")) if n.startswith("part-") and os.path.getsize(f"{folder}/w/{n}"))
    data = bytearray(open(path, "rb").read())
    if damage == "flip":
        data[len(data) // 2] ^= 0xFF
    with open(path, "wb") as out:
        out.write(data if damage == "flip" else data[: len(data) - 40])
    crc = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(ValueError, match="damaged archives"):
        warc.check_tiled(warc.read_archives(spark, folder + "/w", 3000), warc.archives(spark, folder + "/w"))


def test_foreign_records_are_read(tmp_path):
    head = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc._member(head))
    with warc._opened(str(path)) as file:
        got = warc.records_of_range(file, 0, file.size(), with_payload=True)
    assert [(r["record_type"], r["record_id"], r["page_id"], r["payload"]) for r in got] == [("warcinfo", "<urn:uuid:1>", None, b"abc")]


def test_lookup_spreads_heavy_keys(spark):
    left = spark.range(6000).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS key")
    right = left.groupBy("key").count().selectExpr("key", "count AS size", "upper(key) AS name")
    got = looked_up(left, right, "key", "size", 6000, ["id"])
    assert got.count() == 6000 and got.where("name <> upper(key) OR name IS NULL").count() == 0
    assert spark.sparkContext.applicationId in staging_path(spark, "x")
