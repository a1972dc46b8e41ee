"""The completeness gate on file streams: every verdict, restarts, timeouts and publication."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from dockflow.sinks.release import pointer
from dockflow.sources import records
from dockflow.streaming import gate, live, publish

SNAP = {n: n * 64 for n in "abcdef0123456789"}
META = "e" * 64


def header(snapshot, kind, origin="GBFS_REPLAY", meta=META):
    return {"contract_version": "1.1", "record_type": kind, "snapshot_id": SNAP[snapshot], "metadata_version": meta, "data_origin": origin}


def clock(minute):
    return f"2025-01-08T13:{minute:02d}:00Z", f"2025-01-08T08:{minute:02d}:00-05:00", f"2025-01-08T13:{minute:02d}:20Z"


def station(snapshot, name, minute, bikes=5, docks=15, **kw):
    at, local, ingested = clock(minute)
    value = {
        "station_id": name, "snapshot_at_utc": at, "snapshot_at_local": local, "num_bikes_available": bikes,
        "num_bikes_disabled": 0, "num_docks_available": docks, "num_docks_disabled": None, "is_installed": True,
        "is_renting": True, "is_returning": True, "last_reported_at_utc": at, "ingested_at_utc": ingested, "source_version": "2.3",
    }
    value.update(kw.pop("change", {}))
    return {"key": name, "headers": header(snapshot, "station", **kw), "value": value}


def end(snapshot, count, minute, **kw):
    at, _, ingested = clock(minute)
    return {"key": "__snapshot_end__", "headers": header(snapshot, "snapshot_end", **kw),
            "value": {"station_count": count, "snapshot_at_utc": at, "ingested_at_utc": ingested}}


def batch(snapshot, minute, names=("S1", "S2", "S3"), **kw):
    return [*[station(snapshot, n, minute, **kw) for n in names], end(snapshot, len(names), minute, **kw)]


class Harness:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.files = spark, folder, 0
        os.makedirs(f"{folder}/in")
        info = [(META, f"S{i}", f"Stn {i}", 20, 40.7 + i * 0.001, -74.0) for i in range(1, 6)]
        self.metadata = spark.createDataFrame(info, "metadata_version string, station_id string, station_name string, capacity int, lat double, lon double")

    def send(self, *rows):
        self.files += 1
        aside = f"{self.folder}/.{self.files}"
        with open(aside, "w") as out:
            out.write("\n\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows) + "\n")
        os.rename(aside, f"{self.folder}/in/{self.files:04d}.ndjson")

    def run(self, mode="recorded", timeout=120, publish_to=None):
        """Drain what was sent through the gate and return every verdict so far."""
        lines = records.stream_ndjson(self.spark, f"{self.folder}/in")
        judge = gate.Gate(f"{self.folder}/state", mode, timeout)
        out = f"{self.folder}/verdicts"

        def keep(df, batch_id):
            df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            if publish_to:
                publish.publisher(publish_to, self.metadata)(df, batch_id)

        writer = lines.writeStream.outputMode("append").foreachBatch(live.gated(self.metadata, judge, keep))
        query = writer.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()
        assert query.awaitTermination(300)
        rows = self.spark.read.parquet(out).where("outcome <> 'STATION'").orderBy("batch", "visit").collect()
        return [(r.snapshot_id[0], r.outcome, r.reason) for r in rows]


@pytest.fixture
def harness(spark, folder):
    return Harness(spark, folder)


def test_verdicts_in_one_ordered_feed(harness):
    twice = station("1", "S1", 10)
    other_time = end("0", 1, 24)
    other_time["value"]["snapshot_at_utc"] = clock(25)[0]
    harness.send(
        *batch("a", 1),
        twice, twice, station("1", "S2", 10), end("1", 2, 10),  # equal repeat is counted once
        station("2", "S1", 12), station("2", "S1", 12, bikes=6), end("2", 1, 12), *batch("3", 13),  # conflict, then recovery
        station("4", "S1", 14), *batch("5", 15),  # next batch before the end marker
        *batch("5", 15),  # already published
        *batch("6", 15),  # not newer
        station("7", "S9", 16), end("7", 1, 16),  # unknown station
        station("8", "S1", 17), end("8", 2, 17),  # wrong count
        station("9", "S1", 18), station("9", "S2", 18, origin="FIXTURE"), end("9", 2, 18),  # mixed origin
        *batch("b", 19, origin="GBFS_LIVE"),  # live data in a recorded consumer
        station("c", "S1", 20, change={"is_renting": None}), end("c", 1, 20),  # missing flag
        station("d", "S1", 21) | {"key": "S2"}, end("d", 1, 21),  # key differs from the station
        json.dumps(station("e", "S1", 22)).replace('"is_renting": true', '"is_renting": true, "is_renting": true'), end("e", 1, 22),  # repeated field
        end("f", 0, 23),  # an empty snapshot is legal
        station("0", "S1", 24), other_time,  # end of another time
    )
    assert harness.run() == [
        ("a", "PUBLISHED", None), ("1", "PUBLISHED", None), ("2", "REJECTED", "STATION_CONFLICT"), ("3", "PUBLISHED", None),
        ("4", "REJECTED", "NEXT_BATCH_BEFORE_END"), ("5", "PUBLISHED", None), ("5", "IGNORED", "ALREADY_PUBLISHED"),
        ("6", "REJECTED", "OLDER_THAN_PUBLISHED"), ("7", "REJECTED", "COUNT_OR_METADATA_MISMATCH"),
        ("8", "REJECTED", "COUNT_OR_METADATA_MISMATCH"), ("9", "REJECTED", "MIXED_BATCH"), ("b", "REJECTED", "INVALID_ORIGIN_FOR_MODE"),
        ("c", "REJECTED", "INVALID_RECORD"), ("d", "REJECTED", "KEY_MISMATCH"), ("e", "REJECTED", "INVALID_RECORD"),
        ("f", "PUBLISHED", None), ("0", "REJECTED", "SNAPSHOT_TIME_MISMATCH"),
    ]
    rows = harness.spark.read.parquet(f"{harness.folder}/verdicts").where("outcome = 'STATION'")
    assert {(r.snapshot_id[0], r["n"]) for r in rows.groupBy("snapshot_id").agg(F.count("*").alias("n")).collect()} == {("a", 3), ("1", 2), ("3", 3), ("5", 3)}
    one = harness.spark.read.parquet(f"{harness.folder}/verdicts").where(F.col("snapshot_id") == SNAP["1"]).where("outcome = 'PUBLISHED'").first()
    assert (one.received, one.duplicates) == (3, 1)


def test_batch_split_over_triggers_and_a_restart(harness):
    whole = batch("a", 1)
    harness.send(*whole[:2])
    assert harness.run() == []
    harness.send(*whole[2:])
    assert harness.run() == [("a", "PUBLISHED", None)]
    harness.send(*batch("a", 1))
    assert harness.run()[-1] == ("a", "IGNORED", "ALREADY_PUBLISHED")


def test_timeout_counts_from_the_first_record(harness):
    harness.send(*batch("a", 1)[:2])
    assert harness.run(timeout=1) == []
    time.sleep(1.5)
    harness.send(*batch("a", 1)[2:])
    assert harness.run(timeout=1) == [("a", "REJECTED", "BATCH_TIMEOUT")]
    harness.send(*batch("b", 2))
    assert harness.run(timeout=60)[-1] == ("b", "PUBLISHED", None)


def test_publication_moves_forward_only(harness):
    root = f"{harness.folder}/served"
    harness.send(*batch("a", 5))
    harness.run(publish_to=root)
    assert pointer(harness.spark, root, "live_release")["snapshot_id"] == SNAP["a"]
    harness.send(*batch("b", 6), *batch("c", 4))
    harness.run(publish_to=root)
    release, risk, moves = publish.live_snapshot(harness.spark, root)
    assert release["snapshot_id"] == SNAP["b"] and release["clock_mode"] == "recorded"
    rows = risk.orderBy("station_id").collect()
    assert [r.station_id for r in rows] == ["S1", "S2", "S3"] and {r.current_status for r in rows} == {"LOW_INVENTORY"}
    assert {r.forecast_reason for r in rows} == {"NO_BASELINE"} and moves.count() == 0
    # The same trigger once more changes nothing.
    gate_rows = harness.spark.read.parquet(f"{harness.folder}/verdicts")
    assert publish.publish(harness.spark, root, gate_rows, harness.metadata) is None


def test_a_station_without_metadata_refuses_the_publication(spark, folder, harness):
    harness.send(*batch("a", 1))
    assert harness.run() == [("a", "PUBLISHED", None)]
    rows = spark.read.parquet(f"{folder}/verdicts")
    with pytest.raises(ValueError, match="1 stations without metadata"):
        publish.publish(spark, f"{folder}/served", rows, harness.metadata.where("station_id <> 'S3'"))
    assert publish.live_snapshot(spark, f"{folder}/served") is None
    assert publish.publish(spark, f"{folder}/served", rows, harness.metadata)
    assert publish.live_snapshot(spark, f"{folder}/served")[1].count() == 3


def test_replay_files(spark, folder, harness):
    harness.send(*batch("a", 1))
    replay = records.load_replay(spark, f"{folder}/in")
    assert {r.headers["data_origin"] for r in replay.collect()} == {"GBFS_REPLAY"} and replay.count() == 4
    publish.write_landed(replay, f"{folder}/landed")
    again = records.read_ndjson(spark, f"{folder}/landed/snapshot_id={SNAP['a']}")
    assert again.count() == 4
    sent = []
    publish.send_records(replay, lambda df: sent.append({r.headers["record_type"] for r in df.collect()}))
    assert sent == [{"station"}, {"snapshot_end"}]
    harness.send(*batch("b", 1))
    with pytest.raises(ValueError):
        records.load_replay(spark, f"{folder}/in")


def test_kafka_rows_become_records(spark):
    rows = spark.sql(
        "SELECT CAST('S1' AS BINARY) AS key, CAST('{}' AS BINARY) AS value, 'bikes' AS topic, 0 AS partition, 7L AS offset,"
        " array(struct('record_type' AS key, CAST('station' AS BINARY) AS value)) AS headers"
    )
    got = records.kafka_records(rows).first()
    assert (got.key, got.headers, got.feed, got.offset.position) == ("S1", {"record_type": "station"}, "bikes-0", 7)


def test_persisted_batches_must_match_their_log(spark):
    from dockflow.operators.quality import rule_violations

    log = spark.sql("SELECT 'd' AS snapshot_directory, sha2('raw', 256) AS status_raw_sha256, sha2('meta', 256) AS metadata_version, 's' AS snapshot_id")
    landed = spark.sql("SELECT 'd' AS snapshot_directory, 'raw' AS status_raw, 'meta' AS metadata_raw, 's' AS recorded_snapshot_id")
    rules = records.persisted_batch_rules()
    assert rule_violations(records.persisted_batches(log, landed), rules).count() == 0
    bad = landed.withColumn("status_raw", F.lit("other"))
    assert [r.rule for r in rule_violations(records.persisted_batches(log, bad), rules).collect()] == ["status_raw_sha256"]


def test_metadata_that_lands_while_the_job_runs(spark, folder, harness):
    path, later, root = f"{folder}/metadata", "9" * 64, f"{folder}/served"
    harness.metadata.write.parquet(path)
    harness.send(*batch("a", 1))
    harness.send(*batch("b", 2, meta=later))
    metadata = spark.read.parquet(path)
    step = live.gated(metadata, gate.Gate(f"{folder}/state", "recorded"), publish.publisher(root, metadata))

    def keep(df, batch_id):
        if batch_id == 1:  # it lands with the records that name it
            harness.metadata.withColumn("metadata_version", F.lit(later)).write.mode("append").parquet(path)
        step(df, batch_id)

    writer = records.stream_ndjson(spark, f"{folder}/in").writeStream.outputMode("append").foreachBatch(keep)
    query = writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    outcomes = spark.read.parquet(f"{root}/live/log").orderBy("trigger").collect()
    assert [(r.snapshot_id[0], r.outcome) for r in outcomes] == [("a", "PUBLISHED"), ("b", "PUBLISHED")]
    assert publish.live_snapshot(spark, root)[0]["metadata_version"] == later


def _one_by_one(rows, origins, limit):
    """The verdicts of a feed by the rules read record after record."""
    out, now, last = [], None, (None, None)
    for r in rows:
        is_end = r["record_type"] == "snapshot_end"
        if now and now["id"] != r["snapshot_id"]:
            if not now["done"]:
                out.append((now["id"], "NEXT_BATCH_BEFORE_END", now["n"], now["twice"]))
            now = None
        if now is None:
            now = {"id": r["snapshot_id"], "head": (r["metadata_version"], r["data_origin"], r["ingested_at"]), "n": 0, "twice": 0, "done": False, "held": {}}
            if r["snapshot_id"] == last[0]:
                out.append((now["id"], "ALREADY_PUBLISHED", 0, 0))
                now["done"] = True
        if not now["done"]:
            held, reason = now["held"].get(r["record_key"]), None
            if r["broken_rule"]:
                reason = "KEY_MISMATCH" if r["broken_rule"] == "key_mismatch" else "INVALID_RECORD"
            elif r["data_origin"] not in origins:
                reason = "INVALID_ORIGIN_FOR_MODE"
            elif (r["metadata_version"], r["data_origin"], r["ingested_at"]) != now["head"]:
                reason = "MIXED_BATCH"
            elif not is_end and held:
                reason = "STATION_CONFLICT" if held[0] != r["value"] else None
                now["n"] += reason is None
                now["twice"] += reason is None
            elif not is_end:
                if last[1] and r["snapshot_at"] <= last[1]:
                    reason = "OLDER_THAN_PUBLISHED"
                elif limit is not None and len(now["held"]) >= limit:
                    reason = "STATION_LIMIT"
                else:
                    now["held"][r["record_key"]] = (r["value"], r["snapshot_at"], r["known_station"])
                    now["n"] += 1
            elif r["station_count"] != len(now["held"]) or not all(h[2] for h in now["held"].values()):
                reason = "COUNT_OR_METADATA_MISMATCH"
            elif any(h[1] != r["snapshot_at"] for h in now["held"].values()):
                reason = "SNAPSHOT_TIME_MISMATCH"
            elif last[1] and r["snapshot_at"] <= last[1]:
                reason = "OLDER_THAN_PUBLISHED"
            else:
                out.append((now["id"], None, now["n"], now["twice"]))
                last, now = (r["snapshot_id"], r["snapshot_at"]), None
                continue
            if reason:
                out.append((now["id"], reason, now["n"], now["twice"]))
                now["done"] = True
        if now["done"] and is_end:
            now = None
    return out


def _random_feed(rng):
    """Records of one feed with breaches of every kind, several to a snapshot."""
    rows, sid = [], 0
    while len(rows) < 60:
        sid = max(1, sid + rng.choice([0, 1, 1, 1, 1]))
        at, n = f"t{sid + rng.choice([0, 0, 0, 0, -2]):03d}", rng.randint(0, 4)
        base = {"snapshot_id": f"s{sid}", "metadata_version": "m", "data_origin": "GBFS_REPLAY", "snapshot_at": at, "ingested_at": "i",
                "broken_rule": None, "known_station": True, "station_count": None}
        for i in range(n):
            odd = {} if rng.random() < 0.85 else rng.choice([
                {"broken_rule": "key_mismatch"}, {"broken_rule": "json"}, {"data_origin": "GBFS_LIVE"}, {"metadata_version": "x"},
                {"known_station": False}, {"snapshot_at": "t999"}])
            key = f"k{rng.randint(0, i)}" if rng.random() < 0.2 else f"k{i}"
            rows.append({**base, "record_type": "station", "record_key": key, "value": f"{key}{rng.random() < 0.05}", **odd})
        if rng.random() < 0.85:
            whole = len({r["record_key"] for r in rows[len(rows) - n :]}) + (rng.random() < 0.1)
            rows.append({**base, "record_type": "snapshot_end", "record_key": "end", "value": "e", "station_count": whole})
    return rows


_TYPES = {"position": "bigint", "station_count": "int", "known_station": "boolean"}


def _frame(spark, feeds, part=lambda rows: rows):
    rows = [{**r, "feed": f"{f:02d}", "feed_file": "f", "position": 3 * i} for f, of in enumerate(feeds) for i, r in part(list(enumerate(of)))]
    return spark.createDataFrame([tuple(r[c] for c in gate.INPUT) for r in rows], ", ".join(f"{c} {_TYPES.get(c, 'string')}" for c in gate.INPUT)).repartition(5)


@pytest.mark.parametrize("limit", [None, 3])
def test_summaries_give_the_verdicts_of_single_records(spark, folder, monkeypatch, limit):
    import random

    monkeypatch.setattr(gate, "CHUNK", 16)  # visits go over many chunks
    rng = random.Random(3)
    feeds = [_random_feed(rng) for _ in range(60)]
    want = {f"{f:02d}": _one_by_one(of, {"GBFS_REPLAY"}, limit) for f, of in enumerate(feeds)}
    assert len({w[1] for of in want.values() for w in of}) == (11 if limit is None else 12)  # the reasons, and none
    plain = lambda r: (r.snapshot_id, r.reason, r.received, r.duplicates)
    # All at once.
    got = {f: [] for f in want}
    whole = gate.verdicts(_frame(spark, feeds), "recorded", limit).where("outcome IS NOT NULL").orderBy("feed", "visit")
    for r in whole.selectExpr("feed", "head.snapshot_id", "reason", "received", "duplicates").collect():
        got[r.feed].append(plain(r))
    assert got == want
    if limit is not None:
        return
    # Trigger by trigger, cut anywhere, one trigger repeated.
    judge, got, cuts = gate.Gate(f"{folder}/state", "recorded", 10**6, limit), {f: [] for f in want}, [0, 13, 41, 1000]
    for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
        frame = _frame(spark, feeds, lambda rows: rows[a:b])
        if number == 1:
            judge(frame, number).count()
        for r in judge(frame, number).where("outcome <> 'STATION'").collect():
            got[r.feed].append(plain(r))
    assert {f: sorted(v, key=repr) for f, v in got.items()} == {f: sorted(v, key=repr) for f, v in want.items()}


def test_a_time_too_old_refuses_a_complete_visit_from_its_first_record(spark):
    base = {"metadata_version": "m", "data_origin": "GBFS_REPLAY", "ingested_at": "i", "broken_rule": None, "known_station": True, "station_count": None}
    row = lambda sid, at, key, value="v": {**base, "snapshot_id": sid, "snapshot_at": at, "record_type": "station", "record_key": key, "value": value}
    end = lambda sid, at, n: {**row(sid, at, "end"), "record_type": "snapshot_end", "station_count": n}
    first = [row("a", "t5", "k0"), end("a", "t5", 1)]
    # A conflict before the old time, and an old repeat in a visit that is whole.
    rows = [*first, row("b", "t6", "k0"), row("b", "t6", "k0", "w"), row("b", "t4", "k1"), end("b", "t6", 2), row("c", "t7", "k0"), row("c", "t3", "k0"), end("c", "t7", 1)]
    said = lambda **kw: [tuple(r) for r in gate.verdicts(_frame(spark, [rows]), "recorded", **kw).orderBy("visit").selectExpr("head.snapshot_id", "reason", "received", "duplicates").collect()]
    assert said(complete=True) == [("a", None, 1, 0), ("b", "OLDER_THAN_PUBLISHED", 0, 0), ("c", "OLDER_THAN_PUBLISHED", 0, 0)]
    assert said() == [("a", None, 1, 0), ("b", "STATION_CONFLICT", 1, 0), ("c", None, 2, 1)]


def test_gate_query_equals_its_sql_where_an_older_snapshot_shares_an_id(spark, folder):
    import duckdb

    import __spark_entry__ as driver
    from compare import differences

    spark.range(56_000, 60_000).withColumnRenamed("id", "event_id").coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    assert differences(spark, con, driver.queries()["gate_verdicts"], driver.oracle_sql()["gate_verdicts"], folder) is None


def test_stations_of_published_visits_come_from_any_trigger(spark, folder):
    base = {"snapshot_id": "s", "metadata_version": "m", "data_origin": "GBFS_REPLAY", "snapshot_at": "t", "ingested_at": "i", "broken_rule": None, "known_station": True}
    rows = [{**base, "record_type": "station", "record_key": f"k{i}", "value": f"v{i}", "station_count": None} for i in range(6)]
    rows.append({**base, "record_type": "snapshot_end", "record_key": "end", "value": "e", "station_count": 6})
    judge = gate.Gate(f"{folder}/state", "recorded")
    assert judge(_frame(spark, [rows], lambda r: r[:4]), 0).count() == 0
    assert judge(_frame(spark, [[]]), 1).count() == 0  # an idle trigger
    last = judge(_frame(spark, [rows], lambda r: r[4:]), 2).collect()
    assert sorted((r.station_id, r.value) for r in last if r.outcome == "STATION") == [(f"k{i}", f"v{i}") for i in range(6)]
    assert [(r.outcome, r.received) for r in last if r.outcome != "STATION"] == [("PUBLISHED", 6)]
    assert judge(_frame(spark, [rows]), 3).collect()[0].reason == "ALREADY_PUBLISHED"


def test_a_batch_times_out_without_new_records(spark, folder):
    base = {"snapshot_id": "s", "metadata_version": "m", "data_origin": "GBFS_REPLAY", "snapshot_at": "t", "ingested_at": "i", "broken_rule": None, "known_station": True}
    row = {**base, "record_type": "station", "record_key": "k", "value": "v", "station_count": None}
    judge, none = gate.Gate(f"{folder}/state", "recorded", 120), _frame(spark, [[]])
    judge(_frame(spark, [[row]]), 0, now_ms=1_000_000)
    assert judge(none, 1, now_ms=1_119_999).count() == 0
    assert [r.reason for r in judge(none, 2, now_ms=1_120_000).collect()] == ["BATCH_TIMEOUT"]
    assert judge(none, 3, now_ms=2_000_000).count() == 0


def test_a_file_of_many_splits(spark, harness):
    """Order, duplicates and verdicts do not depend on how Spark cuts a file."""
    names = [f"S{i % 5 + 1}" for i in range(40)]
    harness.send(*batch("a", 1), *[station("b", n, 2) for n in names], end("b", 5, 2), station("c", "S1", 3), *batch("d", 4))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert harness.run() == [("a", "PUBLISHED", None), ("b", "PUBLISHED", None), ("c", "REJECTED", "NEXT_BATCH_BEFORE_END"), ("d", "PUBLISHED", None)]
        lines = records.read_ndjson(spark, f"{harness.folder}/in")
        assert lines.select("offset.feed_file").distinct().count() > 20 and lines.select("offset").distinct().count() == lines.count() == 50
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    rows = spark.read.parquet(f"{harness.folder}/verdicts").where(F.col("snapshot_id") == SNAP["b"]).where("outcome = 'PUBLISHED'").first()
    assert (rows.received, rows.duplicates) == (40, 35)


def test_two_folders_are_two_feeds(spark, harness):
    for feed in ("one", "two"):
        os.makedirs(f"{harness.folder}/{feed}")
        with open(f"{harness.folder}/{feed}/0001.ndjson", "w") as lines:
            lines.write("\n".join(json.dumps(r) for r in batch("a", 1)))
    read = records.read_ndjson(spark, f"{harness.folder}/one,{harness.folder}/two".split(","))
    assert {r.feed.rsplit("/", 1)[1]: r["count"] for r in read.groupBy("feed").count().collect()} == {"one": 4, "two": 4}
