"""CSV files to a committed release, with hand-computed results."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from dockflow.operators.trips import GateError
from dockflow.plans.build import build_release
from dockflow.schemas import TRIP_FIELDS
from dockflow.sinks.release import ReleaseError, commit_release, new_attempt, open_release, pointer, publish_release, register_warehouse
from dockflow.sources.trips_csv import numbered_lines, parse_records, read_trip_csv, read_trip_table, register_trip_table

HEADER = ",".join(TRIP_FIELDS)


def trip(ride, start, end, a="P", b="Q", kind="classic_bike", member="member", spot="40.7,-74.0,40.71,-74.01", names=("Pier", "Quay")):
    return f"{ride},{kind},{start},{end},{names[0]},{a},{names[1]},{b},{spot},{member}"


# A June of ten rides: a Tuesday evening out and a Tuesday morning back between pier and quay, a round trip on a Thursday,
# one ride out of the month to an unlisted station, one that ends before it starts, one without a start station, and
# the ids e3 (same content) and e1 (another end) once more.
EAST = [
    trip("e1", "2025-06-03 17:05:00", "2025-06-03 17:25:00"),
    trip("e2", "06/03/2025 17:40:00.25", "06/03/2025 18:02:00", kind="electric_bike", member="casual"),
    trip("e3", "2025-06-10T07:15:00", "2025-06-10T07:45:00", a="Q", b="P"),
    trip("e4", "2025-06-10 07:50:00", "2025-06-10 08:20:00", a="Q", b="P", kind="tandem"),
]
WEST = [
    trip("w1", "2025-06-30 23:30:00", "2025-07-01 00:15:00", b="Z.9", names=('"Pi""er, 1"', "Zed")),
    trip("w2", "2025-06-12 12:00:00", "2025-06-12 12:30:00", a="Q"),
    trip("w3", "2025-06-12 13:00:00", "2025-06-12 12:59:00"),
    trip("w4", "2025-06-13 11:00:00", "2025-06-13 11:05:00", a=" ", spot="NaN,-74.0,95,-74.01"),
]
LATE = [EAST[2], trip("e1", "2025-06-03 17:05:00", "2025-06-03 17:26:00")]
JUNE = {"east.csv": EAST, "west.csv": WEST, "x-late.csv": LATE}


def write_source(folder, parts, counts=None, month="2025-06", header=HEADER, newline="\n"):
    raw = f"{folder}/raw"
    os.makedirs(raw, exist_ok=True)
    entries = []
    for i, (name, rows) in enumerate(parts.items()):
        text = newline.join([header, *rows]) + newline
        with open(f"{raw}/{name}", "w", newline="") as out:
            out.write(text)
        n = len(rows) if counts is None else counts[i]
        entries.append({"filename": name, "size_bytes": len(text), "record_count": n, "header": list(TRIP_FIELDS)})
    manifest = {"source_month": month, "zip_sha256": "ab" * 32, "record_count": sum(e["record_count"] for e in entries),
                "csv_file_count": len(entries), "zip_members": list(parts), "csv_files": entries}
    with open(f"{folder}/manifest.json", "w") as out:
        json.dump(manifest, out)
    stations = [
        {"provider_station_id": f"u{n}", "station_id": n, "mapping_status": "SHORT_NAME", "mapping_reason": None, "station_name": None if n == "P" else f"Name {n}",
         "lat": 40.7, "lon": -74.0, "capacity": 20, "region_id": None, "is_current": True, "metadata_source": "GBFS", "metadata_updated_at": "2025-07-02T00:00:00Z"}
        for n in ("P", "Q")
    ]
    with open(f"{folder}/metadata.json", "w") as out:
        json.dump(stations, out, indent=1)
    return raw, f"{folder}/manifest.json", f"{folder}/metadata.json"


def build(spark, folder, parts, **kw):
    raw, manifest, metadata = write_source(folder, parts, **kw)
    return build_release(spark, raw, manifest, metadata, "2025-06", f"{folder}/out", "2025-07-03 00:00:00")


def test_release_end_to_end(spark, folder):
    release = build(spark, folder, JUNE)
    counts = release["counts"]
    assert (counts["dwd"], counts["valid"], counts["duplicate"], counts["duplicate_conflict"]) == (10, 6, 2, 1)
    assert counts["inbound"] == counts["outbound"] == counts["od_rides"] == 6
    # Station-days: pier on 3, 10, 30 June; quay on 3, 10, 12 June; Z.9 on 1 July. Weekdays: pier Tue, Mon; quay Tue, Thu; Z.9 Tue.
    assert (counts["flow"], counts["profile"], counts["od"], counts["dim"]) == (7 * 24, 5 * 24, 4, 3)
    assert (counts["historical_ids"], counts["matched_ids"]) == (3, 2)
    assert counts["non_positive_duration"] == 1 and counts["missing_start_station"] == 1 and counts["missing_end_station"] == 0
    assert counts["missing_or_invalid_start_coordinate"] == 1 and counts["missing_or_invalid_end_coordinate"] == 1

    with open(f"{folder}/metadata.json", "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    wanted = hashlib.sha256(f"1.1\n{version}\n2025-06:{'ab' * 32}\n".encode()).hexdigest()
    assert release["dataset_id"] == wanted and release["metadata_version"] == version

    tables = open_release(spark, release["release_root"])
    dwd = {(r.source_file, r.source_row_number): r for r in tables["dwd_trip_v1"].collect()}
    assert set(dwd) == {(name, n + 1) for name, rows in JUNE.items() for n in range(len(rows))}
    assert [dwd["x-late.csv", n].is_duplicate_ride for n in (1, 2)] == [True, True] and not dwd["east.csv", 1].is_duplicate_ride
    assert dwd["west.csv", 1].start_station_name == 'Pi"er, 1' and dwd["west.csv", 1].end_station_id == "Z.9"
    assert dwd["east.csv", 2].duration_seconds == 1319
    dim = {r.station_id: r for r in tables["dim_station_v1"].collect()}
    assert dim["P"].station_name == 'Pi"er, 1' and dim["Q"].station_name == "Name Q"
    assert dim["Z.9"].metadata_source == "HISTORICAL" and not dim["Z.9"].is_current and dim["Z.9"].capacity is None
    tuesday = tables["dws_station_hour_profile_v1"].where("station_id = 'P' AND day_of_week = 2 AND hour = 17").first()
    assert (tuesday.avg_outbound, tuesday.median_net_flow, tuesday.sample_days) == (1.0, -1.0, 2)
    flow = tables["dws_station_hourly_flow_v1"].where("station_id = 'P' AND service_date = '2025-06-03' AND hour = 17").first()
    assert (flow.outbound_rides, flow.electric_outbound, flow.classic_outbound, flow.casual_outbound) == (2, 1, 1, 1)
    lines = spark.read.text(f"{release['release_root']}/serving_export/dim_station_v1")
    by_id = {r.value.split("\t")[0]: r.value.split("\t") for r in lines.collect()}
    assert by_id["P"][1] == 'Pi"er, 1' and by_id["P"][8] == "2025-07-02 00:00:00.000000" and by_id["P"][6] == "1"
    assert by_id["Z.9"][4] == release["null_token"]


def test_second_run_returns_the_committed_release(spark, folder):
    first = build(spark, folder, JUNE)
    assert build(spark, folder, JUNE) == first
    # Other content under the same identity is refused, and the release stays as it was.
    with pytest.raises(ReleaseError, match="rows"):
        build(spark, folder, {**JUNE, "east.csv": EAST[:3]})


def test_the_first_descriptor_wins(spark, folder):
    evidence = {"dataset_id": "d", "metadata_version": "m", "source_months": ["2025-06"], "ingest_batch_ids": ["b"], "counts": {"dwd": 1, "ods": None}}
    root = f"{folder}/out"
    first = commit_release(spark, root, new_attempt(root, "d"), evidence, export=False)
    # The loser of a race gets the winner's release; its own folder is not served.
    assert commit_release(spark, root, new_attempt(root, "d"), {**evidence, "counts": {"dwd": 1, "ods": 5}}, export=False) == first
    with pytest.raises(ReleaseError, match="ingest_batch_ids"):
        commit_release(spark, root, new_attempt(root, "d"), {**evidence, "ingest_batch_ids": ["c"]}, export=False)


def test_published_pointer_and_registered_tables(spark, folder):
    release = build(spark, folder, JUNE)
    publish_release(spark, f"{folder}/out", release)
    assert pointer(spark, f"{folder}/out", "historical_release")["dataset_id"] == release["dataset_id"]
    register_warehouse(spark, "dock_test", release["release_root"])
    assert spark.table("dock_test.dws_station_od_hourly_v1").count() == 4
    pruned = spark.table("dock_test.dws_station_hourly_flow_v1").where("service_date = '2025-06-10'")
    assert pruned.count() == 48 and "PartitionFilters: [isnotnull(service_date" in pruned._jdf.queryExecution().toString()
    register_warehouse(spark, "dock_test", release["release_root"])
    spark.sql("DROP DATABASE dock_test CASCADE")


@pytest.mark.parametrize(
    "bad",
    [
        trip("r9", " ", "2025-06-03 08:11:00"),
        trip("r9", "2025-06-03 08:01:00+00:00", "2025-06-03 08:11:00"),
        trip("r9", "2025-06-03 08:01:00", "2025-06-03 08:11:00") + ",extra",
        "r9,only,three",
        trip('"r9', "2025-06-03 08:01:00", "2025-06-03 08:11:00"),
        "",
    ],
)
def test_one_bad_record_refuses_the_batch(spark, folder, bad):
    with pytest.raises(GateError):
        build(spark, folder, {"east.csv": [*EAST, bad]})
    assert not os.path.exists(f"{folder}/out/releases")


def evidence_of(spark, folder):
    return sorted((json.loads(r.value) for r in spark.read.text(f"{folder}/out/attempts/*/*-evidence").collect()), key=lambda e: e["status"])


def test_every_attempt_leaves_evidence(spark, folder):
    bad = trip("r90", "not a time", "2025-06-02 10:00:00")
    blank = trip("", "2025-06-02 09:00:00", "2025-06-02 10:00:00")
    with pytest.raises(GateError, match="unparsed_time"):
        build(spark, folder, {"east.csv": [*EAST, bad, blank]})
    release = build(spark, folder, {"east.csv": EAST})
    failed, passed = evidence_of(spark, folder)
    assert failed["status"] == "FAIL" and failed["source"] == {"rows": len(EAST) + 2, "malformed": 0, "bad_header": 0, "blank_required_field": 1, "unparsed_time": 1}
    refused = {(r.refused, r.ride_id, r.source_file, r.source_row_number) for r in spark.read.parquet(failed["quarantine"]).collect()}
    assert {(kind, name, n) for kind, _, name, n in refused} == {("UNPARSED_TIME", "east.csv", len(EAST) + 1), ("BLANK_REQUIRED_FIELD", "east.csv", len(EAST) + 2)}
    assert passed["status"] == "PASS" and passed["counts"] == release["counts"] and "quarantine" not in passed


def test_preflight_and_expected_count(spark, folder):
    raw, manifest, metadata = write_source(folder, {"east.csv": EAST})
    go = lambda **kw: build_release(spark, raw, manifest, metadata, "2025-06", f"{folder}/out", "2025-07-03 00:00:00", **kw)
    with pytest.raises(GateError, match="given count"):
        go(ods_count=len(EAST) + 1)
    with open(f"{raw}/extra.csv", "w") as out:
        out.write(HEADER + "\n")
    with open(f"{raw}/east.csv", "a") as out:
        out.write("\n")
    with pytest.raises(GateError, match="east.csv.*DIFFERENT.*extra.csv.*EXTRA"):
        go()
    assert [e["status"] for e in evidence_of(spark, folder)] == ["FAIL", "FAIL"] and not os.path.exists(f"{folder}/out/releases")


def test_wrong_header_and_counts_refuse_the_batch(spark, folder):
    with pytest.raises(GateError, match="bad_header"):
        build(spark, folder, {"east.csv": EAST}, header=HEADER.upper())
    with pytest.raises(GateError, match="record counts"):
        build(spark, folder, {"east.csv": EAST, "west.csv": WEST}, counts=[4, 5])


def test_line_numbers_do_not_depend_on_splits(spark, folder):
    raw, *_ = write_source(folder, {"a.csv": [trip(f"r{i}", "x", "y") for i in range(500)], "b.csv": [trip(f"q{i}", "x", "y") for i in range(300)]}, newline="\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "4000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            lines = numbered_lines(spark, [f"{raw}/a.csv", f"{raw}/b.csv"], f"{folder}/offsets-{size}")
            assert lines.rdd.getNumPartitions() > (10 if size == "4000" else 0)
            plan = lines._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
            got = {(r.source_file, r.line_number): r.line[:5].split(",")[0] for r in lines.collect()}
            want = {("a.csv", i + 1): f"r{i}" for i in range(500)} | {("b.csv", i + 1): f"q{i}" for i in range(300)}
            want |= {("a.csv", 0): "ride_", ("b.csv", 0): "ride_"}
            assert got == want
            lazy = numbered_lines(spark, [f"{raw}/a.csv", f"{raw}/b.csv"])
            assert {(r.source_file, r.line_number) for r in lazy.collect()} == set(want)
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        stale = numbered_lines(spark, [f"{raw}/a.csv", f"{raw}/b.csv"], f"{folder}/offsets-stale")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
        with pytest.raises(Exception, match="split differently"):
            stale.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_strict_record_shape(spark):
    good = trip("r", "s", "e")
    cases = {
        good: False, good.replace("Pier", '"Pi,er"'): False, good.replace("Pier", '"a""b"'): False, good.replace("Pier", 'a"b'): False,
        good.replace("Pier", '"a"b'): True, good.replace("Pier", '"a'): True, good + ",": True, good.rsplit(",", 1)[0]: True, "": True,
    }
    rows = spark.createDataFrame([("f", i, line) for i, line in enumerate(cases)], "source_file string, line_number bigint, line string")
    got = {r.source_row_number: r.malformed for r in parse_records(rows).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_plain_and_table_scans(spark, folder):
    raw, *_ = write_source(folder, {"a.csv": EAST})
    assert read_trip_csv(spark, f"{raw}/a.csv").count() == 4
    month = f"{folder}/ods/year=2025/month=1"
    os.makedirs(month)
    os.makedirs(f"{folder}/ods/year=2024/month=12")
    for where in (month, f"{folder}/ods/year=2024/month=12"):
        with open(f"{where}/a.csv", "w") as out:
            out.write("\n".join([HEADER, *EAST]) + "\n")
    register_trip_table(spark, "ods_trips_test", f"{folder}/ods")
    assert spark.table("ods_trips_test").count() == 10
    assert read_trip_table(spark, "ods_trips_test", 2025, 1).count() == 4
    spark.sql("DROP TABLE ods_trips_test")
    with open(f"{folder}/wrong.csv", "w") as out:
        out.write(HEADER.replace("ride_id", "id") + "\n")
    with pytest.raises(GateError):
        read_trip_csv(spark, f"{folder}/wrong.csv")


def test_clock_change_durations(spark):
    from dockflow.operators.trips import typed_trips

    row = dict.fromkeys(TRIP_FIELDS, "1") | {"started_at": "2025-03-09 01:50:00", "ended_at": "2025-03-09 03:10:00"}
    raw = spark.createDataFrame([row], ", ".join(f"{n} string" for n in TRIP_FIELDS))
    assert typed_trips(raw, "ltz").first().duration_seconds == 1200
    assert typed_trips(raw, "ntz").first().duration_seconds == 4800
    gap = raw.withColumn("started_at", F.lit("2025-03-09 02:30:00"))
    assert str(typed_trips(gap, "ltz").select(F.col("started_at_local").cast("string")).first()[0]) == "2025-03-09 03:30:00"
