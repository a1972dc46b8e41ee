"""Risk, rebalancing, feed and lookup rules on small hand-computed inputs."""

import datetime as dt
import itertools
import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dockflow.functions.status import fill_class
from dockflow.operators import greedy as greedy_moves
from dockflow.operators import quality, rebalance, risk, serving, stations
from dockflow.operators.trips import GateError, flag_first_seen
from dockflow.sinks.tsv import null_token
from dockflow.sources import gbfs, inventory, manifest, metadata
from dockflow.schemas import TRIP_CSV, TRIP_FIELDS

T0 = dt.datetime(2025, 1, 8, 13, 0, 0)
OBS = (
    "name string, snapshot_at timestamp_ntz, last_reported_at timestamp_ntz, as_of timestamp_ntz, bikes int, docks int,"
    " is_installed boolean, is_renting boolean, is_returning boolean"
)


def observation(name, snapshot=0, reported=0, as_of=0, bikes=10, docks=10, installed=True, renting=True, returning=True):
    at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    return (name, at(snapshot), at(reported), at(as_of), bikes, docks, installed, renting, returning)


def test_status_ladder(spark):
    cases = [
        (observation("no time", snapshot=None, as_of=5), "INVALID_DATA", "INVALID_TIME"),
        (observation("61 s ahead", snapshot=61, reported=0), "INVALID_DATA", "INVALID_TIME"),
        (observation("report 61 s ahead", reported=61), "INVALID_DATA", "INVALID_TIME"),
        (observation("60 s ahead", snapshot=60, reported=60), "HEALTHY", None),
        (observation("179 s old", as_of=179), "HEALTHY", None),
        (observation("180 s old", as_of=180), "STALE_DATA", "STALE_OBSERVATION"),
        (observation("old report", reported=-150, as_of=30), "STALE_DATA", "STALE_OBSERVATION"),
        (observation("no report", reported=None, as_of=179), "HEALTHY", None),
        (observation("off and negative", bikes=-1, renting=False), "SERVICE_UNAVAILABLE", "SERVICE_FLAGS"),
        (observation("off and unknown", installed=None, returning=False), "SERVICE_UNAVAILABLE", "SERVICE_FLAGS"),
        (observation("negative docks", docks=-1), "INVALID_DATA", "NEGATIVE_INVENTORY"),
        (observation("negative and unknown", bikes=-1, docks=None), "INVALID_DATA", "NEGATIVE_INVENTORY"),
        (observation("unknown flag", renting=None), "INSUFFICIENT_DATA", "MISSING_INVENTORY"),
        (observation("unknown docks", docks=None), "INSUFFICIENT_DATA", "MISSING_INVENTORY"),
        (observation("nothing", bikes=0, docks=0), "INSUFFICIENT_DATA", "ZERO_SERVICEABLE_CAPACITY"),
        (observation("huge", bikes=2**31 - 1, docks=2**31 - 1), "HEALTHY", None),
    ]
    rows = risk.current_status(spark.createDataFrame([c[0] for c in cases], OBS)).collect()
    got = {r.name: (r.current_status, r.current_reason) for r in rows}
    assert got == {c[0][0]: c[1:] for c in cases}
    missing = next(r for r in rows if r.name == "no time")
    assert missing.expires_at == T0 + dt.timedelta(seconds=5)


def test_fill_class_bounds(spark):
    bounds = [(0.15, "SHORTAGE_RISK"), (0.1500001, "LOW_INVENTORY"), (0.30, "LOW_INVENTORY"), (0.3000001, "HEALTHY"), (0.6999999, "HEALTHY"),
              (0.70, "HIGH_INVENTORY"), (0.8499999, "HIGH_INVENTORY"), (0.85, "OVERFLOW_RISK"), (-3.0, "SHORTAGE_RISK"), (9.0, "OVERFLOW_RISK")]
    rows = spark.createDataFrame(bounds, "r double, want string").select("want", fill_class(F.col("r")).alias("got")).collect()
    assert all(r.want == r.got for r in rows)


def test_forecast_uses_the_city_hour_and_keeps_failures(spark):
    rows = [("A", *observation("x")[1:]), ("B", *observation("x", renting=False)[1:]), ("C", *observation("x")[1:]), ("D", *observation("x")[1:])]
    obs = spark.createDataFrame(rows, OBS.replace("name", "station_id"))
    # 13:00 UTC on this Wednesday is 08:00 in the city.
    profile = spark.createDataFrame(
        [("A", 3, 8, 1.0, 9.0, -8.0, 2), ("B", 3, 8, 1.0, 2.0, -1.0, 2), ("D", 3, 8, 1.0, 2.0, -1.0, 0), ("C", 3, 13, 1.0, 2.0, -1.0, 1)],
        "station_id string, day_of_week tinyint, hour tinyint, avg_inbound double, avg_outbound double, avg_net_flow double, sample_days bigint",
    )
    got = {r.station_id: r for r in risk.station_risk(obs, profile).collect()}
    assert (got["A"].projected_bikes_1h, got["A"].forecast_status, got["A"].forecast_for) == (2.0, "SHORTAGE_RISK", T0 + dt.timedelta(hours=1))
    assert (got["B"].forecast_status, got["B"].forecast_reason, got["B"].sample_days) == ("SERVICE_UNAVAILABLE", "SERVICE_FLAGS", None)
    for name in "CD":
        assert (got[name].forecast_status, got[name].forecast_reason, got[name].fill_ratio) == ("INSUFFICIENT_DATA", "NO_BASELINE", 0.5)
    bare = {r.station_id: r for r in risk.station_risk(obs, profile, has_baseline=False).collect()}
    assert bare["A"].forecast_reason == "NO_BASELINE" and bare["A"].projected_bikes_1h is None


ENDS = ("snapshot_at timestamp_ntz, station_id string, current_status string, forecast_status string, bikes int, docks int, capacity int,"
        " lat double, lon double, projected_bikes_1h double, expires_at timestamp_ntz")  # fmt: skip


def end(station, bikes, docks, capacity, projected, lat=40.7, lon=-74.0, snapshot=0, status="HEALTHY", expires=100):
    size = bikes + docks
    forecast = "SHORTAGE_RISK" if projected / size <= 0.15 else "OVERFLOW_RISK" if projected / size >= 0.85 else "HEALTHY"
    at = T0 + dt.timedelta(minutes=snapshot)
    return (at, station, status, forecast, bikes, docks, capacity, lat, lon, projected, at + dt.timedelta(seconds=expires))


def moves_of(spark, rows):
    found = rebalance.rebalance(rebalance.rebalance_ends(spark.createDataFrame(rows, ENDS)))
    return sorted(found.collect(), key=lambda r: (r.snapshot_at, r.priority))


def test_rebalance_worked_examples(spark):
    rows = [
        # Supply 8, need 8, ample safe amounts: 8 bikes.
        end("src", 34, 6, 40, 36.0, lon=-74.001), end("dst", 6, 34, 40, 4.0, expires=50),
        # Nothing may leave a station that is short now, whatever its forecast.
        end("src", 2, 38, 40, 36.0, snapshot=1), end("dst", 6, 34, 40, 4.0, snapshot=1),
        # Fractions: capacity 41, supply 7, need 8.
        end("src", 35, 6, 41, 36.6, snapshot=2), end("dst", 6, 35, 41, 4.4, snapshot=2),
        # A station without capacity or out of service takes no part.
        end("src", 34, 6, None, 36.0, snapshot=3), end("dst", 6, 34, 40, 4.0, snapshot=3),
        end("src", 34, 6, 40, 36.0, snapshot=4, status="SERVICE_UNAVAILABLE"), end("dst", 6, 34, 40, 4.0, snapshot=4),
    ]
    got = moves_of(spark, rows)
    assert [(r.snapshot_at.minute, r.move_bikes, r.from_surplus, r.to_deficit) for r in got] == [(0, 8, 8, 8), (2, 7, 7, 8)]
    assert got[0].expires_at == T0 + dt.timedelta(seconds=50) and got[0].distance_meters == 84


def greedy(rows):
    """Plain greedy assignment over all pairs, with six separate balances."""

    def metres(a, b):
        p, q = math.radians(a[7]), math.radians(b[7])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[8] - a[8]) / 2) ** 2
        return 6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    stock = {}
    for r in rows:
        s, c, p, b, d = r[4] + r[5], r[6], r[9], r[4], r[5]
        stock[r[1]] = {"need": max(0, math.ceil(3 * c / 10 - p)), "supply": max(0, math.floor(p - 7 * c / 10)), "keep": max(0, b - (3 * s + 9) // 10),
                       "take": max(0, 7 * s // 10 - b), "bikes": b, "docks": d}
    targets = sorted((r for r in rows if r[3] == "SHORTAGE_RISK"), key=lambda r: (-stock[r[1]]["need"], r[1]))
    sources = [r for r in rows if r[3] == "OVERFLOW_RISK"]
    out = []
    for t in targets:
        for s in sorted(sources, key=lambda s: (metres(t, s), s[1])):
            a, b = stock[s[1]], stock[t[1]]
            n = min(a["supply"], a["keep"], a["bikes"], b["need"], b["docks"], b["take"])
            if n > 0:
                out.append((s[1], t[1], n, a["supply"], b["need"], len(out) + 1))
                for side, names in ((a, ("supply", "keep", "bikes")), (b, ("need", "docks", "take"))):
                    for name in names:
                        side[name] -= n
    return out


def test_rebalance_equals_brute_force(spark):
    rng = random.Random(5)
    snapshots = {}
    for snapshot in range(12):
        rows = []
        for i in range(rng.choice([2, 60, 150])):
            bikes, docks = rng.randrange(0, 40), rng.randrange(1, 40)
            projected = bikes + rng.uniform(-25, 25)
            rows.append(end(f"S{i:03d}", bikes, docks, rng.randrange(10, 60), projected, 40.6 + rng.random() / 5, -74 + rng.random() / 5, snapshot))
        snapshots[snapshot] = rows
    got = {}
    for r in moves_of(spark, [r for rows in snapshots.values() for r in rows]):
        got.setdefault(r.snapshot_at.minute, []).append((r.from_station_id, r.to_station_id, r.move_bikes, r.from_surplus, r.to_deficit, r.priority))
    want = {s: greedy(rows) for s, rows in snapshots.items()}
    assert got == {s: m for s, m in want.items() if m} and sum(map(len, got.values())) > 100


@pytest.mark.parametrize("shape", ["city", "globe", "line", "same place", "far targets"])
def test_nearest_sources_by_rings(shape):
    """The grid gives all open sources in the order of a full sort, whatever their shape, while sources run out."""
    from types import SimpleNamespace

    rng = random.Random(11)
    place = {
        "city": lambda: (40.6 + rng.random() / 5, -74 + rng.random() / 5), "globe": lambda: (rng.uniform(-89, 89), rng.uniform(-180, 180)),
        "line": lambda: (40.7, -74 + rng.randrange(50) / 100), "same place": lambda: (40.7, -74.0),
        "far targets": lambda: (40.6 + rng.random() / 50, -74 + rng.random() / 50),
    }[shape]
    ends = [SimpleNamespace(station_id=f"S{i:04d}", room=2, amount=2, lat=(p := place())[0], lon=p[1], expires_at=0) for i in range(700)]
    sources, opened = greedy_moves.Sources(ends), set(range(700))
    for _ in range(120):
        lat, lon = place() if shape != "far targets" else (rng.uniform(39, 42), rng.uniform(-76, -72))
        metres = greedy_moves._metres(lat, lon, sources.lats, sources.lons)
        want = sorted(opened, key=lambda i: (metres[i], i))
        got = list(itertools.islice(sources.nearest(lat, lon), 25))
        assert [i for _, i in got] == want[:25]
        for _, i in got[:4]:
            sources.take(i, 2)
            opened.discard(i)


def test_snapshots_arrive_over_batches():
    """A snapshot's targets may come in any number of batches after its sources."""
    rows = []
    for s in (1, 2, None):
        rows += [(s, False, f"A{i}", 3, 3, 40.0, -74.0 + i / 100, 9) for i in range(3)]
        rows += [(s, True, f"T{i}", 2, 2, 40.0, -74.0, 9) for i in range(6)]
    frame = pd.DataFrame(rows, columns=["at", *greedy_moves.END], dtype=object)
    whole = pd.concat(greedy_moves.assign_batches([frame], "at"), ignore_index=True)
    parts = pd.concat(greedy_moves.assign_batches([frame.iloc[i : i + 2] for i in range(0, len(frame), 2)], "at"), ignore_index=True)
    assert parts.fillna(-1).values.tolist() == whole.fillna(-1).values.tolist() and whole["move_bikes"].sum() == 27 and len(set(whole["priority"])) * 3 == len(whole)


def test_names_repeated_at_any_depth_are_no_document(spark):
    """A repeated name makes a document unreadable as a whole, however deep it is: neither of its values may win."""
    from dockflow.operators.quality import rule_violations

    fine = '{"version": "2.3", "last_updated": 1, "ttl": 60, "data": {"stations": [{"station_id": "a", "vehicle_types_available": [{"count": 1}]}]}}'
    rows = [("fine", fine), ("top", fine.replace('"ttl": 60', '"ttl": 60, "ttl": 60')), ("row", fine.replace('"station_id": "a"', '"station_id": "a", "station_id": "b"')),
            ("deep", fine.replace('"count": 1', '"count": 1, "count": 2')), ("data", fine.replace('"data": {', '"data": {"stations": [], '))]
    docs = gbfs.documents(spark.createDataFrame(rows, "feed string, raw string"))
    broken = {r.feed for r in rule_violations(docs, gbfs.envelope_rules("stations"), "feed").where("rule = 'json'").collect()}
    assert broken == {"top", "row", "deep", "data"}


def test_invariants_report_a_broken_assignment(spark):
    rows = spark.createDataFrame([end("src", 34, 6, 40, 36.0), end("dst", 6, 34, 40, 4.0)], ENDS)
    ends = rebalance.rebalance_ends(rows)
    good = rebalance.rebalance(ends)
    assert {r.violations for r in rebalance.suggestion_breaches(good, ends).collect()} == {0}
    bad = good.withColumn("move_bikes", F.lit(9)).unionByName(good)
    got = {r.rule: r.violations for r in rebalance.suggestion_breaches(bad, ends).collect()}
    assert got == {"positive_move": 0, "unique_pair": 1, "source_limit": 1, "target_limit": 1, "priority_sequence": 2}


def test_first_seen_flags_under_skew(spark):
    rows = [("hot", i, "same" if i % 2 else "other") for i in range(400)] + [(f"k{i}", i, "x") for i in range(200)]
    df = spark.createDataFrame(rows, "k string, n int, content string").repartition(7)
    flagged = flag_first_seen(df, "k", ("n",), "content", "dup").collect()
    assert sum(r.dup for r in flagged) == 399 and [r.n for r in flagged if r.k == "hot" and not r.dup] == [0]
    assert sum(r.is_conflict for r in flagged) == 200 and len(flagged) == 600


FEED = {
    "last_updated": 1736341200, "ttl": 60, "version": "2.3",
    "data": {"stations": [{"station_id": "u1", "num_bikes_available": 3, "num_docks_available": -1, "is_installed": 1, "is_renting": True, "is_returning": 0,
                           "last_reported": 1736341100, "vehicle_types_available": [{"vehicle_type_id": "1", "count": 2}, {"vehicle_type_id": "2", "count": 2}]}]},
}


def feed(spark, *documents):
    import json

    texts = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return gbfs.documents(spark.createDataFrame(texts, "n int, raw string"))


def changed(**fields):
    station = {**FEED["data"]["stations"][0], **fields}
    return {**FEED, "data": {"stations": [{k: v for k, v in station.items() if v != "drop"}]}}


@pytest.mark.parametrize(
    "fields, rule",
    [
        ({}, None),
        ({"station_id": 7}, "station_id"), ({"station_id": ""}, "station_id"), ({"num_bikes_available": 1.5}, "num_bikes_available"),
        ({"num_bikes_available": None}, "num_bikes_available"), ({"num_bikes_available": "drop"}, "num_bikes_available"),
        ({"num_docks_available": "4"}, "num_docks_available"), ({"num_docks_available": None}, None), ({"is_renting": 2}, "is_renting"),
        ({"is_installed": "true"}, "is_installed"), ({"last_reported": -1}, "last_reported"), ({"vehicle_types_available": {}}, "vehicle_types_available"),
        ({"vehicle_types_available": [{"vehicle_type_id": "1", "count": True}]}, "vehicle_type_entry"),
        ({"vehicle_types_available": [{"count": 1}]}, "vehicle_type_entry"),
    ],
)
def test_status_feed_rules(spark, fields, rule):
    rows = gbfs.feed_rows(feed(spark, changed(**fields)), "stations", "n")
    broken = {r.rule for r in quality.rule_violations(rows, gbfs.status_rules()).collect() if r.severity == "error"}
    assert broken == ({rule} if rule else set())


def test_feed_envelope_events_and_warnings(spark):
    docs = feed(spark, FEED, {**FEED, "version": "3.0"}, {**FEED, "last_updated": "now"}, "[1]", "{not json", {**FEED, "data": {}})
    broken = {}
    for r in quality.rule_violations(docs, gbfs.envelope_rules("stations"), "n").collect():
        broken.setdefault(r.n, set()).add(r.rule)
    assert broken[1] == {"version"} and broken[2] == {"last_updated"} and broken[5] == {"rows"} and 0 not in broken
    assert "json" in broken[3] and "json" in broken[4]
    rows = gbfs.feed_rows(docs.where("n = 0"), "stations", "n")
    event = gbfs.status_events(rows, F.timestamp_seconds(F.lit(1736341230))).first()
    assert str(event.snapshot_at_local) == "2025-01-08 08:00:00" and event.is_returning is False and event.num_docks_available == -1
    warned = {(r.warning, r.field, r.value, r.expected) for r in gbfs.status_warnings(rows).collect()}
    assert warned == {("vehicle_count_mismatch", "num_bikes_available", 3, 4), ("negative_inventory", "num_docks_available", -1, None)}


def test_discovery_and_other_feeds(spark):
    discovery = {"data": {"en": {"feeds": [{"name": "station_status", "url": "u"}, {"name": "vehicle_types", "url": "v"}]}}}
    feeds = gbfs.discovery_feeds(feed(spark, discovery))
    assert [r.name for r in gbfs.missing_feeds(spark, feeds).collect()] == ["station_information"]
    info = {"version": "2.3", "last_updated": 1, "data": {"stations": [
        {"station_id": "u1", "short_name": " 61.15 ", "name": " N ", "lat": 40.7, "lon": -74, "capacity": 0, "region_id": "7"},
        {"station_id": "u2", "short_name": "dup", "name": "b", "lat": 95, "lon": -74.1, "capacity": 5}, {"station_id": "u3", "short_name": "dup", "name": "c", "lat": 1, "lon": 2},
        {"station_id": "u4", "name": "d", "lat": "x", "lon": 2}]}}
    rows = gbfs.feed_rows(feed(spark, info), "stations", "n")
    bad = {(r.position, r.rule) for r in quality.rule_violations(rows, gbfs.information_rules(), "position").collect()}
    assert bad == {(0, "capacity"), (1, "lat_range"), (3, "lat")}
    table = gbfs.information_table(rows)
    mapped = {r.provider_station_id: (r.station_id, r.mapping_reason) for r in stations.canonical_mapping(table).collect()}
    assert mapped == {"u1": ("61.15", None), "u2": ("gbfs:u2", "DUPLICATE_SHORT_NAME"), "u3": ("gbfs:u3", "DUPLICATE_SHORT_NAME"), "u4": ("gbfs:u4", "MISSING_SHORT_NAME")}
    vehicles = {"version": "2.3", "data": {"vehicle_types": [{"vehicle_type_id": "1", "form_factor": "bicycle", "propulsion_type": "human", "max_range_meters": "far"}]}}
    types = gbfs.feed_rows(feed(spark, vehicles), "vehicle_types", "n")
    assert [r.rule for r in quality.rule_violations(types, gbfs.vehicle_type_rules()).collect()] == ["max_range_meters"]


GOOD_MANIFEST = {"source_month": "2025-01", "zip_sha256": "a" * 64, "record_count": 3, "csv_files": [
    {"filename": "a.csv", "size_bytes": 5, "record_count": 1, "header": list(TRIP_FIELDS)}, {"filename": "b.csv", "size_bytes": 6, "record_count": 2, "header": list(TRIP_FIELDS)}]}


@pytest.mark.parametrize(
    "change, rule",
    [
        (lambda m: None, None), (lambda m: m.update(source_month="2025-02"), "source_month"), (lambda m: m.update(zip_sha256="A" * 64), "zip_sha256"),
        (lambda m: m.update(csv_files=[], record_count=0), "csv_files"), (lambda m: m["csv_files"][0].update(filename="../a.csv"), "filename"),
        (lambda m: m["csv_files"][0].update(filename="b.csv"), "duplicate_filename"), (lambda m: m["csv_files"][1].update(header=["x"]), "header"),
        (lambda m: (m["csv_files"][0].update(record_count=-1), m.update(record_count=1)), "file_count"), (lambda m: m.update(record_count=4), "record_count"),
    ],
)
def test_manifest_rules(spark, folder, change, rule):
    import copy
    import json

    document = copy.deepcopy(GOOD_MANIFEST)
    change(document)
    with open(f"{folder}/m.json", "w") as out:
        json.dump(document, out)
    if rule is None:
        assert manifest.load_manifest(spark, f"{folder}/m.json", "2025-01")["record_count"] == 3
    else:
        with pytest.raises(GateError, match=rf"\['{rule}'\]"):
            manifest.load_manifest(spark, f"{folder}/m.json", "2025-01")
    assert manifest.expected_count(3, None) == 3
    with pytest.raises(GateError):
        manifest.expected_count(3, 4)


def test_metadata_is_refused_whole(spark, folder):
    import json

    row = {"provider_station_id": "u1", "station_id": "A", "mapping_status": "SHORT_NAME", "station_name": "n", "lat": 1.0, "lon": 2.0, "capacity": 5,
           "is_current": True, "metadata_source": "GBFS", "metadata_updated_at": "2025-01-01T00:00:00Z"}
    for i, (rows, message) in enumerate([
        ([row], None), ([row, {**row, "provider_station_id": "u2"}], "duplicate metadata station_id"), ([{**row, "station_id": "A B"}], "station_id"),
        ([{**row, "mapping_status": "ISOLATED", "mapping_reason": "MISSING_METADATA"}], "mapping"), ([{**row, "capacity": 0}], "capacity"),
        ([{**row, "lat": 91.0}], "lat"), ([{**row, "station_name": " n"}], "station_name"), ([{**row, "is_current": False}], "not_current"),
    ]):
        path = f"{folder}/{i}.json"
        with open(path, "w") as out:
            json.dump(rows, out)
        if message is None:
            assert metadata.load_metadata(spark, path).count() == 1
        else:
            with pytest.raises(GateError, match=message):
                metadata.load_metadata(spark, path)


def test_inventories(spark, folder):
    import os

    for side, files in {"raw": {"a.csv": "1", "b.csv": "22"}, "ods": {"a.csv": "1", "b.csv": "23", "c.csv": "3"}}.items():
        os.makedirs(f"{folder}/{side}")
        for name, text in files.items():
            with open(f"{folder}/{side}/{name}", "w") as out:
                out.write(text)
    raw, ods = inventory.inventory(spark, f"{folder}/raw"), inventory.inventory(spark, f"{folder}/ods")
    assert {(r.filename, r.verdict) for r in inventory.copy_differences(raw, ods).collect()} == {("b.csv", "DIFFERENT"), ("c.csv", "EXTRA")}
    assert inventory.totals(raw).first().asDict() == {"file_count": 2, "byte_count": 3}
    listed = spark.createDataFrame([("a.csv", None), ("b.csv", 3), ("z.csv", 1)], "filename string, size_bytes bigint")
    got = {(r.filename, r.verdict) for r in inventory.manifest_differences(listed, raw).collect()}
    assert got == {("b.csv", "DIFFERENT"), ("z.csv", "MISSING")}


def test_bounded_and_tokens_and_schema(spark):
    df = spark.range(5)
    assert serving.bounded(df, 5, "rows").count() == 5
    with pytest.raises(serving.TooLarge):
        serving.bounded(df, 4, "rows")
    taken = spark.createDataFrame([("__DOCKFLOW_NULL_d_0__",)], "s string")
    assert null_token([taken, df.select(F.col("id"))], "d") == "__DOCKFLOW_NULL_d_1__"
    assert null_token([df.select(F.col("id"))], "d") == "__DOCKFLOW_NULL_d_0__"
    summary = quality.schema_summary(spark, spark.sql("SELECT 'x' AS ride_id, 1 AS start_lat"), TRIP_CSV).collect()
    assert [r.matches for r in summary if r.name in ("ride_id", "start_lat")] == [True, False]
    counts = spark.createDataFrame([(1, 1, 1), (1, None, 1), (1, 2, 1), (None, None, 1)], "a int, b int, c int")
    assert [r.status for r in quality.reconcile_counts(counts, "a", "b", "c").collect()] == ["PASS", "PARTIAL", "FAIL", "NOT_RUN"]


def test_mistyped_events_and_foreign_headers_are_refused(spark):
    from dockflow.operators.quality import rule_violations
    from dockflow.sources import records

    value = {
        "station_id": "S1", "snapshot_at_utc": "2025-07-03T13:00:00Z", "snapshot_at_local": "2025-07-03T09:00:00-04:00", "num_bikes_available": 3,
        "num_bikes_disabled": None, "num_docks_available": 4, "num_docks_disabled": 0, "is_installed": True, "is_renting": True, "is_returning": True,
        "last_reported_at_utc": None, "ingested_at_utc": "2025-07-03T13:00:05Z", "source_version": "2.3",
    }
    headers = {"contract_version": "1.1", "record_type": "station", "snapshot_id": "a" * 64, "metadata_version": "b" * 64, "data_origin": "GBFS_LIVE"}
    cases = [({}, {}, set())]
    cases += [({k: v}, {}, {f"kind_{k}"}) for k, v in (("num_bikes_disabled", "x"), ("num_docks_available", "many"), ("num_docks_disabled", 1.5), ("is_renting", 1))]
    cases += [({"num_bikes_available": None}, {}, {"kind_num_bikes_available", "bikes"}), ({}, {"trace": "1"}, {"header_names"})]
    rows = [("S1", {**headers, **h}, json.dumps({**value, **v})) for v, h, _ in cases]
    frame = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "feed string, key string, headers map<string,string>, value string")
    flat = records.flat_records(frame.withColumn("offset", F.lit(0)))
    got = {}
    for r in rule_violations(flat, records.event_rules(), "feed").collect():
        got.setdefault(int(r.feed), set()).add(r.rule)
    for i, (_, _, want) in enumerate(cases):
        assert want <= got.get(i, set()) and (want or not got.get(i)), (i, got.get(i))


def test_only_a_sent_attempt_blocks_others(spark):
    from dockflow.operators.snapshots import snapshot_states

    rows = [(1, "t", "x", False), (2, "t", "x", True), (3, "t", "x", False), (4, "t", "y", True), (5, "u", "z", False)]
    states = snapshot_states(spark.createDataFrame(rows, "attempt int, provider_time string, status_raw_sha256 string, sent boolean"))
    assert {r.attempt: r.state for r in states.collect()} == {
        1: "FAILED_SEND", 2: "PUBLISHED", 3: "SKIPPED_DUPLICATE", 4: "REJECTED_CONFLICT", 5: "FAILED_SEND",
    }
