"""Landed feeds to records to a published snapshot, through the whole live path."""

import json

import pytest
from pyspark.sql import functions as F

from dockflow.operators import quality
from dockflow.operators.quality import rule_violations
from dockflow.plans import collect
from dockflow.sources import records
from dockflow.streaming import publish
from dockflow.streaming.live import start_live

INFO = {"version": "2.3", "last_updated": 1736341000, "ttl": 60, "data": {"stations": [
    {"station_id": "u1", "short_name": "61.15", "name": "One", "lat": 40.7, "lon": -74, "capacity": 20},
    {"station_id": "u2", "short_name": " ", "name": "Two", "lat": 40.71, "lon": -74.01, "capacity": 20}]}}


def status(at, *ids):
    row = {"num_bikes_available": 2, "num_docks_available": 18, "is_installed": 1, "is_renting": 1, "is_returning": True,
           "last_reported": at - 5, "vehicle_types_available": []}
    return {"version": "2.3", "last_updated": at, "ttl": 60, "data": {"stations": [{"station_id": i, **row} for i in ids]}}


def landed(spark, *documents):
    rows = [(f"f{i}", json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "feed string, raw string")


def test_colliding_ids_fail_the_collection(spark):
    """A short name that looks like an isolated station's id would give two stations one identity."""
    stations = [dict(s) for s in INFO["data"]["stations"]]
    stations[0]["short_name"] = "gbfs:u2"
    information = landed(spark, INFO, {**INFO, "data": {"stations": stations}})
    states = landed(spark, status(1736341200, "u1", "u2"), status(1736341200, "u1")).withColumn("ingested_at", F.timestamp_seconds(F.lit(1736341210)))
    with pytest.raises(Exception, match="claimed twice: gbfs:u2 in f1"):
        collect.snapshot_records(information, states).collect()


def test_feeds_to_published_snapshot(spark, folder):
    winter, summer = 1736341200, 1751547600
    information = landed(spark, INFO, INFO, INFO)
    states = landed(spark, status(winter, "u1", "u2", "u9"), status(summer, "u1"), status(summer + 60))
    states = states.withColumn("ingested_at", F.timestamp_seconds(F.lit(summer + 70)))
    out = collect.snapshot_records(information, states, "GBFS_REPLAY").persist()

    flat = records.flat_records(out.select("key", "headers", "value", F.lit("x").alias("feed"), F.lit(0).alias("offset")))
    assert rule_violations(flat, records.event_rules(), "record_key").collect() == []
    verdicts = quality.batch_integrity(flat).collect()
    assert len(verdicts) == 3 and {v.verdict for v in verdicts} == {"COMPLETE"}
    assert sorted(v.stations for v in verdicts) == [0, 1, 3]
    local = {json.loads(r.value)["snapshot_at_local"] for r in out.where("position = 0").collect()}
    assert local == {"2025-01-08T08:00:00-05:00", "2025-07-03T09:00:00-04:00"}
    keys = {r.key for r in out.where("position = 0").collect()}
    assert keys == {"61.15", "gbfs:u2", "gbfs:u9"}

    metadata = collect.canonical_metadata(*(collect.gbfs.documents(d) for d in (information, states)))
    versions = collect.metadata_documents(metadata)
    document = json.loads(versions.where("feed = 'f0'").first().raw)
    assert [s["station_id"] for s in document] == ["61.15", "gbfs:u2", "gbfs:u9"] and document[2]["mapping_reason"] == "MISSING_METADATA"
    known = metadata.join(versions, "feed").select("metadata_version", "station_id", "station_name", "capacity", "lat", "lon").distinct()
    known.write.parquet(f"{folder}/metadata")

    # One replay file per snapshot, its end marker last.
    for i, snapshot in enumerate(r.snapshot_id for r in out.select("snapshot_id", "position").distinct().where("position = 1").collect()):
        lines = out.where(F.col("snapshot_id") == snapshot).orderBy("position", "key").select(F.to_json(F.struct("key", "headers", "value")).alias("value"))
        lines.coalesce(1).write.mode("append").text(f"{folder}/in")
    query = start_live(
        records.stream_ndjson(spark, f"{folder}/in"), spark.read.parquet(f"{folder}/metadata"), f"{folder}/served",
        mode="recorded", trigger={"availableNow": True}, checkpoints=f"{folder}/checkpoints",
    )
    assert query.awaitTermination(300)
    release, risk, moves = publish.live_snapshot(spark, f"{folder}/served")
    assert release["snapshot_at"] == "2025-07-03 13:01:00.000000" and risk.count() == 0 and moves.count() == 0
