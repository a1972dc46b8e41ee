"""Live publication: complete batches become risk and suggestions behind one pointer."""

import datetime
import uuid

from pyspark.sql import functions as F

from dockflow.operators import rebalance, risk
from dockflow.schemas import STATION_EVENT
from dockflow.sinks.release import open_release, point_to, pointer

POINTER = "live_release"
# A snapshot may be empty, so readers do not infer these.
RISK_TABLE = (
    "station_id string, metadata_version string, data_origin string, snapshot_at timestamp, last_reported_at timestamp,"
    " ingested_at timestamp, received_at timestamp, bikes int, docks int, is_installed boolean, is_renting boolean,"
    " is_returning boolean, clock_mode string, as_of timestamp, station_name string, capacity int, lat double, lon double,"
    " current_reason string, expires_at timestamp, serviceable bigint, fill_ratio double, current_status string,"
    " sample_days bigint, forecast_reason string, forecast_status string, expected_inbound_1h double,"
    " expected_outbound_1h double, expected_net_flow_1h double, projected_bikes_1h double, forecast_for timestamp,"
    " snapshot_id string"
)
SUGGESTION_TABLE = (
    "from_station_id string, to_station_id string, move_bikes int, from_surplus int, to_deficit int, distance_meters int,"
    " priority int, expires_at timestamp, suggestion_id string, generated_at timestamp, snapshot_id string"
)


def batch_observations(gate_rows, now):
    """Published station rows as typed observations with their business clock."""
    event = F.from_json("value", STATION_EVENT)
    rows = gate_rows.where("outcome = 'STATION'").withColumn("event", event)
    typed = rows.select(
        "snapshot_id", "metadata_version", "data_origin", "station_id",
        F.to_timestamp(F.col("event.snapshot_at_utc")).alias("snapshot_at"),
        F.to_timestamp(F.col("event.last_reported_at_utc")).alias("last_reported_at"),
        F.to_timestamp(F.col("event.ingested_at_utc")).alias("ingested_at"),
        F.lit(now).cast("timestamp").alias("received_at"),
        F.col("event.num_bikes_available").alias("bikes"),
        F.col("event.num_docks_available").alias("docks"),
        *[F.col(f"event.{name}").alias(name) for name in risk.FLAGS],
    )
    return risk.batch_clock(typed)


def with_versioned_metadata(observations, metadata):
    """Observations with their station's attributes in their own metadata version; refused if one has none."""
    key = ["metadata_version", "station_id"]
    versioned = metadata.select(*key, "station_name", "capacity", "lat", "lon")
    unknown = observations.join(versioned, key, "left_anti").groupBy("snapshot_id").agg(F.count("*").alias("stations"))
    missing = unknown.orderBy("snapshot_id").first()
    if missing:
        raise ValueError(f"snapshot {missing.snapshot_id} has {missing.stations} stations without metadata of its version")
    return observations.join(versioned, key)


def suggestions(found):
    """The suggestions of every snapshot in `found`."""
    return rebalance.with_suggestion_id(rebalance.rebalance(rebalance.rebalance_ends(found, "snapshot_id"), "snapshot_id"))


def write_snapshots(df, path):
    """One folder per snapshot; writing the same snapshot again replaces it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(path)


def publish(spark, root, gate_rows, metadata, now=None):
    """Publish the batches of one trigger; safe to run again for the same trigger.

    Tables are written first and the pointer moves last, so a reader sees the old
    snapshot or the new one. A snapshot that is not newer than the pointer is
    skipped, which also makes a replay after a restart harmless.
    """
    now = now or datetime.datetime.now(datetime.timezone.utc).isoformat()
    current = pointer(spark, root, POINTER)
    ended = gate_rows.where("outcome = 'PUBLISHED'")
    if current:
        ended = ended.where(F.col("snapshot_at") > current["snapshot_at"])
    newest = ended.orderBy(F.desc("snapshot_at")).limit(1).collect()
    if not newest:
        return None
    fresh = gate_rows.join(ended.select("snapshot_id"), "snapshot_id", "left_semi")
    served = pointer(spark, root, "historical_release")
    baseline = served["dataset_id"] if served else None
    profile = open_release(spark, served["release_root"])["dws_station_hour_profile_v1"] if served else _no_profile(spark)
    risk_path = f"{root}/live/ads_station_current_risk"
    known = with_versioned_metadata(batch_observations(fresh, now), metadata)
    needed = risk.hours_needed(profile, known.select("snapshot_at"))
    write_snapshots(risk.station_risk(known, needed, baseline is not None), risk_path)
    # The solver reads the written rows, so risk is worked out once; the join prunes to the folders of this trigger.
    written = spark.read.schema(RISK_TABLE).parquet(risk_path).join(ended.select("snapshot_id"), "snapshot_id", "left_semi")
    stamped = suggestions(written).withColumn("generated_at", F.lit(now).cast("timestamp"))
    write_snapshots(stamped, f"{root}/live/ads_rebalance_suggestion")
    row = newest[0]
    recorded = row.data_origin != "GBFS_LIVE"
    release = {
        "snapshot_id": row.snapshot_id, "metadata_version": row.metadata_version, "baseline_dataset_id": baseline,
        "snapshot_at": row.snapshot_at, "ingested_at": row.ingested_at, "as_of": row.ingested_at if recorded else now,
        "published_at": now, "data_origin": row.data_origin, "clock_mode": "recorded" if recorded else "wall",
    }
    point_to(spark, root, POINTER, release)
    return release


def _no_profile(spark):
    return spark.createDataFrame(
        [], "station_id string, day_of_week tinyint, hour tinyint, avg_inbound double, avg_outbound double, avg_net_flow double, sample_days bigint"
    )


def live_snapshot(spark, root):
    """The published snapshot: pointer, risk rows and suggestions, or None before the first one."""
    release = pointer(spark, root, POINTER)
    if release is None:
        return None
    picked = F.col("snapshot_id") == release["snapshot_id"]
    found = spark.read.schema(RISK_TABLE).parquet(f"{root}/live/ads_station_current_risk").where(picked)
    moves = spark.read.schema(SUGGESTION_TABLE).parquet(f"{root}/live/ads_rebalance_suggestion").where(picked)
    return release, found, moves


def refresher(metadata):
    """A function that lists the files of a file-based `metadata` frame anew."""
    catalog, view = metadata.sparkSession.catalog, f"live_metadata_{uuid.uuid4().hex}"
    metadata.createOrReplaceTempView(view)
    return lambda: catalog.refreshTable(view)


def publisher(root, metadata):
    """A `foreachBatch` function: verdicts to the log, complete batches to the live tables, with the metadata files of that moment."""
    refresh = refresher(metadata)

    def run(batch, batch_id):
        spark = batch.sparkSession
        refresh()
        rows = batch.persist()
        try:
            log = rows.where("outcome <> 'STATION'").drop("station_id", "value")
            log.write.mode("overwrite").parquet(f"{root}/live/log/trigger={batch_id}")
            publish(spark, root, rows, metadata)
        finally:
            rows.unpersist()

    return run


def send_records(records, write):
    """Station records first; the end markers only after that write has succeeded."""
    write(records.where("headers['record_type'] = 'station'"))
    write(records.where("headers['record_type'] = 'snapshot_end'"))


def to_kafka(servers, topic):
    """A writer for `send_records`; needs the Kafka connector on the classpath."""

    def write(records):
        headers = F.transform(F.map_entries("headers"), lambda e: F.struct(e.key.alias("key"), e.value.cast("binary").alias("value")))
        out = records.select("key", "value", headers.alias("headers")).write.format("kafka")
        out.option("kafka.bootstrap.servers", servers).option("topic", topic).option("includeHeaders", True).save()

    return write


def write_landed(records, path):
    """Records as NDJSON, one folder per snapshot, for replay and audit."""
    out = records.select(F.to_json(F.struct("key", "headers", "value")).alias("line"), F.col("headers")["snapshot_id"].alias("snapshot_id"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").text(path)
