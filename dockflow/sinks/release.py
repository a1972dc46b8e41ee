"""Immutable releases: every attempt writes its own folder, the first to create the descriptor is the release."""

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from dockflow.schemas import CONTRACT_VERSION, SERVING_COLUMNS, SERVING_KEYS
from dockflow.sinks.tsv import null_token, write_tsv

TABLE_PATHS = {
    "dwd_trip_v1": "dwd/dwd_trip_v1",
    "dim_station_v1": "dim/dim_station_v1",
    "dws_station_hourly_flow_v1": "dws/dws_station_hourly_flow_v1",
    "dws_station_hour_profile_v1": "dws/dws_station_hour_profile_v1",
    "dws_station_od_hourly_v1": "dws/dws_station_od_hourly_v1",
}
PARTITIONS = {
    "dwd_trip_v1": ("source_year", "source_month"),
    "dws_station_hourly_flow_v1": ("service_date",),
    "dws_station_od_hourly_v1": ("service_date",),
    "dws_station_hour_profile_v1": ("day_of_week",),
}
# Row order inside a file, so that Parquet min/max ranges skip row groups on replay and history reads.
ROW_ORDER = {
    "dws_station_hourly_flow_v1": ("station_id", "hour"),
    "dws_station_od_hourly_v1": ("hour", "from_station_id", "to_station_id"),
    "dws_station_hour_profile_v1": ("hour", "station_id"),
    "dim_station_v1": ("station_id",),
}


class ReleaseError(ValueError):
    """A release does not match what was asked for."""


def _path(spark, uri):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, uri):
    path, fs = _path(spark, uri)
    return fs.exists(path)


def write_text(spark, uri, text, overwrite=False):
    path, fs = _path(spark, uri)
    stream = fs.create(path, overwrite)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def read_json(spark, uri):
    """A small descriptor document."""
    text = spark.read.text(uri, wholetext=True).first()
    return json.loads(text[0]) if text else None


def write_table(df, name, path):
    """One table of a release; tables by date or weekday get their rows clustered by it first.

    Rebalancing lets AQE size the files and split a date that holds most rows. The
    trip table has one source month per batch, so its tasks write where they are.
    """
    parts = PARTITIONS.get(name, ())
    out = df
    if parts and name in ROW_ORDER:
        out = out.hint("rebalance", *parts)
    if name in ROW_ORDER:
        out = out.sortWithinPartitions(*parts, *ROW_ORDER[name])
    writer = out.write.mode("errorifexists")
    (writer.partitionBy(*parts) if parts else writer).parquet(path)


def new_attempt(root, dataset_id):
    """The folder of one build attempt; attempts never share or move files."""
    return f"{root.rstrip('/')}/attempts/{dataset_id}/{uuid.uuid4().hex}"


def descriptor_of(root, dataset_id):
    return f"{root.rstrip('/')}/releases/{dataset_id}.json"


# What two builds of one dataset must have in common, whoever was first.
_SAME = ("contract_version", "dataset_id", "metadata_version", "source_months", "ingest_batch_ids", "tables", "rows")


def differences(ours, theirs):
    """Names of the properties in which a committed release is not this build."""
    found = [name for name in _SAME if ours[name] != theirs.get(name)]
    if ours.get("null_token") and theirs.get("null_token") and ours["null_token"] != theirs["null_token"]:
        found.append("null_token")
    return found


def commit_release(spark, root, attempt, evidence, export=True):
    """Commit an attempt by creating its dataset's descriptor, which only the first attempt can do.

    Data stay where they were written, so nothing depends on renaming folders. Whoever
    comes second compares its build with the committed one and returns that.
    """
    dataset_id = evidence["dataset_id"]
    uri = descriptor_of(root, dataset_id)
    described = {
        **evidence, "status": "PASS", "contract_version": CONTRACT_VERSION, "release_root": attempt, "tables": sorted(TABLE_PATHS),
        "rows": {k: v for k, v in evidence["counts"].items() if k != "ods"},
        "paths": {n: f"{attempt}/{p}" for n, p in TABLE_PATHS.items()},
    }
    if not exists(spark, uri):
        if export:
            tables = {n: spark.read.parquet(f"{attempt}/{TABLE_PATHS[n]}").select(*c) for n, c in SERVING_COLUMNS.items()}
            described["null_token"] = null_token(tables.values(), dataset_id)
            for name, df in tables.items():
                described["paths"][f"export_{name}"] = f"{attempt}/serving_export/{name}"
                write_tsv(df, described["paths"][f"export_{name}"], described["null_token"], SERVING_KEYS[name])
        try:
            write_text(spark, uri, json.dumps(described, indent=2, sort_keys=True))
        except Py4JJavaError:
            if not exists(spark, uri):
                raise
    committed = read_json(spark, uri)
    unlike = differences(described, committed)
    if unlike:
        raise ReleaseError(f"dataset {dataset_id} is already released from another build; these differ: {', '.join(unlike)}")
    return committed


def open_release(spark, release_root):
    """The tables of a committed release by name; a release never changes, so reads are consistent."""
    return {name: spark.read.parquet(f"{release_root}/{path}") for name, path in TABLE_PATHS.items()}


def point_to(spark, root, name, value):
    """Swap a pointer file: written aside, then renamed over the old one."""
    target, fs = _path(spark, f"{root.rstrip('/')}/{name}.json")
    aside = f"{root.rstrip('/')}/.{name}-{uuid.uuid4().hex}.json"
    write_text(spark, aside, json.dumps(value, sort_keys=True, default=str))
    source, _ = _path(spark, aside)
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(source, target, options)


def pointer(spark, root, name):
    uri = f"{root.rstrip('/')}/{name}.json"
    return read_json(spark, uri) if exists(spark, uri) else None


def publish_release(spark, root, release):
    """Make a committed release the served one: all four tables and their pointer change together."""
    row = {k: release[k] for k in ("dataset_id", "source_months", "min_service_date", "max_service_date", "release_root")}
    point_to(spark, root, "historical_release", row)


def register_warehouse(spark, database, release_root):
    """External Parquet tables over a release; an existing managed or non-Parquet table is refused."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, path in TABLE_PATHS.items():
        table = f"{database}.{name}"
        if spark.catalog.tableExists(table):
            detail = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
            if detail.get("Type") != "EXTERNAL" or detail.get("Provider", "").lower() != "parquet":
                raise ReleaseError(f"{table} is not an external Parquet table")
            spark.sql(f"DROP TABLE {table}")
        spark.catalog.createTable(table, path=f"{release_root}/{path}", source="parquet")
        if name in PARTITIONS:
            spark.sql(f"MSCK REPAIR TABLE {table}")


def write_evidence(spark, path, evidence):
    """Build evidence (PASS or FAIL with its metrics) as one JSON row; evidence is never overwritten."""
    row = spark.createDataFrame([(json.dumps(evidence, sort_keys=True, default=str),)], "value string")
    row.write.mode("errorifexists").text(path)


def quarantine(df, path, reason="reason"):
    """Refused inputs beside their reason, one folder per reason."""
    df.where(F.col(reason).isNotNull()).write.mode("errorifexists").partitionBy(reason).parquet(path)
