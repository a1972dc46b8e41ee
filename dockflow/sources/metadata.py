"""Canonical station metadata: a JSON array of stations."""

from pyspark.sql import functions as F

from dockflow.operators.quality import rule_violations
from dockflow.operators.stations import metadata_rules
from dockflow.operators.trips import GateError
from dockflow.schemas import METADATA


def read_metadata(spark, path):
    return spark.read.schema(METADATA).option("multiLine", True).json(path)


def load_metadata(spark, path):
    """The metadata, refused as a whole when a row or the uniqueness of an id is broken."""
    rows = read_metadata(spark, path)
    broken = rule_violations(rows, metadata_rules(), "station_id").take(1)
    if broken:
        raise GateError(f"metadata station {broken[0].station_id}: {broken[0].rule}")
    for key in ("station_id", "provider_station_id"):
        twice = rows.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").take(1)
        if twice:
            raise GateError(f"duplicate metadata {key}: {twice[0][0]}")
    return rows


def content_version(spark, path):
    """Version of a metadata file: the digest of its bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
