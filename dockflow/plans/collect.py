"""Landed feeds to stream records: canonical metadata, versions, station events and end markers.

Many snapshots are processed at once; `feed` names one collection attempt. Arrays
per attempt hold at most the contract's 5,000 stations.
"""

from pyspark.sql import functions as F

from dockflow.functions.hashing import metadata_version, snapshot_id
from dockflow.functions.times import city_text, utc_text
from dockflow.operators import stations
from dockflow.schemas import CONTRACT_VERSION, END_KEY, METADATA, STATION_EVENT
from dockflow.sources import gbfs

_KEPT_NULLS = {"ignoreNullFields": "false"}


def canonical_metadata(information, status):
    """Canonical metadata rows of every attempt, placeholders for unlisted stations included."""
    rows = gbfs.information_table(gbfs.feed_rows(information, "stations", "feed"))
    mapped = stations.canonical_mapping(stations.safe_station_fields(rows), scope=("feed",))
    listed = mapped.withColumns(
        {
            "is_current": F.lit(True),
            "metadata_source": F.lit("GBFS"),
            "metadata_updated_at": F.timestamp_seconds("last_updated"),
        }
    ).select("feed", *METADATA.fieldNames())
    seen = gbfs.feed_rows(status, "stations", "feed").select(
        "feed", gbfs.string(F.col("item"), "$.station_id").alias("provider_station_id"), F.timestamp_seconds("last_updated").alias("seen_at")
    )
    strangers = seen.join(listed, ["feed", "provider_station_id"], "left_anti")
    nothing = {name: F.lit(None).cast(METADATA[name].dataType).alias(name) for name in ("station_name", "lat", "lon", "capacity", "region_id")}
    placeholders = strangers.select(
        "feed",
        "provider_station_id",
        F.concat(F.lit("gbfs:"), F.col("provider_station_id")).alias("station_id"),
        F.lit("ISOLATED").alias("mapping_status"),
        F.lit("MISSING_METADATA").alias("mapping_reason"),
        *nothing.values(),
        F.lit(True).alias("is_current"),
        F.lit("GBFS").alias("metadata_source"),
        F.col("seen_at").alias("metadata_updated_at"),
    )
    return _without_collisions(listed.unionByName(placeholders))


def _without_collisions(metadata):
    """The same rows; the plan fails where two stations of an attempt claim one canonical id."""
    claimed = stations.canonical_collisions(metadata, scope=("feed",)).withColumn("claimed", F.lit(True)).drop("claims")
    said = F.concat(F.lit("canonical station id claimed twice: "), "station_id", F.lit(" in "), F.col("feed").cast("string"))
    own = F.when(F.col("claimed"), F.raise_error(said).cast("string")).otherwise(F.col("station_id"))
    return metadata.join(claimed, ["feed", "station_id"], "left").withColumn("station_id", own).select(metadata.columns)


def metadata_documents(metadata):
    """The metadata of each attempt as one JSON array in station order, with its version."""
    texts = metadata.withColumn("updated", utc_text(metadata, "metadata_updated_at"))
    fields = [F.col("updated").alias(n) if n == "metadata_updated_at" else F.col(n) for n in METADATA.fieldNames()]
    # The id leads the struct, so sorting the array sorts by station.
    entry = F.struct(F.col("station_id").alias("_order"), F.struct(*fields).alias("row"))
    grouped = texts.groupBy("feed").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    content = F.to_json(F.col("rows.row"), _KEPT_NULLS)
    return grouped.select("feed", content.alias("raw")).withColumn("metadata_version", metadata_version(F.col("raw")))


def snapshot_records(information, status, origin="GBFS_LIVE"):
    """Stream records of every attempt: its stations and, after them, its end marker.

    Inputs are feed documents with `feed`, `raw` and (status) `ingested_at`. Rows
    carry `position`: 0 for stations, 1 for the end marker, so a writer can send
    the marker last.
    """
    information, status = gbfs.documents(information), gbfs.documents(status)
    metadata = canonical_metadata(information, status)
    versions = metadata_documents(metadata).select("feed", "metadata_version")
    known = status.join(versions, "feed").withColumn("snapshot_id", snapshot_id(F.col("raw"), F.col("metadata_version")))
    batch = ("feed", "snapshot_id", "metadata_version", "ingested_at")
    events = gbfs.status_events(gbfs.feed_rows(known, "stations", *batch), F.col("ingested_at"))
    mapping = metadata.select("feed", "provider_station_id", "station_id")
    # An event must have an identity: one that the mapping lacks fails the plan instead of leaving the batch short.
    said = F.concat(F.lit("no canonical id for provider station "), F.coalesce("provider_station_id", F.lit("(null)")))
    placed = events.join(mapping, ["feed", "provider_station_id"], "left")
    placed = placed.withColumn("station_id", F.coalesce("station_id", F.raise_error(said).cast("string")))
    placed = placed.withColumns(
        {
            "snapshot_at_utc": utc_text(placed, "snapshot_at"),
            "snapshot_at_local": city_text(placed, "snapshot_at"),
            "last_reported_at_utc": utc_text(placed, "last_reported_at"),
            "ingested_at_utc": utc_text(placed, "ingested_at"),
        }
    )
    value = F.to_json(F.struct(*STATION_EVENT.fieldNames()), _KEPT_NULLS)
    rows = placed.select(
        F.col("station_id").alias("key"), _headers("station", origin), value.alias("value"), "snapshot_id", F.lit(0).alias("position")
    )
    # A snapshot without stations still ends, so its marker comes from the document.
    ends = known.withColumns(
        {
            "station_count": F.coalesce(F.size(F.try_variant_get("doc", "$.data.stations", "array<variant>")), F.lit(0)),
            "snapshot_at": F.timestamp_seconds(gbfs.integer(F.col("doc"), "$.last_updated")),
        }
    )
    marker = F.struct(
        "station_count", utc_text(ends, "snapshot_at").alias("snapshot_at_utc"), utc_text(ends, "ingested_at").alias("ingested_at_utc")
    )
    last = ends.select(
        F.lit(END_KEY).alias("key"), _headers("snapshot_end", origin), F.to_json(marker, _KEPT_NULLS).alias("value"), "snapshot_id", F.lit(1).alias("position")
    )
    return rows.unionByName(last)


def _headers(kind, origin):
    names = {"contract_version": F.lit(CONTRACT_VERSION), "record_type": F.lit(kind), "snapshot_id": F.col("snapshot_id"),
             "metadata_version": F.col("metadata_version"), "data_origin": F.lit(origin)}
    return F.create_map(*[part for name, value in names.items() for part in (F.lit(name), value)]).alias("headers")
