"""Station identity: canonical mapping, attributes, dimension and lookups."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from dockflow.functions.text import clean_identifier
from dockflow.functions.times import sortable
from dockflow.operators.quality import Rule
from dockflow.schemas import MAPPING_REASONS, MAX_ID_LENGTH

ATTRIBUTES = ("station_name", "lat", "lon")


def endpoint_candidates(dwd):
    """Every known trip endpoint as a station sighting; one scan for both sides."""

    def side(rank, **columns):
        named = [F.col(source).alias(name) for name, source in columns.items()]
        return F.struct(*named, F.lit(rank).alias("side"))

    sides = F.array(
        side(0, station_id="start_station_id", station_name="start_station_name", lat="start_lat",
             lon="start_lng", event_time="started_at_local"),
        side(1, station_id="end_station_id", station_name="end_station_name", lat="end_lat",
             lon="end_lng", event_time="ended_at_local"),
    )
    return dwd.select(F.inline(sides), "source_file", "source_row_number").where("station_id IS NOT NULL")


def _timed(candidates):
    """Sightings without a time lose to every timed one."""
    return candidates.withColumn("at", F.coalesce(sortable(candidates, "event_time"), F.lit(-(2**63))))


def newest_times(candidates):
    """Newest time per station at which each attribute is known: a hash aggregate of three numbers."""
    return _timed(candidates).groupBy("station_id").agg(
        *[F.max(F.when(F.col(name).isNotNull(), F.col("at"))).alias(f"{name}_at") for name in ATTRIBUTES]
    )


def latest_attributes(candidates, newest=None):
    """Newest non-null value of each attribute per station, each taken on its own.

    Only the sightings at the newest times are ordered by file, row and side. A
    station with most of the trips is reduced in every task before both shuffles.
    A job that wrote `newest_times` to a table passes it as `newest`, so that the
    join is planned by its real size.
    """
    if newest is None:
        newest = newest_times(candidates)
    is_newest = {name: F.col(name).isNotNull() & (F.col("at") == F.col(f"{name}_at")) for name in ATTRIBUTES}
    near = _timed(candidates).join(newest, "station_id").where(reduce(or_, is_newest.values()))
    order = F.struct("source_file", "source_row_number", "side")
    picked = near.groupBy("station_id").agg(
        *[F.min_by(F.col(name), F.when(is_newest[name], order)).alias(name) for name in ATTRIBUTES]
    )
    return newest.select("station_id").join(picked, "station_id", "left")


def station_dim(metadata, historical, built_at):
    """Current metadata and historical stations together; metadata wins field by field."""
    known = metadata.select(
        "station_id",
        *[F.col(name).alias(f"meta_{name}") for name in ATTRIBUTES],
        "capacity",
        "region_id",
        "is_current",
        "metadata_updated_at",
    )
    joined = known.join(historical, "station_id", "full")
    return joined.select(
        "station_id",
        *[F.coalesce(f"meta_{name}", name).alias(name) for name in ATTRIBUTES],
        "capacity",
        "region_id",
        F.coalesce("is_current", F.lit(False)).alias("is_current"),
        F.when(F.col("is_current").isNotNull(), "GBFS").otherwise("HISTORICAL").alias("metadata_source"),
        F.coalesce("metadata_updated_at", built_at).alias("metadata_updated_at"),
    )


def metadata_hits(candidates, metadata):
    """How many distinct endpoints the metadata knows."""
    known = metadata.select("station_id", F.lit(1).alias("known"))
    ends = candidates.select("station_id").distinct().join(known, "station_id", "left")
    return ends.agg(
        F.count("*").alias("historical_ids"), F.count("known").alias("matched_ids")
    )


def canonical_mapping(information, provider="provider_station_id", scope=()):
    """Canonical id per provider station: its short name when nobody else uses it.

    `scope` names further grouping columns (a snapshot id) when many feeds are
    mapped at once. Shared short names are found by a partial aggregate and are
    few; blank ones never enter the join.
    """
    named = information.withColumn("short", F.nullif(F.trim("short_name"), F.lit("")))
    # Nameless stations get a join key of their own, so they spread over all tasks.
    named = named.withColumn("short_key", F.coalesce("short", F.concat(F.lit("\n"), F.col(provider))))
    shared = (
        named.where("short IS NOT NULL")
        .groupBy(*scope, F.col("short").alias("short_key"))
        .agg(F.count("*").alias("owners"))
        .where("owners > 1")
        .drop("owners")
        .withColumn("is_shared", F.lit(True))
    )
    joined = named.join(shared, [*scope, "short_key"], "left")
    reason = F.when(F.col("short").isNull(), "MISSING_SHORT_NAME").when(F.col("is_shared"), "DUPLICATE_SHORT_NAME")
    isolated = F.concat(F.lit("gbfs:"), F.col(provider))
    return (
        joined.withColumn("mapping_reason", reason)
        .withColumns(
            {
                "station_id": F.when(F.col("mapping_reason").isNull(), F.col("short")).otherwise(isolated),
                "mapping_status": F.when(F.col("mapping_reason").isNull(), "SHORT_NAME").otherwise("ISOLATED"),
            }
        )
        .drop("short", "short_key", "is_shared")
    )


def canonical_collisions(mapped, scope=()):
    """Canonical ids claimed more than once; any row here refuses the metadata."""
    return mapped.groupBy(*scope, "station_id").agg(F.count("*").alias("claims")).where("claims > 1")


def to_canonical(events, mapping, provider="provider_station_id"):
    """Attach canonical ids; `mapped` is false where the mapping has no such provider id."""
    pairs = mapping.select(provider, "station_id")
    return events.join(pairs, provider, "left").withColumn("mapped", F.col("station_id").isNotNull())



def missing_metadata_rows(status, metadata, updated_at, provider="provider_station_id"):
    """Isolated placeholder rows for status stations that the metadata lacks."""
    strangers = status.select(provider).distinct().join(metadata, provider, "left_anti")
    nothing = F.lit(None)
    return strangers.select(
        provider,
        F.concat(F.lit("gbfs:"), F.col(provider)).alias("station_id"),
        F.lit("ISOLATED").alias("mapping_status"),
        F.lit("MISSING_METADATA").alias("mapping_reason"),
        nothing.cast("string").alias("station_name"),
        nothing.cast("double").alias("lat"),
        nothing.cast("double").alias("lon"),
        nothing.cast("int").alias("capacity"),
        nothing.cast("string").alias("region_id"),
        F.lit(True).alias("is_current"),
        F.lit("GBFS").alias("metadata_source"),
        updated_at.alias("metadata_updated_at"),
    )


def safe_station_fields(information):
    """Trimmed names, ranged coordinates and positive capacity, plus the list of warnings."""

    def ranged(name, limit):
        return F.when(~F.isnan(name) & (F.abs(name) <= limit), F.col(name))

    bad = {
        "invalid_coordinate:lat": F.col("lat").isNotNull() & ranged("lat", 90).isNull(),
        "invalid_coordinate:lon": F.col("lon").isNotNull() & ranged("lon", 180).isNull(),
        "invalid_capacity": F.coalesce(F.col("capacity") <= 0, F.lit(False)),
    }
    warnings = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in bad.items()]))
    return information.withColumn("warnings", warnings).withColumns(
        {
            "station_name": F.nullif(F.trim("name"), F.lit("")),
            "lat": ranged("lat", 90),
            "lon": ranged("lon", 180),
            "capacity": F.when(F.col("capacity") > 0, F.col("capacity")),
            "region_id": F.nullif(F.trim("region_id"), F.lit("")),
        }
    )


def _short_text(name, limit):
    value = F.col(name)
    return value.isNull() | ((F.trim(value) == value) & F.length(value).between(1, limit))


def metadata_rules():
    """Row rules of a canonical metadata table; each predicate is true for a bad row."""
    isolated = F.concat(F.lit("gbfs:"), F.col("provider_station_id"))
    status, reason = F.col("mapping_status"), F.col("mapping_reason")
    good_mapping = ((status == "SHORT_NAME") & reason.isNull()) | (
        (status == "ISOLATED") & reason.isin(*MAPPING_REASONS) & (F.col("station_id") == isolated)
    )
    return [
        Rule("provider_station_id", ~clean_identifier(F.col("provider_station_id"), MAX_ID_LENGTH)),
        Rule("station_id", ~clean_identifier(F.col("station_id"), MAX_ID_LENGTH)),
        Rule("not_current", ~F.coalesce(F.col("is_current"), F.lit(False)) | ~F.col("metadata_source").eqNullSafe("GBFS")),
        Rule("mapping", ~F.coalesce(good_mapping, F.lit(False))),
        Rule("station_name", ~_short_text("station_name", 512)),
        Rule("region_id", ~_short_text("region_id", 128)),
        Rule("lat", F.isnan("lat") | (F.abs("lat") > 90)),
        Rule("lon", F.isnan("lon") | (F.abs("lon") > 180)),
        Rule("capacity", F.col("capacity") <= 0),
        Rule("metadata_updated_at", F.col("metadata_updated_at").isNull()),
    ]


def with_dim(df, dim, key="station_id"):
    """Rows with their dimension attributes where known."""
    info = dim.select(F.col("station_id").alias(key), "station_name", "lat", "lon", "capacity")
    return df.join(info, key, "left")


def station_lookup(dim, current):
    """One row per station: the historical dimension first, else the current snapshot."""
    columns = ("station_id", "station_name", "lat", "lon", "capacity")
    ranked = dim.select(*columns, F.lit(0).alias("priority")).unionByName(
        current.select(*columns, F.lit(1).alias("priority"))
    )
    picked = ranked.groupBy("station_id").agg(
        F.min(F.struct("priority", *columns[1:])).alias("pick")
    )
    return picked.select(
        "station_id",
        *[f"pick.{name}" for name in columns[1:]],
        F.when(F.col("pick.priority") == 0, "HISTORICAL").otherwise("CURRENT").alias("found_in"),
    )


def without_coordinates(od, dim):
    """Origin–destination rows that a map cannot draw because an end has no position."""
    placed = dim.where("lat IS NOT NULL AND lon IS NOT NULL").select("station_id")
    starts = placed.select(F.col("station_id").alias("from_station_id"), F.lit(True).alias("from_placed"))
    ends = placed.select(F.col("station_id").alias("to_station_id"), F.lit(True).alias("to_placed"))
    joined = od.join(starts, "from_station_id", "left").join(ends, "to_station_id", "left")
    hidden = F.col("from_placed").isNull() | F.col("to_placed").isNull()
    return joined.where(hidden).select(*od.columns)
