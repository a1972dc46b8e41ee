"""Trip cleaning: gates, typed rows, duplicate flags and the validity predicate."""

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from dockflow.functions.hashing import row_signature
from dockflow.functions.text import blank_to_null, is_blank, safe_coordinate
from dockflow.functions.times import elapsed_seconds, parse_wall_clock, with_calendar
from dockflow.schemas import (
    DWD_COLUMNS,
    REQUIRED_TRIP_FIELDS,
    TRIP_COORDINATES,
    TRIP_ENUMS,
    TRIP_FIELDS,
    TRIP_TIME_FIELDS,
)


class GateError(ValueError):
    """A whole batch was refused."""


def gate_reason():
    """Why a row breaks the batch: blank required text, or a critical time that parses to nothing."""
    blank = reduce(or_, [is_blank(F.col(name)) for name in REQUIRED_TRIP_FIELDS])
    unparsed = reduce(or_, [F.col(f"{name}_local").isNull() for name in TRIP_TIME_FIELDS])
    return F.when(blank, "BLANK_REQUIRED_FIELD").when(unparsed, "UNPARSED_TIME")


def rejected_rows(typed):
    return typed.withColumn("gate_reason", gate_reason()).where("gate_reason IS NOT NULL")



def source_gate(typed):
    """Refuse the batch when any row fails; one scan that stops at the first failure."""
    failed = rejected_rows(typed).select("gate_reason").take(1)
    if failed:
        raise GateError(f"unusable trip records: {failed[0].gate_reason}")
    return typed


def without_header_rows(df, fields=TRIP_FIELDS):
    """Drop records that repeat the header, as a text table returns them."""
    is_header = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.lit(name)) for name in fields])
    return df.where(~is_header)


def contract_types(df):
    """Contract types with the raw coordinate text kept beside the numbers."""
    raw = {f"raw_{name}": F.col(name).cast("string") for name in TRIP_COORDINATES}
    typed = {name: F.col(name).try_cast("double") for name in TRIP_COORDINATES}
    return df.withColumns(raw).withColumns(typed)


def unknown_enum_counts(df, enums=TRIP_ENUMS):
    """Present values outside each enumeration, one row per field and value."""
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.trim(name).alias("value")) for name in enums])
    known = reduce(or_, [(F.col("field") == n) & F.col("value").isin(*v) for n, v in enums.items()])
    exploded = df.select(F.inline(pairs)).where(F.col("value") != "").where(~known)
    return exploded.groupBy("field", "value").agg(F.count("*").alias("row_count"))


def with_local_times(raw, wall_clock="ltz"):
    return raw.withColumns(
        {f"{name}_local": parse_wall_clock(F.col(name), wall_clock) for name in TRIP_TIME_FIELDS}
    )


def clean_fields(df):
    """Blank names and identifiers to NULL, coordinates to safe numbers."""
    texts = ("start_station_id", "end_station_id", "start_station_name", "end_station_name")
    cleaned = {name: blank_to_null(F.col(name)) for name in texts}
    cleaned.update({name: safe_coordinate(F.col(name), limit) for name, limit in TRIP_COORDINATES.items()})
    return df.withColumns(cleaned)


def with_trip_calendar(df):
    df = df.withColumn("duration_seconds", elapsed_seconds(df, "started_at_local", "ended_at_local"))
    return with_calendar(df, "started_at_local")


def repeated_keys(df, key):
    """Keys that occur more than once.

    A counting hash aggregate over the key column alone: a key that owns most of
    the rows is one row per task before anything is shuffled.
    """
    return df.groupBy(key).agg(F.count("*").alias("key_rows")).where("key_rows > 1").select(key)


def first_rows(df, key, order, *extra, repeated=None):
    """First row of every repeated key: its order values and the named extra columns.

    Only rows of repeated keys are ordered, and they too are reduced in each task
    before the shuffle.
    """
    keys = repeated_keys(df, key) if repeated is None else repeated
    rows = df.select(key, *order, *extra).join(keys, key, "left_semi")
    return rows.groupBy(key).agg(F.min(F.struct(*order, *extra)).alias("first_row"))


def flag_first_seen(df, key, order, signature=None, flag="is_duplicate_ride", firsts=None):
    """Mark every row but the first of its key; optionally mark content conflicts too.

    Only the repeated keys are joined back, and they are few in sound data. A job
    that wrote `first_rows` to a table passes it as `firsts`: its file size then
    decides between a broadcast, which leaves the wide rows where they are, and a
    sort-merge join whose hot partitions AQE splits.
    """
    if firsts is None:
        firsts = first_rows(df, key, order, *([signature] if signature else []))
    firsts = firsts.select(F.col(key).alias("dup_key"), "first_row")
    joined = df.join(firsts, df[key] == F.col("dup_key"), "left")
    is_first = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"first_row.{name}")) for name in order])
    added = {flag: F.col("dup_key").isNotNull() & ~is_first}
    if signature:
        same = F.col(signature).eqNullSafe(F.col(f"first_row.{signature}"))
        added["is_conflict"] = F.col("dup_key").isNotNull() & ~is_first & ~same
    return joined.withColumns(added).drop("dup_key", "first_row")


def valid_trip(duplicate="is_duplicate_ride"):
    """Counted trips: first of their ride id, both stations known, positive duration."""
    return (
        ~F.col(duplicate)
        & F.col("start_station_id").isNotNull()
        & F.col("end_station_id").isNotNull()
        & F.coalesce(F.col("ended_at_local") > F.col("started_at_local"), F.lit(False))
    )


def business_signature():
    return row_signature(*[name for name in TRIP_FIELDS if name != "ride_id"])


def typed_trips(raw, wall_clock="ltz"):
    """Row-local part of the trip table: parse, clean and derive, no shuffle."""
    return with_trip_calendar(clean_fields(with_local_times(raw, wall_clock)))


def build_dwd(typed, order=("source_year", "source_month", "source_file", "source_row_number"), firsts=None):
    """All physical rows with duplicate and validity flags."""
    flagged = flag_first_seen(typed, "ride_id", order, firsts=firsts)
    return flagged.withColumn("is_valid_station_trip", valid_trip()).select(*DWD_COLUMNS)


def conflict_count(typed, order, repeated=None):
    """Duplicates whose content differs from the first row of their ride id; only repeated ids are hashed."""
    keys = repeated_keys(typed, "ride_id") if repeated is None else repeated
    rows = typed.join(keys, "ride_id", "left_semi")
    signed = rows.select("ride_id", *order, business_signature().alias("signature"))
    flagged = flag_first_seen(signed, "ride_id", order, "signature")
    return flagged.agg(F.count_if("is_conflict").alias("duplicate_conflict"))


QUALITY_COUNTERS = {
    "dwd": "true",
    "valid": "is_valid_station_trip",
    "invalid": "NOT is_valid_station_trip",
    "duplicate": "is_duplicate_ride",
    "missing_start_station": "start_station_id IS NULL",
    "missing_end_station": "end_station_id IS NULL",
    "missing_or_invalid_start_coordinate": "start_lat IS NULL OR start_lng IS NULL",
    "missing_or_invalid_end_coordinate": "end_lat IS NULL OR end_lng IS NULL",
    "non_positive_duration": "duration_seconds <= 0",
}


def quality_columns():
    """The batch counters, usable in `agg` or in `observe` on a frame that is written anyway."""
    return [F.count_if(F.expr(rule)).alias(name) for name, rule in QUALITY_COUNTERS.items()]


def quality_summary(dwd):
    return dwd.agg(*quality_columns())
