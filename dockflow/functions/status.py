"""Inventory status rules as column expressions.

Every ladder is one `when` chain over ordinary columns, so it runs inside
whole-stage code generation and never touches Python.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from dockflow.schemas import FAILED_STATUSES, FRESH_SECONDS, INVENTORY_STATUSES, SKEW_SECONDS, STATUSES
from dockflow.functions.times import plus_seconds

# Upper bounds of the fill ratio classes (two inclusive, two exclusive).
SHORTAGE_MAX, LOW_MAX, HEALTHY_BELOW, HIGH_BELOW = 0.15, 0.30, 0.70, 0.85


def fill_class(ratio: Column) -> Column:
    return (
        F.when(ratio.isNull(), F.lit(None).cast("string"))
        .when(ratio <= SHORTAGE_MAX, "SHORTAGE_RISK")
        .when(ratio <= LOW_MAX, "LOW_INVENTORY")
        .when(ratio < HEALTHY_BELOW, "HEALTHY")
        .when(ratio < HIGH_BELOW, "HIGH_INVENTORY")
        .otherwise("OVERFLOW_RISK")
    )


def observed_at(snapshot: Column, reported: Column) -> Column:
    """The older of snapshot and report time; a missing report falls back to the snapshot."""
    return F.least(snapshot, F.coalesce(reported, snapshot))


def expires_at(snapshot: Column, reported: Column, as_of: Column) -> Column:
    """Freshness limit; without a snapshot time the row is already expired."""
    return F.when(snapshot.isNull(), as_of).otherwise(
        plus_seconds(observed_at(snapshot, reported), FRESH_SECONDS)
    )


def failure_reason(snapshot, reported, as_of, bikes, docks, flags) -> Column:
    """Why an observation cannot be classified, NULL when it can. The order is the contract's."""
    latest_allowed = plus_seconds(as_of, SKEW_SECONDS)
    any_false = F.lit(False)
    any_missing = bikes.isNull() | docks.isNull()
    for flag in flags:
        any_false = any_false | F.coalesce(~flag, F.lit(False))
        any_missing = any_missing | flag.isNull()
    return (
        F.when(snapshot.isNull() | (snapshot > latest_allowed) | (reported > latest_allowed), "INVALID_TIME")
        .when(as_of >= expires_at(snapshot, reported, as_of), "STALE_OBSERVATION")
        .when(any_false, "SERVICE_FLAGS")
        .when((bikes < 0) | (docks < 0), "NEGATIVE_INVENTORY")
        .when(any_missing, "MISSING_INVENTORY")
        .when(bikes.cast("long") + docks == 0, "ZERO_SERVICEABLE_CAPACITY")
    )


def failure_status(reason: Column) -> Column:
    return (
        F.when(reason.isin("INVALID_TIME", "NEGATIVE_INVENTORY"), "INVALID_DATA")
        .when(reason == "STALE_OBSERVATION", "STALE_DATA")
        .when(reason == "SERVICE_FLAGS", "SERVICE_UNAVAILABLE")
        .when(reason.isin("MISSING_INVENTORY", "ZERO_SERVICEABLE_CAPACITY"), "INSUFFICIENT_DATA")
    )


def severity_rank(status: Column) -> Column:
    """Display order, most urgent first; unknown statuses come last."""
    chain = F.when(F.lit(False), 0)
    for rank, name in enumerate(STATUSES):
        chain = chain.when(status == name, rank)
    return chain.otherwise(99).cast("int")


def in_bucket(status: Column, bucket: str) -> Column:
    """Map filter: all, shortage, full or issue."""
    if bucket == "all":
        return F.lit(True)
    if bucket == "shortage":
        return status.isin("SHORTAGE_RISK", "LOW_INVENTORY")
    if bucket == "full":
        return status.isin("OVERFLOW_RISK", "HIGH_INVENTORY")
    if bucket == "issue":
        return ~status.isin(*INVENTORY_STATUSES, "NOT_APPLICABLE")
    raise ValueError(f"unknown bucket: {bucket}")


def usable(status: Column) -> Column:
    """The station can still take part in a suggestion."""
    return ~status.isin(*FAILED_STATUSES)
