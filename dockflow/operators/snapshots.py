"""Collection log: duplicates, conflicts, pending failures and counters."""

from pyspark.sql import functions as F

from dockflow.schemas import MODE_ORIGINS

RESOLVED = ("PUBLISHED", "SKIPPED_DUPLICATE", "REJECTED_CONFLICT")


def snapshot_states(attempts, order="attempt", sent="sent"):
    """The first content of a provider time that is sent is published; later equal content is a duplicate, other content a conflict.

    An attempt that could not be sent and has nothing published before it blocks
    nothing. The first sent attempt per provider time is a partial aggregate; comparing
    against it is a join with one row per time, which AQE splits when a time dominates.
    """
    first = attempts.groupBy("provider_time").agg(
        F.min(F.when(F.col(sent), F.struct(F.col(order), F.col("status_raw_sha256")))).alias("first")
    )
    joined = attempts.join(first, "provider_time")
    state = (
        F.when(F.col(order) == F.col(f"first.{order}"), "PUBLISHED")
        .when(F.col("first").isNull() | (F.col(order) < F.col(f"first.{order}")), "FAILED_SEND")
        .when(F.col("status_raw_sha256") == F.col("first.status_raw_sha256"), "SKIPPED_DUPLICATE")
        .otherwise("REJECTED_CONFLICT")
    )
    return joined.withColumn("state", state).drop("first")


def pending_sends(log, order="attempt"):
    """Snapshots whose last failed send has no later resolution."""
    failed = F.max(F.when(F.col("status") == "FAILED_SEND", F.col(order)))
    done = F.max(F.when(F.col("status").isin(*RESOLVED), F.col(order)))
    ends = log.groupBy("snapshot_id").agg(failed.alias("failed_at"), done.alias("resolved_at"))
    return ends.where(F.col("failed_at") > F.coalesce("resolved_at", F.lit(-1)))



def latest_live_metadata(log, order="attempt"):
    """Metadata version of the newest published live batch."""
    live = log.where((F.col("status") == "PUBLISHED") & F.col("data_origin").isin(*MODE_ORIGINS["live"]))
    return live.agg(
        F.max_by("metadata_version", order).alias("metadata_version"), F.max(order).alias("attempt")
    )


def log_counters(log, *by):
    """Collection metrics, optionally per group."""
    status = F.col("status")
    failed = status.startswith("FAILED") | (status == "REJECTED_CONFLICT")
    return log.groupBy(*by).agg(
        F.count("*").alias("attempts"),
        F.count_if(failed).alias("failed_batches"),
        F.count_if(status == "SKIPPED_DUPLICATE").alias("duplicates"),
        F.count_if(status == "REJECTED_CONFLICT").alias("conflicts"),
        F.count_if(status.isin("PUBLISHED", "SKIPPED_DUPLICATE")).alias("complete_batches"),
        F.sum("mapped_count").alias("mapping_success"),
        F.sum("isolated_count").alias("mapping_isolated"),
    )


def origin_gate(records, mode):
    """Reason a record may not enter a consumer of this mode, NULL when it may."""
    allowed = F.col("data_origin").isin(*MODE_ORIGINS[mode])
    reason = F.when(~F.coalesce(allowed, F.lit(False)), "INVALID_ORIGIN_FOR_MODE")
    return records.withColumn("gate_reason", reason)
