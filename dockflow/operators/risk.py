"""Current and one-hour-ahead inventory risk, and the masks applied when it is read."""

from pyspark.sql import functions as F

from dockflow.functions.status import expires_at, failure_reason, failure_status, fill_class, in_bucket, severity_rank
from dockflow.functions.times import city_clock, iso_day, hour_of, plus_seconds
from dockflow.schemas import FORECAST_SECONDS, FRESH_SECONDS, INVENTORY_STATUSES, MODE_ORIGINS

FLAGS = ("is_installed", "is_renting", "is_returning")
BASELINE = ("avg_inbound", "avg_outbound", "avg_net_flow", "sample_days")
FORECAST_COLUMNS = (
    "expected_inbound_1h", "expected_outbound_1h", "expected_net_flow_1h",
    "projected_bikes_1h", "sample_days", "forecast_for",
)


def latest_per_station(observations, order="event_id"):
    """One observation per snapshot and station: the one with the highest order value."""
    others = [name for name in observations.columns if name not in ("snapshot_at", "station_id")]
    picked = observations.groupBy("snapshot_at", "station_id").agg(
        F.max_by(F.struct(*others), F.col(order)).alias("row")
    )
    return picked.select("snapshot_at", "station_id", *[f"row.{name}" for name in others])


def current_status(observations):
    """Status, reason, fill ratio and freshness limit of every observation."""
    reason = failure_reason(
        F.col("snapshot_at"), F.col("last_reported_at"), F.col("as_of"),
        F.col("bikes"), F.col("docks"), [F.col(name) for name in FLAGS],
    )
    serviceable = F.col("bikes").cast("long") + F.col("docks")
    return (
        observations.withColumns(
            {
                "current_reason": reason,
                "expires_at": expires_at(F.col("snapshot_at"), F.col("last_reported_at"), F.col("as_of")),
                "serviceable": serviceable,
            }
        )
        .withColumn("fill_ratio", F.when(F.col("current_reason").isNull(), F.col("bikes") / F.col("serviceable")))
        .withColumn("current_status", F.coalesce(failure_status(F.col("current_reason")), fill_class(F.col("fill_ratio"))))
    )


def with_city_hour(df):
    """Weekday and hour of the snapshot on the city's clock."""
    clock = city_clock(df, "snapshot_at")
    return df.withColumns({"day_of_week": iso_day(clock), "hour": hour_of(clock)})


def hours_needed(profile, observations):
    """The part of the profile that the observations' weekday-hours can meet, at most 168, as a filter that prunes the scan."""
    hours = with_city_hour(observations).select("day_of_week", "hour").distinct().collect()
    wanted = F.lit(False)
    for day, hour in sorted((r.day_of_week, r.hour) for r in hours):
        wanted = wanted | ((F.col("day_of_week") == day) & (F.col("hour") == hour))
    return profile.where(wanted)


def with_baseline(df, profile):
    """Attach the weekday-hour baseline of the snapshot's city hour."""
    keyed = with_city_hour(df)
    keys = ["station_id", "day_of_week", "hour"]
    return keyed.join(profile.select(*keys, *BASELINE), keys, "left").drop("day_of_week", "hour")


def forecast(df, has_baseline=True):
    """One-hour projection; a failed observation keeps its failure, a missing baseline only hides the forecast."""
    has_id = F.lit(has_baseline)
    usable = F.coalesce(F.col("current_reason").isNull() & (F.col("sample_days") >= 1) & has_id, F.lit(False))
    projected = F.col("bikes") + F.col("avg_net_flow")
    return df.withColumns(
        {
            "forecast_reason": F.when(~usable, F.coalesce("current_reason", F.lit("NO_BASELINE"))),
            "forecast_status": F.when(usable, fill_class(projected / F.col("serviceable")))
            .when(F.col("current_reason").isNotNull(), F.col("current_status"))
            .otherwise("INSUFFICIENT_DATA"),
            "expected_inbound_1h": F.when(usable, F.col("avg_inbound")),
            "expected_outbound_1h": F.when(usable, F.col("avg_outbound")),
            "expected_net_flow_1h": F.when(usable, F.col("avg_net_flow")),
            "projected_bikes_1h": F.when(usable, projected),
            "sample_days": F.when(usable, F.col("sample_days")),
            "forecast_for": F.when(usable, plus_seconds(F.col("snapshot_at"), FORECAST_SECONDS)),
        }
    ).drop("avg_inbound", "avg_outbound", "avg_net_flow")


def station_risk(observations, profile, has_baseline=True):
    """The whole rule: status, baseline join and forecast."""
    return forecast(with_baseline(current_status(observations), profile), has_baseline)


def _cleared(when, names, df):
    return {name: F.when(~when, F.col(name)) for name in names if name in df.columns}


def mask_expired(risk, as_of, snapshot_expired=None):
    """What a reader sees at `as_of`: expired rows turn stale and lose ratio and forecast."""
    expired = F.coalesce(F.col("expires_at") <= as_of, F.lit(False))
    if snapshot_expired is not None:
        expired = expired | snapshot_expired
    changed = {f"{side}_status": F.when(expired, "STALE_DATA").otherwise(F.col(f"{side}_status")) for side in ("current", "forecast")}
    changed.update(
        {f"{side}_reason": F.when(expired, "STALE_OBSERVATION").otherwise(F.col(f"{side}_reason")) for side in ("current", "forecast")}
    )
    changed.update(_cleared(expired, ("fill_ratio", *FORECAST_COLUMNS), risk))
    return risk.withColumns(changed)


def mask_without_baseline(risk, no_baseline):
    """With no published baseline, forecasts vanish; failures keep their own reason."""
    eligible = no_baseline & F.col("current_status").isin(*INVENTORY_STATUSES)
    changed = {
        "forecast_status": F.when(eligible, "INSUFFICIENT_DATA").otherwise(F.col("forecast_status")),
        "forecast_reason": F.when(eligible, "NO_BASELINE").otherwise(F.col("forecast_reason")),
    }
    changed.update(_cleared(no_baseline, FORECAST_COLUMNS, risk))
    return risk.withColumns(changed)


def snapshot_expired(as_of):
    return plus_seconds(F.col("snapshot_at"), FRESH_SECONDS) <= as_of


def batch_clock(records):
    """Recorded batches run on their own ingest time, live ones on arrival time."""
    recorded = F.col("data_origin").isin(*MODE_ORIGINS["recorded"])
    return records.withColumns(
        {
            "clock_mode": F.when(recorded, "recorded").otherwise("wall"),
            "as_of": F.when(recorded, F.col("ingested_at")).otherwise(F.col("received_at")),
        }
    )


def status_histogram(risk):
    return risk.groupBy("snapshot_at", "current_status").agg(F.count("*").alias("stations"))


def fleet_kpis(risk):
    """One row per snapshot: stations, bikes, docks and risk counts over usable observations."""
    usable = F.col("current_reason").isNull()
    return risk.groupBy("snapshot_at").agg(
        F.count("*").alias("stations"),
        F.count_if(usable).alias("active_stations"),
        F.coalesce(F.sum(F.when(usable, F.col("bikes"))), F.lit(0)).alias("bikes"),
        F.coalesce(F.sum(F.when(usable, F.col("docks"))), F.lit(0)).alias("docks"),
        F.count_if(in_bucket(F.col("current_status"), "shortage")).alias("shortage_stations"),
        F.count_if(in_bucket(F.col("current_status"), "full")).alias("overflow_stations"),
    )


def risk_ranking(risk, view="current"):
    """Most urgent first, then station id; healthy stations are not part of the walk-through."""
    status = F.col(f"{view}_status")
    ranked = risk.withColumns({"severity": severity_rank(status), "in_traversal": status != "HEALTHY"})
    return ranked.orderBy("severity", "station_id")


def display_flags(risk, map_expired=None):
    """What the map may draw, forecast and dispatch."""
    live = F.lit(True) if map_expired is None else ~map_expired
    failed = ("SERVICE_UNAVAILABLE", "STALE_DATA", "INVALID_DATA", "INSUFFICIENT_DATA")
    drawable = live & (F.col("bikes") >= 0) & ~F.col("current_status").isin(*failed, "NOT_APPLICABLE")
    forecastable = drawable & F.col("projected_bikes_1h").isNotNull() & ~F.col("forecast_status").isin(*failed)
    dispatchable = (
        forecastable & (F.col("capacity") > 0) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )
    return risk.withColumns(
        {
            "can_draw": F.coalesce(drawable, F.lit(False)),
            "can_forecast": F.coalesce(forecastable, F.lit(False)),
            "can_dispatch": F.coalesce(dispatchable, F.lit(False)),
        }
    )


def station_search(risk, needle="", bucket="all", view="current"):
    """Stations whose name or id contains the text, ignoring case, within a risk bucket."""
    text = F.lower(F.concat(F.coalesce("station_name", F.lit("")), F.lit(" "), F.col("station_id")))
    wanted = needle.strip().lower()
    return risk.where(in_bucket(F.col(f"{view}_status"), bucket) & text.contains(wanted))
