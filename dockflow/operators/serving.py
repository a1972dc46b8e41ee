"""Read-side queries over one published release.

Each is a parametrised DataFrame function. Filters on `service_date` reach the
partition directory and filters on `hour` and ids reach the Parquet scan.
"""

from pyspark.sql import functions as F

from dockflow.functions.times import iso_day
from dockflow.operators.risk import mask_expired, mask_without_baseline, snapshot_expired
from dockflow.operators.stations import with_dim
from dockflow.schemas import FLOW_COUNTS


class TooLarge(ValueError):
    """A bounded response would have to be cut short."""


def bounded(df, limit, label):
    """The frame itself, or an error when it holds more than `limit` rows; never a shortened result."""
    if df.limit(limit + 1).count() > limit:
        raise TooLarge(f"{label} result too large")
    return df


# --- origin–destination displays -------------------------------------------


def top_routes(od, limit=20):
    """Busiest pairs of the whole input: a top-n plan, not a sort."""
    totals = od.groupBy("from_station_id", "to_station_id").agg(F.sum("ride_count").alias("ride_count"))
    return totals.orderBy(F.desc("ride_count"), "from_station_id", "to_station_id").limit(limit)


def top_routes_per_hour(od, limit=20):
    """Busiest pairs of every hour; the rank limit is applied before the shuffle as well."""
    rank = F.expr(
        "row_number() OVER (PARTITION BY service_date, hour"
        " ORDER BY ride_count DESC, from_station_id, to_station_id)"
    )
    return od.withColumn("position", rank).where(F.col("position") <= limit)


def routes_of_station(od, station_id):
    return od.where((F.col("from_station_id") == station_id) | (F.col("to_station_id") == station_id))


def route_summary(od, dim):
    """All routes against the ones that can be drawn, per hour."""
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    spots = dim.select("station_id", placed.alias("placed"))
    joined = od.join(spots.toDF("from_station_id", "from_ok"), "from_station_id", "left").join(
        spots.toDF("to_station_id", "to_ok"), "to_station_id", "left"
    )
    shown = F.coalesce(F.col("from_ok") & F.col("to_ok"), F.lit(False))
    return joined.groupBy("service_date", "hour").agg(
        F.count("*").alias("total"),
        F.count_if(shown).alias("shown"),
        F.sum("ride_count").alias("total_rides"),
        F.coalesce(F.sum(F.when(shown, F.col("ride_count"))), F.lit(0)).alias("shown_rides"),
    )


# --- selection --------------------------------------------------------------


def neighbouring_hours(flow):
    """Each replayable hour with the available hours before and after it on the same date."""
    pairs = flow.select("service_date", "hour").distinct()
    around = "(PARTITION BY service_date ORDER BY hour)"
    return pairs.withColumns(
        {"previous_hour": F.expr(f"lag(hour) OVER {around}"), "next_hour": F.expr(f"lead(hour) OVER {around}")}
    )


def default_selection(flow):
    """Latest date, earliest hour of that date."""
    days = flow.groupBy("service_date").agg(F.min("hour").alias("hour"))
    return days.agg(F.max("service_date").alias("service_date"), F.max_by("hour", "service_date").alias("hour"))


# --- replay -----------------------------------------------------------------


def _at(df, service_date, hour=None):
    picked = df.where(F.col("service_date") == F.lit(service_date).cast("date"))
    return picked if hour is None else picked.where(F.col("hour") == hour)


def replay_station_ids(flow, od, service_date, hour):
    """Stations active on the date, or at either end of a route of that hour."""
    routes = _at(od, service_date, hour)
    ends = routes.select(F.explode(F.array("from_station_id", "to_station_id")).alias("station_id"))
    return _at(flow, service_date).select("station_id").unionByName(ends).distinct()


def replay_stations(flow, od, dim, service_date, hour):
    """Replay stations with their attributes; a replay has no inventory and no risk."""
    found = with_dim(replay_station_ids(flow, od, service_date, hour), dim)
    nothing = F.lit("NOT_APPLICABLE")
    return found.withColumns({"current_status": nothing, "forecast_status": nothing}).orderBy("station_id")


def replay_flows(od, service_date, hour):
    rows = _at(od, service_date, hour).select("from_station_id", "to_station_id", "ride_count")
    return rows.orderBy("from_station_id", "to_station_id")


def is_available(flow, service_date, hour=None):
    return bool(_at(flow, service_date, hour).select("hour").take(1))


def replay_map(flow, od, service_date, hour):
    """Stations and routes of one replay hour in a single result, tagged by kind."""
    stations = replay_station_ids(flow, od, service_date, hour).select(
        F.lit("station").alias("kind"), "station_id",
        F.lit(None).cast("string").alias("to_station_id"), F.lit(None).cast("bigint").alias("ride_count"),
    )
    routes = replay_flows(od, service_date, hour).select(
        F.lit("flow").alias("kind"), F.col("from_station_id").alias("station_id"), "to_station_id", "ride_count"
    )
    return stations.unionByName(routes)


# --- station history --------------------------------------------------------


def station_profile(profile, station_id, day_of_week):
    """The 24 baseline rows of one station and weekday; none when there is no baseline."""
    return (
        profile.where((F.col("station_id") == station_id) & (F.col("day_of_week") == day_of_week))
        .select("hour", "avg_inbound", "avg_outbound", "avg_net_flow", "median_net_flow", "sample_days")
        .orderBy("hour")
    )


def station_actual(flow, station_id, service_date):
    """24 actual rows, zero filled, when the station has any row that day; else none."""
    rows = _at(flow, service_date).where(F.col("station_id") == station_id)
    by_hour = F.map_from_entries(F.collect_list(F.struct("hour", F.struct(*FLOW_COUNTS))))
    day = rows.groupBy("station_id", "service_date").agg(by_hour.alias("hours"))
    hours = F.sequence(F.lit(0), F.lit(23)).cast("array<tinyint>")
    filled = day.select("hours", F.explode(hours).alias("hour"))
    counts = F.try_element_at("hours", F.col("hour"))
    return filled.select(
        "hour", *[F.coalesce(counts[name], F.lit(0)).alias(name) for name in FLOW_COUNTS]
    ).orderBy("hour")


def station_history(profile, flow, station_id, service_date):
    """Baseline of the date's weekday beside that date's actual rows, hour by hour."""
    day = F.lit(service_date).cast("date")
    base = profile.where((F.col("station_id") == station_id) & (F.col("day_of_week") == iso_day(day)))
    base = base.select("hour", "avg_inbound", "avg_outbound", "avg_net_flow", "median_net_flow", "sample_days")
    return base.join(station_actual(flow, station_id, service_date), "hour", "full")


# --- live -------------------------------------------------------------------


def live_stations(risk, as_of, has_baseline=None):
    """Stations of the published snapshot as they may be shown at `as_of`."""
    expired = snapshot_expired(as_of)
    masked = risk if has_baseline is None else mask_without_baseline(risk, ~has_baseline)
    return mask_expired(masked, as_of, expired)


def page(df, order, number=0, size=50):
    """One page of a sorted result: a top-n of (number + 1) pages, then a skip."""
    return df.orderBy(*order).offset(number * size).limit(size)


def sample_rows(df, key, tracked, order, size):
    """Tracked keys first, in the order they were named, then source order."""
    position = F.array_position(F.array(*[F.lit(k) for k in tracked]), F.col(key))
    rank = F.when(position > 0, position).otherwise(len(tracked) + 1)
    return df.orderBy(rank, order).limit(size)
