"""Station flow, weekday-hour baseline and origin–destination aggregates."""

from pyspark.sql import functions as F

from dockflow.functions.times import hour_of, iso_day
from dockflow.schemas import FLOW_COUNTS

FLOW_KEYS = ("station_id", "service_date", "hour")
# Counter -> predicate on one endpoint event.
_COUNTERS = {
    "inbound_rides": "NOT departing",
    "outbound_rides": "departing",
    "electric_outbound": "departing AND rideable_type = 'electric_bike'",
    "classic_outbound": "departing AND rideable_type = 'classic_bike'",
    "member_outbound": "departing AND member_casual = 'member'",
    "casual_outbound": "departing AND member_casual = 'casual'",
}


def endpoint_events(trips):
    """Two rows per trip from one scan: the departure and the arrival, each on its own clock hour."""


    def side(departing, station, at):
        return F.struct(F.lit(departing).alias("departing"), F.col(station).alias("station_id"), F.col(at).alias("at"))

    sides = F.array(
        side(True, "start_station_id", "started_at_local"), side(False, "end_station_id", "ended_at_local")
    )
    return trips.select(F.inline(sides), "rideable_type", "member_casual").select(
        "departing",
        "station_id",
        F.to_date("at").alias("service_date"),
        hour_of(F.col("at")).alias("hour"),
        "rideable_type",
        "member_casual",
    )


def _counts(*names):
    return [F.count_if(F.expr(_COUNTERS[name])).alias(name) for name in names]


def sparse_flow(trips):
    """Hours with at least one departure or arrival."""
    return endpoint_events(trips).groupBy(*FLOW_KEYS).agg(*_counts(*_COUNTERS))


def outbound_split(trips):
    departures = trips.select(
        F.lit(True).alias("departing"),
        F.col("start_station_id").alias("station_id"),
        F.to_date("started_at_local").alias("service_date"),
        hour_of(F.col("started_at_local")).alias("hour"),
        "rideable_type",
        "member_casual",
    )
    return departures.groupBy(*FLOW_KEYS).agg(*_counts(*(n for n in _COUNTERS if n != "inbound_rides")))


def inbound(trips):
    arrivals = trips.select(
        F.col("end_station_id").alias("station_id"),
        F.to_date("ended_at_local").alias("service_date"),
        hour_of(F.col("ended_at_local")).alias("hour"),
    )
    return arrivals.groupBy(*FLOW_KEYS).agg(F.count("*").alias("inbound_rides"))


def fill_day(sparse):
    """All 24 hours of every station-day that has any row.

    The second aggregation runs on already counted hours, at most 24 per
    station-day, so its arrays are bounded; no grid is shuffled or joined.
    """
    entry = F.struct("hour", F.struct(*_COUNTERS).alias("counts"))
    days = sparse.groupBy("station_id", "service_date").agg(
        F.map_from_entries(F.collect_list(entry)).alias("hours")
    )
    hours = F.sequence(F.lit(0), F.lit(23)).cast("array<tinyint>")
    dense = days.select("station_id", "service_date", "hours", F.explode(hours).alias("hour"))
    dense = dense.withColumn("counts", F.try_element_at("hours", F.col("hour")))
    return dense.select(
        *FLOW_KEYS, *[F.coalesce(F.col("counts")[name], F.lit(0)).alias(name) for name in _COUNTERS]
    )


def with_flow_totals(flow):
    return flow.withColumns(
        {
            "net_flow": F.col("inbound_rides") - F.col("outbound_rides"),
            "total_activity": F.col("inbound_rides") + F.col("outbound_rides"),
        }
    ).select(*FLOW_KEYS, *FLOW_COUNTS)


def hourly_flow(trips):
    """Dense hourly flow of counted trips."""
    return with_flow_totals(fill_day(sparse_flow(trips)))


def hour_profile(flow):
    """Weekday-hour baseline over active days, zero hours included; the median is exact.

    Flow has one row per station and hour, so a group never holds more than one
    value per calendar week and the row count is the number of sample days.
    """
    by_day = flow.withColumn("day_of_week", iso_day(F.col("service_date")))
    return by_day.groupBy("station_id", "day_of_week", "hour").agg(
        F.avg("inbound_rides").alias("avg_inbound"),
        F.avg("outbound_rides").alias("avg_outbound"),
        F.avg("net_flow").alias("avg_net_flow"),
        F.median("net_flow").alias("median_net_flow"),
        F.count("*").alias("sample_days"),
    )


def od_hourly(trips):
    """Rides per departure hour and station pair; self-loops stay."""
    return trips.groupBy(
        F.to_date("started_at_local").alias("service_date"),
        hour_of(F.col("started_at_local")).alias("hour"),
        F.col("start_station_id").alias("from_station_id"),
        F.col("end_station_id").alias("to_station_id"),
    ).agg(F.count("*").alias("ride_count"))


def conservation(dwd, flow, od):
    """Totals that must agree, as one row with a verdict."""

    def one(df, **totals):
        names = ("source", "valid", "inbound", "outbound", "od_rides")
        columns = [totals.get(name, F.lit(None)).cast("bigint").alias(name) for name in names]
        return df.agg(*columns)

    parts = (
        one(dwd, source=F.count("*"), valid=F.count_if("is_valid_station_trip"))
        .unionByName(one(flow, inbound=F.sum("inbound_rides"), outbound=F.sum("outbound_rides")))
        .unionByName(one(od, od_rides=F.sum("ride_count")))
    )
    names = ("source", "valid", "inbound", "outbound", "od_rides")
    merged = parts.agg(*[F.coalesce(F.max(name), F.lit(0)).alias(name) for name in names])
    agree = (
        (F.col("valid") == F.col("inbound"))
        & (F.col("valid") == F.col("outbound"))
        & (F.col("valid") == F.col("od_rides"))
    )
    return merged.withColumn("conserved", agree)


def availability(flow):
    """Hours that can be replayed, per date."""
    pairs = flow.select("service_date", "hour").distinct()
    return pairs.groupBy("service_date").agg(F.sort_array(F.collect_list("hour")).alias("hours"))


def date_bounds(flow):
    return flow.agg(F.min("service_date").alias("min_service_date"), F.max("service_date").alias("max_service_date"))
