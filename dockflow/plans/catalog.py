"""Registered queries: every operator over whole tables, through the stand-in views."""

from pyspark.sql import functions as F

from dockflow.functions import geo, hashing, status, text, times
from dockflow.operators import flow as flows
from dockflow.operators import quality, rebalance, risk, serving, snapshots, stations, trips
from dockflow.plans.standins import spark_view, table
from dockflow.schemas import TRIP_COORDINATES
from dockflow.sinks.tsv import tsv_lines
from dockflow.sources import gbfs
from dockflow.streaming import gate

QUERIES = {}
# Parameters of the registered read queries.
REPLAY_DATE, REPLAY_HOUR, STATION, BUILT_AT = "2024-01-10", 8, "S42", "2024-03-01 00:00:00"
DATASET = "0" * 64


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _int(df, *names):
    """Small integers as INT, so both engines report one type."""
    return df.withColumns({name: F.col(name).cast("int") for name in names})


def _ntz(literal):
    return F.lit(literal).cast("timestamp_ntz")


# --- inputs shared by several queries ---------------------------------------


def _trips(spark, sf):
    return spark_view(spark, sf, "trips_v").withColumn("is_duplicate_ride", F.lit(False))


def _dwd(spark, sf):
    trip = _trips(spark, sf)
    seconds = times.elapsed_seconds(trip, "started_at_local", "ended_at_local")
    return trip.withColumns({"is_valid_station_trip": trips.valid_trip(), "duration_seconds": seconds})


def _valid(spark, sf):
    return _dwd(spark, sf).where("is_valid_station_trip")


def _flow(spark, sf):
    return flows.hourly_flow(_valid(spark, sf))


def _profile(spark, sf):
    return flows.hour_profile(_flow(spark, sf))


def _od(spark, sf):
    return flows.od_hourly(_valid(spark, sf))


def _raw(spark, sf):
    return spark_view(spark, sf, "raw_trips_v")


def _data_rows(spark, sf):
    return trips.without_header_rows(_raw(spark, sf))


def _typed(spark, sf):
    return trips.typed_trips(_data_rows(spark, sf), "ntz")


def _metadata(spark, sf):
    return spark_view(spark, sf, "stations_v")


def _dim(spark, sf):
    historical = stations.latest_attributes(stations.endpoint_candidates(_dwd(spark, sf)))
    return stations.station_dim(_metadata(spark, sf), historical, _ntz(BUILT_AT))


def _observations(spark, sf):
    return risk.latest_per_station(spark_view(spark, sf, "obs_v"))


def _status(spark, sf):
    return risk.current_status(_observations(spark, sf))


def _risk(spark, sf):
    return risk.station_risk(_observations(spark, sf), _profile(spark, sf))


def _ends(spark, sf):
    return rebalance.rebalance_ends(_risk(spark, sf))


# --- flow, profile, origin–destination --------------------------------------


@query
def station_hourly_flow(spark, sf):
    return _int(_flow(spark, sf), "hour")


@query
def station_outbound_split(spark, sf):
    return _int(flows.outbound_split(_valid(spark, sf)), "hour")


@query
def station_inbound(spark, sf):
    return _int(flows.inbound(_valid(spark, sf)), "hour")


@query
def station_hour_profile(spark, sf):
    return _int(flows.hour_profile(_flow(spark, sf)), "day_of_week", "hour")


@query
def od_hourly(spark, sf):
    return _int(_od(spark, sf), "hour")


@query
def od_top20(spark, sf):
    return serving.top_routes(_od(spark, sf))


@query
def od_top20_per_hour(spark, sf):
    return _int(serving.top_routes_per_hour(_od(spark, sf)), "hour")


@query
def od_for_station(spark, sf):
    return _int(serving.routes_of_station(_od(spark, sf), STATION), "hour")


@query
def od_display_summary(spark, sf):
    return _int(serving.route_summary(_od(spark, sf), _dim(spark, sf)), "hour")


@query
def od_hidden(spark, sf):
    return _int(stations.without_coordinates(_od(spark, sf), _metadata(spark, sf)), "hour")


@query
def od_distance(spark, sf):
    """Great-circle length of every route between stations with known positions."""
    spots = _metadata(spark, sf).select("station_id", "lat", "lon").where("lat IS NOT NULL")
    pairs = _od(spark, sf).groupBy("from_station_id", "to_station_id").agg(F.sum("ride_count").alias("ride_count"))
    joined = pairs.join(spots.toDF("from_station_id", "lat_a", "lon_a"), "from_station_id").join(
        spots.toDF("to_station_id", "lat_b", "lon_b"), "to_station_id"
    )
    metres = geo.great_circle_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return joined.select(
        "from_station_id", "to_station_id", "ride_count",
        F.round(metres, 3).alias("distance"), geo.whole_metres(metres).alias("distance_meters"),
    )


@query
def conservation_check(spark, sf):
    return flows.conservation(_dwd(spark, sf), _flow(spark, sf), _od(spark, sf))


@query
def availability(spark, sf):
    hours = F.array_join(F.transform("hours", lambda h: h.cast("string")), ",")
    return flows.availability(_flow(spark, sf)).select("service_date", hours.alias("hours"))


@query
def dataset_bounds(spark, sf):
    return flows.date_bounds(_flow(spark, sf))


@query
def next_available_hour(spark, sf):
    # Departure hours only, so dates have gaps.
    return _int(serving.neighbouring_hours(_od(spark, sf)), "hour", "previous_hour", "next_hour")


@query
def default_selection(spark, sf):
    return _int(serving.default_selection(_od(spark, sf)), "hour")


@query
def replay_stations(spark, sf):
    return serving.replay_stations(_flow(spark, sf), _od(spark, sf), _dim(spark, sf), REPLAY_DATE, REPLAY_HOUR)


@query
def replay_map(spark, sf):
    return serving.replay_map(_flow(spark, sf), _od(spark, sf), REPLAY_DATE, REPLAY_HOUR)


@query
def station_history(spark, sf):
    return _int(serving.station_history(flows.hour_profile(_flow(spark, sf)), _flow(spark, sf), STATION, REPLAY_DATE), "hour")


@query
def station_actual_24h(spark, sf):
    # Sparse input shows the zero filling.
    sparse = flows.with_flow_totals(flows.sparse_flow(_valid(spark, sf)))
    return _int(serving.station_actual(sparse, STATION, REPLAY_DATE), "hour")


@query
def station_lookup(spark, sf):
    current = _observations(spark, sf).groupBy("station_id").agg(
        F.max_by(F.struct("station_name", "lat", "lon", "capacity"), "snapshot_at").alias("row")
    )
    return stations.station_lookup(_metadata(spark, sf), current.select("station_id", "row.*"))


# --- trip cleaning ----------------------------------------------------------


@query
def trip_calendar(spark, sf):
    out = trips.with_trip_calendar(_trips(spark, sf)).select(
        "ride_id", "duration_seconds", "service_date", "start_hour", "day_of_week", "is_weekend"
    )
    return _int(out, "start_hour", "day_of_week")


@query
def valid_trips(spark, sf):
    return _dwd(spark, sf).select("ride_id", "is_valid_station_trip")


@query
def timestamp_parse(spark, sf):
    return trips.with_local_times(_raw(spark, sf), "ntz").select(
        "source_row_number", "started_at", "started_at_local", "ended_at_local"
    )


@query
def time_format_match(spark, sf):
    return _raw(spark, sf).select("source_row_number", times.matched_pattern(F.col("started_at")).alias("pattern"))


@query
def blank_to_null(spark, sf):
    names = ("start_station_id", "end_station_id", "start_station_name", "end_station_name")
    return _raw(spark, sf).select("source_row_number", *[text.blank_to_null(F.col(n)).alias(n) for n in names])


@query
def safe_coordinate(spark, sf):
    return _raw(spark, sf).select(
        "source_row_number", *[text.safe_coordinate(F.col(n), limit).alias(n) for n, limit in TRIP_COORDINATES.items()]
    )


@query
def contract_types(spark, sf):
    return trips.contract_types(_data_rows(spark, sf)).select(
        "source_row_number", *TRIP_COORDINATES, *[f"raw_{n}" for n in TRIP_COORDINATES]
    )


@query
def header_row_removal(spark, sf):
    return _data_rows(spark, sf).groupBy("source_file").agg(F.count("*").alias("data_rows"))


@query
def unknown_enum(spark, sf):
    return trips.unknown_enum_counts(_data_rows(spark, sf))


@query
def decimal_like_ids(spark, sf):
    kept = F.trim("start_station_id")
    return _data_rows(spark, sf).select("source_row_number", F.coalesce(text.decimal_like(kept), F.lit(False)).alias("decimal_like"))


@query
def gate_rejections(spark, sf):
    rejected = trips.rejected_rows(trips.with_local_times(_data_rows(spark, sf), "ntz"))
    return rejected.select("source_row_number", "gate_reason")


@query
def dwd_trips(spark, sf):
    """The trip table end to end, rows that the gate would refuse included."""
    typed = _typed(spark, sf).withColumn("ingest_batch_id", F.lit(DATASET))
    return _int(trips.build_dwd(typed), "start_hour", "day_of_week")


@query
def quality_summary(spark, sf):
    flagged = trips.flag_first_seen(_typed(spark, sf), "ride_id", ("source_year", "source_month", "source_file", "source_row_number"))
    return trips.quality_summary(flagged.withColumn("is_valid_station_trip", trips.valid_trip()))


DUP_ORDER = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "content")


@query
def dedup_flags(spark, sf):
    flagged = trips.flag_first_seen(spark_view(spark, sf, "dup_v"), "ride_id", DUP_ORDER, flag="is_duplicate")
    return flagged.select("ride_id", *DUP_ORDER[:3], "is_duplicate")


@query
def dedup_conflicts(spark, sf):
    flagged = trips.flag_first_seen(spark_view(spark, sf, "dup_v"), "ride_id", DUP_ORDER[:7], "content", "is_duplicate")
    return flagged.agg(
        F.count_if("is_duplicate").alias("duplicates"), F.count_if("is_conflict").alias("duplicate_conflict")
    )


@query
def row_signatures(spark, sf):
    """Distinct business contents and how often each repeats, told apart by signature only."""
    rows = spark_view(spark, sf, "dup_v").select(hashing.row_signature("l_shipdate", "l_suppkey", "content").alias("s"))
    return rows.groupBy("s").agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("contents"))


@query
def duplicate_key_groups(spark, sf):
    return quality.duplicate_key_groups(spark_view(spark, sf, "dup_v"), "ride_id")


@query
def duplicate_row_counts(spark, sf):
    return quality.duplicate_row_counts(spark_view(spark, sf, "dup_v"), "ride_id")


@query
def partition_counts(spark, sf):
    return quality.partition_counts(_raw(spark, sf), "source_year", "source_month", "source_file")


@query
def source_profile_rollup(spark, sf):
    return quality.source_profile(_data_rows(spark, sf))


@query
def time_format_counts(spark, sf):
    return quality.time_format_counts(_data_rows(spark, sf))


@query
def gate_metrics(spark, sf):
    typed = trips.with_local_times(trips.contract_types(_data_rows(spark, sf)), "ntz")
    return quality.gate_metrics(typed)


@query
def gate_ranges(spark, sf):
    return _int(quality.gate_ranges(_typed(spark, sf)), "min_start_hour", "max_start_hour", "min_day_of_week", "max_day_of_week")


@query
def gate_verdict(spark, sf):
    typed = trips.with_local_times(trips.contract_types(_data_rows(spark, sf)), "ntz")
    return quality.gate_verdict(quality.gate_metrics(typed), "PASS")


@query
def distinct_examples(spark, sf):
    names = ("rideable_type", "member_casual", "start_station_id", "end_station_id")
    return _int(quality.distinct_examples(_data_rows(spark, sf), names), "position")


@query
def count_reconciliation(spark, sf):
    """Per file: all records, data records and parsed records; the first count is unknown for one file."""
    parsed = trips.with_local_times(_raw(spark, sf), "ntz")
    counts = parsed.groupBy("source_file").agg(
        F.count_if(F.col("source_file") != "part-2.csv").alias("source"),
        F.count_if(F.col("ride_id") != "ride_id").alias("hive"),
        F.count_if(F.col("started_at_local").isNotNull()).alias("spark"),
    )
    counts = counts.withColumn("source", F.when(F.col("source") > 0, F.col("source")))
    return quality.reconcile_counts(counts, "source", "hive", "spark")


@query
def trip_rule_report(spark, sf):
    return quality.rule_report(_data_rows(spark, sf), quality.trip_rules())


@query
def trip_rule_verdict(spark, sf):
    return quality.verdict(quality.rule_report(_data_rows(spark, sf), quality.trip_rules()))


@query
def trip_rule_violations(spark, sf):
    return quality.rule_violations(_data_rows(spark, sf), quality.trip_rules(), "source_row_number")


# --- stations ---------------------------------------------------------------


@query
def endpoint_candidates(spark, sf):
    return stations.endpoint_candidates(_dwd(spark, sf))


@query
def station_latest_attributes(spark, sf):
    return stations.latest_attributes(stations.endpoint_candidates(_dwd(spark, sf)))


@query
def station_dim(spark, sf):
    return _dim(spark, sf)


@query
def metadata_hits(spark, sf):
    return stations.metadata_hits(stations.endpoint_candidates(_dwd(spark, sf)), _metadata(spark, sf))


@query
def canonical_mapping(spark, sf):
    mapped = stations.canonical_mapping(spark_view(spark, sf, "information_v"))
    return mapped.select("provider_station_id", "station_id", "mapping_status", "mapping_reason")


@query
def canonical_collisions(spark, sf):
    # Every fifth provider id is claimed by a second row.
    again = spark_view(spark, sf, "information_v")
    both = again.unionByName(again.where("provider_station_id LIKE '%5'").withColumn("short_name", F.lit(None).cast("string")))
    return stations.canonical_collisions(stations.canonical_mapping(both))


@query
def safe_station_fields(spark, sf):
    out = stations.safe_station_fields(spark_view(spark, sf, "information_v"))
    return out.select(
        "provider_station_id", "station_name", "lat", "lon", "capacity", "region_id",
        F.array_join("warnings", ",").alias("warnings"),
    )


@query
def missing_metadata_placeholders(spark, sf):
    metadata = _metadata(spark, sf).select("provider_station_id")
    rows = stations.missing_metadata_rows(spark_view(spark, sf, "feed_v"), metadata, _ntz(BUILT_AT))
    return rows.select("provider_station_id", "station_id", "mapping_status", "mapping_reason", "metadata_updated_at")


@query
def canonical_events(spark, sf):
    mapped = stations.to_canonical(spark_view(spark, sf, "feed_v"), _metadata(spark, sf))
    return mapped.groupBy("station_id", "mapped").agg(F.count("*").alias("events"), F.sum("bikes").alias("bikes"))


@query
def metadata_rule_violations(spark, sf):
    # Provider rows checked before normalisation, so several rules fire.
    rows = stations.canonical_mapping(spark_view(spark, sf, "information_v")).select(
        "*", F.col("name").alias("station_name"), F.col("mapping_status").isNotNull().alias("is_current"),
        F.lit("GBFS").alias("metadata_source"), _ntz(BUILT_AT).alias("metadata_updated_at"),
    )
    return quality.rule_violations(rows, stations.metadata_rules(), "provider_station_id")


# --- risk -------------------------------------------------------------------

_STATUS = ("event_id", "current_status", "current_reason", "fill_ratio", "expires_at")


@query
def current_status(spark, sf):
    return risk.current_status(spark_view(spark, sf, "obs_v")).select(*_STATUS)


@query
def fill_class(spark, sf):
    ratio = F.col("value") / F.lit(100.0)
    return table(spark, sf, "events").select("event_id", status.fill_class(ratio).alias("fill_class"))


@query
def observation_expiry(spark, sf):
    seen, reported = F.col("snapshot_at"), F.col("last_reported_at")
    return spark_view(spark, sf, "obs_v").select(
        "event_id",
        status.observed_at(seen, reported).alias("observed_at"),
        status.expires_at(seen, reported, F.col("as_of")).alias("expires_at"),
    )


_RISK = (
    "snapshot_at", "station_id", "current_status", "current_reason", "forecast_status", "forecast_reason",
    "fill_ratio", "expected_inbound_1h", "expected_outbound_1h", "expected_net_flow_1h", "projected_bikes_1h",
    "sample_days", "forecast_for", "expires_at",
)


@query
def forecast_risk(spark, sf):
    return _risk(spark, sf).select(*_RISK)


@query
def read_expiry_mask(spark, sf):
    later = times.plus_seconds(F.col("as_of"), 60)
    return risk.mask_expired(_risk(spark, sf), later).select(*_RISK)


@query
def no_baseline_mask(spark, sf):
    missing = F.hour("snapshot_at") % 2 == 0
    return risk.mask_without_baseline(_risk(spark, sf), missing).select(*_RISK)


@query
def live_map(spark, sf):
    """Stations of every snapshot as a reader sees them 100 seconds later."""
    shown = risk.mask_expired(_risk(spark, sf), times.plus_seconds(F.col("as_of"), 100), risk.snapshot_expired(times.plus_seconds(F.col("as_of"), 100)))
    return shown.select(*_RISK, "station_name", "lat", "lon", "capacity", "bikes", "docks")


@query
def live_suggestions(spark, sf):
    """Open suggestions a reader gets 60 seconds later, both ends still usable."""
    found = _risk(spark, sf)
    later = found.withColumn("as_of", times.plus_seconds(F.col("as_of"), 60))
    moves = rebalance.rebalance(rebalance.rebalance_ends(found))
    clock = later.groupBy("snapshot_at").agg(F.min("as_of").alias("read_at"))
    joined = moves.join(clock, "snapshot_at")
    return rebalance.usable_suggestions(joined, risk.mask_expired(later, F.col("as_of")), F.col("read_at"))


@query
def status_histogram(spark, sf):
    return risk.status_histogram(_status(spark, sf))


@query
def fleet_kpis(spark, sf):
    return risk.fleet_kpis(_status(spark, sf))


@query
def risk_ranking(spark, sf):
    return risk.risk_ranking(_risk(spark, sf), "forecast").select(
        "snapshot_at", "station_id", "forecast_status", "severity", "in_traversal"
    )


@query
def risk_bucket(spark, sf):
    state = F.col("current_status")
    return _status(spark, sf).select(
        "snapshot_at", "station_id", *[status.in_bucket(state, b).alias(b) for b in ("shortage", "full", "issue")]
    )


@query
def station_search(spark, sf):
    return risk.station_search(_status(spark, sf), " STN 4", "shortage").select("snapshot_at", "station_id", "current_status")


@query
def drawable_flags(spark, sf):
    return risk.display_flags(_risk(spark, sf)).select("snapshot_at", "station_id", "can_draw", "can_forecast", "can_dispatch")


@query
def station_page(spark, sf):
    ranked = _status(spark, sf).withColumn("severity", status.severity_rank(F.col("current_status")))
    order = ("severity", "station_id", "snapshot_at")
    return serving.page(ranked.select(*order, "current_status"), order, 1)


@query
def sample_rows(spark, sf):
    rows = _trips(spark, sf).select("ride_id", "source_row_number", "start_station_id", "end_station_id")
    return serving.sample_rows(rows, "ride_id", ["R77", "R5"], "source_row_number", 10)


# --- rebalancing ------------------------------------------------------------


@query
def rebalance_inputs(spark, sf):
    return _ends(spark, sf).select("snapshot_at", "station_id", "role", "need", "supply", "source_safe", "target_safe")


@query
def rebalance_target_order(spark, sf):
    return _int(rebalance.target_order(_ends(spark, sf)), "target_rank").select("snapshot_at", "station_id", "need", "target_rank")


@query
def rebalance_suggestions(spark, sf):
    return rebalance.rebalance(_ends(spark, sf))


@query
def rebalance_invariants(spark, sf):
    """Broken promises among the real moves and copies of the first two of each snapshot with wrong amounts."""
    ends = _ends(spark, sf)
    moves = rebalance.rebalance(ends).select("snapshot_at", "from_station_id", "to_station_id", "move_bikes", "priority")
    wrong = moves.where("priority <= 2").withColumn("move_bikes", F.expr("CASE WHEN priority = 1 THEN 1000 ELSE -1 END"))
    return rebalance.suggestion_breaches(moves.unionByName(wrong), ends)


@query
def usable_suggestions(spark, sf):
    found = _risk(spark, sf)
    moves = rebalance.rebalance(rebalance.rebalance_ends(found))
    return rebalance.dispatchable_suggestions(moves, risk.display_flags(found), _ntz("2024-01-15 12:00:00"))


@query
def snapshot_station_counts(spark, sf):
    return rebalance.snapshot_station_counts(spark_view(spark, sf, "obs_v").select("snapshot_at", "station_id").distinct())


# --- stream batches and collection log --------------------------------------


@query
def batch_integrity(spark, sf):
    return _int(quality.batch_integrity(spark_view(spark, sf, "records_v")), "announced")


@query
def batch_clock(spark, sf):
    return risk.batch_clock(spark_view(spark, sf, "records_v")).select("event_id", "clock_mode", "as_of")


@query
def origin_gate(spark, sf):
    return snapshots.origin_gate(spark_view(spark, sf, "records_v"), "live").select("event_id", "gate_reason")


@query
def record_rule_report(spark, sf):
    return quality.rule_report(spark_view(spark, sf, "records_v"), quality.record_rules())


@query
def gate_verdicts(spark, sf):
    """What the gate says of every visit when it has read all records: a visit that holds a time too old is refused from its first record on."""
    visits = gate.verdicts(spark_view(spark, sf, "gate_v"), complete=True)
    return visits.select("feed", F.col("visit.position").alias("first_position"), "head.snapshot_id", "received", "duplicates", "outcome", "reason")


@query
def snapshot_dedup(spark, sf):
    return snapshots.snapshot_states(spark_view(spark, sf, "attempts_v").withColumn("sent", F.expr("status <> 'FAILED_SEND'"))).select("attempt", "provider_time", "state")


@query
def pending_failures(spark, sf):
    return snapshots.pending_sends(spark_view(spark, sf, "attempts_v"))


@query
def collection_log_counters(spark, sf):
    return snapshots.log_counters(spark_view(spark, sf, "attempts_v"), "data_origin")


@query
def latest_live_metadata(spark, sf):
    return snapshots.latest_live_metadata(spark_view(spark, sf, "attempts_v"))


def _feed_documents(spark, sf):
    """One status document per event: the envelope with one station, as landed text."""
    vehicle = F.array(
        F.struct(F.lit("e").alias("vehicle_type_id"), F.col("ebikes").alias("count")),
        F.struct(F.lit("c").alias("vehicle_type_id"), F.lit(2).alias("count")),
    )
    station = F.struct(
        F.col("provider_station_id").alias("station_id"), F.col("bikes").alias("num_bikes_available"),
        F.col("docks").alias("num_docks_available"), F.col("bikes_disabled").alias("num_bikes_disabled"),
        F.col("installed_flag").alias("is_installed"), F.lit(True).alias("is_renting"), F.lit(1).alias("is_returning"),
        "last_reported", vehicle.alias("vehicle_types_available"),
    )
    body = F.struct(
        F.lit("2.3").alias("version"), "last_updated", F.lit(60).alias("ttl"),
        F.struct(F.array(station).alias("stations")).alias("data"),
    )
    feed = spark_view(spark, sf, "feed_v").select("event_id", F.to_json(body).alias("raw"))
    return gbfs.feed_rows(gbfs.documents(feed), "stations", "event_id")


@query
def feed_events(spark, sf):
    """Feed documents parsed back into events; times as POSIX seconds."""
    events = gbfs.status_events(_feed_documents(spark, sf), F.timestamp_seconds("last_updated"))
    return events.select(
        "event_id", "provider_station_id", F.unix_seconds("snapshot_at").alias("snapshot_posix"),
        "snapshot_at_local", F.unix_seconds("last_reported_at").alias("reported_posix"),
        "num_bikes_available", "num_docks_available", "num_bikes_disabled",
        "is_installed", "is_renting", "is_returning", "source_version",
    )


@query
def feed_rule_report(spark, sf):
    return quality.rule_report(_feed_documents(spark, sf), gbfs.status_rules())


@query
def vehicle_count_mismatch(spark, sf):
    warnings = gbfs.status_warnings(_feed_documents(spark, sf))
    return warnings.groupBy("provider_station_id", "warning", "field").agg(
        F.count("*").alias("rows"), F.sum("value").alias("value"), F.sum("expected").alias("expected")
    )


# --- releases and versions --------------------------------------------------


def _release_tables(spark, sf):
    stamp = F.lit(DATASET).alias("dataset_id")
    flow = _flow(spark, sf)
    return {
        "dim_station_v1": _dim(spark, sf).select("*", stamp),
        "dws_station_hourly_flow_v1": flow.select("*", stamp),
        "dws_station_hour_profile_v1": flows.hour_profile(flow).select("*", stamp),
        "dws_station_od_hourly_v1": _od(spark, sf).select("*", stamp),
    }


@query
def staging_checks(spark, sf):
    # Sound tables against an expectation of zero trips: only the three totals differ.
    return quality.staging_checks(_release_tables(spark, sf), DATASET, 0)


@query
def profile_flow_mismatch(spark, sf):
    # The baseline without the stations ending in 3, against sparse flow: both directions show.
    sparse = flows.sparse_flow(_valid(spark, sf))
    return _int(quality.profile_flow_mismatch(sparse, _profile(spark, sf)), "day_of_week", "hour")


@query
def incomplete_days(spark, sf):
    sparse = flows.with_flow_totals(flows.sparse_flow(_valid(spark, sf)))
    return quality.incomplete_days(sparse).select("station_id", "service_date", "rows", "activity")


@query
def response_invariants(spark, sf):
    shown = risk.mask_expired(_risk(spark, sf), F.col("as_of"))
    live = quality.rule_report(shown, quality.live_station_rules()).withColumn("part", F.lit("live"))
    routes = quality.rule_report(_od(spark, sf), quality.flow_rules()).withColumn("part", F.lit("flow"))
    return live.unionByName(routes)


@query
def unlisted_endpoints(spark, sf):
    return quality.unlisted_endpoints(_od(spark, sf), _metadata(spark, sf)).select(
        "service_date", F.col("hour").cast("int").alias("hour"), "from_station_id", "to_station_id"
    )


@query
def version_hashes(spark, sf):
    version = hashing.metadata_version(F.col("props"))
    return table(spark, sf, "events").select(
        "event_id", version.alias("metadata_version"), hashing.snapshot_id(F.col("event_type"), version).alias("snapshot_id")
    )


@query
def dataset_versions(spark, sf):
    """Version per event type over its months; the months are few however long the table."""
    day = F.substring(F.col("ts").cast("string"), 1, 10)
    months = table(spark, sf, "events").select("event_type", F.concat(day, F.lit(":"), F.sha2(day, 256)).alias("line")).distinct()
    grouped = months.groupBy("event_type").agg(F.collect_list("line").alias("lines"))
    version = hashing.metadata_version(F.col("event_type"))
    return grouped.select("event_type", hashing.dataset_id(version, F.col("lines")).alias("dataset_id"))


@query
def serving_projection(spark, sf):
    """Dimension rows as unquoted tab-separated text; control characters become spaces."""
    named = _metadata(spark, sf).withColumn("station_name", F.concat("station_name", F.lit("\tx\r\ny\\\"")))
    columns = ("station_id", "station_name", "capacity", "region_id", "is_current", "metadata_source", "metadata_updated_at")
    return tsv_lines(named.select(*columns), "<null>")
