"""Oracle SQL for the registered queries, in DuckDB's dialect.

Written from the rules, not from the operators: windows, grids and joins where
the operators use aggregates, and aggregates where they use windows.
"""

import re

from dockflow.plans.catalog import BUILT_AT, DATASET, REPLAY_DATE, REPLAY_HOUR, STATION
from dockflow.plans.standins import CTES as VIEWS

_FORMATS = (
    "['%m/%d/%Y %H:%M:%S.%f', '%m/%d/%Y %H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S',"
    " '%Y-%m-%dT%H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S']"
)
_OK = "start_station_id IS NOT NULL AND end_station_id IS NOT NULL AND ended_at_local > started_at_local"
_COUNTS = "inbound_rides, outbound_rides, net_flow, total_activity, electric_outbound, classic_outbound, member_outbound, casual_outbound"


# Visits by plain windows over records in order, and a walk over the visits of each feed. Columns first_* are positions.
_GATE = f"""WITH RECURSIVE gate_v AS ({VIEWS["gate_v"]}),
o AS (SELECT *, lag(snapshot_id) OVER w AS id_before, lag(record_type) OVER w AS type_before, row_number() OVER w AS nth FROM gate_v WINDOW w AS (PARTITION BY feed ORDER BY position)),
n AS (SELECT *, sum(CASE WHEN nth = 1 OR snapshot_id <> id_before OR type_before = 'snapshot_end' THEN 1 ELSE 0 END) OVER (PARTITION BY feed ORDER BY position) AS v FROM o),
k AS (SELECT *, first_value(value) OVER w AS own_value, row_number() OVER w AS again, record_type = 'station' AS st,
  first_value(metadata_version || data_origin || ingested_at) OVER (PARTITION BY feed, v ORDER BY position) AS head FROM n WINDOW w AS (PARTITION BY feed, v, record_type, record_key ORDER BY position)),
g AS (SELECT feed, v, min(position) AS first_position, min(snapshot_id) AS snapshot_id, count(*) FILTER (NOT st) AS ends, max(station_count) AS announced,
  max(snapshot_at) FILTER (NOT st) AS end_at, count(*) FILTER (st AND again = 1) AS stations, count(*) FILTER (st AND again = 1 AND NOT known_station) AS strange,
  count(*) FILTER (st AND again = 1 AND snapshot_at <> (SELECT max(e.snapshot_at) FROM n e WHERE e.feed = k.feed AND e.v = k.v AND e.record_type = 'snapshot_end')) AS off,
  min(snapshot_at) FILTER (st) AS low_at,
  arg_min(CASE WHEN broken_rule = 'key_mismatch' THEN 'KEY_MISMATCH' WHEN broken_rule IS NOT NULL THEN 'INVALID_RECORD' WHEN data_origin NOT IN ('GBFS_LIVE') THEN 'INVALID_ORIGIN_FOR_MODE'
    WHEN metadata_version || data_origin || ingested_at <> head THEN 'MIXED_BATCH' WHEN st AND value <> own_value THEN 'STATION_CONFLICT' END, position)
    FILTER (broken_rule IS NOT NULL OR data_origin NOT IN ('GBFS_LIVE') OR metadata_version || data_origin || ingested_at <> head OR (st AND value <> own_value)) AS broken,
  min(position) FILTER (broken_rule IS NOT NULL OR data_origin NOT IN ('GBFS_LIVE') OR metadata_version || data_origin || ingested_at <> head OR (st AND value <> own_value)) AS broken_at
  FROM k GROUP BY feed, v),
l AS (SELECT *, max(v) OVER (PARTITION BY feed) AS last_v FROM g),
w AS (
  SELECT feed, CAST(0 AS HUGEINT) AS v, CAST(NULL AS VARCHAR) AS id_out, CAST(NULL AS VARCHAR) AS at_out, CAST(NULL AS VARCHAR) AS at_in, CAST(NULL AS VARCHAR) AS reason FROM l GROUP BY feed
  UNION ALL
  SELECT feed, v, CASE WHEN reason IS NULL AND ends > 0 THEN snapshot_id ELSE id_out END, CASE WHEN reason IS NULL AND ends > 0 THEN end_at ELSE at_out END, at_out, reason
  FROM (SELECT l.feed, l.v, l.ends, l.snapshot_id, l.end_at, w.id_out, w.at_out,
    CASE WHEN l.snapshot_id = w.id_out THEN 'ALREADY_PUBLISHED'
      WHEN l.low_at <= w.at_out AND l.first_position < coalesce(l.broken_at, l.first_position + 1) THEN 'OLDER_THAN_PUBLISHED'
      WHEN l.broken IS NOT NULL THEN l.broken WHEN l.ends > 0 AND (l.announced <> l.stations OR l.strange > 0) THEN 'COUNT_OR_METADATA_MISMATCH'
      WHEN l.ends > 0 AND l.off > 0 THEN 'SNAPSHOT_TIME_MISMATCH' WHEN l.ends > 0 AND l.end_at <= w.at_out THEN 'OLDER_THAN_PUBLISHED'
      WHEN l.ends = 0 AND l.v < l.last_v THEN 'NEXT_BATCH_BEFORE_END' END AS reason
    FROM w JOIN l ON l.feed = w.feed AND l.v = w.v + 1) x),
s AS (SELECT l.*, w.reason, CASE WHEN w.reason = 'ALREADY_PUBLISHED' THEN -1 WHEN w.reason = 'OLDER_THAN_PUBLISHED' AND l.low_at <= w.at_in THEN l.first_position
  WHEN w.reason = l.broken THEN l.broken_at ELSE 9223372036854775807 END AS stop FROM l JOIN w ON w.feed = l.feed AND w.v = l.v)
SELECT s.feed, s.first_position, s.snapshot_id, count(*) FILTER (k.st AND k.position < s.stop) AS received, count(*) FILTER (k.st AND k.again > 1 AND k.position < s.stop) AS duplicates,
  CASE WHEN s.reason = 'ALREADY_PUBLISHED' THEN 'IGNORED' WHEN s.reason IS NOT NULL THEN 'REJECTED' WHEN s.ends > 0 THEN 'PUBLISHED' END AS outcome, s.reason
FROM s JOIN k ON k.feed = s.feed AND k.v = s.v GROUP BY s.feed, s.first_position, s.snapshot_id, s.reason, s.ends"""


def _coord(name, limit):
    cast = f"TRY_CAST({name} AS DOUBLE)"
    return f"CASE WHEN {cast} BETWEEN -{limit} AND {limit} AND NOT isnan({cast}) THEN {cast} END"


def _blank(name):
    return f"(coalesce(trim({name}), '') = '')"


def _shape(text):
    """Which of the six formats a text follows."""
    date, month = r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}"
    clock, fraction = r"\d{2}:\d{2}:\d{2}", r"\.\d{1,6}"
    cases = [
        (rf"{month} {clock}{fraction}", "MM/dd/yyyy HH:mm:ss.SSSSSS"),
        (rf"{month} {clock}", "MM/dd/yyyy HH:mm:ss"),
        (rf"{date} {clock}{fraction}", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        (rf"{date} {clock}", "yyyy-MM-dd HH:mm:ss"),
        (rf"{date}T{clock}{fraction}", "yyyy-MM-dd''T''HH:mm:ss.SSSSSS"),
        (rf"{date}T{clock}", "yyyy-MM-dd''T''HH:mm:ss"),
    ]
    chain = " ".join(f"WHEN regexp_full_match({text}, '{rx}') THEN '{name}'" for rx, name in cases)
    return f"CASE WHEN try_strptime({text}, {_FORMATS}) IS NULL THEN NULL {chain} END"


_FAIL = """CASE
 WHEN snapshot_at IS NULL OR snapshot_at > as_of + INTERVAL 60 SECOND OR coalesce(last_reported_at > as_of + INTERVAL 60 SECOND, false) THEN 'INVALID_TIME'
 WHEN as_of >= expires_at THEN 'STALE_OBSERVATION'
 WHEN is_installed = false OR is_renting = false OR is_returning = false THEN 'SERVICE_FLAGS'
 WHEN bikes < 0 OR docks < 0 THEN 'NEGATIVE_INVENTORY'
 WHEN is_installed IS NULL OR is_renting IS NULL OR is_returning IS NULL OR bikes IS NULL OR docks IS NULL THEN 'MISSING_INVENTORY'
 WHEN bikes + docks = 0 THEN 'ZERO_SERVICEABLE_CAPACITY' END"""


def _classify(r):
    return (
        f"CASE WHEN {r} <= 0.15::DOUBLE THEN 'SHORTAGE_RISK' WHEN {r} <= 0.30::DOUBLE THEN 'LOW_INVENTORY'"
        f" WHEN {r} < 0.70::DOUBLE THEN 'HEALTHY' WHEN {r} < 0.85::DOUBLE THEN 'HIGH_INVENTORY' ELSE 'OVERFLOW_RISK' END"
    )


def _status_of(source):
    return f"""SELECT *, CASE current_reason WHEN 'INVALID_TIME' THEN 'INVALID_DATA' WHEN 'NEGATIVE_INVENTORY' THEN 'INVALID_DATA'
   WHEN 'STALE_OBSERVATION' THEN 'STALE_DATA' WHEN 'SERVICE_FLAGS' THEN 'SERVICE_UNAVAILABLE' WHEN 'MISSING_INVENTORY' THEN 'INSUFFICIENT_DATA'
   WHEN 'ZERO_SERVICEABLE_CAPACITY' THEN 'INSUFFICIENT_DATA' ELSE {_classify('bikes::DOUBLE / (bikes + docks)')} END AS current_status,
   CASE WHEN current_reason IS NULL THEN bikes::DOUBLE / (bikes + docks) END AS fill_ratio
 FROM (SELECT *, {_FAIL} AS current_reason FROM (SELECT *, CASE WHEN last_reported_at IS NULL OR snapshot_at < last_reported_at THEN snapshot_at ELSE last_reported_at END AS observed_at,
   CASE WHEN last_reported_at IS NULL OR snapshot_at < last_reported_at THEN snapshot_at ELSE last_reported_at END + INTERVAL 180 SECOND AS expires_at FROM {source}) a) b"""


_EXPECT = "expected_inbound_1h, expected_outbound_1h, expected_net_flow_1h, projected_bikes_1h, sample_days, forecast_for"
_RISK = (
    "snapshot_at, station_id, current_status, current_reason, forecast_status, forecast_reason, fill_ratio,"
    f" {_EXPECT}, expires_at"
)


def _masked(source, when, extra=""):
    cleared = ", ".join(f"CASE WHEN x THEN NULL ELSE {n} END AS {n}" for n in ["fill_ratio", *_EXPECT.split(", ")])
    return f"""SELECT * EXCLUDE (x, current_status, forecast_status, current_reason, forecast_reason, fill_ratio, {_EXPECT}),
  CASE WHEN x THEN 'STALE_DATA' ELSE current_status END AS current_status, CASE WHEN x THEN 'STALE_DATA' ELSE forecast_status END AS forecast_status,
  CASE WHEN x THEN 'STALE_OBSERVATION' ELSE current_reason END AS current_reason, CASE WHEN x THEN 'STALE_OBSERVATION' ELSE forecast_reason END AS forecast_reason,
  {cleared} FROM (SELECT *, ({when}) AS x FROM {source}) m"""


_USABLE = "current_status NOT IN ('STALE_DATA', 'SERVICE_UNAVAILABLE', 'INVALID_DATA', 'INSUFFICIENT_DATA')"

STEPS = {
    "dwd_v": f"SELECT *, coalesce({_OK}, false) AS is_valid FROM trips_v",
    "valid_v": "SELECT * FROM dwd_v WHERE is_valid",
    "out_v": """SELECT start_station_id AS station_id, CAST(started_at_local AS DATE) AS service_date, CAST(hour(started_at_local) AS INTEGER) AS hour,
  count(*) AS outbound_rides, count(*) FILTER (rideable_type = 'electric_bike') AS electric_outbound, count(*) FILTER (rideable_type = 'classic_bike') AS classic_outbound,
  count(*) FILTER (member_casual = 'member') AS member_outbound, count(*) FILTER (member_casual = 'casual') AS casual_outbound FROM valid_v GROUP BY 1, 2, 3""",
    "in_v": "SELECT end_station_id AS station_id, CAST(ended_at_local AS DATE) AS service_date, CAST(hour(ended_at_local) AS INTEGER) AS hour, count(*) AS inbound_rides FROM valid_v GROUP BY 1, 2, 3",
    "grid_v": """SELECT station_id, service_date, CAST(h AS INTEGER) AS hour FROM (SELECT station_id, service_date FROM out_v UNION SELECT station_id, service_date FROM in_v) d, range(24) t(h)""",
    "flow_v": """SELECT station_id, service_date, hour, inbound_rides, outbound_rides, inbound_rides - outbound_rides AS net_flow, inbound_rides + outbound_rides AS total_activity,
  electric_outbound, classic_outbound, member_outbound, casual_outbound FROM (SELECT g.station_id, g.service_date, g.hour, coalesce(inbound_rides, 0) AS inbound_rides, coalesce(outbound_rides, 0) AS outbound_rides,
  coalesce(electric_outbound, 0) AS electric_outbound, coalesce(classic_outbound, 0) AS classic_outbound, coalesce(member_outbound, 0) AS member_outbound, coalesce(casual_outbound, 0) AS casual_outbound
  FROM grid_v g LEFT JOIN in_v USING (station_id, service_date, hour) LEFT JOIN out_v USING (station_id, service_date, hour)) j""",
    "sparse_v": "SELECT * FROM flow_v WHERE total_activity > 0",
    "profile_v": """SELECT station_id, CAST(isodow(service_date) AS INTEGER) AS day_of_week, hour, avg(inbound_rides) AS avg_inbound, avg(outbound_rides) AS avg_outbound, avg(net_flow) AS avg_net_flow,
  CAST(median(net_flow) AS DOUBLE) AS median_net_flow, count(DISTINCT service_date) AS sample_days FROM flow_v GROUP BY 1, 2, 3""",
    "base_v": "SELECT * FROM profile_v",
    "od_v": """SELECT CAST(started_at_local AS DATE) AS service_date, CAST(hour(started_at_local) AS INTEGER) AS hour, start_station_id AS from_station_id, end_station_id AS to_station_id,
  count(*) AS ride_count FROM valid_v GROUP BY 1, 2, 3, 4""",
    "ends_v": """SELECT start_station_id AS station_id, start_station_name AS station_name, start_lat AS lat, start_lng AS lon, started_at_local AS event_time, source_file, source_row_number, CAST(0 AS INTEGER) AS side
  FROM dwd_v WHERE start_station_id IS NOT NULL UNION ALL SELECT end_station_id, end_station_name, end_lat, end_lng, ended_at_local, source_file, source_row_number, CAST(1 AS INTEGER) FROM dwd_v WHERE end_station_id IS NOT NULL""",
    "latest_v": """SELECT DISTINCT station_id, first_value(station_name IGNORE NULLS) OVER w AS station_name, first_value(lat IGNORE NULLS) OVER w AS lat, first_value(lon IGNORE NULLS) OVER w AS lon FROM ends_v
  WINDOW w AS (PARTITION BY station_id ORDER BY event_time DESC NULLS LAST, source_file, source_row_number, side ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "dim_v": f"""SELECT coalesce(m.station_id, h.station_id) AS station_id, coalesce(m.station_name, h.station_name) AS station_name, coalesce(m.lat, h.lat) AS lat, coalesce(m.lon, h.lon) AS lon,
  m.capacity, m.region_id, m.station_id IS NOT NULL AS is_current, CASE WHEN m.station_id IS NULL THEN 'HISTORICAL' ELSE 'GBFS' END AS metadata_source,
  coalesce(m.metadata_updated_at, TIMESTAMP '{BUILT_AT}') AS metadata_updated_at FROM stations_v m FULL JOIN latest_v h ON m.station_id = h.station_id""",
    "data_v": "SELECT * FROM raw_trips_v WHERE NOT (ride_id = 'ride_id' AND started_at = 'started_at' AND end_lng IS NOT DISTINCT FROM 'end_lng')",
    "typed_v": f"""SELECT source_row_number, source_file, source_year, source_month, ride_id, rideable_type, member_casual, started_at, ended_at,
  try_strptime(started_at, {_FORMATS}) AS started_at_local, try_strptime(ended_at, {_FORMATS}) AS ended_at_local,
  nullif(trim(start_station_id), '') AS start_station_id, nullif(trim(end_station_id), '') AS end_station_id, nullif(trim(start_station_name), '') AS start_station_name, nullif(trim(end_station_name), '') AS end_station_name,
  {_coord('start_lat', 90)} AS start_lat, {_coord('start_lng', 180)} AS start_lng, {_coord('end_lat', 90)} AS end_lat, {_coord('end_lng', 180)} AS end_lng FROM data_v""",
    "flagged_v": f"""SELECT *, CAST(floor(date_diff('microsecond', started_at_local, ended_at_local) / 1000000.0) AS BIGINT) AS duration_seconds, dup AS is_duplicate_ride, NOT dup AND coalesce({_OK}, false) AS is_valid_station_trip
  FROM (SELECT *, row_number() OVER (PARTITION BY ride_id ORDER BY source_year, source_month, source_file, source_row_number) > 1 AS dup FROM SRC) f""",
    "snap_v": "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_at, station_id ORDER BY event_id DESC) AS rn FROM obs_v) s WHERE rn = 1",
    "status_v": _status_of("snap_v"),
    "risk_v": f"""SELECT *, CASE WHEN current_reason IS NOT NULL THEN current_status WHEN usable THEN {_classify('projected_bikes_1h / (bikes + docks)')} ELSE 'INSUFFICIENT_DATA' END AS forecast_status,
  CASE WHEN NOT usable THEN coalesce(current_reason, 'NO_BASELINE') END AS forecast_reason FROM (
  SELECT s.*, (current_reason IS NULL AND coalesce(p.sample_days >= 1, false)) AS usable, CASE WHEN current_reason IS NULL THEN avg_inbound END AS expected_inbound_1h,
   CASE WHEN current_reason IS NULL THEN avg_outbound END AS expected_outbound_1h, CASE WHEN current_reason IS NULL THEN avg_net_flow END AS expected_net_flow_1h,
   CASE WHEN current_reason IS NULL THEN bikes + avg_net_flow END AS projected_bikes_1h, CASE WHEN current_reason IS NULL THEN p.sample_days END AS sample_days,
   CASE WHEN current_reason IS NULL AND p.sample_days IS NOT NULL THEN snapshot_at + INTERVAL 1 HOUR END AS forecast_for
  FROM status_v s LEFT JOIN base_v p ON p.station_id = s.station_id AND p.day_of_week = isodow(timezone('America/New_York', timezone('UTC', s.snapshot_at)))
   AND p.hour = hour(timezone('America/New_York', timezone('UTC', s.snapshot_at)))) r""",
    "feasible_v": f"SELECT * FROM risk_v WHERE capacity > 0 AND lat IS NOT NULL AND lon IS NOT NULL AND bikes >= 0 AND docks >= 0 AND {_USABLE} AND projected_bikes_1h IS NOT NULL",
    "role_v": """SELECT snapshot_at, station_id, CASE forecast_status WHEN 'SHORTAGE_RISK' THEN 'target' ELSE 'source' END AS role,
  CAST(greatest(0, ceil((3 * capacity)::DOUBLE / 10::DOUBLE - projected_bikes_1h)) AS INTEGER) AS need, CAST(greatest(0, floor(projected_bikes_1h - (7 * capacity)::DOUBLE / 10::DOUBLE)) AS INTEGER) AS supply,
  CAST(greatest(0, bikes - (3 * (bikes + docks) + 9) // 10) AS INTEGER) AS source_safe, CAST(greatest(0, (7 * (bikes + docks)) // 10 - bikes) AS INTEGER) AS target_safe
  FROM feasible_v WHERE forecast_status IN ('SHORTAGE_RISK', 'OVERFLOW_RISK')""",
    # The greedy assignment as a walk over ordered target-source pairs; the state is the list of what sources have left.
    "active_v": """SELECT *, row_number() OVER (PARTITION BY snapshot_at, role ORDER BY station_id) AS ix FROM (
  SELECT r.*, f.lat, f.lon, f.expires_at, CASE WHEN r.role = 'target' THEN least(need, docks, target_safe) ELSE least(supply, bikes, source_safe) END AS room
  FROM role_v r JOIN feasible_v f ON f.snapshot_at = r.snapshot_at AND f.station_id = r.station_id) a WHERE room > 0""",
    "pair_v": """SELECT *, row_number() OVER (PARTITION BY snapshot_at ORDER BY need DESC, to_id, metres, from_id) AS k,
  row_number() OVER (PARTITION BY snapshot_at, to_id ORDER BY metres, from_id) AS pos FROM (
  SELECT *, 12742000 * atan2(sqrt(h), sqrt(1 - h)) AS metres FROM (
   SELECT t.snapshot_at, t.station_id AS to_id, s.station_id AS from_id, t.need, t.room AS t_room, s.supply, s.room AS s_room, s.ix, least(t.expires_at, s.expires_at) AS expires_at,
    pow(sin(radians(s.lat - t.lat) / 2), 2) + cos(radians(t.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - t.lon) / 2), 2) AS h
   FROM active_v t JOIN active_v s ON t.snapshot_at = s.snapshot_at WHERE t.role = 'target' AND s.role = 'source') p) q""",
    "walk_v": """SELECT snapshot_at, CAST(0 AS BIGINT) AS k, list(room ORDER BY station_id) AS rest, 0 AS wanted, 0 AS moved, 0 AS had, 0 AS short FROM active_v WHERE role = 'source' GROUP BY snapshot_at
  UNION ALL SELECT snapshot_at, k, rest[:ix - 1] || [had - moved] || rest[ix + 1:], short - moved, moved, had, short FROM (
   SELECT *, least(had, short) AS moved FROM (SELECT p.snapshot_at, p.k, w.rest, p.ix, w.rest[p.ix] AS had, CASE WHEN p.pos = 1 THEN p.t_room ELSE w.wanted END AS short
    FROM walk_v w JOIN pair_v p ON p.snapshot_at = w.snapshot_at AND p.k = w.k + 1) x) y""",
    "moves_v": """SELECT w.snapshot_at, from_id AS from_station_id, to_id AS to_station_id, CAST(moved AS INTEGER) AS move_bikes, CAST(supply - (s_room - had) AS INTEGER) AS from_surplus,
  CAST(need - (t_room - short) AS INTEGER) AS to_deficit, CAST(floor(metres + 0.5) AS INTEGER) AS distance_meters, CAST(row_number() OVER (PARTITION BY w.snapshot_at ORDER BY w.k) AS INTEGER) AS priority, expires_at
  FROM walk_v w JOIN pair_v p ON p.snapshot_at = w.snapshot_at AND p.k = w.k WHERE moved > 0""",
    "map_v": """SELECT provider_station_id, CASE WHEN s IS NULL OR owners > 1 THEN 'gbfs:' || provider_station_id ELSE s END AS station_id,
  CASE WHEN s IS NULL OR owners > 1 THEN 'ISOLATED' ELSE 'SHORT_NAME' END AS mapping_status,
  CASE WHEN s IS NULL THEN 'MISSING_SHORT_NAME' WHEN owners > 1 THEN 'DUPLICATE_SHORT_NAME' END AS mapping_reason, name, lat, lon, capacity, region_id
  FROM (SELECT *, count(*) OVER (PARTITION BY s) AS owners FROM (SELECT *, nullif(trim(short_name), '') AS s FROM information_v) i) j""",
}


def sql(body, **steps):
    """The body with exactly the common table expressions it uses, in dependency order."""
    known = {**VIEWS, **STEPS, **steps}
    ordered = []

    def visit(text):
        for name in [n for n in known if re.search(rf"\b{n}\b", text)]:
            if name not in ordered and known[name] is not text:
                visit(known[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    head = ",\n".join(f"{name} AS ({known[name]})" for name in ordered)
    recursive = "RECURSIVE " if "walk_v" in ordered else ""
    return f"WITH {recursive}{head}\n{body}" if ordered else body


def _report(source, rules):
    parts = [
        f"SELECT '{name}' AS rule, '{severity}' AS severity, count(*) FILTER ({cond}) AS violations, count(*) AS rows_checked FROM {source}"
        for name, severity, cond in rules
    ]
    return " UNION ALL ".join(parts)


def _violations(source, identity, rules):
    return " UNION ALL ".join(
        f"SELECT {identity}, '{name}' AS rule, '{severity}' AS severity FROM {source} WHERE {cond}" for name, severity, cond in rules
    )


def _num(name):
    return f"TRY_CAST(trim({name}) AS DOUBLE)"


_COORDS = {"start_lat": 90, "start_lng": 180, "end_lat": 90, "end_lng": 180}
_FIELDS = (
    "ride_id rideable_type started_at ended_at start_station_name start_station_id end_station_name end_station_id"
    " start_lat start_lng end_lat end_lng member_casual"
).split()
_ENUMS = {"rideable_type": "('classic_bike', 'electric_bike')", "member_casual": "('member', 'casual')"}
_TRIP_RULES = (
    [(f"required_{n}", "error", _blank(n)) for n in ("ride_id", "rideable_type", "member_casual")]
    + [
        rule
        for n in ("started_at", "ended_at")
        for rule in (
            (f"missing_{n}", "error", _blank(n)),
            (f"unparsed_{n}", "error", f"NOT {_blank(n)} AND try_strptime(trim({n}), {_FORMATS}) IS NULL"),
        )
    ]
    + [(f"unknown_{n}", "warning", f"NOT {_blank(n)} AND trim({n}) NOT IN {v}") for n, v in _ENUMS.items()]
    + [
        ("invalid_coordinate", "warning", " OR ".join(f"(NOT {_blank(n)} AND {_num(n)} IS NULL)" for n in _COORDS)),
        (
            "out_of_range_coordinate",
            "warning",
            " OR ".join(f"coalesce(isnan({_num(n)}) OR abs({_num(n)}) > {lim}, false)" for n, lim in _COORDS.items()),
        ),
    ]
)


def _gate_metrics():
    counters = {"total_rows": "true", "null_service_date": f"{_blank('started_at')} OR try_strptime(started_at, {_FORMATS}) IS NULL"}
    for n in ("start_station_id", "end_station_id", "ride_id", "rideable_type", "started_at", "ended_at", "member_casual"):
        counters[f"null_{n}"] = _blank(n)
    for n in ("started_at", "ended_at"):
        counters[f"invalid_{n}"] = f"NOT {_blank(n)} AND try_strptime({n}, {_FORMATS}) IS NULL"
    for n, lim in _COORDS.items():
        cast = f"TRY_CAST({n} AS DOUBLE)"
        counters[f"null_{n}"] = f"{cast} IS NULL"
        counters[f"invalid_{n}"] = f"NOT {_blank(n)} AND ({cast} IS NULL OR isnan({cast}))"
        counters[f"out_of_range_{n}"] = f"NOT isnan({cast}) AND abs({cast}) > {lim}"
    for n, known in _ENUMS.items():
        counters[f"unknown_{n}"] = f"NOT {_blank(n)} AND {n} NOT IN {known}"
    return " UNION ALL ".join(
        f"SELECT '{k}' AS metric, count(*) FILTER ({cond}) AS value FROM data_v" for k, cond in counters.items()
    )


def _source_profile():
    bad = {n: f"(NOT {_blank(n)} AND ({_num(n)} IS NULL OR NOT isfinite({_num(n)})))" for n in _COORDS}
    out = {n: f"(NOT {_blank(n)} AND coalesce(isfinite({_num(n)}) AND abs({_num(n)}) > {lim}, false))" for n, lim in _COORDS.items()}
    start, end = (f"try_strptime(trim({n}), {_FORMATS})" for n in ("started_at", "ended_at"))
    cols = {"record_count": "true"}
    cols.update({f"missing_{n}": _blank(n) for n in _FIELDS})
    cols.update({f"invalid_{n}": f"NOT {_blank(n)} AND try_strptime(trim({n}), {_FORMATS}) IS NULL" for n in ("started_at", "ended_at")})
    cols.update({f"unknown_{n}": f"NOT {_blank(n)} AND trim({n}) NOT IN {v}" for n, v in _ENUMS.items()})
    cols.update({f"decimal_{n}": f"regexp_full_match(trim({n}), '[+-]?\\d+\\.\\d+')" for n in ("start_station_id", "end_station_id")})
    cols.update({f"invalid_{n}": bad[n] for n in _COORDS})
    cols.update({f"outside_{n}": out[n] for n in _COORDS})
    cols["coordinate_anomaly_rows"] = " OR ".join([*bad.values(), *out.values()])
    cols["non_positive_duration"] = f"{end} <= {start}"
    cols["uncomputable_duration"] = f"{end} IS NULL OR {start} IS NULL"
    picked = ", ".join(f"count(*) FILTER ({cond}) AS {n}" for n, cond in cols.items())
    ratios = ", ".join(
        f"round(count(*) FILTER ({_blank(n)}) / count(*)::DOUBLE, 6) AS {n}_ratio" for n in ("start_station_id", "end_station_id")
    )
    return (
        f"SELECT source_file, {picked}, {ratios} FROM data_v GROUP BY source_file"
        f" UNION ALL SELECT '(all files)', {picked}, {ratios} FROM data_v"
    )


_HEX = "regexp_full_match({}, '[0-9a-f]{{64}}')"
_RECORD_RULES = [
    ("contract_version", "error", "contract_version <> '1.1'"),
    ("snapshot_id", "error", "NOT " + _HEX.format("snapshot_id")),
    ("metadata_version", "error", "NOT " + _HEX.format("metadata_version")),
    ("data_origin", "error", "data_origin NOT IN ('GBFS_LIVE', 'GBFS_REPLAY', 'FIXTURE')"),
    ("record_type", "error", "record_type NOT IN ('station', 'snapshot_end')"),
    ("end_key", "error", "record_type = 'snapshot_end' AND record_key <> '__snapshot_end__'"),
    ("end_count", "error", "record_type = 'snapshot_end' AND (station_count IS NULL OR station_count < 0)"),
    ("station_key", "error", "record_type = 'station' AND (record_key IS NULL OR record_key LIKE '% %' OR length(record_key) > 128)"),
]
_ANY_BAD_RECORD = " OR ".join(f"({cond})" for _, _, cond in _RECORD_RULES)

_LIVE_RULES = [
    ("status", "error", "false"),
    ("reason", "error", "false"),
    ("fill_ratio", "error", "fill_ratio < 0 OR fill_ratio > 1"),
    ("expected", "error", "expected_inbound_1h < 0 OR expected_outbound_1h < 0"),
    ("sample_days", "error", "sample_days < 1"),
    ("snapshot_at", "error", "snapshot_at IS NULL OR expires_at IS NULL"),
    ("position", "error", "abs(lat) > 90 OR abs(lon) > 180 OR capacity < 1"),
    ("classified", "error", "current_status IN ('SHORTAGE_RISK', 'LOW_INVENTORY', 'HEALTHY', 'HIGH_INVENTORY', 'OVERFLOW_RISK') AND fill_ratio IS NULL"),
]
_FLOW_RULES = [
    ("station", "error", "from_station_id IS NULL OR to_station_id IS NULL OR length(from_station_id) = 0 OR length(to_station_id) = 0"),
    ("ride_count", "error", "ride_count IS NULL OR ride_count < 1"),
    ("hour", "error", "hour < 0 OR hour > 23"),
]
_TEXT_RULE = "{0} IS NOT NULL AND (trim({0}) <> {0} OR length({0}) = 0 OR length({0}) > {1})"
_METADATA_RULES = [
    ("provider_station_id", "error", "regexp_matches(provider_station_id, '\\s') OR length(provider_station_id) > 128"),
    ("station_id", "error", "regexp_matches(station_id, '\\s') OR length(station_id) > 128"),
    ("station_name", "error", _TEXT_RULE.format("name", 512)),
    ("region_id", "error", _TEXT_RULE.format("region_id", 128)),
    ("lat", "error", "abs(lat) > 90"),
    ("lon", "error", "abs(lon) > 180"),
    ("capacity", "error", "capacity <= 0"),
]

_SEVERITY = "CASE {0} " + " ".join(
    f"WHEN '{name}' THEN {rank}"
    for rank, name in enumerate(
        "SHORTAGE_RISK OVERFLOW_RISK LOW_INVENTORY HIGH_INVENTORY SERVICE_UNAVAILABLE STALE_DATA INVALID_DATA INSUFFICIENT_DATA HEALTHY".split()
    )
) + " ELSE 99 END"

_AT = f"service_date = DATE '{REPLAY_DATE}'"
_REPLAY_IDS = f"""SELECT station_id FROM flow_v WHERE {_AT} UNION SELECT from_station_id FROM od_v WHERE {_AT} AND hour = {REPLAY_HOUR}
 UNION SELECT to_station_id FROM od_v WHERE {_AT} AND hour = {REPLAY_HOUR}"""
_CAN_DRAW = "(bikes IS NOT NULL AND bikes >= 0 AND " + _USABLE + ")"
_CAN_FORECAST = f"({_CAN_DRAW} AND projected_bikes_1h IS NOT NULL AND forecast_status NOT IN ('SERVICE_UNAVAILABLE', 'STALE_DATA', 'INVALID_DATA', 'INSUFFICIENT_DATA'))"
_FLAT_WARNINGS = """concat_ws(',', CASE WHEN lat IS NOT NULL AND NOT lat BETWEEN -90 AND 90 THEN 'invalid_coordinate:lat' END,
  CASE WHEN lon IS NOT NULL AND NOT lon BETWEEN -180 AND 180 THEN 'invalid_coordinate:lon' END, CASE WHEN capacity <= 0 THEN 'invalid_capacity' END)"""


def _staging():
    zero = lambda name: f"SELECT '{name}' AS check_name, CAST(0 AS BIGINT) AS violations"
    tables = ("dim_station_v1", "dws_station_hourly_flow_v1", "dws_station_hour_profile_v1", "dws_station_od_hourly_v1")
    sound = [f"{t}:{c}" for t in tables for c in ("version", "duplicate_keys")]
    sound += ["flow:bad_rows", "od:not_positive", "profile:sample_days", "profile:not_positive", "flow:incomplete_days"]
    totals = [
        f"SELECT '{name}' AS check_name, count(*) AS violations FROM valid_v"
        for name in ("flow:inbound_total", "flow:outbound_total", "od:ride_total")
    ]
    return " UNION ALL ".join([zero(n) for n in sound] + totals)


def _queries():
    flagged = STEPS["flagged_v"]
    out = {
        "station_hourly_flow": "SELECT * FROM flow_v",
        "station_outbound_split": "SELECT * FROM out_v",
        "station_inbound": "SELECT * FROM in_v",
        "station_hour_profile": "SELECT * FROM profile_v",
        "od_hourly": "SELECT * FROM od_v",
        "od_top20": "SELECT from_station_id, to_station_id, CAST(sum(ride_count) AS BIGINT) AS ride_count FROM od_v GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20",
        "od_top20_per_hour": "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY service_date, hour ORDER BY ride_count DESC, from_station_id, to_station_id) AS INTEGER) AS position FROM od_v) r WHERE position <= 20",
        "od_for_station": f"SELECT * FROM od_v WHERE '{STATION}' IN (from_station_id, to_station_id)",
        "od_display_summary": """SELECT service_date, hour, count(*) AS total, count(*) FILTER (ok) AS shown, CAST(sum(ride_count) AS BIGINT) AS total_rides, CAST(coalesce(sum(ride_count) FILTER (ok), 0) AS BIGINT) AS shown_rides
 FROM (SELECT o.*, EXISTS (SELECT 1 FROM dim_v d WHERE d.station_id = from_station_id AND lat IS NOT NULL AND lon IS NOT NULL) AND EXISTS (SELECT 1 FROM dim_v d WHERE d.station_id = to_station_id AND lat IS NOT NULL AND lon IS NOT NULL) AS ok FROM od_v o) x GROUP BY 1, 2""",
        "od_hidden": """SELECT * FROM od_v WHERE from_station_id NOT IN (SELECT station_id FROM stations_v WHERE lat IS NOT NULL AND lon IS NOT NULL)
 OR to_station_id NOT IN (SELECT station_id FROM stations_v WHERE lat IS NOT NULL AND lon IS NOT NULL)""",
        "od_distance": """SELECT from_station_id, to_station_id, ride_count, round(m, 3) AS distance, CAST(floor(m + 0.5) AS INTEGER) AS distance_meters FROM (
 SELECT from_station_id, to_station_id, ride_count, 12742000 * asin(sqrt(least(1, h))) AS m FROM (SELECT from_station_id, to_station_id, ride_count,
 pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
 FROM (SELECT from_station_id, to_station_id, CAST(sum(ride_count) AS BIGINT) AS ride_count FROM od_v GROUP BY 1, 2) p
 JOIN stations_v a ON a.station_id = from_station_id AND a.lat IS NOT NULL JOIN stations_v b ON b.station_id = to_station_id AND b.lat IS NOT NULL) q) z""",
        "conservation_check": """SELECT (SELECT count(*) FROM dwd_v) AS source, (SELECT count(*) FROM valid_v) AS valid, CAST((SELECT sum(inbound_rides) FROM flow_v) AS BIGINT) AS inbound,
 CAST((SELECT sum(outbound_rides) FROM flow_v) AS BIGINT) AS outbound, CAST((SELECT sum(ride_count) FROM od_v) AS BIGINT) AS od_rides, true AS conserved""",
        "availability": "SELECT service_date, string_agg(CAST(hour AS VARCHAR), ',' ORDER BY hour) AS hours FROM (SELECT DISTINCT service_date, hour FROM flow_v) d GROUP BY 1",
        "dataset_bounds": "SELECT min(service_date) AS min_service_date, max(service_date) AS max_service_date FROM flow_v",
        "next_available_hour": "SELECT a.service_date, a.hour, max(b.hour) FILTER (b.hour < a.hour) AS previous_hour, min(b.hour) FILTER (b.hour > a.hour) AS next_hour FROM (SELECT DISTINCT service_date, hour FROM od_v) a JOIN (SELECT DISTINCT service_date, hour FROM od_v) b USING (service_date) GROUP BY 1, 2",
        "default_selection": "SELECT service_date, min(hour) AS hour FROM od_v WHERE service_date = (SELECT max(service_date) FROM od_v) GROUP BY 1",
        "replay_stations": f"SELECT i.station_id, station_name, lat, lon, capacity, 'NOT_APPLICABLE' AS current_status, 'NOT_APPLICABLE' AS forecast_status FROM ({_REPLAY_IDS}) i LEFT JOIN dim_v d ON d.station_id = i.station_id",
        "replay_map": f"SELECT 'station' AS kind, station_id, NULL::VARCHAR AS to_station_id, NULL::BIGINT AS ride_count FROM ({_REPLAY_IDS}) i UNION ALL SELECT 'flow', from_station_id, to_station_id, ride_count FROM od_v WHERE {_AT} AND hour = {REPLAY_HOUR}",
        "station_history": f"""SELECT coalesce(p.hour, f.hour) AS hour, avg_inbound, avg_outbound, avg_net_flow, median_net_flow, sample_days, {_COUNTS}
 FROM (SELECT * FROM profile_v WHERE station_id = '{STATION}' AND day_of_week = isodow(DATE '{REPLAY_DATE}')) p FULL JOIN (SELECT * FROM flow_v WHERE station_id = '{STATION}' AND {_AT}) f ON p.hour = f.hour""",
        "station_actual_24h": f"SELECT hour, {_COUNTS} FROM flow_v WHERE station_id = '{STATION}' AND {_AT}",
        "station_lookup": """SELECT coalesce(m.station_id, c.station_id) AS station_id, CASE WHEN m.station_id IS NULL THEN c.station_name ELSE m.station_name END AS station_name,
 CASE WHEN m.station_id IS NULL THEN c.lat ELSE m.lat END AS lat, CASE WHEN m.station_id IS NULL THEN c.lon ELSE m.lon END AS lon, CASE WHEN m.station_id IS NULL THEN c.capacity ELSE m.capacity END AS capacity,
 CASE WHEN m.station_id IS NULL THEN 'CURRENT' ELSE 'HISTORICAL' END AS found_in FROM stations_v m FULL JOIN (SELECT * FROM snap_v QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY snapshot_at DESC) = 1) c ON c.station_id = m.station_id""",
        "trip_calendar": """SELECT ride_id, CAST(floor(date_diff('microsecond', started_at_local, ended_at_local) / 1000000.0) AS BIGINT) AS duration_seconds, CAST(started_at_local AS DATE) AS service_date,
 CAST(hour(started_at_local) AS INTEGER) AS start_hour, CAST(isodow(started_at_local) AS INTEGER) AS day_of_week, isodow(started_at_local) > 5 AS is_weekend FROM trips_v""",
        "valid_trips": "SELECT ride_id, is_valid AS is_valid_station_trip FROM dwd_v",
        "timestamp_parse": f"SELECT source_row_number, started_at, try_strptime(started_at, {_FORMATS}) AS started_at_local, try_strptime(ended_at, {_FORMATS}) AS ended_at_local FROM raw_trips_v",
        "time_format_match": f"SELECT source_row_number, {_shape('started_at')} AS pattern FROM raw_trips_v",
        "blank_to_null": "SELECT source_row_number, " + ", ".join(f"CASE WHEN length(trim({n})) > 0 THEN trim({n}) END AS {n}" for n in ("start_station_id", "end_station_id", "start_station_name", "end_station_name")) + " FROM raw_trips_v",
        "safe_coordinate": "SELECT source_row_number, " + ", ".join(f"{_coord(n, lim)} AS {n}" for n, lim in _COORDS.items()) + " FROM raw_trips_v",
        "contract_types": "SELECT source_row_number, " + ", ".join(f"TRY_CAST({n} AS DOUBLE) AS {n}, {n} AS raw_{n}" for n in _COORDS) + " FROM data_v",
        "header_row_removal": "SELECT source_file, count(*) AS data_rows FROM data_v GROUP BY 1",
        "unknown_enum": "SELECT 'rideable_type' AS field, trim(rideable_type) AS value, count(*) AS row_count FROM data_v WHERE trim(rideable_type) NOT IN ('', 'classic_bike', 'electric_bike') GROUP BY 2 UNION ALL SELECT 'member_casual', trim(member_casual), count(*) FROM data_v WHERE trim(member_casual) NOT IN ('', 'member', 'casual') GROUP BY 2",
        "decimal_like_ids": "SELECT source_row_number, coalesce(regexp_full_match(trim(start_station_id), '[+-]?\\d+\\.\\d+'), false) AS decimal_like FROM data_v",
        "gate_rejections": f"SELECT source_row_number, CASE WHEN {_blank('rideable_type')} OR {_blank('started_at')} OR {_blank('ended_at')} THEN 'BLANK_REQUIRED_FIELD' ELSE 'UNPARSED_TIME' END AS gate_reason FROM typed_v WHERE {_blank('rideable_type')} OR started_at_local IS NULL OR ended_at_local IS NULL",
        "dwd_trips": sql(
            f"""SELECT ride_id, rideable_type, started_at_local, ended_at_local, duration_seconds, start_station_id, start_station_name, start_lat, start_lng, end_station_id, end_station_name, end_lat, end_lng, member_casual,
 CAST(started_at_local AS DATE) AS service_date, CAST(hour(started_at_local) AS INTEGER) AS start_hour, CAST(isodow(started_at_local) AS INTEGER) AS day_of_week, isodow(started_at_local) > 5 AS is_weekend,
 '{DATASET}' AS ingest_batch_id, source_file, source_row_number, is_duplicate_ride, is_valid_station_trip, source_year, source_month FROM dwd_flags""",
            dwd_flags=flagged.replace("SRC", "typed_v"),
        ),
        "quality_summary": sql(
            """SELECT count(*) AS dwd, count(*) FILTER (is_valid_station_trip) AS valid, count(*) FILTER (NOT is_valid_station_trip) AS invalid, count(*) FILTER (is_duplicate_ride) AS duplicate,
 count(*) - count(start_station_id) AS missing_start_station, count(*) - count(end_station_id) AS missing_end_station, count(*) FILTER (start_lat IS NULL OR start_lng IS NULL) AS missing_or_invalid_start_coordinate,
 count(*) FILTER (end_lat IS NULL OR end_lng IS NULL) AS missing_or_invalid_end_coordinate, count(*) FILTER (duration_seconds <= 0) AS non_positive_duration FROM sum_flags""",
            sum_flags=flagged.replace("SRC", "typed_v"),
        ),
        "dedup_flags": "SELECT ride_id, l_shipdate, l_partkey, l_suppkey, row_number() OVER (PARTITION BY ride_id ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, content) > 1 AS is_duplicate FROM dup_v",
        "dedup_conflicts": """SELECT count(*) FILTER (rn > 1) AS duplicates, count(*) FILTER (rn > 1 AND content <> winner) AS duplicate_conflict FROM (SELECT *, row_number() OVER w AS rn, first_value(content) OVER w AS winner FROM dup_v
 WINDOW w AS (PARTITION BY ride_id ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)) d""",
        "row_signatures": "SELECT copies, count(*) AS contents FROM (SELECT count(*) AS copies FROM dup_v GROUP BY l_shipdate, l_suppkey, content) c GROUP BY 1",
        "duplicate_key_groups": "SELECT count(*) AS duplicate_key_groups FROM (SELECT ride_id FROM dup_v GROUP BY 1 HAVING count(*) > 1) g",
        "duplicate_row_counts": "SELECT count(*) - count(DISTINCT ride_id) AS duplicate_row_count, (SELECT count(*) FROM (SELECT ride_id FROM dup_v GROUP BY 1 HAVING count(*) > 1) g) AS duplicate_value_count FROM dup_v",
        "partition_counts": "SELECT source_year, source_month, source_file, count(*) AS ride_count, count(*) FILTER (ride_id = 'ride_id' AND rideable_type = 'rideable_type' AND started_at = 'started_at') AS csv_header_rows FROM raw_trips_v GROUP BY 1, 2, 3",
        "source_profile_rollup": _source_profile(),
        "time_format_counts": " UNION ALL ".join(f"SELECT source_file, '{n}' AS field, {_shape(f'trim({n})')} AS pattern, count(*) AS row_count FROM data_v GROUP BY 1, 3 HAVING pattern IS NOT NULL" for n in ("started_at", "ended_at")),
        "gate_metrics": _gate_metrics(),
        "gate_ranges": """SELECT min(started_at_local) AS min_started_at, max(started_at_local) AS max_started_at, CAST(min(hour(started_at_local)) AS INTEGER) AS min_start_hour, CAST(max(hour(started_at_local)) AS INTEGER) AS max_start_hour,
 CAST(min(isodow(started_at_local)) AS INTEGER) AS min_day_of_week, CAST(max(isodow(started_at_local)) AS INTEGER) AS max_day_of_week FROM typed_v""",
        "gate_verdict": f"""SELECT CASE WHEN sum(b) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, CAST(sum(b) AS BIGINT) AS blocking_metrics FROM (SELECT CASE WHEN value > 0 AND metric IN ('null_ride_id', 'null_rideable_type', 'null_started_at', 'null_ended_at', 'null_member_casual', 'invalid_started_at', 'invalid_ended_at') THEN 1 ELSE 0 END AS b FROM ({_gate_metrics()}) m) v""",
        "distinct_examples": " UNION ALL ".join(f"SELECT '{n}' AS field, {n} AS value, CAST(position AS INTEGER) AS position FROM (SELECT {n}, dense_rank() OVER (ORDER BY {n}) AS position FROM (SELECT DISTINCT {n} FROM data_v WHERE NOT {_blank(n)}) d) r WHERE position <= 10" for n in ("rideable_type", "member_casual", "start_station_id", "end_station_id")),
        "count_reconciliation": f"""SELECT *, CASE WHEN (source IS NULL)::INT + (hive IS NULL)::INT + (spark IS NULL)::INT > 1 THEN 'NOT_RUN' WHEN coalesce(source, hive) <> hive OR hive <> spark THEN 'FAIL' WHEN source IS NULL THEN 'PARTIAL' ELSE 'PASS' END AS status
 FROM (SELECT source_file, CASE WHEN source_file <> 'part-2.csv' THEN count(*) END AS source, count(*) FILTER (ride_id <> 'ride_id') AS hive, count(try_strptime(started_at, {_FORMATS})) AS spark FROM raw_trips_v GROUP BY 1) c""",
        "trip_rule_report": _report("data_v", _TRIP_RULES),
        "trip_rule_verdict": f"SELECT CASE WHEN count(*) FILTER (severity = 'error' AND violations > 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status, count(*) FILTER (severity = 'error' AND violations > 0) AS errors, count(*) FILTER (severity = 'warning' AND violations > 0) AS warnings FROM ({_report('data_v', _TRIP_RULES)}) r",
        "trip_rule_violations": _violations("data_v", "source_row_number", _TRIP_RULES),
        "endpoint_candidates": "SELECT * FROM ends_v",
        "station_latest_attributes": "SELECT * FROM latest_v",
        "station_dim": "SELECT * FROM dim_v",
        "metadata_hits": "SELECT count(DISTINCT station_id) AS historical_ids, count(DISTINCT station_id) FILTER (station_id IN (SELECT station_id FROM stations_v)) AS matched_ids FROM ends_v",
        "canonical_mapping": "SELECT provider_station_id, station_id, mapping_status, mapping_reason FROM map_v",
        "canonical_collisions": sql("SELECT station_id, count(*) AS claims FROM twice_map GROUP BY 1 HAVING count(*) > 1", twice_map=STEPS["map_v"].replace("information_v", "twice_v"),
            twice_v="SELECT * FROM information_v UNION ALL SELECT * REPLACE (NULL AS short_name) FROM information_v WHERE provider_station_id LIKE '%5'"),
        "safe_station_fields": f"""SELECT provider_station_id, nullif(trim(name), '') AS station_name, CASE WHEN lat BETWEEN -90 AND 90 THEN lat END AS lat, CASE WHEN lon BETWEEN -180 AND 180 THEN lon END AS lon,
 CASE WHEN capacity > 0 THEN capacity END AS capacity, nullif(trim(region_id), '') AS region_id, {_FLAT_WARNINGS} AS warnings FROM information_v""",
        "missing_metadata_placeholders": f"SELECT DISTINCT provider_station_id, 'gbfs:' || provider_station_id AS station_id, 'ISOLATED' AS mapping_status, 'MISSING_METADATA' AS mapping_reason, TIMESTAMP '{BUILT_AT}' AS metadata_updated_at FROM feed_v WHERE provider_station_id NOT IN (SELECT provider_station_id FROM stations_v)",
        "canonical_events": "SELECT s.station_id, s.station_id IS NOT NULL AS mapped, count(*) AS events, CAST(sum(bikes) AS BIGINT) AS bikes FROM feed_v f LEFT JOIN stations_v s USING (provider_station_id) GROUP BY 1, 2",
        "metadata_rule_violations": _violations("map_v", "provider_station_id", _METADATA_RULES),
        "current_status": sql("SELECT event_id, current_status, current_reason, fill_ratio, expires_at FROM all_status", all_status=_status_of("obs_v")),
        "fill_class": f"SELECT event_id, {_classify('value / 100')} AS fill_class FROM events",
        "observation_expiry": "SELECT event_id, least(snapshot_at, last_reported_at) AS observed_at, least(snapshot_at, last_reported_at) + INTERVAL 3 MINUTE AS expires_at FROM obs_v",
        "forecast_risk": f"SELECT {_RISK} FROM risk_v",
        "read_expiry_mask": f"SELECT {_RISK} FROM ({_masked('risk_v', 'as_of + INTERVAL 60 SECOND >= expires_at')}) z",
        "no_baseline_mask": f"""SELECT snapshot_at, station_id, current_status, current_reason, CASE WHEN n AND current_reason IS NULL THEN 'INSUFFICIENT_DATA' ELSE forecast_status END AS forecast_status,
 CASE WHEN n AND current_reason IS NULL THEN 'NO_BASELINE' ELSE forecast_reason END AS forecast_reason, fill_ratio, {", ".join(f"CASE WHEN NOT n THEN {c} END AS {c}" for c in _EXPECT.split(", "))}, expires_at FROM (SELECT *, hour(snapshot_at) % 2 = 0 AS n FROM risk_v) z""",
        "live_map": f"SELECT {_RISK}, station_name, lat, lon, capacity, bikes, docks FROM ({_masked('risk_v', 'as_of + INTERVAL 100 SECOND >= expires_at OR as_of + INTERVAL 100 SECOND >= snapshot_at + INTERVAL 180 SECOND')}) z",
        "status_histogram": "SELECT snapshot_at, current_status, count(*) AS stations FROM status_v GROUP BY 1, 2",
        "fleet_kpis": """SELECT snapshot_at, count(*) AS stations, count(*) FILTER (current_reason IS NULL) AS active_stations, CAST(coalesce(sum(bikes) FILTER (current_reason IS NULL), 0) AS BIGINT) AS bikes,
 CAST(coalesce(sum(docks) FILTER (current_reason IS NULL), 0) AS BIGINT) AS docks, count(*) FILTER (current_status IN ('SHORTAGE_RISK', 'LOW_INVENTORY')) AS shortage_stations,
 count(*) FILTER (current_status IN ('OVERFLOW_RISK', 'HIGH_INVENTORY')) AS overflow_stations FROM status_v GROUP BY 1""",
        "risk_ranking": f"SELECT snapshot_at, station_id, forecast_status, CAST({_SEVERITY.format('forecast_status')} AS INTEGER) AS severity, forecast_status <> 'HEALTHY' AS in_traversal FROM risk_v",
        "risk_bucket": """SELECT snapshot_at, station_id, current_status IN ('SHORTAGE_RISK', 'LOW_INVENTORY') AS shortage, current_status IN ('OVERFLOW_RISK', 'HIGH_INVENTORY') AS "full",
 current_status IN ('STALE_DATA', 'SERVICE_UNAVAILABLE', 'INVALID_DATA', 'INSUFFICIENT_DATA') AS issue FROM status_v""",
        "station_search": "SELECT snapshot_at, station_id, current_status FROM status_v WHERE current_status IN ('SHORTAGE_RISK', 'LOW_INVENTORY') AND (station_name || ' ' || station_id) ILIKE '%stn 4%'",
        "drawable_flags": f"SELECT snapshot_at, station_id, coalesce({_CAN_DRAW}, false) AS can_draw, coalesce({_CAN_FORECAST}, false) AS can_forecast, coalesce({_CAN_FORECAST} AND capacity > 0 AND lat IS NOT NULL AND lon IS NOT NULL, false) AS can_dispatch FROM risk_v",
        "station_page": f"SELECT CAST({_SEVERITY.format('current_status')} AS INTEGER) AS severity, station_id, snapshot_at, current_status FROM status_v ORDER BY 1, 2, 3 LIMIT 50 OFFSET 50",
        "sample_rows": "SELECT ride_id, source_row_number, start_station_id, end_station_id FROM trips_v ORDER BY CASE ride_id WHEN 'R77' THEN 1 WHEN 'R5' THEN 2 ELSE 3 END, source_row_number LIMIT 10",
        "rebalance_inputs": "SELECT * FROM role_v",
        "rebalance_target_order": "SELECT snapshot_at, station_id, need, CAST(row_number() OVER (PARTITION BY snapshot_at ORDER BY need DESC, station_id) AS INTEGER) AS target_rank FROM role_v WHERE role = 'target'",
        "rebalance_invariants": """SELECT 'positive_move' AS rule, count(*) AS violations FROM (SELECT 1 FROM bad_v GROUP BY snapshot_at, from_station_id, to_station_id HAVING min(move_bikes) <= 0) a
 UNION ALL SELECT 'unique_pair', count(*) FROM (SELECT 1 FROM bad_v GROUP BY snapshot_at, from_station_id, to_station_id HAVING count(*) > 1) b
 UNION ALL SELECT 'source_limit', count(*) FROM (SELECT snapshot_at, from_station_id AS s, sum(move_bikes) AS m FROM bad_v GROUP BY 1, 2) c LEFT JOIN active_v a ON a.snapshot_at = c.snapshot_at AND station_id = s AND role = 'source' WHERE room IS NULL OR m > room
 UNION ALL SELECT 'target_limit', count(*) FROM (SELECT snapshot_at, to_station_id AS s, sum(move_bikes) AS m FROM bad_v GROUP BY 1, 2) c LEFT JOIN active_v a ON a.snapshot_at = c.snapshot_at AND station_id = s AND role = 'target' WHERE room IS NULL OR m > room
 UNION ALL SELECT 'priority_sequence', (SELECT count(*) FROM (SELECT 1 FROM bad_v GROUP BY snapshot_at, priority HAVING count(*) > 1) d) + (SELECT count(*) FROM (SELECT 1 FROM bad_v GROUP BY snapshot_at HAVING min(priority) <> 1 OR max(priority) <> count(*)) e)""",
        "rebalance_suggestions": "SELECT * FROM moves_v",
        "live_suggestions": """SELECT m.*, c.read_at FROM moves_v m JOIN (SELECT snapshot_at, min(as_of + INTERVAL 60 SECOND) AS read_at FROM risk_v GROUP BY 1) c ON c.snapshot_at = m.snapshot_at
 WHERE m.expires_at > c.read_at AND EXISTS (SELECT 1 FROM open_v o WHERE o.snapshot_at = m.snapshot_at AND o.station_id = m.from_station_id) AND EXISTS (SELECT 1 FROM open_v o WHERE o.snapshot_at = m.snapshot_at AND o.station_id = m.to_station_id)""",
        "usable_suggestions": """SELECT m.* FROM moves_v m WHERE m.expires_at > TIMESTAMP '2024-01-15 12:00:00'
 AND EXISTS (SELECT 1 FROM dispatch_v o WHERE o.snapshot_at = m.snapshot_at AND o.station_id = m.from_station_id) AND EXISTS (SELECT 1 FROM dispatch_v o WHERE o.snapshot_at = m.snapshot_at AND o.station_id = m.to_station_id)""",
        "snapshot_station_counts": "SELECT snapshot_at, count(DISTINCT station_id) AS stations FROM obs_v GROUP BY 1",
        "batch_integrity": f"""SELECT *, CASE WHEN reason IS NULL THEN 'COMPLETE' ELSE 'REJECTED' END AS verdict FROM (SELECT snapshot_id, header_sets, invalid_rows, end_rows, stations, station_rows, announced,
 CASE WHEN invalid_rows > 0 THEN 'INVALID_RECORD' WHEN header_sets > 1 THEN 'MIXED_HEADERS' WHEN end_rows <> 1 THEN 'END_MARKER' WHEN stations <> station_rows THEN 'DUPLICATE_STATION'
  WHEN announced IS DISTINCT FROM stations THEN 'COUNT_MISMATCH' WHEN times > 1 THEN 'TIME_MISMATCH' END AS reason FROM (SELECT snapshot_id, count(DISTINCT metadata_version || data_origin || contract_version) AS header_sets,
 count(*) FILTER ({_ANY_BAD_RECORD}) AS invalid_rows, count(*) FILTER (record_type = 'snapshot_end') AS end_rows, count(DISTINCT metadata_version || data_origin || contract_version || record_key) FILTER (record_type = 'station') AS stations,
 count(*) FILTER (record_type = 'station') AS station_rows, max(station_count) AS announced, count(DISTINCT CAST(snapshot_at AS VARCHAR) || CAST(ingested_at AS VARCHAR)) AS times FROM records_v GROUP BY 1) a) b""",
        "batch_clock": "SELECT event_id, CASE WHEN data_origin IN ('GBFS_REPLAY', 'FIXTURE') THEN 'recorded' ELSE 'wall' END AS clock_mode, CASE WHEN data_origin IN ('GBFS_REPLAY', 'FIXTURE') THEN ingested_at ELSE received_at END AS as_of FROM records_v",
        "origin_gate": "SELECT event_id, CASE WHEN data_origin <> 'GBFS_LIVE' THEN 'INVALID_ORIGIN_FOR_MODE' END AS gate_reason FROM records_v",
        "record_rule_report": _report("records_v", _RECORD_RULES),
        "gate_verdicts": _GATE,
        "snapshot_dedup": """SELECT attempt, provider_time, CASE WHEN attempt = first_sent THEN 'PUBLISHED' WHEN first_sent IS NULL OR attempt < first_sent THEN 'FAILED_SEND' WHEN status_raw_sha256 = winner THEN 'SKIPPED_DUPLICATE' ELSE 'REJECTED_CONFLICT' END AS state
 FROM (SELECT *, min(attempt) FILTER (status <> 'FAILED_SEND') OVER w AS first_sent, arg_min(status_raw_sha256, attempt) FILTER (status <> 'FAILED_SEND') OVER w AS winner FROM attempts_v WINDOW w AS (PARTITION BY provider_time)) d""",
        "pending_failures": """SELECT f.snapshot_id, max(f.attempt) AS failed_at, (SELECT max(attempt) FROM attempts_v r WHERE r.snapshot_id = f.snapshot_id AND status IN ('PUBLISHED', 'SKIPPED_DUPLICATE', 'REJECTED_CONFLICT')) AS resolved_at
 FROM attempts_v f WHERE status = 'FAILED_SEND' AND NOT EXISTS (SELECT 1 FROM attempts_v r WHERE r.snapshot_id = f.snapshot_id AND r.attempt > f.attempt AND status IN ('PUBLISHED', 'SKIPPED_DUPLICATE', 'REJECTED_CONFLICT')) GROUP BY f.snapshot_id""",
        "collection_log_counters": """SELECT data_origin, count(*) AS attempts, count(*) FILTER (status IN ('FAILED_SEND', 'FAILED_COLLECTION', 'REJECTED_CONFLICT')) AS failed_batches, count(*) FILTER (status = 'SKIPPED_DUPLICATE') AS duplicates,
 count(*) FILTER (status = 'REJECTED_CONFLICT') AS conflicts, count(*) FILTER (status IN ('PUBLISHED', 'SKIPPED_DUPLICATE')) AS complete_batches, CAST(sum(mapped_count) AS BIGINT) AS mapping_success, CAST(sum(isolated_count) AS BIGINT) AS mapping_isolated FROM attempts_v GROUP BY 1""",
        "latest_live_metadata": "SELECT metadata_version, attempt FROM attempts_v WHERE status = 'PUBLISHED' AND data_origin = 'GBFS_LIVE' ORDER BY attempt DESC LIMIT 1",
        "feed_events": """SELECT event_id, provider_station_id, last_updated AS snapshot_posix, timezone('America/New_York', to_timestamp(last_updated)) AS snapshot_at_local, last_reported AS reported_posix,
 CAST(bikes AS INTEGER) AS num_bikes_available, CAST(docks AS INTEGER) AS num_docks_available, CAST(bikes_disabled AS INTEGER) AS num_bikes_disabled, installed_flag = 1 AS is_installed, true AS is_renting, true AS is_returning, '2.3' AS source_version FROM feed_v""",
        "feed_rule_report": _report(
            "feed_v",
            [(n, "error", "false") for n in ("station_id", "num_bikes_available", "num_bikes_disabled", "num_docks_available", "num_docks_disabled", "is_installed", "is_renting", "is_returning")]
            + [("last_reported", "error", "last_reported IS NULL"), ("vehicle_types_available", "error", "false"), ("vehicle_type_entry", "error", "false")]
            + [("negative_num_bikes_available", "warning", "bikes < 0"), ("negative_num_bikes_disabled", "warning", "bikes_disabled < 0"), ("negative_num_docks_available", "warning", "docks < 0"), ("negative_num_docks_disabled", "warning", "false")],
        ),
        "vehicle_count_mismatch": """SELECT provider_station_id, 'vehicle_count_mismatch' AS warning, 'num_bikes_available' AS field, count(*) AS rows, CAST(sum(bikes) AS BIGINT) AS value, CAST(sum(ebikes + 2) AS BIGINT) AS expected FROM feed_v WHERE bikes <> ebikes + 2 GROUP BY 1
 UNION ALL SELECT provider_station_id, 'negative_inventory', 'num_bikes_available', count(*), CAST(sum(bikes) AS BIGINT), NULL FROM feed_v WHERE bikes < 0 GROUP BY 1
 UNION ALL SELECT provider_station_id, 'negative_inventory', 'num_bikes_disabled', count(*), CAST(sum(bikes_disabled) AS BIGINT), NULL FROM feed_v WHERE bikes_disabled < 0 GROUP BY 1
 UNION ALL SELECT provider_station_id, 'negative_inventory', 'num_docks_available', count(*), CAST(sum(docks) AS BIGINT), NULL FROM feed_v WHERE docks < 0 GROUP BY 1""",
        "staging_checks": _staging(),
        "profile_flow_mismatch": """SELECT coalesce(e.station_id, p.station_id) AS station_id, coalesce(e.day_of_week, p.day_of_week) AS day_of_week, coalesce(e.hour, p.hour) AS hour, e.expected_days, p.sample_days
 FROM (SELECT station_id, CAST(isodow(service_date) AS INTEGER) AS day_of_week, hour, count(DISTINCT service_date) AS expected_days FROM sparse_v GROUP BY 1, 2, 3) e
 FULL JOIN base_v p ON p.station_id = e.station_id AND p.day_of_week = e.day_of_week AND p.hour = e.hour WHERE e.expected_days IS DISTINCT FROM p.sample_days""",
        "incomplete_days": "SELECT station_id, service_date, count(*) AS rows, CAST(sum(total_activity) AS BIGINT) AS activity FROM sparse_v GROUP BY 1, 2 HAVING count(DISTINCT hour) <> 24",
        "response_invariants": f"SELECT *, 'live' AS part FROM ({_report('shown_v', _LIVE_RULES)}) l UNION ALL SELECT *, 'flow' AS part FROM ({_report('od_v', _FLOW_RULES)}) f",
        "unlisted_endpoints": "SELECT service_date, hour, from_station_id, to_station_id FROM od_v WHERE from_station_id NOT IN (SELECT station_id FROM stations_v) OR to_station_id NOT IN (SELECT station_id FROM stations_v)",
        "version_hashes": "SELECT event_id, sha256(props) AS metadata_version, sha256(event_type || chr(10) || sha256(props)) AS snapshot_id FROM events",
        "dataset_versions": """SELECT event_type, sha256('1.1' || chr(10) || sha256(event_type) || chr(10) || string_agg(d || ':' || sha256(d) || chr(10), '' ORDER BY d)) AS dataset_id
 FROM (SELECT DISTINCT event_type, strftime(ts, '%Y-%m-%d') AS d FROM events) m GROUP BY 1""",
        "serving_projection": """SELECT station_id || chr(9) || coalesce(station_name || ' x  y"', '<null>') || chr(9) || coalesce(CAST(capacity AS VARCHAR), '<null>') || chr(9) || coalesce(region_id, '<null>') || chr(9) || '1' || chr(9) || 'GBFS' || chr(9) || '2024-02-01 00:00:00.000000' AS value FROM stations_v""",
    }
    out["serving_projection"] = out["serving_projection"].replace("x  y\"", "x  y\\\"")
    steps = {
        "shown_v": _masked("risk_v", "as_of >= expires_at"),
        "bad_v": """SELECT snapshot_at, from_station_id, to_station_id, move_bikes, priority FROM moves_v UNION ALL
  SELECT snapshot_at, from_station_id, to_station_id, CASE WHEN priority = 1 THEN 1000 ELSE -1 END, priority FROM moves_v WHERE priority <= 2""",
        "open_v": f"SELECT snapshot_at, station_id FROM ({_masked('risk_v', 'as_of + INTERVAL 60 SECOND >= expires_at')}) z WHERE {_USABLE}",
        "dispatch_v": f"SELECT snapshot_at, station_id FROM risk_v WHERE {_CAN_FORECAST} AND capacity > 0 AND lat IS NOT NULL AND lon IS NOT NULL",
    }
    return {name: body if body.startswith("WITH") else sql(body, **steps) for name, body in out.items()}


ORACLE_SQL = _queries()
