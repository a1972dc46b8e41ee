"""Input views over the driver's tables.

The driver's tables hold no bike trips, so every registered query reads a view
derived row by row from them: no shuffle, no window and no subset. Each view is
one SQL text used for Spark (`spark_view`) and for the oracle (`CTES`), and only
prepares input; the operators themselves are written twice, independently.
`STR`, `TS` and `SHA … END` stand for the engines' spellings.
"""

VIEWS = {
    # Trips with known, unknown and missing types, stations and non-positive durations.
    "trips_v": """
SELECT 'R' || CAST(event_id AS {STR}) AS ride_id,
  CASE event_type WHEN 'view' THEN 'electric_bike' WHEN 'click' THEN 'classic_bike' ELSE event_type END AS rideable_type,
  CASE WHEN user_id % 10 < 6 THEN 'member' WHEN user_id % 10 < 9 THEN 'casual' ELSE 'guest' END AS member_casual,
  ts AS started_at_local,
  CASE WHEN event_id % 67 = 0 THEN NULL WHEN event_id % 61 = 0 THEN ts
       ELSE ts + INTERVAL 1 SECOND * CAST(floor(value * 60) AS INTEGER) END AS ended_at_local,
  CASE WHEN event_id % 53 = 0 THEN NULL ELSE 'S' || CAST(k AS {STR}) END AS start_station_id,
  CASE WHEN event_id % 47 = 0 THEN NULL ELSE 'S' || CAST((k * 7 + user_id * 3) % 100 AS {STR}) END AS end_station_id,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'Stn ' || CAST(k AS {STR}) || ' v' || CAST(event_id % 5 AS {STR}) END AS start_station_name,
  CASE WHEN event_id % 3 = 1 THEN NULL ELSE 'Stn ' || CAST((k * 7 + user_id * 3) % 100 AS {STR}) || ' w' || CAST(event_id % 4 AS {STR}) END AS end_station_name,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 4.06e1 + k * 1e-2 + value * 1e-6 END AS start_lat,
  CASE WHEN event_id % 4 = 1 THEN NULL ELSE -7.4e1 + k * 1e-2 + value * 1e-6 END AS start_lng,
  CASE WHEN event_id % 4 = 2 THEN NULL ELSE 4.06e1 + ((k * 7 + user_id * 3) % 100) * 1e-2 + value * 1e-6 END AS end_lat,
  CASE WHEN event_id % 4 = 3 THEN NULL ELSE -7.4e1 + ((k * 7 + user_id * 3) % 100) * 1e-2 + value * 1e-6 END AS end_lng,
  'part-' || CAST(event_id % 3 AS {STR}) || '.csv' AS source_file, event_id AS source_row_number,
  CAST(2024 AS INTEGER) AS source_year, CAST(1 AS INTEGER) AS source_month
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events) e
""",
    # The same trips as raw text: six time formats, offsets, blanks, junk coordinates,
    # padded and decimal-looking identifiers, repeated ride ids and header records.
    "raw_trips_v": """
SELECT CASE WHEN h THEN 'ride_id' WHEN event_id % 20 = 7 THEN 'R' || CAST(event_id - 7 AS {STR}) ELSE 'R' || CAST(event_id AS {STR}) END AS ride_id,
  CASE WHEN h THEN 'rideable_type' WHEN event_type = 'view' THEN 'electric_bike' WHEN event_type = 'click' THEN 'classic_bike'
       WHEN event_type = 'error' AND event_id % 9 = 0 THEN ' ' ELSE event_type END AS rideable_type,
  CASE WHEN h THEN 'started_at' WHEN f = 0 THEN m || ' ' || c WHEN f = 1 THEN m || ' ' || substr(c, 1, 8) WHEN f = 2 THEN d || ' ' || c
       WHEN f = 3 THEN d || ' ' || substr(c, 1, 8) WHEN f = 4 THEN d || 'T' || c WHEN f = 5 THEN d || 'T' || substr(c, 1, 8)
       WHEN f = 6 AND event_id % 11 = 0 THEN d || ' ' || substr(c, 1, 8) || '+00:00' WHEN f = 7 AND event_id % 13 = 0 THEN ' '
       WHEN f = 7 AND event_id % 17 = 0 THEN 'not a time' WHEN f = 7 AND event_id % 19 = 0 THEN d || ' 25:00:00' ELSE d || ' ' || c END AS started_at,
  CASE WHEN h THEN 'ended_at' WHEN event_id % 97 = 0 THEN NULL ELSE e END AS ended_at,
  CASE WHEN h THEN 'start_station_name' WHEN event_id % 3 = 0 THEN '' ELSE ' Stn ' || CAST(k AS {STR}) || ' ' END AS start_station_name,
  CASE WHEN h THEN 'start_station_id' WHEN event_id % 53 = 0 THEN '  ' WHEN event_id % 3 = 0 THEN ' ' || CAST(k AS {STR}) || '.05 ' ELSE 'S' || CAST(k AS {STR}) END AS start_station_id,
  CASE WHEN h THEN 'end_station_name' WHEN event_id % 3 = 1 THEN NULL ELSE 'Stn ' || CAST((k * 7 + user_id * 3) % 100 AS {STR}) END AS end_station_name,
  CASE WHEN h THEN 'end_station_id' WHEN event_id % 47 = 0 THEN NULL ELSE 'S' || CAST((k * 7 + user_id * 3) % 100 AS {STR}) END AS end_station_id,
  CASE WHEN h THEN 'start_lat' WHEN event_id % 23 = 0 THEN 'NaN' WHEN event_id % 29 = 0 THEN 'abc' WHEN event_id % 31 = 0 THEN '95.5' WHEN event_id % 37 = 0 THEN ' ' ELSE '40.' || CAST(600 + k AS {STR}) END AS start_lat,
  CASE WHEN h THEN 'start_lng' WHEN event_id % 31 = 1 THEN '-181' WHEN event_id % 37 = 1 THEN 'Infinity' ELSE '-73.' || CAST(900 - k AS {STR}) END AS start_lng,
  CASE WHEN h THEN 'end_lat' WHEN event_id % 41 = 0 THEN '' WHEN event_id % 43 = 0 THEN '90' ELSE '40.' || CAST(500 + k AS {STR}) END AS end_lat,
  CASE WHEN h THEN 'end_lng' WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 1 THEN '-180.0' ELSE '-73.' || CAST(800 - k AS {STR}) END AS end_lng,
  CASE WHEN h THEN 'member_casual' WHEN user_id % 10 < 6 THEN 'member' WHEN user_id % 10 < 9 THEN 'casual' ELSE 'guest' END AS member_casual,
  'part-' || CAST(event_id % 3 AS {STR}) || '.csv' AS source_file, event_id AS source_row_number,
  CAST(2024 AS INTEGER) AS source_year, CAST(1 AS INTEGER) AS source_month
FROM (SELECT event_id, event_type, user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k, event_id % 8 AS f, event_id % 401 = 400 AS h,
        substr(CAST(ts AS {STR}), 1, 10) AS d, substr(CAST(ts AS {STR}), 12) AS c,
        substr(CAST(ts AS {STR}), 6, 2) || '/' || substr(CAST(ts AS {STR}), 9, 2) || '/' || substr(CAST(ts AS {STR}), 1, 4) AS m,
        CAST(ts + INTERVAL 1 SECOND * CAST(floor(value * 60) - 90 AS INTEGER) AS {STR}) AS e FROM events) r
""",
    # Rows with real repeated keys and a coarse content column, so repeats both agree and conflict.
    "dup_v": """
SELECT CAST(l_orderkey AS {STR}) || '-' || CAST(l_linenumber AS {STR}) AS ride_id, l_shipdate, l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag || l_linestatus AS content
FROM lineitem
""",
    # Canonical station metadata; starts at S20 so that both sides of the station join miss rows.
    "stations_v": """
SELECT 'u-' || CAST(s_suppkey AS {STR}) AS provider_station_id, 'S' || CAST(s_suppkey + 20 AS {STR}) AS station_id,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE s_name END AS station_name,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 4.06e1 + ((s_suppkey + 20) % 100) * 1e-2 + s_suppkey * s_suppkey * 1e-8 END AS lat,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE -7.4e1 + ((s_suppkey + 20) % 100) * 3e-3 + s_suppkey * s_suppkey * 1e-8 END AS lon,
  CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(20 + s_suppkey % 40 AS INTEGER) END AS capacity,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'N' || CAST(s_nationkey AS {STR}) END AS region_id,
  true AS is_current, 'GBFS' AS metadata_source, CAST('2024-02-01 00:00:00' AS {TS}) AS metadata_updated_at
FROM supplier
""",
    # Provider station rows with blank, shared and padded short names and bad attributes.
    "information_v": """
SELECT 'u-' || CAST(s_suppkey AS {STR}) AS provider_station_id,
  CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN '  ' WHEN s_suppkey % 8 = 0 THEN 'N' || CAST(s_nationkey AS {STR})
       WHEN s_suppkey % 3 = 0 THEN ' S' || CAST(s_suppkey AS {STR}) || ' ' ELSE 'S' || CAST(s_suppkey AS {STR}) END AS short_name,
  CASE WHEN s_suppkey % 6 = 0 THEN '  ' ELSE ' ' || s_name || ' ' END AS name,
  CASE WHEN s_suppkey % 17 = 0 THEN NULL WHEN s_suppkey % 10 = 0 THEN 9.5e1 ELSE 4.06e1 + s_suppkey * 1e-4 END AS lat,
  CASE WHEN s_suppkey % 19 = 0 THEN -1.805e2 ELSE -7.4e1 + s_suppkey * 1e-4 END AS lon,
  CASE WHEN s_suppkey % 9 = 0 THEN CAST(0 AS INTEGER) WHEN s_suppkey % 14 = 0 THEN NULL ELSE CAST(20 + s_suppkey % 40 AS INTEGER) END AS capacity,
  CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE ' R' || CAST(s_nationkey AS {STR}) END AS region_id
FROM supplier
""",
    # One station observation per event; covers every row of the status ladder.
    "obs_v": """
SELECT event_id, 'S' || CAST(k AS {STR}) AS station_id, s AS snapshot_at,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN s + INTERVAL 5 MINUTES ELSE s - INTERVAL 30 SECONDS END AS last_reported_at,
  s + CASE WHEN event_id % 5 = 0 THEN INTERVAL 200 SECONDS WHEN event_id % 5 = 1 THEN INTERVAL 150 SECONDS ELSE INTERVAL 20 SECONDS END AS as_of,
  v % 45 - 2 AS bikes,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN v % 45 = 2 THEN 0 ELSE 40 - v % 40 END AS docks,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type <> 'error' END AS is_installed,
  true AS is_renting, CASE WHEN event_id % 59 = 0 THEN false ELSE true END AS is_returning,
  CASE WHEN k % 25 = 24 THEN NULL ELSE CAST(40 AS INTEGER) END AS capacity, 'Stn ' || CAST(k AS {STR}) AS station_name,
  CASE WHEN k % 30 = 29 THEN NULL ELSE 4.06e1 + floor(k / 1e1) * 1e-2 + k * k * 1.3e-6 END AS lat,
  -7.4e1 + (k % 10) * 1e-2 + k * k * 1.7e-6 AS lon,
  user_id, event_type
FROM (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k,
        CAST(floor(value) AS INTEGER) AS v, CAST(date_trunc('hour', ts) AS {TS}) AS s FROM events) o
""",
    # One stream record per event inside hourly batches, with broken batches of every kind.
    "records_v": """
SELECT event_id, CASE WHEN event_id % 400 = 399 THEN md5(CAST(s AS {STR})) ELSE {SHA}CAST(s AS {STR}){END} END AS snapshot_id,
  CASE WHEN event_id % 700 = 699 THEN {SHA}'m2'{END} ELSE {SHA}'m1'{END} END AS metadata_version,
  CASE WHEN user_id % 50 = 7 THEN 'GBFS_REPLAY' WHEN user_id % 97 = 13 THEN 'OTHER' ELSE 'GBFS_LIVE' END AS data_origin,
  CASE WHEN event_id % 900 = 899 THEN '1.0' ELSE '1.1' END AS contract_version,
  CASE WHEN event_type = 'error' THEN 'snapshot_end' ELSE 'station' END AS record_type,
  CASE WHEN event_type = 'error' THEN '__snapshot_end__' ELSE 'S' || CAST(k AS {STR}) END AS record_key,
  CASE WHEN event_type = 'error' THEN CAST(k % 12 AS INTEGER) END AS station_count,
  CASE WHEN event_id % 300 = 299 THEN s + INTERVAL 1 SECOND ELSE s END AS snapshot_at,
  s + INTERVAL 20 SECONDS AS ingested_at, s + INTERVAL 45 SECONDS AS received_at
FROM (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k, CAST(date_trunc('hour', ts) AS {TS}) AS s FROM events) r
""",
    # Records of several feeds in blocks of forty: a block is one snapshot with its end marker, and some blocks break a rule.
    "gate_v": """
SELECT 'f' || CAST(CAST(floor(event_id / 4e3) AS BIGINT) AS {STR}) AS feed, 'all' AS feed_file, CAST(event_id AS BIGINT) AS position,
  CASE WHEN i = 39 AND b % 13 <> 12 THEN '__snapshot_end__' WHEN b % 7 = 3 THEN 'S' || CAST(i % 20 AS {STR}) ELSE 'S' || CAST(i AS {STR}) END AS record_key,
  CASE WHEN i = 39 AND b % 13 <> 12 THEN 'snapshot_end' ELSE 'station' END AS record_type,
  {SHA}CAST(CASE WHEN b % 11 = 10 THEN b - 1 ELSE b END AS {STR}){END} AS snapshot_id,
  CASE WHEN b % 29 = 28 AND i = 7 THEN 'm2' ELSE 'm1' END AS metadata_version,
  CASE WHEN b % 31 = 30 AND i = 9 THEN 'OTHER' ELSE 'GBFS_LIVE' END AS data_origin,
  CASE WHEN b % 7 = 3 AND b % 2 = 0 AND i = 25 THEN 'other' ELSE 'v' END AS value,
  CAST(CAST('2024-01-01 00:00:00' AS {TS}) + INTERVAL 1 MINUTE * CAST(CASE WHEN b % 17 = 16 THEN b - 40 ELSE b END + CASE WHEN b % 47 = 46 AND i = 39 THEN 1 ELSE 0 END AS INTEGER) AS {STR}) AS snapshot_at,
  'i' || CAST(b AS {STR}) AS ingested_at,
  CASE WHEN i = 39 AND b % 13 <> 12 THEN CAST(CASE WHEN b % 23 = 22 THEN 7 WHEN b % 7 = 3 THEN 20 ELSE 39 END AS INTEGER) END AS station_count,
  CASE WHEN b % 41 = 40 AND i = 11 THEN 'flags' WHEN b % 43 = 42 AND i = 12 THEN 'key_mismatch' END AS broken_rule,
  NOT (b % 37 = 36 AND i = 3) AS known_station
FROM (SELECT event_id, CAST(floor(event_id / 4e1) AS BIGINT) AS b, event_id % 40 AS i FROM events) g
""",
    # One collection attempt per event, with repeated provider times.
    "attempts_v": """
SELECT event_id AS attempt, CAST(date_trunc('hour', ts) AS {TS}) AS provider_time, ts AS ingested_at,
  {SHA}CAST(user_id % 3 AS {STR}){END} AS status_raw_sha256, {SHA}'s' || CAST(user_id AS {STR}){END} AS snapshot_id,
  {SHA}'m' || CAST(user_id % 7 AS {STR}){END} AS metadata_version,
  CASE WHEN user_id % 5 = 4 THEN 'GBFS_REPLAY' ELSE 'GBFS_LIVE' END AS data_origin,
  CASE event_type WHEN 'error' THEN 'FAILED_SEND' WHEN 'view' THEN 'PUBLISHED' WHEN 'click' THEN 'SKIPPED_DUPLICATE'
       WHEN 'signup' THEN 'REJECTED_CONFLICT' ELSE 'FAILED_COLLECTION' END AS status,
  CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS isolated_count, CAST(floor(value) AS INTEGER) AS mapped_count
FROM events
""",
    # Raw status feed text per event, as it lands before parsing.
    "feed_v": """
SELECT event_id, 'u-' || CAST(k AS {STR}) AS provider_station_id, CAST(1704067200 + event_id * 7 AS BIGINT) AS last_updated,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(1704067200 + event_id * 7 - v AS BIGINT) END AS last_reported,
  v % 45 - 2 AS bikes, CASE WHEN event_id % 13 = 0 THEN NULL ELSE 40 - v % 43 END AS docks,
  CASE WHEN event_id % 8 = 0 THEN -1 ELSE v % 4 END AS bikes_disabled,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS installed_flag, k AS ebikes
FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k, CAST(floor(value) AS INTEGER) AS v FROM events) f
""",
}
TABLES = {"stations_v": "supplier", "information_v": "supplier", "dup_v": "lineitem"}

_SPARK = {"STR": "STRING", "TS": "TIMESTAMP_NTZ", "SHA": "sha2(", "END": ", 256)"}
_DUCKDB = {"STR": "VARCHAR", "TS": "TIMESTAMP", "SHA": "sha256(", "END": ")"}


def _render(name, names):
    text = VIEWS[name]
    for token, value in names.items():
        text = text.replace("{" + token + "}", value)
    return text.strip()


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_view(spark, sf_dir, name):
    """The view as a DataFrame; only the columns a query uses are read from Parquet."""
    source = TABLES.get(name, "events")
    text = _render(name, _SPARK).replace(f"FROM {source}", "FROM {source}")
    return spark.sql(text, source=table(spark, sf_dir, source))


CTES = {name: _render(name, _DUCKDB) for name in VIEWS}
