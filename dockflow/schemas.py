"""Contract values and table schemas.

Fixed values: the names, formats, thresholds and enumerations below are part of
the data contract and must match it exactly.
"""

from pyspark.sql import types as T

CONTRACT_VERSION = "1.1"
FEED_VERSION = "2.3"
CITY_ZONE = "America/New_York"

TRIP_FIELDS = (
    "ride_id",
    "rideable_type",
    "started_at",
    "ended_at",
    "start_station_name",
    "start_station_id",
    "end_station_name",
    "end_station_id",
    "start_lat",
    "start_lng",
    "end_lat",
    "end_lng",
    "member_casual",
)
REQUIRED_TRIP_FIELDS = ("ride_id", "rideable_type", "started_at", "ended_at", "member_casual")
TRIP_TIME_FIELDS = ("started_at", "ended_at")
TRIP_STATION_FIELDS = ("start_station_id", "end_station_id")
TRIP_COORDINATES = {"start_lat": 90.0, "start_lng": 180.0, "end_lat": 90.0, "end_lng": 180.0}
TRIP_ENUMS = {
    "rideable_type": ("classic_bike", "electric_bike"),
    "member_casual": ("casual", "member"),
}
TIME_PATTERNS = (
    "MM/dd/yyyy HH:mm:ss.SSSSSS",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
)

STATUSES = (
    "SHORTAGE_RISK",
    "OVERFLOW_RISK",
    "LOW_INVENTORY",
    "HIGH_INVENTORY",
    "SERVICE_UNAVAILABLE",
    "STALE_DATA",
    "INVALID_DATA",
    "INSUFFICIENT_DATA",
    "HEALTHY",
    "NOT_APPLICABLE",
)
INVENTORY_STATUSES = ("SHORTAGE_RISK", "LOW_INVENTORY", "HEALTHY", "HIGH_INVENTORY", "OVERFLOW_RISK")
FAILED_STATUSES = ("STALE_DATA", "SERVICE_UNAVAILABLE", "INVALID_DATA", "INSUFFICIENT_DATA")
REASONS = (
    "INVALID_TIME",
    "STALE_OBSERVATION",
    "SERVICE_FLAGS",
    "NEGATIVE_INVENTORY",
    "MISSING_INVENTORY",
    "ZERO_SERVICEABLE_CAPACITY",
    "NO_BASELINE",
)
FRESH_SECONDS = 180
SKEW_SECONDS = 60
FORECAST_SECONDS = 3600
BATCH_TIMEOUT_SECONDS = 120
EARTH_RADIUS_M = 6371000.0

MAX_ID_LENGTH = 128

ORIGINS = ("GBFS_LIVE", "GBFS_REPLAY", "FIXTURE")
MODE_ORIGINS = {
    "live": ("GBFS_LIVE",),
    "recorded": ("GBFS_REPLAY", "FIXTURE"),
    "any": ORIGINS,
}
END_KEY = "__snapshot_end__"
FEEDS = ("station_information", "station_status", "vehicle_types")
MAPPING_REASONS = ("MISSING_SHORT_NAME", "DUPLICATE_SHORT_NAME", "MISSING_METADATA")

# End of fixed values.


def _struct(**fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampType()

TRIP_CSV = T.StructType([T.StructField(name, _S, True) for name in TRIP_FIELDS])

METADATA = _struct(
    provider_station_id=_S,
    station_id=_S,
    mapping_status=_S,
    mapping_reason=_S,
    station_name=_S,
    lat=_D,
    lon=_D,
    capacity=_I,
    region_id=_S,
    is_current=_B,
    metadata_source=_S,
    metadata_updated_at=_TS,
)

MANIFEST = _struct(
    source_month=_S,
    zip_sha256=_S,
    record_count=_L,
    csv_file_count=_L,
    zip_members=T.ArrayType(_S),
    csv_files=T.ArrayType(
        _struct(filename=_S, size_bytes=_L, record_count=_L, header=T.ArrayType(_S))
    ),
)

STATION_EVENT = _struct(
    station_id=_S,
    snapshot_at_utc=_S,
    snapshot_at_local=_S,
    num_bikes_available=_I,
    num_bikes_disabled=_I,
    num_docks_available=_I,
    num_docks_disabled=_I,
    is_installed=_B,
    is_renting=_B,
    is_returning=_B,
    last_reported_at_utc=_S,
    ingested_at_utc=_S,
    source_version=_S,
)
SNAPSHOT_END = _struct(station_count=_I, snapshot_at_utc=_S, ingested_at_utc=_S)
RECORD_HEADERS = ("contract_version", "record_type", "snapshot_id", "metadata_version", "data_origin")

DWD_COLUMNS = (
    "ride_id", "rideable_type", "started_at_local", "ended_at_local", "duration_seconds",
    "start_station_id", "start_station_name", "start_lat", "start_lng",
    "end_station_id", "end_station_name", "end_lat", "end_lng", "member_casual",
    "service_date", "start_hour", "day_of_week", "is_weekend",
    "ingest_batch_id", "source_file", "source_row_number",
    "is_duplicate_ride", "is_valid_station_trip", "source_year", "source_month",
)
FLOW_COUNTS = (
    "inbound_rides", "outbound_rides", "net_flow", "total_activity",
    "electric_outbound", "classic_outbound", "member_outbound", "casual_outbound",
)
# Column order of the four serving tables.
SERVING_COLUMNS = {
    "dim_station_v1": (
        "station_id", "station_name", "lat", "lon", "capacity", "region_id",
        "is_current", "metadata_source", "metadata_updated_at", "dataset_id",
    ),
    "dws_station_hourly_flow_v1": ("station_id", "service_date", "hour", *FLOW_COUNTS, "dataset_id"),
    "dws_station_hour_profile_v1": (
        "station_id", "day_of_week", "hour", "avg_inbound", "avg_outbound",
        "avg_net_flow", "median_net_flow", "sample_days", "dataset_id",
    ),
    "dws_station_od_hourly_v1": (
        "service_date", "hour", "from_station_id", "to_station_id", "ride_count", "dataset_id",
    ),
}
SERVING_KEYS = {
    "dim_station_v1": ("station_id",),
    "dws_station_hourly_flow_v1": ("station_id", "service_date", "hour"),
    "dws_station_hour_profile_v1": ("station_id", "day_of_week", "hour"),
    "dws_station_od_hourly_v1": ("service_date", "hour", "from_station_id", "to_station_id"),
}
