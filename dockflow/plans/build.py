"""The batch build: manifest files to a committed release, or to evidence of why not."""

import calendar

from pyspark.sql import Observation
from pyspark.sql import functions as F

from dockflow.functions.hashing import dataset_id
from dockflow.operators import flow, stations, trips
from dockflow.operators.trips import GateError
from dockflow.schemas import CONTRACT_VERSION
from dockflow.sinks.release import TABLE_PATHS, commit_release, exists, new_attempt, quarantine, write_evidence, write_table
from dockflow.sources.inventory import inventory, manifest_differences
from dockflow.sources.manifest import count_mismatches, expected_count, load_manifest, members, read_manifest
from dockflow.sources.metadata import content_version, load_metadata
from dockflow.sources.trips_csv import read_manifest_trips

_LINEAGE = ("source_year", "source_month", "source_file", "source_row_number")


def month_parts(source_month):
    year, month = source_month.split("-")
    calendar.monthrange(int(year), int(month))
    return int(year), int(month)


def stage_typed(records, source_month, batch_id, path, wall_clock="ltz"):
    """Parse once and write; the gate's counters come out of the same pass.

    Everything later reads this Parquet copy, so the CSV text is scanned twice in
    total (line numbers, then parsing) however many tables are built from it.
    """
    year, month = month_parts(source_month)
    typed = trips.typed_trips(records, wall_clock).withColumns(
        {"source_year": F.lit(year), "source_month": F.lit(month), "ingest_batch_id": F.lit(batch_id)}
    )
    seen = Observation("source_gate")
    reason = trips.gate_reason()
    observed = typed.observe(
        seen,
        F.count("*").alias("rows"),
        F.count_if("malformed").alias("malformed"),
        F.count_if("bad_header").alias("bad_header"),
        F.count_if(reason == "BLANK_REQUIRED_FIELD").alias("blank_required_field"),
        F.count_if(reason == "UNPARSED_TIME").alias("unparsed_time"),
    )
    refused = F.when(F.col("bad_header"), "BAD_HEADER").when(F.col("malformed"), "MALFORMED").otherwise(reason)
    observed.withColumn("refused", refused).drop("bad_header").write.mode("errorifexists").parquet(path)
    return seen.get


def check_files(spark, raw_root, manifest_members):
    """Refuse files that are missing, extra or of another size before any of them is read."""
    found = manifest_differences(manifest_members, inventory(spark, raw_root, digest=False)).orderBy("filename").take(10)
    if found:
        raise GateError(f"files differ from the manifest: {[r.asDict() for r in found]}")


def check_source(counters, mismatches):
    """Refuse the batch on any gate counter or file count difference."""
    broken = {name: n for name, n in counters.items() if name != "rows" and n}
    if broken:
        raise GateError(f"unusable trip records, by kind: {broken}")
    different = mismatches.take(10)
    if different:
        raise GateError(f"record counts differ from the manifest: {[r.asDict() for r in different]}")


def staged(df, path):
    """Write a small intermediate and read it back: joins against it are planned by its file size."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def build_tables(spark, typed, metadata, built_at, stage, release_id):
    """All warehouse tables from typed trips; each is written once and read back by the next."""
    paths = {name: f"{stage}/{path}" for name, path in TABLE_PATHS.items()}
    counters = Observation("quality")
    repeated = staged(trips.repeated_keys(typed, "ride_id"), f"{stage}-repeated")
    firsts = staged(trips.first_rows(typed, "ride_id", _LINEAGE, repeated=repeated), f"{stage}-firsts")
    marked = trips.build_dwd(typed, _LINEAGE, firsts).observe(counters, *trips.quality_columns())
    write_table(marked, "dwd_trip_v1", paths["dwd_trip_v1"])
    dwd = spark.read.parquet(paths["dwd_trip_v1"])
    counted = dwd.where("is_valid_station_trip")

    def save(name, df):
        write_table(df.withColumn("dataset_id", F.lit(release_id)), name, paths[name])
        return spark.read.parquet(paths[name])

    hourly = save("dws_station_hourly_flow_v1", flow.hourly_flow(counted))
    profile = save("dws_station_hour_profile_v1", flow.hour_profile(hourly))
    od = save("dws_station_od_hourly_v1", flow.od_hourly(counted))
    sightings = stations.endpoint_candidates(dwd)
    newest = staged(stations.newest_times(sightings), f"{stage}-newest")
    historical = stations.latest_attributes(sightings, newest)
    dim = save("dim_station_v1", stations.station_dim(metadata, historical, built_at))

    totals = flow.conservation(dwd, hourly, od).first().asDict()
    if not totals.pop("conserved"):
        raise GateError(f"flow does not conserve trips: {totals}")
    hits = stations.metadata_hits(sightings, metadata).first().asDict()
    conflicts = trips.conflict_count(typed, _LINEAGE, repeated).first()[0]
    sizes = {"flow": hourly.count(), "profile": profile.count(), "od": od.count(), "dim": dim.count()}
    bounds = flow.date_bounds(hourly).first().asDict()
    return {**counters.get, **totals, **hits, **sizes, "duplicate_conflict": conflicts}, bounds


def build_release(spark, raw_root, manifest_path, metadata_path, source_month, root, built_at, wall_clock="ltz", ods_count=None, export=True):
    """Build and commit the release of one month; running it again validates and returns the committed one.

    Every attempt leaves evidence beside its folder, PASS or FAIL with what it has counted. A refused one also leaves the records that were refused, by reason;
    they were marked in the pass that parsed them. Neither is ever overwritten.
    """
    manifest = load_manifest(spark, manifest_path, source_month)
    metadata = load_metadata(spark, metadata_path)
    version = content_version(spark, metadata_path)
    line = f"{source_month}:{manifest['zip_sha256']}"
    release_id = spark.range(1).select(dataset_id(F.lit(version), F.array(F.lit(line)))).first()[0]

    stage = new_attempt(root, release_id)
    facts = {
        "contract_version": CONTRACT_VERSION, "dataset_id": release_id, "metadata_version": version, "source_months": [source_month],
        "ingest_batch_ids": [manifest["zip_sha256"]], "built_at": built_at,
    }
    try:
        release = _attempt(spark, raw_root, manifest_path, manifest, metadata, source_month, root, wall_clock, ods_count, export, stage, facts)
    except GateError as refused:
        typed = f"{stage}-typed"
        if exists(spark, typed):
            facts["quarantine"] = f"{stage}-quarantine"
            quarantine(spark.read.parquet(typed), facts["quarantine"], "refused")
        write_evidence(spark, f"{stage}-evidence", {**facts, "status": "FAIL", "error": str(refused)})
        raise
    write_evidence(spark, f"{stage}-evidence", {**facts, "status": "PASS"})
    return release


def _attempt(spark, raw_root, manifest_path, manifest, metadata, source_month, root, wall_clock, ods_count, export, stage, facts):
    listed = members(read_manifest(spark, manifest_path))
    check_files(spark, raw_root, listed)
    expected = expected_count(manifest["record_count"], ods_count)
    typed_path = f"{stage}-typed"
    records = read_manifest_trips(spark, raw_root, manifest, f"{stage}-splits")
    facts["source"] = counters = stage_typed(records, source_month, manifest["zip_sha256"], typed_path, wall_clock)
    typed = spark.read.parquet(typed_path).drop("refused")
    check_source(counters, count_mismatches(typed, listed))
    if expected != counters["rows"]:
        raise GateError(f"{expected} records were expected, the files hold {counters['rows']}")

    quality, bounds = build_tables(spark, typed, metadata, F.lit(facts["built_at"]).cast("timestamp"), stage, facts["dataset_id"])
    facts.update({name: str(bounds[name]) for name in ("min_service_date", "max_service_date")})
    facts["counts"] = {**quality, "ods": ods_count}
    described = {name: value for name, value in facts.items() if name != "source"}
    return commit_release(spark, root, stage, described, export=export)
