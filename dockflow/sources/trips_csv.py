"""Trip CSV scans: a plain one, and one that numbers every record for lineage."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.operators.trips import GateError, without_header_rows
from dockflow.schemas import TRIP_CSV, TRIP_FIELDS, TRIP_STATION_FIELDS

# One field: quoted text with doubled quotes, or text without a comma that does not start with a quote.
_FIELD = r'(?:"(?:[^"]++|"")*+"|(?:[^",][^,]*+)?+)'
RECORD_SHAPE = rf"^{_FIELD}(?:,{_FIELD}){{{len(TRIP_FIELDS) - 1}}}$"


def read_trip_csv(spark, path):
    """Plain scan: header by name and order, text columns, permissive records."""
    names = spark.read.option("header", True).csv(path).columns
    if tuple(names) != TRIP_FIELDS:
        raise GateError(f"unexpected trip header: {names}")
    reader = spark.read.schema(TRIP_CSV).option("header", True).option("enforceSchema", False)
    return reader.option("mode", "PERMISSIVE").csv(path)


def read_trip_table(spark, table, year=None, month=None):
    """Scan of a registered text table; the month filter prunes partitions."""
    df = spark.table(table)
    if year is not None:
        df = df.where((F.col("year") == year) & (F.col("month") == month))
    missing = sorted(set(TRIP_FIELDS) - set(df.columns))
    if missing:
        raise GateError(f"table {table} lacks columns {missing}")
    for name in TRIP_STATION_FIELDS:
        if not isinstance(df.schema[name].dataType, T.StringType):
            raise GateError(f"table {table}: {name} must be a string")
    return without_header_rows(df)


def register_trip_table(spark, table, location):
    """External text table over year=/month= folders, partitions discovered."""
    columns = ", ".join(f"{name} STRING" for name in TRIP_FIELDS)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}, year INT, month INT) USING csv"
        f" OPTIONS (header 'false') PARTITIONED BY (year, month) LOCATION '{location}'"
    )
    spark.sql(f"MSCK REPAIR TABLE {table}")
    return spark.table(table)


def numbered_lines(spark, paths, offsets_path=None, **options):
    """Every physical line with its file name and zero-based line number.

    Lines of one split arrive in file order, so the position inside a split is a
    difference of task-local ids, and the rest is a prefix sum over per-split line
    counts. Splits are few (one per 128 MB or so). A job names `offsets_path`, where
    the per-split offsets are written first: the join is then planned by their file
    size and lines stay where they are read. Without it the estimated size decides,
    and lines may be shuffled. Both scans must cut the files alike; a line outside
    its split's counted range stops the job instead of getting a wrong number.
    """
    lines = spark.read.options(**options).text(paths).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line_id"),
    )
    splits = lines.groupBy("path", "split").agg(F.count("*").alias("lines"), F.min("line_id").alias("first_id"))
    before = F.expr(
        "coalesce(sum(lines) OVER (PARTITION BY path ORDER BY split"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    )
    offsets = splits.select("path", "split", "lines", "first_id", before.alias("before"))
    if offsets_path is not None:
        offsets.write.mode("errorifexists").parquet(offsets_path)
        offsets = spark.read.parquet(offsets_path)
    place = F.col("line_id") - F.col("first_id")
    moved = F.raise_error(F.lit("the files were split differently by the two scans; run the job again"))
    number = F.when((place >= 0) & (place < F.col("lines")), F.col("before") + place).otherwise(moved.cast("bigint"))
    return lines.join(offsets, ["path", "split"], "left").select("line", "source_file", number.alias("line_number"))


def parse_records(numbered):
    """Strict one-record-per-line parse; `malformed` marks lines that are not exactly 13 fields."""
    record = F.from_csv("line", TRIP_CSV.simpleString()[len("struct<"):-1].replace(":", " "), {"escape": '"'})
    return numbered.select(
        "source_file",
        F.col("line_number").alias("source_row_number"),
        (~F.col("line").rlike(RECORD_SHAPE)).alias("malformed"),
        record.alias("record"),
    ).select("source_file", "source_row_number", "malformed", "record.*")


def is_header():
    """The parsed line repeats the field names in order."""
    return F.array(*TRIP_FIELDS).eqNullSafe(F.array(*[F.lit(name) for name in TRIP_FIELDS]))


def read_manifest_trips(spark, root, manifest, offsets_path=None):
    """All records of the manifest's files with lineage columns; the header is record 0 and drops out.

    `manifest` is the checked manifest (`sources.manifest`). Malformed lines and
    wrong headers stay visible as `malformed` / `bad_header` for the source gate.
    """
    paths = [f"{root.rstrip('/')}/{entry['filename']}" for entry in manifest["csv_files"]]
    records = parse_records(numbered_lines(spark, paths, offsets_path))
    first = F.col("source_row_number") == 0
    flagged = records.withColumn("bad_header", first & ~F.coalesce(is_header() & ~F.col("malformed"), F.lit(False)))
    return flagged.where(~first | F.col("bad_header"))
