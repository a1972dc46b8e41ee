"""Stream records: NDJSON replay files, Kafka topics and landed batches.

Every source yields the same flat columns (`FLAT`), so the batch rules and the
streaming gate read one shape.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.functions.hashing import metadata_version
from dockflow.functions.text import clean_identifier
from dockflow.operators.quality import Rule, batch_integrity, record_rules
from dockflow.operators.trips import GateError
from dockflow.sources.gbfs import is_kind, member
from dockflow.schemas import CITY_ZONE, END_KEY, FEED_VERSION, RECORD_HEADERS, SNAPSHOT_END, STATION_EVENT

_S = T.StringType()
# Values stay text until the record type says how to read them.
ENVELOPE = T.StructType(
    [
        T.StructField("key", _S),
        T.StructField("headers", T.MapType(_S, _S)),
        T.StructField("value", _S),
    ]
)
_UTC = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|\+00:00)$"


def _folder():
    """Replay files of one folder are one feed; folders are gated in parallel."""
    return F.regexp_extract("_metadata.file_path", r"^(.*)/[^/]*$", 1).alias("feed")


def _lines(reader, path):
    """(text, feed, file, split) of text files: Spark cuts large files into splits, and `split` says where a line's begins."""
    name, start = F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split")
    return reader.text(path).select(F.col("value").alias("text"), _folder(), name, start)


def envelopes_of(batch):
    """Envelopes of a batch of `_lines`, blank ones skipped; rows that are envelopes already pass.

    The gate needs the order of lines, not their numbers. Rows of a split are read one after another, so the row's place in its task orders them, and
    the splits of a file stand in order of their first byte: no line is sorted, shuffled or counted. The batch must come straight from
    the reader.
    """
    if "text" not in batch.columns:
        return batch
    file = F.concat("file", F.lit(" "), F.lpad(F.col("split").cast("string"), 19, "0"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = batch.select("text", "feed", F.struct(file.alias("feed_file"), place.alias("position")).alias("offset"))
    parsed = placed.where(F.trim("text") != "").withColumn("record", F.from_json("text", ENVELOPE))
    return parsed.select("record.*", "feed", "offset")


def read_ndjson(spark, path):
    """Records of NDJSON files; blank lines are skipped."""
    return envelopes_of(_lines(spark.read, path))


def stream_ndjson(spark, path, max_files=1):
    """Replay files as a stream of lines in file order, for `envelopes_of` in `foreachBatch`; a file of any size is read in splits."""
    return _lines(spark.readStream.option("maxFilesPerTrigger", max_files), path)


def read_kafka(spark, servers, topic, max_offsets=50_000, **options):
    """Records of a topic; the checkpoint replaces manual offset commits."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    reader = reader.option("startingOffsets", "earliest").option("includeHeaders", True)
    reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    for name, value in options.items():
        reader = reader.option(name.replace("__", "."), value)
    return kafka_records(reader.load())


def kafka_records(rows):
    """Kafka rows (binary key, value and headers) as envelopes keyed by topic partition."""
    text = F.transform("headers", lambda h: F.struct(h.key.alias("key"), h.value.cast("string").alias("value")))
    return rows.select(
        F.col("key").cast("string").alias("key"),
        F.map_from_entries(text).alias("headers"),
        F.col("value").cast("string").alias("value"),
        F.concat_ws("-", "topic", "partition").alias("feed"),
        F.struct(F.lit("").alias("feed_file"), F.col("offset").alias("position")).alias("offset"),
    )


def _instant(text):
    return F.when(text.rlike(_UTC), text.try_cast("timestamp"))


def flat_records(envelopes):
    """Typed columns of both record kinds; a field of the other kind is NULL."""
    headers = [F.try_element_at("headers", F.lit(name)).alias(name) for name in RECORD_HEADERS]
    station = F.when(F.col("record_type") == "station", F.from_json("value", STATION_EVENT))
    end = F.when(F.col("record_type") == "snapshot_end", F.from_json("value", SNAPSHOT_END))
    opened = (
        envelopes.select(F.col("key").alias("record_key"), *headers, F.array_sort(F.map_keys("headers")).alias("header_names"), "value", "feed", "offset")
        .withColumns({"station": station, "end": end})
        .withColumn("document", F.try_parse_json("value"))
    )
    snapshot_at = F.coalesce("station.snapshot_at_utc", "end.snapshot_at_utc")
    ingested_at = F.coalesce("station.ingested_at_utc", "end.ingested_at_utc")
    return opened.withColumns(
        {
            "snapshot_at": _instant(snapshot_at),
            "ingested_at": _instant(ingested_at),
            "station_count": F.col("end.station_count"),
            "station_id": F.col("station.station_id"),
            "bikes": F.col("station.num_bikes_available"),
            "docks": F.col("station.num_docks_available"),
            "is_installed": F.col("station.is_installed"),
            "is_renting": F.col("station.is_renting"),
            "is_returning": F.col("station.is_returning"),
            "last_reported_at": _instant(F.col("station.last_reported_at_utc")),
        }
    ).drop("end")


# Fields that an event must fill; the others may be null.
_REQUIRED = (
    "station_id", "snapshot_at_utc", "snapshot_at_local", "num_bikes_available", "is_installed", "is_renting", "is_returning",
    "ingested_at_utc", "source_version",
)
_JSON_KIND = {"string": "string", "int": "integer", "bigint": "integer", "boolean": "boolean"}


def _as_declared(field, nullable):
    """Whether the document's field has the JSON kind of its type; a wrong kind must not pass as missing."""
    kinds = [_JSON_KIND[field.dataType.simpleString()], *(["null", "missing"] if nullable else [])]
    return is_kind(member(F.col("document"), f"$.{field.name}"), *kinds)


def event_rules():
    """Everything one record must satisfy on its own, header rules included."""
    is_station, is_end = F.col("record_type") == "station", F.col("record_type") == "snapshot_end"
    event = F.col("station")
    # The local text must be the same instant, written on the city's clock.
    utc_wall = F.col("snapshot_at").cast("timestamp_ntz")
    city_text = F.convert_timezone(F.current_timezone(), F.lit(CITY_ZONE), utc_wall).cast("string")
    local_text = event["snapshot_at_local"]
    same_clock = F.replace(F.substring(local_text, 1, 19), F.lit("T"), F.lit(" ")) == F.substring(city_text, 1, 19)
    same_local = F.coalesce(same_clock & (local_text.try_cast("timestamp") == F.col("snapshot_at")), F.lit(False))
    fields = set(STATION_EVENT.fieldNames())
    # Exact field set: names that the document has, against the contract's.
    names = F.json_object_keys("value")
    wanted = F.array_sort(F.array(*[F.lit(n) for n in sorted(fields)]))
    wanted_end = F.array_sort(F.array(*[F.lit(n) for n in sorted(SNAPSHOT_END.fieldNames())]))
    flags = [event[n] for n in ("is_installed", "is_renting", "is_returning")]
    missing_flag = flags[0].isNull() | flags[1].isNull() | flags[2].isNull()
    rules = record_rules() + [
        Rule("json", F.col("document").isNull()),
        Rule("header_names", ~F.col("header_names").eqNullSafe(F.array(*[F.lit(n) for n in sorted(RECORD_HEADERS)]))),
        *[Rule(f"kind_{f.name}", is_station & ~_as_declared(f, f.name not in _REQUIRED)) for f in STATION_EVENT.fields],
        *[Rule(f"kind_end_{f.name}", is_end & ~_as_declared(f, False)) for f in SNAPSHOT_END.fields],
        Rule("station_fields", is_station & ~F.array_sort(names).eqNullSafe(wanted)),
        Rule("end_fields", is_end & ~F.array_sort(names).eqNullSafe(wanted_end)),
        Rule("repeated_field", F.size(F.array_distinct(names)) != F.size(names)),
        Rule("key_mismatch", is_station & ~F.col("record_key").eqNullSafe(F.col("station_id"))),
        Rule("end_key_name", is_end & ~F.col("record_key").eqNullSafe(F.lit(END_KEY))),
        Rule("station_id", is_station & ~clean_identifier(F.col("station_id"))),
        Rule("bikes", is_station & F.col("bikes").isNull()),
        Rule("flags", is_station & missing_flag),
        Rule("source_version", is_station & ~event["source_version"].eqNullSafe(FEED_VERSION)),
        Rule("snapshot_time", F.col("snapshot_at").isNull()),
        Rule("ingest_time", F.col("ingested_at").isNull()),
        Rule("report_time", event["last_reported_at_utc"].isNotNull() & F.col("last_reported_at").isNull()),
        Rule("local_time", is_station & ~same_local),
    ]
    return rules


def replayed(envelopes):
    """The records as a replay: same content, origin rewritten."""
    return envelopes.withColumn(
        "headers", F.transform_values("headers", lambda k, v: F.when(k == "data_origin", "GBFS_REPLAY").otherwise(v))
    )


def load_replay(spark, path):
    """A replay file as records, refused unless it is one complete recorded batch."""
    envelopes = read_ndjson(spark, path)
    flat = flat_records(envelopes)
    verdicts = batch_integrity(flat).take(2)
    if len(verdicts) != 1 or verdicts[0].verdict != "COMPLETE":
        raise GateError(f"replay is not one complete batch: {[v.reason for v in verdicts]}")
    if flat.where("data_origin = 'GBFS_LIVE'").take(1):
        raise GateError("live records cannot be replayed")
    return replayed(envelopes)


def persisted_batch_rules():
    """A landed batch against its log row; all three digests must match."""
    return [
        Rule("status_raw_sha256", ~F.col("status_raw_sha256").eqNullSafe(F.sha2("status_raw", 256))),
        Rule("metadata_version", ~F.col("metadata_version").eqNullSafe(metadata_version(F.col("metadata_raw")))),
        Rule("snapshot_id", ~F.col("snapshot_id").eqNullSafe(F.col("recorded_snapshot_id"))),
    ]


def persisted_batches(log, landed):
    """Log rows joined to what was landed for them, for `persisted_batch_rules`."""
    return log.join(landed, "snapshot_directory", "left")
