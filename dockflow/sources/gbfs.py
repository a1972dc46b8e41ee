"""Station feed snapshots: envelopes, typed rows, schema rules and canonical events.

Feeds arrive as whole JSON documents. They are read as VARIANT, so a value's own
JSON type stays visible and a wrong type is reported instead of coerced.
"""

from pyspark.sql import functions as F

from dockflow.functions.hashing import metadata_version, snapshot_id
from dockflow.functions.times import city_clock
from dockflow.operators.quality import Rule
from dockflow.schemas import FEED_VERSION, FEEDS

INVENTORY = ("num_bikes_available", "num_bikes_disabled", "num_docks_available", "num_docks_disabled")
FLAGS = ("is_installed", "is_renting", "is_returning")


def read_documents(spark, path):
    """One row per feed file: path, raw text and the parsed document (NULL when not JSON)."""
    files = spark.read.format("binaryFile").load(path)
    text = F.col("content").cast("string")
    return files.select(F.col("path"), text.alias("raw"), F.try_parse_json(text).alias("doc"))


def documents(df, raw="raw"):
    """The same over a text column, e.g. a Kafka value or a table of landed feeds."""
    return df.withColumn("doc", F.try_parse_json(raw))


# JSON kinds as the names that `schema_of_variant` gives them.
_KINDS = {
    "object": "OBJECT.*",
    "array": "ARRAY.*",
    "string": "STRING",
    "integer": "BIGINT|INT|SMALLINT|TINYINT",
    "number": "DECIMAL.*|DOUBLE|FLOAT",
    "boolean": "BOOLEAN",
    "null": "VOID",
}


def is_kind(value, *kinds):
    """The variant has one of the JSON kinds; false for an absent value unless `missing` is listed."""
    named = "|".join(_KINDS[k] for k in kinds if k != "missing")
    return F.coalesce(F.schema_of_variant(value).rlike(f"^(?:{named})$"), F.lit("missing" in kinds))


def member(document, path, target="variant"):
    return F.try_variant_get(document, path, target)


def integer(document, path):
    """The value as BIGINT when it is a JSON integer; fractions and text are NULL."""
    return F.when(is_kind(member(document, path), "integer"), F.try_variant_get(document, path, "bigint"))


def flag(document, path):
    """Boolean, or 0/1 as boolean; anything else is NULL."""
    number = F.try_variant_get(document, path, "bigint")
    return F.when(is_kind(member(document, path), "boolean"), F.try_variant_get(document, path, "boolean")).when(
        is_kind(member(document, path), "integer") & number.isin(0, 1), number == 1
    )


def string(document, path):
    return F.when(is_kind(member(document, path), "string"), F.try_variant_get(document, path, "string"))


def feed_rows(docs, array, *keep):
    """One row per element of `data.<array>`, with the envelope's times and version."""
    items = F.try_variant_get("doc", f"$.data.{array}", "array<variant>")
    return docs.select(
        *keep,
        string(F.col("doc"), "$.version").alias("version"),
        integer(F.col("doc"), "$.last_updated").alias("last_updated"),
        F.posexplode(items).alias("position", "item"),
    )


def discovery_feeds(docs, locale="en"):
    """Feed names and addresses of one locale of a discovery document."""
    items = F.try_variant_get("doc", f"$.data.{locale}.feeds", "array<variant>")
    exploded = docs.select(F.explode(items).alias("feed"))
    return exploded.select(string(F.col("feed"), "$.name").alias("name"), string(F.col("feed"), "$.url").alias("url"))


def missing_feeds(spark, feeds, required=FEEDS):
    """Required feeds that the discovery document does not list."""
    wanted = spark.createDataFrame([(name,) for name in required], "name string")
    return wanted.join(feeds.where("url IS NOT NULL"), "name", "left_anti")


def envelope_rules(array):
    """Document-level rules of a data feed."""
    doc = F.col("doc")
    return [
        Rule("json", ~is_kind(doc, "object")),
        Rule("version", ~string(doc, "$.version").eqNullSafe(FEED_VERSION)),
        Rule("last_updated", ~F.coalesce(integer(doc, "$.last_updated") >= 0, F.lit(False))),
        Rule("ttl", ~F.coalesce(integer(doc, "$.ttl") >= 0, F.lit(False))),
        Rule("rows", ~is_kind(member(doc, f"$.data.{array}"), "array")),
    ]


def _text_rule(name):
    value = string(F.col("item"), f"$.{name}")
    return Rule(name, ~F.coalesce(value != "", F.lit(False)))


def status_rules():
    """Row rules of the status feed."""
    item = F.col("item")
    rules = [_text_rule("station_id")]
    rules.append(Rule("num_bikes_available", ~is_kind(member(item, "$.num_bikes_available"), "integer")))
    for name in INVENTORY[1:]:
        rules.append(Rule(name, ~is_kind(member(item, f"$.{name}"), "missing", "null", "integer")))
    for name in FLAGS:
        rules.append(Rule(name, flag(item, f"$.{name}").isNull()))
    rules.append(Rule("last_reported", ~F.coalesce(integer(item, "$.last_reported") >= 0, F.lit(False))))
    rules.append(Rule("vehicle_types_available", ~is_kind(member(item, "$.vehicle_types_available"), "array")))
    vehicles = F.try_variant_get("item", "$.vehicle_types_available", "array<variant>")
    bad_vehicle = F.exists(
        vehicles,
        lambda v: (string(v, "$.vehicle_type_id").isNull()) | ~F.coalesce(integer(v, "$.count") >= 0, F.lit(False)),
    )
    rules.append(Rule("vehicle_type_entry", bad_vehicle))
    rules += [
        Rule(f"negative_{name}", integer(item, f"$.{name}") < 0, "warning") for name in INVENTORY
    ]
    return rules


def information_rules():
    """Row rules of the station information feed."""
    item = F.col("item")
    rules = [_text_rule("station_id"), Rule("name", string(item, "$.name").isNull())]
    for name, limit in (("lat", 90), ("lon", 180)):
        numeric = is_kind(member(item, f"$.{name}"), "integer", "number")
        rules.append(Rule(name, ~numeric))
        rules.append(Rule(f"{name}_range", F.abs(member(item, f"$.{name}", "double")) > limit, "warning"))
    rules.append(
        Rule(
            "capacity",
            ~is_kind(member(item, "$.capacity"), "missing", "null", "integer") | (integer(item, "$.capacity") <= 0),
            "warning",
        )
    )
    return rules


def vehicle_type_rules():
    """Row rules of the vehicle types feed."""
    item = F.col("item")
    rules = [_text_rule(name) for name in ("vehicle_type_id", "form_factor", "propulsion_type")]
    rules.append(Rule("name", ~is_kind(member(item, "$.name"), "missing", "null", "string")))
    rules.append(Rule("max_range_meters", ~is_kind(member(item, "$.max_range_meters"), "missing", "null", "integer", "number")))
    return rules


def information_table(rows):
    """Station information rows as provider columns for the canonical mapping."""
    item = F.col("item")

    def number(name):
        return F.when(is_kind(member(item, f"$.{name}"), "integer", "number"), member(item, f"$.{name}", "double"))

    return rows.withColumns(
        {
            "provider_station_id": string(item, "$.station_id"),
            "short_name": string(item, "$.short_name"),
            "name": string(item, "$.name"),
            "lat": number("lat"),
            "lon": number("lon"),
            "capacity": integer(item, "$.capacity").try_cast("int"),
            "region_id": string(item, "$.region_id"),
        }
    ).drop("item", "position")


def status_events(rows, ingested_at):
    """Status rows as station events; identity is still the provider's."""
    item = F.col("item")
    typed = rows.withColumns(
        {
            "provider_station_id": string(item, "$.station_id"),
            "snapshot_at": F.timestamp_seconds("last_updated"),
            "last_reported_at": F.timestamp_seconds(integer(item, "$.last_reported")),
            "ingested_at": ingested_at,
            "source_version": F.col("version"),
            **{name: integer(item, f"$.{name}").try_cast("int") for name in INVENTORY},
            **{name: flag(item, f"$.{name}") for name in FLAGS},
        }
    )
    return typed.withColumn("snapshot_at_local", city_clock(typed, "snapshot_at")).drop("item", "position", "version", "last_updated")


def status_warnings(rows):
    """Observable oddities that do not stop normalisation: count mismatch and negative inventory."""
    item = F.col("item")
    vehicles = F.try_variant_get("item", "$.vehicle_types_available", "array<variant>")
    total = F.aggregate(
        vehicles, F.lit(0).cast("long"), lambda acc, v: acc + F.coalesce(integer(v, "$.count"), F.lit(0).cast("long"))
    )
    bikes = integer(item, "$.num_bikes_available")
    entry = [
        F.when(bikes != total, F.struct(F.lit("vehicle_count_mismatch").alias("warning"), F.lit("num_bikes_available").alias("field"), bikes.alias("value"), total.alias("expected")))
    ]
    for name in INVENTORY:
        value = integer(item, f"$.{name}")
        entry.append(
            F.when(value < 0, F.struct(F.lit("negative_inventory").alias("warning"), F.lit(name).alias("field"), value.alias("value"), F.lit(None).cast("long").alias("expected")))
        )
    station = string(item, "$.station_id").alias("provider_station_id")
    return rows.select(station, F.inline(F.array_compact(F.array(*entry))))
