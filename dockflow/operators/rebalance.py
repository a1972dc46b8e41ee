"""Rebalancing: feasible ends, integer needs, and the greedy assignment per snapshot."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.functions.status import usable
from dockflow.operators.greedy import END, OUTPUT, assign_batches
from dockflow.operators.quality import named_counts

ENDS = (
    "station_id", "role", "bikes", "docks", "lat", "lon", "need", "supply", "source_safe", "target_safe", "expires_at",
)


def feasible(risk):
    """Stations that may give or take bikes at all."""
    return risk.where(
        (F.col("capacity") > 0)
        & F.col("lat").isNotNull()
        & F.col("lon").isNotNull()
        & (F.col("bikes") >= 0)
        & (F.col("docks") >= 0)
        & usable(F.col("current_status"))
        & F.col("projected_bikes_1h").isNotNull()
    )


def with_needs(risk):
    """Integer need, supply and safe amounts.

    Need and supply follow the forecast and nominal capacity in double arithmetic;
    the safe amounts follow present bikes and docks in exact integers.
    """
    capacity, projected = F.col("capacity").cast("long"), F.col("projected_bikes_1h")
    present = F.col("bikes").cast("long") + F.col("docks")

    def at_least_zero(value):
        return F.greatest(value.cast("long"), F.lit(0).cast("long")).cast("int")

    return risk.withColumns(
        {
            "need": at_least_zero(F.ceil((capacity * 3).cast("double") / F.lit(10.0) - projected)),
            "supply": at_least_zero(F.floor(projected - (capacity * 7).cast("double") / F.lit(10.0))),
            "source_safe": at_least_zero(F.col("bikes") - F.floor((present * 3 + 9) / 10)),
            "target_safe": at_least_zero(F.floor(present * 7 / 10) - F.col("bikes")),
        }
    )


def rebalance_ends(risk, snapshot="snapshot_at"):
    """Shortage targets and overflow sources with something to move, a few narrow columns each."""
    role = F.when(F.col("forecast_status") == "SHORTAGE_RISK", "target").when(
        F.col("forecast_status") == "OVERFLOW_RISK", "source"
    )
    ends = with_needs(feasible(risk)).withColumn("role", role).where("role IS NOT NULL")
    return ends.select(snapshot, *ENDS)


def active_ends(ends):
    """Drop ends that can never move a bike, before anything is grouped."""
    target = (F.col("role") == "target") & (F.least("need", "docks", "target_safe") > 0)
    source = (F.col("role") == "source") & (F.least("supply", "bikes", "source_safe") > 0)
    return ends.where(target | source)


def target_order(ends, snapshot="snapshot_at"):
    """Targets in service order: greatest need first, then station id."""
    order = F.expr(f"row_number() OVER (PARTITION BY {snapshot} ORDER BY need DESC, station_id)")
    return ends.where("role = 'target'").withColumn("target_rank", order)


def snapshot_station_counts(observations, snapshot="snapshot_at"):
    """Stations of every snapshot; a size is reported, never a reason to refuse."""
    return observations.groupBy(snapshot).agg(F.count("*").alias("stations"))


def ordered_ends(ends, snapshot="snapshot_at"):
    """Active ends by snapshot: its sources by id, then its targets in service order.

    Rows are sorted, not collected: the assignment holds the open sources of one snapshot and meets the targets one by one. Snapshots
    without a counterpart stay behind.
    """
    target = F.col("role") == "target"
    rows = active_ends(ends).withColumns(
        {
            "is_target": target,
            "amount": F.when(target, F.col("need")).otherwise(F.col("supply")),
            "room": F.when(target, F.least("need", "docks", "target_safe")).otherwise(F.least("supply", "bikes", "source_safe")),
        }
    )
    both = rows.groupBy(snapshot).agg(F.bool_or("is_target").alias("targets"), F.bool_or(~F.col("is_target")).alias("sources"))
    used = rows.join(both.where("targets AND sources").select(snapshot), snapshot, "left_semi")
    order = [F.col(snapshot), F.col("is_target"), F.when(F.col("is_target"), -F.col("amount")), F.col("station_id")]
    return used.select(snapshot, *END).repartition(snapshot).sortWithinPartitions(*order)


def rebalance(ends, snapshot="snapshot_at"):
    """Suggested moves with global priority per snapshot.

    The greedy rule is sequential inside a snapshot and independent across
    snapshots, so snapshots are the unit of parallelism; no pair of stations is
    ever materialised as a row.
    """
    kinds = {f.name: f.dataType for f in ends.schema.fields}
    schema = T.StructType(
        [T.StructField(snapshot, kinds[snapshot])]
        + [T.StructField(n, T.StringType()) for n in OUTPUT[:2]]
        + [T.StructField(n, T.IntegerType()) for n in OUTPUT[2:7]]
        + [T.StructField("expires_at", kinds["expires_at"])]
    )
    return ordered_ends(ends, snapshot).mapInPandas(lambda batches: assign_batches(batches, snapshot), schema)


def with_suggestion_id(suggestions, snapshot_id="snapshot_id"):
    return suggestions.withColumn("suggestion_id", F.concat_ws(":", snapshot_id, "priority"))


def suggestion_breaches(suggestions, ends, snapshot="snapshot_at"):
    """Counts of broken promises per rule; all zero for a correct assignment.

    Each suggestion is unfolded into the five things it must be consistent with
    (source, target, pair, rank, snapshot), so the solver runs once.
    """

    def part(kind, first=None, second=None):
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("role"),
            (F.col(first).cast("string") if first else nothing).alias("station_id"),
            (F.col(second) if second else nothing).alias("other"),
        )

    parts = F.array(
        part("source", "from_station_id"),
        part("target", "to_station_id"),
        part("pair", "from_station_id", "to_station_id"),
        part("rank", "priority"),
        part("snapshot"),
    )
    folded = (
        suggestions.select(snapshot, "move_bikes", "priority", F.inline(parts))
        .groupBy(snapshot, "role", "station_id", "other")
        .agg(
            F.sum("move_bikes").alias("moved"),
            F.count("*").alias("rows"),
            F.count_if(F.col("move_bikes") <= 0).alias("not_positive"),
            F.min("priority").alias("low"),
            F.max("priority").alias("high"),
        )
    )
    limits = ends.select(
        snapshot, "role", "station_id",
        F.when(F.col("role") == "source", F.least("supply", "source_safe", "bikes"))
        .otherwise(F.least("need", "target_safe", "docks")).alias("limit"),
    )
    checked = folded.join(limits, [snapshot, "role", "station_id"], "left")
    role = F.col("role")
    beyond = F.col("limit").isNull() | (F.col("moved") > F.col("limit"))
    rules = {
        "positive_move": (role == "pair") & (F.col("not_positive") > 0),
        "unique_pair": (role == "pair") & (F.col("rows") > 1),
        "source_limit": (role == "source") & beyond,
        "target_limit": (role == "target") & beyond,
        "priority_sequence": ((role == "rank") & (F.col("rows") > 1))
        | ((role == "snapshot") & ((F.col("low") != 1) | (F.col("high") != F.col("rows")))),
    }
    return named_counts(checked, rules, "rule", "violations")


def usable_suggestions(suggestions, risk_now, as_of, snapshot="snapshot_at"):
    """Unexpired suggestions whose two stations are still usable at read time."""
    open_ends = risk_now.where(usable(F.col("current_status")))
    return _both_ends(suggestions.where(F.col("expires_at") > as_of), open_ends, snapshot)


def dispatchable_suggestions(suggestions, flagged, as_of, snapshot="snapshot_at"):
    """The map's stricter filter: both stations must also be dispatchable."""
    return _both_ends(suggestions.where(F.col("expires_at") > as_of), flagged.where("can_dispatch"), snapshot)


def _both_ends(suggestions, open_ends, snapshot):
    out = suggestions
    for side in ("from_station_id", "to_station_id"):
        ids = open_ends.select(snapshot, F.col("station_id").alias(side))
        out = out.join(ids, [snapshot, side], "left_semi")
    return out.select(*suggestions.columns)
