"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Token counts are summed once by cell (source, language, topic). Raking then scales the cells in turn to the target share of each
source, language and topic until all three marginals agree; a document's weight is its cell's raked tokens over its real ones.
One scale turns weights into inclusion probabilities min(1, scale * weight) whose expected tokens are KEEP of all tokens,
and a hash of the document's id decides.

Targets default to the observed share to the power TEMPER, normalised, so that large groups give way to small ones.
A topic is a column of the input if there is one, else the text's form (list, capitals, symbols, legal, short, prose).

Documents reach a shuffle only as partial sums by cell; the cells, not the documents, go through the rounds. A hot source is a few
cells. The join back is broadcast by Spark only at a measured size; else Spark splits hot cells.

Defined cases: null source, language or topic are groups of their own; null and empty texts have no tokens, weight 1 where their whole
cell has none, and are sampled like others; a null id is hashed as the empty text; rows that repeat an id are decided alike;
marginals that still do not fit after ROUNDS rounds, and a KEEP that the cells cannot reach, are reported as warnings; an empty table gives
an empty result; further columns are ignored (``weights``) or passed through (``sampled``).
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import staged, unstage

TEMPER = 0.7
KEEP = 0.8
TOLERANCE = 1e-5
ROUNDS = 50
SEED = "mix"
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"


def form_of(text: Column) -> Column:
    """The form of a text, as the default topic."""
    return (
        F.when(text.contains(" | "), "list")
        .when((F.length(text) > 20) & (F.upper(text) == text), "capitals")
        .when(text.contains("***") | text.contains("$$$"), "symbols")
        .when(text.rlike("(?i)rights reserved|licen[cs]ed? under|released under"), "legal")
        .when(F.length(text) < 500, "short")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """(row, doc_id, _source, _lang, _topic, _tokens, _u): all columns of ``docs`` in one, groups that are never null, and the place in [0, 1) that decides."""
    text = F.coalesce(F.col("text"), F.lit(""))
    topic = F.col("topic") if "topic" in docs.columns else form_of(text)
    words = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    tokens = F.when(words == "", 0).otherwise(F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1)
    mark = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    place = F.conv(F.substring(mark, 1, 13), 16, 10).cast("double") / float(16**13)
    group = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    groups = [group(c).alias(f"_{d}") for d, c in (("source", F.col("source")), ("lang", F.col("lang")), ("topic", topic))]
    return docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *groups, tokens.cast("long").alias("_tokens"), place.alias("_u"))


def cells_of(rows: DataFrame) -> DataFrame:
    keys = [F.col(f"_{d}").alias(d) for d in DIMENSIONS]
    return rows.groupBy(*keys).agg(F.sum("_tokens").cast("double").alias("tokens"), F.count("*").alias("docs"))


def targets_of(cells: DataFrame, dimension: str, temper: float = TEMPER) -> DataFrame:
    """(dimension, target): share of all tokens, summing to 1."""
    raised = cells.groupBy(dimension).agg(F.pow(F.sum("tokens"), F.lit(temper)).alias("t"))
    total = raised.agg(F.sum("t")).first()[0] or 1.0
    return raised.select(dimension, (F.col("t") / F.lit(total)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, rounds: int = ROUNDS) -> DataFrame:
    """The cells with ``mass``, whose marginals match ``targets`` (share of all tokens) as closely as the cells allow."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    start = cells.withColumn("mass", F.col("tokens"))
    for d, goal in targets.items():  # every cell carries its three targets, so that a round needs no other table
        start = start.join(goal.select(d, (F.col("target") * total).alias(f"goal_{d}")), d)
    now = staged(start, "cells")
    columns = now.columns
    for _ in range(rounds):
        step, factors = now.select(columns), []
        for d in targets:
            have = step.groupBy(d).agg(F.sum("mass").alias("have"))
            factor = F.when(F.col("have") > 0, F.col(f"goal_{d}") / F.col("have")).otherwise(1.0)
            step = step.join(have, d).withColumns({f"by_{d}": factor, "mass": F.col("mass") * factor}).drop("have")
            factors.append(F.abs(F.col(f"by_{d}") - 1))
        after = staged(step, "cells")
        unstage(now)
        now = after
        # All marginals fit when a whole round changes nothing.
        off = now.agg(F.max(F.greatest(*factors))).first()[0] or 0.0
        if off <= tolerance:
            break
    else:
        warnings.warn(f"raking stopped after {rounds} rounds; its last round still changed a cell by {off:.2g} of its mass, so the marginals do not all fit", stacklevel=2)
    return now.select(*cells.columns, "mass")


def scale_of(cells: DataFrame, keep: float) -> float:
    """The scale at which expected tokens, with probabilities cut at 1, are ``keep`` of all tokens."""
    low, high = 0.0, 1.0
    total, top = cells.agg(F.sum("tokens"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.greatest("mass", F.lit(1e-12))))).first()
    if not total or keep >= 1:
        return float("inf")
    high = float(top or 1.0)
    while True:  # each pass narrows the scale 32 times, with one aggregate over the cells
        grid = [low + (high - low) * i / 32 for i in range(33)]
        got = cells.agg(*[F.sum(F.least(F.col("tokens"), F.col("mass") * s)).alias(f"s{i}") for i, s in enumerate(grid)]).first()
        i = max(1, next((i for i, v in enumerate(got) if v >= keep * total), 32))
        low, high = grid[i - 1], grid[i]
        if got[32] < keep * total * (1 - TOLERANCE):
            warnings.warn(f"cells with mass hold only {got[32] / total:.4f} of all tokens, so {keep} of them cannot be kept", stacklevel=2)
            break
        # The expected share fits, or the scale has no more digits.
        if got[i] - keep * total <= TOLERANCE * total or high - low <= 1e-15 * high:
            break
    return high


def _joined(rows: DataFrame, keep: float, temper: float, targets: dict[str, DataFrame] | None) -> DataFrame:
    """``rows`` of ``described`` with _weight and _p."""
    cells = staged(cells_of(rows), "cells")
    raked = rake(cells, targets or {d: targets_of(cells, d, temper) for d in DIMENSIONS})
    scale = scale_of(raked, keep)
    weight = F.when(F.col("tokens") > 0, F.col("mass") / F.col("tokens")).otherwise(F.lit(1.0))
    chance = F.least(F.lit(1.0), weight * F.lit(scale)) if scale != float("inf") else F.lit(1.0)
    known = staged(raked.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], weight.alias("_weight"), chance.alias("_p")), "weights")
    return rows.join(known, [f"_{d}" for d in DIMENSIONS])


def weights(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, weight, probability, kept. The texts are read once."""
    columns = [F.col(f"_{d}").alias(d) for d in DIMENSIONS] + [F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight")]
    joined = _joined(staged(described(docs).drop("row"), "described"), keep, temper, targets)
    return joined.select("doc_id", *columns, F.col("_p").alias("probability"), (F.col("_u") < F.col("_p")).alias("kept"))


def sampled(docs: DataFrame, keep: float = KEEP, temper: float = TEMPER, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The sampled rows of ``docs``, all columns, and mix_weight, which replaces a column of that name. Texts are not shuffled: small cells come to them."""
    joined = _joined(described(docs), keep, temper, targets)
    columns = [F.col(f"row.{c}").alias(c) for c in docs.columns if c.lower() != "mix_weight"]
    return joined.where("_u < _p").select(*columns, F.col("_weight").alias("mix_weight"))
