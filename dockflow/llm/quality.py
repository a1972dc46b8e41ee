"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

A text is a bag of hashed words and word pairs. A word's symbols are cut off and are words of their own, so an ending
glued to invented words is one feature. A pair is hashed without order; a word that follows itself is therefore the same
feature whatever the word is. Counts are divided by the square root of their number, so length does not dominate.

The model is fitted on the driver from a sample of at most about 2 * PER_LABEL labelled texts (documented bound) and shipped to
the tasks by value; every whole text of every document is scored. Labels are learnt only from rows whose
crc32(doc_id) mod 5 is not 0. Ids, languages and sources never reach the model.

Defined cases: null and empty texts have no feature and get the model's base rate; without labels of both kinds the score
is the share of good labels (0.5 without any); repeated rows are scored alike; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import byte_array, held_out, in_slices, lowered, mixed, slices, span_hashes, word_bytes

PER_LABEL = 2500
BITS = 20
THRESHOLD = 0.3


def _kinds() -> np.ndarray:
    """0 white space, 1 letters, digits and non-ASCII bytes, 2 symbols."""
    kind = np.full(256, 2, np.uint8)
    kind[word_bytes(False)] = 1
    kind[~word_bytes(True)] = 0
    return kind


KIND = _kinds()


def features(raw: np.ndarray, at: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and pair occurrence, text after text, and the offsets of the texts."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    kind = KIND[raw]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    change = np.ones(n + 1, bool)
    change[1:n] = (kind[1:] != kind[:-1]) | cut[1:n]
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    real = kind[start] > 0
    start, end = start[real], end[real]
    small = lowered(raw)
    one = span_hashes(small, start, end)
    # Whether a word has capitals only is a property of the word.
    shape = (raw[start] >= 65) & (raw[start] <= 90) & (raw[end - 1] >= 65) & (raw[end - 1] <= 90) & (end - start > 1)
    one = one + shape.astype(np.uint64)
    first = np.searchsorted(start, at, "left")
    # Pairs of letter words only, so that glued symbols do not hide a repeated word.
    spell = np.flatnonzero(kind[start] == 1)
    pair = mixed(one[spell[1:]] ^ one[spell[:-1]])
    owner = np.searchsorted(first, spell, "right")
    within = owner[1:] == owner[:-1]
    buckets = np.concatenate([mixed(one), pair[within] + np.uint64(7)]) >> np.uint64(64 - bits)
    of = np.concatenate([np.searchsorted(first, np.arange(len(start)), "right"), owner[1:][within]]) - 1
    order = np.argsort(of, kind="stable")
    return buckets[order].astype(np.int64), np.searchsorted(of[order], np.arange(len(at)))


def scores(model: dict, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The probability of label 1 of every text."""
    out = np.empty(len(at) - 1)
    for first, last, part, offsets in slices(raw, at):
        bucket, rows = features(part, offsets, model["bits"])
        total = np.concatenate([[0.0], np.cumsum(model["w"][bucket], dtype=np.float64)])
        count = np.diff(rows)
        out[first:last] = (total[rows[1:]] - total[rows[:-1]]) / np.sqrt(np.maximum(count, 1)) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(sample: list, bits: int = BITS, passes: int = 3, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.2, l2: float = 1.0) -> dict:
    """Per-coordinate follow-the-regularised-leader (proximal) over (text, label, weight) rows in a fixed shuffled order."""
    weight = sum(w for *_, w in sample)
    good = sum(w for _, y, w in sample if y == 1)
    rate = good / weight if weight else 0.5
    model = {"w": np.zeros(1 << bits, np.float32), "bias": float(np.log((rate + 1e-3) / (1 - rate + 1e-3))), "bits": bits}
    if rate in (0.0, 1.0) or not sample:
        return model
    bucket, rows = in_slices(features, [t for t, *_ in sample], bits)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    order = np.random.default_rng(7)
    bias, bias_n = model["bias"], 1.0
    for _ in range(passes):
        for i in order.permutation(len(sample)):
            _, y, importance = sample[i]
            at, count = np.unique(bucket[rows[i] : rows[i + 1]], return_counts=True)
            x = count / np.sqrt(max(1, rows[i + 1] - rows[i]))
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -30, 30)))
            error = (p - y) * importance
            g = error * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
            bias_n += error * error
            bias -= 0.1 * error / np.sqrt(bias_n)
    model["w"] = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)
    model["bias"] = float(bias)
    return model


def weighted_sample(docs: DataFrame, labels: DataFrame, column: str, per_label: int, seed: int, extra: tuple = ()) -> list:
    """(text, label, weight, *extra): about ``per_label`` rows of both labels, with weights that restore their true shares.

    Ids are chosen first, from the small table of labels: at most about 2 * per_label reach the driver and are broadcast.
    """
    marks = labels.where(F.col(column).isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col(column).cast("int").alias("label"))
    counts = {0: 0, 1: 0} | {r[0]: r[1] for r in marks.groupBy("label").count().collect()}
    place = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND((1 << 30) - 1) / F.lit(float(1 << 30))
    share = {y: min(1.0, per_label / max(1, n)) for y, n in counts.items()}
    chosen = marks.where(place < F.when(F.col("label") == 1, share[1]).otherwise(share[0])).collect()
    few = docs.sparkSession.createDataFrame(chosen, marks.schema)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", *extra)
    rows = sorted((tuple(r) for r in texts.join(F.broadcast(few), "doc_id").select("text", "label", *extra).collect()), key=lambda r: r[:2])
    got = {y: max(1, sum(1 for r in rows if r[1] == y)) for y in (0, 1)}
    total = max(1, sum(counts.values()))
    return [(t, y, counts[y] / total * len(rows) / got[y], *more) for t, y, *more in rows]


def score_documents(docs: DataFrame, model: dict, scorer, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; ``scorer(model, bytes, offsets)`` works on whole texts."""

    def run(batches):
        for batch in batches:
            got = scorer(model, *byte_array(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """Quality of every document: doc_id, held_out, score, predicted (score >= 0.3)."""
    model = train(weighted_sample(docs, labels, "quality", per_label, 4))
    return score_documents(docs, model, scores, THRESHOLD)
