"""Toxicity: a convolutional text classifier over hashed words, trained in numpy, with thresholds by language.

Words and their beginnings of PREFIXES bytes are hashed into 2**BITS buckets; buckets seen in at least MIN_TEXTS labelled texts,
and in one of RARE, have an embedding, all others share the zero vector. A word's vector is the sum of its own and its beginnings', so rare forms of a
known word are not lost. Filters of widths 1, 2 and 3 run over the words, their largest value over the whole text is kept, and a
logistic layer follows. Thresholds are chosen on a fifth of the labelled texts that the network has not seen, one for each language,
and subtracted on the logit scale, so that 0.5 is the threshold everywhere. The language of a text is guessed from its words
by naive Bayes over the same buckets: the column ``lang`` is only learnt from, never an input of a score.

The model is fitted to every labelled text outside the held-out fold, in Spark: words are counted over all of them, shares of about SHARE
texts each learn in a task of their own from the same values, and these are averaged after every pass, which is one pass over
all labelled texts. The driver holds one network and no text. Every whole text of every document is scored. Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0.

Defined cases: null and empty texts are one window of zero vectors and get the score of no evidence; without labels of both
kinds the score is 0.5 shifted by the base rate, i.e. 0 without toxic labels; repeated rows are scored alike; further columns
are ignored (``scores``) or passed through (``without_toxic``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import bloom_settings, byte_array, held_out, lowered, mixed, settings, slices, span_hashes, staged, unstage, word_bytes, words
from dockflow.llm.quality import score_documents

#: Labelled texts that one task learns from between two averagings.
SHARE = 16000
BITS = 22
#: A bucket is known from so many texts on, and from one text in RARE.
MIN_TEXTS, RARE = 4, 1000
#: Text bytes whose words are worked on at once inside a task, each of which takes some hundred bytes then.
SLICE = 1 << 18
#: Values of the network that are averaged together.
CHUNK = 1 << 14
PREFIXES = (4, 6)
WIDTHS = (1, 2, 3)
FILTERS = 8
DEPTH = 12
THRESHOLD = 0.5
_INSIDE = word_bytes(False)
_PAD = max(WIDTHS) - 1


def buckets(raw: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, 1 + prefixes) hash buckets, -1 for a beginning that is the whole word, and the offsets of the texts."""
    start, end, first = words(raw, at, _INSIDE)
    small = lowered(raw)
    out = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = span_hashes(small, start, end) >> np.uint64(64 - bits)
    for i, size in enumerate(PREFIXES, 1):
        h = mixed(span_hashes(small, start, np.minimum(start + size, end)) + np.uint64(size))
        out[:, i] = np.where(end - start > size, (h >> np.uint64(64 - bits)).astype(np.int32), -1)
    return out, first


def rows_of(m: dict, bucket: np.ndarray) -> np.ndarray:
    """The embedding rows of buckets; 0, the zero vector, where there is none."""
    out = np.zeros(bucket.shape, m["row"].dtype)
    for i, column in enumerate(bucket.T):  # one column at a time, as indexing widens it
        out[:, i] = m["row"][column]
    out[bucket < 0] = 0
    return out


def _vectors(m: dict, rows: np.ndarray) -> np.ndarray:
    """Sum of the embeddings along the last axis of ``rows``."""
    return sum(m["e"][rows[..., i]] for i in range(rows.shape[-1]))


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows with zero words (row 0) after every text, each text's start, and which windows lie in one text."""
    n = len(first) - 1
    out = np.zeros((len(rows) + n * (_PAD + 1) + _PAD, rows.shape[1]), rows.dtype)
    owner = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(rows)) + owner * (_PAD + 1)] = rows
    start = first[:-1] + np.arange(n) * (_PAD + 1)
    inside = np.ones(len(out) - _PAD, bool)
    for j in range(_PAD):  # a text of n words has n + 1 windows, the last of them all zero
        inside[start + np.diff(first) + 1 + j] = False
    return out, start, inside


def _convolved(m: dict, rows: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Filter values of every window, all widths side by side; zero, the least value, for windows across texts."""
    e = _vectors(m, rows)
    n = len(rows) - _PAD
    parts = []
    for w in WIDTHS:
        k = m[f"k{w}"]
        parts.append(sum(e[j : j + n] @ k[j] for j in range(w)) + m[f"c{w}"])
    return np.maximum(np.concatenate(parts, axis=1), 0) * inside[:, None]


def texts_rows(m: dict, raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, embedding rows, offsets by text) of consecutive texts, slice by slice."""
    for a, b, part, offsets in slices(raw, at, SLICE):
        bucket, first = buckets(part, offsets, m["bits"])
        yield a, b, rows_of(m, bucket), first


def _logits(m: dict, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logit of every text less the threshold of the language that its words suggest."""
    out = np.empty(len(at) - 1)
    for a, b, rows, first in texts_rows(m, raw, at):
        long, start, inside = padded(rows, first)
        top = np.maximum.reduceat(_convolved(m, long, inside), start, axis=0)
        sums = np.concatenate([np.zeros((1, m["tongue"].shape[1])), np.cumsum(m["tongue"][rows[:, 0]], axis=0, dtype=np.float64)])
        tongue = (sums[first[1:]] - sums[first[:-1]] + m["prior"]).argmax(1)
        out[a:b] = top @ m["v"] + m["bias"] - m["cut"][tongue]
    return out


def scores(m: dict, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_logits(m, raw, at), -30, 30)))


def _adam(m: dict, state: dict, grads: dict, step: int, rate: float) -> None:
    for key, g in grads.items():
        if key not in state:
            state[key] = (np.zeros_like(m[key]), np.zeros_like(m[key]))
        a, b = state[key]
        a += 0.1 * (g - a)
        b += 0.01 * (g * g - b)
        m[key] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)


def _gradients(m: dict, long: np.ndarray, start: np.ndarray, inside: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict:
    conv = _convolved(m, long, inside)
    top = np.maximum.reduceat(conv, start, axis=0)
    size = np.diff(np.append(start, len(conv)))
    owner = np.repeat(np.arange(len(start)), size)
    # The first window that reaches the maximum takes the gradient.
    place = np.where(conv == top[owner], np.arange(len(conv))[:, None], len(conv))
    best = np.minimum.reduceat(place, start, axis=0)
    p = 1 / (1 + np.exp(-np.clip(top @ m["v"] + m["bias"], -30, 30)))
    error = (p - y) * importance / len(y)
    back = error[:, None] * m["v"] * (top > 0)
    out = {"v": (top.T @ error + 1e-4 * m["v"]).astype(np.float32), "bias": np.float32(error.sum()), "e": np.zeros_like(m["e"])}
    for i, w in enumerate(WIDTHS):
        at, g = best[:, i * FILTERS : (i + 1) * FILTERS], back[:, i * FILTERS : (i + 1) * FILTERS]
        gk = np.zeros_like(m[f"k{w}"])
        for j in range(w):
            rows = long[at + j]
            gk[j] = np.einsum("bfd,bf->df", _vectors(m, rows), g)
            back_e = g[:, :, None] * m[f"k{w}"][j].T[None]
            for c in range(rows.shape[-1]):
                np.add.at(out["e"], rows[..., c], back_e)
        out[f"k{w}"], out[f"c{w}"] = gk, g.sum(0).astype(np.float32)
    out["e"] += 1e-5 * m["e"]
    out["e"][0] = 0
    return out


def vocabulary(rows: DataFrame, bits: int, least: int) -> tuple[np.ndarray, np.ndarray, list]:
    """The buckets in at least ``least`` texts of ``rows`` (text, lang), ascending, how often each is a word by language, and the languages.

    Texts and words are counted in Spark; only the counts of the buckets that stay reach the driver.
    """

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, part, offsets in slices(*byte_array(batch.column(0))):
                bucket, first = buckets(part, offsets, bits)
                text = np.repeat(np.arange(b - a), np.diff(first))
                many = np.unique(((text[:, None] << bits) + bucket)[bucket >= 0])
                owner, many = many >> bits, many & ((1 << bits) - 1)
                for lang in set(langs[a:b]):
                    own = langs[a:b] == lang if lang is not None else np.array([v is None for v in langs[a:b]])
                    held, texts = np.unique(many[own[owner]], return_counts=True)
                    word, times = np.unique(bucket[own[text], 0], return_counts=True)
                    said = np.zeros(len(held), np.int64)
                    said[np.searchsorted(held, word)] = times
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(held.astype(np.int64)), pa.array([lang] * len(held), pa.string()), pa.array(texts), pa.array(said)], names=["bucket", "lang", "texts", "said"]
                    )

    counts = rows.select("text", F.col("lang").cast("string")).mapInArrow(run, "bucket bigint, lang string, texts bigint, said bigint")
    counts = staged(counts.groupBy("bucket", "lang").agg(F.sum("texts").alias("texts"), F.sum("said").alias("said")), "vocabulary")
    wide = counts.groupBy("bucket").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= least).select("bucket")
    known = np.sort(np.asarray(wide.toArrow().column("bucket"), np.int64))
    langs = sorted(r[0] for r in rows.select(F.col("lang").cast("string")).where("lang IS NOT NULL").distinct().collect())
    said = np.zeros((len(known), max(1, len(langs))))
    # A count takes a few bytes in the file and ten times that in a broadcast table.
    own = counts.join(wide.hint("merge"), "bucket").where("lang IS NOT NULL AND said > 0").select("bucket", "lang", "said").toArrow()
    place = {v: i for i, v in enumerate(langs)}
    said[np.searchsorted(known, np.asarray(own.column("bucket"), np.int64)), [place[v] for v in own.column("lang").to_pylist()]] = own.column("said")
    unstage(counts)
    return known, said, langs


def untrained(known: np.ndarray, said: np.ndarray, langs: list, texts_of: dict, rate: float, bits: int) -> dict:
    """The network before its first step; ``texts_of`` has the number of texts of every language, ``rate`` is the share of toxic ones."""
    rng = np.random.default_rng(5)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    m = {"bits": bits, "known": known.astype(np.int32), "e": draw(len(known) + 1, DEPTH, scale=0.1), "v": draw(FILTERS * len(WIDTHS), scale=0.3), "langs": langs}
    m["e"][0] = 0
    for w in WIDTHS:
        m[f"k{w}"], m[f"c{w}"] = draw(w, DEPTH, FILTERS, scale=(w * DEPTH) ** -0.5), np.zeros(FILTERS, np.float32)
    m["bias"] = np.float32(np.log((rate + 1e-4) / (1 - rate + 1e-4)))
    # Naive Bayes over the same rows: log share of a row in a language against all languages.
    tongue = np.concatenate([np.zeros((1, said.shape[1])), said]) + 1
    m["tongue"] = np.log(tongue / tongue.sum(0)).astype(np.float32)
    m["tongue"][0] = 0  # a rare word says nothing
    m["prior"] = np.log(np.array([texts_of.get(v, 0) for v in langs] or [0]) + 1.0)
    m["cut"] = np.zeros(max(1, len(langs)))
    return m


def with_rows(m: dict) -> dict:
    """The model with the table that leads from a bucket to its embedding row."""
    row = np.zeros(1 << m["bits"], np.min_scalar_type(len(m["known"])))  # as narrow as the vocabulary allows
    row[m["known"]] = np.arange(1, len(m["known"]) + 1)
    return m | {"row": row}


#: What steps change.
LEARNT = ("e", "v", "bias", *(f"{c}{w}" for w in WIDTHS for c in "kc"))


def trained(m: dict, texts: list, y: np.ndarray, turns: list, batch: int = 64) -> dict:
    """The learnt values after a pass over the texts, each an array of embedding rows, for each (number, rate) of ``turns``."""
    m = m | {key: np.array(m[key]) for key in LEARNT}
    state, step, weight = {}, 0, np.ones(len(y), np.float32)
    for number, rate in turns:
        learn = np.random.default_rng([7, number]).permutation(len(y))
        for at in range(0, len(learn), batch):
            ids = learn[at : at + batch]
            some = [texts[i] for i in ids]
            windows = padded(np.concatenate(some), np.concatenate([[0], np.cumsum([len(rows) for rows in some])]))
            step += 1
            _adam(m, state, _gradients(m, *windows, y[ids], weight[ids]), step, rate)
    return {key: np.asarray(m[key], np.float32) for key in LEARNT}


def _averaged(m: dict, shares: DataFrame, turns: list) -> dict:
    """``m`` after ``turns`` in each share (part, text, label); their values are averaged by their texts, in Spark.

    A share lies together in one file, in order, and is learnt by the task that reads it. A share that is read in two parts counts as two.
    Of a share only the embedding rows of its words stay in the task, not its texts.
    """

    def learn(batches):
        full = with_rows(m)
        texts, labels, now, total, n = [], [], None, 0.0, 0

        def flat():
            got = trained(m, texts, np.concatenate(labels), turns)
            return len(texts) * np.concatenate([got[key].reshape(-1) for key in LEARNT]).astype(np.float64)

        for batch in batches:
            part, label = np.asarray(batch.column(0)), np.asarray(batch.column(2), np.float32)
            raw, at = byte_array(batch.column(1))
            start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))[: len(part)]
            for a, b in zip(start, [*start[1:], len(part)], strict=False):  # no start in an empty batch
                if part[a] != now and texts:
                    total, n = total + flat(), n + len(texts)
                    texts, labels = [], []
                now = part[a]
                labels.append(label[a:b])
                for *_, rows, first in texts_rows(full, raw, at[a : b + 1]):
                    texts += np.split(rows, first[1:-1])
        if texts:
            total, n = total + flat(), n + len(texts)
        if n:
            values = (total / n).astype(np.float32)
            cut = range(0, len(values), CHUNK)
            yield pa.RecordBatch.from_pydict({"chunk": list(range(len(cut))), "n": [n] * len(cut), "v": [values[i : i + CHUNK].tobytes() for i in cut]})

    def mean(chunk: pa.Table) -> pa.Table:
        n = np.asarray(chunk.column("n"), np.float64)
        values = np.stack([np.frombuffer(v, np.float32) for v in chunk.column("v").to_pylist()])
        return pa.table({"chunk": chunk.column("chunk")[:1], "n": pa.array([int(n.sum())]), "v": pa.array([((n[:, None] * values).sum(0) / n.sum()).astype(np.float32).tobytes()])})

    schema = "chunk bigint, n bigint, v binary"
    done = shares.mapInArrow(learn, schema).groupBy("chunk").applyInArrow(mean, schema)
    flat = np.frombuffer(b"".join(r[1] for r in sorted(tuple(r) for r in done.select("chunk", "v").collect())), np.float32)
    out, at = dict(m), 0
    for key in LEARNT:
        size = np.size(m[key])
        out[key] = flat[at : at + size].reshape(np.shape(m[key])).copy() if np.ndim(m[key]) else np.float32(flat[at])
        at += size
    return out


def _calibrated(m: dict, rows: DataFrame) -> dict:
    """For each language the logit that gives the best F1 on unseen rows; of all rows where a language has few toxic ones.

    Rows are counted in Spark by language, label and the number of grid values below their logit.
    """
    grid = np.linspace(-3, 3, 61)
    full = with_rows(m)

    def run(batches):
        for batch in batches:
            above = np.searchsorted(grid, _logits(full, *byte_array(batch.column(0))), "left")
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(above.astype(np.int32))], names=["lang", "label", "above"])

    counts = np.zeros((len(m["langs"]) + 1, 2, len(grid) + 1))
    found = rows.select("text", F.col("lang").cast("string"), "label").mapInArrow(run, "lang string, label int, above int").groupBy("lang", "label", "above").count()
    for lang, label, above, n in found.collect():
        counts[m["langs"].index(lang) if lang in m["langs"] else -1, label, above] += n

    def best(of: np.ndarray) -> float:
        # Said at cut i are the rows with more than i grid values below their logit.
        said = of[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
        f1 = 2 * said[1] / np.maximum(1e-9, said.sum(0) + of[1].sum())
        top = grid[f1 >= f1.max() - 1e-9]
        return float(top[np.abs(top).argmin()])

    overall = best(counts.sum(0))
    cut = [best(c) if c[1].sum() >= 20 else overall for c in counts[: len(m["langs"])]]
    return m | {"cut": np.array(cut or [overall])}


def model_of(docs: DataFrame, labels: DataFrame, bits: int = BITS, passes: int = 3, batch: int = 64, least_steps: int = 500) -> dict:
    """The network fitted to every labelled text outside the held-out fold, in at least ``least_steps`` steps; every fifth is kept for the thresholds."""
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    text = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string"))
    # Most documents have no label: a Bloom filter keeps their texts out of the shuffle. The others are shuffled once, as the join's partitions are
    # the shares. The id deals the rows and a hash of text and id orders them, whatever the partitions of the tables are.
    spark, dealt = docs.sparkSession, bloom_settings(marks.count())
    with settings(spark, dealt):
        parts = max(1, -(-text.select("doc_id").join(marks, "doc_id").count() * 4 // (5 * SHARE)))
    with settings(spark, dealt | {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        place, part = F.xxhash64("text", "doc_id", F.lit(3)).alias("place"), F.pmod(F.hash("doc_id"), F.lit(parts)).alias("part")
        joined = text.join(marks, "doc_id").select(part, place, "text", "label", "lang")
        rows = staged(joined.sortWithinPartitions("part", "place", "label"), "labelled")
    n, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    texts_of = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    m = untrained(*vocabulary(rows, bits, max(MIN_TEXTS, n // RARE)), texts_of, toxic / n if n else 0.0, bits)
    if not 0 < toxic < n:
        unstage(rows)
        return with_rows(m | {"v": np.zeros_like(m["v"])})
    kept = F.pmod(F.col("place"), F.lit(5)) == 0
    shares = rows.where(~kept).select("part", "text", "label")
    count = shares.count()
    passes = max(passes, -(-least_steps * batch // max(1, count)))
    turns = [(t, 0.01 if t + 1 <= 0.75 * passes else 0.003) for t in range(passes)]
    # One share takes all its passes at once; several meet after every pass.
    for some in [turns] if parts == 1 else [[t] for t in turns]:
        m = _averaged(m, shares, some)
    m = _calibrated(m, rows.where(kept))
    unstage(rows)
    return with_rows(m)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted (score >= 0.5)."""
    return score_documents(docs, model_of(docs, labels), scores, THRESHOLD)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose whole text scores 0.5 or more."""
    model = model_of(docs, labels)

    def run(batches):
        for batch in batches:
            # Slice by slice, so that no second batch of texts is held.
            for a, b, part, at in slices(*byte_array(batch.column("text"))):
                yield batch.slice(a, b - a).filter(pa.array(scores(model, part, at) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
