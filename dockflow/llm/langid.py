"""Language identification: a bidirectional gated recurrent network over bytes, written in numpy.

A text's bytes are cut into windows of SPAN bytes; two gated recurrent layers read every window from both ends, and a softmax
over the languages labels every position. A document's probabilities are the mean over all its letter positions of all its windows. The
network is trained on the driver by backpropagation through time on windows of a sample of about PER_LANG texts for each
language at most (documented bound); prediction covers every byte of every text. Only rows whose crc32(doc_id) mod 3 is not 1
are learnt from; ids, sources and languages are never inputs of a prediction.

Defined cases: a null text or one without a letter gets ``und`` and score 0; without a labelled text every text with letters
gets ``und`` and 0; a single language wins with score 1; repeated rows are predicted alike; further columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import byte_array, encoded, held_out, sample_texts, slices

PER_LANG = 400
SPAN = 64
HIDDEN = 8
#: Windows that one step of the network takes together.
GROUP = 2048
PAD = 256
UNKNOWN = "und"
_LETTER = np.zeros(257, bool)
for _a, _b in ((65, 91), (97, 123), (128, 256)):
    _LETTER[_a:_b] = True


def windows(raw: np.ndarray, at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(span, n) symbols, PAD beyond a text's end, and the text of every window."""
    count = -(-np.diff(at) // span)
    owner = np.repeat(np.arange(len(count)), count)
    begin = at[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * span
    place = begin[None, :] + np.arange(span)[:, None]
    symbols = np.concatenate([raw, np.zeros(1, np.uint8)])[np.minimum(place, len(raw))].astype(np.int64)
    symbols[place >= at[1:][owner][None, :]] = PAD
    return symbols, owner


def _soft(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: the squashing function, several times cheaper here than tanh."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def _run(p: dict, side: int, x: np.ndarray, keep: bool):
    """States (steps, HIDDEN, n) of one direction; the gates too if ``keep`` (for training)."""
    h = np.zeros((HIDDEN, x.shape[1]), np.float32)
    states, saved = [None] * len(x), [None] * len(x)
    w, u = p["w"][side], p["u"][side]
    g = np.empty((3 * HIDDEN, x.shape[1]), np.float32)
    for t in range(len(x)) if side == 0 else range(len(x) - 1, -1, -1):
        np.take(w, x[t], axis=1, out=g, mode="clip")
        a = u @ h
        zr, inner = _soft(g[: 2 * HIDDEN] + a[: 2 * HIDDEN]), a[2 * HIDDEN :]
        zr += 1
        zr *= 0.5
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        c = r * inner
        c += g[2 * HIDDEN :]
        _soft(c)
        if keep:
            saved[t] = (h, z, r, c, inner)
        h = h - c
        h *= z
        h += c
        states[t] = h
    return states, saved


def probabilities(p: dict, x: np.ndarray):
    """Softmax over the languages at every position, step after step: (languages, n)."""
    forward, backward = _run(p, 0, x, False)[0], _run(p, 1, x, False)[0]
    for t in range(len(x)):
        y = p["o"][:, :HIDDEN] @ forward[t]
        y += p["o"][:, HIDDEN:] @ backward[t]
        y += p["b"][:, None]
        y -= y.max(0)
        np.exp(y, out=y)
        y /= y.sum(0)
        yield y


def _step(p: dict, x: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
    """Gradients of the mean cross-entropy over all letter positions, backwards through time."""
    states = [_run(p, side, x, True) for side in (0, 1)]
    n, some = len(x), max(1, int(_LETTER[x].sum()))
    g = {k: np.zeros_like(v) for k, v in p.items()}
    back = [[None] * n, [None] * n]
    loss = 0.0
    for t in range(n):
        both = np.concatenate([states[0][0][t], states[1][0][t]])
        y = p["o"] @ both + p["b"][:, None]
        y -= y.max(0)
        y = np.exp(y)
        y /= y.sum(0)
        mask = _LETTER[x[t]]
        loss -= float(np.log(y[label, np.arange(len(label))] + 1e-9) @ mask)
        y[label, np.arange(len(label))] -= 1
        y *= mask / some
        g["o"] += y @ both.T
        g["b"] += y.sum(1)
        d = p["o"].T @ y
        back[0][t], back[1][t] = d[:HIDDEN], d[HIDDEN:]
    for side in (0, 1):
        u, dh = p["u"][side], np.zeros((HIDDEN, x.shape[1]), np.float32)
        for t in range(n - 1, -1, -1) if side == 0 else range(n):
            h, z, r, c, a = states[side][1][t]
            dh = dh + back[side][t]
            dc = dh * (1 - z) * (1 - np.abs(c)) ** 2
            dz = dh * (h - c) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            dr = dc * a * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            inner = np.concatenate([dz, dr, dc])
            np.add.at(g["w"][side].T, x[t], inner.T)
            inner = np.concatenate([dz, dr, dc * r])
            g["u"][side] += inner @ h.T
            dh = dh * z + u.T @ inner
    return g, loss / some


def train(sample: list, steps: int = 500, batch: int = 256, seed: int = 11) -> dict:
    """Fit the network to (text, language) rows; languages have equal weight."""
    langs = sorted({lang for _, lang in sample})
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {
        "w": draw(2, 3 * HIDDEN, 257, scale=0.3), "u": draw(2, 3 * HIDDEN, HIDDEN, scale=HIDDEN**-0.5),
        "o": draw(max(1, len(langs)), 2 * HIDDEN, scale=0.3), "b": np.zeros(max(1, len(langs)), np.float32),
    }
    model = {"p": p, "langs": langs}
    if len(langs) < 2:
        return model
    x, owner = windows(*encoded([t for t, _ in sample]))
    label = np.array([langs.index(lang) for _, lang in sample])[owner]
    of = [np.flatnonzero(label == i) for i in range(len(langs))]
    of = [a for a in of if len(a)]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    for i in range(1, steps + 1):
        pick = np.concatenate([rng.choice(a, max(1, batch // len(of))) for a in of])
        g, _ = _step(p, x[:, pick], label[pick])
        size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * min(1.0, 2 * (1 - i / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / (size + 1e-9))
            a, b = moment[k]
            a += 0.1 * (v - a)
            b += 0.01 * (v * v - b)
            p[k] -= rate * (a / (1 - 0.9**i)) / (np.sqrt(b / (1 - 0.99**i)) + 1e-8)
    return model


def predict(model: dict, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, languages): mean probabilities over each text's letter positions, zero without any."""
    out = np.zeros((len(at) - 1, max(1, len(model["langs"]))))
    letters = np.zeros(len(at) - 1)
    # A slice is cut into groups of windows, so the working set is bounded however long a text is.
    for a, b, part, offsets in slices(raw, at):
        step = GROUP * SPAN
        for i in range(a, b) if len(part) > step and b - a == 1 else [None]:
            spans = [(0, len(part))] if i is None else [(s, min(s + step, len(part))) for s in range(0, len(part), step)]
            for s, e in spans:
                own = offsets if i is None else np.array([0, e - s])
                x, owner = windows(part[s:e], own)
                for c in range(0, x.shape[1], GROUP):
                    y, mask = x[:, c : c + GROUP], _LETTER[x[:, c : c + GROUP]]
                    got = np.zeros((out.shape[1], y.shape[1]), np.float32)
                    for t, q in enumerate(probabilities(model["p"], y)):
                        q *= mask[t]
                        got += q
                    np.add.at(out, owner[c : c + GROUP] + (a if i is None else i), got.T)
                    np.add.at(letters, owner[c : c + GROUP] + (a if i is None else i), mask.sum(0))
    return out / np.maximum(letters, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)


def language(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score."""
    learn = docs.where(~held_out(F.col("doc_id"), 3, 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = train(sample_texts(learn.select("text", F.col("lang").alias("label")), "label", per_lang, 1))
    langs = model["langs"]

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            raw, at = byte_array(column)
            p = predict(model, raw, at)
            best, score = p.argmax(1), p.max(1)
            # ASCII letters are counted by the network's mask; only texts without any need a look at their characters.
            ascii_letter = ((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122))
            total = np.concatenate([[0], np.cumsum(ascii_letter)])
            known = total[at[1:]] - total[at[:-1]] > 0
            for i in np.flatnonzero(~known):
                known[i] = has_letter(column[int(i)].as_py())
            known &= len(langs) > 0
            said = [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(np.clip(np.where(known, score, 0.0), 0, 1))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
