"""Benchmark decontamination by CGK random walks and bit sampling, verified by exact edit distance.

Symbols are words (small letters, without symbols). A benchmark item of n words is contained in a document if some window of it is
within floor(EDITS * n) word insertions, deletions and replacements. Windows start at every word of every whole text:

1. The q-gram lemma on word pairs, or triples for items of twelve words or more, discards, without loss, windows that hold
   too few of the items' pairs or triples.
2. Every other window and every item go through WALKS random walks (Chakraborty, Goldenberg, Koucky): step j copies the
   current symbol and advances by a random bit of (j, symbol). Edit distance becomes Hamming distance.
3. REPEATS keys for each walk hash SAMPLE sampled steps; a window that shares a key with an item is a candidate.
4. The exact distance decides.

Walks of long items drift apart, so an item of more than SEGMENT words goes through steps 1 to 4 in segments of at most SEGMENT words.
Edits of a fifth of the item leave, by the pigeonhole principle, at least one segment with edits of at most a fifth of its own words. Around every
segment found, the exact distance of the whole item to any run of words decides.

With half of the steps equal, a pair shares none of the WALKS * REPEATS keys with probability (1 - 0.5**SAMPLE)**(WALKS * REPEATS),
under 0.001, so recall exceeds 0.99. The benchmark is the stated query set: it is read in blocks of bounded size, each block's index
travels to the tasks and meets all rows; nothing is shuffled and no key can be hot.

Defined cases: null and empty texts and items match nothing; an item of fewer than five words is matched exactly; repeated rows and items
are each reported; an empty table gives an empty result; further columns are ignored (``leaks``) or passed through (``without_leaks``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import byte_array, encoded, lowered, mixed, slices, span_hashes, word_bytes, words

EDITS = 0.2
WALKS, REPEATS, SAMPLE = 8, 8, 3
#: Text of benchmark items whose index is built and shipped at once.
BLOCK_BYTES = 8 << 20
#: Items of more words are looked for in segments of at most so many.
SEGMENT = 32
_INSIDE = word_bytes(False)
_MAP_BITS = 19


def _symbols(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(raw, at, _INSIDE)
    return span_hashes(lowered(raw), start, end), first


def _grams(h: np.ndarray, q: int) -> np.ndarray:
    """A place in the map of marks for every run of q words."""
    g = h[: max(0, len(h) - q + 1)]
    for j in range(1, q):
        g = mixed(g) + h[j : len(h) - q + 1 + j]
    return (mixed(g) >> np.uint64(64 - _MAP_BITS)).astype(np.int64)


def _walk(h: np.ndarray, start: np.ndarray, stop: np.ndarray, steps: int, walk: int, wanted: np.ndarray) -> np.ndarray:
    """The symbols that a random walk from every start copies at the ``wanted`` steps; zero beyond ``stop``."""
    out = np.zeros((len(wanted), len(start)), np.uint64)
    at, long = start.copy(), np.append(h, np.uint64(0))
    rows = {int(j): np.flatnonzero(wanted == j) for j in wanted}
    for j in range(steps):
        symbol = np.where(at < stop, long[np.minimum(at, len(h))], np.uint64(0))
        if j in rows:
            out[rows[j]] = symbol
        at = at + (mixed(symbol + np.uint64((walk * 100_003 + j) * 2 + 1)) >> np.uint64(63)).astype(np.int64)
    return out


def _keys(group: dict, h: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Key arrays of every window, one for each walk and repeat."""
    for walk in range(WALKS):
        wanted = group["wanted"][walk]
        got = _walk(h, start, stop, group["steps"], walk, wanted)
        for r in range(REPEATS):
            key = np.full(len(start), walk * REPEATS + r + 1, np.uint64)
            for row in got[r * SAMPLE : (r + 1) * SAMPLE]:
                key = mixed(key + row)
            yield key


def _last_row(item: np.ndarray, text: np.ndarray, anywhere: bool) -> np.ndarray:
    """Fewest word edits between the item and the words that end at each place of ``text``, from its start or from anywhere."""
    n = np.arange(len(text) + 1)
    row = np.zeros_like(n) if anywhere else n.copy()
    for i, word in enumerate(item):
        best = np.empty_like(row)
        best[0] = i + 1
        best[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        # Insertions run along the row: a running minimum of value minus place.
        row = np.minimum.accumulate(best - n) + n
    return row


def distance(item: np.ndarray, text: np.ndarray) -> int:
    """Fewest word edits between the item and any beginning of ``text``."""
    return int(_last_row(item, text, False).min())


def within(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest word edits between the item and any run of words of ``text``, and where such a run starts."""
    end = _last_row(item, text, True)
    d, stop = int(end.min()), int(end.argmin())
    back = _last_row(item[::-1], text[:stop][::-1], False)
    return d, stop - int(np.flatnonzero(back == d)[0])


def segments(n: int) -> list[tuple[int, int]]:
    """(first word, words) of an item's parts of nearly equal size; a shorter item is one part."""
    parts = 1 if n <= SEGMENT else -(-n // SEGMENT)
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def index_of(items: list, edits: float = EDITS) -> dict:
    """The index of (item_id, text) rows: word symbols, pair filter and LSH keys, by classes of similar length."""
    raw, at = encoded([t for _, t in items])
    h, first = _symbols(raw, at)
    whole = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    # From here on an item's parts take its place.
    parts = [(i, at, n) for i, item in enumerate(whole) for at, n in segments(len(item))]
    first = np.array([first[i] + at for i, at, _ in parts] + [len(h)])
    own = [h[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    size = np.diff(first)
    groups, lo = [], 0
    marks = {}
    rng = np.random.default_rng(3)
    for n in sorted(set(size.tolist()) - {0}):
        if n > 1.15 * lo or not groups or n < 5 or len(groups) > 60 and n > 2 * lo:
            groups.append({"lo": n, "of": []})
            lo = n
        groups[-1]["hi"] = n
        groups[-1]["of"] += np.flatnonzero(size == n).tolist()
    for g, group in enumerate(groups):
        group["reach"] = group["hi"] + int(edits * group["hi"])
        group["q"] = q = 3 if group["lo"] >= 12 else 2
        group["need"] = max(0, min(n + 1 - q - q * int(edits * n) for n in range(group["lo"], group["hi"] + 1)))
        group["steps"] = max(2, int(1.5 * group["lo"]))
        group["wanted"] = [rng.integers(0, group["steps"], REPEATS * SAMPLE) for _ in range(WALKS)]
        group["bit"] = np.uint64(g % 64)
        group["first"] = np.unique(h[np.concatenate([np.arange(first[i], first[i + 1]) for i in group["of"]])])
        held = marks.setdefault(q, np.zeros(1 << _MAP_BITS, np.uint64))
        for i in group["of"]:
            held[_grams(own[i], q)] |= np.uint64(1) << group["bit"]
        of = np.array(group["of"])
        keys = list(_keys(group, h, first[of], first[of + 1]))
        group["keys"] = [(k[o := np.argsort(k, kind="stable")], of[o]) for k in keys]
    return {"ids": [i for i, _ in items], "whole": whole, "parts": parts, "own": own, "marks": marks, "groups": groups, "edits": edits}


def _starts(group: dict, marked: dict, h: np.ndarray) -> np.ndarray:
    """Window starts that the pair filter leaves: enough known pairs or triples ahead. It drops no window within the edits, whatever its first word is."""
    one = (marked[group["q"]] >> group["bit"]) & np.uint64(1)
    hits = np.zeros(len(h) + group["reach"] + 1, np.int32)
    np.cumsum(one, out=hits[1 : len(h) + 1])
    hits[len(h) + 1 :] = hits[len(h)]
    # Runs that cross into the next text are not marked; those of the next text itself only weaken the filter.
    at = np.flatnonzero(hits[group["reach"] - group["q"] + 1 :][: len(h)] - hits[: len(h)] >= group["need"])
    if group["hi"] >= 5:
        return at
    # Without edits a window begins with the item's first word.
    place = np.minimum(np.searchsorted(group["first"], h[at]), len(group["first"]) - 1)
    return at[group["first"][place] == h[at]]


def matches(index: dict, raw: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) -> (least edits, first word of the best window), for whole texts."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for a, _, part, offsets in slices(raw, at):
        h, first = _symbols(part, offsets)
        if not len(h):
            continue
        size = np.diff(first)
        places: dict[tuple[int, int], list] = {}
        stop = np.repeat(first[1:], size)
        marked = {}
        for q, held in index["marks"].items():
            marked[q] = np.append(held[_grams(h, q)], np.zeros(min(q - 1, len(h)), np.uint64))
            marked[q][np.arange(len(h)) + q > stop] = 0  # a run across texts
        for group in index["groups"]:
            start = _starts(group, marked, h)
            if not len(start):
                continue
            pairs = set()
            for key, (known, of) in zip(_keys(group, h, start, stop[start]), group["keys"], strict=True):
                left, right = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                for w in np.flatnonzero(right > left):
                    pairs.update((int(start[w]), int(i)) for i in of[left[w] : right[w]])
            for s, i in sorted(pairs):
                item = index["own"][i]
                allowed = int(index["edits"] * len(item)) if len(item) >= 5 else 0
                text = int(np.searchsorted(first, s, "right")) - 1
                of, ahead, _ = index["parts"][i]
                parted = len(item) < len(index["whole"][of])
                if parted:
                    known = places.setdefault((text, of), [])
                    reach = int(index["edits"] * len(index["whole"][of]))
                    best = (allowed + 1, 0)
                    if any(abs(s - ahead - place) <= reach for place in known):
                        continue
                else:
                    best = found.get((text + a, of), (allowed + 1, 0))
                if best[0] == 0:
                    continue
                window = h[s : min(s + len(item) + allowed, int(first[text + 1]))]
                if np.isin(item, window).sum() < len(item) - allowed:  # each missing word costs an edit
                    continue
                d = distance(item, window)
                if d < best[0] and parted:
                    known.append(s - ahead)
                elif d < best[0]:
                    found[text + a, of] = (d, s - int(first[text]))
        for (text, of), known in places.items():
            item = index["whole"][of]
            allowed = int(index["edits"] * len(item))
            for place in sorted(known):
                # Edits before the segment, the segment's own and the places skipped above shift the item by less than three times its edits.
                low = max(int(first[text]), place - 3 * allowed)
                d, at_word = within(item, h[low : min(int(first[text + 1]), place + len(item) + 3 * allowed)])
                if d <= allowed and d < found.get((text + a, of), (allowed + 1, 0))[0]:
                    found[text + a, of] = (d, low + at_word - int(first[text]))
    return found


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """The index of each block of items; blocks have about ``limit`` bytes of text, however large the benchmark is."""
    items = benchmark.where("text IS NOT NULL").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // limit) or 1
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).collect()
        if rows:
            yield index_of(sorted((tuple(r) for r in rows), key=repr))


def leaks(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item it contains: doc_id, item_id, edits, n_words, first_word."""
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    kind += ", edits int, n_words int, first_word long"
    texts, out = docs.select("doc_id", "text"), None
    types = (pa.int64() if docs.schema["doc_id"].dataType.simpleString() == "bigint" else None, None)
    for index in blocks_of(benchmark, limit):

        def run(batches, index=index):
            for batch in batches:
                got = sorted(matches(index, *byte_array(batch.column(1))).items())
                ids = batch.column(0).to_pylist()
                columns = [[ids[t] for (t, _), _ in got], [index["ids"][i] for (_, i), _ in got]]
                rest = [[d for _, (d, _) in got], [len(index["whole"][i]) for (_, i), _ in got], [s for _, (_, s) in got]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], types[0] or batch.column(0).type), pa.array(columns[1])]
                    + [pa.array(v, t) for v, t in zip(rest, (pa.int32(), pa.int32(), pa.int64()), strict=True)],
                    names=["doc_id", "item_id", "edits", "n_words", "first_word"],
                ) if got else pa.RecordBatch.from_pydict({})

        part = texts.mapInArrow(_non_empty(run), kind)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], kind) if out is None else out


def _non_empty(run):
    def kept(batches):
        for batch in run(batches):
            if batch.num_rows:
                yield batch

    return kept


def without_leaks(docs: DataFrame, benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all columns, without the documents that contain a benchmark item."""
    for index in blocks_of(benchmark, limit):

        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[t for t, _ in matches(index, *byte_array(batch.column("text")))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
