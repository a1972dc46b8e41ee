"""Spelling variants: frequent words one edit apart, found with PartEnum signatures.

Two words one edit apart have letter multisets that, as binary vectors over (letter, occurrence), differ in one place (a letter more or less) or in two (a
letter replaced). The dimensions are dealt into groups; of GROUPS groups at least GROUPS - 2 agree for a replacement, and of two groups at least one
agrees for an insertion. So every choice of that many groups gives a signature, and near words share one of them exactly. A signature also
holds the length and the half of the word that the edit leaves as it is, the front or the back one, which is just as exact and keeps common letters
from crowding a signature. Words are joined on equal signatures and every pair is verified by its edit distance. No signature is capped.

Words are counted in the tasks before anything is shuffled. The largest of a word's near words is its form, if it is RATIO times as frequent; counts grow along
the way, so roots follow from a few rounds of pointer doubling. Forms that very many words share are salted.

Defined cases: a null text has no words; a null doc_id counts as the empty string in the hash; repeated rows count each; a text or run of any
length is read whole; ties between forms go to the smallest in code-point order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.common import byte_array, looked_up, mixed, staged, unstage

LETTERS = 7
OCCURRENCES = 2
RATIO = 10
#: One in so many (document, run) pairs loses a letter.
DAMAGED = 31
GROUPS = 4
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LETTERS},}}")
#: Counters that a task holds at once, and matches of one long text that are counted at once.
_HELD = 1 << 18
_MATCHES = 1 << 16


def _counted(text: str):
    """Counters of the runs of a text, in parts if it is long; a part is not read twice."""
    if len(text) < _MATCHES:
        yield Counter(_RUN.findall(text))
        return
    part = Counter()
    for i, m in enumerate(_RUN.finditer(text), 1):
        part[m[0]] += 1
        if i % _MATCHES == 0:
            yield part
            part = Counter()
    yield part


def add_words(counts: Counter, doc_id: str, text: bytes) -> None:
    """Count a text's words; of some (document, run) pairs, chosen by their hash, the words are the runs without one letter."""
    seed = zlib.crc32(f"{doc_id}:".encode())
    for part in _counted(text.lower().decode("utf-8", "replace")):
        for run, n in part.items():
            h = zlib.crc32(run.encode(), seed)
            if h % DAMAGED == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < LETTERS:
                    continue
            counts[run] += n


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of every word that occurs at least OCCURRENCES times."""

    def batch_of(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        counts = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            raw, at = byte_array(batch.column(1))
            for i in range(batch.num_rows):
                add_words(counts, ids[i], raw[at[i] : at[i + 1]].tobytes())
                if len(counts) >= _HELD:
                    yield batch_of(counts)
                    counts = Counter()
        yield batch_of(counts)

    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _letters(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, and each word's first place."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return cp, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def _group_hashes(cp: np.ndarray, at: np.ndarray, groups: int) -> np.ndarray:
    """The hash of each word's (letter, occurrence) set in each group of dimensions."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((cp, word))
    c, w = cp[order], word[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    occurrence = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
    dimension = mixed((c << np.uint64(32)) + occurrence.astype(np.uint64) + np.uint64(1))
    out = np.zeros((len(at) - 1, groups), np.uint64)
    np.add.at(out, (w, ((dimension >> np.uint64(20)) % np.uint64(groups)).astype(np.int64)), dimension)
    return out


def _halves(cp: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word's front and back half, where ``left`` letters are left by an edit: left // 2 from the front, the rest from the back."""
    length = np.diff(at)
    place = (np.arange(len(cp)) - np.repeat(at[:-1], length)).astype(np.uint64)
    back = (np.repeat(at[1:], length) - np.arange(len(cp))).astype(np.uint64)
    total = np.zeros((2, len(cp) + 1), np.uint64)
    for side, p in enumerate((place, back)):
        np.cumsum(mixed(cp + (p << np.uint64(32)) + np.uint64(side + 1)), out=total[side, 1:])
    n = left // 2
    return total[0][at[:-1] + n] - total[0][at[:-1]], total[1][at[1:]] - total[1][at[1:] - (left - n)]


def signatures(texts: list, replaced: bool, longer: bool) -> np.ndarray:
    """(word, signature): for a replaced letter; else for a letter more, of the words as the longer or the shorter ones."""
    cp, at = _letters(texts)
    length = np.diff(at)
    left = length if replaced or not longer else length - 1
    groups = _group_hashes(cp, at, GROUPS if replaced else 2)
    choices = list(combinations(range(groups.shape[1]), groups.shape[1] - (2 if replaced else 1)))
    out = []
    for side, half in enumerate(_halves(cp, at, left)):
        for number, choice in enumerate(choices):
            own = sum((mixed(groups[:, g] + np.uint64(g + 1)) for g in choice), mixed(half + np.uint64(side + 1)))
            out.append(mixed(own + mixed(left.astype(np.uint64) * np.uint64(1024) + np.uint64(64 * side + 2 * number + replaced))))
    return np.stack(out, axis=1) if out else np.zeros((0, 0), np.uint64)


def _signed(vocabulary: DataFrame, longer: bool) -> DataFrame:
    """(signature, replaced, word, n), the words taken as the longer or the shorter ones of a pair with a letter more."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(0).to_pylist()
            for replaced in (True, False):
                keys = signatures(texts, replaced, longer)
                row = np.repeat(np.arange(len(texts)), keys.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.full(len(row), replaced)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))],
                    names=["signature", "replaced", "word", "n"],
                )

    return vocabulary.select("word", "n").mapInArrow(run, "signature bigint, replaced boolean, word string, n bigint")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of every two words one edit apart, each pair once."""
    named = lambda df, c: df.select("signature", "replaced", F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    met = named(_signed(vocabulary, False), "a").join(named(_signed(vocabulary, True), "b"), ["signature", "replaced"])
    close = met.where((~F.col("replaced") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return close.select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by pointer doubling."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        sizes = now.groupBy("root").agg(F.count("*").alias("size"))
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further")).join(sizes, "root")
        step = looked_up(now, further, "root", "size", now.count(), ["word"])
        after = staged(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        unstage(now)
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    vocabulary = staged(words(docs), "words")
    pairs = staged(near_pairs(vocabulary), "near")
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), "b")).alias("best")
    near = pairs.select("a", "b", "n_b").unionByName(turned).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    form = F.when(-F.col("best.less") >= RATIO * F.col("n"), F.col("best"))
    listed = vocabulary.join(near, "word", "left").withColumn("of", form)
    listed = staged(listed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("of.b").alias("form"), (-F.col("of.less")).alias("form_n")), "forms")
    roots = _roots(listed.where("form IS NOT NULL"))
    unstage(vocabulary, pairs)
    return listed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: CRC-32 of a list of bytes, as SQL over ``{bytes}``.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {bytes}), lambda c, b:
  list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

_BYTES = """flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
  lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, (unicode(ch) - 64)::BIGINT] END))"""

ORACLE_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {CRC32_SQL.format(bytes=_BYTES)} AS h FROM counted),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS most FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * n THEN other END AS form, CASE WHEN most >= 10 * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk AS (
  SELECT word, word AS root, form AS further FROM forms
  UNION ALL SELECT w.word, w.further, f.form FROM walk w JOIN forms f ON f.word = w.further)
SELECT forms.*, root FROM forms JOIN walk USING (word) WHERE further IS NULL
"""
