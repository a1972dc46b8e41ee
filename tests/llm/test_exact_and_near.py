"""Exact, near and suffix de-duplication against brute force on small tables with every odd case."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from dockflow.llm import exact_dedup, simhash, similar, suffix_dedup, toxicity


def odd_rows():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(160), text(300)
    rows = [(i, text(rng.randint(1, 260))) for i in range(60)]
    rows += [(100 + i, f"{text(20)} {passage} {text(20)}") for i in range(12)]
    rows += [(200 + i, base) for i in range(40)]
    edited = base.split(" ")
    for i in range(25):
        own = list(edited)
        own[rng.randrange(len(own))] = word()
        rows.append((300 + i, " ".join(own)))
    rows += [(400, None), (401, ""), (402, " \n "), (403, "one"), (404, "One"), (405, "a\t\tb"), (406, "a b"), (407, "ab " * 700), (408, "ab " * 900)]
    rows += [(None, base), (None, "alone"), (409, "same id"), (409, "same id"), (409, "other text"), (410, text(60_000))]
    return rows


def test_exact(make):
    rows = odd_rows()
    groups = collections.defaultdict(list)
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in rows:
        groups[plain(t)].append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    want = [(i, least(g := groups[plain(t)]), len(g), i == least(g), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows]
    got = [tuple(r) for r in exact_dedup.exact_dedup(make(rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_finds_heavy_digests(make):
    docs = make([(i, "hot" if i % 2 else f"text {i}") for i in range(2000)])
    rows = exact_dedup.digests(docs).select("doc_id", "sha", "h")
    assert [(r.keep_id, r.group_size) for r in exact_dedup.frequent(rows).collect()] == [(1, 1000)]


def test_without_copies_keeps_one_row(make):
    kept = exact_dedup.without_copies(make(odd_rows()))
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in odd_rows()})
    assert kept.columns[:2] == ["doc_id", "text"] and "kept" in kept.columns


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near(make):
    rows = odd_rows()
    fp = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(len(rows)):
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
        if all(group[group[a]] == group[a] for a in range(len(rows))):
            break
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[group[a]] += [i] if i is not None else []
    want = [(i, f"{fp[a]:016x}", min(least[group[a]], default=None)) for a, (i, _) in enumerate(rows)]
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(make(rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = simhash.without_near_copies(make(rows))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    # One row for each component; the null id stands alone once, and id 409 has two texts.
    assert sorted(ids, key=repr) == sorted([*{w[2] for w in want}, 409], key=repr)
    assert kept.columns == make(rows).columns


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(2))
        b = a
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b ^= 1 << int(bit)
        met = False
        for side in (0, 1):
            x, y = (np.array([v >> (32 * side) & 0x7FFFFFFF], np.uint32) for v in (a, b))
            near = simhash.anchors(y, True)[1]
            met |= simhash.anchors(x, False)[1][0] in near
            assert all((int(v) ^ int(y[0])).bit_count() <= 2 for v in near) and len(set(near.tolist())) == len(near)
        assert met


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    got = {r.u: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}


def brute_removed(rows, length):
    seen, out = collections.Counter(), []
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    for (i, _), b in zip(rows, data, strict=True):
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = [True] * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("length", "k", "hot"), [(400, 32, 50_000), (40, 8, 50_000), (40, 8, 2)])
def test_suffix(make, length, k, hot):
    rows = [r for r in odd_rows() if r[0] != 410]
    got = suffix_dedup.removed(make(rows), length=length, k=k, hot=hot, with_text=True)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == brute_removed(rows, length)
    assert all(hashlib.sha256(r.kept_text).hexdigest() == r.kept_sha256 for r in got.collect())


def test_long_text_in_chunks(make, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    monkeypatch.setattr("dockflow.llm.common.SLICE_BYTES", 4000)
    rng = random.Random(4)
    part = "".join(rng.choice("abcdef") for _ in range(3000))
    rows = [(1, part + "".join(rng.choice("xyz") for _ in range(9000)) + part), (2, part[500:2500]), (3, None)]
    got = sorted((tuple(r)[:5] for r in suffix_dedup.removed(make(rows)).collect()), key=repr)
    assert got == brute_removed(rows, 400)


def test_empty_tables(make):
    none = make([])
    for df in (exact_dedup.exact_dedup(none), exact_dedup.without_copies(none), simhash.near_duplicates(none), suffix_dedup.removed(none)):
        assert df.count() == 0


def brute_shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def edited_rows():
    """Originals and copies of 64 to 250 words with a few words changed, and a chain of which only neighbours are near."""
    rng = random.Random(8)
    say = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    rows = []
    for i in range(40):
        base = say(rng.randint(64, 250))
        rows.append((i * 10, " ".join(base)))
        for j in range(1, 4):
            own = list(base)
            for at in rng.sample(range(len(own)), max(1, int(len(own) * rng.choice([0.005, 0.01, 0.02, 0.03])))):
                own[at : at + 1] = rng.choice([[], say(1), say(2)])
            rows.append((i * 10 + j, " ".join(own)))
    chain = say(100)
    for j in range(6):
        rows.append((1000 + j, " ".join(chain)))
        chain[j * 16 + 8] = "changed"
    return rows + odd_rows()


def test_stage_drops_all_similar_texts(spark, make):
    rows = edited_rows()
    sets = [brute_shingles(t) for _, t in rows]
    near = [(a, b, s) for a in range(len(rows)) for b in range(a) if (s := len(sets[a] & sets[b]) / (len(sets[a] | sets[b]) or 1) if sets[a] or sets[b] else 1.0) >= 0.8]
    assert sum(0.8 <= s < 0.97 for *_, s in near) > 60
    group = list(range(len(rows)))
    while any(group[a] != group[b] for a, b, _ in near):
        for a, b, _ in near:
            group[a] = group[b] = min(group[a], group[b])
    least = collections.defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[group[a]] += [i] if i is not None else []
    want = sorted((min(ids, default=None) for ids in least.values()), key=repr)
    docs = make(rows)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted((r.doc_id for r in kept.select("doc_id").collect()), key=repr) == want
    assert kept.columns == docs.columns and similar.without_similar(docs.limit(0)).count() == 0


def counted_pairs(monkeypatch):
    """Numbers of pairs that are verified, call by call."""
    seen, plain = [], similar.verified

    def verified(pairs, texts):
        seen.append(pairs.count())
        return plain(pairs, texts)

    monkeypatch.setattr(similar, "verified", verified)
    return seen


def test_a_key_of_very_many_near_copies(spark, monkeypatch):
    """20,000 edited copies of one text share keys; pairs with each other are not listed, and all are found."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(20_000):
        own = list(base)
        for at in rng.sample(range(80), rng.choice([0, 1, 1, 1])):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    seen = counted_pairs(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in similar.without_similar(docs).collect()] == [0]
    assert sum(seen) < 60 * len(rows)


def test_a_passage_that_many_texts_share(spark, monkeypatch):
    """Texts of which over half is one passage meet in keys but are told apart by their own words; a few real copies among them are found."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(130))
    rows = [(i, passage + " " + " ".join(f"u{i}.{j}" for j in range(60))) for i in range(3000)]
    rows += [(5000 + i, rows[i * 100][1].replace(f"u{i * 100}.59", f"v{i}")) for i in range(20)]
    monkeypatch.setattr(similar, "BANDS", 20)
    monkeypatch.setattr(similar, "ROWS", 1)  # keys that nearly all of these texts share
    seen = counted_pairs(monkeypatch)
    docs = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id bigint, text string")
    kept = {r.doc_id for r in similar.without_similar(docs).select("doc_id").collect()}
    assert kept == set(range(3000)) and seen[-1] <= 20 and sum(seen) < 60 * len(rows)


def test_fingerprint_links_join_near_copies_without_a_common_minhash_key(spark, make):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    texts = [[word() for _ in range(2000)] for _ in range(6)]
    # Of each text one copy with a word replaced; the others have nothing in common.
    rows = [(2 * i, " ".join(t)) for i, t in enumerate(texts)] + [(2 * i + 1, " ".join([*t[:500], "new", *t[501:]])) for i, t in enumerate(texts)]
    keyed = similar.keyed_rows(make(rows, clash=False))
    groups = similar.sketched(keyed, similar.ROW).selectExpr("set", "doc_id AS first", "n", "array() AS keys", "fp")
    groups = groups.withColumn("keys", groups["keys"].cast("array<bigint>")).localCheckpoint()
    of = {r["set"]: r["first"]["id"] // 2 for r in groups.collect()}
    pairs = [(of[r["set"]], of[r["root"]]) for r in similar._roots(groups, keyed).collect()]
    assert sorted(pairs) == [(i, i) for i in range(6)]


def assert_merged(df):
    """Every join of ``df``, as it ran, is a merge join."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fingerprints_at_their_anchors_are_not_broadcast(spark):
    # Spark sizes the replicated side as if every fingerprint came out once, far under its limit for a broadcast.
    fps = spark.range(500).selectExpr("xxhash64(id) AS fp").union(spark.range(500).selectExpr("xxhash64(id) ^ 5 AS fp"))
    found = simhash.links(fps)
    assert_merged(found)
    assert {frozenset(r) for r in found.collect()} == {frozenset(r) for r in spark.range(500).selectExpr("xxhash64(id)", "xxhash64(id) ^ 5").collect()}


def test_keys_of_sets_are_not_broadcast(spark):
    # Spark sizes an exploded list as one of its items, and staged rows whose values repeat by their few bytes in the file.
    groups = spark.range(300).selectExpr("id AS set", "10L AS n", "transform(sequence(1, 45), b -> xxhash64(b, id div 3)) AS keys", "xxhash64(id div 3) AS fp")
    members = similar._members(groups)
    assert_merged(members)
    assert sorted((r.set, r.n, r.least.set) for r in members.dropDuplicates(["set"]).collect()) == [(i, 10, i // 3 * 3) for i in range(300)] and members.count() == 300 * 45
    named = members.selectExpr("key", "set", "n", "set AS root", "0L AS top", "3L AS sets")
    pairs = similar._met(named, named, "key", True)
    assert_merged(pairs)
    assert sorted(tuple(r) for r in pairs.collect()) == sorted((a, b) for i in range(0, 300, 3) for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2)))
    assert sorted(tuple(r) for r in similar._linked(groups).collect()) == sorted((i, i + j) for i in range(0, 300, 3) for j in (1, 2))


def test_word_counts_are_not_broadcast(make, monkeypatch):
    docs = make([(i, f"word{i % 5} other{i % 3}", "en") for i in range(100)], clash=False)
    got, to_arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: got.append((self, to_arrow(self))) or got[-1][1])
    known, said, langs = toxicity.vocabulary(docs, 22, 4)
    plans = [df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0] for df, _ in got]
    assert langs == ["en"] and said.sum() == 200 and len(known) >= 8
    assert "SortMergeJoin" in plans[-1] and not any("Broadcast" in p for p in plans)


def test_workers_get_few_texts_at_once(spark, make, monkeypatch):
    sizes, array = spark.sparkContext.accumulator(0), similar.byte_array
    monkeypatch.setattr(similar, "byte_array", lambda c: sizes.add(len(c) > 1000) or array(c))
    docs = make([(i, f"text number {i}") for i in range(4500)], clash=False).coalesce(1)
    assert similar.near_copies(simhash.keyed_rows(docs)).count() == 4500 and sizes.value == 0
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
