"""Classifiers by held-out accuracy and by their defined cases; decontamination against brute force and edited copies."""

import os
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from dockflow.llm import decontaminate, langid, quality, registry, toxicity
from dockflow.llm.common import encoded, table

SF = "/root/testdata/sf0.01"
LABELS = "doc_id bigint, quality int, toxic int"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")
ODD = [(1, None), (2, ""), (3, "12 34 ..."), (4, "x" * 300_000), (5, "The same"), (5, "The same"), (None, "null id")]


@needs_tables
def test_language(spark):
    got = registry.op1_language(spark, SF)
    rows = got.join(table(spark, SF, "documents"), "doc_id").where("held_out AND lang IS NOT NULL").select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


@needs_tables
@pytest.mark.parametrize(("name", "label", "least"), [("op3_toxicity", "toxic", 0.95), ("op4_quality", "quality", 0.93)])
def test_labels(spark, name, label, least):
    sf = SF.replace("0.01", "0.1")  # a few hundred labels are needed
    got = registry.QUERIES[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    rows = got.selectExpr("score", "predicted", f"{label} AS label").collect()
    assert np.mean([r.predicted == r.label for r in rows]) > least


def test_language_gradient_by_differences():
    rng = np.random.default_rng(0)
    model = langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")], steps=3)
    p = {k: v.astype(np.float64) for k, v in model["p"].items()}
    x, _ = langid.windows(*encoded(["the cat", "und hund"]), span=9)
    label = np.array([1, 0])
    grad, _ = langid._step({k: v.astype(np.float32) for k, v in p.items()}, x, label)
    for key in p:
        at = tuple(rng.integers(0, s) for s in p[key].shape)
        if key == "w":
            at = (*at[:2], int(x[1, 0]))
        loss = []
        for e in (1e-2, -1e-2):
            q = {k: v.astype(np.float32).copy() for k, v in p.items()}
            q[key][at] += e
            loss.append(langid._step(q, x, label)[1])
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[key][at]) < 5e-3


def test_language_odd_rows(make):
    rows = ODD + [(10 + i, f"the and of to {i}", "en") for i in range(9)] + [(30 + i, f"der die und das {i}", "de") for i in range(9)]
    got = {r.doc_id: r for r in langid.language(make(rows)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[3].score == 0
    assert got[4].lang_pred in ("en", "de") and len(got) == len({r[0] for r in rows})
    assert {r.lang_pred for r in langid.language(make(ODD)).collect()} == {"und"}
    assert langid.language(make([])).count() == 0


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_label_operators_odd_rows(spark, make, operator):
    docs = make(ODD + [(i, f"word{i} {'awful' if i % 2 else 'fine'} text") for i in range(10, 60)])
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i in range(10, 60)] + [(1, 1, 1), (None, 0, 0), (99, None, None)], LABELS)
    got = operator(docs, labels).collect()
    assert len(got) == 57 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert operator(docs, labels.limit(0)).count() == 57 and operator(make([]), labels).count() == 0


def test_without_toxic_keeps_columns(spark, make):
    docs = make([(i, f"some plain words here {'awful' if i % 2 else 'fine'} and more", "en") for i in range(400)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)], LABELS)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {0} and kept.count() == 200


def test_toxicity_learns_from_every_labelled_text(spark, make, monkeypatch):
    import zlib

    monkeypatch.setattr(toxicity, "SHARE", 1500)  # several shares, whose values are averaged
    n = 6000
    docs = make([(i, f"some plain words {'awful' if i % 2 else 'fine'} {i % 50}", "en" if i % 3 else "de") for i in range(n)], clash=False)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(n)], LABELS)
    model = toxicity.model_of(docs, labels)
    learnt = [i for i in range(n) if zlib.crc32(str(i).encode()) % 5]
    assert model["langs"] == ["de", "en"]
    assert np.round(np.exp(model["prior"]) - 1).tolist() == [sum(i % 3 == 0 for i in learnt), sum(i % 3 > 0 for i in learnt)]
    assert toxicity.scores(model, *encoded(["some plain words awful 3", "some plain words fine 3"])).round().tolist() == [1, 0]


def shuffled_bytes(spark):
    context = spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_toxicity_shuffles_no_text_without_label_and_others_once(spark, folder):
    rng = np.random.default_rng(3)
    rows = [(i, f"plain words {'awful' if i % 2 else 'fine'} {rng.bytes(10_000).hex()}", "en", "web", 1) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents")
    spark.createDataFrame([(i, 1, i % 2) for i in range(0, 1000, 7)], LABELS).write.parquet(f"{folder}/labels")
    broadcast, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled_bytes(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many labels
        toxicity.model_of(spark.read.parquet(f"{folder}/documents"), spark.read.parquet(f"{folder}/labels"), least_steps=3)
        assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    text = sum(len(r[1]) for r in rows)
    assert shuffled_bytes(spark) - before < 0.2 * text  # 115 of 1,000 texts are learnt from


def traced_peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_toxicity_tasks_hold_little_beside_their_texts():
    class Shares:
        def mapInArrow(self, run, schema):
            self.learn = run
            raise InterruptedError

    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 5000, 300))
    known = np.unique(toxicity.buckets(*encoded([f"w{k}" for k in range(5000)]), 22)[0][:, 0]).astype(np.int64)
    model = toxicity.untrained(known, np.ones((len(known), 1)), ["en"], {"en": 1}, 0.5, 22)
    raw, at = encoded([text() for _ in range(2000)])
    full = toxicity.with_rows(model)
    toxicity.scores(full, raw[: at[1]], at[:2])  # the tables of powers
    assert traced_peak(lambda: toxicity.scores(full, raw, at)) < 50 << 20
    shares = Shares()
    with pytest.raises(InterruptedError):
        toxicity._averaged(model, shares, [])
    some = pa.RecordBatch.from_pydict({"part": [1] * 1000, "text": [text() for _ in range(1000)], "label": [0, 1] * 500})
    assert traced_peak(lambda: list(shares.learn(iter([some] * 12)))) < 60 << 20
    got = list(shares.learn(iter([some.slice(0, 0), some, some.slice(0, 0)])))
    assert got[0].column("n")[0].as_py() == 1000 and list(shares.learn(iter([some.slice(0, 0)]))) == []


def test_toxicity_thresholds_are_those_of_all_kept_rows(spark):
    known, said = np.zeros(0, np.int64), np.zeros((0, 2))
    model = toxicity.untrained(known, said, ["de", "en"], {"de": 5, "en": 500}, 0.3, 10)
    rows = [(f"text {i}", "en" if i % 10 else "de", int(i % 4 == 0)) for i in range(400)]
    model["bias"], model["v"] = np.float32(0.5), np.zeros_like(model["v"])
    got = toxicity._calibrated(model, spark.createDataFrame(rows, "text string, lang string, label int"))
    # Every logit is 0.5, so every row is said at each cut below it, and the one nearest to zero is taken.
    assert got["cut"].tolist() == [0.0, 0.0]
    model["bias"] = np.float32(-1.04)
    got = toxicity._calibrated(model, spark.createDataFrame(rows, "text string, lang string, label int"))
    assert np.allclose(got["cut"], -1.1)


def words_of(text):
    data, at = encoded([text])
    return decontaminate._symbols(data, at)[0].tolist()


def brute_distance(item, text):
    row = list(range(len(text) + 1))
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 12)).astype(np.uint64)
        assert decontaminate.distance(a, b) == brute_distance(a.tolist(), b.tolist())


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([4, 8, 15, 30, 60]))) for i in range(40)] + [(90, None), (91, ""), (92, "...")]
    rows, planted = [(i, say(120)) for i in range(60)], set()
    for n in range(160):
        i, text = items[n % 40]
        own = text.split(" ")
        for _ in range(rng.randint(0, int(0.2 * len(own))) if len(own) >= 5 else 0):
            j = rng.randrange(len(own))
            own[j : j + 1] = rng.choice([[], [say(1)], [own[j], say(1)]])
        rows.append((1000 + n, f"{say(40)}\n{' '.join(own).upper() if n % 3 == 0 else ' '.join(own)}. {say(40)}"))
        planted.add((1000 + n, i))
    return items, rows + [(1, None), (2, "")], planted


def test_long_items_are_found():
    rng = random.Random(6)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(n * 100 + j, say(n)) for n in (97, 300, 640, 1000) for j in range(12)]
    rows = []
    for _, item in items:
        own = list(item)
        for at in sorted(rng.sample(range(len(own)), int(0.2 * len(own))), reverse=True):
            own[at : at + 1] = rng.choice([[], say(1), [own[at], *say(1)]])
        rows.append((say(rng.randint(0, 80)), own, say(80)))
    index = decontaminate.index_of([(i, " ".join(t)) for i, t in items])
    got = decontaminate.matches(index, *encoded([" ".join(sum(r, [])) for r in rows] + [" ".join(say(3000)), " ".join(items[30][1][:400])]))
    assert all(a == b for a, b in got) and len(got) >= 0.98 * len(items)
    for (a, _), (d, place) in got.items():
        assert d <= int(0.2 * len(items[a][1])) and abs(place - len(rows[a][0])) <= 2
        if len(items[a][1]) <= 300:
            text, item = sum(rows[a], []), items[a][1]
            assert d == brute_distance(item, text[place:]) <= min(brute_distance(item, text[s:]) for s in range(max(0, place - 2), place + 3))


def test_items_between_one_and_three_segments():
    """Edited to the limit, at every length between the shortest and the longest that used to be read in one walk."""
    rng = random.Random(16)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(n * 1000 + j, say(n)) for n in (33, 45, 61, 75, 90, 96) for j in range(60)]
    rows = []
    for _, item in items:
        own = list(item)
        for at in sorted(rng.sample(range(len(own)), int(0.2 * len(own))), reverse=True):
            own[at : at + 1] = rng.choice([[], say(1), [own[at], *say(1)]])
        rows.append(" ".join(say(rng.randint(0, 40)) + own + say(40)))
    got = decontaminate.matches(decontaminate.index_of([(i, " ".join(t)) for i, t in items]), *encoded(rows))
    assert all(a == b for a, b in got) and len(got) >= 0.99 * len(items)


def test_every_window_within_the_edits_passes_the_filter():
    """Also one whose first word no item has."""
    items, rows, planted = corpus()
    index, texts, met = decontaminate.index_of([(i, t) for i, t in items if t]), dict(rows), 0
    for doc, item in sorted(planted)[::3]:
        h, _ = decontaminate._symbols(*encoded([f"unheard {texts[doc]}"]))
        marked = {q: np.append(held[decontaminate._grams(h, q)], np.zeros(q - 1, np.uint64)) for q, held in index["marks"].items()}
        for group in index["groups"]:
            left = set(decontaminate._starts(group, marked, h).tolist())
            for own in (index["own"][p] for p in group["of"] if index["ids"][index["parts"][p][0]] == item):
                allowed = int(0.2 * len(own)) if len(own) >= 5 else 0
                within = {s for s in range(len(h)) if decontaminate.distance(own, h[s : s + len(own) + allowed]) <= allowed}
                assert within <= left
                met += len(within)
    assert met > len(planted) // 3


def test_distance_anywhere():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(0, 14)).astype(np.uint64)
        d, place = decontaminate.within(a, b)
        assert d == min(brute_distance(a.tolist(), b[s:].tolist()) for s in range(len(b) + 1)) == brute_distance(a.tolist(), b[place:].tolist())


def test_leaks(spark, make):
    items, rows, planted = corpus()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.leaks(make(rows), benchmark).collect()}
    want = {}
    for d, t in rows:
        text = words_of(t or "")
        for i, item in items[:40]:
            own = words_of(item)
            allowed = int(0.2 * len(own)) if len(own) >= 5 else 0
            best = min((brute_distance(own, text[s : s + len(own) + allowed]) for s in range(len(text)) if text[s] in own), default=99)
            if best <= allowed:
                want[d, i] = best
    assert set(got) <= set(want) and all(got[k] == want[k] for k in got)
    assert len(got) >= 0.98 * len(want) and len(planted & set(got)) >= 0.98 * len(planted)
    # Blocks of any size give the same answer.
    small = {(r.doc_id, r.item_id) for r in decontaminate.leaks(make(rows), benchmark, limit=2000).collect()}
    assert small == set(got)
    kept = decontaminate.without_leaks(make(rows), benchmark)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.leaks(make(rows), benchmark.limit(0)).count() == 0 and decontaminate.leaks(make([]), benchmark).count() == 0
