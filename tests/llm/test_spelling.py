"""Spelling variants against a plain reading of all pairs of words."""

import random
import zlib
from collections import Counter

import numpy as np

from dockflow.llm import spelling


def rows():
    rng = random.Random(9)
    letters = "abcdeéàÿ×ß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 12))) for _ in range(60)]

    def edited(word):
        at, kind, letter = rng.randrange(len(word)), rng.randrange(3), rng.choice(letters)
        return word[:at] + (letter if kind < 2 else "") + word[at + (kind != 1) :]

    out = []
    for i in range(150):
        own = [w if rng.random() < 0.8 else edited(w) for w in rng.choices(base, k=60)]
        out.append((i, " ".join(own + [rng.choice(["Short", "ÀÀÀÀÀÀÀ", "ABCDEFGH", "abcdefgh", "1234567", "x" * 9])])))
    # A chain of forms, each ten times as frequent as the one before.
    out += [(200, "chained " * 400 + "chaines " * 40 + "chaiies " * 4), (201, None), (202, ""), (203, "."), (204, "aaaaaaaa" * 3000), (204, "aaaaaaaa" * 3000)]
    return out + [(None, "nothing nothing"), (205, "tiesaaa " * 20 + "tiesaab " * 20 + "tiesaac " * 2), (206, "wordword, " * 70_000)]


def plain_words(of):
    counts = Counter()
    for i, text in of:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "") + " "
        run = ""
        for c in lowered:
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                word = run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(word) >= 7:
                    counts[word] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def expected(of):
    n = plain_words(of)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n)


def test_variants(make):
    got = spelling.variants(make(rows())).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = expected(rows())
    assert sorted(tuple(r) for r in got) == want
    found = {r[0]: r for r in want}
    assert found["chaiies"][5] == "chained" and found["tiesaac"][3] == "tiesaaa" and sum(r[3] is not None for r in want) > 20


def test_empty_table(make):
    assert spelling.variants(make([])).count() == 0


def test_signatures_meet():
    rng = random.Random(4)
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(7, 30)))
        at = rng.randrange(len(a))
        b = a[:at] + rng.choice("xb") + a[at + 1 :]
        if a != b:
            one, two = (set(spelling.signatures([w], True, False)[0].tolist()) for w in (a, b))
            assert one & two
        b = a[:at] + a[at + 1 :]
        assert set(spelling.signatures([a], False, True)[0].tolist()) & set(spelling.signatures([b], False, False)[0].tolist())


def test_words_of_parts_are_those_of_the_whole(monkeypatch):
    text = " ".join(t or "" for _, t in rows())[:400_000].encode()
    whole, parts = Counter(), Counter()
    spelling.add_words(whole, "5", text)
    monkeypatch.setattr(spelling, "_MATCHES", 1 << 30)
    spelling.add_words(parts, "5", text)
    assert whole == parts and len(whole) > 50 and np.sum(list(whole.values())) > 5000
