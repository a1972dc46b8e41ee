import time
"""Main text, url verdicts, raking and the pipeline on small hand-made inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from dockflow.llm import htmltext, linkgraph, mixing

LONG = "A sentence long enough to be the body of an article, said twice for good measure. " * 2
PARTS = f"""<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><header>Site name</header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies, {LONG}</div>
<article><header><h1>Head &amp; line</h1></header><p>{LONG}</p><p>Short   one.<br>Two&nbsp;&#8364;</p><aside>Aside {LONG}</aside>
<p>{LONG}<b>bold</b>text</p></article><div id="comments"><p>{LONG}</p></div><form>Mail {LONG}</form><footer>{LONG}</footer></body></html>"""


def test_main_text():
    text = " ".join(LONG.split())
    assert htmltext.main_text(PARTS) == f"Head & line\n\n{text}\n\nShort one. Two €\n\n{text} boldtext"


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>one<p>two", "one\n\ntwo"), ("<!-- never closed <p>x", ""),
    ("<script>never closed <p>x", ""), ("<p>a < b & c &amp d</p>", "a < b & c & d"), ("<nav>only <a href='x'>menus</a></nav>", ""),
    ("<article>" + "<p>w</p>" * 20_000, "\n\n".join(["w"] * 20_000)),
])
def test_main_text_odd(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("script", [
    "<script>for(i=0;i<n;i++){f(i)}</script>", "<script>if(a<b)f()</script>", "<script><!-- g('<p>')</script>", "<style>a<b{}</STYLE >", "<SCRIPT>g(i<n)</script>",
])
def test_main_text_after_scripts(script):
    page = f"<html><body>{script}<article><p>{LONG}</p><p>More{script} words.</p></article></body></html>"
    assert htmltext.main_text(page) == f"{LONG.strip()}\n\nMore words."


def test_main_text_keeps_linked_lines():
    page = f"""<nav><a href="/">Home</a></nav><article><h1><a href="/1">Linked head</a></h1><p>{LONG}</p><h2><a href="#2">Part two</a></h2>
    <p>See <a href="x">A &amp; B &amp; C &amp; D</a></p><ul><li><a href="y">One</a></li><li><a href="z">Two</a></li></ul><p>{LONG}</p></article><footer>End</footer>"""
    text = LONG.strip()
    assert htmltext.main_text(page) == f"Linked head\n\n{text}\n\nPart two\n\nSee A & B & C & D\n\nOne\n\nTwo\n\n{text}"
    assert htmltext.lines("<p>See <a>A &amp; B &amp; C</a> <a>D</a></p>") == (["See A & B & C D"], [3], [0])
    # References: more links than a window has lines, up to the article's end but not behind it.
    links = [f"Reference {i}" for i in range(6)]
    listed = "<ol>" + "".join(f"<li><a href='{i}'>{t}</a></li>" for i, t in enumerate(links)) + "</ol>"
    page = f"<article><p>{LONG}</p>{listed}<p>{LONG}</p>{listed}</article><div>{listed}</div>"
    assert htmltext.main_text(page).split("\n\n") == [text, *links, text, *links]
    # A list of links before furniture is no part of the passage behind it.
    assert htmltext.main_text(f"<p><a>Menu</a></p><nav>x</nav><p>{LONG}</p>") == text


@pytest.mark.parametrize("head", ["<html><head class='nav'><title>T</title>", "<head><meta charset=utf-8><style>p{}</style><link href=x><noscript>n</noscript>"])
def test_main_text_of_open_heads(head):
    assert htmltext.main_text(f"{head}<body><p>{LONG}</p>") == htmltext.main_text(f"{head}</head><body><p>{LONG}</p>") == LONG.strip()


ARTICLE = "<h1>Title of it</h1><p>" + "Words of a story. " * 20 + "</p><p>And its end.</p>"


@pytest.mark.parametrize(
    "around",
    ['<div class="layout has-sidebar">', '<div class="post no-comments">', '<div class="with-navigation">', '<form id="page" action="/x">', '<div class="ad-free">',
     '<div id="content-with-sidebar">', '<div class="page--nav-open">', '<div class="sidebar-layout">'],
)
@pytest.mark.parametrize("inner", [f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>", f"<div>{ARTICLE}</div>"])
def test_wrappers_keep_their_article(around, inner):
    close = "</form>" if around.startswith("<form") else "</div>"
    page = f"<body><nav><a href=/>Home</a></nav>{around}{inner}<p class=ad-free>Free of any.</p>{close}<div class='site-footer'>Imprint and all that</div></body>"
    got = htmltext.main_text(page).split("\n\n")
    assert got[0] == "Title of it" and got[-2:] == ["And its end.", "Free of any."]


def test_named_furniture_still_goes():
    teasers = "<div class=related><article><p>Another story that is told at some length here.</p></article></div>"
    for extra in ("<div class='comments'><p>" + "I say so. " * 12 + "</p></div>", teasers, "<div id=left-sidebar><p>Side text of some length.</p></div>",
                  "<form><p>Subscribe to our letter today, please do.</p><input></form>", "<div class='newsletter-box'>Do read our letter.</div>"):
        assert htmltext.main_text(f"<article>{ARTICLE}</article>{extra}").endswith("And its end.")
        assert htmltext.main_text(f"<div>{ARTICLE}{extra}</div>").endswith("And its end.")


@pytest.mark.parametrize("page", ["<div " * 50_000, "<!" * 50_000, "<div>" * 30_000 + "</span>" * 30_000, "<p class='" * 30_000, "</div>" * 50_000])
def test_work_grows_with_the_length(page):
    begun = time.monotonic()
    htmltext.main_text(page)
    assert time.monotonic() - begun < 3


def test_main_texts_columns(spark):
    pages = spark.createDataFrame([(1, "u", PARTS, "x"), (2, None, None, "y"), (None, "v", "<p>z", "z")], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in htmltext.main_texts(pages).collect()}
    assert got[2].text == "" and got[2].n_chars == 0 and got[None].text == "z" and got[1].n_chars == len(got[1].text)
    assert htmltext.main_texts(pages.limit(0)).count() == 0


PAGES = [
    (1, "http://a.net/x", None), (2, "https://WWW.Example.NET/en/1?q#f", ""), (3, "http://example.net/de/1", None), (4, "http://x.example.com/de/", None),
    (5, "http://m.org/fr/1", None), (6, "http://m.org/en/1", '<a href="http://a.net/">bad</a>'), (7, None, None), (8, "no scheme", None),
    (9, "ftp://notnet/p", None), (10, "http://farm.com/", '<a href="http://a.net/"><a HREF=https://b.net/x>'), (10, "http://farm.com/", None),
    (11, "http://b.net?x=/en/", None), (12, "http://good.com/1", None), (13, "http://example.net/en/", '<a href="http://good.com/9">x</a>'),
]


def test_verdicts(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.judged(pages).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert got[3][2:] == ("net/", "block") and got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9][:3] == ("notnet", "/p", None) and got[11][:3] == ("b.net", "", None)
    assert got[6][3] == "allow" and got[12] == ("good.com", "/1", None, "allow")
    assert linkgraph.judged(pages).count() == len(PAGES) and linkgraph.judged(pages.limit(0)).count() == 0


def test_links_to_hosts_without_pages(spark):
    a = lambda *hosts: "".join(f"<a href='{h}'>x</a>" for h in hosts)
    rows = [
        (1, "http://farm.com/", a("http://x.net/1", "https://y.net", "http://z.net/")), (2, "http://plain.com/", a("http://other.com/", "/own")),
        (3, "http://slashes.com/", a("//p.net/1", "//q.net", "//r.net/")), (4, "http://start.com/", a(*[f"http://far{i}.com/" for i in range(2)])),
        (5, "http://de.com/", a("http://www.example.com/")),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r for r in linkgraph.judged(pages).collect()}
    assert len(got) == 5 and [got[i].verdict for i in range(1, 6)] == ["block", "allow", "block", "allow", "allow"]
    assert got[1].distrust > 1 and got[2].distrust == got[4].distrust == got[5].distrust == 0
    links = {(r.src, r.dst) for r in linkgraph.links_of(pages).collect()}
    assert ("start.com", "far1.com") in links and ("slashes.com", "q.net") in links and len(links) == 10


def test_pagerank_by_matrix(spark):
    rng = np.random.default_rng(2)
    n = 12
    edges = [("k", f"h{a}", f"h{b}", float(rng.integers(1, 4))) for a in range(n - 2) for b in rng.choice(n, 3, replace=False) if a != b]
    seed = {"h0": 0.25, "h3": 0.75}
    both = edges + [("other", "h1", "h2", 1.0)]
    seeds = [("k", h, v) for h, v in seed.items()] + [("other", "h1", 1.0)]
    got = linkgraph.personalised(
        spark.createDataFrame(both, "kind string, src string, dst string, weight double"), spark.createDataFrame(seeds, "kind string, host string, seed double"), 1e-3
    ).collect()
    walk = np.zeros((n, n))
    for _, a, b, w in edges:
        walk[int(b[1:]), int(a[1:])] += w
    walk /= np.maximum(walk.sum(0), 1e-12)
    s = np.array([seed.get(f"h{i}", 0) for i in range(n)])
    x = s.copy()
    for _ in range(200):  # mass without a way out returns to the seeds
        y = 0.85 * walk @ x
        x = y + (1 - y.sum()) * s
    have = {r.host: r.score for r in got if r.kind == "k"}
    assert np.allclose([have.get(f"h{i}", 0) for i in range(n)], x, atol=3e-3)
    other = {r.host: r.score for r in got if r.kind == "other"}
    assert np.isclose(other["h1"], 0.15 / 0.2775) and np.isclose(other["h2"], 0.1275 / 0.2775)


def test_trust_reaches_the_end_of_a_long_chain(spark):
    """A host fifteen links behind the seed: the rounds follow the graph, not a fixed number."""
    edges = spark.createDataFrame([("k", f"h{i:02d}", f"h{i + 1:02d}", 1.0) for i in range(15)], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("k", "h00", 1.0)], "kind string, host string, seed double")
    got = {r.host: r.score for r in linkgraph.personalised(edges, seeds, 1e-3).collect()}
    total = sum(0.85**i for i in range(16))
    assert len(got) == 16 and all(np.isclose(got[f"h{i:02d}"], 0.85**i / total, rtol=0.01) for i in range(16))


def mix_rows():
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        words = " ".join(["word"] * int(rng.integers(1, 400)))
        rows.append((i, f"a | {words}" if i % 7 == 0 else words, ["en", "en", "en", "de", None][i % 5], "hot" if i % 3 else f"s{i % 4}"))
    return rows + [(5000, None, None, None), (5001, "", "en", "hot"), (None, "null id", "en", "hot")]


def test_raking_reaches_the_marginals(make):
    docs = make(mix_rows())
    cells = mixing.cells_of(mixing.described(docs)).cache()
    goals = {d: mixing.targets_of(cells, d) for d in mixing.DIMENSIONS}
    raked = mixing.rake(cells, goals).toPandas()
    total = raked.tokens.sum()
    for d, goal in goals.items():
        want = {r[0]: r[1] for r in goal.collect()}
        for value, mass in raked.groupby(d).mass.sum().items():
            assert abs(mass / total - want[value]) < 1e-4 * want[value] + 1e-9
    # The same numbers by plain loops.
    mass = raked.tokens.to_numpy().copy()
    for _ in range(mixing.ROUNDS):
        for d, goal in goals.items():
            want = {r[0]: r[1] for r in goal.collect()} if _ == 0 else cache[d]  # noqa: F821
            if _ == 0:
                cache = {**(cache if d != "source" else {}), d: want}  # noqa: F821
            for value in want:
                at = (raked[d] == value).to_numpy()
                if mass[at].sum() > 0:
                    mass[at] *= want[value] * total / mass[at].sum()
    assert np.allclose(mass, raked.mass, rtol=1e-4)


def test_scale_with_a_cell_of_almost_no_mass(spark):
    cells = [(1000.0, 700.0), (1000.0, 1309.0), (10.0, 1e-6)]
    s = mixing.scale_of(spark.createDataFrame(cells, "tokens double, mass double"), 0.8)
    assert abs(sum(min(t, m * s) for t, m in cells) / 2010 - 0.8) < 1e-4
    with pytest.warns(UserWarning, match="cannot be kept"):
        mixing.scale_of(spark.createDataFrame([(10.0, 10.0), (90.0, 0.0)], "tokens double, mass double"), 0.8)


def test_raking_reports_misfit(make):
    # Source a is only en and source b only de, so sources and languages cannot have these shares at once.
    docs = make([(1, "one two", "en", "a"), (2, "one two", "de", "b")])
    cells = mixing.cells_of(mixing.described(docs))
    shares = lambda d, rows: docs.sparkSession.createDataFrame(rows, f"{d} string, target double")
    with pytest.warns(UserWarning, match="do not all fit"):
        mixing.rake(cells, {"source": shares("source", [("a", 0.9), ("b", 0.1)]), "lang": shares("lang", [("en", 0.5), ("de", 0.5)])}, rounds=3)


def test_sampling(make):
    docs = make(mix_rows())
    got = mixing.weights(docs).toPandas()
    assert len(got) == 903 and got.probability.between(0, 1).all()
    assert abs((got.probability * got.n_tokens).sum() / got.n_tokens.sum() - mixing.KEEP) < 1e-3
    kept = mixing.sampled(docs)
    assert kept.columns == [*(c for c in docs.columns if c != "mix_weight"), "mix_weight"] and kept.where("_p <> 'z' OR _u <> 'z' OR mix_weight < 0").count() == 0
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == sorted(int(i) if i == i else -1 for i in got[got.kept].doc_id)
    assert mixing.weights(make([])).count() == 0 and mixing.weights(docs, keep=1.0).where("NOT kept").count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not present")
def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    out = corpus_pipeline.run(spark, sf)
    rows = out.select("doc_id", "text").collect()
    assert out.columns == [*docs.columns, "mix_weight"] and 0 < len(rows) < docs.count()
    assert len({r.text for r in rows}) == len(rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
