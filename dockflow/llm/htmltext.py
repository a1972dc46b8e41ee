"""Main text of web pages by the line-block distribution.

Markup is stripped so that every block element starts a new line. The lengths of the lines, links and page furniture counted as
zero, are summed over sliding windows of WINDOW lines. Where the sum surges above the threshold a passage starts, together with
the unbroken lines just before it; it ends where the sum dives to zero. The text between is kept, block by block, lines that are one link
included: lengths only place the surge and the dive, and within an article element a passage dives only at the article's end. Up to WINDOW - 1 such lines just before a passage's first text belong to it.

Furniture is what navigation, header, footer, aside, script and style elements hold, and elements whose class, id or role has a token that is, begins with or
ends in a name of an advert, menu, notice, sidebar, share bar or reader comments; tokens like has-sidebar, no-comments or ad-free say what an element is not. A page's own
header inside its article counts as text. An element that is named so is no furniture if it holds the page's main element or longest article (one of at least a fifth of the page's text). On a page without
either, a compound name and a form, which else is furniture too, count for nothing if the element holds over half of the page's text outside links.
Outside an article a short last paragraph after WINDOW lines of nothing but links lies behind the dive and is left out.

Defined cases: null and empty pages give an empty text; unclosed elements, comments and scripts reach to the page's end, but a head
holds nothing back, as its end tag may be omitted; repeated rows are
each extracted; further columns are ignored. Work grows linearly with a page's length and nothing is cut.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
#: A surge: this many characters within a window, or this share of the page's fullest window if that is less.
SURGE, SHARE = 80, 0.2

#: Outside quotes a tag ends at the next < at the latest, so that an unclosed one is not read to the page's end.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^<>]*+>", re.S
)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*display\s*:\s*none|'[^']*display\s*:\s*none))", re.I)
_WORDS = re.compile(r"[a-z]+|\d+")
_DENIED = frozenset("has with without no not non".split())
_ENDED = frozenset("free off less none".split())
# Element names of the HTML standard.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe object svg math textarea title".split())
#: The closing tag of each of them: nothing else ends it, whatever stands between.
_ENDS = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I) for name in _RAW}
_FURNITURE = frozenset("nav footer aside button select dialog menu".split())
# End of fixed values.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer"
    " gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related respond share sharing"
    " sidebar social sponsor sponsored subscribe toolbar widget alert complementary search contentinfo".split()
)


def _named(attributes: str) -> str:
    """Whether class, id or role name furniture: "whole" for a token that is a name, "part" for one that begins or ends with one, else empty."""
    found = ""
    for m in _NAMED.finditer(attributes):
        for token in m.group(1).strip("\"'").lower().split():
            parts = _WORDS.findall(token)
            if not parts or not _DENIED.isdisjoint(parts) or parts[-1] in _ENDED:
                continue
            if len(parts) == 1 and parts[0] in _NAMES:
                return "whole"
            if parts[0] in _NAMES or parts[-1] in _NAMES:
                found = "part"
    return found


def _events(page: str) -> list[tuple]:
    """(name, attributes, text before): tags in page order; a closing tag's name starts with "/", a skipped script's is "" and the last one's None."""
    out, at, since = [], 0, 0
    while m := _MARKUP.search(page, at):
        text, at = page[since : m.start()], m.end()
        since = at
        name = (m.group(2) or "").lower()
        if not name:
            out.append(("!", "", text))
        elif name in _RAW:
            out.append((name if name in _BLOCKS else "!", "", text))
            if not m.group(1) and not m.group(3).endswith("/"):
                end = _ENDS[name].search(page, at)
                body = page[at : end.start() if end else len(page)]
                since = at = end.end() if end else len(page)
                if body and not body.isspace():
                    out.append(("", "", ""))
                if name in _BLOCKS:
                    out.append((name, "", ""))
        else:
            out.append(("/" + name if m.group(1) else name, m.group(3), text))
    out.append((None, "", page[since:]))
    return out


def _nested(events: list[tuple]):
    """(event number, opened names, closed ones): which elements every tag opens and closes, with the end tags that may be omitted."""
    stack, count = [], {}
    for i, (name, _, _) in enumerate(events):
        closed = []

        def pop(closed=closed):
            at, tag = stack.pop()
            count[tag] -= 1
            closed.append((at, tag))

        opened = False
        if name and name[0] == "/":
            if count.get(name[1:]):
                while stack[-1][1] != name[1:]:
                    pop()
                pop()
        elif name and name != "!" and name not in _VOID and name not in _RAW:
            if name in ("p", "li", "a") and stack and stack[-1][1] == name:
                pop()
            stack.append((i, name))
            count[name] = count.get(name, 0) + 1
            opened = True
        elif name is None:
            while stack:
                pop()
        yield i, opened, closed


def _furniture(events: list[tuple]) -> set[int]:
    """The events that open furniture."""
    named, spans, longest, mains, links, muted, text, articles = {}, {}, None, [], 0, 0, 0, 0
    bad = set()
    for i, opened, closed in _nested(events):
        name, attributes, before = events[i]
        if not links and not muted and before:
            text += len(before.strip())
        for at, tag in closed:
            links -= tag == "a"
            articles -= tag == "article"
            muted -= tag in _FURNITURE
            spans[at] = (text - spans[at], i)
            if tag == "article" and (longest is None or spans[at][0] > spans[longest][0]):
                longest = at
            elif tag == "main":
                mains.append(at)
        if not opened:
            continue
        spans[i] = text
        if name in _FURNITURE or name == "header" and not articles:
            bad.add(i)
        elif name == "form":
            named[i] = "part"
        elif attributes and name not in ("html", "head", "body", "main", "article"):
            if _HIDDEN.search(attributes):
                bad.add(i)
            elif kind := _named(attributes):
                named[i] = kind
        links += name == "a"
        articles += name == "article"
        muted += name in _FURNITURE
    # A teaser among related links may be the only article of a page; it is not what the page is about.
    cores = mains + ([] if longest is None or 5 * spans[longest][0] < text else [longest])
    for i, kind in named.items():
        held, end = spans[i]
        if any(i < core and spans[core][1] <= end for core in cores) or not cores and kind == "part" and 2 * held > text:
            continue
        bad.add(i)
    return bad


def _plain(pieces: list[str]) -> str:
    return " ".join(entities.unescape("".join(pieces)).split())


def lines(page: str) -> tuple[list[str], list[int], list[int]]:
    """The text of every line, how many of its characters are outside links, and the number of its article, 0 outside of any.

    Furniture between lines is one empty line.
    """
    out: list[str] = []
    plain: list[int] = []
    within: list[int] = []
    text: list[str] = []
    own: list[str] = []
    furniture = links = articles = opened = 0
    skipped = False

    def close_line():
        nonlocal skipped
        line = _plain(text) if text else ""
        if line or skipped and out and out[-1]:
            out.append(line)
            plain.append(len(line) if len(own) == len(text) else len(_plain(own)))
            within.append(opened if articles else 0)
        text.clear()
        own.clear()
        skipped = False

    def add(piece: str):
        nonlocal skipped
        if furniture:
            skipped = skipped or not piece.isspace() and piece != ""
        elif piece:
            text.append(piece)
            if not links:
                own.append(piece)

    events = _events(page)
    bad = _furniture(events)
    for i, starts, closed in _nested(events):
        name, _, before = events[i]
        add(before)
        if name is None or name.lstrip("/") in _BLOCKS:
            close_line()
        elif name == "br":
            add(" ")
        elif name == "":
            skipped = True
        for at, tag in closed:
            furniture -= at in bad
            links -= tag == "a"
            articles -= tag == "article"
        if starts:
            furniture += i in bad
            links += name == "a"
            opened += name == "article" and not articles
            articles += name == "article"
    return out, plain, within


def _unbroken(text: list[str], own: list[int], i: int) -> bool:
    """Whether no furniture stands between line ``i`` and the first text outside links from there on."""
    while text[i] and not own[i]:
        i += 1
    return own[i] > 0


def main_text(page: str | None) -> str:
    """The page's passages between surge and dive points, blocks joined by blank lines."""
    if not page:
        return ""
    text, own, within = lines(page)
    if not any(text):
        return ""
    sums = np.convolve(own, np.ones(WINDOW, int))[WINDOW - 1 :][: len(own)]
    surge = min(SURGE, SHARE * sums.max())
    kept, inside, since = [], False, 0
    for i, total in enumerate(sums):
        if not inside and total >= surge and total > 0 and _unbroken(text, own, i):
            # The surge's own line and the unbroken text just before it.
            kept += text[since:i]
            inside = True
        # Links alone do not end a passage within its own article.
        inside = inside and (total > 0 or within[i] > 0 and within[i] == within[i - 1])
        if inside and text[i]:
            kept.append(text[i])
        if not own[i] or inside:
            since = i + 1
    return "\n\n".join(kept)


def main_texts(pages: DataFrame) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            got = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
