"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import gbt
from quarryline.llm.common import slices
from quarryline.llm.dom import Page, parse

#: Tags with a feature of their own; the others share one.
TAGS = ("p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "h1", "h2", "table", "td", "blockquote", "figure", "body")
_GROUPS = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "th": "td", "dl": "ul", "menu": "nav", "dt": "li", "dd": "li", "pre": "blockquote", "fieldset": "form", "dialog": "form"}
#: Words of class, id, role and label attributes, by what they speak for.
WORDS = {
    "content": "article content main post entry story body text prose hentry blog page single markdown",
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc sitemap links tags tag categories skip tabs",
    "frame": "header footer masthead banner topbar bottom copyright legal logo branding site contentinfo credits",
    "aside": "sidebar aside related recommended recommendations widget rail popular trending more also promo teaser complementary recent",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promoted promotion adsense dfp outbrain taboola commercial",
    "notice": "cookie cookies consent gdpr notice alert warning disclaimer modal popup overlay paywall subscribe subscription newsletter signup banner toast hidden",
    "comments": "comment comments reply replies respond disqus discussion reviews review feedback reader readers responses thread",
    "tools": "share sharing social follow login search form button buttons print rating author byline meta date toolbar tools actions",
}
_BITS = {w: 1 << k for k, (_, words) in enumerate(WORDS.items()) for w in words.split()}
_N = len(WORDS)
_TAG_NUMBER = {t: i for i, t in enumerate(TAGS)}
#: Most nodes of a page have these features; see describe().
FEATURES = len(TAGS) + 1 + 3 * _N + 16


def describe(page: Page) -> np.ndarray:
    """A row for each node: its tag; its attribute words, those of its ancestors and of its parts;
    depth; text of the subtree, in links and outside, and its density; brothers and its place among them;
    its share of the page and its place in it."""
    n = len(page.tag)
    parent = page.parent
    text, link, own, runs, stops, prose = ([0] * n for _ in range(6))
    first = [1 << 60] * n
    upto = 0
    for node, t, in_link in zip(page.run_node, page.run_text, page.run_link, strict=True):
        size = len(t)
        text[node] += size
        own[node] += size
        link[node] += in_link
        runs[node] += 1
        stops[node] += t.count(". ") + t.count(", ") + (t[-1] in ".!?:")
        if page.tag[node] in ("p", "blockquote", "pre"):
            prose[node] += size
        first[node] = min(first[node], upto)
        upto += size
    mine, depth, above, tag, size = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n
    brothers, alike, place = [0] * n, {}, [0] * n
    for i in range(n):
        for w in page.tokens[i]:
            mine[i] |= _BITS.get(w, 0)
        t = page.tag[i]
        tag[i] = _TAG_NUMBER.get(_GROUPS.get(t, t), len(TAGS))
        p = parent[i]
        if p >= 0:
            depth[i] = depth[p] + 1
            above[i] = above[p] | mine[p] | (1 << (_N + tag[p]))
            place[i] = brothers[p]
            brothers[p] += 1
            alike[p, tag[i]] = alike.get((p, tag[i]), 0) + 1
    inside = [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (text, link, runs, stops, prose, size):
            a[p] += a[i]
        first[p] = min(first[p], first[i])
        inside[p] |= inside[i] | mine[i]
    x = np.zeros((n, FEATURES), np.float32)
    at = np.arange(n)
    x[at, tag] = 1
    c = len(TAGS) + 1
    up = np.array([p if p >= 0 else 0 for p in parent])
    bits = np.arange(_N)
    for k, flags in enumerate((mine, above, inside)):
        low = np.array(flags, np.int64)
        x[:, c + k * _N : c + (k + 1) * _N] = (low[:, None] >> bits) & 1
    c += 3 * _N
    tags_above = np.array(above, np.int64) >> _N
    has = lambda *names: (tags_above & sum(1 << _TAG_NUMBER[t] for t in names)) > 0
    text, link, own, runs, stops, prose, size, brothers = (np.array(v, np.float64) for v in (text, link, own, runs, stops, prose, size, brothers))
    total = max(1.0, text[0])
    some = np.maximum(text, 1)
    columns = (
        depth, np.log1p(text), np.log1p(own), link / some, text / (size + 1), np.log1p(size), stops / some * 100, prose / some, runs,
        brothers[up], np.array(place) / np.maximum(brothers[up], 1), np.array([alike.get((p, t), 0) for p, t in zip(parent, tag, strict=True)]) / np.maximum(brothers[up], 1),
        text / total, np.minimum(np.array(first, np.float64), total) / total, has("article", "main"), has("nav", "header", "footer", "aside", "form"),
    )
    for k, v in enumerate(columns):
        x[:, c + k] = v
    return x


def decode(page: Page, p: np.ndarray) -> np.ndarray:
    """Whether each node is kept: the likeliest choice in which all below a node that goes goes too, and
    a node that only holds others stays only with one of them."""
    n = len(page.parent)
    keep, go = np.log(np.clip(p, 1e-6, 1)).tolist(), np.log(np.clip(1 - p, 1e-6, 1)).tolist()
    own = [False] * n
    for i in page.run_node:
        own[i] = True
    # Of the children: the sum of the better of both, and what keeping the one that costs least takes off it.
    better, cost, down = [0.0] * n, [1e9] * n, list(go)
    stay = [0.0] * n
    for i in range(n - 1, -1, -1):
        stay[i] = keep[i] + better[i] - (0.0 if own[i] else cost[i])
        if i:
            q = page.parent[i]
            better[q] += max(stay[i], down[i])
            cost[q] = min(cost[q], max(0.0, down[i] - stay[i]))
            down[q] += down[i]  # all below goes with it
    children: dict[int, list[int]] = {}
    for i in range(1, n):
        children.setdefault(page.parent[i], []).append(i)
    kept = np.zeros(n, bool)
    kept[0] = stay[0] >= down[0]
    for i in range(n):
        if kept[i] and (below := children.get(i)):
            chosen = [c for c in below if stay[c] >= down[c]]
            if not chosen and not own[i]:
                chosen = [max(below, key=lambda c: stay[c] - down[c])]
            kept[chosen] = True
    return kept


# -- training -------------------------------------------------------------------------------------

_SYLLABLES = "ba co de fi gu la me no pi ra se tu van wil xor yam zen tri pol mar".split()


def _writer(rng: random.Random):
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def words(low: int, high: int) -> str:
        return " ".join(word() for _ in range(rng.randint(low, high)))

    def sentences(low: int, high: int) -> str:
        return " ".join(words(3, 16).capitalize() + rng.choice((".", ".", ".", "!", "?", ",")) for _ in range(rng.randint(low, high)))

    return word, words, sentences


def training_page(rng: random.Random) -> tuple[str, list[str]]:
    """A made-up page and its main blocks. These begin with a Q, which nothing else has in it, so that labels can be
    read off the text of the parsed tree."""
    word, words, sentences = _writer(rng)
    main: list[str] = []

    def good(t: str) -> str:
        t = "Q" + t
        main.append(" ".join(t.split()))
        return t

    def attr(group: str, chance: float = 0.8, also: str = "") -> str:
        if rng.random() > chance:
            return ""
        name = rng.choice(WORDS[group].split())
        if rng.random() < 0.5:
            name = rng.choice((f"{name}-{word()}", f"{word()}-{name}", f"{word()}_{name}", f"{name} {word()}"))
        return f' {rng.choice(("class", "class", "id"))}="{also}{name}"'

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(rng.randint(low, high))]
        return rng.choice((lambda: "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", lambda: " ".join(items), lambda: "<div>" + " | ".join(items) + "</div>"))()

    def paragraph(t: str) -> str:
        if rng.random() < 0.15:
            half = len(t) // 2
            t = t[:half] + rng.choice(("<b>", "<i>", "<br>", f'<a href="/{word()}">{words(1, 2)}</a> ', "<em>")) + t[half:]
        return f"<p>{t}" + ("</p>" if rng.random() < 0.85 else "")

    def content() -> str:
        out = []
        if rng.random() < 0.85:
            out.append(f"<h1>{good(words(2, 14))}</h1>")
        for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9, 14))):
            kind = rng.random()
            if kind < 0.62:
                t = sentences(1, 6) if rng.random() < 0.8 else words(1, 3) + "."
                out.append(paragraph(good(t)))
            elif kind < 0.70:
                out.append(f"<{(h := rng.choice(('h2', 'h3')))}>{good(words(1, 6))}</{h}>")
            elif kind < 0.76:
                out.append("<ul>" + "".join(f"<li>{good(sentences(1, 2) if rng.random() < 0.6 else words(1, 6))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif kind < 0.80:
                out.append(f"<blockquote>{good(sentences(1, 3))}</blockquote>")
            elif kind < 0.83:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{good(words(1, 4))}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.87:
                out.append(f"<div>{good(sentences(1, 4))}</div>")
            elif kind < 0.92:
                out.append(advert())
            elif kind < 0.95:
                out.append(related())
            elif kind < 0.97:
                out.append(notice())
            else:
                out.append(f"<pre>{good(words(3, 20))}</pre>")
        return "\n".join(out)

    def advert() -> str:
        body = rng.choice((lambda: sentences(1, 3), lambda: f"<p>{sentences(1, 3)}</p>", lambda: f'<a href="/{word()}">{sentences(1, 1)}</a>', lambda: words(2, 12)))()
        return f"<{(t := rng.choice(('div', 'div', 'aside', 'section')))}{attr('advert', 1)}>{body}</{t}>"

    def related() -> str:
        body = rng.choice((lambda: links(2, 6), lambda: f"<h3>{words(1, 3)}</h3>" + links(2, 6), lambda: f"<p>{sentences(1, 3)}</p>"))()
        return rng.choice((f"<aside{attr('aside', 0.6)}>{body}</aside>", f"<div{attr('aside', 1)}>{body}</div>"))

    def notice() -> str:
        body = rng.choice((lambda: sentences(1, 3), lambda: f"<p>{sentences(1, 3)}</p>", lambda: f"<p>{sentences(1, 2)}</p><button>ok</button>"))()
        return f"<{(t := rng.choice(('div', 'section', 'p', 'div')))}{attr('notice', 1)}>{body}</{t}>"

    def form() -> str:
        return f"<form{attr('tools', 0.5)}><label>{words(1, 3)}</label><input name=x>{'<p>' + sentences(1, 1) + '</p>' if rng.random() < 0.5 else ''}<button>{word()}</button></form>"

    def comments() -> str:
        one = lambda: f"<{(t := rng.choice(('div', 'li', 'article')))}{attr('comments', 0.7)}><p>{sentences(1, 4)}</p></{t}>"
        inner = "".join(one() for _ in range(rng.randint(1, 5)))
        head = f"<h2>{words(1, 2)}</h2>" if rng.random() < 0.5 else ""
        return f"<{(t := rng.choice(('div', 'section', 'ul', 'aside')))}{attr('comments', 1)}>{head}{inner}{form() if rng.random() < 0.3 else ''}</{t}>"

    def top() -> str:
        bar = links(2, 8)
        nav = rng.choice((f"<nav{attr('navigation', 0.4)}>{bar}</nav>", f"<div{attr('navigation', 1)}>{bar}</div>"))
        head = rng.choice((nav, f"<header{attr('frame', 0.4)}><h1>{words(1, 4)}</h1>{nav}</header>", f"<div{attr('frame', 1)}>{words(1, 5)}</div>{nav}", f"<header>{words(1, 6)}</header>", f"<header><p>{sentences(1, 1)}</p></header>{nav}"))
        return head

    def bottom() -> str:
        body = rng.choice((lambda: f"&copy; {word()}.example &middot; {sentences(1, 2)}", lambda: links(2, 6), lambda: f"<p>{words(2, 10)}</p>" + links(1, 4), lambda: f"<p>{sentences(1, 3)}</p>"))()
        return rng.choice((f"<footer{attr('frame', 0.3)}>{body}</footer>", f"<footer>{body}</footer>", f"<div{attr('frame', 1)}>{body}</div>"))

    extra = lambda: rng.choice((advert, advert, related, notice, form))()
    inner = content()
    if rng.random() < 0.15:
        inner = f"<div>{inner}</div>"
    if rng.random() < 0.15:
        inner += comments()
    holder = rng.random()
    if holder < 0.4:
        box = f"<article{attr('content', 0.3)}>{inner}</article>"
    elif holder < 0.55:
        box = f"<main{attr('content', 0.3)}>{inner}</main>"
    elif holder < 0.85:
        box = f"<{(t := rng.choice(('div', 'div', 'section')))}{attr('content', 1)}>{inner}</{t}>"
    elif holder < 0.93:
        box = f"<div>{inner}</div>"
    else:
        box = inner
    if rng.random() < 0.2:
        box = f"<main>{box}{related() if rng.random() < 0.4 else ''}</main>"
    if rng.random() < 0.25:
        box = f"<div{attr('content', 0.4)}>{box}{extra() if rng.random() < 0.6 else ''}</div>"
    parts = [top() if rng.random() < 0.92 else ""]
    parts += [extra() for _ in range(rng.choice((0, 0, 1, 1, 2)))]
    parts.append(box)
    parts += [extra() for _ in range(rng.choice((0, 0, 0, 1, 2)))]
    parts.append(comments() if rng.random() < 0.3 else "")
    parts.append(bottom() if rng.random() < 0.92 else "")
    return f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>", main


def labels(page: Page) -> np.ndarray:
    """1 for nodes of a training page with main text in them."""
    y = np.zeros(len(page.tag))
    for node, t in zip(page.run_node, page.run_text, strict=True):
        if "Q" in t:
            while node >= 0:
                y[node] = 1
                node = page.parent[node]
    return y


@cache
def trained(pages: int = 1000, seed: int = 11) -> gbt.Boosted:
    """The model, fitted on made-up pages; the same on every run."""
    rng = random.Random(seed)
    parsed = [parse(training_page(rng)[0]) for _ in range(pages)]
    return gbt.fit(np.concatenate([describe(p) for p in parsed]).astype(np.float64), np.concatenate([labels(p) for p in parsed]), trees=80)


# -- the operator ---------------------------------------------------------------------------------


def main_texts(htmls: list[str | None], model: gbt.Boosted) -> list[str]:
    pages = [parse(h) for h in htmls]
    rows = [describe(p) for p in pages]
    p = model.probability(np.concatenate(rows)) if rows else np.zeros(0)
    out, at = [], 0
    for page in pages:
        n = len(page.tag)
        kept = decode(page, p[at : at + n])
        at += n
        out.append("\n\n".join(t for node, t in zip(page.run_node, page.run_text, strict=True) if kept[node]))
    return out


def extract(pages: DataFrame, model: gbt.Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html).

    text: the main blocks in page order, joined by an empty line; in a block, references are decoded, white
    space is one space, ends are trimmed. A null or empty html, and a page without main text, give an
    empty text. Repeated rows give repeated rows; an empty table gives no rows; null ids and urls stay;
    further columns are ignored. Pages are handled one by one, so any of them may be long.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())  # a few KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            htmls, texts = b.column(2), []
            for i in range(0, len(htmls), 64):
                texts += main_texts(htmls[i : i + 64].to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
