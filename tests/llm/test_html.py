"""Main-text extraction: the reader, decoding against brute force, held-out accuracy, and odd pages."""

import itertools
import random
import re
from html import unescape

import numpy as np

from quarryline.llm import gbt, html
from quarryline.llm.dom import Page, parse


def blocks(page):
    return [(page.tag[n], t) for n, t in zip(page.run_node, page.run_text, strict=True)]


def test_reader_handles_broken_markup():
    p = parse('<p>a &amp; b&nbsp;&#233;&lt;i&gt;<p class="x>y">c <b>d<br>e<ul><li>f<li>g</ul>h</p>i <!-- <p>no</p> --><script>"</p>"</SCRIPT >j<')
    assert [t for _, t in blocks(p)] == ["a & b é<i>", "c d e", "f", "g", "h", "i j<"]
    p = parse("<table><tr><td>1<td>2<tr><td>3</table><dl><dt>x<dd>y</dl><select><option>no</select><title>no</title>z < 3 & 4 > 2")
    assert [t for _, t in blocks(p)] == ["1", "2", "3", "x", "y", "z < 3 & 4 > 2"]
    assert blocks(parse("<head><title>t</title><body><p>x")) == [("p", "x")]
    assert blocks(parse("<script>never closed <p>x")) == [] and blocks(parse(None)) == [] and blocks(parse("")) == []
    assert blocks(parse("plain  text\n\n here")) == [("#root", "plain text here")]


def test_reader_is_linear_on_hostile_input():
    for bad in ("<a '" * 20000, "<" * 100000, "<!--" * 50000, '<p a="' * 20000, "<div>" * 20000 + "x", "</p>" * 50000):
        parse(bad)


def chain(parents, texts):
    p = Page()
    for i, q in enumerate(parents[1:], 1):
        p.parent.append(q)
        p.tag.append("div")
        p.tokens.append(())
        if i in texts:
            p.run_node.append(i)
            p.run_text.append("t")
            p.run_link.append(0)
    return p


def test_decoding_finds_the_likeliest_consistent_choice():
    rng = random.Random(4)
    for _ in range(120):
        n = rng.randint(2, 9)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        leaves = set(range(n)) - set(parents)
        texts = leaves | {i for i in range(1, n) if rng.random() < 0.3}
        p = np.array([rng.random() for _ in range(n)])
        page = chain(parents, texts)
        best, choice = -1e9, None
        for keep in itertools.product((False, True), repeat=n):
            if any(keep[i] and not keep[parents[i]] for i in range(1, n)):
                continue
            if any(keep[i] and i not in texts and not any(keep[c] for c in range(n) if parents[c] == i) for i in range(n)):
                continue
            score = sum(np.log(p[i] if keep[i] else 1 - p[i]) for i in range(n))
            if score > best:
                best, choice = score, keep
        assert tuple(html.decode(page, p).tolist()) == choice


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 1] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    m = gbt.fit(x[:2000], y[:2000], trees=30)
    assert ((m.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_held_out_made_up_pages():
    rng, right, total = random.Random(123), 0, 0
    for _ in range(150):
        source, _ = html.training_page(rng)
        got = html.main_texts([source], html.trained())[0].split("\n\n")
        runs = parse(source).run_text
        total += len(runs)
        right += sum((t in got) == ("Q" in t) for t in runs)
    assert right / total > 0.96


def expected(source):
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    parts = (" ".join(unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in parts if b)


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    got = html.extract(pages).collect()
    assert len(got) == len(source)
    assert all(r.text == expected(source[r.page_id]) and r.n_chars == len(r.text) for r in got)


PAGE = """<html><body><header class="site"><div class=logo>Acme</div><nav><a href=/>Home</a> <a href=/n>News</a></nav></header>
<div class="cookie-notice"><p>We use cookies, accept them all.</p></div>
<main><article><h1>Title of it</h1><p>First paragraph, with a <a href=x>link</a> in it.</p><div class="advert">Buy this thing now, today only.</div>
<p>Second paragraph goes on for a while, and then it ends here.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></aside></main>
<form class="search"><label>Search</label><input></form>
<section class="comments"><h2>Comments</h2><div class="comment"><p>I liked this article very much, thanks.</p></div></section>
<footer><p>Copyright of somebody, all rights reserved.</p></footer></body></html>"""


def test_parts_that_are_not_the_article_go(spark):
    want = "Title of it\n\nFirst paragraph, with a link in it.\n\nSecond paragraph goes on for a while, and then it ends here."
    odd = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<nav><a>x</a></nav>"), (4, "y", "<article>" + "<p>Some words here.</p>" * 20000 + "</article>")]
    df = spark.createDataFrame([(*r, "t", 0) for r in odd], "page_id long, url string, html string, text string, n_chars int")
    got = [(r.page_id, r.url, r.text) for r in html.extract(df).collect()]
    assert got.count((1, "u", want)) == 2 and (2, None, "") in got and (3, "v", "") in got and (None, "w", "") in got
    assert len(next(t for i, _, t in got if i == 4)) == 20000 * 18 - 2
    assert html.extract(df.limit(0)).count() == 0
