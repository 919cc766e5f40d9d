import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from wayfloor.llm.html_text import extract_text, kept_lines, main_text
from wayfloor.llm.queries import queries

DIR = "/root/testdata/sf0.01"


def prose(rng, least=30, most=300):
    n, out = rng.randint(least, most), ""
    while len(out) < n:
        out += rng.choice(["walks", "über", "river", "a", "& sons", "x < y", "the", " gap", "日本語", "\U0001f600", "\"quoted\"", "far"]) + rng.choice([" ", "\n   ", ", ", ". "])
    return out.strip(" ,\n") + "."


def clean(text):
    return " ".join(text.split())


APART = [
    '<nav class="x"><ul><li><a href="/a">Home</a></li><li><a href="/b">{}</a></li></ul></nav>',
    "<header><h2>{}</h2></header>",
    "<footer><p>{}</p></footer>",
    '<aside><h3>Teasers</h3><p>{}</p></aside>',
    '<div class="cookie-notice"><p>{}</p><button>Accept</button></div>',
    '<div id="ad-slot-3">{}</div>',
    '<div class="sponsored box"><p>{}</p></div>',
    '<form action="/s"><label>{}</label><input name="q"><select><option>{}</option></select></form>',
    "<script>if (a < b) document.write('<p>{}</p>');</script>",
    "<style>p > b {{ content: '{}' }}</style>",
    "<!-- <p>{}</p> -->",
    '<section id="comments"><h2>Readers say</h2><div class="comment"><p>{}</p></div><article class="comment"><p>{}</p></article></section>',
    '<div role="complementary"><p>{}</p></div>',
    '<div class="relatedPosts"><p>{}</p></div>',
    '<div style="display: none"><p>{}</p></div>',
    "<noscript><p>{}</p></noscript>",
    '<div class="newsletter-signup"><p>{}</p></div>',
    '<div hidden><p>{}</p></div>',
]


def page(rng, wrap):
    """A page and the blocks of its article."""
    esc = lambda t: html.escape(t, quote=rng.random() < 0.5)
    apart = lambda: rng.choice(APART).replace("{}", esc(prose(rng))).replace("{{", "{").replace("}}", "}")
    blocks, body = [], []
    for i in range(rng.randint(1, 12)):
        t = prose(rng, 3, 400)
        kind = rng.randrange(8) if i else 7
        if kind == 0:
            items = [prose(rng, 3, 40) for _ in range(3)]
            body.append("<ul>" + "".join(f"<li>{esc(x)}</li>" for x in items) + "</ul>")
            blocks += map(clean, items)
            continue
        if kind == 1:
            body.append(apart())
            continue
        if kind == 2:
            body.append(f"<table><tr><td>{esc(t)}</td><td>two</td></tr></table>")
            blocks.append(clean(t) + " two")
            continue
        if kind == 3:
            t2 = prose(rng, 3, 40)
            body.append(f"<p>{esc(t)}<br/>{esc(t2)} <a href='/x?a=1&amp;b=\">\"'>link</a><!-- c --></p>")
            blocks.append(clean(t + " " + t2 + " link"))
            continue
        tag = rng.choice(["p", "blockquote", "div", "h2", "pre"]) if i else "h1"
        body.append(f"<{tag}>{'<em>' if i % 2 else ''}{esc(t)}{'</em>' if i % 2 else ''}" + ("" if tag == "p" and rng.random() < 0.3 else f"</{tag}>"))
        blocks.append(clean(t))
    before, after = "".join(apart() for _ in range(rng.randint(0, 4))), "".join(apart() for _ in range(rng.randint(0, 4)))
    open_, close = wrap
    head = f"<!DOCTYPE html><html><head><title>{esc(prose(rng))}</title><meta charset=utf-8></head><body class='has-sidebar'>"
    return head + before + open_ + "\n".join(body) + close + after + rng.choice(["</body></html>", "", "</bo"]), "\n".join(blocks)


WRAPS = [("<article>", "</article>"), ("<main>", "</main>"), ("<main><div class=grid><article class='post'>", "</article></div></main>"), ('<div class="post-content">', "</div>"), ('<form id="aspnet"><article>', "</article></form>"), ("<DIV><ARTICLE>", "</ARTICLE></DIV>")]


@pytest.mark.parametrize("wrap", WRAPS, ids=[w[0][:24] for w in WRAPS])
def test_articles_known_by_construction(wrap):
    rng = random.Random(str(wrap))
    wrong = 0
    for _ in range(150):
        text, want = page(rng, wrap)
        wrong += main_text(text) != want
    assert wrong == 0


def test_unmarked_pages_by_their_lines():
    menu = "".join(f'<div><a href="/{i}">Section number {i}</a></div>' for i in range(20))
    text = ["A headline", "First paragraph of the text, long enough to surge. " * 3, "Short.", "Another paragraph that goes on for quite some time. " * 3]
    page_ = f"<body><div>{menu}</div><div><h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:]) + f"</div><div>{menu}</div><div>(c) example</div></body>"
    assert main_text(page_) == "\n".join(map(clean, text))


def test_short_pages():
    assert main_text("<body><div><a href=x>Menu</a></div><h1>Tiny</h1><p>One line.</p><div class=footer>Imprint of all</div></body>") == "Tiny\nOne line."
    assert main_text("<body><nav>a</nav><a href=x>only links</a></body>") == ""


def test_surge_and_dive():
    assert kept_lines([0, 10, 12, 0, 0, 0], 50, 0.0) == [(1, 3)]
    assert kept_lines([0, 0, 5, 100, 0, 0, 7, 0, 0, 0, 3], 50, 0.0) == [(2, 7)]
    assert kept_lines([0, 0, 0], 1, 0.0) == [] == kept_lines([], 1, 0.0)
    assert kept_lines([90, 0, 0, 0, 0, 200, 10], 50, 0.5) == [(5, 7)]


def test_given_pages(spark):
    """Their articles hold a headline and paragraphs, which a pattern can read."""
    rows = {r.page_id: r.html for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    got = queries()["op11_html_text"](spark, DIR).collect()
    assert len(got) == len(rows)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", rows[r.page_id], re.S)
        blocks = [clean(html.unescape(re.sub(r"<[^>]*>", " ", b))) for b in re.split(r"</?(?:p|h1)>", inner[1])]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (3, "u", "<"), (4, "u", "<article>a &amp; b &#x1F600; &unknown; &am"), (5, "u", "plain words " * 20), (6, "u", "<article>x</article>"), (6, "u", "<article>x</article>"), (7, "u", "<!-- never closed <article>x</article>"), (8, "u", "<article>a<script>b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("__html", F.lit("other"))
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract_text(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (None, "", 0), (3, "", 0), (4, "a & b \U0001f600 &unknown; &am", 21), (5, ("plain words " * 20).strip(), 239), (6, "x", 1), (6, "x", 1), (7, "", 0), (8, "a", 1)], key=str)
    assert extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "hostile",
    ["<div>" * 200_000, "</div>" * 200_000, '<a b="' * 150_000, "<p class='a' " + 'x="1" ' * 160_000, "<" * 1_000_000, "<!" * 500_000, "<title>" * 140_000, "<div class=ad>x" * 70_000, "<a>" * 300_000, "a" * 1_000_000, "<article>x" * 100_000, "&" * 1_000_000],
    ids=lambda t: t[:12],
)
def test_a_megabyte_takes_seconds(hostile):
    began = time.time()
    main_text(hostile)
    assert time.time() - began < 10
