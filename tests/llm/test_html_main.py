"""Pages with known articles."""

from __future__ import annotations

import random
import re
import time

import pytest

from cataloom.llm.html_main import OUTSIDE, SHARE, SURGE, extract_main_text, main_text, masses, page_lines, regions, window_sums

ARTICLE = "<h1>A &amp; B</h1><p>One&nbsp;line<br>more</p><p>two <b>bold<i>er</i></b>\n words<ul><li>x<li>y</ul><blockquote>q</blockquote>"
EXPECTED = "A & B\n\nOne line more\n\ntwo bolder words\n\nx\n\ny\n\nq"
LONG = "Words that make up a paragraph of an article which is long enough to be taken for one, and then some more."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>home</a></nav><article>{ARTICLE}</article><footer>f</footer></body></html>",
        f"<body><div class='site-header'>Head</div><main>{ARTICLE}<aside>side</aside></main><div id='comments'><p>first!</p></div>",
        f"<header>h</header><article>{ARTICLE}<script>if (a < b) {{ '</p>' }}</script><form><input><p>name</p></form></article><section class=comments><article class=comment>nice</article></section>",
        f"<div class=cookie-notice>we bake</div><ARTICLE>{ARTICLE}<div class='ad-slot'>buy</div></ARTICLE><div role=contentinfo>c</div>",
        f"<!-- <article>no</article> --><article>{ARTICLE}",
        f"<article><div hidden>no</div>{ARTICLE}<div style='display:none'>no</div></article><div class='newsletter signup'>mail</div>",
    ],
)
def test_articles(page):
    assert main_text(page) == EXPECTED


def test_pages_that_mark_no_article():
    page = f"<div><a href=1>a link of a menu</a></div><div><p>{LONG}</p><p>short</p></div><div><a href=2>more</a></div>"
    assert main_text(page) == f"{LONG}\n\nshort"
    assert main_text(f"<div class=content-with-sidebar><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>") == LONG
    assert main_text("<p>tiny") == "tiny"


@pytest.mark.parametrize("page", [None, "", "   ", "<nav>only a menu</nav>", "<script>x", "<article></article><p>not the article</p>"])
def test_no_text(page):
    assert main_text(page) == ""


def test_broken_markup():
    assert main_text("</div></p>a < b and c > d <b") == "a < b and c > d"
    assert main_text("<p>" * 3000 + "deep" + "</p>" * 3000) == "deep"
    assert main_text("<div>" * 3000 + "deep") == "deep"


def test_table(spark):
    rows = [(1, "u", "<article><p>x</p></article>", "old"), (2, None, None, None), (None, "u", "<p>y", "old"), (2, None, None, None)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "y", 1), (1, "x", 1), (2, "", 0), (2, "", 0)]
    assert extract_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0


def by_brute_force(lines, values, window):
    """Regions from every window's own sum."""
    sums = [sum(values[i : i + window]) for i in range(len(values))]
    kept, peaks, at = [], [], 0
    while at < len(values):
        if values[at] == 0:
            at += 1
            continue
        end = at
        while end < len(values) and sums[end] > 0:
            end += 1
        last = max(i for i in range(at, end) if values[i])
        kept.append((at, last))
        peaks.append(max(sums[at : last + 1]))
        at = end
    if not peaks:
        return ""
    least = max(SURGE if max(peaks) >= SURGE else 0, SHARE * max(peaks))
    return "\n\n".join(x.text for (a, b), peak in zip(kept, peaks, strict=True) if peak >= least for x in lines[a : b + 1] if x)


def random_page(r):
    parts = []
    for _ in range(r.randrange(1, 25)):
        words = " ".join(r.choice(["ab", "cdefgh", "i", "jklmnopqrst"]) for _ in range(r.randrange(0, 30)))
        parts.append(r.choice(["<p>%s</p>", "<nav>%s</nav>", "<div>%s</div>", "<p><a href=x>%s</a></p>", "<article><p>%s</p></article>", "<aside>%s</aside>", "<li>%s", "<main>%s</main>", "<section class=ad>%s</section>"]) % words)
    return "".join(parts)


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_windows_against_brute_force(window):
    r = random.Random(window)
    for _ in range(300):
        page = random_page(r)
        lines, best = page_lines(page, window)
        assert main_text(page, window) == by_brute_force(lines, masses(lines, best), window)


def test_window_sums_and_regions():
    assert window_sums([1, 0, 0, 0, 5, 2], 3) == [1, 0, 5, 7, 7, 2]
    assert regions([1, 0, 0, 0, 5, 2], [1, 0, 5, 7, 7, 2]) == [(0, 0, 1), (4, 5, 7)]


def test_the_distribution_chooses():
    """Marks are no condition: the same article without them; and the window decides what hangs together."""
    nav, foot = "<nav>" + "<a href=1>menu</a>" * 9 + "</nav>", "<footer>" + LONG + "</footer>"
    body = f"<h1>Title</h1><p>{LONG}</p><p>tail</p>"
    want = f"Title\n\n{LONG}\n\ntail"
    for tag in ("article", "main", "div", "section"):
        assert main_text(f"{nav}<{tag}>{body}</{tag}>{foot}") == want
    split = f"<p>{LONG}</p><p><a href=1>{LONG}</a></p><p>tail</p>"
    assert main_text(split, 3).endswith("tail") and not main_text(split, 1).endswith("tail")
    short, block = "<article><p>Some words.</p></article>", f"<p>{LONG * 40}</p>" * 3
    assert main_text(short + f"<p>{LONG}</p>") == "Some words."
    assert main_text(short + block).startswith("Words that"), f"marks weigh {OUTSIDE} times as much, no more"


def test_marks_may_go(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    assert pages
    for page in pages:
        assert main_text(re.sub(r"(</?)article", r"\1div", page)) == main_text(page)


@pytest.mark.parametrize("unit", ['<a href="x>', "<a b='", "<b><p></b>", "<!--", "<li>", "<div>x", "<td><li>", "</span>", "<article>x</article>", "<main>x<aside>y</aside>", '<i t="a>b">', "&lt;<"])
def test_long_pages_take_linear_time(unit):
    began = time.process_time()
    main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - began < 30


def test_content_of_any_kind_stays():
    page = f"<article><p>{LONG}</p><math><mi>x</mi></math><object>fallback</object><xmp>a<b>c</xmp><p>z</p></article>"
    assert main_text(page) == f"{LONG}\n\nxfallback\n\na<b>c\n\nz"
