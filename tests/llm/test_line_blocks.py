from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from clipgrid.llm.line_blocks import extract, lines, main_text, spans

LONG = "This is a sentence of the article that is long enough to count as text and goes on for a while."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\nonly", "plain text only"),
        (page("<nav><a href=/a>menu</a></nav><article><h1>H</h1><p>One &amp; <b>two</b>\n three<p>Four &lt;5&#33;</article><footer>&copy; f</footer>"), "H\nOne & two three\nFour <5!"),
        (page("<article><p>a</p><div class='ad'>buy</div><p>b</p></article>"), "a\nb"),
        (page("<article><p>a</p><section id=comments><p>first!</p></section></article>"), "a"),
        (page("<article><p>a</p><aside>x<aside>y</aside>z</aside><p>b</p></article>"), "a\nb"),
        (page("<header>Site</header><article><header><h1>Title</h1></header><p>x</p></article>"), "Title\nx"),
        (page("<article><p><b>Bold<br><p>next</article>"), "Bold\nnext"),
        (page("<!-- ad --><article>a<!-- <p>no</p> -->b<br/>c&nbsp;d</article>"), "ab\nc d"),
        (page("<div>Home <a href=/>x</a></div>" + f"<div class=story><p>{LONG}</p><p>{LONG}</p></div><form>e-mail <input></form>"), f"Home x\n{LONG}\n{LONG}"),
        (page(f"<ul><li><a>one</a><li><a>two</a></ul><hr><p>{LONG}</p><div class='cookie-notice'>We use cookies</div>"), LONG),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p>a</p><p title=\"x>y\">b</p><p title='", "a\nb"),
        (page("<main><p>m</p></main><p>outside</p>"), "m"),
        (page("<article></article>"), ""),
        ("a < b and c > d", "a < b and c > d"),
    ],
)
def test_pages(html, want):
    assert main_text(html) == want


def test_surge_and_dive():
    assert spans(np.array([0, 0, 0, 9, 8, 0, 7, 0, 0, 0, 5, 0]), 3) == [(1, 7, 17), (8, 11, 5)]
    assert spans(np.array([], int)) == [] and spans(np.array([0, 0])) == []
    assert spans(np.array([4]), 3) == [(0, 1, 4)]


def test_links_are_counted():
    assert list(lines("<p>ab <a>cd</a></p>")) == [("ab cd", 2, False, False)]


def test_table(spark):
    rows = [(1, "u", page("<article><p>é x</p></article>")), (2, None, None), (2, None, None), (3, "v", "<p>" + "word " * 200000)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    found = sorted((tuple(r) for r in extract(df, ["page_id", "url"]).collect()), key=lambda r: r[0])
    assert found == [(1, "u", "é x", 3), (2, None, "", 0), (2, None, "", 0), (3, "v", ("word " * 200000).strip(), 999999)]
    assert extract(df.limit(0), ["page_id", "url"]).collect() == []


def test_the_longest_text_counts_wherever_the_mark_is():
    teasers = "".join(f"<article class=card><h2>Teaser {i}</h2><p>Read what happened next.</p></article>" for i in range(3))
    found = main_text(page(f"{teasers}<div class=body><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"))
    assert found.count(LONG) == 3
    assert main_text(page(f"<article><p>{LONG}</p></article><p>Short text outside.</p>")) == LONG


def test_short_paragraphs_between_and_after_spans():
    menu = "<ul>" + "<li><a>one</a></li>" * 3 + "</ul>"
    assert main_text(page(f"<p>{LONG}</p>{menu}<p>In short</p>{menu}<p>{LONG}</p>{menu}<p>The end.</p>{menu}<p>imprint</p>")) == f"{LONG}\nIn short\n{LONG}\nThe end."


@pytest.mark.parametrize(
    "attributes",
    ['style="overflow: hidden"', 'title="The hidden cost of X"', "class='content has-sidebar'", "class='page no-sidebar'", "class='post comments-open'"]
    + ["class=elementor-widget-theme-post-content", "class=social-science", "data-x='class=\"ad\"'", "data-hidden=1"],
)
def test_attributes_that_are_no_noise(attributes):
    assert main_text(page(f"<article><div {attributes}><p>x</p></div></article>")) == "x"


@pytest.mark.parametrize("attributes", ["hidden", "class='a hidden' hidden=''", "class=site-footer", "class='x post-comments'", "id=comments", "aria-hidden=true"])
def test_attributes_that_are_noise(attributes):
    assert main_text(page(f"<article><p>x</p><div {attributes}><p>y</p></div></article>")) == "x"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><p class=notice>x<p>text</article>", "text"),
        ("<article><ul><li class=share>a<li>b</ul><p>c</article>", "b\nc"),
        ("<article><svg class=icon/><math/><p>text</p></article>", "text"),
        ("<article><div><section class=ad>x</div><p>text</p></article>", "text"),
        ("<article><table><tr class=ad><td>x<tr><td>y</table><dl><dt class=ad>s<dd>t</dl></article>", "y\nt"),
        ("<article><div class=ad><p>x</div>y<p>read <span class=share>tweet</span> more</article>", "y\nread more"),
        ("<article class='post sidebar'><p>text</p></article>", "text"),
        ("<div class=widget><article><p>text</p></article></div>", "text"),
        ("<article><p>text</p></article><section id=comments><article><p>first</p></article></section>", "text"),
        ("<div class=banner><main><p>text</p></main></div>", "text"),
    ],
)
def test_noise_ends_and_spares_the_article(body, want):
    assert main_text(page(body)) == want


def test_line_blocks_alone_find_the_article():
    """Without names, roles and marks, surge and dive alone give nearly the same texts."""
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"])["html"].to_pylist()
    scores = []
    for page in pages:
        bare = re.sub(r"<(/?)(?:article|main|nav|footer|aside|header|form|menu|dialog)\b[^>]*>", r"<\1div>", page)
        bare = re.sub(r"\s(?:class|id|role|itemprop)=\"[^\"]*\"", "", bare)
        own, want = Counter(main_text(bare)), Counter(main_text(page))
        both = own.total() + want.total()
        scores.append(2 * (own & want).total() / both if both else 1.0)
    assert sum(scores) / len(scores) >= 0.9
