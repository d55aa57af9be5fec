from __future__ import annotations

import html as lib
import re

import pyarrow.parquet as pq
import pytest

from apilens.llm import html_extract as H
from apilens.llm.html_extract import extract, main_text, parsed

BODY = "A first paragraph, with enough words, to be the content. It goes on for a while, and then it ends."


def article(page):
    inside = re.search(r"(?s)<article>(.*?)</article>", page)[1]
    return " ".join(lib.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0].strip("</>") in ("b", "i") else " ", inside)).split())


def test_pages_of_the_table():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist():
        assert main_text(page) == article(page)


def unmarked(page):
    """The page without any tag or name that tells its parts apart."""
    return re.sub(r"(</?)(?:article|nav|footer)>", r"\1div>", page).replace(' class="ad"', "")


def test_ratios_decide_where_nothing_is_marked(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    long = [p for p in pages if len(article(p)) > 600]
    assert len(long) > 150
    assert sum(main_text(unmarked(p)) == article(p) for p in long) >= 0.8 * len(long)
    assert sum(main_text(p, names=False) == article(p) for p in long) >= 0.7 * len(long)
    monkeypatch.setattr(H, "fused", lambda length, marks: 1.0)
    assert sum(main_text(unmarked(p)) == article(p) for p in long) == 0


def test_ratios_are_aggregated_smoothed_and_fused():
    assert H.fused(100, 0) == 10 and H.fused(90, 2) > H.fused(100, 1) and H.fused(9000, 200) == H.ENOUGH
    elements, blocks = parsed("<body><div><p>aaaa, aaaa.</p><p>bb</p></div><div class=x>cccccc</div></body>")
    H._placed(elements, True)
    assert [(b.text, b.chars, b.marks) for b in blocks] == [("aaaa, aaaa.", 11, 2), ("bb", 2, 0), ("cccccc", 6, 0)]
    assert blocks[0].element.path == blocks[1].element.path != blocks[2].element.path
    first, second, third = H.smoothed([10.0, 10.0, 0.0], [b.element.section for b in blocks])
    assert first == pytest.approx(10, abs=0.1) and second > 9.4 and third < 0.6  # other sections hardly count
    assert H.block_scores(blocks)[0] == pytest.approx(H.fused(6.5, 1.0), rel=0.02)


PROBES = ['<div class="layout has-sidebar">{}</div>', '<article class="post comments-open">{}</article>', '<div id="content-share">{}</div>', '<div class="nav-open">{}</div>', '<form id="aspnetForm">{}</form>', '<div class="main sidebar-right">{}</div>', '<table><tr><td class="widget">{}</td></tr></table>']


@pytest.mark.parametrize("wrapper", PROBES)
@pytest.mark.parametrize("inside", [f"<h1>Heading</h1><p>{BODY}</p>", f"<h1>Heading</h1><p>{BODY}</p><p>Short.</p><ul><li>one</li><li>two</li></ul><p>{BODY}</p>"])
def test_wrappers_whose_names_mislead(wrapper, inside):
    want = " ".join(re.sub("<[^>]*>", " ", inside).split())
    assert main_text(f"<html><body>{wrapper.format(inside)}</body></html>") == want
    menu, foot = '<ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul>', "<footer><p>All rights, reserved.</p></footer>"
    assert main_text(f"<html><body>{menu}{wrapper.format(inside)}{foot}</body></html>") == want


def test_pages_without_article():
    story = "".join(f"<p>{BODY} {i}.</p>" for i in range(5)) + "<table><tr><td>cell</td><td>42</td></tr></table><blockquote><p>Quoted.</p></blockquote>"
    want = " ".join(re.sub("<[^>]*>", " ", story).split())
    links = "".join(f'<div><a href="/{i}">Link number {i}</a></div>' for i in range(12))
    for page in (f"<div>{links}</div><div><h1>T</h1><div>{story}</div></div><div>{links}</div>", f"<table><tr><td>{links}</td><td><h1>T</h1>{story}</td></tr></table>"):
        assert main_text(f"<html><body>{page}</body></html>") == f"T {want}"


def test_deep_and_long_pages_take_linear_time():
    deep = "<div>" * 20_000 + f"<p>{BODY}</p>" + "</div>" * 20_000
    assert main_text(deep) == BODY
    assert main_text("<b>" * 20_000 + f"<p>{BODY}</p>" * 50 + "</x>" * 20_000) == " ".join([BODY] * 50)
    assert main_text("<div>x, y." * 5000 + "</i>" * 5000) != ""


@pytest.mark.parametrize("apart", [
    "<nav><ul><li>One, two, three. Four, five.</li></ul></nav>", "<header>Site, name, and motto, here.</header>", '<div class="site-header">Site, name, and motto, here.</div>', "<footer>All, rights, reserved.</footer>", "<aside>More, to, read.</aside>",
    '<div class="sidebar">Some, longer, text, that is not content, really not.</div>', '<div class="cookie-notice">We use, cookies, everywhere, all the time.</div>', '<section id="comments"><p>I agree, with all of this, and more. Really, I do.</p></section>',
    '<form><p>Your name, please, and address.</p><input></form>', "<script>var x = '<p>not, text</p>';</script>", "<style>p { margin: 0 }</style>", "<!-- a comment, with <p>tags</p> -->", '<div class="ad">Buy, now, and save, a lot.</div>',
])
def test_apart(apart):
    page = f'<html><head><title>T</title></head><body>{apart}<div class="story"><h1>Heading</h1><p>{BODY}</p><p>Short.</p></div>{apart}</body></html>'
    assert main_text(page) == f"Heading {BODY} Short."
    assert main_text(f"<html><body><article><h1>Heading</h1><p>{BODY}</p>{apart if 'header' not in apart else ''}<p>Short.</p></article></body></html>") == f"Heading {BODY} Short."


def test_white_space_entities_and_inline():
    page = f"<article><p>{BODY}</p><p>  a&amp;b\n\n<b>c</b>d&nbsp;e &lt;x&gt;<br>f</p></article>"
    assert main_text(page) == f"{BODY} a&b cd e <x> f"


def test_odd_markup():
    for page in (None, "", "plain words only", "<p", "<!-- open", "<script>never closed", "<p title='open>text", "</div></div>", "<" * 5000, "<p>" * 5000 + "deep", "<a b=\"" * 2000):
        assert isinstance(main_text(page), str)
    assert main_text("plain words only") == "plain words only"
    assert [x.text for x in parsed("a < b")[1]] == ["a < b"]
    long = f"<article>{f'<p>{BODY}</p>' * 5000}</article>"
    assert main_text(long) == " ".join([BODY] * 5000)


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{BODY}</p></article>", 5), (None, None, None, 6), (1, "u", "", 7)], "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in extract(df).collect()), key=str)
    assert got == sorted([(1, BODY, len(BODY)), (None, "", 0), (1, "", 0)], key=str)
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("holder", ['article class="post no-sidebar"', 'main class="has-comments"', 'div class="no-sidebar"', 'article id="related"', 'form action="./Default.aspx"', 'div class="widget"'])
def test_names_of_what_holds_the_article(holder):
    page = f'<html><body><nav><ul><li><a href="/">One, two, three. Four.</a></li></ul></nav><{holder}><nav>Home, and more.</nav><h1>Heading</h1><p>{BODY}</p><p>{BODY}</p><div class="comments"><p>I agree, with all.</p></div></{holder.split()[0]}><footer>All, rights.</footer></body></html>'
    assert main_text(page) == f"Heading {BODY} {BODY}"


@pytest.mark.parametrize("part", ['<section id="discussion"><p>{}</p></section>', '<h2 id="related-work">{}</h2>', '<h2 id="search-algorithms">{}</h2>', '<p id="notice">{}</p>', '<div class="search-algorithms"><p>{}</p></div>', '<section id="related-work"><p>{}</p></section>'])
def test_names_inside_the_article(part):
    assert main_text(f"<html><body><article><h1>Heading</h1><p>{BODY}</p>{part.format('A part of it.')}<p>{BODY}</p></article></body></html>") == f"Heading {BODY} A part of it. {BODY}"


def test_long_comments_stay_apart():
    many = f'<div class="comments">{f"<article><p>{BODY}</p></article>" * 30}</div>'
    for page in (f"<article><h1>Heading</h1><p>{BODY}</p></article>{many}", f"<form><div><h1>Heading</h1><p>{BODY}</p></div>{many}</form>"):
        assert main_text(f"<html><body>{page}</body></html>") == f"Heading {BODY}"


@pytest.mark.parametrize("part", [
    "<ul>" + "<li>An item of a list</li>" * 8 + "</ul>", "<table>" + "<tr><td>One cell</td><td>42</td></tr>" * 4 + "</table>", "<figure><img><figcaption>A caption</figcaption></figure>",
    "<h2>Next</h2>", '<p><a href="/x">A link</a></p>', "<div>A short box</div>", "<dl><dt>Term</dt><dd>Meaning</dd></dl>",
])
def test_articles_directly_in_body(part):
    text = " ".join(re.sub("<[^>]*>", " ", part).split())
    paragraphs = [f"<p>{BODY} {BODY} {i}.</p>" for i in range(6)]
    for body in (["<h1>Heading</h1>", *paragraphs[:3], part, *paragraphs[3:]], ["<h1>Heading</h1>", *paragraphs, part if "div" not in part and "href" not in part else ""]):
        page = f'<html><body><nav><a href="/">Home</a></nav>{"".join(body)}<nav><a href="/next">Next page</a></nav><footer>All, rights.</footer></body></html>'
        want = " ".join(" ".join(re.sub("<[^>]*>", " ", b).split()) for b in body if b)
        assert text and main_text(page) == want
        assert main_text(page.replace("<html><body>", "").replace("</body></html>", "")) == want
