"""Pages of known text, and the given pages against a search for their article."""

import html
import re

import pytest

from tidemark.llm.html_text import extracted, main_text
from tidemark.llm.q_html_text import op5_html_text

PROSE = "The quick brown fox jumps over the lazy dog, and then, after a while, it sleeps."


def page(body):
    return f"<html><head><title>T</title><script>var x = '<p>no</p>';</script></head><body>{body}</body></html>"


AROUND = (
    '<header class="site"><a href="/">Home</a> Slogan of the site, long enough to count.</header>'
    '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
    '<div class="cookie-notice"><p>We use cookies, as all do, and here we tell you about it at length.</p></div>'
)
AFTER = (
    '<aside><p>Also read this, that, and the other thing, which is quite long too.</p></aside>'
    '<section id="comments"><div class="comment"><p>First, I think, as a reader, that this is good.</p></div></section>'
    '<form><label>Mail</label><input name="m"><button>Send</button></form><footer>&copy; Site, all rights reserved, forever.</footer>'
)

CASES = {
    "article": (page(f"{AROUND}<article><h1>Head</h1><p>{PROSE}</p><p>Short.</p></article>{AFTER}"), ["Head", PROSE, "Short."]),
    "unclosed": (page(f"{AROUND}<article><h1>Head</h1><p><b>Bold start.<br><p>{PROSE}<p>End.</article>{AFTER}"), ["Head", "Bold start.", PROSE, "End."]),
    "divs": (page(f'{AROUND}<div id="x"><div class="c"><h2>H</h2><p>{PROSE}</p><p>{PROSE}</p></div></div>{AFTER}'), ["H", PROSE, PROSE]),
    "inner parts": (
        page(f'<main><div class="post-body"><p>{PROSE}</p><div class="ad">Buy now, cheap, today, everything must go.</div>'
             f'<ul><li>item one</li><li>item two</li></ul><ul class="x"><li><a href="/">linked, linked, linked</a></li></ul><p>{PROSE}</p></div>'
             f'<div class="share-links"><a href="#">Tweet</a></div></main>{AFTER}'),
        [PROSE, "item one", "item two", PROSE],
    ),
    "references": (page("<article><p>a &amp; b &lt;c&gt;&nbsp;&eacute;&#233;&#x41; &am\n\n d</p></article>"), ["a & b <c> ééA &am d"]),
    "hidden and comments": (page(f'<article><!-- <p>old</p> --><p hidden>secret</p><p style="display: none">x</p><p>{PROSE}</p></article>'), [PROSE]),
    "quoted bracket": (page(f'<article><p title="a > b" data-x=\'<p>\'>{PROSE}</p></article>'), [PROSE]),
    "no tags": (PROSE, [PROSE]),
    "cut off": (f"<html><body><article><p>{PROSE}</p><p>more <b", [PROSE, "more"]),
    "open script": (f"<article><p>{PROSE}</p></article><script>var a = 1;", [PROSE]),
    "table": (page(f"<article><p>{PROSE}</p><table><tr><th>k</th><td>v</td></tr><tr><td>x<td>y</table></article>"), [PROSE, "k v", "x y"]),
    "stray ends": (page(f"</div></p><article></span><p>{PROSE}</i></p></article></article>"), [PROSE]),
    "siblings": (page(f'<div class="a"><p>{PROSE}</p><p>{PROSE}</p></div><div class="b"><p>{PROSE} {PROSE}</p></div>'), [PROSE, PROSE, f"{PROSE} {PROSE}"]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    source, want = CASES[name]
    assert main_text(source) == "\n\n".join(want)


def known(source):
    """The article of a given page by plain search."""
    body = re.search(r"<article>(.*?)</article>", source or "", re.S)
    parts = re.split(r"</?(?:h1|p)>", body[1]) if body else []
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", p).replace("<b>", "").replace("</b>", "")).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_given_pages(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op5_html_text(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == known(pages[r.page_id].html) and r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def test_edges(spark):
    sources = [None, "", " \n", "<p></p>", "<" * 50_000, "<div>" * 20_000 + PROSE, f"<article>{'<p>' + PROSE + '</p>'}</article>" * 2, '<p x="' * 3000]
    rows = [(i, None, s, "clash") for i, s in enumerate(sources)] + [(6, "u", sources[6], "clash")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text) for r in extracted(pages).collect())
    assert len(got) == 9 and [t for _, t in got[:4]] == [""] * 4
    assert got[4][1] == "<" * 50_000 and got[5][1] == PROSE and got[6] == got[7]
    assert extracted(pages.where("false")).count() == 0


LONG = f"<h1>Head</h1><p>{PROSE} {PROSE}</p><p>{PROSE} Then more.</p>"
WANT = ["Head", f"{PROSE} {PROSE}", f"{PROSE} Then more."]
WRAPPERS = [
    '<div class="content with-sidebar">{}</div>', '<div id="page" class="no-sidebar">{}</div>', '<section class="post social">{}</section>',
    '<article class="post has-related">{}</article>', '<article class="post related">{}</article>', "<form action='/'><div>{}</div></form>",
    '<div class="layout-sidebar"><div class="share">{}</div></div>', '<form><table><tr><td class="widget">{}</td></tr></table></form>',
]


@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_wrappers_named_like_parts_around(wrapper):
    assert main_text(page(wrapper.format(LONG))) == "\n\n".join(WANT)
    assert main_text(page(AROUND + wrapper.format(LONG + '<div class="ad"><p>Buy now, cheap, today.</p></div>') + AFTER)) == "\n\n".join(WANT)


@pytest.mark.parametrize("name", ["comments-open", "ad-free", "ad", "with-sidebar popup"])
def test_named_body(name):
    assert main_text(f'<body class="{name}">{AROUND}<article>{LONG}</article>{AFTER}</body>') == "\n\n".join(WANT)


def test_suspects_beside_the_article():
    comments = f'<section id="comments">{f"""<div class="comment-body"><p>{PROSE}</p></div>""" * 8}</section>'
    assert main_text(page(f"<article>{LONG}</article>{comments}")) == "\n\n".join(WANT)
    assert main_text(page(f'<article><p>{PROSE} <span class="share">Tweet</span></p></article>')) == PROSE
    twice = f'<section class="post social">{LONG}</section>' * 2
    assert main_text(page(twice + comments)) == "\n\n".join(WANT * 2)
    assert main_text('<div class="cookie-notice">Only this, and nothing more, is here.</div>') == "Only this, and nothing more, is here."


@pytest.mark.parametrize("n", [1, 4, 12])
def test_two_wrapped_articles(n):
    first, second = f"First, {PROSE} " * n, f"Second, {PROSE} " * n
    body = f"{AROUND}<article><div><p>{first}</p><p>{first}</p></div></article><article><div><p>{second}</p></div></article>{AFTER}"
    assert main_text(page(body)) == "\n\n".join(t.strip() for t in (first, first, second))


@pytest.mark.parametrize("raw", [
    "<script>if(a<b){}</script>", "<script><!-- x </script>", "<style>a<b{}</style>", "<textarea>a<b</textarea>", "<title>x<y</title>",
    "<script>s = '<div'; t = \"<p>no\";</script>", "<script>if (a <b) go();</script>", "<noscript>a<b</noscript>", "<script>x='</div>'</SCRIPT >",
    "<!-- <script> -->", "<iframe>a<b 'c</iframe>", "<script></script>",
])
def test_raw_elements_end_where_they_end(raw):
    assert main_text(f"<html><head>{raw}</head><body><article><p>{PROSE}</p>{raw}<p>{PROSE} p2</p></article></body></html>") == f"{PROSE}\n\n{PROSE} p2"
    assert main_text(f"{raw}<article><p>{PROSE}</p></article>") == PROSE


def test_links_of_an_article_stay():
    links = "<ul><li><a href='/1'>Source one</a></li><li><a href='/2'>Source two</a></li></ul>"
    assert main_text(page(f"{AROUND}<article><p>{PROSE}</p>{links}</article>{AFTER}")) == f"{PROSE}\n\nSource one\n\nSource two"
