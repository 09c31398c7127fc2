"""Main text of pages: parsing, choice of the container, votes of a host, defined results."""

import time

import pytest

from tallymark.llm import main_text
from tallymark.llm.html_tree import parse
from tallymark.llm.main_text import Scored

PROSE = "The river rose in the night and the lower fields were under water by the morning."
MORE = "Nobody had seen it so high since the old mill was built beside the bridge."


def own(html):
    return Scored(parse(html)).main_text([])


def test_plain_page():
    page = (f"<!DOCTYPE html><html><head><title>No &amp; no</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
            f"<body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><!-- <p>ad</p> --><div class=\"ad\">Buy this now, it is good.</div>"
            f"<article><h1>Flood &amp; fields</h1><p><b>{PROSE}<br><p>{MORE}</article><footer>&copy; host &middot; all</footer></body></html>")
    assert own(page) == f"Flood & fields\n{PROSE}\n{MORE}"


def test_wrappers_without_html5_names():
    page = (f"<body class='has-sidebar'><div id='page-12'><div class='header'><a href='/'>Home</a> The daily</div><div class='x'>"
            f"<div class='post-body'><h2>Flood</h2><p>{PROSE}</p><div class='AdSlot7'>Cheap boots here today</div><p>{MORE}</p>"
            f"<ul><li>one<li>two</ul></div></div><div class='sideBar'>{PROSE} {PROSE}</div>"
            f"<div id='cookie-notice'>We use cookies to count our readers and to keep you signed in.</div></div>")
    assert own(page) == f"Flood\n{PROSE}\n{MORE}\none\ntwo"


def test_comments_forms_and_hidden_parts_go():
    page = (f"<main><article><header><h1>Flood</h1><div class='share'>Tell your friends</div></header><p>{PROSE}</p>"
            f"<form><label>Mail</label><input><button>Send</button></form><div hidden>secret</div><div style='display: none'>none</div>"
            f"<p aria-hidden=true>not read</p><aside>{MORE}</aside><p>{MORE}</p>"
            f"<section id='comments'><h3>2 comments</h3><article class='comment'><p>{PROSE} Great!</p></article>"
            f"<div class='comment-body'>{MORE} Indeed.</div></section><footer>By us</footer></article></main>")
    assert own(page) == f"Flood\n{PROSE}\n{MORE}"


def test_a_form_around_the_page_is_kept():
    assert own(f"<form id='aspnetForm'><div class='content'><p>{PROSE}</p><p>{MORE}</p></div></form>") == f"{PROSE}\n{MORE}"


def test_blocks_and_white_space():
    assert own("<p>  a\t<b>b</b>c&nbsp;\n d<br>e </p>f") == "a bc d e\nf"
    assert own("<table><tr><td>one<td>two<tr><th>three</table>") == "one\ntwo\nthree"
    assert own("plain &lt;text&gt; &amp &am 1 < 2 & 3 > 2") == "plain <text> & &am 1 < 2 & 3 > 2"
    assert own("") == own("<p></p>") == own("<!-- a") == own("<script>var a") == ""
    assert own("<p>a</p></div></p></b><p>b<em>c</p>d") == "a\nbc\nd"
    assert own("<p title=\"a > b\">x</p><p title='un>closed>y</p><p>z</p>") == "x\nclosed>y\nz"


def test_long_and_deep_pages_are_linear():
    started = time.time()
    for page in ("<div>" * 50_000 + PROSE, "<i title='\"'>" * 50_000 + PROSE, "<i title=\"'>" * 50_001 + PROSE,
                 "< " * 200_000 + PROSE, "<b><p>" * 30_000 + PROSE, "<li>" * 50_000 + PROSE, "</div>" * 50_000 + PROSE, "<!--" * 50_000 + "-->" + PROSE, f"<p>{PROSE}</p>" * 20_000):
        assert PROSE in own(page)
    assert time.time() - started < 60


def test_paths():
    page = Scored(parse("<div class='b a12' id='post-7'><section>x</section></div>"))
    assert page.path(2) == "page>div.a0.b#post-0>section"
    assert page.matches(["page>div.a0.b#post-0>section", "page>div", "page"]) == [[2], [], [0]]


def article(title, text, junk):
    return f"<div class='q1'>{junk}</div><div class='z9'><h2>{title}</h2><p>{text}</p></div><div class='q2'>Read on in the next issue.</div>"


@pytest.fixture(scope="module")
def pages(spark):
    """A host whose pages agree on a container, with one page whose text is shorter than its unnamed notice."""
    rows = [(k, f"http://Paper.example/{k}", article(f"T{k}", f"{k} {PROSE} " * 4, "Welcome back.")) for k in range(12)]
    rows += [(12, "http://paper.example/12", article("Short", "Short text.", f"{PROSE} {MORE} " * 5))]
    rows += [(13, "http://paper.example/13", "<p>Only this.</p>"), (14, None, f"<p>{PROSE}</p>"), (15, "http://none.example/", None),
             (16, "no url", ""), (17, "http://x.example/", "<nav>Menu</nav>"), (None, "http://x.example/", PROSE), (12, "http://y/", "text")]
    schema = "page_id long, url string, html string, host int, `key` string, paths int, text int, n int"
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in rows], schema).repartition(3)


def test_a_host_agrees(pages):
    out = {(r.page_id, r.url): r.text for r in main_text.extract(pages).collect()}
    for k in range(12):
        assert out[k, f"http://Paper.example/{k}"] == f"T{k}\n" + " ".join([f"{k} {PROSE}"] * 4)
    assert own(article("Short", "Short text.", f"{PROSE} {MORE} " * 5)) != "Short\nShort text."
    assert out[12, "http://paper.example/12"] == "Short\nShort text."
    assert out[13, "http://paper.example/13"] == "Only this." and out[14, None] == PROSE
    assert out[15, "http://none.example/"] == out[16, "no url"] == out[17, "http://x.example/"] == ""
    assert out[None, "http://x.example/"] == PROSE and out[12, "http://y/"] == "text" and len(out) == 20


def test_votes(pages):
    rows = main_text.hosted(pages, "page_id", "url", "html")
    won = {r.host: (r.size, r.paths) for r in main_text.winning_paths(rows).collect()}
    assert won["paper.example"] == (14, ["page>div.z0", "page"])
    assert won["none.example"] == (1, []) and won[""][0] == 2
    assert main_text.extract(pages.limit(0)).collect() == []
