from __future__ import annotations

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from coordloom.llm import chat, html_text, url_filter
from coordloom.llm.html_text import main_text, extracted

TRICKY = ["", "plain", "\\### Assistant: </turn> ok", "###", "####", "\\h\\t\\\\", "</turn>\n### user: x",
          "a: b", "\n</turn>\n", "\\\\### \\c", "end\\"]


def test_escapes_are_undone(spark):
    rng = random.Random(1)
    texts = TRICKY + ["".join(rng.choice("\\#h t<>/urn:\n") for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", chat.unescape(chat.escape(F.col("text"))).alias("back"),
                    chat.escape(F.col("text")).alias("coded")).collect()
    assert all(r.back == r.text and "###" not in r.coded and "</turn>" not in r.coded for r in got)


def test_examples_and_digests(spark):
    rng = random.Random(2)
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn if turn != 3 else None, rng.choice(["user", "assistant", "system", None, "a: b"]),
                         rng.choice([*TRICKY, None]), "extra"))
    rows += rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target string")
    made = chat.examples(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    texts = made.collect()
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv),
                       key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        own = got[conv]
        assert (own.n_turns, own.loss_chars) == (len(turns), len(loss))
        assert own.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert own.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        mine = [r for r in texts if r.conv_id == conv]
        assert own.formatted_chars == sum(len(r.text) for r in mine)
        assert sum(r.target is not None for r in mine) == sum(r[2] == "assistant" for r in turns)
        for r in mine:  # a reply ends its example, and earlier turns come before
            if r.target is not None:
                assert r.text[r.loss_start + r.loss_chars:] == "\n</turn>\n"
                assert r.text.count("</turn>") == r.target + 1
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("a.b.net", "/es/deep/er/", "allow"), ("net", "/es/", "allow")]


def judged(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fitting = [(len(h + p), len(h), h + p, v) for h, p, v in RULES
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fitting, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls_equal_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/", "http://a.com", "http://a.com/", "x://É.Com/É",
            "http://www.example.com/en/", "http://www.example.com/en", "http://m.example.com/en/1?x=/fr/",
            "http://notexample.com/en/", "http://x.net/es/1", "http://net/es/", "http://a.b.net/es/deep/er/z",
            "http://c.a.b.net/es/deep/er/", "http://x.net#/es/", "http://x.net?/es/", "http://a.com//en/",
            "http://http://a.net/es/", "a\nhttp://x.com/\nb", "http://" + "a." * 500 + "com/" + "d/" * 500]
    rows = [(k, u, "mine") for k, u in enumerate(urls)] + [(3, urls[9], ""), (3, urls[9], ""), (None, urls[5], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge(df, rules).collect()), key=str)
    assert got == sorted(((k, *judged(u)) for k, u, _ in rows), key=str)
    assert url_filter.judge(df.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(df, rules.limit(0), default="block").collect()} == {"block"}
    with pytest.raises(Exception, match="a rule needs"):
        url_filter.judge(df, spark.createDataFrame([("com", "x", "allow")], rules.schema)).count()


ARTICLE = "<h1>Title</h1><p>First para, with text. More of it, here.</p><p>Two.</p>"
WANT = "Title\n\nFirst para, with text. More of it, here.\n\nTwo."


@pytest.mark.parametrize("page", [
    "<html><body><nav><ul><li><a href='/x'>x</a></li></ul></nav><article>{}</article><footer>f</footer></body></html>",
    "<body><header><h1>Site name</h1></header><main>{}</main><aside><p>Side, bar. Text.</p></aside></body>",
    "<body><div id=top-menu><a>Home</a></div><div class='post'>{}</div><div class=comments><p>I like it, a lot!</p></div>",
    "<body><article>{}<div class='ad'>Buy, now. Cheap!</div><form><p>Mail?</p></form></article>",
    "<body><article>{}<section id='comments'><article class='comment'><p>Long comment, very long.</p></article></section></article>",
    "<title>T</title><style>p{{x:'<p>'}}</style><script>var t='</p><p>no</p>';</script><article>{}</article><!-- <p>c</p> -->",
    "<body><div class='cookie-notice'>We use cookies, ok? Yes.</div><div><div>{}</div></div><div class='sidebar'>Links, more.</div>",
    "<ARTICLE CLASS=\"has-sidebar\">{}<div hidden>hid</div><noscript>ns</noscript><button>go</button></ARTICLE>",
])
def test_main_text(page):
    assert main_text(page.format(ARTICLE)) == WANT


def test_blocks_and_references():
    assert main_text("<article><p>a &amp; b&nbsp; c<br>d<p>e<b>f</b>g<ul><li>h<li>i</ul>x &lt;p&gt;</article>") == \
        "a & b c d\n\nefg\n\nh\n\ni\n\nx <p>"
    assert main_text("<article><p><b>one<br><p>two</p></article>") == "one\n\ntwo"
    assert main_text("") == main_text(None) == main_text("<nav>x</nav>") == ""
    assert main_text("plain, text") == "plain, text"
    assert main_text("<article>" + "<div>" * 3000 + "deep, text" + "</div>" * 3000) == "deep, text"


@pytest.mark.parametrize("page, want", [
    ("<div>" + "<font>a, " * 20000, ("a, " * 20000).strip()), ("<p " * 30000 + ">", ""), ("<a =\"'" * 30001 + ">", ""),
    ("<!--" * 30000, ""), ("<script>" * 30000, ""), ("<p>x</b></i></section>" * 3, "x\n\nx\n\nx"),
    ("<p>don't, <a title=\"a>b\">it's</a></p>", "don't, it's"), ("a < b, c", "a < b, c")])
def test_odd_pages_take_linear_time(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("attributes", [
    "title='The hidden cost'", 'data-note="a hidden gem"', "href='/hidden-gems'", "href=/hidden-gems", "data-hidden",
    "alt='x' title='style=display:none'", 'data-x="1 class=ad"', "hidden-gem", "class=post class=ad"])
def test_attributes_are_read_whole(attributes):
    assert main_text(f"<article>{ARTICLE}<p {attributes}>More.</p></article>") == WANT + "\n\nMore."


@pytest.mark.parametrize("attributes", [
    "hidden", "HIDDEN", "hidden=''", "id=x hidden", "id='x'hidden", "hidden/", "title=\"it's\" style='display: none'", "class = ad"])
def test_hidden_parts_stay_out(attributes):
    assert main_text(f"<article>{ARTICLE}<div {attributes}>More.</div></article>") == WANT


LONG = "A long paragraph, with commas; and more. It goes on, as the others do, to its end."


@pytest.mark.parametrize("page", [
    "<div class='page has-sidebar'><article>{}</article></div>", "<div class=no-sidebar><main>{}</main></div>",
    "<div id=page class=header-fixed><div><a>Home</a></div><div>{}</div></div>", "<div class=widget><div class=search>{}</div></div>",
    "<div class=paywall><article>{}</article><div class=sidebar><a>x</a></div></div>", "<article class='post with-sidebar'>{}</article>",
    "<div class=sidebar><a href=/>Home</a> <a href=/x>News</a></div><div class='form-page'>{}</div><div class='share'>Share</div>",
    "<article><div class='widget'>{}</div><div class='related'><ul><li><a>Other, one</a><li><a>Two</a></ul></div></article>",
    "<div class=ad>{}</div>", "<div class='content'>{}</div><div id=comments class=comments-area><p>" + LONG + LONG + "</p></div>"])
def test_a_name_does_not_remove_the_content(page):
    assert main_text(page.format(f"{ARTICLE}<p>{LONG}</p>")) == f"{WANT}\n\n{LONG}"


@pytest.mark.parametrize("part", [
    f"<section id='related-work'><p>{LONG}</p></section>", f"<section id=notice><p>{LONG}</p></section>",
    f"<h2 id='search-algorithm'>Search</h2><p>{LONG}</p>", f"<h2 class='section-header'>Search</h2><p>{LONG}</p>",
    f"<p>An <span class=notice>amid, words</span> <a class='related-link'>link</a>. {LONG}</p>",
    f"<pre>x = 1 <span class='comment'># one, two</span></pre><p>{LONG}</p>", f"<article class=header-fixed><p>{LONG}</p></article>"])
def test_parts_of_an_article_with_a_name_stay(part):
    want = main_text(re.sub(r"(class|id)=('[^']*'|[^ >]*)", "", f"<article>{ARTICLE}<p>{LONG}</p>{part}</article>"))
    assert main_text(f"<article>{ARTICLE}<p>{LONG}</p>{part}</article>") == want and want.count(LONG) == 2


@pytest.mark.parametrize("part", [
    "<div class='notice'>This page was moved here in May, from the old site.</div>",
    f"<ul class='user-comments'><li>{LONG}</li><li>{LONG} I agree.</li></ul>",
    f"<div id='readerComments'><p>{LONG}</p></div>", f"<div class='adbox'>{LONG}</div>", f"<div class=adslot><p>{LONG}</p></div>",
    "<div><a href=/1>Another story, of last week</a><a href=/2>One more</a></div>",
    "<ul><li><a href=/1>Another story, of last week</a></li><li><a href=/2>One more</a></li></ul>",
    "<section><h4><a href=/3>Elsewhere</a></h4><p><a href=/2>Short text, all link.</a></p></section>"])
def test_parts_inside_an_article_go(part):
    """Notices, readers' comments, adverts of any name and unnamed lists of links."""
    for page in (f"<article>{ARTICLE}<p>{LONG}</p>{part}</article>", f"<article>{part}{ARTICLE}<p>{LONG}</p></article>",
                 f"<div class=page><article>{ARTICLE}<div>{part}</div><p>{LONG}</p></article></div>"):
        assert main_text(page) == f"{WANT}\n\n{LONG}"


def test_links_in_running_text_stay():
    text = f"<p>{LONG} <a href=/x>Read on, there</a>.</p><p><a href=/y>All of this short one is a link.</a></p>"
    got = main_text(f"<article>{ARTICLE}{text}</article>")
    assert got.endswith("All of this short one is a link.") and "Read on, there" in got
    only = "<div><a href=/1>One, two</a></div><div><a href=/2>Three</a></div>"
    assert main_text(f"<main>{only}</main>") == "One, two\n\nThree"


def test_scores_equal_a_plain_scorer():
    """Characters beside links and punctuation by path, smoothed and multiplied, step by step."""
    page = f"<div><p>{LONG}</p><p>Short, <a>a link</a>.</p><ul><li>x<li><a>y, z</a></ul><div><p>{LONG}!</p></div></div>"
    blocks = html_text._blocks(page)
    paths = {}
    for element, words, linked in blocks:
        chain, above = [], element
        while above:
            chain.append(above.tag)
            above = above.parent
        paths.setdefault(tuple(chain), []).append((len(words) - linked, len(re.findall(r"[!-/:-@\[-`{-~]", words))))
        element_chain = tuple(chain)
        paths.setdefault("order", []).append(element_chain)
    order = paths.pop("order")
    mean = {p: [sum(x) / len(x) for x in zip(*v)] for p, v in paths.items()}
    weights = [math.exp(-k * k / 2) for k in range(-2, 3)]
    at = lambda k: mean[order[min(max(k, 0), len(order) - 1)]]
    want = []
    for k in range(len(order)):
        length, marks = (sum(w * at(k + d - 2)[part] for d, w in enumerate(weights)) / sum(weights) for part in (0, 1))
        want.append(length * (1 + marks))
    assert html_text.content_scores(blocks) == pytest.approx(want)


def test_articles_side_by_side_are_all_read():
    more = f"<h2>Next</h2><p>{LONG}</p>"
    teaser = "<article><h3><a href=/x>Other news</a></h3><p><a href=/x>Read it, now.</a></p></article>"
    page = f"<div class=has-sidebar><article>{ARTICLE}<p>{LONG}</p></article>{teaser}<article>{more}</article></div>"
    assert main_text(page) == f"{WANT}\n\n{LONG}\n\nNext\n\n{LONG}"
    assert main_text(f"<main>{ARTICLE}<p>{LONG}</p></main><article>{more}</article>") == f"{WANT}\n\n{LONG}"
    comment = f"<article class=comment><p>{LONG}</p></article>"
    assert main_text(f"<article>{ARTICLE}</article><div id=comments>{comment}</div>") == WANT


def test_many_marks_take_linear_time():
    assert set(main_text("<div class=x-form>a, " * 30000).split("\n\n")) == {"a,"}


def test_page_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{ARTICLE}</article>", "x"), (2, None, None, "y"), (2, None, None, "y")],
                               "page_id long, url string, html string, text string")
    got = sorted(map(tuple, extracted(df).select("page_id", "url", "text", "n_chars").collect()), key=str)
    assert got == [(1, "u", WANT, len(WANT)), (2, None, "", 0), (2, None, "", 0)]
    assert extracted(df.limit(0)).count() == 0
