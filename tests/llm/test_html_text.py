import re

import pytest

from reelstate.llm import html_text, queries
from reelstate.llm.html_text import main_text

PROSE = ("This is the first part of a story that was told to us by the people who had been there, and "
         "it is as long as it has to be so that the rules can see that it is prose and not a list of "
         "links or a menu of some kind or other, which it is not.")
PAGES = {
    "menus, adverts and footers go": (
        "<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"
        "<nav><ul><li><a href=/>Home</a></li></ul></nav><div class=\"ad-box\">Buy</div><header>Site"
        "</header><article><h1>Title &amp; more</h1><p>One<br>line.</p><aside>Side</aside><p>Two.</p>"
        "<form><input value=x>Send</form></article><footer>&copy; Us</footer></body></html>",
        "Title & more\nOne line.\nTwo."),
    "reader comments go": (
        "<main><p>Text.</p><section id='comments'><article><p>First!</p></article></section></main>",
        "Text."),
    "an article's header is its own": (
        "<article><header class='entry-header'><h2>Head</h2></header><p>Body.</p></article>", "Head\nBody."),
    "an article ends a header left open": ("<header><div>Logo<article><p>Body.</p></article>", "Body."),
    "a layout class does not hide the article": (
        "<div class='page with-sidebar'><article><p>Body.</p></article></div>", "Body."),
    "a list of links is a menu": (
        "<article><p>Body.</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>"
        "<ul><li>Point one</li><li>Point <a>two</a></li></ul></article>", "Body.\nPoint one\nPoint two"),
    "no main element": (
        f"<body><div class=menu><a>A</a></div><div><h1>Title of it</h1><p>{PROSE}</p><p>Short.</p>"
        f"<p>{PROSE}</p></div><div><a href=1>Read all the other stories</a></div></body>",
        f"Title of it\n{PROSE}\nShort.\n{PROSE}"),
    "entities and white space": (
        "<article><p>a&nbsp;&lt;b&gt;\n\t c&#233;&#x20AC;  </p><p> </p><pre>x\n  y</pre></article>",
        "a <b> cé€\nx y"),
    "inline markup joins words": ("<article><p>f<b>o</b>o <i>bar</i></p>\n<p>x</article>", "foo bar\nx"),
    "cut off": ("<article><p>Whole.</p><p>Half <a hre", "Whole.\nHalf"),
    "cut off in a comment": ("<article><p>Whole.</p><!-- rest", "Whole."),
    "cut off in a script": ("<article><p>Whole.</p><script>var x = '<p>", "Whole."),
    "notices": ("<article><div class='cookie-notice'>We use cookies.</div><p>Body.</p></article>", "Body."),
    "two breaks part blocks": ("<article>One<br>two<br><br/>three</article>", "One two\nthree"),
    "plain text": ("just text &amp; no tags", "just text & no tags"),
    "table": ("<article><table><tr><td>a</td><td>b</td></tr></table></article>", "a\nb"),
    "less-than signs": ("<article><p>1 < 2 and 3 <4</p></article>", "1 < 2 and 3 <4"),
    "empty": ("", ""), "null": (None, ""),
    "a class on the article": ("<article class='post has-comments'><p>Body.</p></article>", "Body."),
    "free of adverts": ("<article class='post ad-free'><p>Body.</p></article>", "Body."),
    "a class of layout": (f"<div class='flex overflow-hidden'><p>{PROSE}</p></div>", PROSE),
    "a class of layout in an article": (
        "<article><div class='flex overflow-hidden'><p>Body.</p></div></article>", "Body."),
    "a sidebar elsewhere": (f"<div class='content has-sidebar'><p>{PROSE}</p></div>", PROSE),
    "no sidebar": (f"<div class='no-sidebar'><p>{PROSE}</p></div>", PROSE),
    "open for comments": (f"<div class='post comment-open'><p>{PROSE}</p></div>", PROSE),
    "replies on": ("<main class='replies-enabled'><article><p>Body.</p></article></main>", "Body."),
    "a form around all": (f"<form><div><p>{PROSE}</p></div></form>", PROSE),
    "a hint around all": (f"<div class='comments widget'><div><p>{PROSE}</p></div></div>", PROSE),
    "an article called comment": (f"<article class='comment'><p>{PROSE}</p></article>", PROSE),
    "comments longer than the article": (
        f"<div><p>{PROSE}</p></div><div class='comments'>" + f"<p>I say that {PROSE}</p>" * 5 + "</div>", PROSE),
    "comments that are articles": (
        f"<article><p>{PROSE}</p><article class='comment'><p>{PROSE}</p></article></article>", PROSE),
    "a form around all, with comments": (
        f"<form><p>{PROSE}</p><div id='comments'><p>{PROSE}</p><p>{PROSE}</p></div></form>", PROSE),
    "end tags without an element": ("<article><div></p></b></section>One</div></i>two</article>", "One\ntwo"),
    "an end tag inside a list": ("<article><ul><li>a<div>b</li><li>c</ul></article>", "a\nb\nc"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    source, text = PAGES[name]
    assert main_text(source) == text


def test_second_pass():
    nearest = html_text.second_pass
    assert nearest([None, True, None, None, False, None]) == [True, True, True, False, False, False]
    assert nearest([True, None, False]) == [True, True, False]
    assert nearest([None, None]) == [True, True]
    assert nearest([None, False, None]) == [True, False, True]
    assert nearest([]) == []


def test_first_pass_without_containers():
    def label(text, linked=0):
        return html_text.first_pass([html_text.Block(text, linked, False, False, 0)])[0]

    assert label(PROSE) is True
    assert label("Short one.") is None
    assert label("x" * 100) is False
    assert label("a link", 5) is False


def test_query_against_a_plain_rule(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op5_html_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    import html
    for r in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        parts = (html.unescape(re.sub(r"</?(?:b|br)>", "", p)).split()
                 for p in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(" ".join(p) for p in parts if p)
        assert r.n_chars == len(r.text)


def test_odd_tables(spark):
    rows = [(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(r.text for r in html_text.extracted(df).collect()) == ["", "a", "a"]
    assert html_text.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("source", [
    "<div>" * 40_000 + "</p>" * 40_000, "<b>" * 40_000 + "</i>" * 40_000,
    "<li><section>" + "<div>" * 40_000 + "</li>" * 40_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000,
    "<div class=menu>" * 20_000 + "<p>x" * 20_000,
])
def test_malformed_pages_take_linear_time(source):
    import time

    start = time.process_time()
    main_text(source)
    assert time.process_time() - start < 5


def test_pages_without_article_tags(spark, sf_dir):
    """The density rules alone, on the given pages: hardly any boilerplate stays.

    The words of these pages are made up, and many paragraphs have few stop words: a part of them goes.
    """
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    kept = words = other = 0
    for r in rows:
        want = main_text(r.html).split("\n")
        got = main_text(re.sub(r"</?article>", "", r.html)).split("\n")
        words += sum(len(x.split()) for x in want)
        kept += sum(len(x.split()) for x in want if x in got)
        other += sum(len(x.split()) for x in got if x not in want)
    assert kept >= 0.75 * words and other <= 0.01 * words, (kept / words, other / words)


def test_a_very_long_page():
    assert main_text("<article>" + "<p>word</p>" * 100_000).count("\n") == 99_999
    assert main_text("<div>" * 20_000 + "<p>deep</p>") == "deep"
