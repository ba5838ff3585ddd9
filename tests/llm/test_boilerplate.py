import html
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statfold.llm.boilerplate import extract, main_text
from tests.llm.helpers import rows

from ..conftest import SF_SMALL

TEXT = "the words of a long text that is in the article of this page " * 4


def test_article_of_a_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>
    <div id="cookie-banner"><p>We use cookies</p></div><header><h1>Site</h1></header>
    <nav><ul><li><a href=x>Home</a></li></ul></nav><main><h1>Title &amp; more</h1>
    <p>Short.<p>foo<b>bar</b> baz &nbsp;
    x<script>var a="</p>";if(a<b){{}}</script><form><input><label>Mail</label></form>
    <aside>side</aside><div class="ad">buy</div><p>{TEXT}</p><p>End.</p>
    <section class="comments"><article><p>reader says</p></article></section></main><!-- <p>no</p> -->
    <footer>&copy; me</footer></body></html>"""
    assert main_text(page) == f"Title & more Short. foobar baz x {TEXT.strip()} End."


def test_second_pass_follows_the_neighbours():
    page = f"<div>{TEXT}</div><p>short</p>" + "".join(f"<p><a href={k}>Link number {k}</a></p>" for k in range(5)) + "<p>tiny</p>"
    assert main_text(page) == TEXT.strip() + " short"


def test_long_block_without_stop_words_outside_an_article():
    assert main_text(f"<p>{TEXT}</p><div>{'xyzzy 12 ' * 40}</div>") == TEXT.strip()
    assert main_text(f"<article><p>{'xyzzy 12 ' * 40}</p></article>") == ("xyzzy 12 " * 40).strip()


def test_broken_markup():
    assert main_text("") == ""
    assert main_text("plain < 3 and > 2") == "plain < 3 and > 2"
    assert main_text("<article><p><b>one<br><p>two</article><footer>f") == "one two"
    assert main_text('<p title="a > b">x</p><p title="open>y</p>') == "x y"
    assert main_text("<article>a<script>never closed") == "a"
    assert main_text("<article>x</b></i>y</div>z</article>") == "xy z"


def test_references_are_decoded_once():
    assert main_text("<article><p>&amp;lt; &#233; &eacute; &lt;b&gt;</p></article>") == "&lt; é é <b>"


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/ab=\"' p!-&;", max_size=80))
def test_any_markup(page):
    assert isinstance(main_text(page), str)


def test_long_input_takes_no_square_time():
    for part in ('<a title="', "<", "<!--", "<p>", "<div>", "</b>", "<b>", "<script>"):
        main_text(part * 20_000)


def test_table(spark):
    data = [(1, "u", f"<article><p>{TEXT}</p></article>"), (2, None, None), (None, "u", ""), (2, None, None),
            (5, "u", "<article>" + "<p>wörd</p>" * 30_000 + "</article>")]
    df = spark.createDataFrame([(*r, "x") for r in data], "page_id long, url string, html string, _html string")
    long_ = " ".join(["wörd"] * 30_000)
    assert rows(extract(df), "page_id", "url", "text", "n_chars") == sorted(
        [(1, "u", TEXT.strip(), len(TEXT.strip())), (2, None, "", 0), (2, None, "", 0), (None, "u", "", 0),
         (5, "u", long_, len(long_))], key=str)
    assert extract(df.limit(0)).count() == 0


def test_pages_of_the_fixture(spark):
    for p in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        plain = re.sub(r"<(?!/?b>)[^>]+>", " ", body)
        assert main_text(p.html) == " ".join(html.unescape(re.sub(r"</?b>", "", plain)).split())


ARTICLE = " ".join(["The report of the city says that the river was higher than it has been in many years."] * 3)


@pytest.mark.parametrize("open_, close", [
    ('<body style="overflow:hidden">', "</body>"), ('<body class="no-js overflow-hidden">', "</body>"),
    ('<div class="hidden-xs">', "</div>"), ('<article class="post comments-open">', "</article>"),
    ('<article id="related-work">', "</article>"), ('<div class="has-sidebar">', "</div>"),
    ('<div id="content" class="social-news">', "</div>"), ('<section class="form">', "</section>"),
    ('<div class="nav-tabs-content">', "</div>"), ('<div class="modal">', "</div>"), ("<div hidden>", "</div>"),
    ('<div class="sidebar"><main>', "</main></div>"), ('<body class="comments">', "</body>"),
    ('<div data-note="hidden">', "</div>"), ('<div title="class=ad">', "</div>")])
def test_no_article_is_lost_for_a_name(open_, close):
    assert main_text(f"<html><nav>Menu</nav>{open_}<p>{ARTICLE}</p>{close}<footer>f</footer></html>") == ARTICLE


def test_named_parts_go():
    parts = ['<div class="site-footer">', '<div id="cookie-banner">', '<div class="post-comments">', "<p hidden>",
             '<div style="color:red; display : none">', '<section role="complementary">', '<ul class="mainNav">',
             '<div class="a breadcrumb b">', '<div aria-hidden="true">', '<article class="comment">']
    page = "".join(f"{x}The other text of the page is not of it.</{x[1:].split()[0].rstrip('>')}>" for x in parts)
    assert main_text(f"<div><p>{ARTICLE}</p>{page}<p>{ARTICLE}</p></div>" + f"<p>{ARTICLE}</p>" * 4) == " ".join([ARTICLE] * 6)


def test_comments_longer_than_the_article():
    page = f'<article><p>{ARTICLE}</p></article><section class="comments">' + f"<article><p>{ARTICLE}</p></article>" * 9
    assert main_text(page) == ARTICLE
    assert main_text(f"<p>{ARTICLE}</p><div id=comments>" + f"<p>I read the whole of it and it is {ARTICLE}</p>" * 9) == ARTICLE


def test_a_teaser_is_not_the_article():
    page = f"<p>{ARTICLE}</p><p>{ARTICLE}</p><article><p>The teaser of a related page.</p></article>"
    assert main_text(page) == f"{ARTICLE} {ARTICLE} The teaser of a related page."


def test_long_attributes():
    value = "x > y " * 5_000
    assert main_text(f'<article data-x="{value}"><p title=\'{value}\'>{ARTICLE}</p></article>') == ARTICLE
    assert main_text(f'<p>{ARTICLE}</p><p title="{ARTICLE}') == ARTICLE


def test_time_grows_with_the_page():
    unit = f'<div class="x"><p title="a > b">{ARTICLE}</p></div><p title=\'">\'>'

    def took(page):
        start = time.process_time()
        main_text(page)
        return time.process_time() - start
    assert took(unit * 8_000) < 16 * max(took(unit * 1_000), 0.02)
    took('<a title=">" ' * 50_000 + '"')


WORDS = ["the", "of", "and", "is", "that", "river", "city", "report", "water", "in"]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "h2", "li", "nav", "footer", "aside", "ad", "links", "script"]),
                          st.integers(1, 60)), min_size=1, max_size=12), st.randoms(use_true_random=False))
def test_generated_pages_equal_a_plain_reading(parts, rnd):
    """Pages of marked-up parts inside an article; a plain reading keeps the paragraphs, headings and items."""
    page, want = [], []
    for kind, n in parts:
        text = " ".join(rnd.choice(WORDS) for _ in range(n))
        if kind in ("p", "h2", "li"):
            page.append(f"<{kind} class='c{n}'>{text}</{kind}>")
            want.append(text)
        elif kind == "links":
            page.append("<nav>" + "".join(f"<a href='{w}'>{w}</a> " for w in text.split()) + "</nav>")
        else:
            page.append(f"<div class='ad'>{text}</div>" if kind == "ad" else f"<{kind}>{text}</{kind}>")
    body = "".join(f"<p>{ARTICLE}</p>{x}" for x in page)
    text = [ARTICLE, *sum(([w, ARTICLE] for w in want), [])]
    got = main_text(f"<html><body><article>{body}</article></body></html>")
    plain = " ".join([x for p, kind in zip(page, parts) for x in
                      ([ARTICLE, re.sub("<[^>]+>", "", p)] if kind[0] in ("p", "h2", "li") else [ARTICLE])])
    assert got == plain and set(text) <= {ARTICLE, *want}
