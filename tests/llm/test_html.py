"""HTML extraction: the scan against brute force, pages without an article element, hostile pages, edges."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm import html_extract

LABELLED = [f"<html><body><nav><ul><li><a>home</a><li>x</ul></nav><article><h1>T{i}</h1><p>many words of an <b>article</b> go here<p>and here</article><div class='ad'>buy</div><footer>bye</footer></body></html>" for i in range(9)]
PAGE = """<html><head><title>no</title><script>if (a<b) {"<p>no</p>"}</script><style>p{}</style></head><body><header><a>Site</a></header><nav><ul><li><a>menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies here and there and everywhere all of the time</div><article><h1>A &amp; B</h1><p><b>First   part,<br>with&nbsp;more words than a menu has.
</p><aside>related stuff that nobody needs to read at all</aside><p>1 &lt; 2 is true, and words follow it.</p><form><input value="x"><button>Send</button></form><div class="ad-box">buy buy buy now</div>
<p>The last paragraph has words too.</p></article><section id="comments"><p>A reader says that this is a very good article, thanks a lot for it</p></section><footer>&copy; us</footer></body></html>"""
TEXT = "A & B\nFirst part, with more words than a menu has.\n1 < 2 is true, and words follow it.\nThe last paragraph has words too."


@pytest.fixture(scope="module")
def learned():
    return html_extract.learnt(LABELLED)


def test_learnt_scores(learned):
    assert learned["p"] < 0.1 < 0.9 < learned["nav"] and learned[".ad"] > 0.9 and "li" not in learned  # the list isn't why a menu is outside
    page = html_extract.Page(PAGE)
    assert all(v > 0 if n else v <= 0 for v, (n, _) in zip(html_extract.scores(page, learned), page.tokens))  # words positive, tags negative


def test_text_and_pages_without_an_article_element(learned):
    assert html_extract.main_text(PAGE, learned) == TEXT
    assert html_extract.main_text(PAGE.replace("<article>", '<div id="q">').replace("</article>", "</div>"), learned) == TEXT
    assert html_extract.main_text(PAGE, {}) == TEXT  # by the priors alone


def test_the_scan_decides(learned):
    """No element around the links is known to be outside; only the scan leaves them out."""
    links = "".join(f"<div><span><a>link {i}</a></span></div>" for i in range(20))
    page = f"<body>{links}<p>The words of the text are here, and there are many of them.</p>{links}</body>"
    assert html_extract.main_text(page, learned) == "The words of the text are here, and there are many of them."


def test_lists_within_the_text_stay(learned):
    page = "<body><nav><ul><li><a>menu</a></ul></nav><article><p>Some words come first here.</p><ul><li>one of many</li><li>two</li></ul><p>And some words come last.</p></article></body>"
    assert html_extract.main_text(page, learned) == "Some words come first here.\none of many\ntwo\nAnd some words come last."


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=12))
def test_region_against_brute_force(scores):
    low, high = html_extract.region(map(float, scores))
    best = max((sum(scores[a:b]) for a in range(len(scores) + 1) for b in range(a, len(scores) + 1)), default=0)
    assert sum(scores[low:high]) == best


def test_null_empty_and_odd_pages(learned):
    assert html_extract.main_text(None, learned) == html_extract.main_text("", learned) == html_extract.main_text("<p><div>", learned) == ""
    assert html_extract.main_text("<p>a < b and <c", learned) == "a < b and <c"
    assert html_extract.main_text('<p title="a > b">words</p><!-- open', learned) == "words"
    assert html_extract.main_text("<p>x</p>" * 1 + "<p>" + "word " * 200_000 + "</p>", learned).count("word") == 200_000


@pytest.mark.parametrize("part", ["<script ", "<!", "<!--", '<a href="', "<a b='<a c=\"", "<p>", "</div>", "<", "<script>", "<a =", "<a x=\"<\" y='", "&#xZZ;&amp", "</script "])
def test_hostile_pages_take_linear_time(part, learned):
    def seconds(n):
        began = time.process_time()
        html_extract.main_text(part * n, learned)
        return time.process_time() - began

    assert seconds(40_000) < 0.25 + 12 * seconds(10_000)


def test_query(spark):
    pages = spark.createDataFrame([(1, "u", None, 7), (2, None, "", 8), (3, "v", "<article><p>words of one page</p></article>", 9), (3, "v", "<article><p>words of one page</p></article>", 9), (None, "w", "<p>no id but words</p>", 1)], "page_id long, url string, html string, text long")
    learned = html_extract.train(pages)
    got = sorted((r.page_id or 0, r.text) for r in html_extract.extracted(pages, learned).collect())
    assert got == [(0, "no id but words"), (1, ""), (2, ""), (3, "words of one page"), (3, "words of one page")]
    none = pages.filter("false")
    assert html_extract.train(none) == {} and html_extract.extracted(none, {}).count() == 0
