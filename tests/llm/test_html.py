import random
import re
from collections import Counter

import pandas as pd
import pytest

from corpusmill.llm import html
from corpusmill.storage import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:y}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li>About</li></ul></nav><div class="ad">Buy now cheap things today</div>
<article><h1>The  title &amp; more</h1><p>First   para with <b>bold</b>words.<br>After break.<p>Second &eacute;t&eacute; &#233; para.</p>
<div class="notice cookie">We use cookies</div><aside>Related</aside><ul><li>One</li><li>Two</li></ul><form>Name <input></form></article>
<div id="comments"><p>A reader says a lot of words here, many more than the article has, again and again and again and again.</p></div><footer>Copyright 2020</footer></body></html>"""


def texts(spark, pages):
    frame = spark.createDataFrame([(i, f"http://x/{i}", p, "z") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    rows = sorted(html.extract(frame).collect(), key=lambda r: r.page_id)
    assert all(r.n_chars == len(r.text) for r in rows)
    return [r.text for r in rows]


def test_article_without_the_rest(spark):
    (got,) = texts(spark, [PAGE])
    assert got == "The title & more\nFirst para with boldwords. After break.\nSecond été é para.\nOne\nTwo"


def test_odd_pages(spark):
    got = texts(spark, [None, "", "plain words only", "<nav>menu</nav>", "<article><p>open", "<article><p>cut <b", "<script>x", "<!-- never closed", "<p>" * 3000 + "deep text" + "</p>" * 10, "<div><p>word " + "word " * 200_000 + "</p></div>"])
    assert got[:4] == ["", "", "plain words only", ""]
    assert got[4] == "open" and got[6] == "" and got[7] == ""
    assert got[5].startswith("cut")
    assert got[8] == "deep text"
    assert got[9].count("word") == 200_001
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(frame).count() == 0


@pytest.mark.parametrize(("scores", "span"), [([1, -2, 3, -1, 2], (2, 5)), ([-1, -2], (0, 0)), ([], (0, 0)), ([2, 2], (0, 2))])
def test_best_run(scores, span):
    assert html.best_run([float(x) for x in scores]) == span


def test_best_run_matches_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        s = [float(rng.randint(-4, 4)) for _ in range(rng.randint(0, 12))]
        b, e = html.best_run(s)
        assert sum(s[b:e]) == max([0.0, *(sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1))])


def test_every_page_is_read(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = html.extract(pages).collect()
    assert len(rows) == pages.count()
    assert sum(bool(r.text) for r in rows) >= 0.99 * len(rows)
    assert not any("<p>" in r.text or "track(" in r.text for r in rows)


FIXED = html.learned(Counter(), Counter(), 0, 0)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>One<p class="notice">Note<p>Two<p>Three</article><p>x', "One\nTwo\nThree"),
        ('<article><ul><li>One<li class="share">Share<li>Two</ul><p>Three</article>', "One\nTwo\nThree"),
        ("<p hidden>No<p>One two three<p>Four five", "One two three\nFour five"),
        ('<article><p>One</p><div class="ad">Buy<p>Two</p></article><p>x', "One\nTwo"),
        ("<article><p>One</p><aside>Buy<p>Two</p></article><p>x", "One\nTwo"),
        ("<aside>Ad<article><p>One</article><aside>More</aside><p>x", "One"),
        ('<div class="ad">Ad<article><p>One</p></article><div class="ad">x</div>', "One"),
        ('<p class="notice">Note<article><p>One</article>', "One"),
        ('<ul><li class="share">Share</ul><article><p>One</article>', "One"),
        ('<table><tr><td class="ad">Buy<td>One two<tr><td>Three</table>', "One two\nThree"),
        ("<html><head><title>T</title><body><p>One two", "One two"),
        ('<article>One<div class="ad"><p>x<p>y</div>two</article>', "One\ntwo"),
        ('<article><b>One<div class="ad">x</b>y</div>two</article>', "One\ntwo"),
        ("<article>One</article><aside><article>Other</article></aside>", "One"),
    ],
)
def test_unclosed_elements_that_are_skipped_end_where_html_says(page, text):
    assert html.main_text(page, FIXED) == text


@pytest.mark.parametrize(
    "attrs",
    ['style="overflow:hidden"', 'title="hidden gems"', 'data-id="header"', 'data-hidden="1"', 'class="content has-sidebar"', 'class="no-sidebar"', 'class="post has-comments"', "data-x='a class=\"ad\"'"],
)
def test_words_that_are_no_such_attribute_or_class(attrs):
    for name in ("div", "article", "section"):
        assert html.main_text(f"<body><{name} {attrs}><p>One two three</p></{name}></body>", FIXED) == "One two three"


@pytest.mark.parametrize("attrs", ["hidden", 'HIDDEN=""', 'class="x ad"', "class=cookie-notice", "id='site-footer'", 'role="navigation"', 'aria-hidden="true"', 'class="share-buttons"', 'data-a="x" class="sidebar"'])
def test_elements_that_are_skipped(attrs):
    assert html.main_text(f"<p>One two three</p><div {attrs}>No</div><p>four five six</p>", FIXED) == "One two three\nfour five six"


@pytest.mark.parametrize(
    "page",
    ['<div class="widget"><article>One</article></div>', "<form><main>One</main></form>", '<article class="comments">One</article>', '<div hidden><div class="ad">No</div><article class="related">One</article></div>'],
)
def test_what_holds_the_main_text_is_read(page):
    assert html.main_text(page, FIXED) == "One"
    assert html.main_text("<article>Two</article><div class='related'><article class='share'>One</article></div>", FIXED) == "Two"


def test_weights_are_learned_from_labelled_pages_however_rare(spark):
    plain = spark.range(3000).selectExpr("id AS page_id", "'<p>word</p>' AS html")
    labelled = spark.range(3000, 3005).selectExpr("id AS page_id", "'<div>a b</div><ARTICLE><p>one two three</p></ARTICLE>' AS html")
    got = html.learn(plain.unionByName(labelled), sample=5)
    assert got == html.learn(labelled) and got.tags


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>before <span class=\"ad\">x</span> after</p></article>", "before after"),
        ("<article><p>be<span hidden>x</span>fore</p></article>", "before"),
        ("<article><p>a <math><mi>x</mi></math> b <button>Copy</button> c <svg><text>d</text></svg></p></article>", "a x b Copy c d"),
        ("<p>" + "İ" * 60 + "</p><SCRIPT>var words = 'in a script are none';</sCript><p>one two three</p>", "İ" * 60 + "\none two three"),
        ("<script>ſ</ſcript>x</script><p>one two</p>", "one two"),
        ("<article><h1>A</h1><p>one two three four five six</p></article><div><article><p>teaser one</p></article><article><p>teaser two</p></article></div>", "A\none two three four five six"),
        ("<article>One<div>two</div><div hidden>x</div>three</article>", "One\ntwo\nthree"),
        ('<div class="layout no-sidebar"><article><p>One two</p></article></div>', "One two"),
    ],
)
def test_nothing_of_the_main_text_is_lost(page, text):
    assert html.main_text(page, FIXED) == text


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(1, "u", "<p>İstanbul one two</p>", "x", 7)] * 2 + [(None, None, "<p>one</p>", None, None), (2, "u", None, "x", 1)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert Counter(map(tuple, got)) == Counter({(1, "u", "İstanbul one two", 16): 2, (None, None, "one", 3): 1, (2, "u", "", 0): 1})


def brute_force(page, weights):
    """Every contiguous run of a page's tokens is tried; the first and longest of the best, with whole blocks at its ends, is read."""
    run = list(html.tokens(page))
    scores = [weights.of(t) for t in run]
    best = max(((round(sum(scores[i:j]), 6), -i, j) for i in range(len(run)) for j in range(i + 1, len(run) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return ""
    first, last = run[-best[1]].block, run[best[2] - 1].block
    blocks = [" ".join("".join(t.text for t in run if t.block == b).split()) for b in range(first, last + 1)]
    return "\n".join(filter(None, blocks))


def test_main_text_matches_brute_force():
    rng = random.Random(5)
    parts = ["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<b>", "</b>", "<br>", "<nav>a b</nav>", '<span class="ad">q</span>', "<li>", "one ", "two three ", "four five six seven ", " ", "&amp; "]
    weights = html.Weights(1.0, {"div": -1.5, "p": -0.25, "border": -4.0, "never": -2.5})
    for _ in range(300):
        page = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert html.main_text(page, weights) == brute_force(page, weights), page


def pages_of(spark):
    return [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]


def tallied(pages):
    f = next(html._tally(iter([pd.DataFrame({"html": pages})])))
    inside, outside = (Counter(dict(zip(f["kind"], map(int, f[c])))) for c in ("inside", "outside"))
    return html.learned(inside, outside, inside.pop("", 0), outside.pop("", 0))


def labelled_text(page):
    """By plain patterns, which these pages allow."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    bare = [html.html.unescape(re.sub(r"</?[a-z][^>]*>", "", b.replace("<br>", " "))) for b in blocks]
    return "\n".join(filter(None, (" ".join(b.split()) for b in bare)))


def test_pages_without_their_labels_give_the_same_text(spark):
    pages = pages_of(spark)
    weights = tallied(pages[::2])  # pages of the other half were not learned from
    held = pages[1::2]
    same = [html.main_text(re.sub("</?article>", "", p), weights) == labelled_text(p) for p in held]
    assert sum(same) >= 0.95 * len(same)
    assert all(html.main_text(p, weights) == labelled_text(p) for p in held)


def test_weights_tell_unnamed_adverts_from_labelled_text():
    page = "<body><div>Buy cheap things now</div><article><h1>T</h1><p>{}</p></article><div>More of it</div></body>".format("one two three " * 20)
    weights = tallied([page] * 50)
    assert html.main_text(page, weights) == "T\n" + " ".join(["one two three"] * 20)
    assert html.main_text(re.sub("</?article>", "", page), weights) == "T\n" + " ".join(["one two three"] * 20)
