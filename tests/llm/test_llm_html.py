"""Main text of pages: reading blocks, the recurrent labeller, whole tables against a plain rule, and edge cases."""

from __future__ import annotations

import html
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortloom.llm import html_blocks as hb
from cohortloom.llm.common import ship, table
from cohortloom.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, leaves int, shares string, text string, h long, weights int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def weights(spark):
    return hb.learn(table(spark, "/root/testdata/sf0.001", "pages"), sample=60)


def plain(page):
    """For pages whose article stands in one element, whose parts are headings and paragraphs."""
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    said = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"<p>|</p>|</?h1>", inner))
    return "\n\n".join(x for x in said if x)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_a_plain_rule(spark, folder):
    got = QUERIES["op11_main_text"](spark, folder)
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = {r.page_id: (r.url, plain(r.html), len(plain(r.html))) for r in table(spark, folder, "pages").collect()}
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got.collect()} == want


def said(page):
    return [leaf.text for leaf in hb.leaves(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain  text\n&amp; more", ["plain text & more"]),
        ("<p>a<b>b</b> c<br>d<p>e</p>f", ["ab c d", "e", "f"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><td><p>c</table>d", ["a", "b", "c", "d"]),
        ("<script>var t='</p>';</script><style>p{}</style><title>t</title><p>a</p><!-- <p>no</p> -->b", ["a", "b"]),
        ("<SCRIPT>no</SCRIPT ><P CLASS=x>a &lt;b&gt; &#233; &nbsp;c", ["a <b> é c"]),
        ("a < b <3 </ c> <", ["a < b <3 <"]),
        ("<p title='a>b' data-x=\"<p>\">c</p>", ["c"]),
        ("<div>a<p>b</div>c</p>d", ["a", "b", "c", "d"]),
        ("a<!-- never ended <p>b", ["a"]),
        ("<p>a</p><p never ended", ["a"]),
    ],
)
def test_leaves(page, want):
    assert said(page) == want


def test_paths_know_their_containers():
    page = hb.leaves("<div class='side bar'><p>a</p></div><main><p>b<p>c</main><footer>d</footer><div role=main>e<nav>f</nav></div>")
    assert [leaf.inside for leaf in page] == ["", "main", "main", "other", "main", "other"]
    assert page[0].path.sum() == 4 and page[1].path.sum() == 2 and (page[1].path == page[2].path).all()


@pytest.mark.parametrize("piece", ["<", "<a ", "<!--", "&", "</", "<b>", "<div>x", "<p><b>x<br>", '<a href="', "<b>x</i>", "&#"])
def test_time_is_in_proportion_to_the_page(piece):
    start = time.perf_counter()
    hb.leaves(piece * 60_000)
    assert time.perf_counter() - start < 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "/", "!", "--", "[", "p", "div", "script", "a", '"', "'", "=", " ", "&", "amp;", "#x", "9", "x", "\n", "title", "<p>", "</p>", "<b>", "</div>"]), max_size=25))
def test_any_markup_is_read(parts):
    for leaf in hb.leaves("".join(parts)):
        assert leaf.text and leaf.text == " ".join(leaf.text.split()) and 0 <= leaf.linked <= 1


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = hb.Labeller(hidden=3, seed=2)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    pages = [rng.normal(size=(n, hb.WIDTH)) for n in (4, 2, 1)]
    x, mask, y = hb.stacked(pages, [(rng.random(len(p)) < 0.5).astype(float) for p in pages])

    def loss():
        z = model.logits(x, mask)[0].astype(np.float64)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    found = model.gradients(x, mask, y)
    for name, w in model.w.items():
        for at in rng.integers(0, w.size, 6):
            before, step = w.flat[at], 2e-2
            w.flat[at] = before + step
            up = loss()
            w.flat[at] = before - step
            down = loss()
            w.flat[at] = before
            assert found[name].flat[at] == pytest.approx((up - down) / (2 * step), abs=2e-3), name


def test_what_a_leaf_is_depends_on_the_whole_page():
    """Leaves all alike but for the first or the last of the page, which says what the page is: only context can tell."""
    rng = np.random.default_rng(4)
    pages = []
    for k in range(120):
        v = np.zeros((rng.integers(3, 9), hb.WIDTH), np.float32)
        v[0 if k % 2 else -1, 0] = sign = rng.choice([-1, 1])
        pages.append((v, np.full(len(v), sign > 0, np.float32)))
    model = hb.Labeller(seed=3).fit(pages[:80], epochs=40)
    assert all(((s >= 0.5) == (y > 0)).all() for s, (_, y) in zip(model.shares([v for v, _ in pages[80:]]), pages[80:]))


def test_made_pages_of_other_draws_are_read(weights):
    model, maker = hb.Labeller.load(weights), hb.Maker(["words of a text that goes on for a while, and on."] * 5, seed=99)
    made = [hb.made_page(maker) for _ in range(200)]
    right = [((s >= 0.5) == (y > 0)) for s, (_, y) in zip(model.shares([v for v, _ in made]), made)]
    assert np.concatenate(right).mean() > 0.95


def test_batches_do_not_change_the_result(weights):
    model, maker = hb.Labeller.load(weights), hb.Maker([], seed=8)
    made = [hb.made_page(maker)[0] for _ in range(40)] + [np.empty((0, hb.WIDTH), np.float32)]
    for a, b in zip(model.shares(made), model.shares(made, most=1), strict=True):
        assert np.allclose(a, b, atol=1e-5)


def test_a_page_of_another_build(weights):
    page = """<html><body class=home><div class="site-header"><a href=/>Home</a> <a href=/x>News</a></div>
    <div class="cookie-banner"><p>We use cookies, see our policy.</p></div><div class="post-content"><h1>A title of some words</h1>
    <p>The first part of the text, with a <a href=/y>link</a> inside, goes on for a line or two and ends here.</p>
    <p>The second part of it says more, and it is as long as the first one, or a bit longer than that.</p></div>
    <div class=sidebar><h3>More</h3><ul><li><a href=/1>one</a><li><a href=/2>two</a></ul></div>
    <section class=comments><h3>Comments</h3><div class=comment>I do not agree at all.</div></section>
    <form><label>Mail</label><input><button>Go</button></form><footer>(c) us</footer></body></html>"""
    read = hb.leaves(page)
    shares = hb.Labeller.load(weights).shares([hb.vectors(read)])[0]
    kept = [leaf.text for leaf, p in zip(read, shares, strict=True) if p >= 0.5]
    assert kept[0] == "A title of some words" and [t.split()[:2] for t in kept[1:]] == [["The", "first"], ["The", "second"]]


def test_nulls_long_pages_repeats_and_clashing_names(spark, weights):
    long = "<nav><a href=x>m</a></nav><article><h1>t</h1>" + "".join(f"<p>part {k} of a long text.</p>" for k in range(20_000)) + "</article><footer>f</footer>"
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<nav>only a menu</nav>"), (4, "w", long), (None, "x", "<article><p>One &amp; only, a text of some words.</p></article>")]
    rows += rows[-1:] * 2
    pages = spark.createDataFrame([(*r, 1, "s", "t", 2, 3) for r in rows], SCHEMA)
    got = sorted((r.page_id or 0, r.url, r.n_chars, r.text) for r in hb.main_texts(pages, weights).collect())
    assert [g[:2] for g in got] == [(0, "x")] * 3 + [(1, "u"), (2, None), (3, "v"), (4, "w")]
    assert {g[3] for g in got[:3]} == {"One & only, a text of some words."}
    assert [g[3] for g in got[3:6]] == ["", "", ""] and got[6][3].count("\n\n") == 20_000 and got[6][2] == len(got[6][3])


def test_no_pages(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hb.main_texts(none, hb.learn(none)).count() == 0
