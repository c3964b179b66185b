"""Pages of extreme shapes, and the matching against a plain tree matching."""

import random
import time

import pytest

from review_insights.llm import wrapper_induction as w

WIDE = "<article>" + "<h2>h %d</h2><p>p %d</p>" * 5_000 + "</article>"
SHAPES = {
    "nested": lambda k: "<div>" * 10_000 + f"<p>text {k} of the page</p>" + "</div>" * 10_000,
    "unclosed lists": lambda k: "<ul><li>" * 5_000 + f"text {k} of the page",
    "unknown tags": lambda k: "<x-y>" * 10_000 + f"text {k} of the page" + "</section>" * 10_000,
    "alternating": lambda k: WIDE % tuple([k] * 10_000),
    "unclosed quotes": lambda k: f"text {k} of the page " + "<a href='" * 120_000,
    "quotes before a mark": lambda k: f"text {k} of the page " + "<a href='" * 120_000 + ">",
    "unclosed comment": lambda k: f"text {k} of the page <!--" + "<p>" * 300_000,
    "many kinds": lambda k: "".join(f"<div class='k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}'>t {i} {k}</div>" for i in range(5_000)),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_extreme_shapes_take_a_moment(shape):
    pages = [SHAPES[shape](k) for k in range(2)]
    start = time.perf_counter()
    wrapper = w.Wrapper()
    for page in pages:
        wrapper.learn(w.runs_of([w.parse(page)]))
    for page in pages:
        wrapper.count(w.runs_of([w.parse(page)]))
    other = w.Wrapper()
    other.learn(w.runs_of([w.parse(pages[0])]))
    wrapper.absorb(other)
    wrapper.to_json()
    wrapper.settle()
    texts = [w.extract(w.parse(page), None) for page in pages]
    assert time.perf_counter() - start < 6  # both pages, four passes each, on a busy machine
    assert all(str(k) in t for k, t in enumerate(texts))


def test_extreme_pages_through_spark(spark):
    rows = [(k, "http://h.example/", SHAPES[s](k)) for k, s in enumerate(["nested", "unclosed lists", "alternating", "unclosed quotes"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    found = {r["page_id"]: r["text"] for r in w.extract_text(df).collect()}
    assert "text 0 of the page" in found[0] and "text 1 of the page" in found[1] and found[2].count("\n") > 9_000


def test_deep_blocks_keep_their_text_and_their_template_sections():
    page = "<div>" * 500 + "<p>First part of the text.</p><nav><div><div>menu</div></div></nav><ul><li>second part<li>third</ul>" + "</div>" * 500
    assert w.extract(w.parse(page), None) == "First part of the text.\nsecond part\nthird"


def plain_matching(a, b):
    """Simple tree matching of two trees, without a memory."""
    if a.key != b.key:
        return 0
    m, n = len(a.kids), len(b.kids)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + plain_matching(a.kids[i - 1], b.kids[j - 1]))
    return best[m][n] + 1


def test_matching_equals_plain_tree_matching():
    rng = random.Random(3)

    def tree(depth):
        run = w.Run(rng.choice("abc"))
        run.kids = [tree(depth - 1) for _ in range(rng.randint(0, 4))] if depth else []
        return run

    for _ in range(300):
        a, b = tree(3), tree(3)
        a.key = b.key = "r"
        size, pairs = w.match(a.kids, b.kids)
        assert size + 1 == plain_matching(a, b)
        assert pairs == sorted(pairs) and all(a.kids[i].key == b.kids[j].key for i, j in pairs)


def test_common_order_is_longest():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.sample("abcdefghij", rng.randint(0, 10)) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = w.common_order(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)


def test_recurring_headings_stay_before_varying_text(spark):
    """Headings that all articles share belong to them; notices, menus and the site's own title do not."""
    html = lambda k: (f"<body><h1>The site</h1><article><h1>Title {k}</h1><h2>Background</h2><p>Some text {k} of the article.</p><p>Read our terms.</p>"  # noqa: E731
                      f"<h2>Methods</h2><h3>Design</h3><p>How it was done, {k}.</p><h2>About us</h2><p>Always the same.</p></article>"
                      "<div><h3>Categories</h3><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div></body>")
    df = spark.createDataFrame([(k, f"http://h.example/{k}", html(k)) for k in range(20)], "page_id long, url string, html string")
    for r in w.extract_text(df.repartition(3)).collect():
        k = r["page_id"]
        assert r["text"] == f"Title {k}\nBackground\nSome text {k} of the article.\nMethods\nDesign\nHow it was done, {k}."
