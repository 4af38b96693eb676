import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm.html_text import ContentModel, labelled_pages, main_text, parse

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";track(0);</script></head>
<body><nav><ul><li><a href="/a">a</a></li><li><a href="/b">b</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy this now, it is cheap.</div>
<article><h1>T &amp; t&nbsp;x</h1><p><b>One &lt;two&gt;<br><p>Three
  four</p><p>fi<i>ve</i> &amp;&amp;amp; six.</p></article><footer>&copy; site &middot; all of it.</footer></body></html>"""


def test_one_page():
    model = ContentModel(labelled_pages())
    assert model.extract(PAGE) == "T & t x One <two> Three four five &&amp; six."
    assert model.extract("") == "" and model.extract("<nav><a>x</a>") == "" and model.extract("<<<>><p") is not None


ARTICLE = "<article><p>One two three. Four five.</p>{}</article>"


def test_broken_markup():
    model = ContentModel(labelled_pages())
    for inside in ("<![foo[ x ]]>", "<![CDATA[ x", "<!-- x x", "<!-->", "<!---->", "<!-- a --!>", "<!doctype", "<?php x ?>", "</>", "</ x>", "<p title='x", "<p class=x", "</i></span>", "<script>x</scr", "<a/href=x/>", "<textarea><p>x</textarea>"):
        assert model.extract(ARTICLE.format(inside)) == "One two three. Four five.", inside
    assert model.extract(ARTICLE.format("<p>1 < 2 &lt;3&gt; a<b. Six seven.")) == "One two three. Four five. 1 < 2 <3> a"
    assert model.extract(ARTICLE.format("<p title='<p>' data-x = y>Six it's seven.</p>")) == "One two three. Four five. Six it's seven."
    assert model.extract(ARTICLE.format("<SCRIPT>if (a</b) '</p>'</SCRIPT ><P>Six seven.")) == "One two three. Four five. Six seven."


def test_deep_and_unmatched_tags_take_linear_time():
    model, n = ContentModel(labelled_pages(60)), 100_000
    pages = ["<div>" * n + "x", "</i>" * n, "<b>" * n + "</u>" * n, "<p><li>" + "<b>" * n + "<p>x</p>" * n, "<div></span>" * n, "<a " * n, "<!--" * n, "<? " * n, "<a b='" * n, "<" * n, "<![x[" * n, "&lt" * n]
    began = time.time()
    for page in pages:
        assert isinstance(model.extract(page), str)
    assert time.time() - began < 60
    long = " ".join(f"Word{i} goes on." for i in range(n))
    assert model.extract(ARTICLE.format(f"<p>{long}</p>")) == "One two three. Four five. " + long


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "<!--", "-->", "<![", "]]>", "<?", "'", '"', "=", "/", "&", "&amp", "&#x0;", "p", "div", "script", "a ", "li", " class=x", "\n", "\x00", "é", "td", "table"]), max_size=40))
def test_random_markup_is_read(parts):
    tree = parse("".join(parts))
    assert all(node.parent < i for i, node in enumerate(tree.nodes))
    assert tree.nodes[0].total == tree.nodes[0].own + sum(x.own for x in tree.nodes[1:])
    assert all(len(depths) == sum(tag == t for t, _, _ in tree.open[1:]) for tag, depths in tree.depths.items())


def test_held_out_pages():
    model, good, words = ContentModel(labelled_pages(400, 11)), Counter(), Counter()
    for html, text in labelled_pages(200, 99):
        got, want = Counter(model.extract(html).split()), Counter(text.split())
        good["exact"] += got == want
        words["both"] += sum((got & want).values())
        words["got"] += sum(got.values())
        words["want"] += sum(want.values())
    assert words["both"] / words["got"] > 0.98 and words["both"] / words["want"] > 0.98, (words, good)
    assert good["exact"] >= 160, good


def test_marginals_are_exact():
    import itertools
    import math

    import numpy as np

    from sightline.llm.html_text import _features, _kind

    model = ContentModel(labelled_pages(60))
    tree = parse("<body><nav><a>a b</a></nav><div class=post><p>One two. Three.</p><div class=ad>x y</div></div></body>")
    n = len(tree.nodes)
    unary = [0.5 * sum(model.node.get(f, 0.0) for f in _features(x, tree.nodes[x.parent])) if x.total and i else 0.0 for i, x in enumerate(tree.nodes)]
    total, one = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        w = math.exp(sum(unary[i] * y[i] for i in range(n)) + sum(model.moves.get(_kind(tree.nodes[i]), model.any_move)[y[tree.nodes[i].parent], y[i]] for i in range(1, n)))
        total += w
        one += w * np.array(y)
    assert np.allclose(model.content(tree)[1:], (one / total)[1:])


def test_query_and_edges(spark):
    rows = [(1, "u", PAGE, 5), (2, None, None, 5), (3, "v", "", 5), (1, "u", PAGE, 5), (None, "w", "<p>" * 3000, 5), (7, "w", "<article><p>a. Bc de.</p><![foo[ x ]]>" + "</i>" * 9, 5)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((str(x.page_id), x.text) for x in got) == [("1", "T & t x One <two> Three four five &&amp; six.")] * 2 + [("2", ""), ("3", ""), ("7", "a. Bc de."), ("None", "")]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    labelled = spark.createDataFrame([(*x, 1, "u") for x in labelled_pages(150)] + [(None, "x", 1, "u")], "html string, text string, rank int, url string")
    assert main_text(spark.createDataFrame(rows[:1], "page_id long, url string, html string, text int"), labelled).first().text.startswith("T & t x One")
