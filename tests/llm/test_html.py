from __future__ import annotations

import re

import pytest

from purchase_insights.llm import html_text
from purchase_insights.llm.dom import parse
from purchase_insights.llm.labelled_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return html_text.train(labelled_pages())


@pytest.fixture(scope="module")
def extractor(model):
    return html_text.Extractor(model)


def blocks(page):
    return [(n.text, [m.tag for m in _above(parse(page), k)]) for k, n in enumerate(parse(page)) if n.tag == "#"]


def _above(nodes, k):
    while nodes[k].parent > 0:
        k = nodes[k].parent
        yield nodes[k]


def test_reader():
    assert blocks("<p>a<b>b</b> c<p>d<br>e&amp;&lt;p&gt;&nbsp; f") == [("ab c", ["p"]), ("d e&<p> f", ["p"])]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == [
        ("a", ["li", "ul"]), ("b", ["li", "ul"]), ("c", ["li", "ul", "li", "ul"]), ("d", ["li", "ul"]), ("e", []),
    ]
    assert blocks("x</p></div><!-- <p>no</p> -->y<script>var a='<p>no</p>'</script>z<style>p{}</style>") == [("xyz", [])]
    assert blocks("<head><title>no</title></head><body>yes<textarea><p>no</textarea></body>") == [("yes", ["body"])]
    assert blocks("<div title='a>b' class=\"c>d\">in</div>5 < 6 <7") == [("in", ["div"]), ("5 < 6 <7", [])]
    assert blocks("") == blocks("   \n") == blocks("<p></p><!--") == [] and blocks("<p>a<script>b") == [("a", ["p"])]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == [(x, ["td", "tr", "table"]) for x in "abc"]


def test_head_without_its_end():
    head = "<html><head><meta charset=utf-8><title>no</title><link href=a><style>p{}</style><noscript><img src=b></noscript>"
    assert [text for text, _ in blocks(f"{head}<article><p>yes</article></html>")] == ["yes"]
    assert [text for text, _ in blocks(f"{head} yes <p>too</html>")] == ["yes", "too"]
    assert [text for text, _ in blocks(f"{head}<template><p>no</template><script>no</script></head><p>yes")] == ["yes"]


def test_names():
    node = parse('<div class="siteNav main-menu" id=Comments role=banner style="display: none">x</div>')[1]
    assert node.names() == {"site", "nav", "main", "menu", "comment", "banner", "hidden"}


def test_marginals_are_exact(extractor):
    """Against the sum over all assignments of states."""
    from itertools import product

    nodes = parse("<div class=comments><p>some text here</p><ul><li>one</ul></div><p>two words</p>")
    looks = [(0.98, 0.01, 0.01)] + [extractor.look(html_text.features(n, nodes[n.parent].tag)) for n in nodes[1:]]
    totals = [[0.0] * 3 for _ in nodes]
    for states in product(range(3), repeat=len(nodes)):
        weight = looks[0][states[0]]
        for k in range(1, len(nodes)):
            weight *= looks[k][states[k]] * extractor.model.passed_on[states[nodes[k].parent]][states[k]]
        for k, state in enumerate(states):
            totals[k][state] += weight
    for found, total in zip(extractor.marginals(nodes), totals):
        assert found == pytest.approx([t / sum(total) for t in total], rel=1e-6)


def test_held_out_pages(extractor):
    """Pages that it wasn't trained on: nearly all runs of text are judged rightly."""
    right = total = 0
    for page in labelled_pages(150, seed=99):
        nodes, marks = parse(page), []
        for k, node in enumerate(nodes):
            mark = html_text.PART.search(node.attributes)
            marks.append(mark[1] if mark else marks[node.parent] if k else None)
        beliefs = extractor.marginals(parse(re.sub(r' data-part="\w+"', "", page)))
        for node, mark, belief in zip(nodes, marks, beliefs):
            if node.tag == "#":
                total += 1
                right += (mark == "content") == (belief[html_text.CONTENT] > 0.5)
    assert right / total > 0.97


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site name</header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<div class="ad">Buy one, get two, today only and never again.</div>
<article><h1>A &amp; B</h1><p><b>First   paragraph
 of text</b> with enough words in it to be one.<br><p>Second one, <i>also</i> with words &#8212; many.
<div class="advert"><p>Another offer that nobody asked for, with many words in it.</p></div><p>Third.</p>
<form>Your mail <input name=m><button>Send</button></form>
<section class="comments"><h2>Comments</h2><p>I read all of this text and it was very good.</p></section></article>
<aside class="sidebar"><p>Read more about other things in our other texts.</p></aside><footer>&copy; all of us</footer></body></html>"""


def test_page(extractor):
    assert extractor.text(PAGE) == (
        "A & B\n\nFirst paragraph of text with enough words in it to be one.\n\nSecond one, also with words — many.\n\nThird."
    )


def test_pages(spark, model):
    long = "<article>" + "<p>one more paragraph of words</p>" * 20_000 + "</article>"
    deep = "<div>" * 20_000 + "x" + "</b>" * 20_000
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", long), (5, "u", deep), (6, "u", "<nav>menu</nav>"), (1, "u", PAGE), (None, "u", " ")]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    found = html_text.extract_text(pages.repartition(3), model).collect()
    assert sorted(str(r.page_id) for r in found) == sorted(str(r[0]) for r in rows)
    texts = {r.page_id: r.text for r in found}
    assert texts[4] == "\n\n".join(["one more paragraph of words"] * 20_000)
    assert texts[2] == texts[3] == texts[6] == texts[None] == "" and texts[1].startswith("A & B")
    assert html_text.extract_text(pages.limit(0), model).count() == 0
