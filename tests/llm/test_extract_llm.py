"""HTML extraction: blocks, the random field against enumeration, held-out and given pages."""

import html
import itertools
import re

import numpy as np
import pytest

from llm_helpers import SF_SMALL
from pitwall.llm import extract
from pitwall.llm.html_blocks import leaf_blocks
from pitwall.llm.labelled_pages import labelled_page
from pitwall.llm.queries import queries


@pytest.fixture(scope="module")
def model(spark):
    return extract.train(extract.made_pages(spark))


def texts(page):
    return [b.text for b in leaf_blocks(page)]


@pytest.mark.parametrize("page,want", [
    ("", []), ("   ", []), ("plain", ["plain"]), ("<p>a<p>b", ["a", "b"]), ("<p><b>a<br>b<p>c", ["a b", "c"]),
    ("<div>a<p>b</p>c</div>", ["a", "b", "c"]), ("a<span>b</span> <i>c</i>", ["ab c"]),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", ["x", "y", "z"]), ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
    ("<p>x &amp; y &lt;z&gt; &#233;&eacute; &copy;</p>", ["x & y <z> éé ©"]), ("<p>a&nbsp;\n\t b</p>", ["a b"]),
    ("<script>var t='</p><p>no';</script>yes<style>p{}</style>", ["yes"]), ("<!-- <p>no</p> -->yes<!--", ["yes"]),
    ("<head><title>no</title></head><body>yes", ["yes"]), ("<p title='a>b'>yes</p>", ["yes"]), ("a < b", ["a < b"]), ("<p title='x>yes</p>", ["yes"]),
    ("<p>a</div>b</p>", ["ab"]), ("yes<a href='", ["yes"]), ("<SCRIPT>no</Script >yes<BR>more", ["yes more"]),
    ("<p>one</p><hr>two", ["one", "two"]), ("<textarea>no</textarea>yes", ["yes"]), ("<script>never closed", [])])
def test_leaf_blocks(page, want):
    assert texts(page) == want


def test_random_field_against_enumeration():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 8):
        scores, step, first = rng.normal(size=(n, 2)), rng.normal(size=(2, 2, 2)), rng.normal(size=2)
        same = rng.integers(0, 2, n)
        value = {y: first[y[0]] + sum(scores[k, y[k]] for k in range(n))
                 + sum(step[same[k], y[k - 1], y[k]] for k in range(1, n)) for y in itertools.product((0, 1), repeat=n)}
        total = np.log(sum(map(np.exp, value.values())))
        got, marginal, pairs = extract.forward_backward(scores, same, step, first)
        assert np.isclose(got, total)
        for k in range(n):
            assert np.isclose(marginal[k, 1], sum(np.exp(v - total) for y, v in value.items() if y[k]))
        for k in range(1, n):
            assert np.isclose(pairs[k, 1, 0], sum(np.exp(v - total) for y, v in value.items() if y[k - 1] and not y[k]))
        assert tuple(extract.viterbi(scores, same, step, first)) == max(value, key=value.get)


def test_gradient_against_single_pages():
    """The padded batch adds up what forward and backward give page by page."""
    rng = np.random.default_rng(2)
    pages = [labelled_page(s) for s in range(12)]
    seen = [(extract.features(b), extract.same_parent(b), extract.label_blocks(b, t))
            for b, t in ((leaf_blocks(h), t) for h, t in pages)]
    m = extract.Model(rng.normal(size=(extract.COLUMNS, 2)), rng.normal(size=(2, 2, 2)), rng.normal(size=2))
    block, step, first = np.zeros_like(m.block), np.zeros_like(m.step), np.zeros(2)
    for columns, same, label in seen:
        scores = np.stack([m.block[c].sum(0) for c in columns])
        _, marginal, pairs = extract.forward_backward(scores, same, m.step, m.first)
        over = np.eye(2)[label] - marginal
        for c, o in zip(columns, over):
            block[c] += o
        first += over[0]
        for k in range(1, len(label)):
            step[same[k], label[k - 1], label[k]] += 1
            step[same[k]] -= pairs[k]
    for got, want in zip(extract.Batch(seen).gradient(m), (block, step, first)):
        assert np.allclose(got, want)


def test_made_pages_have_one_label_per_block():
    off = 0
    for seed in range(200):
        page, text = labelled_page(seed)
        blocks = leaf_blocks(page)
        off += "\n\n".join(b.text for b, y in zip(blocks, extract.label_blocks(blocks, text)) if y) != text
    assert off <= 2


def test_held_out_pages(model):
    """Pages of other seeds: other words, other choices of layout."""
    hit = made = want = 0
    for seed in range(10 ** 6, 10 ** 6 + 200):
        page, text = labelled_page(seed)
        got, true = extract.main_text(page, model).split("\n\n"), text.split("\n\n")
        hit, made, want = hit + len(set(got) & set(true)), made + len(set(got)), want + len(set(true))
    assert hit / made > 0.98 and hit / want > 0.98


HAND = [
    ("<html><body><div id='cookie-consent'><p>We use cookies. Accept them all.</p></div><div class='navbar'><a href='/'>Home"
     "</a><a href='/n'>News</a></div><div class='post-content'><h1>A title here</h1><p>First paragraph, with some words in it."
     "</p><div class='ad-slot'>Buy this now!</div><p>Second one follows. It has two sentences.</p></div><div class='comments'>"
     "<div class='comment'><p>Nice text, thank you.</p></div></div><footer>© 2020 Somebody</footer></body></html>",
     "A title here\n\nFirst paragraph, with some words in it.\n\nSecond one follows. It has two sentences."),
    ("<body><header><a href='/'>Site</a></header><main><article><h1>Other title</h1><p>Some text is here, and it is long "
     "enough to be read.</p><ul><li>one item of the list</li><li>two items of it</li></ul></article></main><aside><h3>Related"
     "</h3><ul><li><a href='/a'>A story</a></li><li><a href='/b'>B story</a></li></ul></aside><form><p>Subscribe to our letter"
     "</p><button>Go</button></form></body>",
     "Other title\n\nSome text is here, and it is long enough to be read.\n\none item of the list\n\ntwo items of it")]


@pytest.mark.parametrize("page,want", HAND)
def test_hand_written_pages(model, page, want):
    assert extract.main_text(page, model) == want


def test_given_pages(spark):
    """The article element of the given pages, taken by plain patterns."""
    got = {r["page_id"]: r for r in queries()["op11_html_extraction"](spark, SF_SMALL).collect()}
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = re.sub("<[^>]*>", " ", re.sub("</?(?:p|h1)>", "\0", article)).split("\0")
        want = "\n\n".join(t for t in (" ".join(html.unescape(p).split()) for p in parts) if t)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))


def test_extract_edges(spark, model):
    schema = "main string, html string, page_id long, hash string, text string"
    long = "<article>" + "<p>Some words in it, and more.</p>" * 20_000 + "</article>"
    rows = [("x", None, 1, "h", "t"), (None, "", None, None, None), ("x", "<p></p>", 2, "h", "t"), ("x", long, 3, "h", "t"),
            ("x", long, 3, "h", "t")]
    got = extract.extract(spark.createDataFrame(rows, schema), model).collect()
    assert [r["main_text"].count("Some words") for r in got if r["page_id"] == 3] == [20_000] * 2
    assert all(r["main_text"] == "" for r in got if r["page_id"] != 3)
    assert extract.extract(spark.createDataFrame([], schema), model).count() == 0
    with pytest.raises(ValueError):
        extract.extract(spark.createDataFrame([], schema), model, out="text")
    nothing = extract.fit([])
    assert extract.main_text("<p>a</p>", nothing) == ""
    assert np.array_equal(extract.train(spark.createDataFrame([(None, None), ("", "x")], "html string, text string")).first,
                          np.zeros(2))
