"""HTML extraction: parser, trees, decoding without contradictions, extraction of whole pages."""

import html
import itertools
import re

import numpy as np
import pytest

from tillroll.llm import html_extract as H
from tillroll.llm.common import table


def texts(source):
    p = H.parse(source)
    return [t for t, tag in zip(p.text, p.tag, strict=True) if tag == "#text"]


def test_parser():
    assert texts(None) == [] and texts("") == [] and texts("plain & simple") == ["plain & simple"]
    assert texts('<p>a<script>var t="</p>";</script> b<!-- c --> &amp;&lt;<br>d</p>e') == ["a b &< d", "e"]
    assert texts("<p><b>one<br><p>two</p>three") == ["one", "two", "three"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert texts("<style>p{}</style><title>t</title><P CLASS=x>a</P  ></div>b") == ["a", "b"]
    assert texts("a < b <i>c</i>  d <unclosed") == ["a < b c d <unclosed"]
    assert texts('<div title="x > y">z</div>') == ["z"]
    assert texts("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == ["deep", "er"]


@pytest.mark.parametrize("title", ["<title>t</title>", "<meta charset=x><style>a{}</style><noscript><img src=x></noscript>"])
@pytest.mark.parametrize("body", ["<body><article><p>a</p></article>", "<p>a", "a", "<a href=x>a</a>", "</head><body>a", "<body>a</head>"])
def test_head_without_end_tag(title, body):
    assert texts(f"<html><head>{title}{body}") == ["a"]
    assert texts(f"<html><head>{title}{body}</body></html>") == ["a"]


def test_head_holds_no_text():
    assert texts("<head>x<title>t</title><template><div>y</div></template>z</head>a") == ["a"]
    assert texts("<head><script>var t = '</head><body>';</script><title>t</title></head><body>a") == ["a"]
    assert texts("<head><title>t") == []


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "noscript", "template"])
def test_silent_element_without_end_tag(tag):
    assert texts(f"<article><p>a</p><{tag}>x<p>b</p><p>c</p></article>d") == ["a", "b", "c", "d"]
    assert texts(f"<div><p>a<{tag}>x</p>b</div>c") == ["a", "b", "c"]
    assert texts(f"<ul><li>a<{tag}>x<li>b</ul>c") == ["a", "b", "c"]
    assert texts(f"<p>a<{tag}>x</p><p>b</p><{tag}>y</{tag}>c") == ["a", "b", "c"]
    assert texts(f"<div>a<{tag}>x</div>b</{tag}>c") == ["a", "bc"]


@pytest.mark.parametrize("tag", ["button", "object", "svg", "noscript", "template"])
def test_silent_element_with_end_tag(tag):
    assert texts(f"<p>a<{tag}>x<p>y</p><{tag}>z</{tag}>w</{tag}> b</p>c") == ["a b", "c"]
    assert texts(f"<p>a <b>b<{tag}>x</b>y</{tag}> c</p>d") == ["a b c", "d"]


def test_raw_text_reaches_to_its_end_tag():
    for tag in ("script", "style", "title", "textarea", "iframe"):
        assert texts(f"a<{tag}><p>x</p></{tag}>b") == ["ab"]
        assert texts(f"<p>a<{tag}>x<p>y") == ["a"]


def test_quotes_in_tags():
    assert texts('<a href="x>a link') == ["a link"] and texts("<p title='x>text</p>") == ["text"]
    assert texts("<p title=Bob's>it's here, isn't it</p>") == ["it's here, isn't it"]
    assert texts("<p title = \"a > b\" class='c > d'>x</p>") == ["x"]
    assert texts('<p a==">y</p>"><b>z') == ["z"]


def test_parsing_takes_time_in_proportion():
    import time

    def seconds(source):
        start = time.perf_counter()
        H.parse(source)
        return time.perf_counter() - start

    for unit in ("<b>x<p>", "<b><p>", "</i>y<div><b>", "<li><b>", '<a href="x', "<p a=b'"):
        assert seconds(unit * 40_000) < 6
    assert seconds("<b>" * 40_000 + "<p>" * 40_000) < 6


HAND_WRITTEN = [
    ("<article><p>line one<br>line two</p><p>para<span> in</span>line</p></article>", "line one line two\npara inline"),
    ("<html><body><p>Short words.</p></body></html>", "Short words."),
    ("Two short sentences. Without any tags.", "Two short sentences. Without any tags."),
    (
        "<article><h1>Title</h1><p>This is a paragraph of the article, long enough to be seen as text.</p>"
        "<table><tr><td>a1</td><td>b1</td></tr><tr><td>a2</td><td>b2</td></tr></table><h2>Part two</h2>"
        "<ul><li>first</li><li>second</li></ul><p>Another paragraph that ends the article here.</p></article>",
        "Title\nThis is a paragraph of the article, long enough to be seen as text.\na1\nb1\na2\nb2\nPart two\n"
        "first\nsecond\nAnother paragraph that ends the article here.",
    ),
    (
        "<main><h1>Name</h1><table><tr><td>x</td><td>y</td></tr></table><pre>code = 1</pre><p>Text that goes on.</p></main>",
        "Name\nx\ny\ncode = 1\nText that goes on.",
    ),
    (
        '<div class="qzx"><div class="foo1">Two short paragraphs.</div><div class="foo1">Under unknown names.</div></div>',
        "Two short paragraphs.\nUnder unknown names.",
    ),
    (
        "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"
        '<header><a href=/>Site</a></header><div class="story"><h1>Big news today</h1><table><tr><th>k</th><th>v</th></tr>'
        '<tr><td>one</td><td>1</td></tr></table><p>Short.</p></div><div class="ad">Buy now the best thing ever. Click here.</div>'
        "<footer>&copy; 2024 site.example all rights</footer></body></html>",
        "Big news today\nk\nv\none\n1\nShort.",
    ),
]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_hand_written_pages(spark, sf):
    """Pages that the training layouts do not make; whichever pages the sentences come from."""
    fitted = H.train(table(spark, f"/root/testdata/{sf}", "pages"))
    assert fitted.extract([source for source, _ in HAND_WRITTEN]) == [text for _, text in HAND_WRITTEN]


def test_sample_is_bounded_and_of_different_pages(spark):
    rows = [(k, "u", "<p>One page that a third of all rows repeat. It has two sentences.</p>") for k in range(300)]
    rows += [(k, "u", f"<p>Page number {k}. It has its own words.</p>") for k in range(300, 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    model = H.train(pages, max_pages=20)
    assert model.extract([rows[0][2]])[0].startswith("One page")


def test_features_are_finite_and_one_row_per_node():
    p = H.parse("<div class='ad sidebar'><p>x. y</p><a href=/>l</a></div>")
    x = H.features(p)
    assert len(x) == len(p.tag) and np.isfinite(x).all()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = H.Gbt.fit(x, y, H.GbtParams())
    assert ((model.probability(x) > 0.5) == y).mean() > 0.97
    same = H.Gbt.fit(x, np.ones(2000), H.GbtParams())
    assert same.probability(x).min() > 0.99


def brute_decode(p, some, only):
    """All labellings without contradictions; the best by the same node scores."""
    only = np.minimum(only, some)
    kids = {k: [j for j in range(len(p.tag)) if p.parent[j] == k] for k in range(len(p.tag))}
    texty = [t == "#text" for t in p.tag]
    for k in range(len(p.tag) - 1, 0, -1):
        texty[p.parent[k]] |= texty[k]
    nodes = [k for k in range(1, len(p.tag)) if texty[k]]
    best, found = -np.inf, None
    for states in itertools.product("KDM", repeat=len(nodes)):
        s = dict(zip(nodes, states, strict=True)) | {0: "M"}
        if any(p.tag[k] == "#text" and s[k] == "M" for k in nodes):
            continue
        if any(s[p.parent[k]] != "M" and s[k] != s[p.parent[k]] for k in nodes):
            continue
        prob = {"K": lambda k: only[k], "D": lambda k: 1 - some[k], "M": lambda k: some[k] - only[k]}
        score = sum(np.log(np.clip(prob[s[k]](k), 1e-6, 1)) for k in nodes)
        if score > best + 1e-12:
            best, found = score, [k for k in nodes if p.tag[k] == "#text" and s[k] == "K"]
    return best, found


def test_decoding_is_the_best_labelling_without_contradictions():
    rng = np.random.default_rng(3)
    p = H.parse("<div>a<p>b</p><ul><li>c</li></ul></div><p>d</p>")
    for _ in range(25):
        some = rng.random(len(p.tag))
        only = some * rng.random(len(p.tag))
        assert H.decode(p, some, only) == brute_decode(p, some, only)[1]


@pytest.fixture(scope="module")
def model(spark):
    return H.train(table(spark, "/root/testdata/sf0.01", "pages"))


def article_text(source):
    """The text of the one <article> of the given pages, block by block."""
    m = re.search(r"<article>(.*?)</article>", source, re.S)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", m[1]) if m else []
    plain = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in parts]
    return "\n".join(x for x in plain if x)


def test_given_pages(spark, model):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in H.extract(pages, model).collect()}
    expected = {r.page_id: article_text(r.html) for r in pages.collect()}
    assert np.mean([got[k] == v for k, v in expected.items()]) > 0.98


def test_other_layouts(spark, model):
    """Layouts that were not trained on, with comments and adverts inside the article."""
    sentences = [f"This is sentence number {k}, of some length." for k in range(200)] + ["Short one.", "Menu", "Home"]
    layouts = H._Layouts(sentences, 12345)
    right = chars = hit = 0
    for _ in range(150):
        p = H.parse(layouts.page())
        x = H.features(p)
        kept = set(H.decode(p, model.some.probability(x), model.only.probability(x)))
        truth = {k for k, s in enumerate(H.labels(p)) if p.tag[k] == "#text" and s == 1}
        right += kept == truth
        chars += sum(len(p.text[k]) for k in kept | truth)
        hit += sum(len(p.text[k]) for k in kept & truth)
    assert right >= 120 and hit / chars > 0.95


def test_awkward_pages(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<article><p>" + "Word here. " * 50000)] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    found = H.extract(df, model)
    assert found.columns == ["page_id", "url", "text"]
    by = {r.page_id: r.text for r in found.collect()}
    assert found.count() == 8
    assert by[1] == by[2] == by[None] == ""
    assert by[4] == ("Word here. " * 50000).strip()


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract(none, H.train(none)).count() == 0
