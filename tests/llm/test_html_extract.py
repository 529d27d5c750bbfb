"""Main text of labelled pages that the field has not seen, parsing rules, and edge cases."""

import html
import os
import re

import pytest

from newstide.llm import html_extract as he

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def chain():
    return he.fit()


def test_pages_it_has_not_seen(chain):
    pages = he.labelled_pages(150, seed=5)
    got = he.main_text([p for p, _ in pages], chain, he.Features())
    assert sum(g == "\n".join(t) for g, (_, t) in zip(got, pages, strict=True)) >= 0.93 * len(pages)


def test_blocks():
    page = """<!doctype html><head><title>no</title></head><body class="x"><p>a &amp; b<b> c</b>d<br>e<p title='>'>f &lt;i&gt; &nbsp; g
    <script>var t = "</p>";</script><style>p{}</style><!-- <p>no</p> --><ul><li>one<li>two <a href="/x">link</a></ul>tail &copy &#233;</body> <"""
    got = he.blocks(page)
    assert [b.text for b in got] == ["a & b cd e", "f <i> g", "one", "two link", "tail © é <"] or [b.text for b in got] == ["a & b cd e", "f <i> g", "one", "two link", "tail © é", "<"]
    assert [b.place.name for b in got[:4]] == ["p", "p", "li", "li"] and got[0].place.marks == ("x",)
    assert got[3].linked == 4 and (got[3].place.tags, got[3].place.above) == (("body", "ul", "li"), "ul")


@pytest.mark.parametrize("page", ["", "<", "<p", "<p>", "</p></div>", "<script>never closed <p>x", "<!-- never closed <p>x", "<a href='x", "text only", "&", "<p>" * 3000 + "x", "\x00<p>퟿"])
def test_broken_pages(chain, page):
    assert isinstance(he.main_text([page, None], chain, he.Features())[0], str)


def test_long_page(chain):
    text = "A sentence of words, repeated often. " * 20000
    page = f"<body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>Title of it</h1>{('<p>' + 'word ' * 30 + '.</p>') * 3000}<p>{text}</p></article><footer>&copy; 2020 x</footer></body>"
    got = he.main_text([page], chain, he.Features())[0].split("\n")
    assert len(got) == 3002 and got[-1] == text.strip()


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables are not here")
def test_sample_pages(spark, chain):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in he.extract(pages, chain).collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|article|div)\b[^>]*>", inside[1] if inside else "")]
        assert r.text == "\n".join(x for x in parts if x)


def test_edges(spark, chain):
    schema = "page_id long, url string, html string, text string"
    rows = [(None, None, None, "mine"), (1, "u", "", "mine"), (1, "u", "", "mine"), (2, None, "<article><p>Some words here.</p></article>", None)]
    out = he.extract(spark.createDataFrame(rows, schema), chain)
    assert out.columns == ["page_id", "url", "html", "text"]
    assert sorted((r.page_id or 0, r.text) for r in out.collect()) == [(0, ""), (1, ""), (1, ""), (2, "Some words here.")]
    assert he.extract(spark.createDataFrame([], schema), chain).count() == 0


@pytest.mark.parametrize(
    "raw",
    [
        "<script>for(var i=0;i<a.length;i++){f(i)}</script>", "<script>if(i<n)f()</script>", "<SCRIPT>if(i<n)f()</sCript >", "<script>it's<b \"</script>",
        "<script><!-- if(i<n)f() //--></script>", "<script>if(a<!--b)f()</script>", "<script><!-- never closed</script>", "<script><!--></script>",
        "<script><!-- w('<script src=x></script>') //--></script>", "<script>x = '<!-- <script>'</script>", "<script>'</scripty>' + i<n</script>", "<style>a<b{content:'\"'}</style>",
        "<style><!-- p{} </style>", "<noscript>i<n</noscript>", "<textarea>i<n</textarea>", "<iframe>i<n</iframe>", "<template><p>no<script>if(i<n)f('</template>')</script></template>",
        "<svg><style>a<b{}</style><title>no</svg>", "<title>i<n</title>", "<script src=x></script>", "<script src='x' />",
    ],
)
def test_scripts_end_at_their_own_tag(chain, raw):
    for more in ("", "<script>g()</script>", raw):
        page = f"<html><body>{raw}<article><h1>Title of it</h1><p>Some words here, in a row.</p></article>{more}</body></html>"
        assert [b.text for b in he.blocks(page)] == ["Title of it", "Some words here, in a row."]
        assert he.main_text([page], chain, he.Features()) == ["Title of it\nSome words here, in a row."]


def test_many_raw_elements_take_one_pass():
    assert he.blocks("<svg><style>" * 20_000 + "x") == [] and he.blocks("<script><!--" * 20_000 + "x") == []
    assert [b.text for b in he.blocks("<script><!-- <script></script>--></script>" * 20_000 + "x")] == ["x"]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<article><p>one</p><svg><svg><text>no</text></svg>no</svg><p>two</p></article>", ["one", "two"]),
        ("<article><p>one</p><object data=x><object><p>no</p></object>no</object><p>two</p></article>", ["one", "two"]),
        ("<article><p>one</p><video src=a><p>two</p></article><p>three", ["one", "two", "three"]),
        ("<article><p>one <select><option>no</p><p>two</p></article>", ["one", "no", "two"]),
        ("<div><p>one</p><audio>no</div><p>two</p><audio></audio>three", ["one", "two", "three"]),
        ("<p>if <math><mi>x</mi><mo>&lt;</mo><msup><mi>y</mi><mn>2</mn></msup></math> holds</p>", ["if x<y2 holds"]),
        ("<p>a <math><semantics><mi>x</mi><annotation encoding='tex'>no</annotation></semantics></math> b</p>", ["a x b"]),
        ("<div><section><p>one</section></p></div></div></p>two", ["one", "two"]),
    ],
)
def test_passed_over_elements(page, texts):
    assert [b.text for b in he.blocks(page)] == texts


def test_deep_pages_take_seconds(chain):
    import time

    start = time.perf_counter()
    n = 50_000
    for page in ("<div>x" * n, "<div>x" * n + "</div>" * n, "<div class='a b'>x" * n + "</p></span>" * n, "".join(f"<t{k % 5000} id=w{'abcdefghij'[k % 10]}>x" for k in range(n)), "<svg>x" * n, "<p>x<video>" * n):
        assert len(he.blocks(page)) >= 1
    deep = "<article><p>Some words here, in a row.</p>" + "<div>" * n + "<p>Some words here, in a row.</p>"
    assert he.main_text([deep], chain, he.Features()) == ["Some words here, in a row.\nSome words here, in a row."]
    assert time.perf_counter() - start < 30
