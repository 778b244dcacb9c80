import html
import re

import pytest

from hazeline.llm import htmlextract as H
from tests.llm.conftest import prose


def plain(page):
    """The article of the tables' pages, whose markup is known."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    body = re.sub(r"</?(p|h1)>", "\x00", inner[1] if inner else "").replace("<br>", " ")
    return " ".join(y for x in re.sub(r"</?b>", "", body).split("\x00") if (y := " ".join(html.unescape(x).split())))


def test_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    found = H.extracted(pages).collect()
    assert len(found) == len(source)
    for r in found:
        assert r.text == plain(source[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b  c\n d</p>e", "a b c d e"), ("<b>wo</b>rd <i>x</i>", "word x"),
        ("<article>a<!-- <p>no</p> -->b<script>if (a<b) '</p>'</script>c</article>", "abc"), ("<article>x &lt;b&gt; &copy; &#233; &nosuch;</article>", "x <b> © é &nosuch;"),
        ("<body><nav>menu</nav><div class='side-bar sidebar'>s</div><main><h1>T</h1><form><p>f</form><p>body<div class=\"cookie-notice\">n</div> rest</main><footer>f", "T body rest"),
        ("<article><p>one<div class='comments'><p>who</p><p>said</p></div><p>two<aside>x</aside></article><article>three</article>", "one two three"),
        ("<body class='has-sidebar'><article class='post no-comments'><p>kept</p><article class='comment'>who</article></article></body>", "kept"),
        ("<table><tr><td>a<td>b</table><ul><li>c<li>d</ul>", "a b c d"), ("a < b and c > d", "a < b and c > d"), ("<article>cut off <a href=\"x", "cut off <a href=\"x"), ("<div><span hidden>h</span>t</div>", "t"),
    ],
)
def test_markup(page, text):
    assert H.article(page, None) == text


def site(host, k, body, kind="article"):
    return f"http://{host}/{k}", f"<html><head><title>t{k}</title></head><body><div id='top'>Welcome to {host}</div><ul class='links'><li>Home<li>About us</ul><{kind}>{body}</{kind}><div id=foot>All rights reserved</div></body></html>"


def test_template_without_an_article_element(spark):
    """What recurs on the host's pages is template; what differs is kept, whatever its tags are called."""
    rows = [(k, *site("a.example", k, f"<p>{prose(k, 30)}</p><p>{prose(100 + k, 10)}</p>", "div")) for k in range(12)]
    rows += [(100 + k, *site("b.example", k, f"<p>{prose(k, 30)}</p>")) for k in range(2)] + [(200, None, None), (201, "no url", "<p>alone"), (0, *rows[0][1:])]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, host string").repartition(3)
    found = H.extracted(pages).collect()
    assert len(found) == len(rows)
    by = {r.page_id: r.text for r in found}
    for k in range(12):
        assert by[k] == f"{prose(k, 30)} {prose(100 + k, 10)}"
    assert by[100] == prose(0, 30) and by[200] == "" and by[201] == "alone"
    assert H.extracted(pages.limit(0)).count() == 0


def test_equal_vectors_are_a_class(spark):
    rows = [(k, *site("a.example", k, "<p>x</p>" * (1 + k % 3))) for k in range(6)]
    tokens = H.classes(spark.createDataFrame(rows, "page_id bigint, url string, html string")).filter("host = 'a.example' AND block = 0").collect()
    assert {"", "/html", "/html/body", "/html/body/article", "/html/body/div#top", "/html/body/ul.links", "/html/body/div#foot"} == {t.path for t in tokens}
    assert {(t.members, t.pages) for t in tokens} == {(7, 6)}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        *((f"<article><div {a}><p>kept</p></div></article>", "kept") for a in ('style="overflow:hidden"', 'aria-hidden="false"', "data-hidden=0", 'title="The hidden valley"', 'data-id="sidebar"')),
        *((f"<article><div {a}><p>lost</p></div>t</article>", "t") for a in ("hidden", 'hidden=""', "class=x HIDDEN", "aria-hidden='true'")),
        ("<article>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> and <object data=f.pdf>the file</object> <canvas>a chart</canvas></article>", "so x=1 and the file a chart"),
        ("<article>a<iframe src=x><p>b</p><style>i{}<p>c</p></article>", "a b c"), ("<article><p>a<select><option>o</select>b</article>", "a b"),
    ],
)
def test_only_what_is_hidden_or_raw_is_apart(page, text):
    assert H.article(page, None) == text


def test_template_blocks_inside_the_article_go(spark):
    """A line that every page of the host repeats in its article, and one that only pages of a rarer layout repeat."""
    body = lambda k, more: f"<p>{prose(k, 30)}</p><p>Get our letter every week</p>{more}<p>{prose(100 + k, 10)}</p>"
    rows = [(k, *site("a.example", k, body(k, ""))) for k in range(12)]
    for k in range(12, 16):
        url, page = site("a.example", k, body(k, "<div>Part of our series</div>"))
        rows.append((k, url, page.replace("<article>", "<div class=series><article>")))
    rows += [(16, *site("a.example", 16, body(16, "<p>Part of our series</p>")))]
    found = {r.page_id: r.text for r in H.extracted(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}
    for k in range(16):
        assert found[k] == f"{prose(k, 30)} {prose(100 + k, 10)}"
    assert found[16] == f"{prose(16, 30)} Part of our series {prose(116, 10)}"


def extracted(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    return {r.page_id: r.text for r in H.extracted(pages).collect()}


def test_copies_of_an_article_are_no_template(spark):
    """Mirrors, print views and tracking versions of one article on one host, with and without an article element, keep it."""
    body = f"<p>{prose(1, 30)}</p><p>{prose(2, 30)}</p>"
    rows = [(k, f"http://m.example/{k}", f"<html><head><meta name=v content={k}></head><body><article>{body}</article></body></html>") for k in range(3)]
    rows += [(10 + k, f"http://n.example/{k}", f"<html><head><meta name=v content={k}></head><body><div class=text>{body}</div></body></html>") for k in range(3)]
    rows += [(20 + k, f"http://o.example/{k}", f"<html><body><article>{body}<p>Seen {k} times</p></article></body></html>") for k in range(4)]
    found = extracted(spark, rows)
    whole = f"{prose(1, 30)} {prose(2, 30)}"
    assert [found[k] for k in (0, 1, 2, 10, 11, 12)] == [whole] * 6 and [found[20 + k] for k in range(4)] == [f"{whole} Seen {k} times" for k in range(4)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div class='entry-content has-sidebar'><p>kept</p></div><div class='sidebar-widget'>s</div></body>", "kept"),
        ("<article><div class='share-price-report'><p>prices</p></div><p>tail</p><div class='share-buttons'>x</div><div class=post-share-links>y</div></article>", "prices tail"),
        ("<body><header>site</header><article><header><h1>Title</h1><nav>menu</nav></header><p>text</p></article></body>", "Title text"),
        ("<article><div class='w-1/2'><p>a</p></div><div class='comment-list'>no</div><div class='forum-thread'>b</div></article>", "a b"),
        ("<article><header class='site-header'>no</header><div class='search-engine-history'>yes</div></article>", "yes"),
    ],
)
def test_names_that_only_contain_a_word(page, text):
    assert H.article(page, None) == text


def test_deep_and_slashed_containers(spark):
    """A path of thousands of characters, and class names with slashes, keep containers apart and nested."""
    deep = "".join(f"<div class='level-{'x' * 60}'>" for _ in range(50))
    rows = []
    for k in range(6):
        url, page = site("d.example", k, f"{deep}<div class='w-1/2 md:w-1/3'><p>{prose(k, 40)}</p></div>{'</div>' * 50}", "div")
        rows.append((k, url, page))
    assert extracted(spark, rows) == {k: prose(k, 40) for k in range(6)}
    paths = H.Page(rows[0][2]).paths
    assert len(set(paths)) == len(paths) and max(map(len, paths)) <= 400


def test_megabytes(spark):
    body = f"<p>{prose(3, 150_000)}</p><div class='{'c' * 1_000_000}'>inner</div>"
    found = extracted(spark, [(1, "http://big.example/" + "u" * 1_000_000, f"<html><body><article>{body}</article></body></html>")])
    assert found[1] == f"{prose(3, 150_000)} inner"
