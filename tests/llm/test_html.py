import html
import math
import re
import time
from collections import Counter, defaultdict
from functools import cache

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wharfline.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";x(1<2)</script></head><body class="has-sidebar">
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header>
<article><h1>Head &amp; <em>tail</em></h1><p>First <b>bold</b>word&nbsp;here &lt;p&gt;<br>next<p>Second
  line<form>name <input> <button>Go</button></form><aside>By the way</aside><div class="ad">Buy</div><ul><li>one<li>two</ul>
<section id="comments"><div class="comment-body">I disagree</div></section><!-- <p>hidden</p> --></article>
<div class="sidebar">Side</div><footer>&copy; me</footer>"""


def alone(page):
    """The main text of a page that shares no element with others."""
    tree = hx.Page(page or "")
    return hx.extract(tree, "h", hx.alone(tree, "h"))


def test_crafted_page():
    assert alone(PAGE) == "Head & tail First boldword here <p> next Second line one two"


def test_names():
    text = alone
    assert text('<div class="layout sidebar-layout"><p>a</p><div class="leftSidebar">b</div><div id="disqus_thread">c</div></div>') == "a"
    assert text('<div class="with-sidebar no-comments"><p>a</p></div>') == "a"
    assert text('<div id="widget"><article><p>a</p><div class="userComments">b</div></article></div>') == "a"
    assert text('<div class="comments"><article class="x"><p>b</p></article></div><p>a</p>') == "a"
    assert text('<main><div class="article-header"><h1>a</h1></div><header>b</header><div class="commentBox">c</div><article class="comment">d</article></main>') == "a b"
    assert text('<p hidden>x</p><p style="display: none">y</p><div role="alert">z</div><p>a</p>') == "a"


def test_odd_markup():
    for page in ["", None, "plain", "<", "<p", "<<p>>", "a < b & c", "<p><b><i></p>x</b>", "</div></p>text", "<script>never closed", '<a href="x>y', "<div " * 500, "<div>" * 3000 + "deep", "<!-- open", "&#0; &bogus; &#xD800;"]:
        alone(page)
    assert alone("a < b &amp; c") == "a < b & c"
    assert alone("<p>x<script>var a='<p>no</p>'</SCRIPT >y") == "x y"
    assert alone("<p title='a>b'>x</p><td>y<td>z") == "x y z"
    assert len(alone("<article>" + "<p>word " * 30000).split()) == 30000


def test_host():
    assert hx.host_of("https://u@WWW.a.example:80/x") == "www.a.example" and hx.host_of(None) == hx.host_of("junk") == ""


def plain_removable(pages, kind_of=hx._kind):
    """The removable nodes of all hosts, by recursion over whole lists of rows."""
    seen, kids, up = defaultdict(list), defaultdict(dict), {}
    for url, page in dict.fromkeys(pages):
        tree, host = hx.Page(page or "", kind_of), hx.host_of(url)
        if tree.has_main_text():
            for k, style, j, own, node in tree.nodes(host):
                seen[node].append((own, None if tree.kids[k] else tree.text[k], tree.kind[k], tree.most[k]))
                kids[style][j] = node
    for node, rows in seen.items():
        up |= {x: node for own, text, *_ in rows if text is None for x in kids[own].values()}

    @cache
    def importance(node):
        rows, m, styles = seen[node], len(seen[node]), defaultdict(list)
        if m == 1:
            return 1.0
        for own, text, *_ in rows:
            styles[own, text is None].append(text)
        fade, shown, inner = hx.DECAY ** len(styles), 0.0, 0.0
        for (own, is_inner), texts in styles.items():
            share = len(texts) / m
            shown -= share * math.log(share) / math.log(m)
            if len(texts) == 1:
                worth = 1.0
            elif is_inner:
                worth = sum(map(importance, kids[own].values())) / len(kids[own])
            else:
                counts = Counter(texts).values()
                worth = 1 - sum(map(math.log, counts)) / len(counts) / math.log(len(texts))
            inner += share * worth
        return (1 - fade) * shown + fade * inner

    @cache
    def value(node):
        m = len(seen[node])
        return (m * importance(node) + hx.DOUBT * (value(up[node]) if node in up else 1.0)) / (m + hx.DOUBT)

    @cache
    def worth(node):
        rows, most = seen[node], max(r[3] for r in seen[node])
        if len(rows) == 1:
            return most
        weight, says = hx._VIEW[max(r[2] for r in rows)]
        again = [own for own, n in Counter(r[0] for r in rows if r[1] is None).items() if n > 1]
        return max([min(most, (1 - weight) * value(node) + weight * says)] + [worth(x) for own in again for x in kids[own].values()])

    out = set()
    for beside in kids.values():
        best = max(map(worth, beside.values()))
        out |= {x for x in beside.values() if worth(x) < hx.LEAST * best}
    return out


def plain_texts(pages, kind_of=hx._kind):
    gone = plain_removable(pages, kind_of)
    return [hx.extract(hx.Page(p or "", kind_of), hx.host_of(u), gone) for u, p in pages]


def site(n, same="Follow us on all channels"):
    return [(f"http://s.example/{i}", f"<body><div class=top{i}>{same}</div><div id=x><p>Story {i} is about {i * 7}</p><p>More {i}</p></div><div class=tail>All rights kept</div></body>") for i in range(n)]


def layers(n):
    """Unmarked pages with branches in branches: a varied story, and the same list four levels down."""
    story = lambda i: "".join(f"<p>part {i} of {k}</p>" + "<pre>code</pre>" * (i * k % 3) for k in range(1 + i % 5))
    same = "<div><ul><li>one</li><li>two</li></ul><div><div>three</div></div></div>"
    return [(f"http://l.example/{i}", f"<body><div class=a>{same}</div><div class=b><div class=c>{story(i)}</div><div class=d>ask {i % 2}</div></div></body>") for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"marks": False}, {"here_nodes": 0, "sent_nodes": 0}])
def test_style_tree_against_recursion(spark, how):
    pages = site(40) + [("http://other.example/1", site(1)[0][1]), *layers(30)]
    pages += [(f"http://copies.example/{i}", "<article><p>Same</p></article>") for i in range(40)] + pages[:2] * 3
    pages += [(f"http://m.example/{i}", f"<nav>Menu</nav><div class=x><h1>Title {i}</h1><article><p>Text {i}</p>" + "<p>more</p>" * (i % 3) + "</article></div><div class=ad>Buy {i}</div>") for i in range(9)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("key", F.lit("x")).withColumn("node", F.lit(2))
    got = {r.page_id: r.text for r in hx.main_text(df, **how).collect()}
    assert got == dict(enumerate(plain_texts(pages, hx._kind if how.get("marks", True) else hx._unmarked)))
    assert got[3] == "Story 3 is about 21 More 3"
    assert got[40] == "Follow us on all channels Story 0 is about 0 More 0 All rights kept"  # nothing to compare with
    assert got[75] == "Same"  # a page never loses all of its text
    assert "three" not in got[44] and "ask" not in got[44] and got[44].startswith("part 3 of 0 ")


def test_importance_outvotes_names():
    """What calls itself a banner but varies stays beside what is the same on every page."""
    pages = [(f"http://h/{i}", f"<div class=banner><b>News {i}</b>" + f"<div>item {i}</div>" * (i % 7) + "</div><div class=text>Welcome to this site</div>") for i in range(200)]
    texts = plain_texts(pages)
    assert texts[5].startswith("News 5 item 5") and "Welcome" not in texts[5]


TRUTH = re.compile(r"<article>(.*?)(</article>|\Z)", re.S)


def article(page):
    spaced = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", TRUTH.search(page)[1]))
    return " ".join(html.unescape(spaced).split())


def test_tree_finds_articles_without_names(spark):
    """Tags and names tell nothing here: only entropies do."""
    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet").set_index("page_id").html
    got = hx.main_text(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), marks=False).toPandas().set_index("page_id").text
    right = sum(got[i] == article(p) for i, p in pages.items())
    assert right >= 0.9 * len(pages)


def test_tree_removes_branches_of_every_page():
    """Without the tree's decisions all pages would be other texts."""
    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    rows = list(zip(pages.url, pages.html))
    gone = plain_removable(rows)
    assert len(gone) > 100
    for u, p in rows:
        tree = hx.Page(p)
        assert hx.extract(tree, hx.host_of(u), gone) == article(p) != hx.extract(tree, hx.host_of(u), set())


@pytest.mark.parametrize("unit", ['<a "', "<b ", '<a ">"', '<a x=">"', "<a x='>\"'", "<!--", "<", "<div>", "<div>a", "<p>w ", "<a =", "<title>x</title", "<b></i><p></b>"])
def test_time_is_linear(unit):
    times = []
    for n in (20_000, 80_000):
        start = time.process_time()
        alone(unit * n)
        times.append(time.process_time() - start)
    assert times[1] < 12 * times[0] + 1 and times[1] < 15


def test_edge_rows(spark):
    rows = [(1, "http://a/1", None), (2, None, "<p>x</p>"), (None, "u", ""), (2, None, "<p>x</p>"), (3, "http://a/2", "<article>" + "<p>w</p>" * 20000)]
    got = hx.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 1), ("2", 1), ("3", 39999), ("None", 0)]
    assert hx.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table(spark):
    from wharfline.llm.queries import QUERIES

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet").set_index("page_id").html
    got = QUERIES["op7_html"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == len(pages)
    for r in got.itertuples():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id], re.S)[1]
        spaced = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", body))
        assert r.text == " ".join(html.unescape(spaced).split()) and r.n_chars == len(r.text)


def test_pages_nested_500_deep():
    """Noise and the article at the bottom, closed one by one, and unclosed inline tags above."""
    inner = "<nav>menu words</nav><article><div>first part</div><p>second part</p></article><footer>legal words</footer>"
    assert alone("<div>" * 500 + inner + "</div>" * 500) == "first part second part"
    fonts = "<div>" + "<font color=red>" * 500 + inner + "</div><aside>more</aside>"
    assert alone(fonts) == "first part second part"
    open_inside = "<article>" + "<div>" * 300 + "deep" + "</div>" * 300 + "<p>still the article</p></article><p>outside</p>"
    assert alone(open_inside) == "deep still the article"
    assert len(hx.Page("<b>" * 30000 + "x" + "</i><p>y" * 30000).label) > 1
