"""Main texts against articles cut out by hand, and the site tree against one folded in plain Python."""

import html
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import html_text as H
from skein.llm.common import Scratch
from skein.session import table


def texts(page):
    return [t for _, fixture, t in H.Page(page).blocks if not fixture]


def test_articles_of_the_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in H.main_text(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (r.url, want, len(want))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple\n text", ["plain & simple text"]),
        ("<p>one<p>two<br>lines<div>three</div>four", ["one", "two lines", "three", "four"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>x", ["1", "2", "3", "x"]),
        ("<h1>T<h2>U</h1>v", ["T", "U", "v"]),
        ("<p>a <b>bold <i>it</b>alic</i> z", ["a bold italic z"]),
        ("<p>x</div></article></p>y", ["x", "y"]),
        ("<head><title>no</title><script>var a = '<p>no</p>';</script><p>yes", ["yes"]),
        ("<body><!-- no --><p>a<style>p{}</style>b</p><svg><text>no</text></svg><noscript>no</noscript>", ["ab"]),
        ("<nav>no<p>no</p></nav><header>no</header><article><header><h1>T</h1></header>text<aside>no</aside><div class='post-comments'>no</div></article><footer>no", ["T", "text"]),
        ("<div class='cookieNotice'>no</div><div id='sidebar-2'>no</div><div role='navigation'>no</div><div hidden>no</div><div style='display: none'>no</div>yes", ["yes"]),
        ("<body class='has-sidebar comments-open'><form><p>no</form><button>no</button><p>yes<select><option>no<p>end", ["yes", "end"]),
        ("&lt;p&gt; &eacute; &#x41; &am &copy 2020 &nbsp;x", ["<p> é A &am © 2020 x"]),
        ("<p>cut off <a href='x", ["cut off"]),
        ("<div>" * 300 + "deep" + "</div>" * 300 + "<p>after", ["deep", "after"]),
    ],
)
def test_broken_and_odd_markup(page, want):
    assert texts(page) == want


def site(n, host="h.example.org"):
    """Pages with boilerplate that no label gives away, and articles that differ."""
    pages = []
    for i in range(n):
        body = "".join(f"<p>Sentence {chr(97 + i % 26)}{chr(97 + i // 26)} number {j} of its own.</p>" for j in range(1 + i % 4))
        pages.append((f"https://{host}/{i}", f"<body><div><p>Welcome to all of you.</p><span>Call us</span></div><section><h1>Title {chr(97 + i % 26)}{i % 7 * 'x'}</h1>{body}</section><div class=low>All rights kept, {i}.</div></body>"))
    return pages


def tree_in_python(pages):
    """{(host, node): importance, most} by the definition, over Python dictionaries."""
    stats = {}

    def one(rows):
        nodes = defaultdict(lambda: {"pages": 0, "styles": Counter(), "texts": Counter(), "share": 0.0, "parent": None})
        for _, page in rows:
            page = H.Page(page)
            seen, found = set(), set()
            for node, parent, _, children, fixture in page.elements:
                if not fixture:
                    seen.add(node)
                    nodes[node]["parent"] = parent
                    nodes[node]["styles"]["\n".join(children)] += 1
                    for label, k in Counter(children).items():
                        nodes[H.child_node(node, label)]["share"] += k / len(children)
            for path, fixture, text in page.blocks:
                if not fixture:
                    seen.add(path[-1])
                    nodes[path[-1]]["parent"] = path[-2]
                    found.add((path[-1], re.sub("[0-9]+", "0", text.lower())))
            for node in seen:
                nodes[node]["pages"] += 1
            for node, text in found:
                nodes[node]["texts"][text] += 1
        for x in nodes.values():
            m = max(2, x["pages"])
            if x["texts"]:
                x["own"] = 1.0 if x["pages"] < 2 else 1 - sum(math.log(n) for n in x["texts"].values()) / len(x["texts"]) / math.log(m)
            else:
                total = sum(x["styles"].values())
                x["own"] = 0.0 if x["pages"] < 2 or not total else min(1.0, -sum(n / total * math.log(n / total) for n in x["styles"].values()) / math.log(m))
        return {k: x for k, x in nodes.items() if x["pages"]}

    general, hosts = one(pages), defaultdict(list)
    for url, page in pages:
        hosts[url.split("/")[2]].append((url, page))
    for host, rows in hosts.items():
        nodes = one(rows)

        def fold(node):
            x, trust = nodes[node], nodes[node]["pages"] / (nodes[node]["pages"] + H.PRIOR_PAGES)
            own = trust * x["own"] + (1 - trust) * general[node]["own"]
            if x["texts"]:
                stats[host, node] = own, own
                return stats[host, node]
            below = [(y["share"] / sum(x["styles"].values()), fold(k)) for k, y in nodes.items() if y["parent"] == node and k != node]
            importance = 1 - (1 - own) * (1 - sum(w * i for w, (i, _) in below))
            stats[host, node] = importance, max([importance, *(m for _, (_, m) in below)])
            return stats[host, node]

        fold(H.ROOT)
    return stats


def test_tree_and_branches_of_two_sites(spark):
    pages = site(60) + site(3, "small.example.org") + [("x://one/1", "<body><div><p>Alone here.</p></div>")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    tree = H.site_tree(Scratch(spark), H.with_host(df))
    got = {(r.host, r.node): (r.importance, r.most) for r in tree.collect()}
    want = tree_in_python(pages)
    assert got.keys() == want.keys()
    for k, (a, b) in want.items():
        assert got[k] == pytest.approx((a, b), abs=1e-9)
    out = {r.page_id: r.text.split("\n") for r in H.main_text(df).collect()}
    for i in range(60):
        assert out[i][0].startswith("Title") and len(out[i]) == 2 + i % 4 and not any("rights" in t or "Welcome" in t or "Call" in t for t in out[i])
    assert out[63] == ["Alone here."]


def test_copies_of_an_article_do_not_make_it_boilerplate(spark):
    same = "<body><nav>m</nav><article><h1>T</h1><p>One and the same.</p></article></body>"
    other = [f"<body><nav>m</nav><article><h1>T{chr(97 + i)}</h1><p>Text {chr(97 + i)} alone.</p></article></body>" for i in range(20)]
    df = spark.createDataFrame([(i, "http://a.b/", p) for i, p in enumerate([same] * 40 + other)], "page_id long, url string, html string")
    assert {r.text for r in H.main_text(df).collect() if r.page_id < 40} == {"T\nOne and the same."}


def test_nulls_repeated_rows_clashing_columns_and_nothing(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://h/", "<p>a</p>"), (3, "no url", "<p>b"), (4, "http://u@H:80/x", ""), (5, "http://h/", "<p>" + "long " * 100_000)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit("y"), "page": F.lit(1), "node": F.lit(2)})
    got = sorted((tuple(r) for r in H.main_text(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (1, None, "", 0), (None, "http://h/", "a", 1), (3, "no url", "b", 1), (4, "http://u@H:80/x", "", 0), (5, "http://h/", ("long " * 100_000).strip(), 499_999)], key=str)
    assert H.main_text(df.limit(0)).count() == 0
    assert {r.host for r in H.with_host(df).select("host").collect()} == {"", "h"}
