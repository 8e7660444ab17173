"""Main text of web pages by a site style tree.

The block elements of all pages of a host are merged into one tree: elements with the same path of labels (tag, classes,
id) are one node. A node's presentation weighs by how its elements differ in their children (entropy to the base of the
pages that have it), a text node's content by how few pages share its texts (one less the mean entropy of the distinct
texts). Both lean on the tree of all hosts where a host has few pages. The importance of a branch joins its own
presentation with the mean of its children's. Branches that are below ``LEAST``, they and all below them, leave every
page, and so do those whose labels name a fixture of pages (menu, footer, advert, form, comments ...), whatever they hold.

Statistics are sums over (host, node, item) with partial sums in each task, so a hot host is dealt by its texts and
layouts; the tree is folded by levels of joins. No page and no host is ever gathered in a task.

Defined results: a null, empty or broken page gives what its tags allow, an empty text where nothing is left; a null url
is a host of its own; repeated pages and page ids give one row each; elements below ``DEPTH`` levels count as the element
above them, their text stays; an empty table gives no row; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Branches of less importance go. Pages of a host that weigh as much as the tree of all hosts. Levels of the tree.
LEAST, PRIOR_PAGES, DEPTH = 0.2, 8.0, 24
#: Levels folded between two written tables.
FOLD = 8

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose content is never text of the page; the second kind ends at the next block, closed or not.
SILENT = frozenset(("script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "head"))
CONTROLS = frozenset(("button", "select", "textarea", "datalist", "title"))
#: A start tag (key) ends open elements (first) that no boundary (second) hides.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir", "table")), "dd": (("dd", "dt"), ("dl", "table")), "dt": (("dd", "dt"), ("dl", "table")),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
SCOPE = frozenset(("table", "td", "th", "caption", "html"))
TABLE_PARTS = frozenset(("table", "caption", "tbody", "thead", "tfoot", "tr", "td", "th"))
FIXTURE_TAGS = frozenset(("nav", "aside", "footer", "form", "dialog", "menu", "search"))
FIXTURE_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"))
FIXTURE_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising banner promo promotion promoted sponsor sponsored sponsors nav navbar navigation menu menubar breadcrumb"
    " breadcrumbs sidebar footer masthead cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended"
    " recommendations widget widgets comment comments disqus respond reply replies notice notices alert toolbar pagination pager copyright".split()
)
#: Classes that speak of the page as a whole ("has-sidebar") name no fixture.
ABOUT = ("has-", "with-", "no-", "is-", "not-")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A tag that the page's end cuts off.
CUT_TAG = re.compile(r"<[A-Za-z/!?][^>]*\Z")
ROOT, TEXT = 0, "#text"


@lru_cache(maxsize=1 << 16)
def child_node(parent: int, label: str) -> int:
    """The id of a path: 64 bits of its parent's id and its own label."""
    return int.from_bytes(hashlib.blake2b(f"{parent} {label}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=1 << 16)
def look(tag: str, classes: str, ident: str, role: str, inside: bool) -> tuple[str, bool]:
    """(label, whether it names a fixture of pages) of an element; ``inside``: within an article or the main part."""
    label = DIGITS.sub("0", ".".join([tag, *sorted(set(classes.split()))]) + (f"#{ident}" if ident else ""))
    if tag in FIXTURE_TAGS or role in FIXTURE_ROLES or (tag == "header" and not inside):
        return label, True
    if tag in ("html", "body", "main", "article"):
        return label, False
    names = [x for x in (*classes.split(), ident) if not x.lower().startswith(ABOUT)]
    words = {w.lower() for x in names for w in WORD.findall(x)}
    return label, bool(words & FIXTURE_WORDS) or (words == {"header"} and not inside)


class Page(HTMLParser):
    """The blocks of text of one page, each with the nodes above it, and the elements with their children.

    Inline elements are part of their block; end tags that are missing are implied as browsers do.
    """

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        # An element: [tag, node, children's labels, fixture, inside, level, nodes from the root to it].
        self.stack: list[list] = [["", ROOT, [], False, False, 0, ()]]
        self.open: Counter = Counter()
        self.elements: list[tuple[int, int, int, list[str], bool]] = []
        self.blocks: list[tuple[tuple[int, ...], bool, str]] = []
        self.run: list[str] = []
        self.silent, self.depth = "", 0
        cut = CUT_TAG.search(html, max(0, html.rfind("<")))
        self.feed(html[: cut.start()] if cut else html)
        self.close()
        self.flush()
        self.silent = ""
        while self.stack:
            self.pop()

    # -- building the tree

    def flush(self) -> None:
        """End the run of text that is open."""
        text = " ".join("".join(self.run).split())
        self.run.clear()
        if text:
            top = self.stack[-1]
            top[2].append(TEXT)
            self.blocks.append(((*top[6], child_node(top[1], TEXT)), top[3], text))

    def pop(self) -> None:
        tag, node, children, fixture, _, depth, _ = self.stack.pop()
        self.open[tag] -= 1
        if depth <= DEPTH:
            self.elements.append((node, self.stack[-1][1] if self.stack else ROOT, depth, children, fixture))

    def end(self, names: tuple[str, ...], hidden_by: frozenset | tuple) -> None:
        """Close the innermost open element of one of the names, unless a boundary comes first."""
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in names:
                self.flush()
                while len(self.stack) > i:
                    self.pop()
                return
            if tag in hidden_by:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            if tag == self.silent:
                self.depth += 1
                return
            if tag not in BLOCKS or self.silent not in CONTROLS and self.silent != "head":
                return
            self.silent = ""
        if tag in SILENT or tag in CONTROLS:
            self.silent, self.depth = tag, 1
            return
        if tag not in BLOCKS:
            if tag in ("br", "wbr"):
                self.run.append(" " if tag == "br" else "")
            return
        if tag in ("html", "body") and self.open[tag]:
            return
        self.flush()
        if tag in ENDS:
            self.end(*ENDS[tag])
        elif tag not in TABLE_PARTS or tag == "table":
            self.end(("p",), SCOPE)
            if tag in HEADINGS and self.stack[-1][0] in HEADINGS:
                self.pop()
        if tag == "hr":
            return
        found = dict(attrs)
        top = self.stack[-1]
        label, fixture = look(tag, found.get("class") or "", found.get("id") or "", (found.get("role") or "").lower(), top[4])
        fixture = fixture or top[3] or "hidden" in found or bool(HIDDEN.search(found.get("style") or ""))
        inside, depth = top[4] or tag in ("article", "main") or found.get("role") == "main", top[5] + 1
        if depth <= DEPTH:
            top[2].append(label)
            node = child_node(top[1], label)
            self.stack.append([tag, node, [], fixture, inside, depth, (*top[6], node)])
        else:  # counts as the element above it
            self.stack.append([tag, top[1], top[2], fixture, inside, depth, top[6]])
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in SILENT or tag in CONTROLS:
            return
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag == self.silent:
                self.depth -= 1
                if not self.depth:
                    self.silent = ""
                return
            if tag not in BLOCKS or self.silent not in CONTROLS:
                return
            self.silent = ""
        if tag in BLOCKS and tag not in ("html", "body"):
            self.flush()
            if tag in HEADINGS:
                self.end(tuple(HEADINGS), SCOPE)
            elif tag in TABLE_PARTS:
                self.end((tag,), ("table",) if tag != "table" else ())
            else:
                self.end((tag,), SCOPE | {"ul", "ol"} if tag == "li" else SCOPE)

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data)


def feature(text: str) -> int:
    """64 bits of a text in lower case, its numbers alike: what pages share of a block."""
    return int.from_bytes(hashlib.blake2b(DIGITS.sub("0", text.lower()).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


STATS = "host string, node long, kind string, item long, n long, parent long, depth int, share double"


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``STATS`` of pages (host, html), summed within each batch. Kinds: ``page`` (pages that have the node, its
    elements' share of their parents' children), ``style`` (elements with the children ``item``), ``text`` (pages that
    have the text ``item`` there)."""
    for batch in batches:
        counts: Counter = Counter()
        about: dict[tuple[str, int], list] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(html or "")
            seen, texts = set(), set()
            for node, parent, depth, children, fixture in page.elements:
                if fixture:
                    continue
                seen.add((node, parent, depth))
                counts[host, node, "style", child_node(1, "\n".join(children))] += 1
                if children:
                    for label, n in Counter(children).items():
                        about.setdefault((host, child_node(node, label)), [0.0])[0] += n / len(children)
            for nodes, fixture, text in page.blocks:
                if not fixture:
                    seen.add((nodes[-1], nodes[-2] if len(nodes) > 1 else ROOT, len(nodes)))
                    texts.add((nodes[-1], feature(text)))
            for node, parent, depth in seen:
                counts[host, node, "page", 0] += 1
                about.setdefault((host, node), [0.0])[1:] = [parent, depth]
            for node, item in texts:
                counts[host, node, "text", item] += 1
        rows = [(*key, n, *([about[key[:2]][1], about[key[:2]][2], about[key[:2]][0]] if key[2] == "page" else (None, None, None))) for key, n in counts.items()]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in STATS.split(", ")])


def _summed(rows: DataFrame) -> DataFrame:
    """(host, node, parent, depth, pages, share, own): what each node weighs by itself, presentation or content."""
    n, log = F.col("n"), lambda x: F.log(x.cast("double"))
    of = lambda kind: F.col("kind") == kind
    sums = rows.groupBy("host", "node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum(F.when(of("page"), n)).alias("pages"), F.sum("share").alias("share"),
        F.sum(F.when(of("style"), n)).alias("elements"), F.sum(F.when(of("style"), n * log(n))).alias("styles"),
        F.count_if(of("text")).alias("texts"), F.sum(F.when(of("text"), log(n))).alias("spread"),
    )
    # One page (or a node that none but fixtures hold) tells nothing: a text is important then, a layout is not varied.
    base = log(F.greatest("pages", F.lit(2)))
    content = F.when(F.col("pages") > 1, 1 - F.col("spread") / F.col("texts") / base).otherwise(1.0)
    layout = F.when(F.col("pages") > 1, F.least(F.lit(1.0), (log(F.col("elements")) - F.col("styles") / F.col("elements")) / base)).otherwise(0.0)
    own = F.when(F.col("texts") > 0, content).otherwise(F.greatest(F.lit(0.0), layout))
    return sums.filter("pages is not null").select("host", "node", "parent", "depth", "pages", "share", "elements", (F.col("texts") > 0).alias("is_text"), own.alias("own"))


def site_tree(scratch: Scratch, pages: DataFrame) -> DataFrame:
    """(host, node, parent, depth, pages, is_text, importance, most) of every node that no fixture holds, ``most`` being the
    largest importance of the node and those below it; ``pages``: (host, html)."""
    rows = pages.select("host", "html").mapInArrow(gathered, STATS)
    rows = rows.groupBy("host", "node", "kind", "item").agg(F.sum("n").alias("n"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("share").alias("share"))
    rows = scratch.keep("html_stats", rows)
    every = rows.groupBy("node", "kind", "item").agg(F.sum("n").alias("n"), F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.sum("share").alias("share"))
    every = _summed(every.withColumn("host", F.lit(""))).select("node", F.col("own").alias("general"))
    trust = F.col("pages") / (F.col("pages") + PRIOR_PAGES)
    nodes = _summed(rows).join(every, "node").withColumn("own", trust * F.col("own") + (1 - trust) * F.col("general"))
    above = nodes.select("host", F.col("node").alias("parent"), F.col("elements").alias("of"))
    nodes = scratch.keep("html_nodes", nodes.join(above, ["host", "parent"], "left").withColumn("part", F.coalesce(F.col("share") / F.col("of"), F.lit(0.0))))
    # Fold from the leaves: a branch is important by its own presentation or by the mean of its children.
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done, below = [], None
    for level in range(deepest, -1, -1):
        now = nodes.filter(F.col("depth") == level)
        importance, most = F.col("own"), F.col("own")
        if below is not None:
            inner = below.groupBy("host", F.col("parent").alias("node")).agg(F.sum(F.col("part") * F.col("importance")).alias("inner"), F.max("most").alias("inner_most"))
            now = now.join(inner, ["host", "node"], "left")
            importance = F.when(F.col("is_text"), F.col("own")).otherwise(1 - (1 - F.col("own")) * (1 - F.coalesce("inner", F.lit(0.0))))
            most = F.greatest(importance, "inner_most")
        now = now.select("host", "node", "parent", "depth", "pages", "is_text", "part", importance.alias("importance"), most.alias("most"))
        if (deepest - level) % FOLD == FOLD - 1:
            now = scratch.keep(f"html_level{level}", now)
        below = now
        done.append(now)
    if not done:
        return nodes.select("host", "node", "parent", "depth", "pages", "is_text", F.col("own").alias("importance"), F.col("own").alias("most"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part")


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host, page): the host in lower case without port; ``page`` tells pages with other urls or texts apart."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select("page_id", "url", html.alias("html")).withColumns({"host": host, "page": F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), "html"), 256)})


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, host, node) of the nodes of each page (page, host, html) that hold text and are no fixture's."""
    for batch in batches:
        out: list[tuple] = []
        for page, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out += ((page, host, x) for x in {n for nodes, fixture, _ in Page(html).blocks if not fixture for n in nodes})
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["page", "host", "node"])


def main_text(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """(page_id, url, text, n_chars): each page's blocks outside fixtures and low branches, in page order, one a line."""
    spark, kinds = pages.sparkSession, {f.name: f.dataType.simpleString() for f in pages.schema}
    rows = with_host(pages)
    scratch = Scratch(spark)
    low = site_tree(scratch, rows).filter(F.col("most") < least).select("host", "node").filter(F.col("node") != ROOT)
    low = scratch.keep("html_low", low)
    held = rows.select("page", "host", "html").mapInArrow(_nodes, "page string, host string, node long")
    gone = held.join(low, ["host", "node"]).groupBy("page").agg(F.collect_set("node").alias("gone"))  # at most a page's own nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, low_nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                without = set(low_nodes or ())
                texts.append("\n".join(text for nodes, fixture, text in Page(html).blocks if not fixture and without.isdisjoint(nodes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kept = rows.join(gone, "page", "left").select("page_id", "url", "html", "gone")
    out = kept.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
