"""Main text of web pages by a site style tree.

The DOMs of all pages of one host are merged: a style node is the path of element names and classes
from the body, held as a digest so that depth costs nothing. Near-equal pages of a host count once: a page
stands for the block of ten words and more that a hash picks from its text in proportion to the words, so
pages that share most of their prose stand for the same block. For every node Spark counts on how many of
the host's P pages, so counted, each content of its text blocks and each child sequence of its elements is.
The entropy of one content is log(its pages) / log(P + 8): 0 where one page has it, near 1 where all of
many have it; the 8 keeps a few equal pages from telling. One less its mean over the node's contents,
each weighted by its pages, is the node's content or presentation importance; both are joined into one.

A branch is noise when the importance of every node in it is low, so a block of text is removed when
that of its own node is. What counts as low depends on evidence in the page, by which the importance is
divided: 3 where a class or id is a word like notice or share (2 inside the article, unless most of the
block is links), 2 where a part of one is, 2 outside the article or main element of a page that has one.
Importance can outweigh each of these; a whole name needs four pages to do so, since fewer confirm nothing.
It can't outweigh a name and a place outside the article together, nor tags and roles that say what they are (navigation,
footers, forms, ...), nor the name of readers' comments, which are as varied as the text. An article or
main element ends what classes around it and a form or header around it say. All nodes are judged so,
those inside article and main elements too.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BOILERPLATE = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select textarea dialog menu head title".split())
RAW = frozenset("script style noscript template iframe object svg canvas title textarea".split())
MAIN = frozenset("article main".split())
SOFT = frozenset("header form".split())  # they may stand around the main text
NAME = r"(?:ad|ads|adv|advert\w*|banner|breadcrumbs?|consent|cookies?|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)"
READERS = re.compile(r"(?:^|\s)(?:comments?|comment-?list|disqus\w*|respond)(?:$|\s)", re.I)
READERS_PART = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus\w*|respond)(?:$|[\s_-])", re.I)
WHOLE_NAME = re.compile(rf"(?:^|\s){NAME}(?:$|\s)", re.I)
NAME_PART = re.compile(rf"(?:^|[\s_-]){NAME}(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
ITEMS = frozenset("p li tr td th dt dd option".split())  # an item ends the open item before it, and a block ends an open paragraph
SCOPES = frozenset("ul ol table dl article main".split())  # but not through these
SMOOTHING = 8
CERTAIN = 8  # what no importance outweighs
PROSE_WORDS = 10  # of a block that a page may stand for
FEW_PAGES = 4  # fewer confirm nothing about what a class or id names
BATCH = 64
BLANK = re.compile(r"\s+")


class Open(NamedTuple):
    """An open element."""

    tag: str
    node: int
    label: tuple[str, ...]  # the last steps of the path
    prior: int  # 1, 2, 3 or CERTAIN: what the importance is divided by
    raw: bool
    main: bool
    strict: bool  # whether the prior comes from a tag that no article inside can lift
    near: dict[str, int]  # where the open items of this scope are
    children: list[str]


ROOT = Open("", 0, ("",), 1, False, False, False, {}, [])


class PageTree(HTMLParser):
    """The text blocks of a page in order: ``(node, label, text, prior)``; and ``(node, label, child names)`` of its elements.

    Scripts, styles and the like have no blocks. Takes time in proportion to the page, however deep
    elements are nested and whatever is left open.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[int, tuple[str, ...], str, int, bool, bool]] = []
        self.open: list[Open] = []
        self.counts: Counter = Counter()
        self.elements: list[tuple[int, tuple[str, ...], str]] = []
        self.text: list[str] = []
        self.links = self.linked = 0  # open links, and characters inside links since the last block
        self.has_main = False

    @property
    def top(self) -> Open:
        return self.open[-1] if self.open else ROOT

    def flush(self) -> None:
        text = BLANK.sub(" ", "".join(self.text)).strip()
        self.text.clear()
        top, links = self.top, 2 * self.linked > len(text)
        self.links = self.linked = 0
        if text and not top.raw:
            self.found.append((top.node, top.label, text, top.prior, top.main, links))

    def close_to(self, size: int) -> None:
        while len(self.open) > size:
            done = self.open.pop()
            self.counts[done.tag] -= 1
            if done.children:
                self.elements.append((done.node, done.label, " ".join(done.children)))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            if tag == "br":
                self.text.append(" ")
            self.links += tag == "a"
            return
        self.flush()
        if tag in VOID or tag in ("html", "body"):
            return
        ends = [at for name in {"p", tag} & ITEMS if (at := self.top.near.get(name)) is not None]
        if ends:
            self.close_to(min(ends))
        own, top = {k: v or "" for k, v in attrs}, self.top
        role, names = own.get("role"), f"{own.get('class', '')} {own.get('id', '')}".strip()
        container = tag in MAIN or role in MAIN
        prior, strict = top.prior, top.strict
        if container:
            self.has_main = True
            prior = prior if strict else 1
        elif names and (NAME_PART.search(names) or READERS_PART.search(names)):
            prior = max(prior, 3 if WHOLE_NAME.search(names) else 2)
        if tag in BOILERPLATE - SOFT or role in ROLES - SOFT or "hidden" in own or own.get("aria-hidden") == "true" or names and READERS.search(names):
            prior, strict = CERTAIN, True
        elif tag == "form" or role in SOFT or tag in SOFT and not top.main:
            prior = CERTAIN
        step = tag + ("." + re.sub(r"\d+", "0", own["class"]).replace(" ", ".") if own.get("class") else "")
        top.children.append(step)
        near = {} if tag in SCOPES else {**top.near, tag: len(self.open)} if tag in ITEMS else top.near
        node = xxhash.xxh3_64_intdigest(step.encode(), seed=top.node) >> 1
        self.open.append(Open(tag, node, (*top.label, step)[-8:], prior, top.raw or tag in RAW, top.main or container, strict, near, []))
        self.counts[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE or tag in VOID:
            self.links -= tag == "a" and self.links > 0
            return
        self.flush()
        if self.counts[tag]:
            self.close_to(next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag))

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links:
            self.linked += len(data)

    @property
    def blocks(self) -> list[tuple[int, tuple[str, ...], str, int]]:
        """``(node, label, text, prior)`` in page order."""
        inside = lambda prior, links: 2 if prior == 3 and not links else prior
        outside = lambda prior: 2 if prior == 1 else CERTAIN
        judged = lambda prior, main, links: inside(prior, links) if main else outside(prior) if self.has_main else prior
        return [(node, label, text, judged(prior, main, links)) for node, label, text, prior, main, links in self.found]

    def stands_for(self, html: str) -> int:
        """The block of prose that a hash picks, by the words of each; a page without any stands for its whole html."""
        prose = {text: n for _, _, text, prior in self.blocks if prior < CERTAIN and (n := text.count(" ") + 1) >= PROSE_WORDS}
        picked = min(prose, key=lambda t: (-math.log((xxhash.xxh3_64_intdigest(t.encode(), seed=1) + 1) / 2**64) / prose[t], t), default=html)
        return xxhash.xxh3_64_intdigest(picked.encode()) >> 1

    @classmethod
    def of(cls, html: str | None) -> PageTree:
        ROOT.children.clear()
        page = cls()
        page.feed(html or "")
        page.close()
        page.flush()
        page.close_to(0)
        return page


def host_of(url: Column) -> Column:
    """The host in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _style_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["host", "page", "kind", "node", "label", "content", "prior"]
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part, rows = batch.slice(at, BATCH), []
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                page = PageTree.of(html)
                stands = page.stands_for(html or "")
                found = [("content", n, x, t, prior) for n, x, t, prior in page.blocks] + [("presentation", n, x, c, 0) for n, x, c in page.elements]
                rows += [(host, stands, kind, n, "/".join(x), xxhash.xxh3_64_intdigest(c.encode()) >> 1, prior) for kind, n, x, c, prior in [*found, ("page", 0, (), "", 0)]]
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", gamma: float = 0.9) -> DataFrame:
    """``host, node, path, pages`` (the host's, near-equal ones once), ``importance``, ``prior`` of the style nodes that hold text.

    ``path`` shows the last eight steps, ``prior`` is the largest that importance may outweigh. The importance
    of a node is its content importance, by ``gamma``, and its presentation importance, where elements
    of it have children, by the rest.
    """
    nodes = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_style_nodes, "host string, page long, kind string, node long, label string, content long, prior int")
    open_ = F.max(F.when(F.col("prior") < CERTAIN, F.col("prior"))).alias("prior")
    once = nodes.groupBy("host", "kind", "node", "content", "page").agg(F.min("label").alias("label"), open_)
    counts = once.groupBy("host", "kind", "node", "content").agg(F.count("*").alias("c"), F.min("label").alias("label"), F.max("prior").alias("prior"))
    c = F.col("c").cast("double")
    spread = counts.groupBy("host", "kind", "node").agg(F.sum("c").alias("n"), F.sum(c * F.log(c)).alias("clogc"), F.min("label").alias("path"), F.max("prior").alias("prior"))
    spread = written(spread, "style-spread")
    hosts = spread.where("kind = 'page'").select("host", F.col("n").alias("pages"))
    scored = spread.where("kind <> 'page'").join(hosts, "host").withColumn("importance", F.greatest(F.lit(0.0), 1 - F.col("clogc") / F.col("n") / F.log(F.col("pages") + float(SMOOTHING))))
    looks = scored.where("kind = 'presentation'").select("host", "node", F.col("importance").alias("looks"))
    both = scored.where("kind = 'content'").join(looks, ["host", "node"], "left")
    return both.select("host", "node", "path", "pages", "prior", F.when(F.col("looks").isNull(), F.col("importance")).otherwise((1 - gamma) * F.col("looks") + gamma * F.col("importance")).alias("importance"))


def _texts(names: list[str], html_at: int, low_at: tuple[int, ...]):
    """The texts of pages whose columns ``low_at`` list the nodes that are low at priors of 1, 2 and 3."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part, found = batch.slice(at, BATCH), []
                for html, *low in zip(*[part.column(i).to_pylist() for i in (html_at, *low_at)], strict=True):
                    sets = {prior: frozenset(x or ()) for prior, x in zip((1, 2, 3), low, strict=True)}
                    found.append("\n".join([text for node, _, text, prior in PageTree.of(html).blocks if prior < CERTAIN and node not in sets[prior]]))
                yield pa.RecordBatch.from_arrays([x for i, x in enumerate(part.columns) if i not in (html_at, *low_at)] + [pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=names)

    return texts


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.3, broadcast_rows: int = 20_000) -> DataFrame:
    """One row for each row of ``pages``: ``page_id, url, text, n_chars`` (code points).

    Blocks in page order, one newline between them; white space inside a block is one space. A block
    goes where its node's importance divided by its prior is below ``threshold``, or its prior is certain. A
    null html counts as empty and gives an empty text; a null url belongs to the host without name. Each
    row is extracted for itself, repeated ones too, from its whole html, however long or deep. Other
    columns are ignored, whatever their names. An empty table gives an empty result. The nodes of low
    importance are broadcast if they are at most ``broadcast_rows`` (counted first); else they are joined
    by host.
    """
    below = lambda prior: F.when(F.col("prior") >= prior, F.when((F.col("importance") < prior * threshold) | (F.lit(prior) >= 3) & (F.col("pages") < FEW_PAGES), F.col("node")))
    levels = {"noise": below(1), "doubted": below(2), "named": below(3)}
    low = style_tree(pages, url_col, html_col).select("host", *[c.alias(n) for n, c in levels.items()]).where(" OR ".join(f"{n} IS NOT NULL" for n in levels))
    low = written(low, "style-noise")
    by_host = low.groupBy("host").agg(*[F.collect_set(n).alias(n) for n in levels])  # the style nodes of one host
    by_host = F.broadcast(by_host) if low.count() <= broadcast_rows else written(by_host, "style-hosts")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    joined = own.join(by_host, "host", "left").select("page_id", "url", "html", *levels)
    kind = pages.schema[id_col].dataType.simpleString()
    names = ["page_id", "url", "text", "n_chars"]
    return joined.mapInArrow(_texts(names, 2, (3, 4, 5)), f"page_id {kind}, url string, text string, n_chars long")
