"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged: elements with the same path of tags and classes are one node, over the
whole DOM. A node keeps how its children were laid out (presentation) and which blocks of text it held (content).

* Presentation importance is the entropy of a node's layouts to the base of their number: 0 if it always looks
  alike.
* Content importance of a block is ``1 - ln(pages with it) / ln(pages with its node)``: 1 if one page has it, 0 if
  all have. A node's is the mean over the distinct blocks in and below it, so it is passed up to every ancestor.
* Importance is ``(1 - DAMP) * presentation + DAMP * content``. A host of few pages borrows: its node counts as
  BORROWED pages of the same node over all hosts, which itself counts as DOUBT pages of importance 1.

A branch is cut at its highest node whose importance is below LOW, inside ``article`` and ``main`` below LEAST. A
single block outside of these is cut if its own importance, with BLOCK_DOUBT pages of importance 1, is below LEAST
and its page holds other text. A page never loses all its text to the tree.

Names are a prior. What can't be text (scripts, styles, form controls, hidden elements) goes. ``nav``, ``footer``,
``aside`` and the like, and elements whose class or id is one of the names below as a whole, go unless the tree
overrules: the node holds half of its pages' text, at an importance of HIGH on SEEN pages. Class and id alone don't
cut what holds ``main``, an ``h1`` or nearly all text of its page.

Counts are aggregated by host and node before they are shuffled, and no step gathers a host's pages or blocks. The
pages are parsed once; only the list of a host's low nodes is joined to them.

Rows: null or empty html gives the empty text. A null url, or one without a host, has no style tree. Repeated rows
are all returned and counted as pages of their own. Pages cut off anywhere are read to their end. Elements below
DEEP levels count as part of the one at that level. Other columns of the input, whatever their names, are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, small_batches, staged

DAMP = 0.9
LOW, LEAST, HIGH = 0.7, 0.1, 0.9
BORROWED, DOUBT, BLOCK_DOUBT, SEEN = 50, 8, 4, 8
#: Levels of a page that have nodes of their own.
DEEP = 64
#: What a name as a prior says of an element: nothing, main text, noise by class or id, noise by tag or role.
NEUTRAL, MAIN, NAMED, NOISE = 0, 1, 2, 3

#: Elements that start a block of text, those that hold no text, and those that seldom hold main text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object".split())
CONTROLS = frozenset("button select datalist audio video canvas map head".split())
NOISE_TAGS = frozenset("nav footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that tell noise, words that may stand beside them, and names of main text.
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored banner promo promotion cookie "
    "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription "
    "signup sidebar sidenav widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "toolbar comment comments commentlist disqus reply replies respond share sharing social related recommended "
    "recommendations pagination pager searchform login skip copyright".split()
)
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global header area section box block wrapper container "
    "list item items bar link links icon icons button buttons slot form bottom content body text inner outer group col "
    "column row panel zone unit".split()
)
MAIN_NAMES = frozenset("content article post story entry main maincontent body text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*+(?:>|\Z)|</[^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"([a-z])([A-Z])")
BLANK = re.compile(r"\s+")
NAME = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Paths, layouts and elements that a worker remembers.
REMEMBERED = 200_000
_paths: dict[tuple[int, str], int] = {}
_elements: dict[tuple[str, str], tuple[int, str]] = {}


def remembered(memory: dict, key: tuple, make) -> object:
    """``make()`` for a new key, else what it gave before."""
    found = memory.get(key)
    if found is None:
        if len(memory) >= REMEMBERED:
            memory.clear()
        found = memory[key] = make()
    return found


def path_of(above: int, label: str) -> int:
    """A 64-bit hash of a path that fits a signed column."""

    def make() -> int:
        return int.from_bytes(hashlib.blake2b(f"{above} {label}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)

    return remembered(_paths, (above, label), make)


def says(name: str) -> int:
    """What one name of a class or id tells."""
    words = set(NAME.findall(CAMEL.sub(r"\1 \2", name).lower()))
    if words and words <= MAIN_NAMES:
        return MAIN
    return NAMED if words & NOISE_NAMES and words <= NOISE_NAMES | BESIDE else NEUTRAL


def element(tag: str, attributes: str) -> tuple[int, str]:
    """What the names of an element tell, and its label in the tree. Numbers in class names don't count."""

    def make() -> tuple[int, str]:
        a: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            a.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        classes = a.get("class", "").split()
        label = tag + "".join(f".{c}" for c in sorted({DIGITS.sub("#", c) for c in classes}))
        if "hidden" in a or HIDDEN.search(a.get("style", "")) or a.get("role", "").lower() in NOISE_ROLES or tag in NOISE_TAGS:
            return NOISE, label + "!"
        told = {says(x) for x in [*classes, *a.get("id", "").split()]}
        if tag == "main" or a.get("role", "").lower() == "main":
            return MAIN, label
        if NAMED in told and MAIN not in told and tag not in ("html", "body") or tag == "form":
            return NAMED, label + "?"
        return MAIN if tag == "article" else NEUTRAL, label

    return remembered(_elements, (tag, attributes), make) if attributes else (plain(tag), tag)


def plain(tag: str) -> int:
    """What a tag without attributes tells."""
    return NOISE if tag in NOISE_TAGS else MAIN if tag in ("main", "article") else NAMED if tag == "form" else NEUTRAL


class Page:
    """Nodes, layouts and blocks of text of one page, by one scan.

    nodes: path, number of the node above, what names tell, whether it holds ``main`` or ``h1``. blocks: number of
    the node, text. layouts: how often a node's children stood in which order.
    """

    def __init__(self, source: str) -> None:
        self.nodes: list[list] = [[0, 0, NEUTRAL, False]]
        self.at: dict[int, int] = {0: 0}
        self.blocks: list[tuple[int, str]] = []
        self.layouts: dict[tuple[int, int], int] = {}
        self.stack: list[tuple[str, int, bool, list[str]]] = [("", 0, False, [])]  # tag, node, inside of main text, labels below
        self.open_tags: dict[str, int] = {}
        self.silent = 0  # elements without text that are open
        self.held: list[str] = []
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self.held.append(source[at:])
                break
            if m.start() > at:
                self.held.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
            else:
                self.start(tag, m[3])
                if tag in RAW and not m[3].endswith("/"):
                    over = END[tag].search(source, at)
                    at = over.start() if over else n
        self.flush()
        self.close(1)
        self.left()

    def flush(self) -> None:
        if self.held:
            if not self.silent:
                text = BLANK.sub(" ", html.unescape("".join(self.held))).strip()
                if text:
                    self.blocks.append((self.stack[-1][1], text))
            self.held = []

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.held.append(" ")
        if tag in RAW or tag in CONTROLS:
            self.flush()
            if not attributes.endswith("/"):
                self.push(tag, self.stack[-1][1], self.stack[-1][2])
                self.silent += 1
            return
        if tag not in BLOCKS and tag not in NOISE_TAGS:
            if tag not in VOID and attributes and attributes != "/":
                told, label = element(tag, attributes)
                if told >= NAMED:  # an inline element that is noise holds its own text
                    self.flush()
                    self.open(tag, label, told)
            return
        self.flush()
        self.implied(tag)
        if tag == "hr":
            return
        told, label = element(tag, attributes if attributes != "/" else "")
        if tag == "header" and not self.stack[-1][2]:
            told, label = NOISE, label + "!"
        self.open(tag, label, told)

    def open(self, tag: str, label: str, told: int) -> None:
        _, above, main, labels = self.stack[-1]
        main = main and told < NAMED or told == MAIN
        if len(self.stack) > DEEP:
            self.push(tag, above, main)
            return
        labels.append(label)
        path = path_of(self.nodes[above][0], label + "+" * main)
        node = self.at.get(path)
        if node is None:
            node = self.at[path] = len(self.nodes)
            self.nodes.append([path, above, MAIN if main else told, False])
        if tag in ("main", "h1"):
            k = node
            while k and not self.nodes[k][3]:
                self.nodes[k][3] = True
                k = self.nodes[k][1]
        self.push(tag, node, main)

    def push(self, tag: str, node: int, main: bool) -> None:
        self.stack.append((tag, node, main, []))
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1

    def close(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        for tag, node, _, labels in reversed(self.stack[k:]):
            self.open_tags[tag] -= 1
            if tag in RAW or tag in CONTROLS:
                self.silent -= 1
            self.laid_out(node, labels)
        del self.stack[k:]

    def left(self) -> None:
        self.laid_out(0, self.stack[0][3])

    def laid_out(self, node: int, labels: list[str]) -> None:
        if labels:
            place = (node, path_of(1, " ".join(labels)) if len(labels) > 64 else hash_of(labels))
            self.layouts[place] = self.layouts.get(place, 0) + 1

    def implied(self, tag: str) -> None:
        """Closes what the start of ``tag`` closes."""
        closes, within = CLOSES.get(tag, set()), WITHIN.get(tag, {"dl", "select"})
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name in closes or name == "p":
                self.close(k)
                if name != "p" and tag != "tr":
                    return
            elif closes and name in within or not closes:
                return

    def end(self, tag: str) -> None:
        if self.open_tags.get(tag):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == tag:
                    self.flush()
                    self.close(k)
                    return
                if tag in ("p", "li") and self.stack[k][0] in ("article", "main", "body", "div", "section", "ul", "ol"):
                    break
        if tag in BLOCKS:
            self.flush()

    def sizes(self) -> list[int]:
        """Characters in and below each node."""
        out = [0] * len(self.nodes)
        for node, text in self.blocks:
            out[node] += len(text)
        for k in range(len(out) - 1, 0, -1):
            out[self.nodes[k][1]] += out[k]
        return out

    def above(self, node: int) -> list[int]:
        """Paths of a node and all above it, but the page."""
        out = []
        while node:
            out.append(self.nodes[node][0])
            node = self.nodes[node][1]
        return out


def hash_of(labels: list[str]) -> int:
    return path_of(1, " ".join(labels))


def text_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


#: What is known of a host's node: low anywhere, low even inside of main text, main text whatever its name.
LOW_NODE, LEAST_NODE, SPARED = 0, 1, 2


def noise(nodes: list, sizes: list[int], known: dict[int, int]) -> tuple[list[bool], list[bool]]:
    """For each node whether names cut it, and whether the tree does. nodes: path, above, told, holds main or h1."""
    total = sizes[0] - sum(sizes[k] for k, x in enumerate(nodes) if x[2] == NOISE and nodes[x[1]][2] != NOISE)
    named, low = [False] * len(nodes), [False] * len(nodes)
    for k in range(1, len(nodes)):
        path, up, told, holds = nodes[k]
        found = known.get(path)
        if told >= NAMED and found != SPARED:
            named[k] = told == NOISE or not (holds or 10 * sizes[k] >= 9 * max(total, 1))
        named[k] = named[k] or named[up]
        low[k] = low[up] or (found == LEAST_NODE or found == LOW_NODE and told != MAIN) and not holds
    return named, low


def main_blocks(nodes: list, blocks: list[tuple[int, str]], sizes: list[int], known: dict[int, int], stale: set[tuple[int, int]]) -> list[str]:
    """The blocks that are left. known: what the tree says of paths; stale: path and hash of low blocks."""
    named, low = noise(nodes, sizes, known)
    left = [(node, text) for node, text in blocks if not named[node]]
    kept = [(node, text) for node, text in left if not low[node]]
    if stale:
        fresh = [(node, text) for node, text in kept if nodes[node][2] == MAIN or (nodes[node][0], text_hash(text)) not in stale]
        kept = fresh or kept
    return [text for _, text in kept or left]


def host(url: str = "url") -> Column:
    """The lower-case host of a url, or null."""
    found = F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def lists(counts: list[int], columns: dict[str, pa.Array]) -> pa.Array:
    """A list of structs for each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, nodes, layouts and blocks of every row of ``pages`` (page_id, url, html, host)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            node: list[list] = [[], [], [], [], [], []]  # path, up, told, holds, size, above
            layout: list[list] = [[], [], []]  # path, l, c
            block: list[list] = [[], [], [], []]  # node, path, f, text
            for source in batch.column("html").to_pylist():
                page = Page(source or "")
                for c, x in zip(counts, (page.nodes, page.layouts, page.blocks), strict=True):
                    c.append(len(x))
                for k, ((path, up, told, holds), size) in enumerate(zip(page.nodes, page.sizes(), strict=True)):
                    for c, v in zip(node, (path, up, told, holds, size, page.above(k)), strict=True):
                        c.append(v)
                for (k, l), c_ in page.layouts.items():
                    layout[0].append(page.nodes[k][0])
                    layout[1].append(l)
                    layout[2].append(c_)
                for k, text in page.blocks:
                    block[0].append(k)
                    block[1].append(page.nodes[k][0])
                    block[2].append(text_hash(text))
                    block[3].append(text)
            kinds = (pa.int64(), pa.int32(), pa.int8(), pa.bool_(), pa.int32(), pa.list_(pa.int64()))
            nodes = lists(counts[0], {n: pa.array(c, t) for n, c, t in zip(("path", "up", "told", "holds", "size", "above"), node, kinds, strict=True)})
            layouts = lists(counts[1], {n: pa.array(c, t) for n, c, t in zip(("path", "f", "c"), layout, (pa.int64(), pa.int64(), pa.int32()), strict=True)})
            blocks = lists(counts[2], {n: pa.array(c, t) for n, c, t in zip(("node", "path", "f", "text"), block, (pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)})
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), batch.column("host"), nodes, layouts, blocks], names=["page_id", "url", "host", "nodes", "layouts", "blocks"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    shape = (
        f"page_id {kinds['page_id']}, url {kinds['url']}, host string, "
        "nodes array<struct<path:bigint,up:int,told:tinyint,holds:boolean,size:int,above:array<bigint>>>, "
        "layouts array<struct<path:bigint,f:bigint,c:int>>, blocks array<struct<node:int,path:bigint,f:bigint,text:string>>"
    )
    return pages.select("page_id", "url", "html", "host").mapInArrow(run, shape)


def importance(nodes: DataFrame, features: DataFrame, by: list[str]) -> DataFrame:
    """``by``, path, m (pages) and t (importance from these pages alone; null without text) of each node, by ``by`` and path.

    nodes: by, path, above, m. features: by, path, kind (0: layout, 1: block), f, n.
    """
    n = F.col("n").cast("double")
    block = F.col("kind") == 1
    own = features.groupBy(*by, "path").agg(
        F.sum(F.when(block, 1.0)).alias("many"),
        F.sum(F.when(block, F.log(n))).alias("logs"),
        F.sum(F.when(~block, n)).alias("laid"),
        F.sum(F.when(~block, n * F.log(n))).alias("same"),
    )
    keyed = own.select(*[F.col(c).alias(f"{c}_") for c in (*by, "path")], "many", "logs", "laid", "same")
    match = F.col("path") == F.col("path_")
    for c in by:
        match = match & (F.col(c) == F.col(f"{c}_"))
    both = nodes.join(keyed, match, "left").drop(*[f"{c}_" for c in (*by, "path")])
    base = F.log(F.greatest(F.col("m"), F.lit(2)).cast("double"))
    up = both.where("many > 0").select(*by, F.explode("above").alias("a_"), "many", (F.col("many") - F.col("logs") / base).alias("worth"))
    up = up.groupBy(*[F.col(c).alias(f"{c}_") for c in by], "a_").agg((F.sum("worth") / F.sum("many")).alias("content"))
    match = F.col("path") == F.col("a_")
    for c in by:
        match = match & (F.col(c) == F.col(f"{c}_"))
    looks = F.when(F.col("laid") > 1, 1 - F.col("same") / (F.col("laid") * F.log("laid"))).when(F.col("laid") == 1, 1.0)
    t = F.when(looks.isNull(), F.col("content")).otherwise((1 - DAMP) * looks + DAMP * F.col("content"))
    return both.join(up, match).withColumn("t", t).drop("many", "logs", "laid", "same", "content", "a_", *[f"{c}_" for c in by])


def low_nodes(pages: DataFrame) -> DataFrame:
    """h, known (path, what) and stale (path, f): what the tree says of each host's nodes and blocks. ``pages`` is ``parsed``."""
    pages = pages.where("host is not null")
    every = pages.select("host", F.get("nodes", F.lit(0)).getField("size").alias("total"), F.explode("nodes").alias("n")).where("n.path <> 0")
    share = F.col("n.size") / F.greatest(F.col("total"), F.lit(1))
    nodes = staged(every.groupBy("host", "n.path", "n.above", "n.told").agg(F.count(F.lit(1)).alias("m"), F.sum(share).alias("share")), "html-nodes")
    blocks = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.lit(1).alias("kind"), b["f"].alias("f"), F.lit(1).alias("c"))))
    layouts = F.transform("layouts", lambda x: F.struct(x["path"].alias("path"), F.lit(0).alias("kind"), x["f"].alias("f"), x["c"].alias("c")))
    features = pages.select("host", F.explode(F.concat(blocks, layouts)).alias("x")).groupBy("host", "x.path", "x.kind", "x.f").agg(F.sum("x.c").alias("n"))
    features = staged(features, "html-features")
    own = importance(nodes, features, ["host"])
    merged = nodes.groupBy("path", "above").agg(F.sum("m").alias("m"))
    everywhere = importance(merged, features.groupBy("path", "kind", "f").agg(F.sum("n").alias("n")), [])
    everywhere = everywhere.select(F.col("path").alias("p_"), ((F.col("m") * F.col("t") + DOUBT) / (F.col("m") + DOUBT)).alias("usual"))
    judged = own.join(everywhere, F.col("path") == F.col("p_"))
    worth = (F.col("m") * F.col("t") + BORROWED * F.col("usual")) / (F.col("m") + BORROWED)
    spared = (F.col("told") >= NAMED) & (worth >= HIGH) & (F.col("m") >= SEEN) & (F.col("share") >= F.col("m") / 2)
    what = F.when(spared, SPARED).when(worth < LEAST, LEAST_NODE).when(worth < LOW, LOW_NODE)
    known = judged.select("host", "path", what.alias("what")).where("what is not null")
    sizes = nodes.select(F.col("host").alias("h_"), F.col("path").alias("p_"), "m")
    m, n = F.col("m").cast("double"), F.col("n").cast("double")
    # Only blocks of more than BLOCK_DOUBT / LEAST * (1 - LEAST) pages can be low.
    often = features.where((F.col("kind") == 1) & (F.col("n") > BLOCK_DOUBT * (1 - LEAST) / LEAST))
    often = often.join(sizes, (F.col("host") == F.col("h_")) & (F.col("path") == F.col("p_")))
    stale = often.where((m * (1 - F.log(n) / F.log(m)) + BLOCK_DOUBT) / (m + BLOCK_DOUBT) < LEAST)
    marks = known.select("host", F.struct("path", "what").alias("known"), F.lit(None).cast("struct<path:bigint,f:bigint>").alias("stale"))
    marks = marks.unionByName(stale.select("host", F.lit(None).cast("struct<path:bigint,what:int>").alias("known"), F.struct("path", "f").alias("stale")))
    return marks.groupBy(F.col("host").alias("h")).agg(F.collect_list("known").alias("known"), F.collect_list("stale").alias("stale"))


def main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html").withColumn("host", host())
    read = staged(parsed(pages), "html-parsed")
    low = staged(low_nodes(read), "html-low")
    slim = F.transform("nodes", lambda n: F.struct(*[n[c].alias(c) for c in ("path", "up", "told", "holds", "size")]))
    text = F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["text"].alias("text")))
    joined = read.select("page_id", "url", "host", slim.alias("nodes"), text.alias("blocks")).join(low, F.col("host") == F.col("h"), "left").drop("host", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, stale = None, {}, set()
        for batch in batches:
            texts = []
            for k, (nodes, blocks) in enumerate(zip(batch.column("nodes").to_pylist(), batch.column("blocks").to_pylist(), strict=True)):
                mine = (batch.column("known")[k], batch.column("stale")[k])
                if last is None or mine[0] != last[0] or mine[1] != last[1]:
                    last = mine
                    known = {x["path"]: x["what"] for x in mine[0].as_py() or ()}
                    stale = {(x["path"], x["f"]) for x in mine[1].as_py() or ()}
                shape = [(n["path"], n["up"], n["told"], n["holds"]) for n in nodes]
                kept = main_blocks(shape, [(b["node"], b["text"]) for b in blocks], [n["size"] for n in nodes], known, stale)
                texts.append("\n".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
