"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of elements.  Each element has a hidden label, content or
not.  A node potential scores its features (tag, words in class, id and role,
amount of text in containers, share of text in links, what it holds); a parent-child potential
scores the pair of labels given the child's tag.  Sum-product message passing,
from the leaves up and from the root down, gives each element's exact marginal
in two sweeps; the text of elements whose marginal is over one half is the main
text.

The potentials are counted from labelled pages: a bounded sample of the table's
own pages that mark their article with exactly one ``article`` or ``main``
element (about ``SAMPLE`` pages, chosen by a hash of the id), and ``LABELLED``, a
few pages whose parts carry labels.  Counting runs in the tasks; the sums are
small, whatever the number of pages.

Text: character references are decoded, white space inside a block becomes one
blank, blocks are trimmed and joined by two line feeds.  Null html counts as
empty and gives an empty text.  Broken markup (missing end tags, cut-off pages)
is repaired as browsers do for heads, paragraphs, list items, cells and the like;
attributes are read as browsers read them, in one pass, so a long page of
unclosed quotes takes no longer than any other. A page is read whole, however
long. Names of classes and ids count as whole names and are one feature of an
element among others.
Repeated rows, null ids and extra columns are allowed; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices

SAMPLE = 400
SMOOTHING = 2.0
EDGE_SMOOTHING = 0.5
#: Weight of a labelled page of ``LABELLED`` against a sampled one.
LABELLED_WEIGHT = 20

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template".split())
SKIPPED = set("script style noscript iframe xmp noembed noframes template head title meta link svg canvas".split())
#: Any other start tag, and text, ends an open head.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("html body div section article main aside header footer nav form fieldset table td details".split())
#: A start tag ends these open elements, up to the nearest boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
ENDS_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "legend"}
P_BOUNDARY = {"td", "th", "table", "caption", "body", "html", "button", "object"}
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE_NAME = re.compile(r"[^\s/>=][^\s/>=]*|=[^\s/>=]*")
UNQUOTED = re.compile(r"[^\s>]*")
BLANK = re.compile(r"[\s/]*")
NAMING = ("class", "id", "role", "itemprop", "aria-label")
#: Parts of class names and ids.  A name counts where all its parts are of one list or neutral, and one is of the list.
HINTS = {
    "off": set(
        "nav navbar navigation menu footer header sidebar aside widget widgets banner cookie cookies notice notices consent promo promotion advert adverts advertisement "
        "sponsor sponsored ad ads comment comments reply replies disqus share sharing social related subscribe newsletter breadcrumb breadcrumbs login signup "
        "search searchform popup modal toolbar pagination pager copyright contentinfo complementary masthead".split()),
    "on": set("article articlebody content main post entry story text body".split()),
}
NEUTRAL = set("site page box bar block area wrap wrapper container inner outer section list links link items item top bottom left right primary secondary global form buttons button widget row col column panel module the".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def hint_of(names: list[str]) -> str:
    """``off``, ``on`` or ``other`` for the names (class, id, role) of an element, empty without any."""
    found = set()
    for name in names:
        parts = {x.lower() for x in NAME_PARTS.findall(name) if not x.isdigit()}
        for kind, listed in HINTS.items():
            if parts & listed and parts <= listed | NEUTRAL:
                found.add(kind)
    if found == {"off"} or found == {"on"}:
        return found.pop()
    return "other" if names else ""


class Scanner:
    """Start and end tags, comments and declarations of a page, in one pass over it."""

    def __init__(self, page: str):
        self.page = page
        self.closed = {'"': True, "'": True}  # whether such a quote may still come

    def tag(self, at: int) -> tuple[int, dict[str, str], bool]:
        """Attributes from behind a tag's name: (place behind the tag, attributes, whether it closes itself).

        An apostrophe or quote within a name or an unquoted value is a part of
        it.  A quoted value ends at the next such quote; where there is none in the
        whole rest, it ends before the next ``>``.  A tag that is cut off ends with the page."""
        page, size, found, slash = self.page, len(self.page), {}, False
        while True:
            m = BLANK.match(page, at)
            slash = m[0].endswith("/")
            at = m.end()
            if at >= size:
                return size, found, slash
            if page[at] == ">":
                return at + 1, found, slash
            m = ATTRIBUTE_NAME.match(page, at)
            name, at, value = m[0].lower(), m.end(), ""
            while at < size and page[at].isspace():
                at += 1
            if at < size and page[at] == "=":
                at += 1
                while at < size and page[at].isspace():
                    at += 1
                quote = page[at:at + 1]
                if quote in self.closed and quote:
                    end = page.find(quote, at + 1) if self.closed[quote] else -1
                    if end < 0:
                        self.closed[quote] = False
                        end = page.find(">", at)
                        value, at = page[at + 1:end] if end > 0 else "", end if end > 0 else size
                    else:
                        value, at = page[at + 1:end], end + 1
                else:
                    m = UNQUOTED.match(page, at)
                    value, at = m[0], m.end()
            found.setdefault(name, value)

    def next(self, at: int) -> tuple[int, int, str, bool, dict[str, str], bool] | None:
        """The next tag from ``at``: (its place, the place behind it, name, whether it is an end tag, attributes, closes itself); name empty for comments."""
        page = self.page
        while True:
            at = page.find("<", at)
            if at < 0:
                return None
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, len(page) if end < 0 else end + 3, "", False, {}, False
            if page[at + 1:at + 2] in ("!", "?"):
                end = page.find(">", at)
                return at, len(page) if end < 0 else end + 1, "", False, {}, False
            ends = page.startswith("/", at + 1)
            m = TAG_NAME.match(page, at + 1 + ends)
            if m:
                behind, found, slash = self.tag(m.end())
                return at, behind, m[0].lower(), ends, found, slash
            at += 1


class Node:
    __slots__ = ("tag", "hint", "parent", "children", "label")

    def __init__(self, tag: str, hint: str, parent: "Node | None"):
        self.tag, self.hint, self.parent = tag, hint, parent
        self.children: list[Node | str] = []
        self.label: int | None = None


def parse(page: str | None) -> Node:
    """Element tree of a page; text stays as it is in the source."""
    root = Node("html", "", None)
    open_ = [root]
    page = page or ""
    scanner = Scanner(page)
    count = Counter()  # of the open elements, by tag

    def cut(i: int) -> None:
        for n in open_[i:]:
            count[n.tag] -= 1
        del open_[i:]

    at = 0
    while at < len(page):
        m = scanner.next(at)
        text = page[at:m[0]] if m else page[at:]
        if text:
            if open_[-1].tag == "head" and text.strip():
                cut(len(open_) - 1)
            open_[-1].children.append(text)
        if not m:
            break
        _, at, tag, ends, attributes, slash = m
        if not tag:
            continue
        if ends:
            for i in range(len(open_) - 1, 0, -1) if count[tag] else ():
                if open_[i].tag == tag:
                    cut(i)
                    break
                if open_[i].tag in ("td", "th", "table", "article", "main", "body") and tag not in BLOCKS:
                    break
            continue
        if tag == "html" or tag == "body" and count[tag] or tag == "head" and len(open_) > 1:
            continue
        if open_[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(open_) - 1)
        if tag in ENDS_P and count["p"]:
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == "p":
                    cut(i)
                    break
                if open_[i].tag in P_BOUNDARY:
                    break
        if tag in CLOSES:
            ended, boundary = CLOSES[tag]
            last = None
            for i in range(len(open_) - 1, 0, -1) if any(count[x] for x in ended) else ():
                if open_[i].tag in boundary:
                    break
                if open_[i].tag in ended:
                    last = i
                    if tag in ("li", "dt", "dd", "option"):
                        break
            if last is not None:
                cut(last)
        node = Node(tag, hint_of([x for name in NAMING for x in attributes.get(name, "").split()]), open_[-1])
        if "data-label" in attributes:
            node.label = int(attributes["data-label"] == "1")
        open_[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag in ("textarea", "title"):
                node.children.append(page[at:stop])
            at = end.end() if end else len(page)
        elif tag not in VOID and not slash:
            open_.append(node)
            count[tag] += 1
    return root


def ordered(root: Node) -> list[Node]:
    """All elements, parents before children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def features(nodes: list[Node]) -> list[tuple]:
    """Of each element: tag, hint, size of text, share of it in links, and which parts it holds."""
    total = {id(n): [0, 0, False] for n in nodes}
    out: list[tuple] = [()] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        n = nodes[i]
        own = total[id(n)]
        own[0] += sum(len(c.strip()) for c in n.children if isinstance(c, str))
        if n.tag in SKIPPED:
            own[0] = own[1] = 0
        if n.tag == "a":
            own[1] = own[0]
        if n.parent is not None:
            up = total[id(n.parent)]
            up[0] += own[0]
            up[1] += own[1]
            up[2] |= own[2] or n.tag in ("article", "main", "nav", "footer", "aside")
        # a paragraph's or heading's own length says nothing; a container's does
        size = -1 if n.tag not in CONTAINERS else 0 if own[0] == 0 else min(6, int(math.log10(own[0]) * 2))
        linked = 0 if own[0] == 0 else min(3, int(4 * own[1] / own[0]))
        out[i] = (("hint", n.hint), ("size", size), ("linked", linked), ("holds", n.tag if own[2] and n.tag in ("html", "body", "div") else own[2]))
    return out


def edge_kind(node: Node) -> str:
    """Kind of the potential between a parent and this child."""
    if node.tag in BLOCKS:
        return "heading" if node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else node.tag
    return "skipped" if node.tag in SKIPPED else "control" if node.tag in ("button", "select", "input", "textarea", "label") else "inline"


def label(nodes: list[Node]) -> list[int] | None:
    """Labels from ``data-label`` marks, or from a single article element; ``None`` if the page has neither."""
    marked = any(n.label is not None for n in nodes)
    heads = [n for n in nodes if n.tag == "article"] or [n for n in nodes if n.tag == "main"]
    if not marked and len(heads) != 1:
        return None
    out: dict[int, int] = {}
    for n in nodes:
        up = out.get(id(n.parent), 0) if n.parent is not None else 0
        if marked:
            out[id(n)] = n.label if n.label is not None else up
        else:
            out[id(n)] = int(n is heads[0] or (up and n.tag not in SKIPPED and n.hint != "off" and edge_kind(n) not in ("nav", "footer", "aside", "form")))
    return [out[id(n)] for n in nodes]


def count_page(page: str | None, into: Counter, weight: int = 1) -> None:
    """Add a labelled page's features and label pairs to the counts."""
    nodes = ordered(parse(page))
    labels = label(nodes)
    if labels is None:
        return
    of = {id(n): x for n, x in zip(nodes, labels)}
    for node, x, own in zip(nodes, labels, features(nodes)):
        kind = edge_kind(node)
        into[f"label={x}"] += weight
        into[f"{kind}={x}"] += weight
        for name, value in own:
            into[f"{kind}:{name}={value}={x}"] += weight
        if node.parent is not None:
            into[f"edge={edge_kind(node)}={of[id(node.parent)]}{x}"] += weight


class Model:
    """Log potentials from counts."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.total = [counts.get(f"label={x}", 0) + 1.0 for x in (0, 1)]
        self.memo: dict = {}

    def node(self, kind: str, own: tuple) -> list[float]:
        """Log likelihood of the features under each label (independent given label and kind)."""
        if (kind, own) not in self.memo:
            total = [self.counts.get(f"{kind}={x}", 0) + 10 * SMOOTHING for x in (0, 1)]
            self.memo[kind, own] = [
                sum(math.log((self.counts.get(f"{kind}:{name}={value}={x}", 0) + SMOOTHING) / total[x]) for name, value in own) for x in (0, 1)]
        return self.memo[kind, own]

    def edge(self, kind: str) -> list[list[float]]:
        """Log probability of the child's label (column) given its parent's (row) and its kind."""
        if kind not in self.memo:
            n = np.array([[self.counts.get(f"edge={kind}={a}{b}", 0) + EDGE_SMOOTHING for b in (0, 1)] for a in (0, 1)])
            self.memo[kind] = np.log(n / n.sum(axis=1, keepdims=True)).tolist()
        return self.memo[kind]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for each element: messages up from the leaves, then down from the root."""
        place = {id(n): i for i, n in enumerate(nodes)}
        parent = [place[id(n.parent)] if n.parent is not None else -1 for n in nodes]
        kinds = [edge_kind(n) for n in nodes]
        edges = [self.edge(k) for k in kinds]
        belief = [list(self.node(k, own)) for k, own in zip(kinds, features(nodes))]
        up: list[list[float]] = [[0.0, 0.0]] * len(nodes)
        for i in range(len(nodes) - 1, 0, -1):
            b, e = belief[i], edges[i]
            up[i] = [_log_add(b[0] + e[a][0], b[1] + e[a][1]) for a in (0, 1)]
            belief[parent[i]] = [belief[parent[i]][a] + up[i][a] for a in (0, 1)]
        prior = math.log(self.total[1] / self.total[0])
        belief[0] = [belief[0][0], belief[0][1] + prior]
        for i in range(1, len(nodes)):
            whole, e = belief[parent[i]], edges[i]
            rest = [whole[a] - up[i][a] for a in (0, 1)]  # what the parent has from everywhere but this child
            belief[i] = [belief[i][b] + _log_add(rest[0] + e[0][b], rest[1] + e[1][b]) for b in (0, 1)]
            most = max(belief[i])
            belief[i] = [x - most for x in belief[i]]
        return [1.0 / (1.0 + math.exp(min(b[0] - b[1], 700.0))) for b in belief]


def _log_add(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def main_text(page: str | None, model: Model) -> str:
    """Main text of a page."""
    nodes = ordered(parse(page))
    on = {id(n): p > 0.5 for n, p in zip(nodes, model.marginals(nodes))}
    blocks: list[list[str]] = [[]]
    # each entry: an element to enter, a piece of text, or None for a block's edge
    stack: list = [nodes[0]]
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif x.tag not in SKIPPED:
            inner = [c for c in x.children if isinstance(c, Node) or on[id(x)]]
            stack += [None, *reversed(inner), None] if x.tag in BLOCKS else inner[::-1]
    texts = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def fit(pages: DataFrame, sample: int = SAMPLE) -> dict[str, int]:
    """Counts of the model from the sample of marked pages and from ``LABELLED``."""
    marked = pages.where(F.lower("html").rlike(r"<(article|main)\b"))
    n = marked.count()
    rare = F.pmod(F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), F.lit(1_000_000)) * F.lit(n) < sample * 1_000_000

    def count(batches):
        found: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                count_page(page, found)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["name", "n"])

    rows = map_arrow(marked.where(rare).select("html"), count, "name string, n bigint").groupBy("name").agg(F.sum("n").alias("n")).collect()  # tags and buckets
    counts = Counter({r["name"]: r["n"] for r in rows})
    for page in LABELLED:
        count_page(page, counts, LABELLED_WEIGHT)
    return dict(counts)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``."""
    counts = pages.sparkSession.sparkContext.broadcast(fit(pages, sample))  # tags and buckets
    d = pages.select("page_id", "url", "html")

    def run(batches):
        model = Model(counts.value)
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p, model) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(d, run, f"page_id {d.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


_LINE = "some plain words that make up a sentence of the text and go on for a while so that it is long enough. "
_LINKS = "<ul>" + "".join(f"<li><a href=/x{i}>word{i}</a></li>" for i in range(5)) + "</ul>"
#: Labelled pages: an element's mark holds for what is below it until the next mark.
LABELLED = [
    f"<html><head><title>t</title></head><body><header><h1>site</h1>{_LINKS}</header><div class=layout><main data-label=1><h1>head</h1><p>{_LINE * 3}</p><h2>part</h2><p>{_LINE}<a href=/y>link</a></p>"
    f"<ul><li>{_LINE}</li><li>one</li></ul><blockquote>{_LINE}</blockquote><pre>code</pre><table><tr><td>a</td><td>b</td></tr></table><div class=share data-label=0><a href=/s>share</a></div></main><aside class=sidebar>{_LINKS}<p>{_LINE}</p></aside></div>"
    f"<footer><p>small print of the site</p>{_LINKS}</footer></body></html>",
    f"<html><body><nav>{_LINKS}</nav><div class=cookie-notice><p>we use cookies {_LINE}</p><button>ok</button></div><article data-label=1><h1>head</h1><p>{_LINE * 2}<br>{_LINE}</p><p>{_LINE * 4}</p><p>short</p>"
    f"<section class=comments data-label=0><h2>comments</h2><div class=comment><p>{_LINE}</p></div><div class=comment><p>nice</p></div><form><textarea>x</textarea><button>send</button></form></section></article>"
    f"<div class=ad>{_LINE}</div><footer>end</footer></body></html>",
    f"<html><body><div id=menu>{_LINKS}</div><div id=wrap><div class=content data-label=1><h1>head</h1><p>{_LINE * 3}</p><p>{_LINE * 2}</p><div class=ad data-label=0>buy {_LINE}</div><p>{_LINE}</p></div><div class=comments><p>{_LINE}</p><p>{_LINE}</p></div></div>"
    f"<form class=search><label>find</label><select><option>a<option>b</select></form><div id=footer><p>small print</p></div></body></html>",
    f"<html><body><div class=header><a href=/>home</a></div><div><div><div data-label=1><h2>head</h2><p>{_LINE * 5}</p><p>{_LINE}</p><figure><figcaption>what it shows</figcaption></figure></div></div></div>"
    f"<div class=related>{_LINKS}</div><div class=newsletter><form><p>get it by mail</p></form></div></body></html>",
    f"<html><body><nav>{_LINKS}</nav><div class=notice>{_LINE}</div><main data-label=1><article><header><h1>head</h1></header><p>{_LINE}</p><p>so</p><p>short</p><p>{_LINE * 2}</p></article></main><aside>{_LINE}{_LINKS}</aside><section id=comments><div><p>{_LINE}</p></div><div><p>{_LINE}</p></div></section><footer>{_LINE}</footer></body></html>",
]
