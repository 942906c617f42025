"""Main text of web pages by wrapper induction.

Pages of one host are parsed into trees and aligned by simple tree matching.
Nodes whose text never changes are template; slots whose text varies may be
content. Roles told by tags and class names (menus, adverts, comments) are
never content, however much they vary.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.storage import stored, table

PAGES_PER_SLICE = 64  # pages that learn a wrapper together; larger hosts are cut into slices
MAX_DEPTH = 256  # of nested elements
EVIDENCE = 5  # different pages that must agree before a text counts as template

# Element names of HTML by their role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("nav footer aside form button select option fieldset menu dialog head audio video map datalist".split()) | _RAW
_OUTSIDE = frozenset(["header"])  # no content unless it stands in an article
_MAIN = frozenset(["article", "main"])
_PLAIN = frozenset("h2 h3 h4 h5 h6 p".split())  # in an article only a whole class name rules these out
_CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                   "th": {"td", "th"}, "option": {"option"}}
_HOLDS_LIST = frozenset("ul ol dl table tbody thead tfoot select".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar note toolbar".split())
# Words in class and id attributes that name something else than the article.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promoted promotion banner "
    "cookie cookies consent gdpr notice notices alert alerts sidebar sidebars aside menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments commentlist commenter reply replies respond discussion disqus "
    "share sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget widgets "
    "toolbar pagination pager login search form hidden".split())
_WORDS_OUTSIDE = frozenset(["header"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>|<[a-zA-Z][^>]*+>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME = re.compile(r"[A-Za-z][a-z]*|\d+")


@lru_cache(20_000)
def _role(tag: str, attrs: str) -> tuple[str, int, bool]:
    """Label of an element; 2 if it is never content, 1 if only inside an article, 0 otherwise; whether a part of a class name alone says so."""
    words, whole, label, bad = set(), set(), tag, 2 if tag in _NEVER else 1 if tag in _OUTSIDE else 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            label += ("." if name == "class" else "#") + re.sub(r"\d+", "", " ".join(sorted(value.split())))
            whole |= set(value.lower().split())
            words |= {x.lower() for x in _NAME.findall(value)} | whole
        elif name == "role" and value.lower() in _ROLES:
            bad = 2
        elif name == "role" and value.lower() == "main" and not bad:
            label = "main"
        elif (name == "hidden") or (name == "aria-hidden" and value.lower() == "true") or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            bad = 2
    part = False
    if tag not in ("html", "body") and tag not in _MAIN | {"h1"} and words & _WORDS:
        part = bad == 0 and not whole & _WORDS
        bad = 2
    elif tag in _MAIN and words & {"comment", "comments", "reply", "replies", "ad", "advert", "related", "sponsored", "promo"}:
        bad = 2
    elif not bad and words & _WORDS_OUTSIDE:
        bad = 1
    return label, bad, part


def _in_article(node: "Node") -> bool:
    while node is not None and not (node.tag in _MAIN or node.label == "main"):
        node = node.parent
    return node is not None


class Node:
    """An element. What is nested deeper than ``MAX_DEPTH`` hangs from the element at that depth, as in browsers."""

    __slots__ = ("depth", "tag", "label", "bad", "kind", "kids", "parent", "slot", "inline")

    def __init__(self, tag, label, bad, parent, inline=False):
        self.tag, self.label, self.bad, self.kids, self.parent, self.slot, self.inline = tag, label, bad, [], parent, None, inline
        self.depth = 0 if parent is None else parent.depth + 1
        self.kind = (label, bad)  # only nodes of one kind may share a slot: hidden and shown ones may have the same label
        if parent is not None:
            parent.kids.append(self)


def parse(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The tree of a page, and its blocks of text in page order, each with its node.

    Broken nesting is mended as browsers do in the simple cases: paragraphs
    end before blocks, list items and cells before their like, stray end tags
    are ignored. Inline elements are part of the block around them.
    """
    root = top = Node("", "", 0, None)
    blocks: list[tuple[Node, str]] = []
    buffer: list[str] = []

    def flush():
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((top, text))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            buffer.append(html.unescape(page[at:begin]) if "&" in page[at:begin] else page[at:begin])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:  # end tag
            node = top
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                flush()
                top = node.parent
            continue
        label, bad, part = _role(tag, m[3].strip())
        if part and tag in _PLAIN and _in_article(top):
            bad = 0
        if tag in _VOID:
            buffer.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            buffer.append(" ")
            continue
        if tag in _INLINE:
            if bad or top.inline:
                flush()
                deep = top.depth >= MAX_DEPTH
                top = Node(tag, label, max(bad, top.bad if top.inline or deep else 0), top.parent if deep else top, inline=True)
            continue
        flush()
        while top.inline:
            top = top.parent
        if tag == "body":
            while top.tag == "head":
                top = top.parent
        node = top
        shut = _CLOSED_BY_SAME.get(tag)
        while node is not root and node.tag not in _HOLDS_LIST and node.tag not in ("body", "article", "div", "section"):
            if node.tag == "p" or (shut and node.tag in shut):
                top = node.parent
                if not shut or node.tag == tag:
                    break
            node = node.parent
        top = Node(tag, label, max(bad, top.bad) if top.depth >= MAX_DEPTH else bad, top.parent if top.depth >= MAX_DEPTH else top)
    flush()
    return root, blocks


class Slot:
    """A node of the wrapper: what stands at one place of a host's pages."""

    __slots__ = ("label", "tag", "bad", "kind", "kids", "texts", "pages", "parent", "inside")

    def __init__(self, node: Node, parent: Slot | None):
        self.label, self.tag, self.bad, self.kind, self.kids, self.parent = node.label, node.tag, node.bad, node.kind, [], parent
        self.texts, self.pages = None, 0
        self.inside = node.tag in _MAIN or node.label == "main" or (parent is not None and parent.inside)

    def never(self) -> bool:
        return self.bad == 2 or (self.bad == 1 and not self.inside) or (self.parent is not None and self.parent.never())


def _runs(node: Node) -> list[list[Node]]:
    """Children with neighbours of the same kind taken together: a repeated field is one slot."""
    out: list[list[Node]] = []
    for kid in node.kids:
        if out and out[-1][0].kind == kid.kind:
            out[-1].append(kid)
        else:
            out.append([kid])
    return out


def _shape(nodes: list[Node]) -> tuple:
    """Kinds of a (repeated) node and what is below, and the nodes behind each, as a nested pair."""
    groups: list[list[Node]] = []
    for node in nodes:
        for run in _runs(node):
            if groups and groups[-1][0].kind == run[0].kind:
                groups[-1] = groups[-1] + run
            else:
                groups.append(run)
    kids = [_shape(g) for g in groups]
    return (nodes[0].kind, tuple(k[0] for k in kids)), (nodes, [k[1] for k in kids])


def matching(a: tuple, kids: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of ``a``'s children with wrapper slots: size, and the matched pairs of children."""
    rows, cols = len(a[1]), len(kids)
    best = [[0] * (cols + 1) for _ in range(rows + 1)]
    gain = [[0] * cols for _ in range(rows)]
    for x in range(rows):
        for y in range(cols):
            if a[1][x][0] == kids[y].kind:
                gain[x][y] = 1 + matching(a[1][x], kids[y].kids)[0]
            best[x + 1][y + 1] = max(best[x][y + 1], best[x + 1][y], best[x][y] + gain[x][y])
    pairs, x, y = [], rows, cols
    while x and y:
        if gain[x - 1][y - 1] and best[x][y] == best[x - 1][y - 1] + gain[x - 1][y - 1]:
            pairs.append((x - 1, y - 1))
            x, y = x - 1, y - 1
        elif best[x][y] == best[x - 1][y]:
            x -= 1
        else:
            y -= 1
    return best[rows][cols], pairs[::-1]


def _align(shape: tuple, nodes: tuple, slot: Slot, plan: list[Slot]) -> None:
    """Give each part of a page its slot, in a fixed order; parts without a partner become new slots."""
    plan.append(slot)
    _, pairs = matching(shape, slot.kids)
    partner = {x: slot.kids[y] for x, y in pairs}
    place = 0
    for x, kid in enumerate(shape[1]):
        if x in partner:
            place = slot.kids.index(partner[x]) + 1
        else:
            partner[x] = Slot(nodes[1][x][0][0], slot)
            slot.kids.insert(place, partner[x])
            place += 1
        _align(kid, nodes[1][x], partner[x], plan)


def _lay(nodes: tuple, plan: list[Slot], at: int = 0) -> int:
    for node in nodes[0]:
        node.slot = plan[at]
    at += 1
    for kid in nodes[1]:
        at = _lay(kid, plan, at)
    return at


def extract(pages: list[str | None]) -> list[str]:
    """The main text of each of some pages of one host."""
    root: Slot | None = None
    plans: dict[tuple, list[Slot]] = {}
    parsed, seen = [], set()
    for page in pages:
        tree, blocks = parse(page or "")
        shape, nodes = _shape([tree])
        if root is None:
            root = Slot(tree, None)
        if shape not in plans:
            plans[shape] = []
            _align(shape, nodes, root, plans[shape])
        _lay(nodes, plans[shape])
        parsed.append(blocks)
        by_slot: dict[Slot, list[str]] = {}
        for node, text in blocks:
            by_slot.setdefault(node.slot, []).append(text)
        key = hash(tuple(text for _, text in blocks))
        if key in seen:  # copies of a page say nothing about what is constant
            continue
        seen.add(key)
        for slot, texts in by_slot.items():
            slot.pages += 1
            if slot.texts is None:
                slot.texts = {tuple(texts)}
            elif len(slot.texts) < 2:
                slot.texts.add(tuple(texts))
    marked, usable = _content(root) if root is not None else (set(), set())
    out = []
    for blocks in parsed:  # pages of a host may differ in layout: each decides for itself whether it has a marked article
        article = [text for node, text in blocks if node.slot in marked]
        out.append("\n".join(article or [text for node, text in blocks if node.slot in usable]))
    return out


def _content(root: Slot) -> tuple[set[Slot], set[Slot]]:
    """The slots of a wrapper that lie in a marked article, and all that are neither template nor never content.

    The latter hold the content of pages without text in a marked article:
    nothing tells it from other text there.
    """
    def below(slot: Slot):
        yield slot
        for kid in slot.kids:
            yield from below(kid)

    def template(slot: Slot) -> bool:
        constant = slot.texts is not None and len(slot.texts) == 1 and slot.pages >= EVIDENCE
        plain = slot.label == slot.tag
        return constant and not (plain and slot.inside)  # plain parts of a marked article belong to it

    usable = {s for s in below(root) if not s.never() and not template(s)}
    return {s for s in usable if s.inside}, usable


def _slice(part: pa.Table) -> pa.Table:
    part = part.sort_by([("page_id", "ascending"), ("url", "ascending")])
    texts = extract(part["html"].to_pylist())
    return pa.table({"page_id": part["page_id"], "url": part["url"], "text": pa.array(texts, pa.string()),
                     "n_chars": pa.array([len(x) for x in texts], pa.int64())})


def main_text(pages: DataFrame, per_slice: int = PAGES_PER_SLICE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html).

    Blocks of the article in page order, each on a line, with character
    references decoded and white space made one space. Pages of a host are
    cut into slices of about ``per_slice`` by a hash of page_id; each slice
    learns its own wrapper, so no host is one task. A text is template only
    if ``EVIDENCE`` different pages agree; a page without company is judged
    by the roles of its tags alone. On a page without text in an element marked
    as the article, all text is kept that is neither template nor never content. Null or empty html gives an empty text;
    null urls form a host of their own; repeated rows are extracted alike.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    named = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"), host.alias("host"))
    # as a written table its size is known to the planner, which then need not move pages to join it
    counts = stored(named.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / per_slice).cast("bigint").alias("slices")), "hosts")
    cut = named.join(counts, "host").withColumn("slice", F.pmod(F.xxhash64("page_id"), F.col("slices"))).drop("slices")
    # a join by host may leave rows dealt out by host alone, which would do for the groups but not for a large host
    cut = cut.repartition("host", "slice")
    return cut.groupBy("host", "slice").applyInArrow(_slice, "page_id bigint, url string, text string, n_chars bigint")


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
