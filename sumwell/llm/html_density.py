"""Main-text extraction by composite text density.

A page becomes a tree of its block elements.  For each node, C is the number
of characters below it, T the number of tags, LC and LT those inside links;
with C_b and LC_b of the whole body, its composite density is

    C/T * log(C/LC * T/LT) / log(ln(C/(C-LC) * LC + LC_b/C_b * C + e)),

zeros below a fraction line counting as 1.  The node whose children have the
largest sum of densities is main text; the least density on its path to the
body is the threshold for more.  Below each node that reaches it, or reaches
what the threshold's node would have at that node's size, the node with the
largest sum is accepted too.  The main text is the innermost node that holds
all of them, without parts that are mostly links and hold none.  Menus, forms,
footers and the like are cut from the tree by their tag or role before
densities are compared; they do count for the body's figures.  A class or id
that names an advert, a notice, comments and the like cuts its part only if
that is mostly links, or if the page has text without it: see _settle_names.
Character data of a node itself counts as a child, also for the threshold.
"""

from __future__ import annotations

import heapq
import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul "
    "head noscript template iframe object svg canvas button textarea title script style math video audio map".split()
)
_CUT_TAGS = frozenset("nav footer aside form head noscript template iframe object svg canvas button select textarea dialog menu title script style fieldset video audio map".split())
_RAW = frozenset("script style textarea title iframe noscript template svg".split())
_CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments disqus replies reply respond discussion widget toolbar pagination pager disclaimer copyright".split()
)
#: Words that may follow a name in a class or id without changing what it says.
_TRAILERS = frozenset(
    "box block wrap wrapper container area section inner outer list lists item items row col column left right top bottom content body text title header head panel bar unit slot link links button buttons icon icons group form field page view "
    "thread posts articles stories media topics".split()
)
#: A named part is cut if the text outside of named parts has at least this share of its own.
LEAST_OUTSIDE = 0.05
_NEVER_CUT = frozenset("html body article main".split())
#: A start tag closes an open element of these names: paragraphs end where blocks begin, items where items begin.
_P_ENDS = _BLOCKS - {"button", "caption", "option", "optgroup", "body", "html", "head", "tbody", "td", "tfoot", "th", "thead", "tr", "script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "map", "math", "audio", "video", "title", "textarea", "select"}
_SIBLING_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    """A block element: its children are nodes and pieces of character data, in page order."""

    __slots__ = ("children", "cut", "density", "density_sum", "links", "link_chars", "chars", "name", "named", "own", "own_density", "parent", "tags", "text")

    def __init__(self, name: str, parent: Node | None, cut: bool, named: bool = False):
        self.name, self.parent, self.cut, self.named, self.children, self.text = name, parent, cut, named, [], 0
        self.chars = self.link_chars = self.own = self.tags = self.links = 0
        self.density = self.density_sum = self.own_density = 0.0


def _names_a_cut(value: str) -> bool:
    """Whether a word of a class or id names a part to cut: its last part, but for trailers and numbers, is such a name."""
    for word in value.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(word) if not p.isdigit()]
        while len(parts) > 1 and parts[-1] in _TRAILERS and "".join(parts[-2:]) not in _CUT_NAMES:
            parts.pop()
        if parts and (parts[-1] in _CUT_NAMES or "".join(parts[-2:]) in _CUT_NAMES):
            return True
    return False


def _is_cut(name: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether tag, role or style cut an element, and whether its class or id names a part to cut."""
    if name in _NEVER_CUT:
        return False, False
    if name in _CUT_TAGS or name == "header" and not in_article:
        return True, False
    if not attrs or attrs.isspace():
        return False, False
    named = False
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True, False
        if key == "role" and value.lower() in _CUT_ROLES:
            return True, False
        named = named or key in ("class", "id") and _names_a_cut(value)
    return False, named


def parse(page: str) -> Node:
    """The block tree of a page.  Inline tags leave no node; links are counted; unclosed tags end with their parent."""
    root = Node("html", None, False)
    stack, link, at, end = [root], 0, 0, len(page)
    opened: Counter[str] = Counter()  # names on the stack, so that it is searched only for what is there

    def text(piece: str):
        if piece and not piece.isspace():
            top = stack[-1]
            top.children.append(piece)
            n = len(_SPACE.sub(" ", piece).strip())
            top.chars += n
            if link:
                top.link_chars += n
        elif piece:
            stack[-1].children.append(" ")

    def close_to(k: int):
        opened.subtract(n.name for n in stack[k:])
        del stack[k:]

    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            rest = page[at:]
            cut = rest.find("<")  # a tag that the end of the page breaks off
            text(_html.unescape(rest if cut < 0 or not re.match(r"</?[a-zA-Z!?]", rest[cut:]) else rest[:cut]))
            break
        if m.start() > at:
            text(_html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name == "a":
            link = 0 if closing else 1
            if not closing:
                stack[-1].links += 1
                stack[-1].tags += 1
        elif name == "br":
            stack[-1].children.append(" ")
        elif name in _BLOCKS:
            if closing:
                for k in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                    if stack[k].name == name:
                        close_to(k)
                        break
                continue
            if name == "html" or name == "body" and opened["body"] > 0:
                continue
            if name in _P_ENDS and opened["p"] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p":
                        close_to(k)
                        break
                    if stack[k].name in ("td", "th", "button", "object", "table"):
                        break
            if name in _SIBLING_ENDS and any(opened[x] > 0 for x in _SIBLING_ENDS[name][0]):
                ends, stops = _SIBLING_ENDS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ends:
                        close_to(k)
                        break
                    if stack[k].name in stops:
                        break
            if name == "body":  # an unclosed head ends here
                close_to(1)
            cut, named = _is_cut(name, m[3], opened["article"] + opened["main"] > 0)
            node = Node(name, stack[-1], stack[-1].cut or cut, named)
            stack[-1].children.append(node)
            if name in _RAW:
                raw = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = raw.end() if raw else end
            elif name != "hr" and not m[3].endswith("/"):
                stack.append(node)
                opened[name] += 1
    return root


def _settle_names(order: list[Node]) -> None:
    """Cut the named parts, but for those that hold so much of the page's text that they must be it.

    The text outside of all named parts, links aside, is compared with that
    of the largest.  Where it has less than LEAST_OUTSIDE of it, the name is
    passed over: its text counts as outside then, and named parts within it
    are judged like the others.
    """
    if not any(n.named for n in order):
        return
    for n in reversed(order):
        if not n.cut:
            n.text += n.chars - n.link_chars
            if n.parent is not None:
                n.parent.text += n.text

    def named_below(top: Node) -> list[Node]:
        found, walk = [], [top]
        while walk:
            for c in walk.pop().children:
                if isinstance(c, Node) and not c.cut:
                    (found if c.named else walk).append(c)
        return found

    root = order[0]
    parts = named_below(root)
    outside = root.text - sum(n.text for n in parts)
    heap = [(-n.text, k, n) for k, n in enumerate(parts)]
    heapq.heapify(heap)
    while heap and outside < LEAST_OUTSIDE * -heap[0][0]:
        n = heapq.heappop(heap)[2]
        n.named, below = False, named_below(n)
        outside += n.text - sum(c.text for c in below)
        for c in below:
            heapq.heappush(heap, (-c.text, len(parts), c))
            parts.append(c)
    for n in order:  # parents first
        n.cut = n.cut or n.named or n.parent is not None and n.parent.cut


def _score(root: Node) -> tuple[list[Node], float]:
    """Fill in counts and densities; the nodes that are not cut, parents first, and the body's share of link characters."""
    order = [root]
    for n in order:
        order += [c for c in n.children if isinstance(c, Node)]
    _settle_names(order)
    body_chars = sum(n.chars for n in order)
    body_links = sum(n.link_chars for n in order)
    ratio = body_links / max(1, body_chars)
    kept = [n for n in order if not n.cut]
    for n in reversed(kept):
        own = n.own = n.chars
        for c in n.children:
            if isinstance(c, Node) and not c.cut:
                n.chars += c.chars
                n.link_chars += c.link_chars
                n.tags += c.tags + 1
                n.links += c.links
                n.density_sum += c.density
        if n.chars:
            tags, lc, lt = max(1, n.tags), max(1, n.link_chars), max(1, n.links)
            base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + ratio * n.chars + math.e)
            n.density = n.chars / tags * max(0.0, math.log(n.chars / lc * tags / lt)) / max(0.05, math.log(base))
        if own:
            base = math.log(ratio * own + math.e)
            n.own_density = own * math.log(max(1, own)) / max(0.05, math.log(base))
            n.density_sum += n.own_density
    return kept, ratio


def _best(kept: list[Node]) -> dict[Node, Node]:
    """For each node, that with the largest density sum in its subtree (the outermost, first of equals)."""
    best: dict[Node, Node] = {}
    for n in reversed(kept):
        top = n
        for c in n.children:
            if isinstance(c, Node) and not c.cut and best[c].density_sum > top.density_sum:
                top = best[c]
        best[n] = top
    return best


def _bar(m: Node, chars: int, ratio: float) -> float:
    """The density of a node of this size with the characters per tag and the share of links of m."""
    tags = max(1, m.tags)
    k = chars / max(1, m.chars)
    lc, t, lt = max(1.0, k * m.link_chars), max(1.0, k * tags), max(1.0, k * m.links)
    base = math.log(m.chars / max(1, m.chars - m.link_chars) * k * m.link_chars + ratio * chars + math.e)
    return m.chars / tags * max(0.0, math.log(max(1, chars) / lc * t / lt)) / max(0.05, math.log(base))


def main_nodes(root: Node) -> tuple[Node, set[Node], set[Node]]:
    """The node that holds the main text, the accepted nodes in it, and the nodes that hold an accepted one or are it."""
    kept, ratio = _score(root)
    best = _best(kept)
    low = n = best[root]
    while n.parent is not None and n.name != "body":
        n = n.parent
        if n.density < low.density:
            low = n
    accepted, around = {best[root]}, Counter((best[root],))
    for n in kept:
        if n.density and n.density >= min(low.density, _bar(low, n.chars, ratio)):
            accepted.add(best[n])
            around[best[n]] = 1
        if n.own_density and n.own_density >= min(low.density, _bar(low, n.own, ratio)):
            around[n] = 1
    total = sum(around.values())
    for n in reversed(kept):
        if around[n] == total:
            return n, accepted, {x for x in around if around[x]}
        if around[n]:
            around[n.parent] += around[n]
    return root, accepted, {x for x in around if around[x]}


def blocks(node: Node, accepted: set[Node], around: set[Node]) -> Iterator[str]:
    """The texts of the blocks below a node, in page order; text around a child block is a block of its own."""
    held: list[str] = []
    walk = [(iter(node.children), node in accepted)]  # not recursive: pages nest as deep as they like
    while walk:
        children, inside = walk[-1]
        c = next(children, None)
        if isinstance(c, str):
            held.append(c)
            continue
        if c is not None and c.cut and c.name in ("script", "style", "template"):
            continue
        if held and (text := _SPACE.sub(" ", "".join(held)).strip("\x20\t\n\x0b\x0c\r")):
            yield text
        held = []
        if c is None:
            walk.pop()
        elif not c.cut and (inside or c in around or 2 * c.link_chars <= c.chars):
            walk.append((iter(c.children), inside or c in accepted))


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by newlines; empty if there is none."""
    if not page:
        return ""
    return "\n".join(blocks(*main_nodes(parse(page))))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    Null, empty and textless pages have an empty text.  Broken, truncated and
    very long pages are read whole.  Of equal densities the outermost node,
    then the first, is taken.  Repeated rows are treated one by one, an
    empty table gives an empty result, further columns are ignored.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
