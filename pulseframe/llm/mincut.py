"""Main text of a page by minimum-cut labelling of its blocks.

A page is cut into blocks, the runs of text between block-level tags. A classifier gives each block a
log-odds of being content; its two costs become the capacities from the source and to the sink.
Blocks that follow each other and blocks close in the tree are joined by smoothness edges that fade
with their distance in the tree. The minimum cut separates content from the rest: it is the labelling
of least total cost. Blocks whose terminal outweighs all their edges are decided first and their
edges folded into their neighbours' terminals; what remains is solved by augmenting paths.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame

from pulseframe.llm.base import arrow_pass, bytes_of

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
EDGE = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: Elements whose content is not markup, or never text of the page.
OPAQUE = frozenset("script style title textarea template noscript iframe svg math object select xmp".split())
#: Those of them that reach to the end of the page where they are not closed.
GREEDY = frozenset("script style title textarea xmp".split())
END_OF = {name: re.compile(rf"</{name}(?:\s[^>]*)?/?>", re.I) for name in OPAQUE}
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul label caption".split()
)
VOID = frozenset(("hr",))
#: Elements that an opening tag ends, if one is the innermost open block.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"}, "option": {"option"}}
OUTSIDE = frozenset("nav footer aside form button option menu dialog search label fieldset".split())
CONTENT = frozenset(("article", "main"))
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation navi menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar sidenav rail widget widgets ad ads advert adverts advertisement advertising "
    "adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist reply replies respond disqus discussion pagination pager toolbar copyright disclaimer legal "
    "skip search tagcloud teaser teasers outbrain taboola".split()
)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
CONTENT_WORDS = frozenset("article articlebody content entry post story maintext bodytext".split())
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SMOOTH = 1.0
#: How fast edges fade with a step in the tree, the weight below which there is none, and the steps from which that is so.
FADE, FAINT = 0.35, 1e-3
FAR = 3 + int(math.log(SMOOTH / FAINT) / FADE)
#: Log-odds that decide a block alone, whatever its neighbours.
SURE = 12.0


class Element:
    """An open tag of the tree: its parent (None at the root), depth, name and mark."""

    __slots__ = ("parent", "depth", "tag", "state")

    def __init__(self, parent: Element | None = None, tag: str = "", state: int = 0):
        self.parent, self.tag, self.state = parent, tag, state
        self.depth = parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("text", "linked", "place")

    def __init__(self, text: str, linked: int, place: Element):
        self.text, self.linked, self.place = text, linked, place


def marked(tag: str, attributes: str, state: int) -> int:
    """1 inside content, -1 outside it, 0 unknown; what an element says of itself goes before its surroundings."""
    outside = tag in OUTSIDE or tag == "header" and state != 1
    inside = tag in CONTENT
    words: set[str] = set()
    if attributes:
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = next(filter(None, values), ""), name.lower()
            if name == "role":
                outside, inside = outside or value.lower() in OUTSIDE_ROLES, inside or value.lower() in CONTENT
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                outside = True
            elif name in ("class", "id") and tag not in ("html", "body"):
                words.update(w.lower() for w in NAME_PARTS.findall(value))
    if outside or words & OUTSIDE_WORDS and not words & CONTENT_WORDS and not inside or inside and words & {"comment", "comments", "reply", "teaser", "related"}:
        return -2 if tag in OUTSIDE or words & {"comment", "comments", "commentlist", "reply", "replies"} else min(state, -1)
    if inside:
        return state if state == -2 else 1
    return 1 if state == 0 and words & CONTENT_WORDS else state


def tag_end(page: str, start: int, final: int, stray: set[int]) -> int:
    """Where the ``>`` is that ends the tag whose attributes begin at ``start``; ``final`` is the page's last ``>``.

    A quoted value of any length is skipped whole. Where the quotes do not work out, the first ``>`` ends the
    tag. ``stray`` keeps the quotes from which no end was reached, so that all tags of a page are linear.
    """
    at, opened = start, []
    while at <= final:
        mark = EDGE.search(page, at).start()
        if page[mark] == ">":
            return mark
        if mark in stray:
            break
        opened.append(mark)
        close = page.find(page[mark], mark + 1)
        if close < 0:
            break
        at = close + 1
    stray.update(opened)
    return page.find(">", start)


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. Character references are decoded, white space is one space; unclosed tags end with their parents.

    A block knows its element and an element its parent, so a page takes memory and time in line with its length
    however deep its tags lie in each other.
    """
    found: list[Block] = []
    inner = Element()
    still_open: Counter[str] = Counter()
    buffer: list[str] = []
    unclosed: set[str] = set()
    linked = links = at = 0
    final, stray = page.rfind(">"), set()

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(buffer)).split()) if buffer else ""
        if text:
            found.append(Block(text, min(linked, len(text)), inner))
        buffer.clear()
        linked = 0

    def leave(element):
        still_open[element.tag] -= 1
        return element.parent

    while at < len(page):
        sign = page.find("<", at)
        if sign != at:
            piece = page[at : sign if sign >= 0 else len(page)]
            buffer.append(piece)
            linked += len(piece) if links else 0
            at += len(piece)
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            at = end + 1 if end >= 0 else len(page)
            continue
        tag = TAG.match(page, at) if at < final else None
        if not tag:
            buffer.append("<")
            at += 1
            continue
        end = tag_end(page, tag.end(), final, stray)
        closing, name, attributes = tag[1], tag[2].lower(), page[tag.end() : end]
        at = end + 1
        if name in OPAQUE:
            if not closing and not attributes.endswith("/"):
                end = None if name in unclosed else END_OF[name].search(page, at)
                if end:
                    at = end.end()
                elif name in GREEDY:
                    at = len(page)
                else:
                    unclosed.add(name)  # looked for once, so that many of them stay linear
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name == "br":
            buffer.append(" ")
        elif name in BLOCKS:
            flush()
            if closing:
                if still_open[name]:
                    while inner.tag != name:
                        inner = leave(inner)
                    inner = leave(inner)
            else:
                ended = ENDS.get(name, {"p"})
                while inner.tag in ended:
                    inner = leave(inner)
                if name not in VOID:
                    inner = Element(inner, name, marked(name, attributes, inner.state))
                    still_open[name] += 1
            links = 0
    flush()
    return found


def log_odds(block: Block) -> float:
    """The classifier: how much a block looks like the text of an article."""
    words, size = block.text.count(" ") + 1, len(block.text)
    stops = sum(map(block.text.count, ".,;:!?"))
    value = -1.0 + 0.08 * min(words, 40) + 0.4 * min(stops, 5) - 4.0 * block.linked / size
    tag = block.place.tag
    value += {"p": 0.8, "h1": 1.0, "blockquote": 0.8, "pre": 0.8, "li": -0.3, "td": -0.3, "th": -0.3}.get(tag, 0.5 if tag[:1] == "h" and tag[1:].isdigit() else 0.0)
    if "©" in block.text and words < 30:
        value -= 3.0
    return value + {1: 4.0, 0: 0.0}.get(block.place.state, -SURE - 4)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Between blocks in sequence, and from a block to the last one before it under the same parent."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            edges.append((i - 1, i, SMOOTH * closeness(blocks[i - 1].place, block.place)))
        parent = block.place.parent or block.place
        if parent in last and last[parent] < i - 1:
            j = last[parent]
            edges.append((j, i, 0.5 * SMOOTH * closeness(blocks[j].place, block.place)))
        last[parent] = i
    return [e for e in edges if e[2] > FAINT]


def closeness(a: Element, b: Element) -> float:
    """Fades with the steps from one element to the other; 0 where no edge is left, so that the walk is short."""
    steps = 0
    while a is not b:
        if steps == FAR:
            return 0.0
        a, b = (a.parent, b) if a.depth >= b.depth else (a, b.parent)
        steps += 1
    return math.exp(-FADE * max(0, steps - 2))


def minimum_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a node on the source side pays for odds below 0, on the sink side above 0, and every cut edge its weight.

    Of several minimum cuts, the one with the fewest nodes on the source side.
    """
    n = len(odds)
    terminal, around = list(odds), [dict() for _ in range(n)]
    for a, b, weight in edges:
        around[a][b] = around[a].get(b, 0.0) + weight
        around[b][a] = around[b].get(a, 0.0) + weight
    label: list[bool | None] = [None] * n
    waiting = deque(range(n))
    while waiting:  # a terminal that outweighs all edges decides its node in every minimum cut
        i = waiting.popleft()
        if label[i] is not None or abs(terminal[i]) <= sum(around[i].values()) and around[i]:
            continue
        label[i] = terminal[i] > 0
        for j, weight in around[i].items():
            terminal[j] += weight if label[i] else -weight
            del around[j][i]
            waiting.append(j)
        around[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = augment(rest, terminal, around)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def augment(nodes: list[int], terminal: list[float], around: list[dict[int, float]]) -> set[int]:
    """The source side after sending as much as possible from nodes with positive to nodes with negative terminals."""
    room = {i: dict(around[i]) for i in nodes}
    supply = {i: max(0.0, terminal[i]) for i in nodes}
    demand = {i: max(0.0, -terminal[i]) for i in nodes}
    tiny = 1e-9
    while True:
        came: dict[int, int | None] = {i: None for i in nodes if supply[i] > tiny}
        waiting, end = deque(came), None
        while waiting and end is None:
            i = waiting.popleft()
            if demand[i] > tiny:
                end = i
                break
            for j, free in room[i].items():
                if free > tiny and j not in came:
                    came[j] = i
                    waiting.append(j)
        if end is None:
            return set(came)
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        sent = min(supply[path[0]], demand[end], *(room[a][b] for a, b in zip(path, path[1:])), math.inf)
        supply[path[0]] -= sent
        demand[end] -= sent
        for a, b in zip(path, path[1:]):
            room[a][b] -= sent
            room[b][a] = room[b].get(a, 0.0) + sent


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    labels = minimum_cut([log_odds(b) for b in blocks], edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, labels) if keep)


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole page in column ``name``, replacing one of that name.

    Null and empty pages, and pages without content, have an empty text; repeated rows get equal texts.
    """
    plain = pages.drop(name)

    def run(batch: pa.RecordBatch):
        found = [main_text(page.decode("utf-8", "replace")) for page in bytes_of(batch.column(html))]
        return pa.record_batch([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, name])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in plain.dtypes)
    return arrow_pass(plain, run, f"{kinds}, `{name}` string", html)
