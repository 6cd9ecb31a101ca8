"""Pages as trees: block elements, their texts, folded shapes, and simple tree matching.

Elements that only style text are no nodes; text is collected in the block element
it stands in.  A shape is the tree with siblings folded: text blocks of one kind
under one parent are one slot, and so are containers of one kind from the eighth on.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple

# Elements whose content is no text of the page.
HIDDEN = "script style template noscript iframe object svg canvas select textarea title button audio video map datalist noembed noframes xmp".split()
# Elements that hold text of one block, and elements that hold blocks.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre caption figcaption summary address blockquote".split())
CONTAINERS = frozenset("html head body main article section div nav header footer aside form ul ol dl table thead tbody tfoot figure details fieldset center dialog menu search hgroup".split())
_BREAKS, _CELLS = frozenset(("br", "hr", "wbr")), frozenset(("td", "th"))
#: Elements that an element closes when it begins.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",)}
#: Elements that the search for what to close doesn't leave.
_WALLS = frozenset(("ul", "ol", "dl", "table", "article", "body", "main", "section", "div"))
DEEPEST, SAME = 150, 8

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*>?|"
    rf"<(?P<hidden>{'|'.join(HIDDEN)})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=hidden)\s*>|\Z)|"
    r"<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]{0,4000}\"|'[^']{0,4000}')*+)>|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

# Names of what is no article, told by role and by words of class and id.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OTHER = frozenset(
    "ad ads adbox adslot adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored promo promos promoted promotion nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside widget widgets "
    "footer foot masthead topbar cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond replies reply share sharing social "
    "related recommended recommendations pagination pager paging search searchbox toolbar skip copyright paywall dialog feedback poll form".split()
)
_UNLESS = frozenset(("has", "no", "with", "without"))
ELEMENTS_OFF = frozenset("head nav footer aside form dialog menu search fieldset".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "kind", "off", "children", "parent", "slot", "buf", "linked")

    def __init__(self, tag: str, kind: str, off: bool, parent: Node | None):
        self.tag, self.kind, self.off, self.parent = tag, kind, off, parent
        self.children: list[Node] = []
        self.buf: list[str] = []
        self.linked = 0


class Block(NamedTuple):
    node: Node
    text: str
    linked: int  # characters of it within links


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if attrs.strip(" /") else {}


@lru_cache(maxsize=20_000)
def _kind(tag: str, attrs: str) -> tuple[str, bool, bool]:
    """What an element is called in shapes, whether its name says that it is no article, and whether it is a header."""
    a = _attributes(attrs)
    names = re.sub(r"\d+", "", a.get("class", "") or a.get("id", "")).split()
    kind = ".".join([tag, *sorted(names)[:3]])[:80]
    off = tag in ELEMENTS_OFF or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").lower().replace(" ", "")
    if tag not in ("html", "body", "main") and not off:
        words = {w.lower() for w in _WORD.findall(f"{a.get('class', '')} {a.get('id', '')}")}
        off = not words & _UNLESS and bool(words & (OTHER if tag != "article" else {"comment", "comments", "reply", "ad", "advert", "sponsored", "related", "promo"}))
    return kind, off, tag == "header" or "header" in (f"{a.get('class', '')} {a.get('id', '')}").lower()


def parsed(page: str) -> tuple[Node, list[Block]]:
    """The tree of a page and its blocks with text, in page order."""
    root = node = Node("#", "#", False, None)
    depth, link, blocks = 0, 0, []

    def flush(n: Node) -> None:
        if n.buf:
            text = " ".join(html.unescape("".join(n.buf)).split())
            if text:
                blocks.append(Block(n, text, min(n.linked, len(text))))
            n.buf, n.linked = [], 0

    def say(raw: str) -> None:
        node.buf.append(raw)
        if link:
            node.linked += len(raw)

    def close(tags: tuple, walls: frozenset) -> None:
        nonlocal node, depth
        n, up = node, 0
        while n is not root and n.tag not in tags:
            if n.tag in walls:
                return
            n, up = n.parent, up + 1
        if n is root:
            return
        x = node
        while True:
            flush(x)
            depth -= 1
            if x is n:
                break
            x = x.parent
        node = n.parent

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        end = m["end"] or m["end2"]
        if tag == "a":
            link = 0 if end else 1
        elif tag in _BREAKS or tag in _CELLS:
            node.buf.append(" ")
        elif tag in TEXT_BLOCKS or tag in CONTAINERS:
            if end:
                close((tag,), frozenset())
                continue
            attrs = m["attrs"] or m["attrs2"] or ""
            if tag == "body":
                close(("head",), frozenset())
            if tag in _CLOSES:
                close(_CLOSES[tag], _WALLS)
            elif node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                close((node.tag,), frozenset())
            flush(node)
            if depth >= DEEPEST:  # deeper elements part blocks, but have no node of their own
                continue
            kind, off, header = _kind(tag, attrs)
            off = off or (header and tag not in ("html", "body", "main", "article") and not any(x.tag in ("article", "main") for x in _up(node)))
            new = Node(tag, kind, off, node)
            node.children.append(new)
            node, depth = new, depth + 1
    if at < len(page):
        say(page[at:])
    while node is not None:
        flush(node)
        node = node.parent
    return root, blocks


def _up(n: Node | None) -> list[Node]:
    out = []
    while n is not None:
        out.append(n)
        n = n.parent
    return out


class Shape(NamedTuple):
    """A folded tree in the order of its beginnings: kinds, parents, and which slots are no article by name."""

    kinds: tuple[str, ...]
    parents: tuple[int, ...]
    off: tuple[bool, ...]


def folded(root: Node) -> Shape:
    """The shape of a tree; each node's slot is set."""
    kinds, parents, off, inside = [root.kind], [-1], [False], [{}]
    root.slot = 0
    todo = [root]
    seen: list[dict] = [{}]
    # depth first, so slots come in page order; siblings that fold share a slot
    while todo:
        n = todo.pop()
        for c in n.children:
            count = seen[n.slot].setdefault((id(n), c.kind), 0)
            seen[n.slot][id(n), c.kind] = count + 1
            key = (c.kind, 0 if c.tag in TEXT_BLOCKS else min(count, SAME - 1))
            slot = inside[n.slot].get(key)
            if slot is None:
                slot = inside[n.slot][key] = len(kinds)
                kinds.append(c.kind)
                parents.append(n.slot)
                off.append(c.off)
                inside.append({})
                seen.append({})
            c.slot = slot
        todo.extend(reversed(n.children))
    return Shape(tuple(kinds), tuple(parents), tuple(off))


def _children(s: Shape) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in s.kinds]
    for i, p in enumerate(s.parents):
        if p >= 0:
            out[p].append(i)
    return out


#: Pairs of slots up to which trees are matched by the best order of children; beyond, children meet in the order of their kinds.
PAIRS = 250_000


def matched(a: Shape, b: Shape) -> tuple[int, list[int]]:
    """Simple tree matching: the most slots of a that can be laid on slots of b of one kind, parents on parents and in order, and for each slot of a its slot of b or -1."""
    ca, cb = _children(a), _children(b)
    out = [-1] * len(a.kinds)
    if len(a.kinds) * len(b.kinds) > PAIRS:
        todo, n = [(0, 0)], 0
        while todo:
            i, j = todo.pop()
            out[i], n = j, n + 1
            free: dict[str, list[int]] = {}
            for y in reversed(cb[j]):
                free.setdefault(b.kinds[y], []).append(y)
            todo += [(x, free[a.kinds[x]].pop()) for x in ca[i] if free.get(a.kinds[x])]
        return n, out
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def weigh(i: int, j: int) -> int:
        if (i, j) in memo:
            return memo[i, j][0]
        xs, ys = ca[i], cb[j]
        m = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        w = {}
        for p, x in enumerate(xs, 1):
            for q, y in enumerate(ys, 1):
                best = max(m[p - 1][q], m[p][q - 1])
                if a.kinds[x] == b.kinds[y]:
                    w[p, q] = weigh(x, y)
                    best = max(best, m[p - 1][q - 1] + w[p, q])
                m[p][q] = best
        pairs, p, q = [], len(xs), len(ys)
        while p and q:
            if (p, q) in w and m[p][q] == m[p - 1][q - 1] + w[p, q]:
                pairs.append((xs[p - 1], ys[q - 1]))
                p, q = p - 1, q - 1
            elif m[p][q] == m[p - 1][q]:
                p -= 1
            else:
                q -= 1
        memo[i, j] = (m[-1][-1] + 1, pairs)
        return memo[i, j][0]

    n = weigh(0, 0)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        todo += memo[i, j][1]
    return n, out
