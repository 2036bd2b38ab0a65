"""Wrappers of pages: union-free regular expressions over the token streams of a host's pages.

A page is a stream of tags and texts. A wrapper is the expression that all pages of a host match: elements in order, of
which each is there once, optionally, repeatedly or both, groups of elements that repeat together, and text slots. It grows
by aligning one page, or another wrapper, after the other. What is on one side only becomes optional; neighbours that look
alike, and runs of up to GROUP neighbours that do, become one repeated group; a slot whose text is the same on all pages is
part of the template, any other is data. Streams are aligned level by level: a start tag, what follows and its end tag are one
item, so that no group is ever cut through a tag. Tags that only mark up text belong to the text.

Wrappers are bounded: an element with more than WIDTH kinds of children in a row is held as its kinds in any number, kinds
beyond WIDTH and levels below DEPTH are not told apart, and beyond NODES the parts met on the fewest pages are cut off.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

GROUP, WIDTH, DEPTH, NODES = 4, 64, 40, 1000
SLOT = "#"

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: What ends an open paragraph, besides its end tag.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
_BARS, _P_BARS = ENDS_P | {"td", "li"}, frozenset("table td th button object article section div li".split())
#: An element, the open ones that its start tag ends, and the ones beyond which it looks for none.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOLD = ("class", "id", "role")


def attributes(source: str) -> dict[str, str]:
    """class, id and role of a start tag."""
    if "=" not in source:
        return {}
    return {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(source) if k.lower() in _TOLD}


def events(html: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """('<', tag, attributes), ('>', tag, None) and ('text', source, None) of a page, with the end tags that HTML lets out."""
    opened: list[str] = []
    count: Counter[str] = Counter()
    at = 0

    def end(name: str) -> Iterator[tuple[str, str, None]]:
        """Ends the innermost open element of a name with all that is open in it."""
        while True:
            last = opened.pop()
            count[last] -= 1
            yield ">", last, None
            if last == name:
                return

    def reach(names, stops) -> str | None:
        """The innermost open element of the names, where none of the stops is open within it."""
        for n in names:
            if count[n]:
                return next((o if o in names else None for o in reversed(opened) if o in names or o in stops), None)
        return None

    while m := _TOKEN.search(html, at):
        if m.start() > at:
            yield "text", html[at : m.start()], None
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            # An end tag of what only marks up text ends nothing around it.
            if opened and opened[-1] == name:
                count[name] -= 1
                yield ">", opened.pop(), None
            elif count[name] and reach((name,), _BARS if name in INLINE else ()):
                yield from end(name)
            continue
        if count["p"] and name in ENDS_P and reach(("p",), _P_BARS):
            yield from end("p")
        if name in ENDS:
            names, stops = ENDS[name]
            while found := reach(names, stops):
                yield from end(found)
        source = m[3] or m[6] or ""
        yield "<", name, attributes(source)
        if name in VOID:
            yield ">", name, None
            continue
        opened.append(name)
        count[name] += 1
        if name in RAW and not source.endswith("/"):
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            stop = close.start() if close else len(html)
            if stop > at:
                yield "text", html[at:stop], None
            at = stop
    if at < len(html):
        yield "text", html[at:], None
    while opened:
        yield ">", opened.pop(), None


def kind(name: str, told: dict[str, str]) -> str:
    """By what elements are told apart: tag, classes and id, with figures left out."""
    if not told:
        return name
    marks = [f".{c}" for c in sorted(told.get("class", "").split())]
    marks += [f"{mark}{told[name]}" for mark, name in (("$", "id"), ("@", "role")) if told.get(name)]
    return re.sub(r"\d+", "0", name + "".join(marks))[:80]


class Node:
    """An item of a wrapper. pages: how many have it; chars, linked: letters of its slots, and those in links; same: the hash of
    a slot's text where all pages agree, else None."""

    __slots__ = ("key", "least", "many", "pages", "chars", "linked", "same", "kids")

    def __init__(self, key: str, least: int = 1, many: bool = False, pages: int = 1, chars: int = 0, linked: int = 0, same: int | None = None, kids: list[Node] | None = None):
        self.key, self.least, self.many, self.pages, self.chars, self.linked, self.same, self.kids = key, least, many, pages, chars, linked, same, kids or []

    def packed(self) -> list:
        return [self.key, self.least, int(self.many), self.pages, self.chars, self.linked, self.same, [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(row: list) -> Node:
        return Node(*row[:2], bool(row[2]), *row[3:7], [Node.unpacked(k) for k in row[7]])

    def told(self) -> str:
        """As a regular expression over elements and slots."""
        inner = " ".join(k.told() for k in self.kids)
        body = f"({inner})" if self.key == "" else self.key + (f"({inner})" if inner else "")
        return body + ("*" if self.many and not self.least else "+" if self.many else "" if self.least else "?")


def write(node: Node) -> str:
    return json.dumps(node.packed(), separators=(",", ":"))


def read(text: str) -> Node:
    return Node.unpacked(json.loads(text))


def of_page(html: str, digest) -> Node:
    """The wrapper of one page. digest(text): a number by which texts are compared."""
    root = Node("")
    stack: list[Node | None] = [root]
    texts: list[list[str]] = [[]]
    links = depth = 0

    def slot() -> None:
        """Makes a slot of the text since the last element of this level."""
        text = " ".join("".join(texts[-1]).split())
        texts[-1] = []
        if text and stack[-1] is not None:
            own = stack[-1]
            own.kids.append(Node(SLOT, chars=len(text), linked=min(own.linked, len(text)), same=digest(text)))
            own.linked = 0

    for what, value, told in events(html):
        if what == "text":
            texts[-1].append(value)
            if links and stack[-1] is not None:
                stack[-1].linked += len(value.strip())
        elif value in INLINE:
            links += (what == "<") - (what == ">") if value == "a" else 0
            if value == "br":
                texts[-1].append(" ")
        elif what == "<":
            depth += 1
            if depth <= DEPTH:
                slot()
                node = Node(kind(value, told))
                stack[-1].kids.append(node)
                stack.append(node)
                texts.append([])
            else:
                texts[-1].append(" ")
        else:
            if depth <= DEPTH:
                slot()
                texts.pop()
                node = stack.pop()
                node.linked, node.kids = 0, fold(node.kids)
            depth -= 1
    slot()
    root.linked, root.kids = 0, fold(root.kids)
    return bounded(root)


def _keys(nodes: list[Node]) -> list[str]:
    return [n.key if n.key else "(" + " ".join(_keys(n.kids)) + ")" for n in nodes]


def _plain(node: Node) -> bool:
    """Whether it holds one slot and nothing else, as most repeated items do."""
    return len(node.kids) == 1 and node.kids[0].key == SLOT


def _again(a: Node, b: Node) -> Node:
    """Two neighbours that look alike, as one that repeats. They are of the same pages."""
    if a.many and _plain(a) and _plain(b):
        slot, more = a.kids[0], b.kids[0]
        slot.chars, slot.linked, slot.pages, slot.same = slot.chars + more.chars, slot.linked + more.linked, slot.pages + more.pages, slot.same if slot.same == more.same else None
        a.least, a.pages = max(a.least, b.least), max(a.pages, b.pages)
        return a
    pages = max(a.pages, b.pages)
    out = merged(a, b)
    out.least, out.many, out.pages, out.same = max(a.least, b.least), True, pages, None
    return out


def fold(nodes: list[Node]) -> list[Node]:
    """Neighbours that look alike, and runs of neighbours that do, as repeated items."""
    for size in range(1, GROUP + 1):
        if len(nodes) < 2 * size:
            break
        out: list[Node] = []
        keys: list[str] = []
        at, own = 0, _keys(nodes)
        while at < len(nodes):
            run = own[at : at + size]
            group = f"({' '.join(run)})"
            if size == 1 and keys and keys[-1] == run[0] and run[0] != SLOT:
                out[-1] = _again(out[-1], nodes[at])
                at += 1
            elif size > 1 and len(run) == size and keys and keys[-1] == group:
                out[-1] = _again(out[-1], Node("", kids=nodes[at : at + size], pages=max(n.pages for n in nodes[at : at + size])))
                at += size
            elif size > 1 and len(set(run)) > 1 and own[at + size : at + 2 * size] == run:
                out.append(Node("", kids=nodes[at : at + size], pages=max(n.pages for n in nodes[at : at + size])))
                keys.append(group)
                at += size
            else:
                out.append(nodes[at])
                keys.append(own[at])
                at += 1
        nodes = out
    return nodes


def _grouped(nodes: list[Node], others: list[Node]) -> list[Node]:
    """nodes, with runs that look like a group of others put into such a group."""
    wanted = {tuple(_keys(o.kids)) for o in others if o.key == ""}
    for keys in wanted:
        own, out, at = _keys(nodes), [], 0
        while at < len(nodes):
            if tuple(own[at : at + len(keys)]) == keys:
                out.append(Node("", kids=nodes[at : at + len(keys)], pages=max(n.pages for n in nodes[at : at + len(keys)])))
                at += len(keys)
            else:
                out.append(nodes[at])
                at += 1
        nodes = out
    return nodes


def _by_kind(nodes: list[Node]) -> list[Node]:
    """Items in no order: each kind optional and in any number; kinds beyond the WIDTH most frequent are one."""
    found: dict[str, Node] = {}
    for n in (k for node in nodes for k in (node.kids if node.key == "" else [node])):
        found[n.key] = _again(found[n.key], n) if n.key in found else n
    kept = sorted(found.values(), key=lambda n: (-n.pages, n.key))[:WIDTH]
    for n in kept:
        n.least, n.many = 0, True
    return sorted(kept, key=lambda n: n.key)


def aligned(xs: list[Node], ys: list[Node]) -> list[Node]:
    """Both lists as one that each of them matches: a longest common subsequence, and what is on one side only as optional."""
    if _keys(xs) != _keys(ys):
        xs, ys = _grouped(xs, ys), _grouped(ys, xs)
    a, b = _keys(xs), _keys(ys)
    if a == b:
        return [merged(x, y) for x, y in zip(xs, ys)]
    if max(len(a), len(b)) > 4 * WIDTH:
        return _by_kind(xs + ys)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(merged(xs[i], ys[j]))
            i, j = i + 1, j + 1
            continue
        if j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            node, i = xs[i], i + 1
        else:
            node, j = ys[j], j + 1
        node.least = 0
        out.append(node)
    out = fold(out)
    return out if len(out) <= WIDTH else _by_kind(out)


def merged(a: Node, b: Node) -> Node:
    """The wrapper that all pages of both match."""
    same = a.same if a.same == b.same else None
    return Node(a.key, min(a.least, b.least), a.many or b.many, a.pages + b.pages, a.chars + b.chars, a.linked + b.linked, same, aligned(a.kids, b.kids))


def bounded(root: Node) -> Node:
    """root without the parts that the fewest pages have, if it has more than NODES."""
    rows, todo = [], [root]
    while todo:
        node = todo.pop()
        rows.append(node)
        todo += node.kids
    if len(rows) > NODES:
        limit = sorted((n.pages for n in rows), reverse=True)[NODES // 2]
        for n in rows:
            n.kids = [k for k in n.kids if k.pages > limit]
    return root
