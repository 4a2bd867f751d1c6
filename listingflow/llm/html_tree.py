"""A small reader of HTML as found on the web: tags that don't close, stray ends, scripts."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noembed xmp iframe noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
#: Elements without text of their own that don't part the words around them.
SILENT = frozenset("area button canvas embed iframe img input link meta noscript object param script select source style svg template textarea track".split())
#: Elements that a start tag of the given name closes, up to the nearest container.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
BLOCKS = frozenset(
    "address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)

DEPTH = 150

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """``("start", name, attributes)``, ("end", name, "") and ("text", "", decoded text).
    The text of scripts, styles and comments is left out."""
    place = 0
    while place < len(page):
        found = _TOKEN.search(page, place)
        if found is None:
            yield "text", "", html.unescape(page[place:])
            return
        if found.start() > place:
            yield "text", "", html.unescape(page[place : found.start()])
        place = found.end()
        if found.group(2) is None:
            continue
        name = found.group(2).lower()
        if found.group(1):
            yield "end", name, ""
            continue
        yield "start", name, found.group(3)
        if name in RAW and not found.group(3).endswith("/"):
            close = re.compile(rf"</{re.escape(name)}\s*/?>", re.I).search(page, place)
            yield "end", name, ""
            place = close.end() if close else len(page)


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    return out


class Node:
    """An element; ``items`` are elements and texts in page order."""

    __slots__ = ("name", "marks", "items")

    def __init__(self, name: str, marks: tuple[str, ...] = ()) -> None:
        self.name, self.marks, self.items = name, marks, []


def marks_of(text: str) -> tuple[str, ...]:
    """What names a part of the page: role, id and classes (digits as ``0``), hidden."""
    if not text or text.isspace():
        return ()
    got = attributes(text)
    out = [f"role={got['role'].strip().lower()}"] if got.get("role") else []
    for key in ("id", "class"):
        out += [re.sub(r"\d+", "0", x) for x in got.get(key, "").lower().split()]
    if "hidden" in got or re.search(r"display\s*:\s*none", got.get("style", ""), re.I):
        out.append("hidden")
    return tuple(out)


def tree(page: str) -> Node:
    """The page's elements. What is nested deeper than ``DEPTH`` is put at that depth."""
    root = Node("root")
    stack = [root]
    for kind, name, rest in events(page):
        if kind == "text":
            stack[min(len(stack) - 1, DEPTH)].items.append(rest)
        elif kind == "start":
            if name in BLOCKS and any(n.name == "p" for n in stack):
                # A block ends an open paragraph and what is open in it.
                depth = max(i for i, n in enumerate(stack) if n.name == "p")
                if all(n.name in INLINE or n.name == "p" for n in stack[depth:]):
                    del stack[depth:]
            if name in CLOSES:
                ends, walls = CLOSES[name]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name in walls:
                        break
                    if stack[i].name in ends:
                        del stack[i:]
            if name in ("html", "body") and any(n.name == name for n in stack):
                continue
            node = Node(name, marks_of(rest))
            stack[min(len(stack) - 1, DEPTH)].items.append(node)
            if name not in VOID and not rest.endswith("/"):
                stack.append(node)
        else:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in BLOCKS and name in INLINE:
                    break
    return root
