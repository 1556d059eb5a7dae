"""HTML pages as sequences of text blocks, each with its path of elements as a vector.

A block is the text between two borders of block elements. Pages are read as browsers read them where
it matters for text: raw elements, comments, implied ends of paragraphs and list items, attribute
values with and without quotes, unclosed elements. Reading takes time in proportion to a page.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple
from zlib import crc32

import numpy as np

#: Elements whose borders part blocks. Fixed values.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main menu nav noscript ol optgroup option p pre "
    "search section select summary table tbody td template tfoot th thead tr ul".split()
)
#: Elements without an end. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup and never a page's text.
RAW = frozenset("script style title textarea xmp iframe noembed noframes svg math".split())
#: What the start of an element ends, and within what it is looked for. Fixed values.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}),
}
KEEP_PARAGRAPH = frozenset("button label option optgroup select".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]+|=[^\s/>=]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]*))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAMING = frozenset("class id role itemprop itemtype aria-label data-role data-component name".split())

#: Widths of a path's parts: tags on it, names on it, the block's own element and the one around it.
TAGS, NAMES, OWN = 64, 192, 48
PATH = TAGS + NAMES + 2 * OWN

#: Vectors of paths that are kept for the next page; pages of a site have the same ones.
MOST_PATHS = 20_000


class Block(NamedTuple):
    """Text of a block, the row of its path in the page's reader, and what its letters are made of."""

    text: str
    path: int
    depth: int
    linked: int
    heading: bool


def _bit(token: str, width: int) -> int:
    return crc32(token.encode()) % width


def _names(attributes: list[tuple[str, str]]) -> list[str]:
    """What an element's attributes call it: their words, and how these begin and end."""
    words = []
    for key, value in attributes:
        if key in _NAMING:
            words += [w.lower() for w in _NAME.findall(value)]
        elif key == "hidden" or key == "style" and _HIDDEN.search(value):
            words.append("hidden")
    pieces = {p for w in words if len(w) > 1 for p in (w, f"{w[:3]}-", f"{w[:5]}-", f"-{w[-4:]}")}
    return sorted(pieces)


class Reader:
    """Reads pages; ``paths`` has a row of 0 and 1 for each path of elements met."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.paths = [np.zeros(PATH, np.float32)]
        self._known: dict[tuple[int, str, str], int] = {}
        self._row: dict[bytes, int] = {self.paths[0].tobytes(): 0}

    def _path(self, parent: int, tag: str, attributes: list[tuple[str, str]]) -> int:
        names = _names(attributes)
        key = (parent, tag, " ".join(names))
        if key not in self._known:
            row = self.paths[parent].copy()
            row[_bit(tag, TAGS)] = 1
            for name in names:
                row[TAGS + _bit(name, NAMES)] = row[TAGS + _bit(name + "#", NAMES)] = 1
            row[TAGS + NAMES + OWN :] = row[TAGS + NAMES : TAGS + NAMES + OWN]
            row[TAGS + NAMES : TAGS + NAMES + OWN] = 0
            row[TAGS + NAMES + _bit(tag, OWN)] = 1
            self._known[key] = self._row.setdefault(row.tobytes(), len(self.paths))  # deep nesting soon repeats rows
            if self._known[key] == len(self.paths):
                self.paths.append(row)
        return self._known[key]

    def read(self, html: str) -> tuple[list[Block], list[str]]:
        """The page's blocks in order, and each one's elements, as ``/tag/tag``."""
        if len(self._known) > MOST_PATHS:
            self.clear()
        stack: list[tuple[str, int]] = [("", 0)]
        open_now: Counter[str] = Counter()
        blocks: list[Block] = []
        inside: list[str] = []
        buffer: list[str] = []
        trail = [""]
        link = 0  # depth at which a link was opened
        linked = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                text = " ".join("".join(buffer).split())
                if text:
                    name, path = stack[-1]
                    blocks.append(Block(text, path, len(stack), min(linked, len(text)), name[:1] == "h" and name[1:].isdigit()))
                    inside.append(trail[-1])
                buffer.clear()
            linked = 0

        def pop() -> None:
            nonlocal link
            open_now[stack.pop()[0]] -= 1
            trail.pop()
            if link > len(stack):
                link = 0

        def end(names: set[str], limits: set[str]) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    while len(stack) > k:
                        pop()
                    return
                if stack[k][0] in limits:
                    return

        def say(text: str) -> None:
            nonlocal linked
            if text:
                text = unescape(text) if "&" in text else text
                buffer.append(text)
                linked += len(text.strip()) if link else 0

        at, size = 0, len(html)
        while at < size:
            lt = html.find("<", at)
            if lt < 0:
                say(html[at:])
                break
            say(html[at:lt])
            tag = _TAG.match(html, lt)
            if not tag:
                if html.startswith("<!--", lt):
                    close = html.find("-->", lt + 2 if html.startswith(("<!-->", "<!--->"), lt) else lt + 4)
                    at = close + 3 if close >= 0 else size
                elif html.startswith(("<!", "<?", "</"), lt):
                    close = html.find(">", lt)
                    at = close + 1 if close >= 0 else size
                else:
                    buffer.append("<")
                    at = lt + 1
                continue
            closing, name = tag[1], tag[2].lower()
            at = tag.end()
            attributes = []
            while at < size and html[at] != ">":
                attribute = _ATTRIBUTE.match(html, at)
                if not attribute:
                    at += 1  # blanks and slashes before the end
                    continue
                value = attribute[2] or ""
                if value[:1] in "\"'":
                    value = value[1:].removesuffix(value[:1])
                attributes.append((attribute[1].lower(), value))
                at = attribute.end()
            if at >= size:
                break  # a tag that never ends
            at += 1
            if name in RAW:
                if not closing:
                    over = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                    at = over.start() if over else size
                    if name != "svg" and name != "math":
                        flush()
            elif name == "a":
                link = 0 if closing else len(stack)
            elif name == "br":
                buffer.append(" ")
            elif name == "hr":
                flush()
            elif name in BLOCK and closing:
                flush()
                if open_now[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
            elif name in BLOCK:
                flush()
                if open_now["p"] and name not in KEEP_PARAGRAPH:
                    end({"p"}, {"button", "td", "th", "caption"})
                if name in ENDS:
                    end(*ENDS[name])
                if name in ("body", "html", "head") and open_now[name]:
                    continue
                stack.append((name, self._path(stack[-1][1], name, attributes)))
                open_now[name] += 1
                trail.append(f"{trail[-1]}/{name}" if len(trail) < 64 else trail[-1])
        flush()
        return blocks, inside
