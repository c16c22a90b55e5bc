"""Leaf blocks of an HTML page: tag path, text and share of link text, in page order.

Paths are nodes with links to their parents, so a page costs time and memory in proportion to its length, also with
any number of elements that are never closed."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""", re.S)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "title", "noscript", "template", "textarea", "iframe", "svg", "select", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
BOILERPLATE = {"nav", "header", "footer", "aside", "form"}


class Node:
    """An open element below its parent: its name and the names in its class, id and role."""

    __slots__ = ("parent", "names", "depth", "last", "main")

    def __init__(self, parent: Node | None, names: tuple[str, ...]):
        self.parent, self.names = parent, names
        self.depth: int = parent.depth + 1 if parent else 0
        self.last: tuple[str, ...] = ((parent.last if parent else ()) + names)[-3:]
        #: None outside of article and main, 1 inside, 0 inside but below a region of boilerplate.
        self.main: int | None = parent.main if parent else None
        for name in names:
            if name in ("article", "main"):
                self.main = 1
            elif self.main and name in BOILERPLATE:
                self.main = 0


class Block(NamedTuple):
    node: Node | None
    text: str
    links: float  # share of the characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        """Names of the open elements, of their classes, ids and roles, the outermost first."""
        found, node = [], self.node
        while node:
            found += reversed(node.names)
            node = node.parent
        return tuple(reversed(found))


def names(tag: str, attributes: str) -> tuple[str, ...]:
    found = [tag]
    if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "=" in attributes):
        for m in NAMES.finditer(attributes):
            found += WORD.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(found)


def blocks(page: str) -> list[Block]:
    """White space in a text is one space; blocks without text are left out."""
    found: list[Block] = []
    stack: list[tuple[str, Node | None]] = []
    opened: Counter[str] = Counter()  # elements of the stack by name
    outer: list[int] = []  # places in the stack of elements that are not inline
    texts: list[str] = []
    linked, size = 0, 0

    def flush() -> None:
        nonlocal linked, size
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                found.append(Block(stack[-1][1] if stack else None, text, linked / max(size, 1)))
            texts.clear()
        linked = size = 0

    def add(text: str) -> None:
        nonlocal linked, size
        if text:
            texts.append(text)
            size += len(text)
            if opened["a"]:
                linked += len(text)

    def close(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop()[0]] -= 1
        while outer and outer[-1] >= depth:
            outer.pop()

    at = 0
    while m := TAG.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag not in INLINE:
            flush()
        if m[1]:
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            if tag not in INLINE and outer:  # a paragraph ends where a block begins, an item where the next begins
                last = stack[outer[-1]][0]
                if last == "p" or last == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    close(outer[-1])
            own, parent = names(tag, m[3]), stack[-1][1] if stack else None
            if tag not in INLINE:
                outer.append(len(stack))
            stack.append((tag, Node(parent, own) if tag not in INLINE or len(own) > 1 else parent))
            opened[tag] += 1
    add(page[at:])
    flush()
    return found
