"""Leaf blocks of a page: its visible text between block-level tags, each with the open tags around it.

The reader is forgiving: tags may be left open, closed twice or cut off. It never fails and never drops visible text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements that begin and end a block. Fixed values of the HTML standard's rendering section, with title and option.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't shown.
HIDDEN_TAGS = ("script", "style", "noscript", "template", "iframe", "object", "svg")
#: Text of these is shown as it is, up to their end tag.
_RAW_TAGS = ("title", "textarea")
#: An open element of the first kind ends where one of the second begins.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_NAME = re.compile(r"[a-z]+")
_END = {name: re.compile(f"</{name}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I) for name in (*HIDDEN_TAGS, *_RAW_TAGS)}


class Node:
    """An open element with its names, "div.ad.box", below its parent. Blocks share their ancestors, so a page of very many
    open tags takes as many nodes and no more. near: the elements next above, itself first, NEAR at most; far: what any
    ancestor beyond them adds to `seen`, the names met on the way up."""

    __slots__ = ("element", "parent", "seen", "features")

    def __init__(self, element: str, parent: Node | None):
        self.element, self.parent, self.features = element, parent, None
        above = parent.seen if parent else frozenset()
        names = frozenset(element.split("."))
        # shared with the parent where nothing is new, which is so for all but a few distinct names
        self.seen = above if names <= above or len(above) >= MOST_NAMES else above | names

    def path(self) -> tuple[str, ...]:
        out, node = [], self
        while node:
            out.append(node.element)
            node = node.parent
        return tuple(reversed(out))


#: Names that are looked at on the way from a block up, at most: with more, a page's names say nothing any more.
MOST_NAMES = 64


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None  #: innermost open element
    linked: int  #: characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        return self.node.path() if self.node else ()


def blocks(page: str | None) -> list[Block]:
    out: list[Block] = []
    stack: list[Node] = []
    tags: list[str] = []
    open_tags: Counter[str] = Counter()
    words: list[str] = []
    linked = links = 0
    node: Node | None = None

    def flush():
        nonlocal linked
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                out.append(Block(text, node, linked))
            words.clear()
        linked = 0

    def shut_last() -> str:
        stack.pop()
        open_tags[name := tags.pop()] -= 1
        return name

    def shown(text: str):
        nonlocal linked
        if text:
            words.append(text)
            if links:
                linked += len(text)

    at, page = 0, page or ""
    while m := _TOKEN.search(page, at):
        shown(page[at : m.start()])
        at = m.end()
        name = m[1]
        if name is None:
            continue
        name = name.lower()
        closing = page.startswith("</", m.start())
        if not closing and name in _END:
            end = _END[name].search(page, at)
            stop = end.start() if end else len(page)
            if name in _RAW_TAGS:
                flush()
                inside, node = node, Node(name, node)
                shown(page[at:stop])
                flush()
                node = inside
            at = end.end() if end else len(page)
            continue
        if name == "a":
            links = 0 if closing else 1
        if name not in BLOCK_TAGS:
            if name in VOID_TAGS:
                words.append(" ")
            continue
        flush()
        if closing:
            if open_tags[name]:
                while shut_last() != name:
                    pass
        elif name not in VOID_TAGS:
            if open_tags["p"] and name not in ("button", "option"):  # a block ends an open paragraph
                while shut_last() != "p":
                    pass
            shut = _CLOSES.get(name)
            if shut and tags and tags[-1] in shut:
                shut_last()
            marks = [x for found in _MARKS.findall(m[2]) for x in _NAME.findall("".join(found).lower())] if m[2] and "=" in m[2] else []
            tags.append(name)
            open_tags[name] += 1
            stack.append(Node(".".join([name, *marks]), stack[-1] if stack else None))
        links = 0
        node = stack[-1] if stack else None
    shown(page[at:])
    flush()
    return out
