"""Leaf blocks of an HTML page, read with one pass of a tolerant scanner.

A block is a run of text between boundaries of block-level elements. Inline tags are dropped, ``br`` is white space,
and scripts, styles, templates, drawings and comments have no text; a drawing that is never closed hides only its start tag. A
closing tag closes up to its element if that is open; a new paragraph, list item or cell closes an open one of its kind.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)(?:>|\Z)|<(?:![^>]*+|\?[^>]*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")
RAW = frozenset(("script", "style", "template", "textarea", "svg", "iframe"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
BLOCKS = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript object ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul video audio".split()
)
#: A start tag of the key closes open elements of the values, up to the element that holds them.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "body": {"html"}}
_NO_P = BLOCKS - {"body", "html", "head", "label", "button", "option"}


class Element:
    """An open block element: its tag, the words of its class, id and role, and the element around it."""

    __slots__ = ("above", "depth", "notes", "tag", "words")

    def __init__(self, tag: str, words: tuple[str, ...], above: Element | None):
        self.tag, self.words, self.above = tag, words, above
        self.depth = above.depth + 1 if above else 1
        self.notes = None  # what a reader of blocks has found out about the element


@dataclass
class Block:
    text: str
    inside: Element | None  # the innermost open block element
    linked: int  # characters inside links
    start: int  # where in the page its text begins


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    path: list[Element] = []
    is_open: Counter[str] = Counter()
    text: list[str] = []
    linked = at = start = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, path[-1] if path else None, linked, start))
            text.clear()
        linked = 0

    def add(part: str, where: int) -> None:
        nonlocal linked, start
        if not text:
            start = where
        text.append(part)
        if in_link:
            linked += len(part)

    def close(i: int) -> None:
        is_open.subtract(e.tag for e in path[i:])
        del path[i:]

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            add(page[at:], at)
            break
        if m.start() > at:
            add(page[at : m.start()], at)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if tag in RAW:
            if not closing and not (m[3] or m[6] or "").endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else at if tag == "svg" else len(page)
            continue
        if tag == "a":
            in_link = not closing
        elif tag == "br":
            add(" ", at)
        elif tag in BLOCKS:
            flush()
            if tag in VOID:
                continue
            if closing:
                in_link = False
                if is_open[tag]:
                    close(next(i for i in range(len(path) - 1, -1, -1) if path[i].tag == tag))
            else:
                if tag in _NO_P and path and path[-1].tag == "p":
                    close(len(path) - 1)
                if any(is_open[t] for t in CLOSES.get(tag, ())):
                    for i in range(len(path) - 1, -1, -1):
                        if path[i].tag in _HOLDS[tag]:
                            break
                        if path[i].tag in CLOSES[tag]:
                            close(i)
                            break
                named = " ".join(x or y or z for x, y, z in _NAMED.findall(m[3] or m[6] or ""))
                path.append(Element(tag, tuple(w for w in _SPLIT.split(named.lower()) if w), path[-1] if path else None))
                is_open[tag] += 1
    flush()
    return out
