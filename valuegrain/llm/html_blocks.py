"""A forgiving HTML reader: leaf blocks in page order, each with the names on its path.

Text inside one block-level element, not broken by another, is a block; inline elements and
``<br>`` do not break it.  Unclosed and misnested tags follow the usual rules (a new ``<p>`` ends
an open one, a stray end tag is ignored).  Head matter, scripts, styles and comments give nothing.

What is no text of the page ends at its own end tag: scripts, styles, frames and form fields hold no
tags, so theirs is the next one (of scripts and the like without one, all that follows is code, as in
browsers; a form field without one is ignored); drawings, templates and lists of choices may hold others
of their kind, and where they are never closed, only the start tag goes.  Formulas, objects and what is
shown without scripts are read like any other text.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import cache

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br img wbr svg math button input object noscript"
    " mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace mfenced semantics annotation".split()
)
#: Hold text that is none of the page's, and no tags; the first ones, where unclosed, up to the page's end.
RAW = frozenset("script style iframe title textarea".split())
TO_THE_END = frozenset("script style iframe".split())
#: Hold elements that are no text of the page.
SKIPPED = frozenset("svg template select head".split())
#: A start tag of the key ends an open element of the values.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""display\s*:\s*none|\shidden(?:[\s=>/]|$)|aria-hidden\s*=\s*["']?true""", re.I)
#: A tag: names, and values that may hold ``>`` within quotes.
_TAG = re.compile(r"""</?[a-zA-Z][^\s/>]*+(?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+>""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    link: int = 0  # characters inside <a>
    words: list[str] = field(default_factory=list)


def _names(tag: str, attrs: str, cache: dict) -> tuple[str, ...]:
    key = (tag, attrs)
    if (found := cache.get(key)) is None:
        names = [tag]
        for value in _ATTR.findall(attrs):
            names += ["." + w.lower() for w in _WORDS.findall(value)]
        if _HIDDEN.search(attrs):
            names.append(".hidden")
        found = tuple(dict.fromkeys(names))
        if len(cache) < 10_000:
            cache[key] = found
    return found


def _tag_end(page: str, start: int) -> int:
    """Index of the ``>`` that ends the tag at ``start``; those in quoted values do not count.

    A quote opens a value only after ``=``; one that is never closed opens none.
    """
    found = _TAG.match(page, start)
    return found.end() - 1 if found else page.find(">", start)


def _pairs(page: str, tag: str) -> dict[int, int]:
    """Where each element of a name that is closed starts and is over; an end tag closes the innermost."""
    opened: list[int] = []
    found: dict[int, int] = {}
    for x in _ends(tag).finditer(page):
        if x[1]:
            if opened:
                found[opened.pop()] = x.end()
        elif not x[0].endswith("/>"):
            opened.append(x.start())
    return found


@cache
def _ends(tag: str) -> re.Pattern:
    """Start and end tags of one name."""
    return re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I)


def read_blocks(page: str | None, memo: dict | None = None) -> list[Block]:
    page = page or ""
    memo = {} if memo is None else memo
    blocks: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    link = links = 0
    path: tuple[str, ...] = ()
    unclosed: set[str] = set()  # raw elements that no end tag follows
    pairs: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal parts, link
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, path, link))
            parts, link = [], 0

    def pop_to(depth: int) -> None:
        nonlocal links
        for name, _ in stack[depth:]:
            links -= name == "a"
        del stack[depth:]

    def say(text: str) -> None:
        nonlocal path, link
        if not parts:
            if text.isspace():
                return
            path = tuple(n for _, names in stack for n in names)
        parts.append(text)
        if links:
            link += len(text)

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        less = page.find("<", at)
        if less < 0:
            say(page[at:])
            break
        if less > at:
            say(page[at:less])
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = size if end < 0 else end + 3
            continue
        if page[less + 1 : less + 2] in ("!", "?"):
            end = page.find(">", less)
            at = size if end < 0 else end + 1
            continue
        name = _NAME.match(page, less + 1)
        end = _tag_end(page, less) if name and less < last else -1
        if not name or end < 0:
            say("<")  # a lone sign is text
            at = less + 1
            continue
        tag, closing = name[1].lower(), page[less + 1] == "/"
        at = end + 1
        if tag not in INLINE:
            flush()
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    pop_to(depth)
                    break
            continue
        if tag in RAW:
            close = None if tag in unclosed else next((x for x in _ends(tag).finditer(page, at) if x[1]), None)
            if not close:
                unclosed.add(tag)
            at = close.end() if close else size if tag in TO_THE_END else at
            continue
        if tag in SKIPPED:
            if tag not in pairs:
                pairs[tag] = _pairs(page, tag)
            at = max(at, pairs[tag].get(less, at))
            continue
        if tag == "br":
            say(" ")
        if tag in VOID:
            continue
        if tag not in INLINE:
            ends = ENDS.get(tag, ("p",))
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    pop_to(depth)
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "article", "section", "div", "body") and tag in ENDS:
                    break
        stack.append((tag, _names(tag, page[name.end() : end], memo)))
        links += tag == "a"
    flush()
    return blocks
