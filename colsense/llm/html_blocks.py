"""HTML to a sequence of leaf blocks: texts with the path of tags above them.

A block is the text between two borders of block-level elements; inline tags
don't break it, ``br`` is white space in it.  Comments, scripts, styles, titles
and other content that is never shown are dropped.  Tags that HTML lets stay
open are closed as its rules say, and text may end anywhere.

A page is read once, forwards.  Quotes count only right after ``=`` in a tag; a
quoted value without an end is read as if unquoted, and if quotes swallow all
ends of tags up to the page's end, quotes count for nothing from there on.
Unseen content without an end tag loses only its tag, raw code also the text up
to the next tag; a comment without an end is one to the page's end, as in HTML.
So every character is looked at a bounded number of times, whatever the page
holds.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

_START = re.compile(r"[a-zA-Z][^\s/<>]*")
_TOKEN = re.compile(r"[=>]")
_VALUE = re.compile(r"\s*([\"']?)")
_PLAIN = re.compile(r"[^\s>]*")
_NAME = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[A-Za-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style title template noscript textarea iframe".split())
UNSEEN_INSIDE = frozenset("annotation annotation-xml desc metadata".split())  # in formulas and drawings
#: Unseen content whose end doesn't nest: the first end tag ends it.  Of these, code is never text.
_FLAT, _CODE = frozenset("script style title textarea iframe".split()), frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mfrac mi mn mo mover mrow mroot ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover object q rp rt ruby s samp semantics small span strike strong sub sup svg time tt u var wbr input".split())
#: Block-level elements; inside a drawing or formula any other element is inline, and these end it.
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes, if it is open inside the nearest of the second set.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_P_WITHIN = ("button", "td", "th", "table")
#: A path names at most so many elements, and so many of an element's names; what lies deeper has the path above it.
PATH_DEPTH, PATH_NAMES, NAME_LENGTH = 64, 16, 40


@dataclass(slots=True)
class Block:
    text: str
    path: str  # "/tag names/tag names ...", names of class, id and role
    linked: float  # share of characters inside links


def names_of(attributes: str) -> str:
    """Return the words of class, id and role, lower case, in order, once each, ``PATH_NAMES`` at most."""
    if "=" not in attributes:
        return ""
    found = dict.fromkeys(w.lower()[:NAME_LENGTH] for _, v in _NAME.findall(attributes) for w in _WORD.findall(v))
    return " ".join(list(found)[:PATH_NAMES])


class _Scanner:
    """Finds the tags of a page, reading forwards."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last_end, self.last_start = page.rfind(">"), page.rfind("<")
        self.none: set[str] = set()  # marks that don't come any more
        self.ends: dict[str, tuple[int, int]] = {}
        self.patterns: dict[str, re.Pattern] = {}

    def find(self, mark: str, at: int) -> int:
        """Return where ``mark`` is next, or -1."""
        if mark in self.none:
            return -1
        found = self.page.find(mark, at)
        if found < 0:
            self.none.add(mark)
        return found

    def end_of(self, at: int) -> int:
        """Return the place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        if at > self.last_end:
            return -1
        if not self.quotes:
            return self.page.find(">", at)
        place = at
        while m := _TOKEN.search(self.page, place):
            if m[0] == ">":
                return m.start()
            place = m.end()
            value = _VALUE.match(self.page, place)
            close = self.find(value[1], value.end()) if value[1] else -1
            place = close + 1 if close >= 0 else _PLAIN.match(self.page, value.end()).end()
        self.quotes = False
        return self.page.find(">", at)

    def closing(self, name: str, at: int) -> tuple[int, int] | None:
        """Return the span of the next end tag of ``name`` at or after ``at``."""
        start, end = self.ends.get(name, (-1, -1))
        if start < at:
            pattern = self.patterns.setdefault(name, re.compile(rf"</{re.escape(name)}(?![^\s/>])", re.I))
            if "</" + name in self.none:
                return None
            m = pattern.search(self.page, at)
            if not m:
                self.none.add("</" + name)
                return None
            close = self.find(">", m.end())
            start, end = self.ends[name] = (m.start(), close + 1 if close >= 0 else len(self.page))
        return start, end


def blocks(page: str | None) -> list[Block]:
    """Return the blocks of ``page`` that hold text, in order."""
    page = page or ""
    scan = _Scanner(page)
    out: list[Block] = []
    tags: list[str] = []
    paths: list[str] = [""]
    depths: dict[str, list[int]] = defaultdict(list)  # where each tag is open, the nearest last
    borders: list[int] = []  # where block-level tags are open
    pieces: list[str] = []
    where: str | None = None
    linked = total = 0

    def nearest(*names: str) -> int:
        return max((depths[n][-1] for n in names if depths.get(n)), default=-1)

    def text(piece: str) -> None:
        nonlocal where, linked, total
        if not piece:
            return
        pieces.append(piece)
        if not piece.isspace():
            if where is None:
                where = paths[-1]
            total += len(piece)
            if depths["a"]:
                linked += len(piece)

    def flush() -> None:
        nonlocal where, linked, total
        if where is not None:
            whole = " ".join(html.unescape("".join(pieces)).split())
            if whole:
                out.append(Block(whole, where, linked / total))
        pieces.clear()
        where, linked, total = None, 0, 0

    def pop(depth: int) -> None:
        while len(tags) > depth:
            depths[tags.pop()].pop()
            paths.pop()
        while borders and borders[-1] >= depth:
            borders.pop()

    def unseen(name: str, at: int) -> int:
        """Return where what follows the unseen element ``name`` begins, whose content begins at ``at``."""
        end = scan.closing(name, at)
        if end is None:
            if name not in _CODE:
                return at
            following = scan.find("<", at)
            return following if following >= 0 else len(page)
        if name in _FLAT:
            return end[1]
        open_here, place = 1, at  # count what nests up to each end
        again = nested.setdefault(name, re.compile(rf"<{re.escape(name)}(?![^\s/>])", re.I))
        while end is not None:
            open_here += len(again.findall(page, place, end[0])) - 1
            if not open_here:
                return end[1]
            place = end[1]
            end = scan.closing(name, place)
        unclosed.add(name)
        return at

    nested: dict[str, re.Pattern] = {}
    unclosed: set[str] = set()  # nesting names whose count never came out even: their tags alone go from then on

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            break
        first = page[start + 1 : start + 2]
        if first == "!" and page.startswith("<!--", start):
            text(page[at:start])
            end = scan.find("-->", start + 2)  # <!--> and <!---> end at once
            at = end + 3 if end >= 0 else n
            continue
        closes = first == "/"
        m = _START.match(page, start + 1 + closes)
        if not m:
            if first and first in "!?/":
                end = scan.find(">", start)
                text(page[at:start])
                at = end + 1 if end >= 0 else start + 2
            else:
                text(page[at : start + 1])
                at = start + 1
            continue
        end = scan.end_of(m.end())
        text(page[at:start])
        if end < 0:  # no tag ends any more; the last may be cut off
            if start == scan.last_start:
                at = n
                break
            text("<")
            at = start + 1
            continue
        name, attributes, at = m[0].lower(), page[m.end() : end], end + 1
        foreign = nearest("svg", "math")
        inline = name in INLINE or foreign >= 0 and name not in BLOCK
        if closes:
            depth = nearest(name)
            if not inline:
                flush()
                if depth >= 0:
                    pop(depth)
            elif depth > (borders[-1] if borders else -1):
                pop(depth)
            continue
        if name in UNSEEN or foreign >= 0 and name in UNSEEN_INSIDE:
            if name not in ("title", "textarea") and not inline:
                flush()
            if name not in unclosed and (not attributes.rstrip().endswith("/") or name in ("script", "style", "title")):
                at = unseen(name, at)
            continue
        if not inline:
            if foreign >= 0:
                pop(foreign)
            flush()
            depth = nearest("p")
            if depth > nearest(*_P_WITHIN):
                pop(depth)
            if name in _CLOSES:
                ends, within = _CLOSES[name]
                depth = nearest(*ends)
                if depth > nearest(*within):
                    pop(depth)
        if name == "br":
            text(" ")
        if name in VOID or foreign >= 0 and inline and attributes.endswith("/"):
            continue
        depths[name].append(len(tags))
        if not inline:
            borders.append(len(tags))
        tags.append(name)
        if len(tags) > PATH_DEPTH:
            paths.append(paths[-1])
        else:
            names = names_of(attributes)
            paths.append(f"{paths[-1]}/{name[:NAME_LENGTH]} {names}" if names else f"{paths[-1]}/{name[:NAME_LENGTH]}")
    text(page[at:])
    flush()
    return out
