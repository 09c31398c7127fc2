"""A small tree of an HTML page: elements in page order and the pieces of text they hold."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Names of HTML elements by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = HEADINGS | frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead tr ul".split())
#: What a start tag closes if it is open, and the elements that hide it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"})}

MARK = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|/[^a-zA-Z>][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>)",
    re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)")
TOLD = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")


@dataclass
class Page:
    """Elements by number (0 is the page itself, a parent comes before its children) and pieces of text.

    ``last`` is the number after the last element inside; a piece is (element, block, text), where text of one block is
    not parted by the start or end of a block element.
    """

    tag: list[str] = field(default_factory=lambda: ["page"])
    parent: list[int] = field(default_factory=lambda: [-1])
    told: list[dict[str, str] | None] = field(default_factory=lambda: [None])
    last: list[int] = field(default_factory=lambda: [0])
    pieces: list[tuple[int, int, str]] = field(default_factory=list)


def attributes(text: str) -> dict[str, str] | None:
    """The attributes by name; None where none of those that matter is there."""
    if not text or not TOLD.search(text):
        return None
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        value = double or single or bare
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found


def parse(source: str) -> Page:
    """The tree of any text: whatever is not closed ends with what holds it, stray end tags are nothing.

    Linear in the text: an unpaired quote inside a tag makes tags end at their first ``>`` from there on.
    """
    page = Page()
    tag, parent, told, last, pieces = page.tag, page.parent, page.told, page.last, page.pieces
    open_now: list[int] = [0]
    opened: dict[str, int] = {}
    block, at, seek, strict, end = 0, 0, 0, True, len(source)

    def close(depth: int) -> None:
        for k in reversed(open_now[depth:]):
            last[k] = len(tag)
            opened[tag[k]] -= 1
        del open_now[depth:]

    def said(to: int) -> None:
        if at < to:
            text = source[at:to]
            pieces.append((open_now[-1], block, html.unescape(text) if "&" in text else text))

    while (k := source.find("<", seek)) >= 0:
        match = MARK.match(source, k) if strict else None
        if match is None:
            match = LOOSE.match(source, k)
            if match is not None and strict:
                strict = False
            elif match is None and not strict:
                match = MARK.match(source, k)
        if match is None:
            seek = k + 1
            continue
        said(k)
        at = seek = match.end()
        name = match.group(2)
        if name is None:
            continue
        name = name.lower()
        if name == "html" or name == "body" or name == "head":  # they tell nothing that the rest does not
            block += 1
        elif match.group(1):
            if name == "br":
                pieces.append((open_now[-1], block, " "))
            elif name in BLOCKS:
                block += 1
                if opened.get(name):
                    depth = len(open_now) - 1
                    while tag[open_now[depth]] != name:
                        depth -= 1
                    close(depth)
            elif opened.get(name):
                depth = len(open_now) - 1
                while tag[open_now[depth]] not in BLOCKS and depth and tag[open_now[depth]] != name:
                    depth -= 1
                if depth and tag[open_now[depth]] == name:
                    close(depth)
        else:
            if name in BLOCKS:
                block += 1
                depth = len(open_now) - 1
                while depth and tag[open_now[depth]] not in BLOCKS:
                    depth -= 1
                holder = tag[open_now[depth]]
                if depth and (holder == "p" or holder in HEADINGS and name in HEADINGS):
                    close(depth)
                if name in CLOSES:
                    ends, hides = CLOSES[name]
                    if any(opened.get(e) for e in ends):
                        depth = len(open_now) - 1
                        while depth and tag[open_now[depth]] not in hides and tag[open_now[depth]] not in ends:
                            depth -= 1
                        if tag[open_now[depth]] in ends:
                            close(depth)
            elif name == "a" and opened.get("a"):
                depth = len(open_now) - 1
                while depth and tag[open_now[depth]] not in BLOCKS and tag[open_now[depth]] != "a":
                    depth -= 1
                if tag[open_now[depth]] == "a":
                    close(depth)
            if name == "br":
                pieces.append((open_now[-1], block, " "))
            elif name in RAW:
                stop = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = seek = stop.end() if stop else end
            elif name not in VOID:
                parent.append(open_now[-1])
                told.append(attributes(match.group(3)))
                open_now.append(len(tag))
                tag.append(name)
                last.append(0)
                opened[name] = opened.get(name, 0) + 1
    said(end)
    close(1)
    last[0] = len(tag)
    return page
