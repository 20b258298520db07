"""A tolerant reader of HTML pages: elements in page order and the text directly in them.

Start tags close what they imply (a paragraph ends at the next block, a list item at the next item), end tags
without a partner are passed over, an inline end tag never closes a block, and cells keep the tags inside them
from closing anything outside. Scripts, styles and the like are read as raw text and dropped. Nothing recurses,
and elements deeper than ``DEPTH`` become siblings, so any input takes time proportional to its length.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

DEPTH = 512

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td template tfoot th thead tr caption ul".split())
ENDS_PARAGRAPH = BLOCK - frozenset(
    "html body head dd dt li legend noscript optgroup option select tbody td template tfoot th thead tr caption".split()) | {"li", "dd", "dt"}
WALL = frozenset("html table td th caption template button object".split())
# a start tag closes the open elements named here, looking outwards until one of the walls
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)"""
    r"""|</(?:>|[^a-zA-Z>][^>]*+(?:>|\Z))"""
    r"""|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?P<close>>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")


@dataclass
class Element:
    tag: str
    parent: int
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Page:
    """``elements[0]`` is the root. Texts are ``(element, block, text)``: those of one block share its number."""

    elements: list[Element]
    texts: list[tuple[int, int, str]]


def read(source: str) -> Page:
    elements = [Element("", -1)]
    texts: list[tuple[int, int, str]] = []
    stack = [0]
    open_count: dict[str, int] = {}
    block = 0
    at = 0

    def pop_to(size: int) -> None:
        nonlocal block
        while len(stack) > size:
            tag = elements[stack.pop()].tag
            open_count[tag] -= 1
            block += tag in BLOCK

    def close(names, walls) -> None:
        """Close the outermost open element of ``names`` inside the walls."""
        if not any(open_count.get(n) for n in names):
            return
        found = 0
        for i in range(len(stack) - 1, 0, -1):
            tag = elements[stack[i]].tag
            if tag in walls:
                break
            if tag in names:
                found = i
        if found:
            pop_to(found)

    while True:
        token = _TOKEN.search(source, at)
        text = source[at:token.start()] if token else source[at:]
        if text:
            if open_count.get("head") and not text.isspace():
                close({"head"}, ())
            texts.append((stack[-1], block, html.unescape(text) if "&" in text else text))
        if not token:
            break
        at = token.end()
        tag = (token["start"] or token["end"] or "").lower()
        if token["end"]:
            if tag in ("p", "br", "hr"):
                block += 1
            if not open_count.get(tag):
                continue
            inline = tag not in BLOCK
            for i in range(len(stack) - 1, 0, -1):
                name = elements[stack[i]].tag
                if name == tag:
                    pop_to(i)
                    break
                if name in WALL and tag not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot") or inline and name in BLOCK:
                    break
        elif token["start"]:
            if not token["close"]:
                break  # the page ends inside a tag
            if tag in ("html", "body", "head") and open_count.get(tag):
                continue
            if tag in ENDS_PARAGRAPH:
                close({"p"}, WALL)
            if tag == "body" or tag not in _IN_HEAD:
                close({"head"}, ())
            if tag in CLOSES:
                close(*CLOSES[tag])
            block += tag in BLOCK
            if tag in VOID:
                if tag == "br":
                    texts.append((stack[-1], block, "\n"))
                continue
            rest = token["rest"]
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if len(stack) >= DEPTH:
                pop_to(len(stack) - 1)
            attributes = {}
            if rest and not rest.isspace():
                for name, a, b, c in _ATTRIBUTE.findall(rest):
                    attributes.setdefault(name.lower(), html.unescape(a or b or c))
            elements.append(Element(tag, stack[-1], attributes))
            stack.append(len(elements) - 1)
            open_count[tag] = open_count.get(tag, 0) + 1
    return Page(elements, texts)


_IN_HEAD = frozenset("head base link meta title script style noscript template html".split())
