"""Main text of web pages by scoring the containers of their tree.

What is never main text goes first: scripts, forms, menus, headers, footers and the like by their tags and roles,
adverts, notices, sidebars and reader comments by the words of their classes and ids. Every paragraph that is left
then passes points for its length and commas to its ancestors: all to the nearest container, half to the
next, and less further out, discounted by the share of the paragraph's text inside links. The container with most
points, again discounted by its links, is the best one; an article or main element around it takes its place. Its text
is kept whole, but for lists and boxes that are mostly links, with those siblings that score like it or
read like prose.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from turnloom.llm import html_tree
from turnloom.llm.rows import Carried

# Names that say what an element is.
DROPPED_TAGS = frozenset(
    "head script style noscript template nav footer aside form iframe object embed svg canvas audio video map select button "
    "textarea input label dialog menu search".split())
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist form".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion promoted "
    "breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager footer foot masthead topbar toolbar sidebar sidebars "
    "aside comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations teaser teasers outbrain taboola print skip copyright hidden".split())
HEADER_WORDS = frozenset({"header", "head", "heading"})
CONTENT_WORDS = frozenset("article articles body content entry post story text title".split())
NEGATED = frozenset({"has", "with", "no", "is", "without", "not"})
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MAIN = frozenset({"article", "main"})
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_LISTS = frozenset("ul ol dl table tr tbody section div".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre li dt dd td th caption figcaption summary legend address tr tbody thead tfoot ul ol dl".split())


def _names_boilerplate(element: html_tree.Element) -> bool:
    """Whether a class or id says that the element is no main text."""
    names = f"{element.attributes.get('class', '')} {element.attributes.get('id', '')}".split()
    for name in names:
        words = [w.lower() for w in _WORD.findall(name)]
        if not words or words[0] in NEGATED:
            continue
        if element.tag in _MAIN:  # an article may be a comment or an advert; other words only describe its parts
            if len(words) == 1 and words[0] in DROPPED_WORDS or words[0] in ("comment", "ad", "advert", "teaser", "promo"):
                return True
            continue
        if any(w in DROPPED_WORDS for w in words):
            return True
        if any(w in HEADER_WORDS for w in words) and not any(w in CONTENT_WORDS for w in words) and element.tag not in _HEADINGS:
            return True
    return False


def _dropped(page: html_tree.Page) -> list[bool]:
    elements = page.elements
    out = [False] * len(elements)
    inside_main = [False] * len(elements)
    holds_main = [0] * len(elements)  # 2: a main element inside, 1: an article that is no part of something else
    named = [False] * len(elements)
    for i, e in enumerate(elements):
        named[i] = bool(e.attributes) and e.tag not in ("html", "body") and _names_boilerplate(e)
    for i in range(len(elements) - 1, 0, -1):
        e = elements[i]
        # an article inside comments, or one that is itself named so, does not protect what is around it
        inside = 2 if e.tag == "main" else max(holds_main[i], e.tag == "article" and not named[i])
        if inside == 2 or not named[i]:
            holds_main[e.parent] = max(holds_main[e.parent], inside)
    for i, e in enumerate(elements[1:], 1):
        inside_main[i] = inside_main[e.parent] or elements[e.parent].tag in _MAIN
        if out[e.parent]:
            # of a header inside an article its headings stay
            out[i] = not (e.tag in _HEADINGS and elements[e.parent].tag == "header" and inside_main[e.parent])
            continue
        a = e.attributes
        if e.tag in DROPPED_TAGS or e.tag == "header":
            out[i] = True
        elif a and e.tag not in ("html", "body"):
            out[i] = (
                a.get("role", "").lower() in DROPPED_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true"
                or bool(_HIDDEN.search(a.get("style", ""))) or named[i] and not (e.tag not in _MAIN and _wraps(elements, i, holds_main)))
    return out


def _wraps(elements: list[html_tree.Element], i: int, holds_main: list[int]) -> bool:
    """Whether element ``i`` is a wrapper around the main text, whatever its name says, and no place for comments."""
    if holds_main[i] != 1:
        return holds_main[i] == 2
    words = {w.lower() for w in _WORD.findall(
        f"{elements[i].attributes.get('class', '')} {elements[i].attributes.get('id', '')}")}
    return not words & {"comment", "comments", "commentlist", "disqus", "related", "sidebar", "teaser", "teasers"}


def main_text(source: str | None) -> str:
    """The main text of one page, a block a line; empty if there is none."""
    if not source:
        return ""
    page = html_tree.read(source)
    elements = page.elements
    count = len(elements)
    dropped = _dropped(page)
    block_of = [0] * count  # nearest block element, for the text of inline ones
    linked = [False] * count
    for i, e in enumerate(elements):
        if i:
            block_of[i] = i if e.tag in html_tree.BLOCK else block_of[e.parent]
            linked[i] = linked[e.parent] or e.tag == "a" and "href" in e.attributes
    blocks: dict[int, list] = {}  # number: [element, pieces, characters, characters in links]
    for element, number, text in page.texts:
        if dropped[element]:
            continue
        block = blocks.setdefault(number, [block_of[element], [], 0, 0])
        block[1].append(text)
        size = len(text.strip())
        block[2] += size
        block[3] += size if linked[element] else 0
    found = []
    for number in sorted(blocks):
        element, pieces, size, in_links = blocks[number]
        text = " ".join("".join(pieces).split())
        if text:
            found.append((element, text, max(size, 1), in_links))
    if not found:
        return ""
    own = [0] * count
    own_links = [0] * count
    links = [0] * count
    score = [0.0] * count
    for i, e in enumerate(elements):
        links[i] += e.tag == "a" and not dropped[i]
    for element, text, size, in_links in found:
        own[element] += size
        own_links[element] += in_links
        points = (1.0 + text.count(",") + min(len(text) / 100.0, 3.0)) * min(1.0, len(text) / 25.0) * (1.0 - in_links / size)
        container = element
        if elements[element].tag in _PARAGRAPHS:
            while container > 0 and elements[container].tag in _PARAGRAPHS:
                container = elements[container].parent
        level = 0
        while container >= 0 and level < 6:
            score[container] += points if level == 0 else points / 2 if level == 1 else points / (level * 3)
            container, level = elements[container].parent, level + 1
    size, in_links = own[:], own_links[:]
    for i in range(count - 1, 0, -1):
        size[elements[i].parent] += size[i]
        in_links[elements[i].parent] += in_links[i]
        links[elements[i].parent] += links[i]
    density = [b / a if a else 0.0 for a, b in zip(size, in_links)]
    final = [s * (1.0 - d) for s, d in zip(score, density)]
    best = max(range(count), key=lambda i: (final[i], -i))
    at = best
    while at > 0:
        e = elements[at]
        if e.tag in _MAIN or e.attributes.get("role", "").lower() == "main" or e.attributes.get("itemprop", "").lower() == "articlebody":
            best = at
            break
        at = e.parent
    least = 0.2 * final[best]
    kept = [False] * count
    kept[best] = True
    parent = elements[best].parent
    if parent >= 0 and elements[best].tag not in ("body", "html", ""):
        siblings = [i for i in range(1, count) if elements[i].parent == parent and i != best and size[i] and not dropped[i]]
        for i in siblings:
            tag = elements[i].tag
            prose = tag in _PROSE and density[i] < 0.25 and (tag in _HEADINGS or size[i] > 80 or not links[i])
            kept[i] = final[i] > 0 and final[i] >= least and density[i] < 0.5 or prose
    menu = [False] * count
    for i, e in enumerate(elements):
        if i and i != best and e.tag in _LISTS and links[i] >= 2 and density[i] > 0.5:
            menu[i] = True
    for i in range(1, count):
        up = elements[i].parent
        kept[i] = (kept[i] or kept[up]) and not menu[i] and not (menu[up] and not kept[up])
    return "\n".join(text for element, text, _, _ in found if kept[element])


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", size: str = "n_chars") -> DataFrame:
    """``pages`` with the main text in ``out`` and its code points in ``size``, without ``html_col``.

    A null or empty page, or one without main text, has an empty text. Columns called ``out`` or ``size`` (in any
    case of letters) are replaced; all others pass through, whatever their names. Rows are neither joined nor split,
    and a task holds a hundred pages at a time.
    """
    own = Carried(pages, [html_col, out, size])
    packed = pages.select(own.packed(), F.col(f"`{html_col}`").cast("string").alias("html"))

    def read(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    done = packed.mapInArrow(read, StructType([packed.schema["row"], StructField("text", StringType())]))
    return done.select(
        *own.columns(), F.col("text").alias(out), F.length("text").cast("long").alias(size))
