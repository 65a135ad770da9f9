"""Main text of a page by line-block distribution.

Markup is stripped so that every block of the page becomes a line. Elements that never hold the article (scripts,
styles, menus, page headers and footers, sidebars, forms, notices, adverts, reader comments; by element name, role or the
words of class and id) and lines made mostly of links count as lines of length zero. The lengths are then summed over
sliding windows of ``WINDOW`` lines. A span of text surges where a window sum rises from zero and dives where the sum
falls back to zero; a line of zero length inside a span is left out, so text that an advert interrupts stays one span.
The spans count whose longest window reaches ``SURGE`` characters, or the longest span where none does, and with them
spans between two of them and later ones that end a sentence. ``article`` and ``main`` are a hint: where the longest span
lies in a marked article, its spans are taken whatever their length, and the others left. Where a longer one that
surges lies outside, the hint is void and all spans of the page count alike.

Each page is handled by itself, whole, in one pass over its tags. Nulls and pages without text give the empty text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipgrid.llm.common import small_slices

#: Lines per window, and characters in a window from which an unmarked span counts as article.
WINDOW, SURGE = 3, 86
#: Share of a line's characters inside links from which it counts as a menu.
LINKED = 0.6
#: Open elements that a tag can end; deeper ones stay open, so that a page of unclosed tags takes linear time.
DEPTH = 512

_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_NEVER = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "select", "option", "object", "svg", "math", "canvas", "audio", "video", "map"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label",
    "mark", "meter", "picture", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Words that name what is not the article, and words that only say which part or place of it; a class or id of such words alone is noise.
_NOISE = set(
    "ad ads advert adverts advertisement advertisements adbox banner sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " comment comments commentlist disqus respond replies cookie cookies consent notice notices notification alert newsletter subscribe signup popup modal"
    " share sharing social related recommended footer masthead pagination pager widget".split()
)
_PARTS = set(
    "site page main global top bottom left right primary secondary inner outer header footer area bar box block list item items link links section"
    " wrapper wrap container slot unit zone row col group form button buttons icon icons media post posts article articles stories entry user reader text bar".split()
)
_WHOLE = {"side-bar", "site-header", "page-header", "skip-link"}
_WORD = re.compile(r"[a-z]+")
_STOPS, _QUOTES = (".", "!", "?", "…", "。"), " \"')]»”’"
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*(?:>|$)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s\"'>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
_BARE_END = re.compile(r"=\s*[^\s\"'>]*/$")
#: Elements whose start ends an open element of these names, up to the nearest of those.
_P_ENDS = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu"
    " nav ol p pre search section summary table ul li dt dd".split()
)
_CELLS = {"table", "td", "th", "caption"}
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"} | _CELLS),
    "dt": ({"dt", "dd"}, {"dl"} | _CELLS),
    "dd": ({"dt", "dd"}, {"dl"} | _CELLS),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
_SPACE = re.compile(r"\s+")
_ENDS = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _RAW}


def _names_noise(token: str) -> bool:
    """Whether a class or id is made of noise words and words of place only: ``site-footer``, but not ``has-sidebar``."""
    token = token.lower()
    words = _WORD.findall(token)
    return token in _WHOLE or any(w in _NOISE for w in words) and all(w in _NOISE or w in _PARTS for w in words)


def _is_noise(name: str, attributes: str, inside: bool) -> bool:
    if name in _NEVER or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        if key in ("class", "id") and any(map(_names_noise, value.split())):
            return True
        if key == "role" and value.lower() in _ROLES or key == "itemprop" and value == "comment":
            return True
    return False


class _Element:
    __slots__ = ("name", "parent", "noise", "articles")

    def __init__(self, name: str, parent: _Element | None, noise: bool) -> None:
        self.name, self.parent, self.noise = name, parent, noise
        self.articles = (parent.articles if parent else 0) + (name in ("article", "main"))


def _open(stack: list[_Element], name: str) -> None:
    """Ends the open elements that the start of ``name`` implies to be over."""
    ends, border = _IMPLIED.get(name, (set(), set()))
    for at in range(len(stack) - 1, max(0, len(stack) - DEPTH), -1):
        if stack[at].name in border:
            break
        if stack[at].name in ends:
            del stack[at:]
            break
    if name in _P_ENDS:
        _close(stack, "p")
        for at in range(len(stack) - 1, max(0, len(stack) - DEPTH), -1):  # a block of HTML breaks out of a drawing
            if stack[at].name == "foreignobject":
                break
            if stack[at].name in ("svg", "math"):
                del stack[at:]
                break


def _close(stack: list[_Element], name: str) -> None:
    """Ends the nearest open ``name`` and what is open in it; an end tag without one, or across a table cell, counts for nothing."""
    for at in range(len(stack) - 1, max(0, len(stack) - DEPTH), -1):
        here = stack[at].name
        if here == name:
            del stack[at:]
            return
        if name in _INLINE and here not in _INLINE or here in _CELLS and name not in ("table", "tr", "tbody", "thead", "tfoot"):
            return


def _parse(page: str) -> tuple[list[list[tuple[str, bool, _Element]]], list[_Element]]:
    """The blocks of a page, as pieces of text (whether in a link, element), and all elements, parents first."""
    root = _Element("", None, False)
    stack, elements, blocks = [root], [root], [[]]
    links, at = False, 0
    while True:
        match = _TAG.search(page, at)
        piece = page[at : match.start()] if match else page[at:]
        if piece:
            blocks[-1].append((piece, links, stack[-1]))
        if not match:
            return blocks, elements
        at = match.end()
        closing, name, attributes = match.group(1), match.group(2), match.group(3)
        if name is None:
            continue
        name = name.lower()
        if not closing and name in _RAW:
            end = _ENDS[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name not in _INLINE and blocks[-1]:
            blocks.append([])
        empty = not closing and attributes.endswith("/") and not _BARE_END.search(attributes)
        if name == "a":
            links = not closing and not empty
        if closing:
            _close(stack, name)
            continue
        _open(stack, name)
        if name in _VOID or empty:
            continue
        element = _Element(name, stack[-1], _is_noise(name, attributes, stack[-1].articles > 0))
        stack.append(element)
        elements.append(element)


def _settle(elements: list[_Element]) -> None:
    """Lets noise reach what is inside it, but never the marked article.

    An outermost article is not noise, nor is what holds it; only where another stands outside all noise may one that
    stands inside noise (a teaser, a comment) go with it. The same holds for ``main``, which always stays.
    """
    outer, clean = [], False
    for e in elements:
        if e.name == "main" or e.name == "article" and not _within(e, "article"):
            e.noise = False
            above, noisy = e.parent, False
            while above:
                noisy, above = noisy or above.noise, above.parent
            outer.append((e, noisy))
            clean |= e.name == "article" and not noisy
    for e, noisy in outer:
        if noisy and (e.name == "main" or not clean):
            above = e.parent
            while above:
                above.noise, above = False, above.parent
    for e in elements[1:]:
        e.noise |= e.parent.noise


def _within(element: _Element, name: str) -> bool:
    above = element.parent
    while above and above.articles:
        if above.name == name:
            return True
        above = above.parent
    return False


def lines(page: str) -> Iterator[tuple[str, int, bool, bool]]:
    """The blocks of a page: text, characters inside links, whether in a noise element, whether in a marked article.

    Noise within a line of text is a line of its own after it.
    """
    blocks, elements = _parse(page)
    _settle(elements)
    for block in blocks:
        for noisy in (False, True):
            pieces = [x for x in block if x[2].noise == noisy]
            line = _SPACE.sub(" ", html.unescape("".join(text for text, *_ in pieces))).strip()
            if line:
                linked = sum(len(text.strip()) for text, link, _ in pieces if link)
                yield line, linked, noisy, any(e.articles for _, _, e in pieces)


def spans(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """Surge and dive of each span (first line, line after the last), and the largest window sum in it."""
    if not len(lengths):
        return []
    total = np.concatenate([[0], np.cumsum(lengths)])
    ends = np.minimum(np.arange(len(lengths)) + window, len(lengths))
    sums = total[ends] - total[:-1]  # of the window that begins at each line
    risen = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(risen[1:] != risen[:-1])
    found = []
    for surge, dive in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        found.append((surge, dive, int(sums[surge:dive].max())))
    return found


def _chosen(found: list[tuple[int, int, int]], texts: list[str], lengths: np.ndarray, surge: int) -> list[tuple[int, int, int]]:
    """The spans that surge, or the longest where none does, with those between them and those after them that end a sentence."""
    if not found:
        return []
    least = min(surge, max(s for *_, s in found))
    high = [i for i, t in enumerate(found) if t[2] >= least]
    sentence = lambda a, b: any(lengths[i] and texts[i].rstrip(_QUOTES).endswith(_STOPS) for i in range(a, b))
    return [t for i, t in enumerate(found) if high[0] <= i <= high[-1] or i > high[-1] and sentence(t[0], t[1])]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks in page order, joined by line feeds."""
    if not page:
        return ""
    found = list(lines(page))
    texts = [line for line, *_ in found]
    marks = np.array([inside for *_, inside in found], bool)
    lengths = np.array([0 if noisy or not inside and linked > LINKED * len(line) else len(line) for line, linked, noisy, inside in found], np.int64)
    within, beyond = (spans(np.where(marks == side, lengths, 0), window) for side in (True, False))
    longest = max((lengths[a:b][marks[a:b]].sum() for a, b, _ in within), default=0)
    if not within:
        kept = np.ones(len(found), bool)
        taken = _chosen(beyond, texts, lengths, surge)
    elif any(s >= surge and lengths[a:b][~marks[a:b]].sum() > longest for a, b, s in beyond):
        kept = np.ones(len(found), bool)  # the mark is not round the longest text: all spans count alike
        taken = _chosen(spans(lengths, window), texts, lengths, surge)
    else:
        kept, taken = marks, within
    return "\n".join(texts[i] for a, b, _ in taken for i in range(a, b) if lengths[i] and kept[i])


def extract(pages: DataFrame, keep: list[str], text: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars``, one row per page."""
    kept = [c for c in keep if c not in ("text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "_html"):
            out = [main_text(x, window, surge) for x in batch.column(len(kept)).to_pylist()]
            sizes = pa.array([len(x) for x in out], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), sizes], [*kept, "text", "n_chars"])

    fields = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept]
    source = pages.select(*kept, F.col(text).cast("string").alias("_html"))
    return source.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
