"""Main text of web pages by the distribution of text over lines.

Markup is stripped so that every block becomes a line, with empty lines where a
section begins or ends. Text inside links counts as no text. The lengths are summed
over a sliding window of lines: where the sum rises above a threshold the main text
surges, where it falls to nothing it dives, and the lines between are kept. Lines of
elements that announce themselves as something else (menus, footers, adverts, forms,
comments and so on) have no text for this purpose and are never kept.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from sift.llm import frames
from sift.llm.words import chunks, texts_of

#: Lines in a window, and the least text in a window where the main text surges.
WINDOW = 3
SURGE = 80

# Element names of HTML by their part in a page, and names that pages use.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "xmp", "noembed", "noframes")
DEAD = frozenset("nav footer aside form header button select dialog menu head audio video map datalist fieldset".split())
SECTION = frozenset("div section article main nav footer aside form header dialog menu head body html table ul ol dl blockquote figure details fieldset select button center td th tr tbody thead tfoot li".split())
BLOCK = SECTION | frozenset("p h1 h2 h3 h4 h5 h6 pre dt dd hr figcaption caption summary address option legend hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
DEAD_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert"
    " popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion sidebar side"
    " menu menubar nav navbar navigation navi breadcrumb breadcrumbs crumbs footer masthead share sharing social related recommended widget"
    " widgets pagination pager copyright legal disclaimer search toolbar skip hidden".split()
)
DEAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW)})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
#: A tag whose quotes are not closed ends at the next angle bracket.
_LOOSE = re.compile(r"<()(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements that no name makes dead.
NEVER_NAMED = frozenset("html body article main".split())


@dataclass
class Line:
    """A block of the page: its text, how much of it is outside of links, and its section."""

    text: str
    size: int
    section: int
    in_main: bool
    #: Open elements that are dead by name, unless they hold most of the page's text.
    named: tuple[int, ...] = ()


def _named(tag: str, attributes: str) -> bool:
    """Whether a whole token of the class or id says that the element is something else."""
    if not attributes or tag in NEVER_NAMED:
        return False
    found = ((m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTRIBUTE.finditer(attributes))
    return any(name in ("class", "id") and not DEAD_NAMES.isdisjoint(value.split()) for name, value in found)


def _is_dead(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in DEAD and not (tag == "header" and in_main):
        return True
    if not attributes or attributes.isspace():
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role" and value.strip() in DEAD_ROLES or name == "hidden":
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def lines_of(page: str) -> list[Line | None]:
    """The live blocks in page order, ``None`` where a section or a dead part lies between."""
    lines: list[Line | int | None] = []  # a number: an edge of that section, if it is dead by name
    stack: list[tuple[str, bool, int, bool]] = []  # open sections: name, dead, number, dead by name
    parts: list[str] = []
    plain: list[str] = []
    sections, links, mains, dead, block_dead = 0, 0, 0, 0, False

    def flush() -> None:
        if parts:
            if not dead and not block_dead:
                text = " ".join(references.unescape("".join(parts)).split())
                if text:
                    size = len(" ".join(references.unescape("".join(plain)).split()))
                    lines.append(Line(text, size, stack[-1][2] if stack else 0, mains > 0, tuple(s[2] for s in stack if s[3])))
            parts.clear()
            plain.clear()

    at = 0
    while True:
        open_ = page.find("<", at)
        m = None
        while open_ >= 0 and (m := _TOKEN.match(page, open_) or _LOOSE.match(page, open_)) is None:
            open_ = page.find("<", open_ + 1)
        text = page[at : open_ if open_ >= 0 else len(page)]
        if text:
            parts.append(text)
            if not links:
                plain.append(text)
        if m is None:
            break
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m[2] else 1
        elif tag == "br":
            parts.append(" ")
            plain.append(" ")
        elif tag in BLOCK:
            flush()
            links, block_dead = 0, False
            if tag not in SECTION:
                block_dead = not m[2] and bool(m[4]) and (_is_dead(tag, m[4], mains > 0) or _named(tag, m[4]))
            elif not m[2]:
                is_dead = _is_dead(tag, m[4], mains > 0)
                named = not is_dead and _named(tag, m[4])
                sections += 1
                stack.append((tag, is_dead, sections, named))
                dead += is_dead
                mains += tag in MAIN
                if is_dead or tag in MAIN:
                    lines.append(None)
                elif named:
                    lines.append(sections)
            elif any(s[0] == tag for s in stack):
                while True:
                    name, was_dead, number, was_named = stack.pop()
                    dead -= was_dead
                    mains -= name in MAIN
                    if was_dead or name in MAIN:
                        lines.append(None)
                    elif was_named:
                        lines.append(number)
                    if name == tag:
                        break
        elif m[4] and tag not in VOID and tag in ("span", "label") and (_is_dead(tag, m[4], mains > 0) or _named(tag, m[4])):
            parts.append(" ")
    flush()
    return _without_named(lines)


def _without_named(lines: list[Line | int | None]) -> list[Line | None]:
    """``lines`` without sections that are dead by name, except those with most of the page's text.

    A section that leaves out text of ``<article>`` or ``<main>`` is never excepted: a
    long thread of comments beside or within a short article stays one.
    """
    held: dict[int, int] = {}
    marked: dict[int, int] = {}
    total, all_marked = 0, 0
    for line in lines:
        if isinstance(line, Line):
            total += line.size
            all_marked += line.in_main
            for number in line.named:
                held[number] = held.get(number, 0) + line.size
                marked[number] = marked.get(number, 0) + line.in_main
    alive = {number for number, size in held.items() if 2 * size > total and marked[number] == all_marked}
    left: list[Line | None] = []
    for line in lines:
        if isinstance(line, int):
            if line not in alive:
                left.append(None)
        elif line is None or alive.issuperset(line.named):
            left.append(line)
    return left


def main_text(page: str, between: str = "\n") -> str:
    """The blocks between surge and dive of the line distribution, joined by ``between``.

    ``<article>`` and ``<main>`` are boundaries, and a weight: where they hold most of the
    text outside links, runs of their lines need no surge.
    """
    lines = lines_of(page)
    sizes: list[int] = []
    place: list[int] = []
    for line in lines:
        if line is None:
            sizes += [0] * WINDOW
        else:
            place.append(len(sizes))
            sizes.append(line.size)
    live = [line for line in lines if line is not None]
    if not live:
        return ""
    marked = {p for line, p in zip(live, place) if line.in_main}
    weighty = 2 * sum(sizes[p] for p in marked) > sum(sizes)
    sums = [sum(sizes[i : i + WINDOW]) for i in range(len(sizes))]
    kept = [False] * len(sizes)
    best, best_sum, i = (0, 0), 0, 0
    while i < len(sums):
        if not sums[i]:
            i += 1
            continue
        j = i
        while j < len(sums) and sums[j]:
            j += 1
        after = j
        # A window begins before its text: lines of links at either end are not part of it.
        while i < j and not sizes[i]:
            i += 1
        while i < j and not sizes[j - 1]:
            j -= 1
        if i < j and (max(sums[i:j]) >= SURGE or weighty and i in marked):
            kept[i:j] = [True] * (j - i)
        if sum(sizes[i:j]) > best_sum:
            best, best_sum = (i, j), sum(sizes[i:j])
        i = after
    if not any(kept):
        kept[best[0] : best[1]] = [True] * (best[1] - best[0])
    # Short blocks of a section that surged belong to it, whatever lies between.
    surged = {line.section for line, p in zip(live, place) if kept[p] and line.size >= SURGE}
    return between.join(line.text for line, p in zip(live, place) if kept[p] or (line.section in surged and line.size))


def extracted(pages: DataFrame, keep: list[str] | None = None, between: str = "\n") -> DataFrame:
    """For every row of ``pages``: ``row`` and ``text``, the main text of the whole ``html``.

    Blocks are joined by ``between``.

    ``row`` holds the columns ``keep`` (all, if not given) as a struct, so their names
    cannot clash. The text of a null or empty page, and of one without text, is empty;
    equal pages give equal texts; an empty table gives no rows.
    """
    rows = frames.packed(pages, keep, "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _ in chunks(texts_of(batch.column(1))):
                texts = [main_text(p, between) if p else "" for p in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(texts, pa.string())], names=["row", "text"])

    return rows.mapInArrow(run, frames.with_row(rows, "text string"))
