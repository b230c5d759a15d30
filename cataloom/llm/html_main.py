"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element; line breaks in the source don't count. Elements that are never part
of an article (menus, headers, footers, sidebars, notices, adverts, forms, scripts, reader comments, hidden parts)
leave a run of empty lines, unless they stand inside an article or main part, which goes on behind them; so does the
boundary of such a part. Each line has a mass: its text length, or, outside an article, that without its link text. Where a
page marks an article or else a main part, mass outside it weighs OUTSIDE times as little, so that marks help but don't
decide. Masses are summed over a sliding window of lines: a region begins at the line where the sum surges from zero and
ends where it dives to zero again. Regions whose highest sum reaches the surge threshold, or the share SHARE of the
page's highest sum if that is more, are kept, with all text between surge and dive, in page order. If no region reaches
the threshold, the share alone decides.

Defined results: a null page counts as empty; no text, or little text beside an empty article, gives an empty string;
unclosed, stray and wrongly nested tags are tolerated; where a quoted attribute never ends, quotes count as plain
characters from there on; a page of any length is processed whole, in linear time; rows keep their other columns.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from cataloom.llm.common import fresh, trimmed

#: Lines that a window sums over; the customary surge threshold of the method; the share of the highest sum that a
#: region needs beside it; and how much less mass outside a marked article weighs.
WINDOW, SURGE, SHARE, OUTSIDE = 3, 86, 0.25, 256

# Element names of the HTML standard by their role here, and usual names of page parts.
RAW_TEXT = frozenset("script style title textarea noscript iframe template noembed noframes xmp".split())
SHOWN_RAW = frozenset({"xmp"})
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form button select dialog menu head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PART_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars aside widget widgets related recommended recommendations share sharing social cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall comment comments commentlist disqus respond replies form search pagination pager toolbar copyright".split())
COMMENT_NAMES = frozenset("comment comments commentlist disqus reply replies respond teaser related promo sponsored ad advert".split())
PART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
NEGATED = frozenset("has with no is without not".split())

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_MAIN_ROLE = re.compile(r"\brole\s*=\s*[\"']?main\b")
#: What an opening tag closes if it is open, and the elements that such an open one doesn't show through.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_NOT_P, _NOT_HEADING = BLOCKS - {"p"}, BLOCKS - HEADINGS


@dataclass
class Line:
    """A block's text; how much of it is link text; the deepest part around it: 2 an article, 1 the main part, 0 neither."""

    text: str
    linked: int
    part: int


def _is_dropped(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if not attributes or name in ("html", "body"):
        return False
    names = COMMENT_NAMES if name in ("article", "main") else PART_NAMES
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _WORDS.findall(token)]
                if words and NEGATED.isdisjoint(words) and (words[0] in names or words[-1] in names):
                    return True
        elif key == "role" and value.lower() in PART_ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


class Tags:
    """Cuts a page into texts and tags, each character looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.at = page, 0
        self.quotes_end = True

    def _tag_end(self, at: int) -> int:
        """Where the tag whose name ends at that place ends: before its >, or at the end of the page."""
        page = self.page
        if self.quotes_end:
            place = at
            while True:
                place = _PLAIN.match(page, place).end()
                if place >= len(page) or page[place] == ">":
                    break
                place = page.find(page[place], place + 1) + 1
                if not place:
                    break
            if 0 < place < len(page):
                return place
            self.quotes_end = False  # scanned to the end of the page in vain, once
        end = page.find(">", at)
        return len(page) if end < 0 else end

    def __iter__(self) -> Iterator[tuple[str, bool, str]]:
        """(text, False, "") for texts; (name, is an end tag, attributes) for tags, told apart by an empty name: ("", ...)."""
        page = self.page
        while self.at < len(page):
            begin = page.find("<", self.at)
            if begin < 0:
                yield "", False, page[self.at :]
                return
            if begin > self.at:
                yield "", False, page[self.at : begin]
            if page.startswith("<!--", begin):
                end = page.find("--", begin + 4)
                while end >= 0 and page[end + 2 : end + 3] != ">" and page[end + 2 : end + 4] != "!>":
                    end = page.find("--", end + 1)
                self.at = len(page) if end < 0 else page.index(">", end) + 1
            elif page[begin + 1 : begin + 2] in ("!", "?"):
                end = page.find(">", begin)
                self.at = len(page) if end < 0 else end + 1
            elif name := _NAME.match(page, begin):
                end = self._tag_end(name.end())
                self.at = end + 1
                yield name[2].lower(), bool(name[1]), page[name.end() : end]
            else:
                yield "", False, "<"
                self.at = begin + 1

    def skip_raw(self, name: str) -> str:
        """The text up to the end tag of a raw element, which is passed over."""
        end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(self.page, self.at)
        text = self.page[self.at : end.start() if end else len(self.page)]
        self.at = end.end() if end else len(self.page)
        return text


def page_lines(page: str, window: int = WINDOW) -> tuple[list[Line | None], int]:
    """Lines of a page, None being an empty line; and the deepest part that the page marks."""
    lines: list[Line | None] = []
    stack: list[tuple[str, bool, int]] = []  # name, dropped, part
    depths: defaultdict[str, list[int]] = defaultdict(list)  # where names stand in the stack
    walls: list[int] = []  # where blocks and dropped elements stand
    hidden: list[int] = []  # where dropped elements stand
    texts: list[str] = []
    linked, in_link, part, best = 0, 0, 0, 0
    gap = False

    def flush() -> None:
        nonlocal linked, gap
        text = " ".join(html.unescape("".join(texts)).split()) if texts else ""
        if text:
            before = next((line.part for line in reversed(lines) if line), part)
            if gap and not part or before != part:
                lines.extend([None] * window)
            lines.append(Line(text, min(linked, len(text)), part))
            gap = False
        texts.clear()
        linked = 0

    def close_to(depth: int) -> None:
        nonlocal part, in_link, gap
        while len(stack) > depth:
            name, dropped, outer = stack.pop()
            depths[name].pop()
            if name in BLOCKS or dropped:
                walls.pop()
                flush()
            if name == "a":
                in_link -= 1
            if dropped:
                hidden.pop()
                gap = True
            part = outer

    def find(names: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> int | None:
        """The innermost open element of these names, if no barrier or dropped element stands within it."""
        at = max((depths[n][-1] for n in names if depths[n]), default=-1)
        wall = max((depths[n][-1] for n in barrier if depths[n]), default=-1)
        return at if at > max(wall, hidden[-1] if hidden else -1) else None

    def add(text: str) -> None:
        nonlocal linked
        if not hidden:
            texts.append(text)
            if in_link:
                linked += len(text.strip())

    tags = Tags(page)
    for name, is_end, content in tags:
        if not name:
            add(content)
            continue
        if is_end:
            if name == "br":
                add(" ")
            if depths[name]:
                depth = depths[name][-1]
                if name in BLOCKS or not walls or walls[-1] <= depth:
                    close_to(depth)
            continue
        if name in BLOCKS:
            if (depth := find({"p"}, _NOT_P)) is not None:
                close_to(depth)
            if name in _CLOSES and (depth := find(*_CLOSES[name])) is not None:
                close_to(depth)
            if name in HEADINGS and (depth := find(HEADINGS, _NOT_HEADING)) is not None:
                close_to(depth)
            flush()
        if name in RAW_TEXT:
            text = tags.skip_raw(name)
            if name in SHOWN_RAW:
                add(text.replace("&", "&amp;"))
                flush()
            continue
        if name == "br":
            add(" ")
        if name in VOID or content.rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name == "a" and (depth := find({"a"}, _NOT_P)) is not None:
            close_to(depth)
        dropped = _is_dropped(name, content)
        if dropped:
            flush()
            gap = True
            hidden.append(len(stack))
        if name in BLOCKS or dropped:
            walls.append(len(stack))
        depths[name].append(len(stack))
        stack.append((name, dropped, part))
        in_link += name == "a"
        inside = 2 if name == "article" else max(part, 1) if name == "main" or _MAIN_ROLE.search(content) else part
        if inside != part and not hidden:
            flush()
            part, best = inside, max(best, inside)
    close_to(0)
    flush()
    return lines, best


def masses(lines: list[Line | None], best: int) -> list[int]:
    """The weighted text length of each line."""

    def mass(line: Line | None) -> int:
        if line is None:
            return 0
        if line.part == 2:
            return len(line.text)
        return (len(line.text) - line.linked) // (1 if line.part == best else OUTSIDE)

    return [mass(line) for line in lines]


def window_sums(values: list[int], window: int = WINDOW) -> list[int]:
    """The sum over the window that begins at each line."""
    sums, running = [0] * len(values), 0
    for i in range(len(values) - 1, -1, -1):
        running += values[i] - (values[i + window] if i + window < len(values) else 0)
        sums[i] = running
    return sums


def regions(values: list[int], sums: list[int]) -> list[tuple[int, int, int]]:
    """(surge, dive, highest sum): from a line with mass to the last one with mass before the sum is zero."""
    found, i = [], 0
    while i < len(values):
        if not values[i]:
            i += 1
            continue
        surge = dive = i
        while i < len(values) and sums[i]:
            if values[i]:
                dive = i
            i += 1
        found.append((surge, dive, max(sums[surge : dive + 1])))
    return found


def main_text(page: str | None, window: int = WINDOW) -> str:
    lines, best = page_lines(page or "", window)
    values = masses(lines, best)
    found = regions(values, window_sums(values, window))
    highest = max((peak for *_, peak in found), default=0)
    least = max(SURGE if highest >= SURGE else 0, SHARE * highest)
    kept = (line.text for surge, dive, peak in found if peak >= least for line in lines[surge : dive + 1] if line)
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html, with text (the main text) and n_chars (its code points)."""
    rest = [c for c in pages.columns if c.lower() not in ("text", "n_chars") and c != html_col]
    (held,) = fresh(pages.columns, "html")
    source = pages.select(*[pages[f"`{c}`"] for c in rest], pages[f"`{html_col}`"].alias(held))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(len(rest))]
            columns = [*batch.columns[: len(rest)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: len(rest)], "text", "n_chars"])

    schema = source.select(*[f"`{c}`" for c in rest]).schema.add("text", "string").add("n_chars", "long")
    return source.mapInArrow(trimmed(extracted), schema)
