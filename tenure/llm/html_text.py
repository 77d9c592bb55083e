"""HTML extraction by layout-aware rendering (operator 7).

A small tree builder with implied end tags turns each page into nested elements; a renderer walks the visible
ones and emits all their text: blocks on lines of their own, a blank line around paragraphs, headings,
lists and tables, list items with their marker and depth, table rows with their cells in aligned columns (a cell takes as many
columns and rows as its colspan and rowspan say), and white space as a browser collapses it (kept in pre and textarea). Options, formulas and
drawings show their text. Columns are up to ``WIDEST`` characters wide: a longer line of a cell that has others behind it is wrapped within its column.

The time is in proportion to the page, for broken markup too: from where no tag is closed any more the rest is text, and behind a quote that is never closed
tags end at the next ``>``.

Not visible: head, script, style, template, noscript and the like, elements with the hidden attribute, an
inline style of display none or visibility hidden, or a rule of that kind for their tag, class or id in a style element
(simple selectors), hidden inputs, comments. Null and empty pages give an
empty text; broken markup never fails (stray end tags are ignored, open elements end with the page). Elements nested
deeper than ``DEEPEST`` are laid side by side at that depth. Rows are independent: equal ids and extra columns are harmless. An empty
table gives an empty result.
"""

from __future__ import annotations

import bisect
import html
import re
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST, WIDEST, MOST_COLUMNS = 200, 60, 1000

NAME, EDGE = re.compile(r"[a-zA-Z][^\s/>]*"), re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
STYLE, END_STYLE, COMMENT = re.compile(r"<style\b", re.I), re.compile(r"</style\s*>", re.I), re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
ORDINAL = re.compile(r"-?[0-9]{1,9}")
SIMPLE = re.compile(r"[a-zA-Z][\w-]*|\*?[.#][\w-]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")

# Fixed values of the HTML standard, as far as rendering needs them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
SKIPPED = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset".split())
LINES = frozenset(
    "html body div section article aside nav header footer main address form details summary li dt dd tr caption thead tbody tfoot figcaption legend center hgroup search option optgroup".split()
)
BLOCKS = SPACED | LINES | {"hr"}
#: What a head may hold; any other start tag, and text, ends an open head.
HEAD = frozenset("head title base basefont bgsound link meta script style template noscript noframes".split())
#: A start tag ends the open elements named here, up to the scope's edge.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"caption", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tbody": ({"caption", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"caption", "thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}


def style_sheets(page: str) -> Iterator[str]:
    """Contents of the page's style elements."""
    at = 0
    while (m := STYLE.search(page, at)) and (start := page.find(">", m.end())) >= 0:
        end = END_STYLE.search(page, start + 1)
        yield page[start + 1 : end.start() if end else len(page)]
        if not end:
            return
        at = end.end()


def unseen_selectors(page: str) -> frozenset[str]:
    """Simple selectors (tag, .class, #id) of the page's style elements whose rules hide."""
    found = set()
    for sheet in style_sheets(page):
        for rule in COMMENT.sub("", sheet).split("}")[:-1]:
            *_, selectors, declarations = ["", *rule.split("{")]
            if selectors and UNSEEN.search(declarations):
                found |= {x.strip().lstrip("*") for x in selectors.split(",") if SIMPLE.fullmatch(x.strip())}
    return frozenset(x if x[0] in ".#" else x.lower() for x in found)


class Tags:
    """The tags of a page, one by one."""

    def __init__(self, page: str):
        self.page, self.last, self.quoted, self.edge = page, page.rfind(">"), True, None

    def _end(self, at: int) -> int:
        """Place behind the tag whose attributes start at ``at``; -1 if there is none. A place that was found once isn't searched for again."""
        start = at
        while True:
            if self.edge is None or self.edge.start() < at:
                self.edge = EDGE.search(self.page, at)
            if self.edge is None:
                return -1
            where, sign = self.edge.start(), self.edge[0]
            if sign == ">":
                return where + 1
            close = self.page.find(sign, where + 1) if self.quoted else where
            if close < 0:
                self.quoted, at = False, start
                self.edge = None
                continue
            at = close + 1

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, lower-case name, attributes) of the first tag, comment or declaration from ``at``; the last two have no name."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(page), "", "", ""
            if start > self.last:
                start = page.find("<!--", start)
                return None if start < 0 else (start, len(page), "", "", "")
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "", "", ""
            slash = "/" if page.startswith("</", start) else ""
            if m := NAME.match(page, start + 1 + len(slash)):
                end = self._end(m.end())
                if end >= 0:
                    return start, end, slash, m[0].lower(), page[m.end() : end - 1]
            at = start + 1
        return None


class Element:
    __slots__ = ("children", "rows", "seen", "span", "start", "tag")

    def __init__(self, tag: str, attributes: str = "", unseen: frozenset[str] = frozenset()):
        self.tag, self.children, self.start, self.span, self.rows = tag, [], 1, 1, 1
        self.seen = tag not in SKIPPED and tag not in unseen
        if attributes and self.seen:
            got = {a.lower(): html.unescape(x or y or z) for a, x, y, z in ATTRIBUTE.findall(attributes)}
            self.seen = not ("hidden" in got or UNSEEN.search(got.get("style", "")) or (tag == "input" and got.get("type", "").lower() == "hidden"))
            if unseen and self.seen:
                self.seen = unseen.isdisjoint([f"#{got.get('id', '')}", *(f".{c}" for c in got.get("class", "").split())])
            if tag == "ol" and ORDINAL.fullmatch(got.get("start", "")):
                self.start = int(got["start"])
            if tag in ("td", "th") and ORDINAL.fullmatch(got.get("colspan", "")):
                self.span = min(max(int(got["colspan"]), 1), MOST_COLUMNS)
            if tag in ("td", "th") and ORDINAL.fullmatch(got.get("rowspan", "")):
                self.rows = min(max(int(got["rowspan"]), 1), MOST_COLUMNS)


def parse(page: str) -> Element:
    root = Element("html")
    stack, at = [root], 0
    end, unseen, tags = len(page), unseen_selectors(page) if STYLE.search(page) else frozenset(), Tags(page)
    while at < end:
        m = tags.next(at)
        if m is None:
            if stack[-1].tag == "head" and page[at:].strip():
                stack.pop()
            stack[-1].children.append(page[at:])
            break
        start, stop, slash, tag, attributes = m
        if start > at:
            if stack[-1].tag == "head" and page[at:start].strip():
                stack.pop()
            stack[-1].children.append(page[at:start])
        at = stop
        if not tag:
            continue
        if slash:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCKS and tag not in ("td", "th") and stack[k].tag in ("td", "th", "table"):
                    break  # an inline end tag doesn't reach out of its cell
            continue
        if tag == "html":
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            stack.pop()
        ends, edge = IMPLIED.get(tag, (set(), set()))
        if tag in BLOCKS:
            ends, edge = ends | {"p"}, edge | {"td", "th", "table", "li", "dd", "button", "object"} - ends
        cut = None
        for k in range(len(stack) - 1, 0, -1) if ends else ():
            if stack[k].tag in ends:
                cut = k
            elif stack[k].tag in edge:
                break
        if cut is not None:
            del stack[cut:]
        e = Element(tag, attributes, unseen)
        stack[-1].children.append(e)
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            e.children.append(page[at : close.start() if close else end])
            at = close.end() if close else end
        elif len(stack) < DEEPEST:
            stack.append(e)
    return root


class Page:
    """Lines under construction; white space and blank lines collapse as they come."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.prefix = ""  # marker or indent of the next line

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s == " " or not s:
            self.space |= s == " "
            return
        if s[0] == " " or self.space:
            s = s.lstrip(" ")
            if self.line:
                self.line.append(" ")
        self.space = s.endswith(" ")
        self.line.append(s.rstrip(" "))

    def kept(self, s: str) -> None:
        for k, part in enumerate(s.split("\n")):
            if k:
                self.flush(keep=True)
            if part:
                self.line.append(part)

    def flush(self, keep: bool = False) -> None:
        if self.line or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            indent = self.prefix if self.line else ""
            self.lines.append(indent + "".join(self.line))
            self.prefix = " " * len(self.prefix)
        self.line, self.space = [], False

    def blank(self) -> None:
        self.flush()
        self.gap = True


def _walk(node: Element, page: Page, indent: str, pre: bool) -> None:
    number = node.start
    for child in node.children:
        if isinstance(child, str):
            text = html.unescape(child) if node.tag not in ("script", "style") else child
            page.kept(text) if pre else page.text(text)
            continue
        if not child.seen:
            continue
        tag = child.tag
        if tag == "br":
            page.flush(keep=True)
        elif tag == "hr":
            page.blank()
        elif tag == "table":
            page.blank()
            for line in _table(child):
                page.line.append(line)
                page.flush()
            page.blank()
        elif tag == "li":
            page.flush()
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            page.prefix = indent + mark
            _walk(child, page, indent + " " * len(mark), pre)
            page.flush()
            page.prefix = indent
        elif tag in BLOCKS:
            deeper = indent + "  " if tag in ("dd", "blockquote") else indent
            # a list or paragraph inside an item goes on within the item
            (page.blank if tag in SPACED and not indent else page.flush)()
            if deeper != indent:
                page.prefix = deeper
            _walk(child, page, deeper, pre or tag == "pre")
            (page.blank if tag in SPACED and not indent else page.flush)()
            page.prefix = indent if deeper != indent else page.prefix
        else:
            _walk(child, page, indent, pre or tag == "textarea")


def _render(node: Element) -> list[str]:
    page = Page()
    _walk(node, page, "", node.tag == "pre")
    page.flush()
    return page.lines


def _rows(table: Element) -> Iterator[Element | str]:
    """Rows and stray content of a table, and the text directly in its row groups."""
    for child in table.children:
        if isinstance(child, str):
            if table.tag != "table":
                yield child
        elif child.seen:
            if child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)
            else:
                yield child


def _stray(children: list[Element | str]) -> list[str]:
    """Texts that stand where only rows or cells may, as lines."""
    return [x for x in (SPACES.sub(" ", html.unescape(c)).strip() for c in children if isinstance(c, str)) if x]


def _wrapped(lines: list[str]) -> list[str]:
    """Lines of at most ``WIDEST`` characters, cut at spaces where there are some."""
    return [y for x in lines for y in (textwrap.wrap(x, WIDEST, break_on_hyphens=False) if len(x) > WIDEST else [x])]


def _table(table: Element) -> list[str]:
    """Rows of cells in columns; captions and stray content as lines."""
    grid: list[list[tuple[int, int, list[str]]] | str] = []  # of a row: first column, columns, lines of each cell
    taken: list[tuple[int, int, int]] = []  # cells of rows above: first column, column behind, further rows
    for row in _rows(table):
        if isinstance(row, str):
            grid += _stray([row])
        elif row.tag == "tr":
            grid += _stray(row.children)
            cells, at, above, k = [], 0, sorted(taken), 0
            taken = [(a, b, n - 1) for a, b, n in taken if n > 1]
            for c in row.children:
                if isinstance(c, Element) and c.seen:
                    while k < len(above) and above[k][0] <= at:
                        at = max(at, above[k][1])
                        k += 1
                    cells.append((at, c.span, _render(c)))
                    if c.rows > 1:
                        taken.append((at, at + c.span, c.rows - 1))
                    at += c.span
            last = max((k for k, x in enumerate(cells) if x[2]), default=0)
            cells = [(a, n, _wrapped(lines) if k < last else lines) for k, (a, n, lines) in enumerate(cells)]
            if any(lines for _, _, lines in cells):
                grid.append(cells)
        else:
            grid += [x for x in _render(row) if x]
    loose = _stray(table.children)
    width: dict[int, int] = {}
    for cells in grid:
        if not isinstance(cells, str):
            for at, span, lines in cells:
                if span == 1:
                    width[at] = max([width.get(at, 0), *(len(x) for x in lines if len(x) <= WIDEST)])
    columns = sorted(width)
    left = [0]  # where each column starts
    for c in columns:
        left.append(left[-1] + width[c] + 2)
    out = loose
    for cells in grid:
        if isinstance(cells, str):
            out.append(cells)
            continue
        for k in range(max(len(lines) for _, _, lines in cells)):
            line = ""
            for at, _, lines in cells:
                if k < len(lines) and lines[k]:
                    place = left[bisect.bisect_left(columns, at)]
                    line = (line + "  " if len(line) >= place else line.ljust(place)) + lines[k] if line or place else lines[k]
            if line.rstrip():
                out.append(line.rstrip())
    return out


def visible_text(page: str | None) -> str:
    lines = [x.rstrip() for x in _render(parse(page or ""))]
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([visible_text(x) for x in part.column(1).to_pylist()], pa.string())], names=["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row of ``pages`` (page_id, html)."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_extract, "page_id long, text string")
