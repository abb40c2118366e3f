"""Visible text of HTML, laid out: block spacing, lists and aligned table cells.

A tree is built from the tags with the implied ones added (paragraphs, list items, rows and
cells end where the next begins), then walked without recursion, so depth has no limit. Hidden
are: the head, scripts, styles, templates and other elements that show nothing (of formulas and
drawings only what is not drawn: annotations, definitions, descriptions), elements with
`hidden` or `display:none`, closed dialogs, closed details but for their summary, and what is
`visibility:hidden` but for what is visible again within. Rules of style sheets are not followed, only
`style` attributes. All other text is written: white space is collapsed outside `pre` and `textarea`,
blocks start new lines, paragraphs, headings, lists and tables are set off by a blank line, list items
are marked and indented. Table cells keep the lines of their blocks, lists and inner tables, and begin
at the place of their column, cells that span columns or rows included. Two bounds keep the result in
proportion to the page, without loss of text: margins end at MAX_MARGIN, and where aligning one table
would take more than MAX_PADDING blanks its widest columns are narrowed (longer cells are written
whole and only shift the rest of their line).

Time grows with the length of the page, however many elements are open.

Null and empty pages give empty text. Broken markup (open tags, stray ends, cut entities) is
read as far as it goes. Repeated rows are rendered alike. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallymill.llm.common import slices

MAX_MARGIN = 200
MAX_PADDING = 1 << 24
# Element names of the HTML standard by what they do to the layout.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = set("head script style template noscript title iframe noembed noframes object "
             "audio video canvas datalist meta link base map".split())
# Within svg and math: what is not shown, and what stands apart from the text before.
UNSEEN = set("annotation annotation-xml mphantom defs desc metadata title symbol clippath mask marker "
             "pattern".split())
APART = {"text", "mtr", "mtd"}
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre table figure hr".split())
BLOCKS = SPACED | set(
    "html body address article aside center details dialog dd dir div dt fieldset figcaption "
    "footer form header hgroup legend li main nav option optgroup search section summary tr "
    "caption thead tbody tfoot xmp".split())
# A start tag ends these open elements, unless one of the borders lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    **{part: ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"})
       for part in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, {"body"}),
}
ENDS_PARAGRAPH = SPACED | set("address article aside center details dialog dd dir div dt fieldset "
                              "figcaption footer form header hgroup li main menu nav search section "
                              "summary".split())
# Any other start tag, and text, ends an open head.
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
# An end tag does not reach out of these.
BORDERS = {"td", "th", "table", "caption", "template"}
ROW_GROUPS = {"thead", "tbody", "tfoot"}

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]*))?")
_NO_SHOW = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
# The slash of an unquoted value is part of the value.
_OWN_END = re.compile(r"(?:\A|[\s\"'])[^\s=\"']*/\Z")
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def _attributes(text: str) -> dict[str, str]:
    if not text.strip("/ \t\n\f\r"):
        return {}
    found = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'")))
    return found


class Open:
    """The open elements, outermost first, and where those of each name are."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def end(self, place: int) -> None:
        """Ends the element at `place` and all within."""
        for node in self.nodes[place:]:
            self.places[node.name].pop()
        del self.nodes[place:]

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost of `names`; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names: set[str], borders: set[str]) -> None:
        """Ends the open elements of `names` down to the nearest border."""
        place = self.last(names - borders)
        if place and place > self.last(borders):
            # Rows hold cells: ending the outer one ends all within.
            inner = names - borders
            while place > 1 and self.nodes[place - 1].name in inner:
                place -= 1
            self.end(place)

    def foreign(self) -> bool:
        """Whether an element that starts here belongs to a formula or drawing."""
        return self.last(("svg", "math")) > self.last(("foreignobject",))


def parse(page: str) -> Node:
    root = Node("#root", {})
    open_, at, end = Open(root), 0, len(page)
    drawn = False  # a formula or drawing has begun somewhere before
    while at < end:
        hit = _TOKEN.search(page, at)
        text = page[at:hit.start()] if hit else page[at:]
        if text:
            if open_.nodes[-1].name == "head" and text.strip(" \t\n\f\r"):
                open_.end(len(open_.nodes) - 1)
            open_.nodes[-1].children.append(html.unescape(text) if "&" in text else text)
        if not hit:
            break
        at = hit.end()
        name = hit.group(2)
        if not name:
            continue
        name = name.lower()
        if hit.group(1):
            place = open_.last((name,))
            if place and (name in ROW_GROUPS or name in ("table", "tr") or place >= open_.last(BORDERS)):
                open_.end(place)
            if name == "br":
                open_.nodes[-1].children.append(Node("br", {}))
            continue
        if open_.nodes[-1].name == "head" and name not in IN_HEAD:
            open_.end(len(open_.nodes) - 1)
        if name in ENDS_PARAGRAPH:
            open_.close({"p"}, {"table", "td", "th", "caption", "button"})
        if name in ENDS:
            open_.close(*ENDS[name])
        node = Node(name, _attributes(hit.group(3)))
        drawn = drawn or name in ("svg", "math")
        inside = drawn and (name in ("svg", "math") or open_.foreign())
        if inside and name in UNSEEN:
            node.attributes["hidden"] = ""
        elif inside and name in APART:
            open_.nodes[-1].children.append(" ")
        open_.nodes[-1].children.append(node)
        if inside and _OWN_END.search(hit.group(3)):
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            body = page[at:stop.start()] if stop else page[at:]
            node.children.append(html.unescape(body) if name == "textarea" else body)
            at = stop.end() if stop else end
        elif name not in VOID:
            open_.push(node)
    return root


class Lines:
    """Text in the making: collapsed words on a current line, and the gap wanted before the next."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.gap, self.mark = "", False, 0, ""
        self.parts: list[str] = []
        self.indent = 0

    def words(self, text: str) -> None:
        collapsed = _SPACE.sub(" ", text)
        if collapsed.strip(" ") == "":
            self.space = self.space or (collapsed != "" and bool(self.parts))
            return
        if self.parts and (self.space or collapsed[0] == " "):
            self.parts.append(" ")
        self.parts.append(collapsed.strip(" "))
        self.space = collapsed[-1] == " "

    def end_line(self) -> None:
        if self.parts:
            self._put("".join(self.parts).replace("\xa0", " "))
            self.parts = []
        self.space = False

    def _put(self, text: str) -> None:
        if self.lines and self.gap > 1:
            self.lines.append("")
        margin = " " * max(0, min(self.indent, MAX_MARGIN) - len(self.mark))
        self.lines.append((margin + self.mark + text).rstrip(" "))
        self.gap, self.mark = 0, ""

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def forced_break(self) -> None:
        if self.parts:
            self.end_line()
        elif self.lines and not self.mark:
            self._put("")

    def exact(self, text: str) -> None:
        """Text whose lines and spaces stay."""
        self.end_line()
        for line in text.replace("\r\n", "\n").split("\n"):
            self._put(line.replace("\xa0", " "))

    def ready(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end_line()
        if self.indent and lines:
            for line in lines:
                self._put(line)
        elif lines:
            self._put(lines[0])
            self.lines += lines[1:]

    def taken(self) -> list[str]:
        """All lines, without empty ones at both ends."""
        self.end_line()
        a, b = 0, len(self.lines)
        while a < b and not self.lines[a]:
            a += 1
        while a < b and not self.lines[b - 1]:
            b -= 1
        return self.lines[a:b]


def _shown(node: Node) -> bool:
    if node.name in HIDDEN or "hidden" in node.attributes:
        return False
    if node.name == "dialog" and "open" not in node.attributes:
        return False
    return not _NO_SHOW.search(node.attributes.get("style", ""))


def _children(node: Node) -> list:
    if node.name == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
    return node.children


def _visible(node: Node, inherited: bool) -> bool:
    own = _VISIBILITY.findall(node.attributes.get("style", ""))
    return own[-1].lower() == "visible" if own else inherited


def _span(node: Node, attribute: str, most: int) -> int:
    """How many columns or rows a cell takes; `most` is the bound of the HTML standard."""
    value = node.attributes.get(attribute, "1").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    number = int(value[:9])
    return min(number, most) if number else most if attribute == "rowspan" else 1


# A cell: its lines, and how many columns and rows it takes. None begins a group of rows.
Cell = tuple[list[str], int, int]
Row = list[Cell] | None


def _placed(rows: list[Row]) -> Iterator[list[tuple[int, int, list[str]]]]:
    """For each row (first column, column behind, lines) of its cells, beside cells of rows above."""
    taken: list[tuple[int, int, int]] = []  # columns from, to, and rows for which they are taken still
    for row in rows:
        if row is None:
            taken = []
            continue
        placed, column, k, coming = [], 0, 0, []
        for lines, columns, height in row:
            while k < len(taken) and taken[k][0] <= column:
                column = max(column, taken[k][1])
                k += 1
            placed.append((column, column + columns, lines))
            if height > 1:
                coming.append((column, column + columns, height))
            column += columns
        left: list[tuple[int, int, int]] = []
        for a, b, height in sorted(taken + coming):
            if height > 1:
                if left and left[-1][1] >= a and left[-1][2] == height - 1:
                    left[-1] = (left[-1][0], max(b, left[-1][1]), height - 1)
                else:
                    left.append((a, b, height - 1))
        taken = left
        yield placed


def _aligned(rows: list[Row]) -> list[str]:
    """Lines of a table: each cell begins where its column begins."""
    placed = [[c for c in row if c[2]] for row in _placed(rows)]
    starts = sorted({cell[0] for row in placed for cell in row})
    if len(starts) < 2:
        return [line for row in placed for cell in row for line in cell[2]]
    number = {column: i for i, column in enumerate(starts)}
    widths, wide = [0] * len(starts), []
    for row in placed:
        for first, behind, lines in row:
            own, width = number[first], max(map(len, lines))
            last = bisect_left(starts, behind) - 1
            if last > own:
                wide.append((own, last, width))
            else:
                widths[own] = max(widths[own], width)
    for own, last, width in wide:  # the last column gives the room that a wide cell lacks
        widths[last] += max(0, width - sum(widths[own:last + 1]) - 2 * (last - own))
    bound = max(widths)
    while True:
        offsets = [0]
        for width in widths[:-1]:
            offsets.append(offsets[-1] + min(width, bound) + 2)
        blanks = sum(offsets[number[row[-1][0]]] * max(len(c[2]) for c in row) for row in placed if row)
        if blanks <= MAX_PADDING or not bound:
            break
        bound //= 2
    out = []
    for row in placed:
        parts: list[list[str]] = [[] for _ in range(max((len(c[2]) for c in row), default=0))]
        lengths = [0] * len(parts)
        for first, _, lines in row:
            offset = offsets[number[first]]
            for i, line in enumerate(lines):
                if line:
                    gap = max(offset - lengths[i], 2 if lengths[i] else 0)
                    parts[i] += [" " * gap, line]
                    lengths[i] += gap + len(line)
        out += ["".join(x).rstrip(" ") for x in parts]
    return out


def render(page: str | None) -> str:
    out = Lines()
    outer: list[tuple[Lines, list[Row]]] = []  # for each open table: the text and rows around
    rows: list[Row] = []
    cells: list[Lines] = []
    lists: list[tuple[bool, int]] = []
    numbers: list[int] = []
    pre = 0
    work: list = [(parse(page or ""), False, True)]
    while work:
        node, leaving, visible = work.pop()
        if isinstance(node, str):
            if not visible:
                continue
            if pre:
                before, *rest = node.replace("\r\n", "\n").split("\n")
                out.parts.append(before)
                for line in rest:
                    out._put("".join(out.parts).replace("\xa0", " "))
                    out.parts = [line]
            else:
                out.words(node)
            continue
        name = node.name
        if not leaving:
            if not _shown(node):
                continue
            if name == "br":
                if visible:
                    out.forced_break()
                continue
            if name in VOID:
                if name == "hr":
                    out.block(2)
                continue
            visible = _visible(node, visible)
            work.append((node, True, visible))
            work += [(child, False, visible) for child in reversed(_children(node))]
            if name == "table" or (name in ("td", "th") and outer):
                if name == "table":
                    out.block(2)
                    outer.append((out, rows))
                    rows = []
                    out = Lines()
                else:
                    if not rows or rows[-1] is None:
                        rows.append([])
                    cells.append(out)
                    out = Lines()
                continue
            if name == "tr" and outer:
                out.end_line()
                rows.append([])
                continue
            if name in ROW_GROUPS and outer:
                out.end_line()
                rows.append(None)
                continue
            if name in BLOCKS:
                nested = name in ("ul", "ol", "menu", "dl") and numbers
                out.block(1 if nested else 2 if name in SPACED else 1)
            if name in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                numbers.append(int(start) - 1 if start.lstrip("-").isdigit() and len(start) < 10 else 0)
                lists.append((name == "ol", out.indent))
            elif name == "li":
                numbered, margin = lists[-1] if lists else (False, 0)
                if numbered:
                    numbers[-1] += 1
                out.mark = f"{numbers[-1]}. " if numbered else "- "
                out.indent = margin + len(out.mark)
            elif name in ("dd", "blockquote"):
                out.indent += 2
            elif name in ("pre", "textarea", "xmp"):
                pre += 1
            continue
        if name in ("td", "th") and outer and cells:
            cell = out.taken(), _span(node, "colspan", 1000), _span(node, "rowspan", 65534)
            out = cells.pop()
            if rows[-1] is None:
                rows.append([])
            rows[-1].append(cell)
            continue
        if name == "table":
            loose = out.taken()  # a caption, or text between rows
            out, around = outer.pop()
            out.ready(loose)
            out.ready(_aligned(rows))
            rows = around
            out.block(2)
            continue
        if name in ("ul", "ol", "menu") and lists:
            out.end_line()
            out.indent = lists.pop()[1]
            numbers.pop()
            out.mark = ""
        elif name == "li":
            out.end_line()
            out.mark = ""
            out.indent = lists[-1][1] if lists else 0
        elif name in ("dd", "blockquote"):
            out.end_line()
            out.indent = max(0, out.indent - 2)
        elif name in ("pre", "textarea", "xmp"):
            pre -= 1
        if name in BLOCKS and not (outer and (name == "tr" or name in ROW_GROUPS)):
            out.block(1 if numbers and name in ("ul", "ol", "menu", "dl") else 2 if name in SPACED else 1)
    return "\n".join(out.taken())


def extract(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """`key` and the laid-out `text` of every page."""
    schema = T.StructType([pages.schema[key], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, source):
                texts = [render(x) for x in part.column(source).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(texts, pa.string())], [key, "text"])

    return pages.select(key, source).mapInArrow(run, schema)
