"""HTML extraction by layout: a tree with implied tags, visibility rules, and a text rendering.

All visible text is emitted. Paragraph-like blocks are set apart by a blank line, other blocks by a
line break; list items get a dash or their number and are indented by depth; table cells are
aligned in columns, with as many lines a row as its cells need, and leave room where a cell above spans
rows; preformatted text keeps its white space; everything else folds it. Elements that are not displayed
go with all they hold; what is only invisible may hold visible elements.

Nothing recurses, so depth is unbounded; each page is handled whole, at a cost that grows with its
length. Fixed limits of the layout, none of which loses text: lines of cells longer than WIDEST are not
waited for by the next column, a cell spans MOST_SPAN columns or rows at most, and a table within DEEPEST
others is written on one line. Defined results: a null or empty page gives an empty text; unclosed and stray tags, unknown
elements and broken attributes never fail; an empty table of pages gives an empty one; repeated rows
give repeated results; columns other than the page and the ones kept are not read. Head ends where
text or a tag stands that may not be in it; text in svg and math is shown, but for what only describes
or defines; HTML tags that may not stand in them end them; an object's stand-in is hidden if it ends.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import slices, tidied

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
BLANK = re.compile(r"[ \t\n\f\r]+")
HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title audio video canvas datalist param source track meta link base area".split())
#: What may stand in head; any other start tag, or text, ends it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements in svg and math that are not shown where they stand, and those set apart by a space.
UNSEEN_FOREIGN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
SPACED_FOREIGN = frozenset("svg math text foreignobject mi mn mo ms mtext".split())
#: HTML stands in these within svg and math.
HTML_IN_FOREIGN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: HTML start tags that end svg and math.
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr article section".split())
BLOCK = APART | frozenset("address aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search summary tr caption".split())
#: Start tags that end an open element of the second kind, up to the nearest of the third.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "caption", "colgroup"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "caption", "colgroup"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "caption", "colgroup"), ("table",)),
    "body": (("head",), ("html",)),
}
#: End tags close no element outside the nearest of these.
BARRIERS = frozenset(("table", "td", "th", "caption"))
MOST_SPAN = 1000
#: Lines wider than this do not widen their column.
WIDEST = 60
#: Tables around a table that is laid out.
DEEPEST = 24
#: Inputs that show their value, and what the others of them show without one.
CAPTIONS = {"submit": "Submit", "reset": "Reset", "button": "", "text": "", "search": "", "email": "", "tel": "", "url": "", "number": "", "date": "", "time": ""}


class Node:
    __slots__ = ("tag", "attributes", "children", "unseen", "spaced", "gone", "shown", "lines")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.unseen = self.spaced = self.gone = False
        self.shown = True
        self.lines: list[str] = []

    def attribute(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(next((v for v in m.groups()[1:] if v is not None), ""))
        return None

    def number(self, name: str, default: int | None) -> int | None:
        value = (self.attribute(name) or "").strip() if name in self.attributes.lower() else ""
        return int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else default

    def visible(self, inherited: bool) -> bool:
        found = VISIBILITY.findall(self.attribute("style") or "") if "visibility" in self.attributes.lower() else ()
        return found[-1].lower() == "visible" if found else inherited

    def alone(self) -> str:
        """What an element without content shows."""
        if self.tag == "img":
            return self.attribute("alt") or ""
        kind = (self.attribute("type") or "text").lower()
        value = self.attribute("value")
        return (CAPTIONS[kind] if value is None else value) if kind in CAPTIONS else ""

    def hidden(self) -> bool:
        if self.unseen or self.tag in UNSEEN:
            return True
        low = self.attributes.lower()
        if not low:
            return self.tag == "dialog"
        if "hidden" in low and (self.attribute("hidden") is not None or (self.tag == "input" and (self.attribute("type") or "").lower() == "hidden")):
            return True
        if self.tag == "dialog" and self.attribute("open") is None:
            return True
        return "style" in low and bool(HIDING.search(self.attribute("style") or ""))


def parse(page: str) -> Node:
    """The tree of a page; implied ends are put in, and a row where a cell has none."""
    root = Node("#root")
    stack = [root]
    foreign = [False]  # for each open element, whether what it holds is svg or math
    held: Counter[str] = Counter()  # open elements by tag, so that no search is for nothing
    at = 0

    def push(node: Node) -> None:
        stack.append(node)
        foreign.append(node.tag in ("svg", "math") or (foreign[-1] and node.tag not in HTML_IN_FOREIGN))
        held[node.tag] += 1

    def cut(k: int) -> None:
        held.subtract(n.tag for n in stack[k:])
        del stack[k:], foreign[k:]

    def close(tags: Sequence[str], within: Sequence[str]) -> None:
        if not any(held[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in within:
                return
            if stack[k].tag in tags:
                cut(k)
                return

    def put(text: str) -> None:
        if stack[-1].tag == "head" and text.strip(" \t\n\f\r"):
            cut(len(stack) - 1)
        stack[-1].children.append(text)

    last = page.rfind(">")
    while at < len(page):
        m = TOKEN.search(page, at) if at <= last else None  # without a > to come there is no tag
        if not m:
            put(html.unescape(page[at:]))
            break
        if m.start() > at:
            put(html.unescape(page[at : m.start()]))
        at = m.end()
        end, tag, attributes = m[1], (m[2] or m[4] or "").lower(), m[3] or m[5] or ""
        if end:
            end = end.lower()
            if end == "br":
                stack[-1].children.append(Node("br"))
            for k in range(len(stack) - 1, 0, -1) if held[end] else ():
                if stack[k].tag == end:
                    stack[k].unseen |= end == "object"  # one without an end does not hide what follows
                    cut(k)
                    break
                if stack[k].tag in BARRIERS and end not in ("table", "tr", "tbody", "thead", "tfoot"):
                    if end == "p":
                        stack[-1].children.append(Node("p"))
                    break
            else:
                if end == "p":  # one that ends nothing is an empty paragraph
                    stack[-1].children.append(Node("p"))
            continue
        if not tag:
            continue
        if tag in ENDS_FOREIGN:
            while foreign[-1]:
                cut(len(stack) - 1)
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            cut(len(stack) - 1)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCK:
            close(("p",), ("table", "td", "th", "button", "object"))
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if foreign[-1]:
            node.unseen = tag in UNSEEN_FOREIGN
        node.spaced = tag in ("svg", "math") or (foreign[-1] and tag in SPACED_FOREIGN)
        if foreign[-1] and attributes.rstrip().endswith("/"):
            continue
        if tag in RAW:
            found = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
            text = page[at : found.start() if found else len(page)]
            at = found.end() if found else len(page)
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            push(node)
        elif tag not in VOID and tag in BLOCK | {"a", "b", "i", "span"}:
            push(node)  # a slash does not end these
    return root


class Writer:
    """Collects text into lines; breaks asked for between blocks never add up."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.bullet = ""

    def text(self, data: str) -> None:
        words = BLANK.split(data)
        if words[0] == "" and len(words) > 1:
            self.space = True
        rest = " ".join(w for w in words if w)
        if rest:
            self._put(rest)
            self.space = words[-1] == ""

    def _put(self, data: str) -> None:
        if not self.line:
            if self.gap > 1 and self.lines:
                self.lines.append("")
            self.line.append(self.indent[: max(0, len(self.indent) - len(self.bullet))] + self.bullet)
            self.bullet = ""
        elif self.space:
            self.line.append(" ")
        self.gap, self.space = 0, False
        self.line.append(data)

    def exact(self, data: str) -> None:
        for k, piece in enumerate(data.replace("\r\n", "\n").split("\n")):
            if k:
                self.newline()
            if piece:
                self._put(piece)

    def newline(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        elif self.lines and self.gap == 0:
            self.lines.append("")
        self.space = False

    def block(self, gap: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.gap, self.space = max(self.gap, gap), False

    def result(self) -> list[str]:
        self.block(1)
        return self.lines


def flat(node: Node) -> str:
    """The visible text of an element on one line."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        if x.gone:
            continue
        if x.spaced or x.tag in BLOCK or x.tag in ("br", "td", "th"):
            out.append(" ")
            todo.append(" ")
        if x.tag in ("img", "input") and x.shown:
            out.append(x.alone())
        todo += [c for c in reversed(x.children) if x.shown or not isinstance(c, str)]
    return " ".join(w for w in BLANK.split("".join(out)) if w)


def table_rows(table: Node) -> tuple[list[list[Node | str]], list[list[tuple[int, Node | str]]]]:
    """What stands beside the rows, and each row's cells with the number of their column."""
    beside: list[list[Node | str]] = []
    rows: list[list[tuple[int, Node | str]]] = []
    taken: dict[int, int] = {}  # rows that a cell above still takes of a column
    todo: list[Node | str | None] = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if x is None:
            taken = {}  # spans end with their group
        elif isinstance(x, str):
            if table.shown and x.strip(" \t\n\f\r"):
                beside.append([x])
        elif x.gone:
            continue
        elif x.tag == "tr":
            cells: list[tuple[int, Node | str]] = []
            left = {k: n - 1 for k, n in taken.items() if n > 1}
            at = 0
            for c in x.children:
                cell = isinstance(c, Node) and c.tag in ("td", "th")
                if (c.gone if isinstance(c, Node) else not (x.shown and c.strip(" \t\n\f\r"))):
                    continue
                while at in taken:
                    at += 1
                cells.append((at, c))
                wide, high = (min(max(c.number("colspan", 1), 1), MOST_SPAN), c.number("rowspan", 1)) if cell else (1, 1)
                high = MOST_SPAN if high == 0 else min(max(high, 1), MOST_SPAN)
                if high > 1:
                    left |= dict.fromkeys(range(at, at + wide), high - 1)
                at += wide
            taken = left
            rows.append(cells)
        elif x.tag in ("tbody", "thead", "tfoot"):
            todo += [None, *reversed(x.children)]
        else:
            beside.append([x])
    return beside, rows


def table_lines(table: Node) -> list[str]:
    """Captions and text beside cells, then the rows with cells aligned in columns."""
    beside, rows = table_rows(table)
    out = [line for x in beside for line in layout(x, table.shown)]
    placed = [[(k, [line for line in layout([c], True) if line]) for k, c in cells] for cells in rows]
    width: dict[int, int] = {}
    for cells in placed:
        for k, lines in cells:
            width[k] = max([width.get(k, 0), *[len(line) for line in lines if len(line) <= WIDEST]])
    columns = max([0, *[k + 1 for k in width]])
    starts = [0] * columns
    for k in range(1, columns):
        starts[k] = starts[k - 1] + width.get(k - 1, 0) + 2
    for cells in placed:
        for n in range(max([0, *[len(lines) for _, lines in cells]])):
            line = ""
            for k, lines in cells:
                if n < len(lines):
                    line = (line.ljust(starts[k]) if len(line) + 2 <= starts[k] or not line else line + "  ") + lines[n]
            out.append(line)
    return out


def layout(nodes: list[Node | str], shown: bool = True) -> list[str]:
    """The lines of some siblings; tables within have theirs already."""
    out = Writer()
    lists: list[list] = []
    indents: list[int] = []
    pre = 0
    todo: list[tuple[Node | str, bool]] = [(x, True) for x in reversed(nodes) if shown or not isinstance(x, str)]
    while todo:
        x, entering = todo.pop()
        if isinstance(x, str):
            out.exact(x) if pre else out.text(x)
            continue
        tag = x.tag
        gap = 2 if tag in APART and not (tag in ("ul", "ol") and len(lists) > (0 if entering else 1)) else 1 if tag in BLOCK else 0
        if entering:
            if x.gone:
                continue
            if tag == "br":
                out.newline()
                continue
            if gap:
                out.block(gap)
            if x.spaced:
                out.space = True
            if tag in ("img", "input") and x.shown:
                out.text(x.alone())
            elif tag == "table":
                for line in x.lines:
                    out.block(1)
                    out._put(line)
                out.block(2)
                continue
            elif tag in ("ul", "ol", "menu", "dir"):
                back = tag == "ol" and x.attribute("reversed") is not None
                first = sum(isinstance(c, Node) and c.tag == "li" and not c.gone for c in x.children) if back else 1
                lists.append([tag, x.number("start", first) if tag == "ol" else 1, -1 if back else 1])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1]
                kind[1] = x.number("value", kind[1])
                out.bullet = (f"{kind[1]}. " if kind[0] == "ol" else "- ") if x.shown else ""
                kind[1] += kind[2]
                indents.append(len(out.bullet))
                out.indent += " " * len(out.bullet)
            elif tag == "dd":
                out.indent += "  "
            elif tag == "pre":
                pre += 1
            if tag not in VOID:
                todo.append((x, False))
                todo += [(c, True) for c in reversed(x.children) if x.shown or not isinstance(c, str)]
            elif gap:
                out.block(gap)
        else:
            if tag == "li":
                out.indent = out.indent[: len(out.indent) - indents.pop()]
                out.bullet = ""
            elif tag == "dd":
                out.indent = out.indent[:-2]
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            elif tag == "pre":
                pre -= 1
            if gap:
                out.block(gap)
            elif x.spaced or tag in ("td", "th"):
                out.space = True
    return out.result()


def render(page: str | None) -> str:
    """The visible text of a page, laid out."""
    if not page:
        return ""
    root = parse(page)
    tables: list[tuple[Node, int]] = []
    todo: list[tuple[Node, bool, int]] = [(root, True, 0)]
    while todo:
        x, shown, depth = todo.pop()
        x.gone = x.hidden()
        if x.gone:
            continue
        x.shown = x.visible(shown) if x.attributes else shown
        if x.tag == "table":
            tables.append((x, depth))
            depth += 1
        todo += [(c, x.shown, depth) for c in x.children if not isinstance(c, str)]
    for table, depth in reversed(tables):  # inner ones first
        if depth < DEEPEST:
            table.lines = table_lines(table)
        elif depth == DEEPEST:
            table.lines = [line] if (line := flat(table)) else []
    return "\n".join(layout([root])).strip("\n")


def extract(df: DataFrame, page: str = "html", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """The columns of keep and text of each row."""
    source = df.select(*keep, F.col(page).cast("string").alias("__page"))
    schema = source.drop("__page").selectExpr("*", "'' AS text").schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for a, b in slices(batch.columns[-1]):
                texts = [render(p) for p in batch.columns[-1].slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:-1]], pa.array(texts, pa.string())], names=[*keep, "text"])

    return source.mapInArrow(tidied(batches), schema)
