"""HTML extraction: a tree with implied tags, rendered as laid-out visible text.

The page becomes a tree first: implied end tags close paragraphs, list items, options
and table parts, stray end tags are dropped. The tree is then laid out: blocks start
lines, paragraphs and headings keep a blank line, lists are indented and numbered,
tables have aligned columns, preformatted text keeps its spaces. Nothing that a browser
would not show is emitted.

Hidden are elements that a browser does not show, ``display: none`` with all below it, and
``visibility: hidden`` but for what is made visible again below. The text of a ``textarea``
and of ``text`` elements in a drawing is shown.

Defined results: a null or empty page gives empty text and zero counts; broken markup
never fails, text is kept; rows are rendered one by one, equal rows alike; other columns
are not read. Pages are taken whole, and neither depth nor length is bounded: the tree
is walked with a stack of its own. Layout is bounded so that the output grows with the
page's text: from ``MOST_INDENT`` characters on a deeper level indents no further, and a
table whose padding would be over ``MOST_PADDING`` times its text has its rows' cells
joined without it; in more than ``MOST_NESTED`` nested tables a cell is a line.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator, Set
from dataclasses import dataclass, field
from heapq import heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldrec.llm.batches import slices

# Element names of the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "area audio base canvas clippath datalist defs desc head iframe link map mask meta metadata noscript object "
    "param pattern script source style symbol template title track video".split()
)
RAW = frozenset("script style textarea title noscript iframe".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure hr details fieldset".split())
LINED = frozenset(
    "html body div section article aside header footer nav main address li dt dd tr caption center dir form "
    "figcaption legend menu optgroup option summary thead tbody tfoot search hgroup dialog".split()
)
CLOSES_P = (SPACED | LINED) - frozenset("html body option optgroup tr thead tbody tfoot".split())
# what stands in an open head; anything else ends it
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
# what an opening tag ends, and what keeps it from looking further out
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
SCOPES = frozenset("table td th caption html".split())

_OTHER = r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?"
_QUOTED = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_TAG = r"<(/?)([a-zA-Z][^\s/>]*+)({})>"
_TOKEN = re.compile(f"{_OTHER}|{_TAG.format(_QUOTED)}|([^<]+)", re.S)
# for pages with a quote that never ends
_LENIENT = re.compile(f"{_OTHER}|{_TAG.format('[^>]*+')}|([^<]+)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANK = " \t\n\r\f"
_SPACE = re.compile(f"[{_BLANK}]+")
_NO_BOX = re.compile(r"display\s*:\s*none")
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)")

#: Bounds of the layout, see above.
MOST_INDENT, MOST_PADDING, MOST_NESTED = 64, 8, 8


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape("".join(values)))
    return out


def parse(page: str) -> Node:
    """The tree of a page; the root is ``html``. Each character is looked at a fixed
    number of times, however broken the markup."""
    root = Node("html")
    open_ = [root]
    places: dict[str, list[int]] = {}  # of every tag's open elements, the root left out
    last = page.rfind(">")
    token = _TOKEN

    def push(node: Node) -> Node:
        open_[-1].children.append(node)
        places.setdefault(node.tag, []).append(len(open_))
        open_.append(node)
        return node

    def innermost(tags: Set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: Set[str], stop: Set[str]) -> bool:
        """Close the innermost element of ``tags`` unless one of ``stop`` is further in."""
        at = innermost(tags)
        if not at or innermost(stop) > at:
            return False
        for node in reversed(open_[at:]):
            places[node.tag].pop()
        del open_[at:]
        return True

    def end_head() -> None:
        while open_[-1].tag == "head":
            places["head"].pop()
            open_.pop()

    def write(text: str) -> None:
        if open_[-1].tag == "head" and text.strip(_BLANK):
            end_head()
        open_[-1].children.append(text)

    at = 0
    while at < len(page):
        if at > last:  # no tag ends any more; a comment may go on to the end
            rest = page[at:].partition("<!--")[0]
            write(unescape(rest))
            break
        match = token.match(page, at)
        if match is None and token is _TOKEN and page[at + 1 : at + 2].strip("/").isalpha():
            token = _LENIENT
            match = token.match(page, at)
        if match is None:  # a lone angle bracket
            write("<")
            at += 1
            continue
        at = match.end()
        end, name, attributes, text = match.groups()
        if text:
            write(unescape(text) if "&" in text else text)
            continue
        if name is None:
            continue
        tag = name.lower()
        if open_[-1].tag == "head" and (tag in ("html", "body", "br") if end else tag not in IN_HEAD | {"html"}):
            end_head()
        if end:
            if tag == "p" and not places.get("p"):
                open_[-1].children.append(Node("p"))
            elif tag == "br":
                open_[-1].children.append(Node("br"))
            elif tag in SCOPES:
                close({tag}, {"table"} - {tag})
            elif tag not in ("html", "body"):
                close({tag}, SCOPES)
            continue
        if tag == "html":
            root.attributes |= _attributes(attributes)
            continue
        if tag == "head" and open_[-1].tag == "head":
            continue
        if tag in CLOSES_P:
            close({"p"}, SCOPES)
        if tag == "body":
            close({"head"}, SCOPES)
        if tag in IMPLIED:
            while close(*IMPLIED[tag]):
                pass
            if tag in ("td", "th") and open_[-1].tag in ("table", "thead", "tbody", "tfoot"):
                push(Node("tr"))
        node = push(Node(tag, _attributes(attributes) if attributes else {}))
        if tag in RAW:
            finish = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at, begin = finish.start() if finish else len(page), at
            if tag == "textarea":
                node.children.append(unescape(page[begin:at]).removeprefix("\n"))
        if tag in VOID:
            open_.pop()
            places[tag].pop()
    return root


def has_box(node: Node) -> bool:
    """Whether an element and what is below it can be shown at all."""
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a:
        return False
    if node.tag == "dialog" and "open" not in a:
        return False
    return not ("style" in a and _NO_BOX.search(a["style"].lower()))


def _visibility(node: Node, inherited: bool) -> bool:
    found = _VISIBILITY.findall(node.attributes["style"].lower()) if "style" in node.attributes else ()
    return found[-1] == "visible" if found else inherited


# ---- layout ---------------------------------------------------------------


class Lines:
    """Text laid out line by line, every line behind the current indent."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.indent = ""
        self.mark = ""
        self.current: list[str] = []
        self.gap = False
        self.space = False

    def write(self, text: str, as_is: bool) -> None:
        if as_is:
            first, *more = text.split("\n")
            self._add(first)
            for line in more:
                self.end(keep=True)
                self._add(line)
            return
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space, words = True, words[1:]
        if not words:
            return
        tail = words.endswith(" ")
        self._add((" " if self.space and self.current else "") + words.rstrip(" "))
        self.space = tail

    def _add(self, text: str) -> None:
        if text:
            self.current.append(text)

    def end(self, keep: bool = False) -> None:
        """End the line; empty ones are dropped unless they are to be kept."""
        if self.current or keep:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead, self.mark = (self.indent[: len(self.indent) - len(self.mark)] + self.mark, "")
            self.lines.append((lead + "".join(self.current)).rstrip())
        self.current, self.space = [], False

    def rows(self, rows: list[str]) -> None:
        for row in rows:
            self.current = [row]
            self.end(keep=True)


@dataclass(slots=True)
class Table:
    """Cells by row and column. Only cells are stored, and the columns that no cell of an
    earlier row reaches into, as runs; every cell takes and gives back its columns once. Of
    two that overlap the earlier one keeps them."""

    rows: list[list[tuple[int, list[str]]]] = field(default_factory=list)
    free: list[tuple[int, int]] = field(default_factory=lambda: [(0, 1 << 60)])
    held: list[tuple[int, int, int]] = field(default_factory=list)  # a heap: last row, from, upto
    fresh: list[tuple[int, int, int]] = field(default_factory=list)
    at: int = 0  # the next column of the row
    run: int = 0  # the free run to look at

    def row(self) -> None:
        y = len(self.rows)
        self.rows.append([])
        self.at = self.run = 0
        while self.held and self.held[0][0] < y:
            self._give(*heappop(self.held)[1:])
        for until, first, upto in self.fresh:
            self._take(until, first, upto)
        self.fresh = []

    def group(self) -> None:
        """Cells end with their group of rows."""
        self.free, self.held, self.fresh = [(0, 1 << 60)], [], []

    def _take(self, until: int, first: int, upto: int) -> None:
        i = max(bisect(self.free, (first, 1 << 61)) - 1, 0)
        j, kept = i, []
        while j < len(self.free) and self.free[j][0] < upto:
            a, b = self.free[j]
            if b > first:
                heappush(self.held, (until, max(a, first), min(b, upto)))
                kept += [x for x in ((a, first), (upto, b)) if x[0] < x[1]]
            else:
                kept.append((a, b))
            j += 1
        self.free[i:j] = kept

    def _give(self, first: int, upto: int) -> None:
        i = bisect(self.free, (first, upto))
        if i < len(self.free) and self.free[i][0] == upto:
            upto = self.free.pop(i)[1]
        if i and self.free[i - 1][1] == first:
            i -= 1
            first = self.free.pop(i)[0]
        self.free.insert(i, (first, upto))

    def add(self, cell: Node, lines: list[str]) -> None:
        if not self.rows:
            self.row()
        while self.free[self.run][1] <= self.at:
            self.run += 1
        self.at = max(self.at, self.free[self.run][0])
        across, down = (_number(cell.attributes.get(k), 1) for k in ("colspan", "rowspan"))
        if lines:
            self.rows[-1].append((self.at, lines))
        upto = self.at + max(1, min(across, 1000))
        if down > 1:
            self.fresh.append((len(self.rows) - 2 + min(down, 1000), self.at, upto))
        self.at = upto

    def aligned(self) -> list[str]:
        """Columns padded to their widest line, cells apart by two spaces and a bar."""
        width: dict[int, int] = {}
        text = height = 0
        for row in self.rows:
            for x, lines in row:
                width[x] = max([width.get(x, 0), *map(len, lines)])
                text += sum(map(len, lines))
            height += max((len(lines) for _, lines in row), default=0)
        shown = sorted(x for x in width if width[x])
        padded = height * sum(width[x] + 3 for x in shown) <= MOST_PADDING * text + 4096
        out = []
        for row in self.rows:
            cells = dict(row)
            if padded:
                pairs = [(cells.get(x, []), width[x]) for x in shown]
            else:
                pairs = [(lines, 0) for _, lines in row]
            for k in range(max(map(len, cells.values()), default=0)):
                line = (lines[k].ljust(n) if k < len(lines) else " " * n for lines, n in pairs if n or k < len(lines))
                out.append(" | ".join(line).rstrip())
        return out


def _number(text: str | None, default: int) -> int:
    """A span or list number; the standard ignores what is not one."""
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,9}", text.strip()) else default


@dataclass(slots=True)
class Rendered:
    text: str
    n_items: int = 0
    n_rows: int = 0
    n_cells: int = 0


def render(page: str | None) -> Rendered:
    """The visible text of a page and how many list items, table rows and cells it shows."""
    out, done = Lines(), Rendered("")
    # what is open: node, next child, and what to restore when it ends
    lists: list[list] = []
    tables: list[Table | None] = []  # None: nested too deep
    outer: list[Lines] = []
    stack: list[tuple[Node, Iterator[Node | str], bool, tuple[str, bool]]] = []
    root = parse(page or "")
    pre = drawing = lettering = 0
    seen = True

    def indented(more: str) -> str:
        return out.indent + more if len(out.indent + more) <= MOST_INDENT else out.indent

    def enter(node: Node) -> None:
        nonlocal out, pre, drawing, lettering, seen
        tag, indent = node.tag, out.indent
        before, seen = seen, _visibility(node, seen)
        state = (indent, before)
        cell = tag in ("td", "th") and bool(tables) and tables[-1] is not None
        if cell:
            outer.append(out)
            out = Lines()
            done.n_cells += seen
        elif tag == "br":
            out.end(keep=True)
        elif tag in SPACED or tag in LINED:
            out.end()
            # a list within an item follows it without a blank line
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                out.gap = True
        if tag == "hr":
            out.rows(["---"] if seen else [])
            out.gap = True
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag, _number(node.attributes.get("start"), 1)])
        elif tag == "li":
            done.n_items += seen
            mark = "- "
            if lists and lists[-1][0] == "ol":
                number = _number(node.attributes.get("value"), lists[-1][1])
                lists[-1][1], mark = number + 1, f"{number}. "
            out.indent, out.mark = indented(" " * len(mark)), mark
        elif tag in ("dd", "blockquote"):
            out.indent = indented("  ")
        elif tag == "table":
            tables.append(Table() if len(tables) < MOST_NESTED else None)
        elif tag in ("td", "th", "tr", "thead", "tbody", "tfoot") and tables and tables[-1] is None:
            out.end()
        elif tag == "tr" and tables:
            done.n_rows += seen
            tables[-1].row()
        elif tag in ("thead", "tbody", "tfoot") and tables:
            tables[-1].group()
        elif tag in ("pre", "textarea"):
            pre += 1
        elif tag == "svg":
            drawing += 1
        elif drawing and tag in ("text", "foreignobject"):
            out.end()
            lettering += 1
        stack.append((node, iter(_shown(node)), cell, state))

    def leave(node: Node, cell: bool, state: tuple[str, bool]) -> None:
        nonlocal out, pre, drawing, lettering, seen
        tag = node.tag
        indent, seen = state
        if cell:
            out.end()
            lines, out = out.lines, outer.pop()
            tables[-1].add(node, lines)
            return
        if tag in SPACED or tag in LINED:
            out.end()
        if tag == "table":
            done_table = tables.pop()
            if done_table:
                out.rows(done_table.aligned())
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag in ("pre", "textarea"):
            pre -= 1
        elif tag == "svg":
            drawing -= 1
        elif drawing and tag in ("text", "foreignobject"):
            out.end()
            lettering -= 1
        out.indent = indent
        if tag == "li":
            out.mark = ""
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            out.gap = True

    enter(root)
    while stack:
        node, children, cell, state = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            leave(node, cell, state)
        elif isinstance(child, str):
            # space between table parts is not text, nor is a drawing outside its lettering
            if not seen or drawing and not lettering:
                continue
            if node.tag not in ("table", "tr", "thead", "tbody", "tfoot") or child.strip():
                out.write(child, pre > 0)
        elif has_box(child):
            enter(child)
    out.end()
    done.text = "\n".join(out.lines).strip("\n")
    return done


def _shown(node: Node) -> list[Node | str]:
    if node.tag == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


def visible_text(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """``key``, the laid-out ``text``, and ``n_lines, n_items, n_rows, n_cells`` of every
    row of ``pages``; no shuffle."""
    rows = pages.select(pages[key].alias("key"), F.col(html).cast("string").alias("html"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in slices(batch, 1)):
            found = [render(page) for page in part.column(1).to_pylist()]
            out = {
                "key": part.column(0),
                "text": pa.array([r.text for r in found], pa.string()),
                "n_lines": pa.array([len(r.text.split("\n")) if r.text else 0 for r in found], pa.int64()),
                "n_items": pa.array([r.n_items for r in found], pa.int64()),
                "n_rows": pa.array([r.n_rows for r in found], pa.int64()),
                "n_cells": pa.array([r.n_cells for r in found], pa.int64()),
            }
            yield pa.RecordBatch.from_pydict(out)

    schema = f"key {kind}, text string, n_lines long, n_items long, n_rows long, n_cells long"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
