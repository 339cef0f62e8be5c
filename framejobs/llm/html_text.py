"""Layout-aware text of HTML pages.

A page is parsed into a tree: start tags close what they imply closed (paragraphs, list items, rows, cells, options), rows without a row tag get one,
end tags without a partner are ignored, raw text ends only at its own end tag. Elements that a browser would not show are left out. The rest is
rendered with block spacing, list markers and indentation, preformatted text as it is, and table cells in aligned columns.

Visibility is inherited: what is in an element with visibility hidden is left out, but for inner elements that are visible again. Cells keep the columns
that row and column spans leave them.

Defined results: a null page is empty; broken markup never fails; elements nest to any depth; pages with one id are rendered each. A closed <details>
shows its summary, a <select> all its options; images have no text. Text is never cut. Only blanks are limited: indentation stops at ``MAX_INDENT``,
cells wider than ``MAX_COLUMN`` do not widen their column, and cells that would begin beyond ``MAX_LINE`` follow the one before after two blanks.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Deeper lists and quotes are indented no further.
MAX_INDENT = 300
#: Columns are padded up to this width; wider cells run on. Cells are aligned up to this place of a line.
MAX_COLUMN, MAX_LINE = 80, 2000
SCHEMA = "page_id long, title string, text string, n_chars long, n_lines long, n_blocks long, n_items long, n_cells long"

_TOKEN = re.compile(
    r"""<!--(?:>|->|[\s\S]*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<"""
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDING_STYLE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
HIDDEN = frozenset("head script style template iframe noembed noframes title object audio video canvas datalist".split())
#: Not shown inside an svg or a formula.
UNDRAWN = {"svg": frozenset("defs desc metadata symbol".split()), "math": frozenset("annotation annotation-xml".split())}
#: Blank lines around a block: 2, a line of its own: 1.
BLOCK = {t: 1 for t in "address article aside body center details dialog dd div dt fieldset figcaption footer form header hgroup html li legend main nav option search section summary tr tbody thead tfoot caption".split()}
BLOCK |= {t: 2 for t in "blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split()}
#: What a start tag closes, and where the search for it stops.
_CELL, _ROW, _PART = {"td", "th"}, {"tr"}, {"thead", "tbody", "tfoot", "caption", "colgroup"}
_LIST, _TABLE = {"ul", "ol", "menu", "dir"}, {"table", "template", "html"}
IMPLIED: dict[str, tuple[set[str], set[str]]] = {
    "li": ({"li"}, _LIST | _TABLE | {"td", "th"}), "dt": ({"dt", "dd"}, {"dl", "td", "th"} | _TABLE), "dd": ({"dt", "dd"}, {"dl", "td", "th"} | _TABLE),
    "td": (_CELL, _ROW | _TABLE), "th": (_CELL, _ROW | _TABLE), "tr": (_CELL | _ROW, _TABLE), "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
} | {t: (_CELL | _ROW | _PART, _TABLE) for t in _PART}
_CLOSES_P = frozenset(BLOCK) - {"body", "html", "option", "tr", "tbody", "thead", "tfoot", "caption", "legend", "td", "th"}
_P_SCOPE = {"td", "th", "caption", "table", "button", "object", "template", "html"}


class Node:
    __slots__ = ("tag", "attrs", "inside", "shown")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.inside = tag, attrs, []
        own = _VISIBILITY.findall(attrs["style"]) if "style" in attrs else []
        self.shown = own[-1].lower() == "visible" if own else parent is None or parent.shown


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Tree:
    """Builds the tree of one page."""

    def __init__(self, page: str):
        self.root = Node("html", {})
        self.stack = [self.root]
        self.deepest = 1
        self.open: dict[str, int] = {"html": 1}
        at, find = 0, _TOKEN.match
        while at < len(page):
            m = find(page, at)
            at = m.end()
            tag = m[2] or m[4]
            if tag:
                at = self._start(tag.lower(), m[3] or m[5] or "", page, at)
            elif m[1]:
                self._end(m[1].lower())
            elif page[m.start()] != "<" or at == m.start() + 1:
                self._text(m[0])

    def _push(self, node: Node) -> None:
        self.stack[-1].inside.append(node)
        self.stack.append(node)
        self.deepest = max(self.deepest, len(self.stack))
        self.open[node.tag] = self.open.get(node.tag, 0) + 1

    def _pop_to(self, k: int) -> None:
        for n in self.stack[k:]:
            self.open[n.tag] -= 1
        del self.stack[k:]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        """Closes the outermost of the tags that is open within the scope."""
        left = sum(self.open.get(t, 0) for t in tags)
        if not left:
            return
        found = 0
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in stop:
                break
            if tag in tags:
                found, left = k, left - 1
                if not left:
                    break
        if found:
            self._pop_to(found)

    def _start(self, tag: str, attrs: str, page: str, at: int) -> int:
        if tag == "html":
            return at
        if self.open.get("head") and tag not in ("title", "meta", "link", "base", "script", "style", "noscript", "template"):
            self._close({"head"}, set())
        if tag in _CLOSES_P:
            self._close({"p"}, _P_SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        top = self.stack[-1].tag
        if tag in _CELL and self.open.get("table") and top in _PART | {"table"}:
            self._push(Node("tr", {}, self.stack[-1]))
        node = Node(tag, _attributes(attrs) if attrs else {}, self.stack[-1])
        if any(tag in inside and self.open.get(t) for t, inside in UNDRAWN.items()):
            node.attrs["hidden"] = ""
        if tag in VOID or attrs.endswith("/") and (tag in UNDRAWN or self.open.get("svg") or self.open.get("math")):
            self.stack[-1].inside.append(node)
        elif tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)[^>]*>?", re.I).search(page, at) if tag != "plaintext" else None
            text = page[at : end.start() if end else len(page)]
            node.inside.append(html.unescape(text) if tag in ("textarea", "title") else text)
            self.stack[-1].inside.append(node)
            return end.end() if end else len(page)
        else:
            self._push(node)
        return at

    def _end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].inside.append(Node("br", {}))
        elif not self.open.get(tag) or tag in ("html", "body"):
            return
        elif tag in BLOCK or tag in _CELL:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self._pop_to(k)
                    break
                if self.stack[k].tag in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "tfoot", "table"):
                    break
        else:  # an inline end tag closes nothing that is a block
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag == tag:
                    self._pop_to(k)
                    break
                if self.stack[k].tag in BLOCK or self.stack[k].tag in _CELL:
                    break

    def _text(self, text: str) -> None:
        if self.open.get("head") and not text.isspace():
            self._close({"head"}, set())
        self.stack[-1].inside.append(html.unescape(text) if "&" in text else text)


def hidden(node: Node) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or node.tag == "dialog" and "open" not in a:
        return True
    return bool(a) and ("hidden" in a or "style" in a and bool(_HIDING_STYLE.search(a["style"])))


def _number(text: str | None, default: int, least: int = 1, most: int = 1000) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return max(least, min(most, int(m[1]))) if m else default


class Page:
    """Lines of text; ``gap`` blank lines are due before the next one."""

    def __init__(self, counts: dict[str, int]):
        self.lines: list[str] = []
        self.now = ""
        self.gap = 0
        self.indent = ""
        self.marker = ""
        self.counts = counts

    def _deeper(self, by: str) -> str:
        return self.indent + by if len(self.indent) < MAX_INDENT else self.indent

    def end_line(self, gap: int = 1) -> None:
        if self.now.strip(" "):
            self._put(self.now.rstrip(" "))
        self.now = ""
        self.gap = max(self.gap, gap)

    def _put(self, line: str) -> None:
        if self.lines and self.gap > 1:
            self.lines.append("")
        mark = self.marker
        if mark:
            line = self.indent[: -len(mark)] + mark + line
            self.marker = ""
        else:
            line = self.indent + line
        self.lines.append(line)
        self.gap = 0

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if self.now.endswith(" ") or not self.now:
            text = text.lstrip(" ")
        self.now += text

    def rows(self, lines: list[str]) -> None:
        for line in lines:
            self._put(line)

    def add(self, node: Node, pre: bool = False) -> None:
        for child in node.inside:
            if isinstance(child, str):
                if not node.shown:
                    continue
                if pre:
                    first, *rest = child.expandtabs(8).replace("\r\n", "\n").split("\n")
                    self.now += first
                    for line in rest:
                        if self.now:
                            self._put(self.now.rstrip(" "))
                        elif self.lines and not self.gap:
                            self.lines.append("")
                        self.now = line
                else:
                    self.text(child)
            elif not hidden(child):
                self.element(child, pre)

    def element(self, node: Node, pre: bool) -> None:
        tag = node.tag
        gap = BLOCK.get(tag, 0)
        if gap:
            self.end_line(1 if tag in ("ul", "ol", "menu") and self.marker + self.indent else gap)
            self.counts["blocks"] += 1
        if tag == "br":
            if self.now.strip(" "):
                self.end_line(0)
            elif self.lines and self.gap < 2 and not self.marker:
                self.gap = 2
        elif tag in ("ul", "ol", "menu"):
            self.list(node, pre)
        elif tag == "table":
            self.table(node)
        elif tag in ("blockquote", "dd"):
            before, self.indent = self.indent, self._deeper("  ")
            self.add(node, pre)
            self.end_line(gap)
            self.indent = before
        elif tag == "details" and "open" not in node.attrs:
            for child in node.inside:
                if isinstance(child, Node) and child.tag == "summary":
                    self.element(child, pre)
        elif tag == "input":
            if node.shown and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                self.text(f" {node.attrs.get('value', '')} ")
        elif tag == "li":
            self.item(node, "- ", pre)
        elif tag in ("td", "th"):
            self.add(node, pre)
            self.text(" ")
        elif tag == "q":
            mark = '"' if node.shown else ""
            self.now += mark
            self.add(node, pre)
            self.now += mark
        else:
            self.add(node, pre or tag in ("pre", "textarea", "xmp", "plaintext", "listing"))
        if gap:
            self.end_line(1 if tag in ("ul", "ol", "menu") and self.indent else gap)

    def item(self, node: Node, marker: str, pre: bool) -> None:
        self.counts["items"] += 1
        self.end_line(1)
        before, self.indent, self.marker = self.indent, self._deeper(" " * len(marker)), marker if node.shown else ""
        self.add(node, pre)
        self.end_line(1)
        self.indent, self.marker = before, ""

    def list(self, node: Node, pre: bool) -> None:
        number = _number(node.attrs.get("start"), 1, -(10**9), 10**9)
        loose = Node("div", {}, node)
        for child in node.inside:
            if isinstance(child, Node) and child.tag == "li" and not hidden(child):
                self.add(loose, pre)
                loose.inside.clear()
                if node.tag == "ol":
                    number = _number(child.attrs.get("value"), number, -(10**9), 10**9)
                self.item(child, f"{number}. " if node.tag == "ol" else "- ", pre)
                number += 1
            else:
                loose.inside.append(child)
        self.add(loose, pre)

    def cell(self, node: Node) -> list[str]:
        self.counts["cells"] += 1
        inner = Page(self.counts)
        inner.add(node)
        inner.end_line()
        return inner.lines

    def table(self, node: Node) -> None:
        grid: list[list[tuple[int, int, list[str]]]] = []  # rows of (column, span, lines)
        busy: dict[int, int] = {}  # columns that cells of earlier rows reach into, and for how many rows

        def place(row: list, cell: Node) -> None:
            at = row[-1][0] + row[-1][1] if row else 0
            while busy.get(at, 0) > 0:
                at += 1
            span, down = _number(cell.attrs.get("colspan"), 1), _number(cell.attrs.get("rowspan"), 1, 0, 65_534)
            row.append((at, span, self.cell(cell)))
            if down != 1:
                fresh.update(dict.fromkeys(range(at, at + span), down - 1 if down else 65_534))

        fresh: dict[int, int] = {}

        def walk(part: Node) -> None:
            for child in part.inside:
                if isinstance(child, str):
                    if child.strip() and part.shown:
                        self.text(child)
                elif hidden(child):
                    continue
                elif child.tag == "tr":
                    row: list = []
                    for c in child.inside:
                        if isinstance(c, Node) and c.tag in _CELL:
                            if not hidden(c):
                                place(row, c)
                        elif isinstance(c, str):
                            if c.strip() and child.shown:
                                self.text(c)
                        elif not hidden(c):
                            self.element(c, False)
                    grid.append(row)
                    left = {c: n - 1 for c, n in busy.items() if n > 1}
                    busy.clear()
                    busy.update(left | fresh)
                    fresh.clear()
                elif child.tag in ("thead", "tbody", "tfoot", "colgroup"):
                    busy.clear()  # cells do not reach out of their group
                    walk(child)
                    busy.clear()
                else:
                    self.element(child, False)

        walk(node)
        self.end_line(1)
        widths = {at: 0 for row in grid for at, _, _ in row}  # columns in which a cell begins
        starts = sorted(widths)
        for at, span, lines in sorted((c for row in grid for c in row), key=lambda c: c[1]):  # narrow cells first
            width = max(map(len, lines), default=0)
            if width <= MAX_COLUMN:
                inside = starts[bisect_left(starts, at) : bisect_left(starts, at + span)]
                widths[inside[-1]] += max(0, width - sum(widths[c] + 2 for c in inside) + 2)
        begins = dict(zip(starts, accumulate((widths[c] + 2 for c in starts), initial=0), strict=False))
        for row in grid:
            out = []
            for k in range(max((len(lines) for *_, lines in row), default=0)):
                line = ""
                for at, _, lines in row:
                    if k < len(lines) and lines[k]:
                        if line or begins[at] <= MAX_LINE:
                            line = line.ljust(begins[at]) if begins[at] <= MAX_LINE and len(line) + 2 * bool(line) <= begins[at] else f"{line}  "
                        line += lines[k]
                out.append(line.rstrip(" "))
            self.rows([x for x in out if x])


def render(page: str) -> dict:
    """title, text and counts of a page."""
    counts = {"blocks": 0, "items": 0, "cells": 0}
    tree, out = Tree(page), Page(counts)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(limit + 8 * tree.deepest)  # frames of Python code need no stack of the process
    try:
        out.add(tree.root)
    finally:
        sys.setrecursionlimit(limit)
    out.end_line()
    title, look = "", [tree.root]
    while look and not title:
        node = look.pop()
        if node.tag == "title":
            title = _SPACE.sub(" ", "".join(c for c in node.inside if isinstance(c, str))).strip()
        elif node.tag != "svg":
            look += [c for c in reversed(node.inside) if isinstance(c, Node)]
    text = "\n".join(out.lines)
    return {"title": title, "text": text, "n_chars": len(text), "n_lines": len(out.lines)} | {f"n_{k}": v for k, v in counts.items()}


def page_texts(pages: DataFrame, page_id: str = "page_id", html_column: str = "html") -> DataFrame:
    """One row per page: page_id, title, text, and the numbers of characters, lines, blocks, list items and table cells."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                rows = [render(h or "") for h in part.column("html").to_pylist()]
                columns = [pa.array([r[n] for r in rows], pa.string() if n in ("title", "text") else pa.int64()) for n in names[1:]]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), *columns], names=names)

    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html_column).alias("html")).mapInArrow(run, SCHEMA)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    return page_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
