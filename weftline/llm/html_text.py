"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

All text a browser would show is emitted: blocks on lines of their own, paragraphs and headings parted by a blank
line, list items with bullets or numbers and indents, table cells padded so that columns align, ``pre`` as written.
Hidden are: head, script, style, template and the like, elements with ``hidden`` or ``display:none``, what is
``visibility:hidden`` and not made visible again inside, hidden inputs, and a closed ``details`` but for its summary.
Cells span rows and columns as marked; a column is padded to its widest
cell, up to ``WIDEST`` characters, so what padding adds to a table is bounded; indents stop at ``DEEPEST`` levels.

Nulls and edge cases: a null page gives a null text, an empty page an empty text; broken markup never fails (an unclosed
tag closes with its parent, a stray end tag is ignored); nesting depth is not bounded by the Python stack; nothing is cut.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import mapped, quoted, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe noembed noframes audio video canvas datalist defs desc metadata symbol clippath annotation annotation-xml".split())
#: Block elements, with the newlines that part them from what is around.
BLOCKS = {t: 1 for t in "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav ol optgroup option section summary ul caption".split()}
BLOCKS |= {t: 2 for t in "p blockquote dl figure h1 h2 h3 h4 h5 h6 hr pre table".split()}
#: An opening tag closes these open elements, up to the nearest of the bounds.
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}), "body": ({"head"}, set()),
}
_SCOPE = frozenset("table td th caption html button object template".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_VISIBLE = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
#: A column is padded to its widest cell of up to so many characters; longer cells reach beyond it.
WIDEST = 1024
#: Levels of nesting that are indented; deeper ones stand at the same place.
DEEPEST = 32


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes), kind one of text, open, close."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", html.unescape(page[at:]), ""
            return
        m = _TOKEN.match(page, lt)
        if not m:  # a lone "<" is text
            yield "text", html.unescape(page[at : lt + 1]), ""
            at = lt + 1
            continue
        if lt > at:
            yield "text", html.unescape(page[at:lt]), ""
        at = m.end()
        if m["cdata"] is not None:
            yield "text", m["cdata"], ""
        elif m["tag"]:
            tag = m["tag"].lower()
            yield ("close" if m["end"] else "open"), tag, m["attrs"]
            if tag in RAW and not m["end"]:
                end = re.compile(f"</{tag}(?=[\\s/>])|</{tag}\\Z", re.I).search(page, at)
                stop = end.start() if end else n
                if stop > at:
                    yield "text", html.unescape(page[at:stop]) if tag in ("textarea", "title") else page[at:stop], ""
                at = stop


def tree(page: str) -> Node:
    root = Node("html", {})
    stack, open_tags = [root], {"html": 1}

    def pop_to(k: int) -> None:
        while len(stack) > k:
            open_tags[stack.pop().tag] -= 1

    def close_implied(closes: set[str], bounds: set[str]) -> None:
        if not any(open_tags.get(t) for t in closes):
            return
        lowest = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bounds:
                break
            if stack[k].tag in closes:
                lowest = k
        if lowest is not None:
            pop_to(lowest)

    def push(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        stack.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1

    for kind, name, attrs in tokens(page):
        if kind == "text":
            stack[-1].children.append(name)
            continue
        if kind == "close":
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            elif open_tags.get(name) and name != "html":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == name:
                        pop_to(k)
                        break
                    if stack[k].tag in _SCOPE and name not in _SCOPE and name not in ("tr", "tbody", "thead", "tfoot"):
                        break
            continue
        if name in ("html", "body") and open_tags.get(name):
            continue
        if name in _P_ENDERS and open_tags.get("p"):
            close_implied({"p"}, _SCOPE)
        if name in _IMPLIED:
            close_implied(*_IMPLIED[name])
        # implied parents of table parts
        if name in ("td", "th") and open_tags.get("table") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr", {})
        found = {k.lower(): html.unescape(v.strip("\"'")) if v else "" for k, v in _ATTR.findall(attrs)} if attrs else {}
        if name in VOID:
            stack[-1].children.append(Node(name, found))
        else:
            push(name, found)
            if attrs.rstrip().endswith("/") and (open_tags.get("svg") or open_tags.get("math")):
                pop_to(len(stack) - 1)
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or bool(a) and ("hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden" or "style" in a and bool(_HIDDEN.search(a["style"])))


class Writer:
    """Lines of text with collapsed white space, pending block gaps, and first and later line indents."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.space = 0, False
        self.indents: list[str] = []
        self.label = ""

    def flush(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def begin(self) -> None:
        if not self.now:
            if self.lines and self.gap > 1 and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            indent = "".join(self.indents[:DEEPEST])
            self.now.append(indent[: len(indent) - len(self.label)] + self.label if self.label else indent)
            self.label = ""

    def text(self, s: str) -> None:
        flat = _SPACE.sub(" ", s)
        if not flat:
            return
        if flat == " ":
            self.space = bool(self.now)
            return
        lead = flat[0] == " "
        body = flat.strip(" ")
        if self.now:
            if self.space or lead:
                self.now.append(" ")
        else:
            self.begin()
        self.now.append(body)
        self.space = flat[-1] == " "

    def raw(self, s: str) -> None:
        for k, line in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
            if k:
                self.line_break()
            if line:
                self.begin()
                self.now.append(line)

    def line_break(self) -> None:
        if not self.now:
            self.begin()
        self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False

    def value(self) -> str:
        self.flush()
        some = [k for k, line in enumerate(self.lines) if line.strip()]
        return "\n".join(self.lines[some[0] : some[-1] + 1]) if some else ""


def _aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table: rows of (cell text, column span, row span)."""
    placed, held = [], {}  # held: columns that cells from above still take, and for how many rows
    for row in rows:
        cells, at, below = [], 0, {c: n - 1 for c, n in held.items() if n > 1}
        for text, span, down in row:
            while at in held:
                cells.append(([""], at, 1))
                at += 1
            cells.append((text.split("\n"), at, span))
            if down > 1:
                below.update(dict.fromkeys(range(at, at + span), down - 1))
            at += span
        placed.append(cells)
        held = below
    width: dict[int, int] = {}
    for cells in placed:
        for lines, at, span in cells:
            if span == 1:
                width[at] = min(WIDEST, max(width.get(at, 0), *map(len, lines)))
    out = []
    for cells in placed:
        padded = [(lines, sum(width.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1)) for lines, at, span in cells]
        for k in range(max((len(lines) for lines, _ in padded), default=0)):
            out.append("  ".join((lines[k] if k < len(lines) else "").ljust(w) for lines, w in padded).rstrip())
    return out


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1")
    return min(max(int(value), 1), 1000) if value.isdecimal() and len(value) < 5 else 1


def render(root: Node) -> str:
    writers, pre, tables = [Writer()], 0, []
    lists: list[list] = []
    work: list = [(root, False, True)]
    while work:
        node, done, shown = work.pop()
        w = writers[-1]
        if isinstance(node, str):
            if not shown:
                continue
            if tables and len(writers) == tables[-1]["depth"]:
                node = node if node.strip() else ""
            w.raw(node) if pre else w.text(node)
            continue
        tag = node.tag
        if not done:
            if hidden(node):
                continue
            if "style" in node.attrs and (found := _VISIBLE.findall(node.attrs["style"])):
                shown = found[-1].lower() == "visible"
            if tag == "br":
                w.line_break()
                continue
            if tag in VOID:
                if shown and tag == "input" and node.attrs.get("value") and node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search"):
                    w.text(node.attrs["value"])
                if tag in BLOCKS:
                    w.block(BLOCKS[tag])
                continue
            work.append((node, True, shown))
            if tag in BLOCKS:
                w.block(1 if tag in ("p", "ul", "ol", "dl") and lists and tag != "p" else BLOCKS[tag])
            if tag == "pre":
                pre += 1
            elif tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                label = "- "
                if lists and lists[-1][0] == "ol":
                    label = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                w.indents.append(" " * len(label))
                w.label = label if shown else ""
            elif tag in ("dd", "blockquote"):
                w.indents.append("  ")
            elif tag == "table":
                tables.append({"rows": [], "depth": len(writers)})
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th") and tables:
                writers.append(Writer())
            kids = node.children
            if tag == "details" and "open" not in node.attrs:
                kids = [c for c in kids if isinstance(c, Node) and c.tag == "summary"]
            work.extend((c, False, shown) for c in reversed(kids))
            continue
        if tag == "pre":
            pre -= 1
        elif tag in ("ul", "ol", "menu", "dir"):
            lists.pop()
        elif tag == "li":
            if w.label:  # an empty item still shows its mark
                w.begin()
            w.flush()
            w.indents.pop()
        elif tag in ("dd", "blockquote"):
            w.flush()
            w.indents.pop()
        elif tag in ("td", "th") and tables and len(writers) > tables[-1]["depth"]:
            text = writers.pop().value()
            if not tables[-1]["rows"]:
                tables[-1]["rows"].append([])
            tables[-1]["rows"][-1].append((text, _span(node, "colspan"), _span(node, "rowspan")))
            w = writers[-1]
        elif tag == "table":
            for line in _aligned(tables.pop()["rows"]):
                w.block(1)
                w.begin()
                w.now.append(line)
        if tag in BLOCKS:
            w.block(1 if tag in ("ul", "ol", "dl") and lists else BLOCKS[tag])
    return writers[0].value()


def extract(page: str | None) -> str | None:
    return None if page is None else render(tree(page))


def html_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """The rows of ``pages`` with the page in ``html_col`` rendered as ``text_col`` (which it replaces if it exists)."""
    source = pages.select(*[quoted(c) for c in pages.columns if c.lower() not in (text_col.lower(), html_col.lower())], F.col(quoted(html_col)).cast("string").alias(html_col))
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page = batch.column(len(names) - 1)
            for lo, hi in slices(page):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([extract(p) for p in page.slice(lo, hi - lo).to_pylist()], pa.string())], [*names[:-1], text_col])

    schema = source.schema
    out = type(schema)([*schema.fields[:-1], type(schema.fields[-1])(text_col, schema.fields[-1].dataType)])
    return mapped(source, run, out)
