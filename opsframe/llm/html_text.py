"""Operator 6: visible text of web pages, laid out as blocks, lists and tables.

Each page is tokenized, built into a tree (with the tags that HTML lets authors leave out), and
rendered: blocks stand on lines of their own, with blank lines around those that have margins; list items get
their marks and indents; cells of a table stand in columns of one width; white space collapses, save in ``pre``.
All visible text is emitted, menus and footers too; hidden elements, scripts, styles, comments and the head are not.

Pages are independent, so this is one pass without a shuffle.

Defined cases: null html gives null text, and empty html empty text; unclosed and stray tags are mended;
unfinished tags and comments at the end are dropped; unknown elements are inline; a table cell
wider than ``MAX_COLUMN`` is shown whole but doesn't widen its column, so alignment never multiplies a
long text; a cell that spans rows shows in its first row and keeps its columns empty below; nesting of any depth is walked without recursion, and indents stop growing at ``MAX_INDENT``; null and repeated ids and urls are kept, one row out for each row in; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_COLUMN, MAX_INDENT = 60, 40
#: Rows that a cell may span, and columns of a table that cells from above can take (as HTML bounds both spans).
MAX_ROWS, MAX_TAKEN = 65_534, 1000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|"""
                    r"""<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title datalist iframe noembed noframes object audio video canvas svg math".split())
#: Blocks with a blank line around them, and other blocks.
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu blockquote pre figure table fieldset hr".split())
BLOCK = MARGIN | frozenset("html body address article aside details dialog dd div dt figcaption footer form header hgroup legend li main nav "
                           "section summary search center optgroup option tr td th thead tbody tfoot caption".split())
CLOSES_P = (BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup legend".split())) | {"hr"}
#: A start tag (left) ends an open element (middle), unless one of the elements on the right is nearer.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup", "option"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "body": ({"head"}, set()),
}
#: End tags look for their element no further up than these.
SCOPE = frozenset("table td th caption template html".split())
#: Elements that may stand in the head; any other start tag ends it.
HEAD = frozenset("head html title meta link style script base template noscript".split())


class Node:
    __slots__ = ("tag", "hidden", "start", "marked", "span", "down", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.children = tag, []
        style = _SPACE.sub("", attributes.get("style", "").lower())
        self.hidden = (tag in HIDDEN or "hidden" in attributes or "display:none" in style or "visibility:hidden" in style
                       or tag == "dialog" and "open" not in attributes)
        self.marked = "open" in attributes
        self.start = _number(attributes.get("start"), 1) if tag == "ol" else 1
        self.span = min(1000, max(1, _number(attributes.get("colspan"), 1))) if tag in ("td", "th") else 1
        down = _number(attributes.get("rowspan"), 1) if tag in ("td", "th") else 1
        self.down = min(MAX_ROWS, down) if down > 0 else MAX_ROWS if down == 0 else 1  # 0: to the end of the table


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"-?\d{1,9}", text.strip()) else default


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return found


def tree(html: str) -> Node:
    """The page's elements and texts, with implied ends put in."""
    root = Node("html", {})
    stack = [root]
    open_tags: dict[str, int] = {}

    def close(tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """End the outermost open element of ``tags`` that no element of ``stop`` parts from here."""
        if not any(open_tags.get(t) for t in tags):
            return
        cut = 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut = i
            if stack[i].tag in stop:
                break
        if cut:
            for node in stack[cut:]:
                open_tags[node.tag] -= 1
            del stack[cut:]

    at = 0
    while at < len(html):
        match = _TOKEN.search(html, at)
        text = html[at:match.start() if match else len(html)]
        if text:
            if open_tags.get("head") and not text.isspace() and stack[-1].tag == "head":
                close({"head"}, frozenset())
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not match:
            break
        at = match.end()
        end, tag, rest = match.group(1), match.group(2), match.group(3)
        if end:
            end = end.lower()
            if end == "br":
                stack[-1].children.append(Node("br", {}))
            elif open_tags.get(end):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == end:
                        for node in stack[i:]:
                            open_tags[node.tag] -= 1
                        del stack[i:]
                        break
                    if stack[i].tag in SCOPE and end not in ("table", "body", "html"):
                        break
        elif tag and match.group(4):
            tag = tag.lower()
            if tag == "html":
                continue
            if tag not in HEAD:
                close({"head"}, frozenset())
            if tag in CLOSES_P:
                close({"p"}, SCOPE | {"button"})
            if tag in IMPLIED_END:
                close(*IMPLIED_END[tag])
            node = Node(tag, _attributes(rest) if rest.strip() else {})
            stack[-1].children.append(node)
            if tag in RAW:
                until = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                inside = html[at:until.start() if until else len(html)]
                if not node.hidden:
                    node.children.append(unescape(inside))
                at = until.end() if until else len(html)
            elif tag not in VOID and not (rest.rstrip().endswith("/") and tag not in BLOCK):
                stack.append(node)
                open_tags[tag] = open_tags.get(tag, 0) + 1
    return root


class _Lines:
    """Lines of one flow of text: a page, or a table cell."""

    def __init__(self) -> None:
        self.done: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.prefix = ""

    def text(self, text: str, keep: bool, indent: str) -> None:
        if keep:
            for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end(force=True)
                if part:
                    self._put(part, indent)
            return
        parts = _SPACE.sub(" ", text)
        body = parts.strip(" ")
        if body:
            if (self.space or parts[0] == " ") and self.line:
                self.line.append(" ")
            self._put(body.replace(" ", " "), indent)
            self.space = parts[-1] == " "
        elif parts:
            self.space = True

    def _put(self, part: str, indent: str) -> None:
        if not self.line:
            if self.blank and self.done:
                self.done.append("")
            self.blank = False
            self.line.append((indent[:-len(self.prefix)] + self.prefix) if self.prefix else indent)
            self.prefix = ""
        self.line.append(part)

    def end(self, margin: bool = False, force: bool = False) -> None:
        """End the line; ``margin``: a blank line comes before what follows; ``force``: an empty line counts."""
        if self.line or force:
            self.done.append("".join(self.line).rstrip())
        self.line, self.space = [], False
        self.blank = self.blank or margin


def _placed(rows: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int]]]:
    """Rows of (text, columns, rows it spans) as (text, columns), with empty cells where one from above reaches down."""
    taken: dict[int, int] = {}  # rows for which a column is still taken
    out = []
    for row in rows:
        at, line, new = 0, [], {}
        for text, span, down in row:
            while taken.get(at):
                line.append(("", 1))
                at += 1
            line.append((text, span))
            if down > 1:
                new |= dict.fromkeys(range(at, min(at + span, MAX_TAKEN)), down)
            at += span
        out.append(line)
        taken = {c: n - 1 for c, n in (taken | new).items() if n > 1}
    return out


def _table(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (text, columns it spans) as lines with aligned columns."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for text, span in row:
            if span == 1 and len(text) <= MAX_COLUMN:
                widths[at] = max(widths.get(at, 0), len(text))
            at += span
    lines = []
    for row in rows:
        at, parts = 0, []
        for text, span in row:
            width = sum(widths.get(i, 0) for i in range(at, at + span)) + 3 * (span - 1)
            parts.append(text.ljust(min(width, MAX_COLUMN * span)))
            at += span
        lines.append(" | ".join(parts).rstrip())
    return [line for line in lines if line.strip(" |")]


def render(root: Node) -> str:
    """The visible text. Walked with a stack of (node, entered) steps."""
    page = _Lines()
    flows, indents, keeps = [page], [""], [False]
    lists: list[list] = []
    tables: list[list[list[tuple[str, int, int]]]] = []
    steps: list[tuple[Node | str, bool]] = [(root, False)]
    while steps:
        node, entered = steps.pop()
        flow = flows[-1]
        if isinstance(node, str):
            flow.text(node, keeps[-1], indents[-1])
            continue
        tag = node.tag
        if entered:
            if tag in ("td", "th") and tables:
                flow.end()
                flows.pop()
                tables[-1][-1].append((" ".join(x.strip() for x in flow.done if x.strip()), node.span, node.down))
            elif tag == "table":
                lines = _table(_placed(tables.pop()))
                flow.end()
                for line in lines:
                    flow._put(line, indents[-1])
                    flow.end()
                flow.end(margin=True)
            elif tag not in ("tr", "thead", "tbody", "tfoot"):
                flow.end(margin=tag in MARGIN and not (tag in ("ul", "ol", "menu") and len(lists) > 1))
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag in ("li", "dd", "blockquote", "ul", "ol", "menu"):
                indents.pop()
            if tag == "li":
                flow.prefix = ""
            if tag in ("pre", "textarea", "xmp"):
                keeps.pop()
            continue
        if node.hidden:
            continue
        if tag == "br":
            flow.end(force=True)
            continue
        if tag == "hr":
            flow.end(margin=True)
            flow._put("---", indents[-1])
            flow.end(margin=True)
            continue
        if tag in BLOCK or tag in ("textarea", "xmp"):
            steps.append((node, True))
            indent = indents[-1]
            if tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(_Lines())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag not in ("tr", "thead", "tbody", "tfoot"):
                flow.end(margin=tag in MARGIN and not (tag in ("ul", "ol", "menu") and lists))
            if tag == "table":
                tables.append([])
            if tag in ("ul", "ol", "menu"):
                lists.append([tag, node.start - 1])
                indents.append(indent)
            elif tag == "li":
                mark = "- "
                if lists:
                    lists[-1][1] += 1
                    mark = f"{lists[-1][1]}. " if lists[-1][0] == "ol" else "- "
                indents.append((indent + " " * len(mark)) if len(indent) < MAX_INDENT else indent[:len(indent) - len(mark)] + " " * len(mark))
                flow.prefix = mark
            elif tag in ("dd", "blockquote"):
                indents.append(indent + "  " if len(indent) < MAX_INDENT else indent)
            if tag in ("pre", "textarea", "xmp"):
                keeps.append(True)
        if tag == "details" and not node.marked:
            children = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        else:
            children = node.children
        steps.extend((c, False) for c in reversed(children))
    page.end()
    return "\n".join(page.done).strip("\n")


def extract(html: str) -> str:
    return render(tree(html))


def extracted(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(id, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else extract(x) for x in (y.as_py() for y in b.column("body"))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return (pages.select(F.col(id_col).cast("long").alias("id"), F.col(html).cast("string").alias("body"))
            .mapInArrow(run, "id long, text string"))
