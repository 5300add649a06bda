"""HTML extraction by layout-aware rendering.

A tokenizer (comments, raw-text elements, character references) feeds a tree builder that supplies the tags HTML lets
authors leave out, and a renderer walks the tree and emits all visible text: blocks on lines of their own with blank
lines where browsers have margins, list markers and indentation, preformatted text as it is, and table cells padded to
aligned columns (with column and row spans). Both keep explicit stacks with constant work a tag, so depth and broken
markup cost no recursion and no repeated scans.

Elements of svg and math are told from those of HTML as browsers do: by where they stand, with self-closing tags, CDATA and
the HTML tags that end them. The text of formulas shows, and of svg that of text elements and of foreignObject; what
`use` would draw once more from a hidden element does not.

Scale: page by page, no shuffle, in Arrow batches; a page's tree is all that is held at a time.

Visibility follows elements, the hidden attribute and inline style; the rules of style sheets are not read, so an element that
only a class hides shows. Text that stands in a table outside its cells comes before the table, as in browsers.

Defined cases: null html gives null text and zeros; an empty page gives empty text; an unclosed tag or comment at the end
is dropped as browsers do; null ids and repeated rows are rendered as they come; a very long page is rendered whole, in one
task; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import table
from lexiloom.runtime import ship

# Element names of HTML by their role in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link base".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dl figure hr table fieldset".split())
BLOCK = MARGIN | frozenset(
    "address article aside body center details dialog dd dir div dt figcaption footer form header hgroup html legend li main menu nav ol "
    "optgroup option search section select summary textarea ul caption tr".split()
)
CLOSES_P = (BLOCK | frozenset(["ul", "ol"])) - frozenset(
    "p option optgroup select textarea legend figcaption body html caption tr".split()
) | frozenset(["p", "figcaption"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
GROUPS = frozenset("thead tbody tfoot".split())
SCOPES = frozenset("table td th caption template button object".split())

# Foreign elements: those whose content is HTML again, those that show nothing, and the HTML tags that end foreign content.
POINTS = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
FOREIGN_UNSEEN = {
    "svg": frozenset("title desc defs metadata symbol style script clippath mask pattern marker lineargradient radialgradient filter".split()),
    "math": frozenset("annotation annotation-xml mphantom".split()),
}
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)

# attributes by the rules of HTML: a quote opens a value only after "=", and nothing is tried twice
_VALUE = r"\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*"
_REST = rf"(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:{_VALUE})?+)?+)*+"
_TAG = re.compile(rf"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^ \t\n\f\r/>]*+)({_REST})(>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*=[ \t\n\f\r]*(?:\"([^\"]*)\"?|'([^']*)'?|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*))?+)?+")
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[ \t\n\f\r/>])", re.I)
_WHITE = re.compile(r"[ \t\n\f\r]+")
_GONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


class Node:
    """An element; ns: svg, math or empty for HTML; scope: whether it bounds the search for open elements."""

    __slots__ = ("tag", "attrs", "kids", "ns", "scope")

    def __init__(self, tag: str, attrs: dict[str, str], ns: str = ""):
        self.tag, self.attrs, self.kids, self.ns = tag, attrs, [], ns
        self.scope = tag in POINTS[ns] or (tag == "annotation-xml" and "html" in attrs.get("encoding", "").lower()) if ns else tag in SCOPES


def raw_end(page: str, tag: str, at: int) -> int:
    """Where the end tag of a raw element begins; a script that opens a comment and a script in it ends after both."""
    if tag != "script":
        end = re.compile(rf"</{tag}(?=[ \t\n\f\r/>])", re.I).search(page, at)
        return end.start() if end else len(page)
    comment = inner = False
    while m := _SCRIPT.search(page, at):
        at = m.end()
        if m.group() == "<!--":
            comment, at = True, at - 2  # its dashes may be those of -->
        elif m.group() == "-->":
            comment = inner = False
        elif not m.group(1):
            inner = comment
        elif inner:
            inner = False
        else:
            return m.start()
    return len(page)


def parse(page: str) -> Node:
    """The tree of a page; texts are str among the kids."""
    root = Node("#root", {})
    stack: list[tuple[Node, tuple]] = [(root, ())]
    # depth of the open p, li, dt or dd, option, heading, table, row group, row and cell that a new tag may close; -1: none
    near = dict.fromkeys(("p", "li", "dt", "option", "h", "table", "group", "tr", "td"), -1)
    counts: list[dict[str, int]] = [{}]
    aliens: list[dict[str, int]] = []  # open foreign elements of each unbroken run of them

    def push(tag: str, attrs: dict[str, str], kind: str | None, ns: str = "") -> None:
        node = Node(tag, attrs, ns)
        if ns:
            if not stack[-1][0].ns:
                aliens.append({})
            aliens[-1][tag] = aliens[-1].get(tag, 0) + 1
        stack[-1][0].kids.append(node)
        changed: dict[str, int] = {}
        if kind:
            changed[kind] = near[kind]
            near[kind] = len(stack)
        hide = ("li", "dt") if not ns and (tag in LISTS or tag == "dl") else ()
        if node.scope:
            hide = ("p", "li", "dt", "option", "h") + (("group", "tr", "td") if ns or tag == "table" else ()) + (("table",) if ns else ())
        for k in hide:
            changed.setdefault(k, near[k])
            near[k] = -1
        stack.append((node, tuple(changed.items())))
        if node.scope:
            counts.append({})
        elif not ns:
            counts[-1][tag] = counts[-1].get(tag, 0) + 1

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            node, changed = stack.pop()
            near.update(changed)
            if node.ns:
                aliens[-1][node.tag] -= 1
                if not stack[-1][0].ns:
                    aliens.pop()
            if node.scope:
                counts.pop()
            elif not node.ns:
                counts[-1][node.tag] -= 1

    def close(kind: str) -> None:
        if near[kind] > 0:
            pop_to(near[kind])

    def say(text: str) -> None:
        here = stack[-1][0]
        if not here.ns and (here.tag in ("table", "tr") or here.tag in GROUPS) and near["table"] > 0 and text.strip(" \t\n\f\r"):
            before = stack[near["table"] - 1][0].kids  # the table is the last of them
            before.insert(len(before) - 1, text)
        else:
            here.kids.append(text)

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            say(html.unescape(page[at : m.start()]))
        here = stack[-1][0]
        if here.ns and page.startswith("<![CDATA[", m.start()):
            at = page.find("]]>", m.start() + 9)
            here.kids.append(page[m.start() + 9 : at if at >= 0 else len(page)])
            at = at + 3 if at >= 0 else len(page)
            continue
        at = m.end()
        slash, tag, rest, ended = m.groups()
        if not tag or not ended:
            continue
        tag = tag.lower()
        if slash and here.ns and tag not in ("br", "p") and aliens[-1].get(tag, 0) > 0:
            d = len(stack) - 1
            while stack[d][0].tag != tag:
                d -= 1
            pop_to(d)
            continue
        attrs, closed = {}, False
        if not slash and rest.strip(" /\n\t\f\r"):
            for a in _ATTR.finditer(rest):
                attrs[a[1].lower()] = html.unescape(a[2] or a[3] or a[4] or "")
                closed = a.end() < len(rest)
        elif not slash:
            closed = True
        closed = closed and rest.endswith("/")
        if here.ns and not here.scope:
            if tag in BREAKOUT and (not slash or tag in ("br", "p")) or (tag == "font" and not slash and attrs.keys() & {"color", "face", "size"}):
                d = len(stack)
                while stack[d - 1][0].ns and not stack[d - 1][0].scope:
                    d -= 1
                pop_to(d)
            elif not slash:
                ns = "svg" if tag == "svg" and here.tag == "annotation-xml" else here.ns
                if closed:
                    here.kids.append(Node(tag, attrs, ns))
                else:
                    push(tag, attrs, None, ns)
                continue
        if not slash and tag in ("svg", "math"):
            if closed:
                stack[-1][0].kids.append(Node(tag, attrs, tag))
            else:
                push(tag, attrs, None, tag)
            continue
        if slash:
            kind = "td" if tag in ("td", "th") else "group" if tag in GROUPS else tag
            if tag == "br":
                stack[-1][0].kids.append(Node("br", {}))
            elif kind in ("td", "tr", "group", "table"):
                close(kind)
            elif tag in SCOPES:
                if counts and len(counts) > 1:
                    for d in range(len(stack) - 1, 0, -1):
                        if stack[d][0].scope:
                            if stack[d][0].tag == tag and not stack[d][0].ns:
                                pop_to(d)
                            break
            elif counts[-1].get(tag, 0) > 0:
                d = len(stack) - 1
                while stack[d][0].tag != tag or stack[d][0].ns:
                    d -= 1
                pop_to(d)
            continue
        kind = None
        if tag in CLOSES_P:
            close("p")
            kind = "p" if tag == "p" else None
        if tag == "li":
            close("li")
            kind = "li"
        elif tag in ("dt", "dd"):
            close("dt")
            kind = "dt"
        elif tag in ("option", "optgroup"):
            close("option")
            kind = "option" if tag == "option" else None
        elif tag in HEADINGS:
            close("h")
            kind = "h"
        elif tag == "table":
            kind = "table"
        elif near["table"] > 0 and tag in GROUPS:
            close("group")
            close("tr")
            close("td")
            kind = "group"
        elif near["table"] > 0 and tag == "tr":
            close("tr")
            kind = "tr"
        elif near["table"] > 0 and tag in ("td", "th"):
            close("td")
            if near["tr"] < 0:
                push("tr", {}, "tr")
            kind = "td"
        if tag in VOID:
            stack[-1][0].kids.append(Node(tag, attrs))
            continue
        push(tag, attrs, kind)
        if tag in RAW:
            end = raw_end(page, tag, at)
            body = page[at:end]
            if tag in ("textarea", "title"):
                body = html.unescape(body)
            stack[-1][0].kids.append(body)
            at = end
    if at < len(page):
        say(html.unescape(page[at:]))
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    if node.ns:
        if node.ns == "svg" and (a.get("display", "").strip() == "none" or a.get("visibility", "").strip() in ("hidden", "collapse")):
            return False
        return node.tag not in FOREIGN_UNSEEN[node.ns] and not _GONE.search(a.get("style", ""))
    return node.tag not in UNSEEN and not (a and ("hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or _GONE.search(a.get("style", ""))))


class Writer:
    """Lines of text with pending space, pending gap before the next line, indentation and list marker."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = 0
        self.marker = ""

    def start(self) -> None:
        if not self.now:
            if self.lines and self.gap == 2:
                self.lines.append("")
            self.gap = 0
            pad = max(0, self.indent - len(self.marker))
            self.now.append(" " * pad + self.marker)
            self.marker, self.space = "", False

    def text(self, s: str) -> None:
        s = _WHITE.sub(" ", s)
        if s.strip(" "):
            fresh = not self.now
            self.start()
            if (self.space or s[0] == " ") and not fresh:
                self.now.append(" ")
            self.now.append(s.strip(" "))
            self.space = s[-1] == " "
        elif s and self.now:
            self.space = True

    def verbatim(self, s: str) -> None:
        for i, x in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.flush(True)
            if x:
                self.start()
                self.now.append(x)

    def flush(self, empty: bool = False) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
        elif empty:
            self.lines.append("")
        self.now, self.space = [], False

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def close(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(node: Node, name: str, most: int) -> int:
    found = re.match(r"\s*(\d{1,6})", node.attrs.get(name, ""))
    return min(max(1, int(found.group(1))), most) if found else 1


def align(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table of (lines, columns, rows) cells, with columns padded to a common width."""
    placed, below = [], {}
    for row in rows:
        cells, col, after = [], 0, {c: n - 1 for c, n in below.items() if n > 1}
        for lines, across, down in row:
            while below.get(col, 0) > 0:
                col += 1
            cells.append((col, across, lines))
            if down > 1:
                after.update((c, down - 1) for c in range(col, col + across))
            col += across
        placed.append(cells)
        below = after
    width: dict[int, int] = {}
    for cells in placed:
        for col, across, lines in cells:
            if across == 1:
                width[col] = max(width.get(col, 0), max(map(len, lines), default=0))
    for col, across, lines in sorted((x for cells in placed for x in cells if x[1] > 1), key=lambda x: x[:2]):
        seen = [c for c in range(col, col + across) if width.get(c, 0)] or [col]  # what a spanning cell lacks goes to its last column
        lack = max(map(len, lines), default=0) - sum(width.get(c, 0) + 2 for c in seen) + 2
        if lack > 0:
            width[seen[-1]] = width.get(seen[-1], 0) + lack
    begins, total = {}, 0
    for col in range(max((c + a for cells in placed for c, a, _ in cells), default=0)):
        begins[col] = total
        total += width.get(col, 0) + 2 * (width.get(col, 0) > 0)
    out = []
    for cells in placed:
        for k in range(max((len(x) for _, _, x in cells), default=0)):
            line = ""
            for col, _, lines in cells:
                if k < len(lines) and lines[k]:
                    line = line.ljust(begins[col])
                    line += ("  " if line and not line.endswith(" ") else "") + lines[k]
            out.append(line.rstrip(" "))
    return out


def render(page: str) -> tuple[str, int, int]:
    """The visible text of a page, and its numbers of list items and table rows with text."""
    writers, tables, lists = [Writer()], [], []
    items = rows = pre = label = 0
    stack = [(parse(page), 0)]
    while stack:
        node, i = stack.pop()
        w = writers[-1]
        if i < len(node.kids):
            stack.append((node, i + 1))
            kid = node.kids[i]
            if isinstance(kid, str):
                if node.tag == "details" and "open" not in node.attrs:
                    continue
                if node.ns == "svg" and not label and not node.scope:
                    continue
                w.verbatim(kid) if pre else w.text(kid)
                continue
            if not visible(kid) or (kid.tag != "summary" and node.tag == "details" and "open" not in node.attrs):
                continue
            tag = kid.tag
            if kid.ns:
                if kid.ns == "svg":
                    label += tag == "text"
                    if tag == "foreignobject":
                        w.block(1)
                if tag in ("text", "mtd") or (tag == "tspan" and kid.attrs.keys() & {"x", "y", "dy"}):
                    w.text(" ")
                stack.append((kid, 0))
                continue
            if tag == "br":
                w.flush(True)
                continue
            if tag == "input":
                if kid.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                    w.text(f" {kid.attrs.get('value', '')} ")
                continue
            if tag == "select":  # shows one option
                shown, below = [], [kid]
                while below:
                    x = below.pop()
                    if x.tag == "option":
                        shown.append(x)
                    else:
                        below.extend(y for y in reversed(x.kids) if isinstance(y, Node))
                shown = [x for x in shown if "selected" in x.attrs][-1:] or shown[:1]
                w.text(" " + " ".join(y for x in shown for y in x.kids if isinstance(y, str)) + " ")
                continue
            if tag in LISTS:
                w.block(1 if lists else 2)
                lists.append([tag, _span(kid, "start", 10**6) if tag == "ol" else 1])
                w.indent += 4 if tag == "ol" else 2
            elif tag == "li":
                w.block(1)
                if not lists:
                    w.indent += 2
                items += 1
                w.marker = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                if lists:
                    lists[-1][1] += 1
            elif tag == "table":
                w.block(2)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                writers.append(Writer())
            elif tag in BLOCK:
                w.block(2 if tag in MARGIN else 1)
                w.indent += 2 * (tag in ("blockquote", "dd"))
            pre += tag in ("pre", "textarea")
            stack.append((kid, 0))
            continue
        tag = node.tag
        if node.ns:
            if node.ns == "svg":
                label -= tag == "text"
                if tag == "foreignobject":
                    w.block(1)
            if tag in ("text", "mtd"):
                w.text(" ")
            continue
        pre -= tag in ("pre", "textarea")
        if tag in LISTS:
            kind = lists.pop()[0]
            w.block(1 if lists else 2)
            w.indent -= 4 if kind == "ol" else 2
        elif tag == "li":
            w.block(1)
            w.marker = ""
            if not lists:
                w.indent -= 2
        elif tag in ("td", "th") and tables and len(writers) > 1:
            lines = writers.pop().close()
            tables[-1][-1].append((lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag == "table" and tables:
            w.flush()
            grid = tables.pop()
            rows += sum(any(c[0] for c in r) for r in grid)
            for line in align(grid):
                w.start()
                w.now.append(line)
                w.flush()
            w.block(2)
        elif tag in BLOCK and tag != "tr":
            w.block(2 if tag in MARGIN else 1)
            w.indent -= 2 * (tag in ("blockquote", "dd"))
    return "\n".join(writers[0].close()), items, rows


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, pages = batch.columns
        at = 0
        while at < len(pages):  # results of a few hundred pages at a time
            some = pages.slice(at, 256).to_pylist()
            got = [(None, 0, 0) if p is None else render(p) for p in some]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(some)), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())],
                names=["page_id", "text", "n_list_items", "n_table_rows"],
            )
            at += len(some)


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", page: str = "html") -> DataFrame:
    """page_id, text, n_list_items, n_table_rows: one row a row of pages."""
    ship(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(page).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_extract, f"page_id {kind}, text string, n_list_items long, n_table_rows long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n", -1))).otherwise(0).cast("long")
    return extract(spark, table(spark, sf_dir, "pages")).select(
        "page_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), lines.alias("n_lines"), "n_list_items", "n_table_rows", "text"
    )
