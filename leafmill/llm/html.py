"""Visible text of web pages: a tree builder with implied tags, visibility rules, and a layout of blocks, lists and tables.

A page becomes a tree as a browser would build it from sloppy markup: void elements, end tags that a start tag
implies (p, li, dt, dd, tr, td, th, option, table sections), end tags without an element, raw-text elements. Hidden
are: head, scripts, styles and other elements without a rendering; the attribute hidden; display:none and
visibility:hidden, inline or by the page's style sheets; closed dialogs; all but the summary of closed details; all but the
chosen option of a select. Of style sheets, rules outside at-rules, and in @media for all or screen and @layer, count; their
selectors may join tags, classes, ids and attributes to compounds, and these by descent or as children (others are left out);
importance, specificity and order decide. Everything else is emitted, the text of formulas and pictures' labels too: white space collapses outside
pre and textarea, blocks begin on lines of their own, paragraphs, headings, lists and tables are set apart by a blank line,
list items carry bullets or numbers and indents, and cells are aligned in columns.
"""

from __future__ import annotations

import hashlib
import html
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head title script style template noscript noembed noframes iframe object video audio canvas datalist map param source track link meta base area rp desc metadata defs symbol clippath mask annotation annotation-xml".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu hr".split())
BLOCK = APART | frozenset("html body div section article aside header footer nav main address form center details summary dialog figcaption legend li dt dd tr td th caption thead tbody tfoot option optgroup select textarea search hgroup".split())
#: A start tag of a key ends an open element of its values, up to the nearest of BARRIERS.
ENDS = (
    {t: frozenset(["p"]) for t in APART | frozenset("div section article aside header footer nav main address form center details dialog summary figcaption hgroup search dir listing".split())}
    | {"li": frozenset(["li", "p"]), "dt": frozenset(["dt", "dd", "p"]), "dd": frozenset(["dt", "dd", "p"]), "option": frozenset(["option"]), "optgroup": frozenset(["option", "optgroup"])}
    | {"td": frozenset(["td", "th", "caption"]), "th": frozenset(["td", "th", "caption"]), "tr": frozenset(["tr", "td", "th", "caption", "colgroup"])}
    | {t: frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]) for t in ("thead", "tbody", "tfoot")}
    | {"body": frozenset(["head"]), "rt": frozenset(["rt", "rp"]), "rp": frozenset(["rt", "rp"])}
)
BARRIERS = {
    "li": frozenset("ul ol menu dir table td th".split()), "dt": frozenset("dl table td th".split()), "dd": frozenset("dl table td th".split()),
    "td": frozenset(["table"]), "th": frozenset(["table"]), "tr": frozenset(["table"]), "thead": frozenset(["table"]), "tbody": frozenset(["table"]), "tfoot": frozenset(["table"]),
    "option": frozenset(["select", "datalist"]), "optgroup": frozenset(["select", "datalist"]),
}
SCOPE = frozenset("table td th caption button object html body".split())
#: Elements nested deeper become siblings at this depth, as in browsers.
MAX_DEPTH = 200
#: Columns are padded up to this width; longer cells stay whole and push what follows.
MAX_PAD = 48

_OTHER_TAG = re.compile(r"<(?:!--(?:.*?--!?>|>|->|.*\Z)|[!?][^>]*>?|/([A-Za-z][^\s/>]*)[^>]*>?)", re.S)
_START_TAG = re.compile(r"<([A-Za-z][^\s/><]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile("[{}]")
_SCREEN = re.compile(r"(?:only\s+)?(?:all|screen)", re.I)
_PART = re.compile(r"([.#]?)([A-Za-z_*][\w-]*)|\*|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")
_DECLARATION = re.compile(r"(?:\A|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; gone: it has no rendering; shown: its own visibility, None if inherited."""

    __slots__ = ("tag", "attributes", "children", "gone", "shown")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children, self.gone, self.shown = tag, attributes, [], False, None


class Tags:
    """Finds the end of start tags in one page, in time linear in it: a place from which no tag ends is remembered."""

    def __init__(self, page: str):
        self.page, self.endless, self.barren = page, set(), len(page)

    def end(self, at: int) -> int:
        """The place of the > that ends a tag whose attributes begin at a place; -1 if none does. Quoted ones don't count."""
        passed = []
        while at < self.barren:
            if (m := _STOP.search(self.page, at)) is None:
                self.barren = at
                break
            if m.group() == ">":
                return m.start()
            if m.start() in self.endless:
                break
            passed.append(m.start())
            at = self.page.find(m.group(), m.end()) + 1
            if not at:
                break
        self.endless.update(passed)
        return -1


def sheet_rules(sheet: str) -> list[tuple[str, str]]:
    """(selectors, declarations) of a style sheet's rules that hold on a screen."""
    sheet, out, at = _COMMENT.sub("", sheet), [], 0
    while m := _BRACE.search(sheet, at):
        head = sheet[at : m.start()].rsplit(";", 1)[-1].strip()  # a statement like @import ends with a semicolon
        at = m.end()
        if m.group() == "}":
            continue
        if not head.startswith("@"):
            end = sheet.find("}", at)
            end = len(sheet) if end < 0 else end
            out.append((head, sheet[at:end]))
            at = end + 1
        elif not (head[:6].lower() == "@layer" or head[:6].lower() == "@media" and any(_SCREEN.fullmatch(x.strip()) for x in head[6:].split(","))):
            depth = 1
            while depth and (m := _BRACE.search(sheet, at)):
                depth += 1 if m.group() == "{" else -1
                at = m.end()
            if depth:
                break
    return out


def compound(text: str) -> tuple | None:
    """(tag, id, classes, attributes, specificity) of a compound selector; None if it holds anything else."""
    tag, ident, classes, attributes, at = None, None, [], [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if m is None or m.group(2) and not m.group(1) and at or m.group() == "*" and at:
            return None
        if m.group(3):
            attributes.append((m.group(3).lower(), m.group(4)))
        elif m.group(1) == "#":
            ident = m.group(2)
        elif m.group(1) == ".":
            classes.append(m.group(2))
        elif m.group() != "*":
            tag = m.group(2).lower()
        at = m.end()
    return (tag, ident, frozenset(classes), tuple(attributes), (1 if ident else 0, len(classes) + len(attributes), 1 if tag else 0)) if text else None


class Styles:
    """What style sheets say on display and visibility: rules by a name that the last compound of a selector asks for."""

    def __init__(self):
        self.by_name: dict[str, list[tuple]] = {}
        self.n = 0

    def add(self, sheet: str) -> None:
        for selectors, declarations in sheet_rules(sheet):
            said = [(name.lower(), value.lower(), bool(important)) for name, value, important in _DECLARATION.findall(declarations)]
            for selector in selectors.split(",") if said else ():
                steps = re.sub(r"\s*>\s*", " > ", selector).split()
                chain = [compound(x) if x != ">" else ">" for x in steps]
                if not chain or None in chain or chain[-1] == ">" or chain[0] == ">":
                    continue
                weight = tuple(map(sum, zip(*(c[4] for c in chain if c != ">"))))
                tag, ident, classes, *_ = chain[-1]
                name = f"#{ident}" if ident else f".{min(classes)}" if classes else tag or "*"
                self.n += 1
                self.by_name.setdefault(name, []).append((chain, weight, self.n, said))

    def resolve(self, node: Node, above: list[Node]) -> None:
        """Set gone and shown of a node and all below it."""
        for child in node.children:
            if not isinstance(child, str):
                self._own(child, above)
                if not child.gone:
                    above.append(child)
                    self.resolve(child, above)
                    above.pop()

    def _own(self, node: Node, above: list[Node]) -> None:
        tag, a = node.tag, node.attributes
        node.gone = tag in UNSEEN or "hidden" in a and a["hidden"].lower() != "until-found" or tag == "dialog" and "open" not in a or tag == "input" and a.get("type", "").lower() == "hidden"
        found: dict[str, tuple] = {}
        if self.n:
            for name in {tag, "*", f"#{a.get('id', '')}", *(f".{c}" for c in a.get("class", "").split())} & self.by_name.keys():
                for chain, weight, order, said in self.by_name[name]:
                    if _matches(chain, node, above):
                        for what, value, important in said:
                            found[what] = max(found.get(what, ((),)), ((important, 0, weight, order), value))
        if "style" in a:
            for what, value, important in _DECLARATION.findall(a["style"]):
                found[what.lower()] = max(found.get(what.lower(), ((),)), ((bool(important), 1, (), 0), value.lower()))
        if "display" in found and tag not in UNSEEN and not node.gone:
            node.gone = found["display"][1] == "none"
        if "visibility" in found and found["visibility"][1] in ("visible", "hidden", "collapse"):
            node.shown = found["visibility"][1] == "visible"


def _fits(part: tuple, node: Node) -> bool:
    tag, ident, classes, attributes, _ = part
    a = node.attributes
    return (tag is None or tag == node.tag) and (ident is None or a.get("id") == ident) and (not classes or classes.issubset(a.get("class", "").split())) and all(k in a and (v is None or a[k] == v) for k, v in attributes)


def _matches(chain: list, node: Node, above: list[Node]) -> bool:
    """Whether a selector's chain ends in node. Descent takes the nearest fit, and steps back where a child's parent fails."""
    if not _fits(chain[-1], node):
        return False
    places = {len(above)}  # places of ancestors, or of node itself, that the rest of the chain may hang from
    at = len(chain) - 2
    while at >= 0 and places:
        child = chain[at] == ">"
        part = chain[at - child]
        if child:
            places = {p - 1 for p in places if p and _fits(part, above[p - 1])}
        else:
            places = {p for p in range(max(places)) if _fits(part, above[p])}
        at -= 1 + child
    return bool(places)


def parse(page: str) -> Node:
    """The tree of a page, with what is hidden marked."""
    root, styles, tags = Node("html", {}), Styles(), Tags(page)
    stack, at, begun, size = [root], 0, 0, len(page)

    def text(raw: str) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    while (at := page.find("<", at)) >= 0:
        if m := _OTHER_TAG.match(page, at):
            text(page[begun:at])
            at = begun = m.end()
            if m.group(1):
                _end(stack, m.group(1).lower())
            continue
        m = _START_TAG.match(page, at)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            at += 1
            continue
        text(page[begun:at])
        tag, raw = m.group(1).lower(), page[m.end() : end]
        at = begun = end + 1
        attributes: dict[str, str] = {}
        if "=" in raw or raw.strip(" \t\n\r\f/"):
            for a, x, y, z in _ATTRIBUTE.findall(raw):
                attributes.setdefault(a.lower(), html.unescape(x or y or z))
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            for a, x in attributes.items():
                next(n for n in stack if n.tag == tag).attributes.setdefault(a, x)
            continue
        _imply(stack, tag)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            body = page[at : end.start() if end else size]
            at = begun = end.end() if end else size
            if tag == "style":
                styles.add(body)
            elif tag in ("textarea", "title"):
                node.children.append(html.unescape(body))
        elif tag not in VOID and len(stack) < MAX_DEPTH and not (raw.endswith("/") and any(n.tag in ("svg", "math") for n in stack)):
            stack.append(node)
    text(page[begun:])
    styles.resolve(root, [root])
    return root


def _imply(stack: list[Node], tag: str) -> None:
    ends = ENDS.get(tag)
    if ends:
        barriers, cut = BARRIERS.get(tag, SCOPE), 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ends:
                cut = i
            elif stack[i].tag in barriers:
                break
        if cut:
            del stack[cut:]


def _end(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br", {}))
        return
    inside = tag in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "html", "body")
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            if tag not in ("body", "html"):
                del stack[i:]
            return
        if stack[i].tag in ("table", "td", "th") and not inside:
            break
    if tag == "p":
        stack[-1].children.append(Node("p", {}))


class Lines:
    """Collects laid-out lines: inline text with collapsing white space, line breaks, blank lines between blocks."""

    def __init__(self, tight: bool = False):
        self.lines, self.now, self.space, self.gap = [], "", False, False
        self.tight = tight  # within a list item: nested lists follow without a blank line

    def inline(self, text: str) -> None:
        parts = _SPACE.split(text)
        if not any(parts):
            self.space |= bool(self.now)
            return
        words = [p for p in parts if p]
        lead = " " if self.now and (self.space or not parts[0]) else ""
        self._begin()
        self.now += lead + " ".join(words)
        self.space = not parts[-1]

    def _begin(self) -> None:
        if not self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False

    def preformatted(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                self.feed(True)
            if line:
                self._begin()
                self.now += line
        self.space = False

    def feed(self, forced: bool = False) -> None:
        if self.now.strip():
            self.lines.append(self.now.rstrip())
        elif forced and self.lines:
            self.lines.append("")
        self.now, self.space = "", False

    def apart(self) -> None:
        self.feed()
        self.gap = True

    def add(self, lines: list[str]) -> None:
        self.feed()
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def done(self) -> list[str]:
        self.feed()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


def _whole(value: str | None, least: int, most: int, default: int) -> int:
    try:
        return min(most, max(least, int(value)))
    except (TypeError, ValueError):
        return default


def _seen(node: Node, seen: bool) -> bool:
    """Whether a node's own text is visible, given its parent's."""
    return seen if node.shown is None else node.shown


def _layout(node: Node, out: Lines, pre: bool, seen: bool) -> None:
    for child in node.children:
        if isinstance(child, str):
            if seen:
                (out.preformatted if pre else out.inline)(child)
        elif not child.gone:
            _element(child, out, pre, _seen(child, seen))


def _drawing(node: Node, out: Lines, seen: bool) -> None:
    """The labels of a drawing: its text elements, and pages within it. Text outside of them is not drawn."""
    for child in node.children:
        if isinstance(child, str) or child.gone:
            continue
        if child.tag in ("text", "foreignobject"):
            out.inline(" ")
            _layout(child, out, False, _seen(child, seen))
            out.inline(" ")
        else:
            _drawing(child, out, _seen(child, seen))


def _element(node: Node, out: Lines, pre: bool, seen: bool) -> None:
    tag = node.tag
    if tag == "br":
        out.feed(True)
    elif tag == "svg":
        _drawing(node, out, seen)
    elif tag == "table":
        out.apart()
        out.add(_table(node, seen))
        out.apart()
    elif tag in ("ul", "ol", "menu", "dir"):
        inner = _list(node, seen)
        if out.tight:
            out.add(inner)
        else:
            out.apart()
            out.add(inner)
            out.apart()
    elif tag == "dd":
        out.add(["  " + x if x else x for x in _lines(node, pre, seen)])
    elif tag == "blockquote":
        out.apart()
        out.add(["  " + x if x else x for x in _lines(node, pre, seen)])
        out.apart()
    elif tag in ("pre", "textarea", "listing", "xmp"):
        out.apart()
        _layout(node, out, True, seen)
        out.apart()
    elif tag == "select":
        options = [o for o in _options(node) if not o.gone]
        chosen = [o for o in options if "selected" in o.attributes] or ([] if "multiple" in node.attributes else options[:1])
        for o in options if "multiple" in node.attributes else chosen[:1]:
            out.inline(" ")
            _layout(o, out, pre, _seen(o, seen))
            out.inline(" ")
    elif tag == "input":
        kind = node.attributes.get("type", "text").lower()
        if seen and kind in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
            out.inline(f" {node.attributes.get('value', '')} ")
    elif tag == "details" and "open" not in node.attributes:
        out.feed()
        summary = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None)
        if summary is not None and not summary.gone:
            _layout(summary, out, pre, _seen(summary, seen))
        out.feed()
    elif tag in APART:
        out.apart()
        _layout(node, out, pre, seen)
        out.apart()
    elif tag in BLOCK:
        out.feed()
        _layout(node, out, pre, seen)
        out.feed()
    else:
        _layout(node, out, pre, seen)


def _lines(node: Node, pre: bool, seen: bool) -> list[str]:
    out = Lines(node.tag == "li")
    _layout(node, out, pre, seen)
    return out.done()


def _options(node: Node) -> list[Node]:
    found = []
    for c in node.children:
        if isinstance(c, Node):
            found += [c] if c.tag == "option" else _options(c)
    return found


def _list(node: Node, seen: bool) -> list[str]:
    number = _whole(node.attributes.get("start"), -(10**9), 10**9, 1)
    step = -1 if "reversed" in node.attributes else 1
    lines: list[str] = []
    loose = Node("div", {})

    def flush() -> None:
        nonlocal loose
        lines.extend("  " + x if x else x for x in _lines(loose, False, seen))
        loose = Node("div", {})

    for child in node.children:
        if not isinstance(child, Node) or child.tag != "li":
            loose.children.append(child)
            continue
        flush()
        if child.gone:
            continue
        number = _whole(child.attributes.get("value"), -(10**9), 10**9, number) if node.tag == "ol" else number
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += step
        inner = _lines(child, False, _seen(child, seen))
        if inner:
            lines.append(mark + inner[0])
            lines.extend(" " * len(mark) + x if x else x for x in inner[1:])
    flush()
    return lines


def _rows(node: Node) -> tuple[list[Node], list[Node]]:
    """(rows in order of the table's sections, captions and other children that are no rows)."""
    head, body, foot, loose = [], [], [], []
    for c in node.children:
        if isinstance(c, str):
            if c.strip():
                loose.append(Node("div", {}))
                loose[-1].children.append(c)
        elif c.gone:
            continue
        elif c.tag == "tr":
            body.append(c)
        elif c.tag in ("thead", "tbody", "tfoot"):
            rows, more = _rows(c)
            for row in rows if c.shown is not None else ():
                row.shown = c.shown if row.shown is None else row.shown
            {"thead": head, "tbody": body, "tfoot": foot}[c.tag].extend(rows)
            loose += more
        elif c.tag in ("td", "th"):
            row = Node("tr", {})
            row.children.append(c)
            body.append(row)
        elif c.tag not in ("colgroup", "col"):
            loose.append(c)
    return head + body + foot, loose


def _table(node: Node, seen: bool) -> list[str]:
    rows, loose = _rows(node)
    out: list[str] = []
    for c in loose:
        out += _lines(c, False, seen)
    grid: list[dict[int, list[str]]] = []
    spans: dict[int, int] = {}  # column -> rows that a cell from above still covers
    for row in rows:
        cells: dict[int, list[str]] = {}
        column = 0
        taken = {c for c, left in spans.items() if left > 0}
        spans = {c: left - 1 for c, left in spans.items() if left > 1}
        for c in row.children:
            if isinstance(c, str):
                if not c.strip():
                    continue
                cell = Node("td", {})
                cell.children.append(c)
                c = cell
            elif c.gone:
                continue
            while column in taken:
                column += 1
            cells[column] = _lines(c, False, _seen(row, seen) if c.shown is None else c.shown)
            wide, deep = _whole(c.attributes.get("colspan"), 1, 1000, 1), _whole(c.attributes.get("rowspan"), 1, 65534, 1)
            if deep > 1:
                for k in range(column, column + wide):
                    spans[k] = deep - 1
            column += wide
        if any(cells.values()):
            grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for k, lines in cells.items():
            width[k] = max(width.get(k, 0), min(MAX_PAD, max(map(len, lines), default=0)))
    columns = sorted(k for k, w in width.items() if w)
    for cells in grid:
        for i in range(max(map(len, cells.values()))):
            parts = [cells[k][i] if k in cells and i < len(cells[k]) else "" for k in columns]
            while parts and not parts[-1]:
                parts.pop()
            out.append("  ".join(p.ljust(width[k]) for p, k in zip(parts, columns)).rstrip())
    return out


def visible_text(page: str) -> str:
    """All visible text of a page, laid out in lines."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
    return "\n".join(_lines(parse(page), False, True))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines, n_chars, text_sha256 of every row of pages.

    A null or empty page has the text ''. Text outside any tag is visible; markup that never ends is text up to
    its end. Repeated rows are extracted each; other columns of pages are not looked at. An empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            texts = [visible_text(p) if p else "" for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in texts], pa.string()),
            ], names=["page_id", "text", "n_lines", "n_chars", "text_sha256"])

    require(pages, "page_id", "html")
    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string, n_lines long, n_chars long, text_sha256 string")


def op8_html(spark, sf_dir: str) -> DataFrame:
    """Contract query: the visible text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
