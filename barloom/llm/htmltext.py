"""HTML extraction: a tree builder with implied tags and visibility rules, rendered as text with its layout."""

from __future__ import annotations

import re
import unicodedata
from html import unescape

from pyspark.sql import DataFrame

from .common import with_columns_from_text

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
KEEPS_SPACE = frozenset("pre xmp plaintext listing".split())
HIDDEN = frozenset("script style template head title noscript iframe noembed noframes object audio video canvas datalist meta link".split())
MATH_HIDDEN = ("annotation", "annotation-xml")
SVG_HIDDEN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
# Inside svg and math, but for the elements that hold HTML, tags can close themselves and HTML elements end the drawing or formula.
HOLDS_HTML = ("foreignobject", "desc", "mi", "mo", "mn", "ms", "mtext", "annotation-xml")
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
SELF_CLOSING = re.compile(r"(?:^|[\s\"']|[\s\"'][^\s=\"']+|^[^\s=\"']+)/\Z")
# Elements that begin on a line of their own: with a blank line around them, or without.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre xmp plaintext listing table figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup li main menu nav optgroup option search section summary tr caption legend".split())
# A start tag ends open elements of these kinds, but none beyond the given limits.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)), "thead": (("caption",), ("table",)), "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)), "body": (("head",), ("html",)),
}
ENDS_P = (SPACED | BLOCK) - {"html", "body", "option", "optgroup", "tr", "caption", "legend"}
TABLE_PARTS = frozenset("tr td th tbody thead tfoot caption".split())
SCOPE = frozenset("html table td th caption button object template".split())
WIDEST = 80
"""Columns that a table column is padded to at most; longer cells run over, with two spaces behind them."""
LEAST_ROOM, ROOM_PER_LETTER = 1 << 20, 4
"""Spaces of indents and alignment that a page may have, so that the text of a page is no more than a small multiple of it. Beyond, lines stand without them; no text or marker is lost."""
STYLE = re.compile(r"<!--.*?(?:-->|\Z)|<style\b[^>]*+>(.*?)(?:</style|\Z)", re.S | re.I)
COMMENTS, AT_RULES = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S), re.compile(r"@[^{};]*+(?:;|\{(?:[^{}]|\{[^{}]*+\})*+\})")
RULE, SELECTOR = re.compile(r"([^{}]++)\{([^{}]*+)\}"), re.compile(r"([a-z][\w-]*+|\*)?((?:[.#][\w-]++)*+)", re.I)
WHOLE = re.compile("-?[0-9]{1,9}")


def declared(source: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a list of declarations, each as (important, value)."""
    out: dict[str, tuple[bool, str]] = {}
    for part in source.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if colon and name in ("display", "visibility"):
            value = value.strip().lower()
            important = value.endswith("important") and "!" in value
            found = important, value.partition("!")[0].strip()
            if found >= (out.get(name, (False, ""))[0], ""):
                out[name] = found
    return out


class Styles:
    """The rules of a page's style elements that set display or visibility, for selectors of one element: a tag, classes, ids. Those in at-rules aren't read."""

    def __init__(self, html: str):
        self.rules: dict[str, list[tuple]] = {}
        order = 0
        for m in STYLE.finditer(html):
            for heads, body in RULE.findall(AT_RULES.sub("", COMMENTS.sub("", m[1]))) if m[1] else ():
                found = declared(body) if ":" in body else None
                for head in map(str.strip, heads.split(",")) if found else ():
                    s = SELECTOR.fullmatch(head)
                    if not s or not head:
                        continue
                    order += 1
                    tag, parts = (s[1] or "*").lower(), re.findall("[.#][^.#]+", s[2])
                    ids, classes = frozenset(p[1:] for p in parts if p[0] == "#"), frozenset(p[1:] for p in parts if p[0] == ".")
                    key = "#" + min(ids) if ids else "." + min(classes) if classes else tag
                    self.rules.setdefault(key, []).append(((len(ids), len(classes), tag != "*", order), tag, ids, classes, found))

    def of(self, tag: str, values: dict[str, str]) -> dict[str, str]:
        """display and visibility of an element, where something sets them: its own style, the rules, the hidden attribute."""
        best: dict[str, tuple] = {"display": (False, (-1,), "none")} if "hidden" in values else {}
        if self.rules:
            own, classes = values.get("id", ""), set(values.get("class", "").split())
            for key in (tag, "*", *(["#" + own] if own else []), *("." + c for c in classes)):
                for weight, of_tag, ids, of_classes, found in self.rules.get(key, ()):
                    if of_tag in (tag, "*") and ids <= {own} and of_classes <= classes:
                        for name, (important, value) in found.items():
                            best[name] = max(best.get(name, (False, (-2,), "")), (important, weight, value))
        if "style" in values:
            for name, (important, value) in declared(values["style"]).items():
                best[name] = max(best.get(name, (False, (-2,), "")), (important, (1 << 30,), value))
        return {name: value for name, (_, _, value) in best.items()}


class Node:
    __slots__ = ("children", "display", "tag", "visible", "values")

    def __init__(self, tag: str, values: dict[str, str], display: bool, visible: bool):
        self.tag, self.values, self.display, self.visible, self.children = tag, values, display, visible, []


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(source)} if source.strip(" /\n\t") else {}


def build(html: str) -> Node:
    """The tree of a page; text is a child of type str. Whatever follows an unclosed comment or tag belongs to it, as in browsers."""
    root, styles = Node("html", {}, True, True), Styles(html)
    stack, counts = [root], {"html": 1}
    at, n = 0, len(html)

    def pop() -> None:
        counts[stack.pop().tag] -= 1

    def close(tags: tuple[str, ...], limits, innermost: bool = False) -> None:
        """Pops up to the outermost (or innermost) open element of ``tags`` that no element of ``limits`` shields."""
        found = 0
        if any(counts.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    found = i
                    if innermost:
                        break
                elif stack[i].tag in limits:
                    break
        while found and len(stack) > found:
            pop()

    while at < n:
        begin = html.find("<", at)
        if begin < 0:
            stack[-1].children.append(html[at:])
            break
        if begin > at:
            stack[-1].children.append(html[at:begin])
        after = html[begin + 1 : begin + 2]
        if after in ("!", "?"):
            comment = html.startswith("<!--", begin)
            end = html.find("-->" if comment else ">", begin + 2)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        m = TAG.match(html, begin)
        if not m:
            if not (after.isalpha() or after == "/"):
                stack[-1].children.append("<")
                at = begin + 1
                continue
            end = html.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "p" and not counts.get("p"):
                stack[-1].children.append(Node("p", {}, True, stack[-1].visible))
            elif tag not in ("html", "body"):  # what follows them still belongs to the page
                close((tag,), {"html"} if tag == "table" else {"table"} if tag in TABLE_PARTS else SCOPE - {tag}, True)
            continue
        if tag in ("html", "body") and counts.get(tag):
            continue
        foreign = (counts.get("svg") or counts.get("math")) and not any(counts.get(t) for t in HOLDS_HTML)
        if foreign and tag in BREAKS_OUT:
            while counts.get("svg") or counts.get("math"):
                pop()
            foreign = False
        if tag in ENDS_P and counts.get("p"):
            close(("p",), SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag not in HIDDEN and stack[-1].tag == "head":
            pop()
        values = attributes(m[3])
        style = styles.of(tag, values) if values or styles.rules else {}
        visible = style["visibility"] == "visible" if style.get("visibility") in ("visible", "hidden", "collapse") else stack[-1].visible
        shown = tag not in HIDDEN and tag != "input" and style.get("display") != "none" and not (tag == "dialog" and "open" not in values)
        node = Node(tag, values, shown and not (tag in SVG_HIDDEN and counts.get("svg")) and not (tag in MATH_HIDDEN and counts.get("math")), visible)
        stack[-1].children.append(node)
        if foreign and SELF_CLOSING.search(m[3]):
            continue
        if tag == "plaintext":
            node.children.append(html[at:].replace("&", "&amp;"))
            at = n
        elif tag in RAW:
            end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(html, at)
            if tag in ("textarea", "title", "xmp"):
                text = html[at : end.start() if end else n]
                node.children.append(text.replace("&", "&amp;") if tag == "xmp" else text)  # references in xmp are text
            at = n if not end else (html.find(">", end.start()) + 1 or n)
        elif tag not in VOID:
            stack.append(node)
            counts[tag] = counts.get(tag, 0) + 1
    return root


class Room:
    """How many spaces a page may still have."""

    def __init__(self, letters: int):
        self.left = LEAST_ROOM + ROOM_PER_LETTER * letters

    def spaces(self, n: int, otherwise: int = 0) -> str:
        if n > self.left:
            return " " * otherwise
        self.left -= max(0, n)
        return " " * n


class Flow:
    """Lines of one block of the page: white space collapsed, line breaks and blank lines where the layout asks for them."""

    def __init__(self, room: Room):
        self.lines, self.now, self.gap, self.indent, self.marker = [], [], 0, 0, ""
        self.space, self.room = False, room

    def text(self, s: str, keep: bool) -> None:
        if keep:
            first, *more = s.split("\n")
            self.put(first)
            for line in more:
                self.end(1, force=True)
                self.put(line)
            return
        s = SPACE.sub(" ", s)
        if s[:1] == " ":
            self.space = True
        body = s.strip(" ")
        if body:
            self.put((" " if self.space and self.now else "") + body)
            self.space = s[-1] == " "

    def put(self, s: str) -> None:
        if s:
            if not self.now and self.gap > 1 and self.lines:
                self.lines.append("")
            self.gap = 0
            self.now.append(s)

    def end(self, gap: int, force: bool = False) -> None:
        """Ends the line; gap 2 asks for a blank line before the next."""
        if self.now or force:
            self.lines.append(self.room.spaces(self.indent - len(self.marker)) + self.marker + "".join(self.now).rstrip() if self.now else "")
            self.now, self.marker = [], ""
        self.gap, self.space = max(self.gap, gap), False

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self.put(line)
            self.end(1, force=True)

    def done(self) -> list[str]:
        self.end(1)
        return self.lines


def width(s: str) -> int:
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def number(values: dict[str, str], name: str, least: int, most: int, default: int) -> int:
    """A whole number of an attribute, held to its bounds."""
    value = values.get(name, "").strip()
    return min(most, max(least, int(value))) if WHOLE.fullmatch(value) else default


class Table:
    """Rows of cells with the column each starts in; cells that span rows hold their columns in the following ones."""

    def __init__(self, flow: Flow):
        self.flow, self.loose, self.caption = flow, [], []
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.held: list[list[int]] = []  # [first column, end, rows left], by first column
        self.new: list[list[int]] = []

    def row(self) -> None:
        self.held = sorted([a, b, n - 1] for a, b, n in self.held + self.new if n > 1)
        self.new, self.at, self.column = [], 0, 0
        self.rows.append([])

    def cell(self, values: dict[str, str]) -> None:
        """Opens a cell at the first column that is free."""
        while self.at < len(self.held) and self.held[self.at][0] <= self.column:
            self.column = max(self.column, self.held[self.at][1])
            self.at += 1
        across, down = number(values, "colspan", 1, 1000, 1), number(values, "rowspan", 0, 65534, 1) or 65534
        self.start, self.span = self.column, across
        self.column += across
        if down > 1:
            self.new.append([self.start, self.column, down])
        self.open = self.start, across

    def fill(self, lines: list[str]) -> None:
        self.rows[-1].append((*self.open, lines))


def aligned(rows: list[list[tuple[int, int, list[str]]]], room: Room) -> list[str]:
    """Rows of cells (column, columns, lines): columns as wide as their widest line, WIDEST at most, two spaces between them. A cell over several columns takes their place together."""
    wide: dict[int, int] = {}
    for row in rows:
        for column, span, lines in row:
            own = min(WIDEST, max(map(width, lines), default=0)) if span == 1 else 0
            wide[column] = max(wide.get(column, 0), own)
    begins, at = {}, 0
    for column in sorted(wide):
        begins[column] = at
        at += wide[column] + 2
    out = []
    for row in rows:
        parts: list[list[tuple[int, str]]] = []
        for column, _, lines in row:
            for k, line in enumerate(lines):
                if k == len(parts):
                    parts.append([])
                if line:
                    parts[k].append((begins[column], line))
        for line in parts:
            text, used = [], 0
            for begin, part in line:
                gap = room.spaces(max(begin - used, 2 if used else 0), 2 if used else 0)
                text.append(gap + part)
                used += len(gap) + width(part)
            out.append("".join(text).rstrip())
    return out


def render(root: Node, letters: int = 0) -> str:
    """All visible text of a tree, walked with a stack of its own, so that deep pages need no deep recursion. ``letters`` is the length of the page."""
    room = Room(letters)
    flow, tables, lists, pre, svg = Flow(room), [], [], 0, 0
    todo: list[tuple] = [("open", root)]
    while todo:
        what, node, *rest = todo.pop()
        if what == "text":
            if rest[0]:
                flow.text(unescape(node), pre > 0)
            continue
        tag = node.tag
        if what == "open":
            if not node.display:
                continue
            if tag == "br":
                flow.end(1, force=True)
                continue
            if tag in BLOCK:
                flow.end(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
            todo.append(("close", node, flow.indent))
            if tag == "mtr" or (svg and (tag == "text" or (tag == "tspan" and node.values.keys() & {"x", "y", "dy"}))):
                flow.end(1)
            elif tag == "mtd":
                flow.space = True
            if tag in KEEPS_SPACE:
                pre += 1
            elif tag == "svg":
                svg += 1
            elif tag in ("ul", "ol", "menu"):
                back = tag == "ol" and "reversed" in node.values
                first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if back else 1
                lists.append([tag, number(node.values, "start", -(10**9), 10**9, first), -1 if back else 1])
            elif tag == "li":
                kind, item, step = lists[-1] if lists else ("ul", 0, 0)
                item = number(node.values, "value", -(10**9), 10**9, item)
                flow.marker = f"{item}. " if kind == "ol" else "- "
                if lists:
                    lists[-1][1] = item + step
                flow.indent += len(flow.marker)
            elif tag in ("dd", "blockquote"):
                flow.indent += 2
            elif tag == "table":
                tables.append(Table(flow))
                flow = Flow(room)
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag == "caption" and tables:
                tables[-1].loose.extend(flow.done())  # text outside the cells is shown before the table
                flow = Flow(room)
            elif tag in ("td", "th") and tables:
                if not tables[-1].rows:
                    tables[-1].row()
                tables[-1].cell(node.values)
                tables[-1].loose.extend(flow.done())
                flow = Flow(room)
            children = node.children
            if tag == "details" and "open" not in node.values:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo += [("text", c, node.visible) if isinstance(c, str) else ("open", c) for c in reversed(children)]
            continue
        if tag in ("td", "th") and tables:
            tables[-1].fill(flow.done())
            flow = Flow(room)
        elif tag == "caption" and tables:
            tables[-1].caption.extend(flow.done())
            flow = Flow(room)
        elif tag == "table":
            rest_of, table = flow.done(), tables.pop()
            flow = table.flow
            flow.end(2)
            flow.add(table.loose + rest_of + table.caption + aligned(table.rows, room))
        elif tag in KEEPS_SPACE:
            pre -= 1
        elif tag == "svg":
            svg -= 1
        elif tag == "mtr" or (svg and tag == "text"):
            flow.end(1)
        elif tag in ("ul", "ol", "menu"):
            lists.pop()
        if tag in BLOCK:
            flow.end(2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1)
        flow.indent = rest[0] if tag not in ("td", "th", "caption") else flow.indent
    lines = flow.done()
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text, all visible text of each whole page, to every row; narrow, no shuffle. A column of that name, in any case, gives way.

    Null and empty pages give ''. Malformed markup never fails: tags are implied, closed or ignored as browsers do. Repeated rows get the same
    text each, an empty table gives an empty one, and pages are rendered whole, however long or deep; only the spaces of indents and alignment
    have a bound (ROOM_PER_LETTER).
    """

    def make():
        return lambda sources: [[render(build(s), len(s)) if s else "" for s in sources]]

    return with_columns_from_text(pages, html, "text string", make, pages.columns)
