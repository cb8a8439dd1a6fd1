"""HTML to text as a browser lays it out: a tree with implied tags, visibility, blocks, lists, tables."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Never laid out.
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes object audio video canvas datalist annotation annotation-xml".split())
#: Blocks with an empty line around them, and blocks that only begin a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address center form li dt dd tr td th thead tbody tfoot caption figcaption details summary hr legend option optgroup hgroup search dialog".split())
CLOSES_P = (BLOCK - frozenset("html body li dt dd tr td th thead tbody tfoot caption legend option optgroup".split())) | {"li", "dt", "dd"}
#: A start tag closes these open elements, looking no further up than the barrier.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: What a table is made of. Anything else that stands in these, outside a cell or caption, goes before the table, as in browsers.
ROW_GROUPS = frozenset("tbody thead tfoot".split())
TABLE_PARTS = ROW_GROUPS | frozenset("caption colgroup col tr td th".split())
NO_CELL = ROW_GROUPS | frozenset("table colgroup tr".split())
IN_TABLE = frozenset("style script template".split())
#: Foreign elements: those whose text is drawn, those that may hold HTML, and the HTML tags that end others.
FOREIGN = frozenset("svg math".split())
SVG_UNSEEN = frozenset("defs symbol clippath mask pattern marker title desc metadata lineargradient radialgradient filter".split())
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
MAX_DEPTH = 200  # deeper elements are put in at this depth
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=][^\s>/=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse|initial)\b", re.I)


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _tag_end(text: str, at: int) -> int:
    """The place of the > that ends a tag; those in quotes don't count."""
    while True:
        end = text.find(">", at)
        if end < 0:
            return -1
        quote = min((q for q in (text.find('"', at, end), text.find("'", at, end)) if q >= 0), default=-1)
        if quote < 0 or text[quote - 1] not in "= \t\n":
            return end
        close = text.find(text[quote], quote + 1)
        if close < 0:
            return end
        at = close + 1


def tokens(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes); kinds: text, start, end. One pass over the text."""
    at, n, lower, drawing = 0, len(text), None, False
    while at < n:
        lt = text.find("<", at)
        if lt < 0:
            yield "text", html.unescape(text[at:]), {}
            return
        if lt > at:
            yield "text", html.unescape(text[at:lt]), {}
        nxt = text[lt + 1 : lt + 2]
        if text.startswith("<!--", lt):
            end = text.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif nxt in ("!", "?") or (nxt == "/" and not NAME.match(text, lt + 2)):
            end = text.find(">", lt + 1)
            at = n if end < 0 else end + 1
        elif name := NAME.match(text, lt + 2 if nxt == "/" else lt + 1):
            tag, end = name[0].lower(), _tag_end(text, name.end())
            if end < 0:
                return
            at = end + 1
            if nxt == "/":
                drawing = drawing and tag != "svg"
                yield "end", tag, {}
                continue
            attrs: dict[str, str] = {}
            if end > name.end():
                for m in ATTRIBUTE.finditer(text, name.end(), end):
                    value = m[2] or ""
                    attrs.setdefault(m[1].lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value) if value else "")
                if text[end - 1] == "/":
                    attrs["/"] = ""  # closes itself, which counts in foreign elements only
            yield "start", tag, attrs
            drawing = drawing or tag == "svg"
            if tag in RAW and not (drawing and "/" in attrs):
                lower = lower if lower is not None and len(lower) == n else text.lower()
                close = lower.find(f"</{tag}", at) if len(lower) == n else text.find(f"</{tag}", at)
                close = n if close < 0 else close
                if tag in ("textarea", "title"):
                    yield "text", html.unescape(text[at:close]), {}
                at = close
        else:
            yield "text", "<", {}
            at = lt + 1


def parse(text: str) -> Element:
    root = Element("html", {})
    body: Element | None = None
    stack = [root]

    def close(names: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                last = i
                for j in range(i - 1, 0, -1):
                    if stack[j].tag in barrier or stack[j].tag not in names:
                        break
                    last = j
                del stack[last:]
                return
            if stack[i].tag in barrier or stack[i].tag == "template":
                return

    def inside_body() -> None:
        nonlocal body
        if body is None:
            body = Element("body", {})
            root.children.append(body)
            del stack[1:]
            stack.append(body)

    def open_table() -> int:
        """The place of the innermost table; 0 where there is none, or a template is within it."""
        return next((i if stack[i].tag == "table" else 0 for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("table", "template")), 0) if tables else 0

    def put(node: Element | str) -> None:
        """To the open element; what a table can't hold there goes before the table."""
        if tables and stack[-1].tag in NO_CELL and (t := open_table()):
            stack[t - 1].children.insert(-1, node)  # the open table is the last one
        else:
            stack[-1].children.append(node)

    def begin_part(t: int, name: str) -> None:
        """Close what a part of the table at t can't stand in, and begin the row of a cell."""
        keep = t + 1
        if name in ("tr", "td", "th"):
            keep += len(stack) > keep and stack[keep].tag in ROW_GROUPS
        if name in ("td", "th"):
            if len(stack) > keep and stack[keep].tag == "tr":
                keep += 1
            else:
                del stack[keep:]
                row = Element("tr", {})
                stack[-1].children.append(row)
                stack.append(row)
                keep += 1
        if name == "col" and len(stack) > keep and stack[keep].tag == "colgroup":
            keep += 1
        del stack[keep:]

    tables, foreign = False, False  # whether any was met
    for kind, name, attrs in tokens(text):
        if kind == "text":
            if body is None and len(stack) == 1:
                if not name.strip():
                    continue
                inside_body()
            if not tables or stack[-1].tag not in NO_CELL:
                stack[-1].children.append(name)
            elif name.strip():
                put(name)
            elif (t := open_table()) and len(stack[t - 1].children) > 1 and isinstance(stack[t - 1].children[-2], str):
                put(name)  # goes on with the text before
        elif kind == "start":
            if name == "html":
                root.attrs = attrs | root.attrs
                continue
            if name == "body":
                inside_body()
                body.attrs = attrs | body.attrs
                continue
            if name == "head":
                if body is None:
                    head = Element("head", attrs)
                    root.children.append(head)
                    del stack[1:]
                    stack.append(head)
                continue
            if body is None and name not in HEAD_ONLY and not any(e.tag in RAW for e in stack):
                inside_body()
            if foreign and name in ENDS_FOREIGN:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in FOREIGN or stack[i].tag in HOLDS_HTML), 0)
                if at and stack[at].tag in FOREIGN:
                    del stack[at:]
            t = open_table()
            outside = t and next(e.tag for e in reversed(stack) if e.tag in TABLE_PARTS or e.tag == "table") in NO_CELL
            if t and name in TABLE_PARTS:
                begin_part(t, name)
            elif outside and name == "table":
                del stack[t:]
                t = outside = 0
            elif outside and stack[-1].tag == "colgroup" and name != "template":
                stack.pop()
            if name in IMPLIED and not (t and name in TABLE_PARTS):
                close(*IMPLIED[name])
                if name in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                    row = Element("tr", {})
                    stack[-1].children.append(row)
                    stack.append(row)
            if name in CLOSES_P:
                close({"p"}, {"table", "td", "th", "button", "object"})
            if name[0] == "h" and name[1:] in "123456" and len(name) == 2 and stack[-1].tag[0] == "h" and stack[-1].tag[1:] in "123456" and len(stack) > 1:
                stack.pop()
            if name == "a":
                close({"a"}, BLOCK)
            new = Element(name, attrs)
            if t and (name in TABLE_PARTS or name in IN_TABLE):
                stack[-1].children.append(new)
            else:
                put(new)
            tables, foreign = tables or name == "table", foreign or name in FOREIGN
            if name in VOID or len(stack) >= MAX_DEPTH or (outside and name == "form"):
                continue
            if foreign and "/" in attrs and (name in FOREIGN or any(e.tag in FOREIGN for e in stack)):
                continue
            stack.append(new)
        elif name == "br":
            inside_body()
            put(Element("br", {}))
        elif name == "head":
            if len(stack) > 1 and stack[1].tag == "head":
                del stack[1:]
        elif name not in ("html", "body"):
            barrier = {"td", "th", "table", "template"} if name not in ("table", "tr", "tbody", "thead", "tfoot") else {"table", "template"}
            barrier = barrier - {name} if name != "template" else set()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name and stack[i] is not body:
                    del stack[i:]
                    break
                if stack[i].tag in barrier or stack[i] is body:
                    if name == "p":
                        stack[-1].children.append(Element("p", {}))
                    break
    return root


def _seen(e: Element, visible: bool = True) -> bool:
    """Take what visibility hides out of the tree; whether anything is left that shows. Its value passes on to what is within."""
    if (found := VISIBILITY.findall(e.attrs.get("style", ""))):
        visible = found[-1].lower() in ("visible", "initial")
    e.children = [c for c in e.children if (visible if isinstance(c, str) else _seen(c, visible))]
    if not visible and e.tag == "q":
        e.tag = "span"  # its marks don't show
    return visible or bool(e.children)


def _shown(e: Element) -> bool:
    if e.tag in UNSEEN or "hidden" in e.attrs:
        return False
    return not (e.attrs.get("style") and HIDDEN_STYLE.search(e.attrs["style"]))


class Flow:
    """Lines of text; what comes next is held back until the gap before it is known."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.mark = ""

    def end_line(self, blank: int) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
            self.gap = 0
        self.space = False
        self.gap = max(self.gap, blank)

    def _open(self) -> None:
        if not self.line and self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if not words.strip(" "):
            self.space = self.space or bool(self.line) and bool(words)
            return
        self._open()
        if self.line and (self.space or words[0] == " "):
            self.line.append(" ")
        if not self.line and self.mark:
            self.line.append(self.mark)
            self.mark = ""
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def raw(self, s: str) -> None:
        for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.new_line()
            if part:
                self._open()
                self.line.append(part)

    def typed(self, s: str) -> None:
        """Text within a line that keeps its own lines and spaces; the first line end is not part of it."""
        if self.line and self.space:
            self.line.append(" ")
        self.space = False
        self.raw(s.replace("\r\n", "\n").removeprefix("\n"))

    def new_line(self) -> None:
        if self.line:
            self.end_line(0)
        else:
            self._open()
            self.lines.append("")

    def block(self, lines: list[str], blank: int) -> None:
        self.end_line(blank)
        if any(x.strip() for x in lines):
            self._open()
            self.lines.extend(lines)
            self.gap = blank

    def done(self) -> list[str]:
        self.end_line(0)
        return self.lines


def _number(value: str | None, least: int, most: int) -> int:
    try:
        return min(most, max(least, int(value or least)))
    except ValueError:
        return least


def _rows(e: Element) -> Iterator[Element]:
    for c in e.children:
        if isinstance(c, Element) and _shown(c):
            if c.tag == "tr":
                yield c
            elif c.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(c)


def _table(e: Element) -> list[str]:
    """Cells of one column begin at the same place; a cell with several lines keeps them in its column."""
    out: list[str] = []
    for c in e.children:
        if isinstance(c, Element) and c.tag == "caption" and _shown(c):
            out += _lines(c)
    grid, until = [], {}  # until: the row from which a column is free again
    for r, row in enumerate(_rows(e)):
        cells, col = [], 0
        for c in row.children:
            if not isinstance(c, Element) or c.tag not in ("td", "th") or not _shown(c):
                continue
            while until.get(col, 0) > r:
                col += 1
            wide, high = _number(c.attrs.get("colspan"), 1, 1000), _number(c.attrs.get("rowspan"), 1, 65534)  # as browsers limit them
            if high > 1:
                until |= {col + j: max(r + high, until.get(col + j, 0)) for j in range(wide)}
            cells.append((col, wide, _lines(c)))
            col += wide
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for col, wide, lines in cells:
            if wide == 1:
                widths[col] = max(widths.get(col, 0), *map(len, lines), 0) if lines else widths.get(col, 0)
    ends: dict[int, int] = {}
    place = 0
    for col in range(max([c + w for cells in grid for c, w, _ in cells], default=0)):
        ends[col] = place
        place += widths.get(col, 0) + 3
    for cells in grid:
        for i in range(max([len(lines) for _, _, lines in cells], default=0)):
            line = ""
            for col, _, lines in cells:
                if col:
                    line = line.ljust(ends[col] - 3)[: max(len(line), ends[col] - 3)] + " | "
                line += lines[i] if i < len(lines) else ""
            out.append(line.rstrip())
    return out


def _lines(e: Element) -> list[str]:
    flow = Flow()
    _inside(e, flow, e.tag == "pre")
    return flow.done()


def _list(e: Element) -> list[str]:
    out: list[str] = []
    number = _number(e.attrs.get("start"), -(10**6), 10**6) if e.attrs.get("start") else 1
    for c in e.children:
        if isinstance(c, str):
            if c.strip():
                out.append(SPACE.sub(" ", c).strip(" "))
        elif _shown(c):
            lines = _lines(c) if c.tag == "li" else _lines(_wrapped(c))
            if not lines:
                continue
            mark = ""
            if c.tag == "li":
                mark = f"{number}. " if e.tag == "ol" else "- "
                number += 1
            out += [(mark if i == 0 else " " * len(mark)) + x if x else "" for i, x in enumerate(lines)]
    return out


def _wrapped(e: Element) -> Element:
    w = Element("div", {})
    w.children.append(e)
    return w


def _drawn(e: Element, flow: Flow, pre: bool) -> None:
    """The text of a drawing: what stands in text elements, a line each, and HTML within it."""
    for c in e.children:
        if isinstance(c, str) or not _shown(c) or c.tag in SVG_UNSEEN:
            continue
        if c.tag in ("text", "foreignobject"):
            flow.end_line(0)
            _inside(c, flow, pre)
            flow.end_line(0)
        else:
            _drawn(c, flow, pre)


def _inside(e: Element, flow: Flow, pre: bool) -> None:
    for c in e.children:
        if isinstance(c, str):
            flow.raw(c) if pre else flow.text(c)
            continue
        tag = c.tag
        if not _shown(c):
            continue
        if tag == "br":
            flow.new_line()
        elif tag == "hr":
            flow.block(["---"], 0)
        elif tag == "table":
            flow.block(_table(c), 1)
        elif tag in ("ul", "ol", "menu"):
            flow.block(_list(c), 0 if e.tag == "li" else 1)
        elif tag == "blockquote":
            flow.block(["  " + x if x else "" for x in _lines(c)], 1)
        elif tag == "dd":
            flow.block(["    " + x if x else "" for x in _lines(c)], 0)
        elif tag == "pre":
            flow.block(_lines(c), 1)
        elif tag == "details" and "open" not in c.attrs:
            flow.block(next((_lines(s) for s in c.children if isinstance(s, Element) and s.tag == "summary" and _shown(s)), []), 0)
        elif tag == "textarea":
            flow.typed("".join(x for x in c.children if isinstance(x, str)))
        elif tag == "svg":
            _drawn(c, flow, pre)
        elif tag == "q":
            flow.text("“")
            flow.space = False
            _inside(c, flow, pre)
            flow.line.append("”") if flow.line else None
        elif tag in BLOCK:
            blank = 1 if tag in SPACED else 0
            flow.end_line(blank)
            _inside(c, flow, pre)
            flow.end_line(blank)
        else:
            _inside(c, flow, pre)


def render(text: str | None) -> str:
    """All visible text of a page; null and empty pages give an empty text."""
    if not text:
        return ""
    return render_tree(parse(text.replace("\x00", "")))


def page_language(tree: Element) -> str | None:
    """The main part of the html element's lang attribute, lower-cased, if that is of two or three letters."""
    main = re.split("[-_]", tree.attrs.get("lang", "").strip(), maxsplit=1)[0].lower()
    return main if re.fullmatch("[a-z]{2,3}", main) else None


def render_tree(tree: Element) -> str:
    """The visible text of a parsed page; what is hidden goes from the tree."""
    _seen(tree)
    lines = _lines(tree)
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return "\n".join(lines)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [render(x.as_py()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["id", "text", "n_chars"]
        )


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text, n_chars), one row for each row of ``pages``.

    Null and empty pages give an empty text; broken markup never fails; repeated rows and
    null ids give a row each; an empty table gives an empty one. Other columns are not read.
    """
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    return (
        pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
        .mapInArrow(_render, f"id {kind}, text string, n_chars bigint").withColumnRenamed("id", id_col)
    )


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
