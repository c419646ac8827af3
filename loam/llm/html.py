"""Layout-aware HTML extraction: a tree with implied tags, visibility rules, and a renderer that keeps blocks, lists and table columns."""

from __future__ import annotations

import re
import sys
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import table

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_STYLE = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[{};]|(?:(?!/\*)[^{};"'])+|["']""", re.S)
_SHOWS_OR_HIDES = re.compile(r"\s*(display|visibility)\s*:\s*(.*?)\s*(!\s*important)?\s*", re.I | re.S)
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
#: Media queries that hold on every screen.
_SCREEN = re.compile(r"(?:(?:only\s+)?(?:all|screen)|not\s+(?:print|speech))?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their end tag.
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
HIDDEN = set("head script style template noscript iframe noembed noframes title datalist audio video canvas svg annotation annotation-xml".split())
#: Values of display and visibility; a declaration with another has no effect.
_VALUES = {
    "display": set("none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group table-footer-group table-column table-column-group table-caption list-item flow flow-root contents run-in ruby math initial inherit unset -webkit-box -webkit-inline-box -webkit-flex -webkit-inline-flex".split()),
    "visibility": set("visible hidden collapse initial inherit unset".split()),
}
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u span".split())
#: Elements on lines of their own, and those that a blank line parts from their neighbours.
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table caption ul xmp".split())
SPACED = set("article blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr main menu ol p pre section table ul xmp dir".split())
_ENDS_P = BLOCK - set("body html dd dt li optgroup option select legend caption".split()) | {"li", "dd", "dt"}
#: Open elements that a start tag ends, and those that shield outer ones from it.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "caption": ({"caption"}, {"table"}),
    "a": ({"a"}, {"table", "td", "th"}),
    **{x: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot")},
}
_P_SHIELDS = {"table", "td", "th", "caption", "button", "object"}
_SHIELDS = {"table", "td", "th", "caption", "template", "html"}
#: As in browsers, elements deeper than this become siblings.
DEPTH = 512
#: Cells wider than this don't widen their column.
WIDE = 120


class Node:
    __slots__ = ("tag", "raw", "children", "_attributes")

    def __init__(self, tag: str, raw: str = "") -> None:
        self.tag, self.raw, self.children, self._attributes = tag, raw, [], None

    @property
    def attributes(self) -> dict[str, str]:
        if self._attributes is None:
            self._attributes = {}
            for name, *values in _ATTRIBUTE.findall(self.raw):
                self._attributes.setdefault(name.lower(), unescape("".join(values)))
        return self._attributes

    def number(self, name: str, default: int, most: int) -> int:
        m = re.match(r"\s*\+?(\d{1,6})", self.attributes.get(name, ""))
        return min(int(m[1]), most) if m else default


class Tree:
    """The elements and texts of a page, with the tags that HTML lets authors leave out."""

    def __init__(self, html: str) -> None:
        self.root, self.styles = Node("html"), []
        self.open = [self.root]
        at = 0
        for m in iter(lambda: _TOKEN.search(html, at), None):
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2]:
                name = m[2].lower()
                if m[1]:
                    self._end(name)
                elif html[m.end() - 1 : m.end()] == ">":  # a tag that the page's end cuts off is none
                    self._start(name, m[3])
                    if name in RAW:
                        at = self._raw(name, html, at)
        self._text(html[at:])

    def _raw(self, name: str, html: str, at: int) -> int:
        m = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
        content, end = (html[at : m.start()], m.end()) if m else (html[at:], len(html))
        if name == "style":
            a = self.open[-1].attributes
            if on_screen(a.get("media", "")) and a.get("type", "").strip().lower() in ("", "text/css"):
                self.styles.append(content)
        elif name in ("textarea", "xmp"):
            self.open[-1].children.append(content if name == "xmp" else unescape(content))
        self._end(name)
        return end

    def _text(self, text: str) -> None:
        if self.open[-1].tag == "head" and text.strip():
            self.open.pop()
        self.open[-1].children.append(unescape(text) if "&" in text else text)

    def _close(self, names: set[str], shields: set[str]) -> None:
        """Ends the outermost open element of those names within the shields; a template shields everything."""
        at, found = len(self.open) - 1, None
        while at > 0 and self.open[at].tag not in shields and self.open[at].tag != "template":
            found = at if self.open[at].tag in names else found
            at -= 1
        if found is not None:
            del self.open[found:]

    def _start(self, name: str, raw: str) -> None:
        if name in ("html", "body"):
            if self.open[-1].tag == "head":
                self.open.pop()
            top = self.root if name == "html" else next((n for n in self.open if n.tag == "body"), None)
            if top is not None:
                top.raw += " " + raw
                return
        if self.open[-1].tag == "head" and name not in IN_HEAD:
            self.open.pop()
        if name in _ENDS_P:
            self._close({"p"}, _P_SHIELDS)
        if name in _ENDS:
            self._close(*_ENDS[name])
        elif name[0] == "h" and name in ("h1", "h2", "h3", "h4", "h5", "h6") and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.pop()
        if name == "table":  # straight within a table it ends that one
            within = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag in ("table", "td", "th", "caption")), 0)
            if self.open[within].tag == "table" and all(n.tag in ("table", "thead", "tbody", "tfoot", "tr", "colgroup") for n in self.open[within:]):
                del self.open[within:]
        if name in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push(Node("tr"))
        node = Node(name, raw)
        if name in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def _push(self, node: Node) -> None:
        if len(self.open) >= DEPTH:
            self.open.pop()
        self.open[-1].children.append(node)
        self.open.append(node)

    def _end(self, name: str) -> None:
        if name == "br":
            self.open[-1].children.append(Node("br"))
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag == name:
                if name in FORMATTING and any(n.tag not in FORMATTING for n in self.open[at + 1 :]):
                    del self.open[at]  # what it was wrongly nested with goes on
                else:
                    del self.open[at:]
                return
            if tag in _SHIELDS and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return
            if tag == "table" and name != "table":
                return


def on_screen(media: str) -> bool:
    """True if one of the media queries holds on every screen, of whatever size."""
    return any(_SCREEN.fullmatch(q.strip()) for q in media.split(","))


def declared(text: str) -> tuple[str, bool, bool] | None:
    """(property, hides, important) of a declaration of display or visibility."""
    if not (m := _SHOWS_OR_HIDES.fullmatch(text)):
        return None
    name, value = m[1].lower(), m[2].lower()
    if not value or not all(x in _VALUES[name] for x in value.split()):
        return None
    return name, value in ("none", "hidden", "collapse"), bool(m[3])


def rules(style: str) -> list[tuple[str, tuple[str, bool, bool]]]:
    """(selectors, declared) in order, without what stands under a condition that not every screen fulfils, or within another selector's block."""
    found, text = [], ""
    open_: list[tuple[bool, str | None]] = [(True, None)]  # whether it holds, and for what
    for m in _STYLE.finditer(style + "}"):
        token = m[0]
        if token not in ("{", "}", ";"):
            text += " " if token.startswith("/*") else token
            continue
        holds, selectors = open_[-1]
        if token == "{":
            if text.strip().startswith("@"):
                name, condition = re.match(r"(@[\w-]*)(.*)", text.strip(), re.S).groups()
                open_.append((holds and (name.lower() == "@layer" or name.lower() == "@media" and on_screen(condition)), selectors))
            else:
                open_.append((holds and selectors is None, text))
        else:
            if holds and selectors is not None and (what := declared(text)):
                found.append((selectors, what))
            if token == "}" and len(open_) > 1:
                open_.pop()
        text = ""
    return found


class Visibility:
    """What a page doesn't show, by tag, attribute, and style rules with a tag, classes and ids of the element itself.

    Of the declarations for an element the important ones win, then its own style, then rules with more ids, classes, tags, then the last.
    """

    def __init__(self, styles: list[str]) -> None:
        self.rules: dict[str, list] = {}
        for order, (selectors, what) in enumerate(x for style in styles for x in rules(style)):
            for s in selectors.split(","):
                if (m := _SIMPLE.fullmatch(s.strip())) and s.strip():
                    tag, parts = (m[1] or "*").lower(), re.findall(r"[.#][\w-]+", m[2])
                    ids = sum(x[0] == "#" for x in parts)
                    rank = (what[2], False, ids, len(parts) - ids, tag != "*", order)
                    self.rules.setdefault(parts[-1] if parts else tag, []).append((tag, set(parts), rank, what))

    def hides(self, node: Node) -> bool:
        if node.tag in HIDDEN:
            return True
        plain = not node.raw or node.raw.isspace()
        if plain and not self.rules:
            return node.tag == "dialog"
        a = {} if plain else node.attributes
        best = {"display": ((), "hidden" in a or node.tag == "dialog" and "open" not in a), "visibility": ((), False)}
        if self.rules:
            own = {"." + c for c in a.get("class", "").split()} | ({"#" + a["id"]} if "id" in a else set())
            for key in (*own, node.tag, "*"):
                for tag, parts, rank, (name, hiding, _) in self.rules.get(key, ()):
                    if rank > best[name][0] and tag in ("*", node.tag) and parts <= own:
                        best[name] = rank, hiding
        if "style" in a:
            for order, text in enumerate(a["style"].split(";")):
                if what := declared(re.sub(r"/\*.*?\*/", "", text, flags=re.S)):
                    name, hiding, important = what
                    if (rank := (important, True, 0, 0, False, order)) > best[name][0]:
                        best[name] = rank, hiding
        return best["display"][1] or best["visibility"][1]


class Lines:
    """Lines of a block: inline text gathers until something ends the line."""

    def __init__(self) -> None:
        self.lines, self.inline, self.gap = [], [], False

    def end_line(self) -> None:
        if self.inline:
            line = _SPACE.sub(" ", "".join(self.inline)).strip(" ")
            self.inline = []
            if line:
                self.put([line])

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines += lines

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced


class Renderer:
    def __init__(self, tree: Tree) -> None:
        self.hides = Visibility(tree.styles).hides

    def block(self, node: Node, depth: int = 0) -> list[str]:
        """The lines of an element's content."""
        out = Lines()
        self._children(node, out, depth)
        out.end_line()
        return out.lines

    def _children(self, node: Node, out: Lines, depth: int) -> None:
        number = node.number("start", 1, 999_999) if node.tag == "ol" else 0
        for child in node.children:
            if isinstance(child, str):
                out.inline.append(child)
                continue
            tag = child.tag
            if self.hides(child):
                continue
            if tag == "br":
                if any(not x.isspace() for x in out.inline if x):
                    out.end_line()
                else:
                    out.inline, out.gap = [], True  # what is only white space would be looked through at each br
            elif tag == "wbr" or tag == "img":
                pass
            elif tag == "input":
                if child.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                    out.inline.append(child.attributes.get("value", ""))
            elif tag == "li":
                number = child.number("value", number, 999_999) if number else 0
                self._item(child, out, f"{number}. " if number else "* ", depth)
                number += bool(number)
            elif tag in ("pre", "xmp", "textarea"):
                out.block(tag != "textarea")
                text = self._raw_text(child)
                text = text[1:] if text.startswith("\n") else text
                if text.strip():
                    out.put([x.rstrip() for x in text.rstrip().split("\n")])
                out.gap |= tag != "textarea"
            elif tag == "table":
                out.block(True)
                before, lines = self._table(child, depth)
                if before:
                    out.put(before)
                if lines:
                    out.put(lines)
                out.gap = True
            elif tag in ("td", "th"):  # outside a table
                out.inline.append(" ")
                self._children(child, out, depth)
                out.inline.append(" ")
            elif tag == "tr":
                out.block(False)
                self._children(child, out, depth)
                out.end_line()
            elif tag in ("blockquote", "dd"):
                out.block(tag in SPACED)
                if lines := self.block(child, depth):
                    out.put([("  " + x).rstrip() for x in lines])
                out.gap |= tag in SPACED
            elif tag in BLOCK:
                spaced = tag in SPACED and not (depth and tag in ("ul", "ol", "menu", "dir"))
                out.block(spaced)
                self._children(child, out, depth)
                out.end_line()
                out.gap |= spaced
            else:
                self._children(child, out, depth)

    def _item(self, node: Node, out: Lines, mark: str, depth: int) -> None:
        out.block(False)
        if lines := self.block(node, depth + 1):
            out.put([mark + lines[0], *((" " * len(mark) + x).rstrip() for x in lines[1:])])

    def _raw_text(self, node: Node) -> str:
        parts = []
        for child in node.children:
            if isinstance(child, str):
                parts.append(child)
            elif not self.hides(child):
                parts.append("\n" if child.tag == "br" else self._raw_text(child))
        return "".join(parts)

    def _table(self, node: Node, depth: int) -> tuple[list[str], list[str]]:
        """(caption and what is wrongly between rows, the rows)."""
        rows, loose = [], Node("div")

        def gather(part: Node) -> None:
            for child in part.children:
                if isinstance(child, str):
                    if not child.isspace():
                        loose.children.append(child)
                elif self.hides(child):
                    continue
                elif child.tag == "tr":
                    rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not self.hides(c)])
                    loose.children += [c for c in child.children if not (isinstance(c, str) and c.isspace()) and not (isinstance(c, Node) and c.tag in ("td", "th"))]
                elif child.tag in ("thead", "tbody", "tfoot"):
                    gather(child)
                elif child.tag not in ("colgroup", "col"):
                    loose.children.append(child)

        gather(node)
        grid: list[list[tuple[int, int, list[str]]]] = []  # of each row (column, columns, lines)
        taken: dict[int, int] = {}  # column: rows that a cell above still covers
        for cells in rows:
            column, row, below = 0, [], {c: n - 1 for c, n in taken.items() if n > 1}
            for cell in cells:
                while taken.get(column, 0) > 0:
                    column += 1
                span = max(1, cell.number("colspan", 1, 1000))
                down = cell.number("rowspan", 1, 65534)
                row.append((column, span, self.block(cell, depth)))
                for c in range(column, column + span):
                    if down > 1:
                        below[c] = down - 1
                column += span
            grid.append(row)
            taken = below
        widths: dict[int, int] = {}
        measure = lambda lines: max((n for x in lines if (n := len(x)) <= WIDE), default=0)
        for row in grid:
            for column, span, lines in row:
                if span == 1:
                    widths[column] = max(widths.get(column, 0), measure(lines))
        starts, used = {}, 0
        for column in range(max(widths, default=-1) + 1):
            starts[column] = used
            used += widths[column] + 2 if widths.get(column) else 0
        lines = []
        for row in grid:
            own = []
            for k in range(max((len(x) for _, _, x in row), default=0)):
                line = ""
                for column, _, cell in row:
                    if k < len(cell) and cell[k]:
                        at = starts.get(column, used)
                        line = line.ljust(at) if len(line) + 2 <= at or not line else line + "  "
                        line += cell[k]
                own.append(line.rstrip())
            lines += own if any(own) else []
        return self.block(loose, depth) if loose.children else [], lines


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    tree = Tree(html.replace("\r\n", "\n").replace("\r", "\n"))
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20 * DEPTH))
    try:
        return "\n".join(Renderer(tree).block(tree.root))
    finally:
        sys.setrecursionlimit(limit)


def visible_text(html: Column) -> Column:
    """All text that a page shows, as lines.

    Shown is all text but that of head, script, style, template, noscript, svg, embedded media and closed dialogs, and of elements with a hidden
    attribute, or with display:none or visibility:hidden in their style or in a style rule for their tag, classes or id, where no stronger or later
    declaration shows them (see Visibility). Rules for print or for some screens only, and rules with combinators, attributes or states, don't count; what
    is within a hidden element is hidden. Blocks have their own lines; paragraphs,
    headings, lists, tables and the like have a blank line around. List items have `* ` or their number, and nested ones are indented; cells of a table
    start at common columns, for which cells of over 120 characters don't count; pre keeps its white space, and elsewhere a run of it is one space.
    Null and empty pages give an empty text, equal pages equal ones, no rows no rows; other columns aren't read; a page of any length is one task's work,
    which grows with its length; text outside any tag is shown; a tag that the end of the page cuts off is not. Nesting deeper than 512 is
    flattened. Tags that HTML lets authors leave out are implied, and stray end tags are ignored.
    """

    @F.arrow_udf("string")
    def show(pages: pa.Array) -> pa.Array:
        return pa.array([render(p) for p in pages.to_pylist()], pa.string())

    return show(html)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", visible_text(F.col("html")).alias("text"))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html": op2_html}
ORACLE_SQL: dict[str, str] = {}
