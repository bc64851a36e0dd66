"""HTML to text, laid out: a tree builder with implied tags, visibility rules, and a renderer of all visible text.

The tree builder closes what HTML leaves open (paragraphs before blocks, list items, table cells and rows, options,
definition terms), ignores end tags of what isn't open, knows void and raw-text elements, and decodes entities. Not
shown: head, scripts, styles, templates and the like, comments, `hidden`, closed dialogs and details, and what a style
attribute or the page's style sheets set to `display: none` or `visibility: hidden`: selectors of tags, classes, ids,
their compounds and descendants, by importance, specificity and order, inside `@media` only if it holds for a screen;
rules with other selectors are ignored. Blocks start lines, paragraphs and the like keep an empty line between them, list items have
bullets or numbers and are indented by depth, preformatted text keeps its spaces, and the cells of a table's columns
are padded to one width, with column and row spans observed; cells of several lines keep them. Both passes are loops, so depth is not limited.

Defined results: null gives null, empty or invisible pages give an empty text; text without tags is rendered as one
flow; pages of any length are rendered whole, in time proportional to it, broken ones too; repeated rows are rendered
each; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
GONE = frozenset("head script style template noscript title iframe object video audio canvas datalist noembed noframes svg math rp param source track meta link base".split())
LINES = frozenset("address article aside body center dd details dialog div dl dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary td th tr tbody thead tfoot caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol blockquote pre table figure hr dl menu dir xmp listing".split())
ENDS_P = (LINES | SPACED) - frozenset("html body option optgroup li td th tr tbody thead tfoot caption legend".split()) | {"li"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}

_OPEN = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{}]")
_SELECTOR = re.compile(r"(?:[\w-]+|\*)?(?:[.#][\w-]+)*")
_OFF = re.compile(r"(?<![\w-])display\s*:\s*([a-z-]+)\s*(!\s*important)?")
_SEEN = re.compile(r"(?<![\w-])visibility\s*:\s*(hidden|collapse|visible)\s*(!\s*important)?")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attrs(s: str) -> dict:
    out = {}
    for m in _ATTR.finditer(s):
        out.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return out


def _tag_end(page: str, at: int) -> int:
    """Where the `>` of a tag is whose attributes begin at `at`; -1: nowhere. A quote that nothing closes is no quote."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        close = page.find(m[0], m.end())
        if close < 0:
            return page.find(">", m.end())
        at = close + 1
    return -1


def parse(page: str) -> Node:
    """The page's tree: children are nodes and, as strings, texts."""
    root = Node("#root", {})
    stack, at, n = [root], 0, len(page)
    opened: Counter = Counter()

    def cut(k: int) -> None:
        opened.subtract(x.tag for x in stack[k:])
        del stack[k:]

    def close(tags, until) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in until:
                return
            if stack[k].tag in tags:
                cut(k)
                if not tags - {"li", "dt", "dd", "option"}:
                    return
                return close(tags, until)

    last, quoted = page.rfind(">"), True
    while at < n:
        m = _OPEN.search(page, at)
        end = -1
        if m and m[0] == "<!--":
            end = page.find("-->", m.end())
            end = n if end < 0 else end + 2
        elif m and m.end() <= last:
            end = _tag_end(page, m.end()) if m[2] and quoted else page.find(">", m.end())
            if end < 0:  # quotes that run to the page's end: from here on tags end at the next >
                quoted, end = False, page.find(">", m.end())
        if end < 0:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(page[at : m.start()]))
        at = end + 1
        if m[2] is None:
            continue
        tag, inside = m[2].lower(), page[m.end() : end]
        if m[1]:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                scope = {"table"} if tag not in ("table", "html", "body") else set()
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[k].tag == tag:
                        cut(k)
                        break
                    if stack[k].tag in scope or stack[k].tag in ("td", "th") and tag not in ("tr", "tbody", "thead", "tfoot", "table"):
                        break
            continue
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ENDS_P:
            close({"p"}, {"td", "th", "button", "table", "caption"})
        node = Node(tag, _attrs(inside) if inside.strip(" /\t\n") else {})
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\s*/?>", re.I).search(page, at)
            text = page[at : end.start() if end else n]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = end.end() if end else n
            continue
        stack.append(node)
        opened[tag] += 1
    return root


def _screen(query: str) -> bool:
    return any(not re.match(r"\s*(?:only\s+)?(?:print|speech|tty|tv|projection|handheld|braille|embossed|aural)\b|\s*not\s+(?:screen|all)\b", q) for q in query.split(","))


def _rules(css: str):
    """(selectors, declarations) of a style sheet that hold on a screen."""
    css, at = _COMMENT.sub("", css).lower(), 0
    while m := _BRACE.search(css, at):
        head, at = css[at : m.start()].rpartition(";")[2].strip(), m.end()
        if m[0] == "}":
            continue
        if head.startswith(("@media", "@supports", "@layer")) and (not head.startswith("@media") or _screen(head[6:])):
            continue  # what is inside is read like what is outside
        depth = 1
        while depth and (e := _BRACE.search(css, at)):
            depth, at = depth + (1 if e[0] == "{" else -1), e.end()
        if not head.startswith("@"):
            yield head, css[m.end() : at - 1 if depth == 0 else len(css)]
        if depth:
            break


def _names(part: str) -> frozenset:
    return frozenset(x for x in re.findall(r"[.#]?[\w-]+", part))


class _Sheet:
    """What the page's style sheets say of display and visibility."""

    def __init__(self, root: Node):
        self.by: dict[str, list] = {}
        todo, order, css = [root], 0, []
        while todo:
            x = todo.pop()
            if x.tag == "style":
                css.append("".join(t for t in x.children if isinstance(t, str)))
            todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
        for heads, body in (r for text in css for r in _rules(text)):
            off, see = _OFF.search(body), _SEEN.search(body)
            for head in heads.split(",") if off or see else ():
                parts = [p for p in head.replace(">", " ").split()]
                if not parts or not all(_SELECTOR.fullmatch(p) for p in parts):
                    continue
                names, order = [_names(p) for p in parts], order + 1
                every = [n for part in names for n in part]
                weight = (sum(n[0] == "#" for n in every), sum(n[0] == "." for n in every), sum(n[0] not in "#." for n in every), order)
                key = max(names[-1], key=lambda n: (n[0] == "#", n[0] == "."), default="*")
                self.by.setdefault(key, []).append((weight, names, (off[1] == "none", bool(off[2])) if off else None, (see[1], bool(see[2])) if see else None))

    def of(self, names: set, above: list) -> tuple:
        """(hidden by display or None, important), (visibility or None, important) of an element with these names."""
        got = [((), None), ((), None)]
        for key in names | {"*"}:
            for weight, parts, *said in self.by.get(key, ()):
                if not parts[-1] <= names:
                    continue
                k = len(parts) - 2
                for up in reversed(above) if k >= 0 else ():
                    k -= parts[k] <= up
                    if k < 0:
                        break
                if k >= 0:
                    continue
                for j, x in enumerate(said):
                    if x is not None and (x[1], *weight) > got[j][0]:
                        got[j] = ((x[1], *weight), x[0])
        return tuple((x, bool(w and w[0])) for w, x in got)


class _Lines:
    """Text laid out so far: finished lines, the open line, what gap is due."""

    def __init__(self):
        self.lines, self.open, self.gap, self.indent, self.marker = [], [], 0, "", None

    def text(self, s: str) -> None:
        s = _SPACES.sub(" ", s)
        if s[:1] == " " and (not self.open or self.open[-1][-1:] == " "):
            s = s[1:]
        if s:
            self.open.append(s)

    def end(self) -> None:
        s = "".join(self.open).rstrip(" ")
        self.open = []
        if s:
            self.line(s)

    def line(self, s: str) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append((self.indent if self.marker is None else self.marker) + s)
        self.marker = None

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def pre(self, s: str) -> None:
        first, *rest = s.split("\n")
        if first:
            self.open.append(first)
        for x in rest:
            line = "".join(self.open)
            self.open = [x] if x else []
            if line.strip():
                self.line(line)
            elif self.lines:
                self.lines.append("")


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table given as rows of cells (lines, column span, row span)."""
    placed: list[dict[int, list[str]]] = []
    starts: set[int] = set()
    spans: dict[int, int] = {}
    single: dict[int, int] = {}
    for row in rows:
        at, line = 0, {}
        due = {c for c, k in spans.items() if k > 0}
        for c in due:
            spans[c] -= 1
        for text, cols, deep in row:
            while at in due:
                at += 1
            line[at] = [x for x in text if x.strip()] if len(text) > 1 else [" ".join(x.split()) for x in text]
            starts.add(at)
            if cols == 1:
                single[at] = max(single.get(at, 0), max(map(len, line[at]), default=0))
            for c in range(at, at + cols):
                single.setdefault(c, 0)
                if deep > 1:
                    spans[c] = deep - 1
            at += cols
        placed.append(line)
    out = []
    for line in placed:
        for k in range(max(map(len, line.values()), default=0)):
            s, x = "", 0
            for c in range(len(single)):
                if k < len(line.get(c, ())):
                    s = s + " " * max(x - len(s), 2 if s else 0) + line[c][k]
                x += single[c] + 2 if c in starts else 0
            out.append(s.rstrip())
    return [s for s in out if s]


def _number(x: str | None, least: int, most: int, default: int) -> int:
    m = re.match(r"\s*(-?)0*(\d+)", x or "")
    return max(least, min(int((m[1] + m[2])[:20]), most)) if m else default


def _list_number(x: str | None, default: int) -> int:
    """Of any size that browsers show."""
    return _number(x, -(1 << 31), (1 << 31) - 1, default)


def render(page: str | None) -> str | None:
    """All visible text of a page."""
    if page is None:
        return None
    root = parse(page)
    sheet = _Sheet(root)
    out = _Lines()
    # frames: node, next child, visible, preformatted, what to do on leaving it
    stack = [[root, 0, True, False, None]]
    above: list[set] = []
    lists: list[list] = []
    tables: list[list] = []
    while stack:
        top = stack[-1]
        node, k, shown, pre, leave = top
        if k == len(node.children):
            stack.pop()
            if above:
                above.pop()
            if leave:
                leave()
            continue
        top[1] += 1
        c = node.children[k]
        if isinstance(c, str):
            if shown and not (node.tag == "details" and "open" not in node.attrs):
                out.pre(c[1:] if k == 0 and node.tag == "pre" and c[:1] == "\n" else c) if pre else out.text(c)
            continue
        tag, a = c.tag, c.attrs
        style = a.get("style", "").lower() if a else ""
        if tag in GONE or "hidden" in a or tag == "dialog" and "open" not in a or tag == "input" and a.get("type", "").lower() == "hidden":
            continue
        names = {tag, *("." + x for x in a.get("class", "").lower().split()), *(("#" + a["id"].lower(),) if a.get("id") else ())} if sheet.by else set()
        (off, strong), (see, sure) = sheet.of(names, above) if sheet.by else ((None, False), (None, False))
        own, own_see = _OFF.search(style), _SEEN.search(style)
        if own and not (strong and not own[2]):
            off = own[1] == "none"
        if own_see and not (sure and not own_see[2]):
            see = own_see[1]
        if off:
            continue
        visible = see == "visible" if see else shown
        if node.tag == "details" and "open" not in node.attrs and tag != "summary":
            continue
        leave = None
        if tag == "br":
            if shown:
                if out.open:
                    out.end()
                elif out.lines and out.lines[-1]:
                    out.gap = max(out.gap, 2)
            continue
        if tag == "hr":
            out.block(2)
            continue
        if tag in ("td", "th") and tables:
            outer, out = out, _Lines()
            table = tables[-1]

            def leave(inner=out, outer=outer, table=table, a=a):
                nonlocal out
                inner.end()
                if not table:
                    table.append([])
                table[-1].append((inner.lines, _number(a.get("colspan"), 1, 1000, 1), _number(a.get("rowspan"), 1, 65534, 1)))
                out = outer

        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag == "table":
            out.block(2)
            tables.append([])

            def leave():
                out.block(0)
                for s in _grid(tables.pop()):
                    out.line(s)
                out.block(2)

        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(1 if lists else 2)
            lists.append([_list_number(a.get("start"), 1) if tag == "ol" else None])

            def leave():
                lists.pop()
                out.block(1 if lists else 2)

        elif tag == "li":
            out.block(1)
            was = out.indent
            if lists and lists[-1][0] is not None:
                mark = f"{_list_number(a.get('value'), lists[-1][0])}. "
                lists[-1][0] = int(mark[:-2]) + 1
            else:
                mark = "- "
            out.marker, out.indent = was + mark, was + " " * len(mark)

            def leave(was=was, o=out):
                o.block(1)
                o.indent, o.marker = was, None

        elif tag in ("blockquote", "dd"):
            gap, was = (2 if tag == "blockquote" else 1), out.indent
            out.block(gap)
            out.indent = was + "  "

            def leave(gap=gap, was=was, o=out):
                o.block(gap)
                o.indent = was

        elif tag in SPACED or tag in LINES:
            gap = 2 if tag in SPACED else 1
            out.block(gap)

            def leave(gap=gap):
                out.block(gap)

        above.append(names)
        stack.append([c, 0, visible, pre or tag in ("pre", "textarea", "listing", "xmp"), leave])
    out.end()
    return "\n".join(out.lines).strip("\n")


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every whole page; one pass, no shuffle."""
    tune(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(html_col).cast("string").alias("_html"))

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([render(x.as_py()) for x in b.column(1)], pa.string())], names=[id_col, "text"])

    return src.mapInArrow(run, f"{id_col} long, text string")
