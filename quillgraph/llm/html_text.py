"""Layout-aware HTML rendering: a tree builder with implied tags and visibility rules emits all visible text.

Tags open and close elements as the HTML rules imply (a block closes an open paragraph, an item the item before it, a
cell the cell before it, and so on); the stack of open elements is the path in the tree, and each element is rendered
when it opens and closes, so pages of any size and depth need no recursion. Blocks are set apart by line breaks,
paragraphs and headings by a blank line; list items get a dash or their number, indented by depth; the cells of a table
are aligned by column, spanning ones over the columns that they span; `pre` and `xmp` keep their spacing; of a select the
chosen option shows. Comments, `head`, scripts, styles, templates, fallback content (of canvas, video and the like), and
what the attribute `hidden` or an inline `display: none` hides are not visible. `visibility` is inherited, and an element
inside can set it back. `aria-hidden` hides nothing that is drawn; svg and math show their text, but not titles,
descriptions and annotations. A closed `details` counts as open, since it is there to be opened. Rendering is one pass
over the rows, without a shuffle.

A page takes time in proportion to its length: open elements are found by name, tags by index, and no text is scanned
twice for an end that isn't there. Lists and tables of any depth, cells of any width and spans as far as HTML lets them go
(1,000 columns, 65,534 rows) are laid out. But spaces that align can be as many as the square of a page, so a page has
room for `growth` times its length (and ROOM characters) of indents and laid-out tables. A table that doesn't fit stops
aligning its widest columns, at half the width as often as it takes; one that doesn't fit without any padding has its
cells set as blocks. What is within the room is laid out in whole, however deep or wide, and no text is lost past it.

Defined cases: null or empty html gives ''. Markup that doesn't parse counts as text or is closed at the end. Rows that
repeat a page_id are rendered one by one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html as _html
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

_MARK = re.compile(r"[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist desc metadata annotation annotation-xml".split())
_HEAD = frozenset("base link meta title style script noscript template".split())
#: Lines between what comes before and after: 2 leaves a blank line.
_BLOCK = dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre xmp ul ol dl table figure hr menu".split(), 2) | dict.fromkeys("html body div article section header footer nav aside main address form fieldset li dt dd tr caption figcaption details summary center legend option text".split(), 1)
_CLOSES_P = frozenset(_BLOCK) - {"option", "tr", "caption", "html", "body", "text"}
_APART = frozenset("section article blockquote table td th body main nav aside header footer form fieldset details figure center".split())
#: An element that opens closes these, as long as none of the second set is open above them.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"} | _APART), "dt": ({"dt", "dd"}, {"dl"} | _APART), "dd": ({"dt", "dd"}, {"dl"} | _APART), "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "a": ({"a"}, {"table", "td", "th"}), "select": ({"select"}, set()), "body": ({"head"}, set()),
}
_SCOPE = frozenset("table td th caption html template".split())
#: Characters that indents and laid-out tables may take: so many for each of the page's, and so many besides.
GROWTH, ROOM = 8, 1 << 16


class _Room:
    """What is left of a page's room."""

    def __init__(self, left: int) -> None:
        self.left = left

    def take(self, n: int) -> bool:
        if n > self.left:
            return False
        self.left -= n
        return True


class _Page:
    """Text with pending line breaks and collapsed white space."""

    def __init__(self, room: _Room) -> None:
        self.out: list = []  # text, and lists of what other pages gave
        self.breaks, self.gap, self.indent, self.mark, self.room, self.size = 0, False, 0, "", room, 0

    def block(self, n: int) -> None:
        self.breaks, self.gap = max(self.breaks, n), False

    def text(self, s: str, pre: bool) -> None:
        if not pre:
            t = _SPACE.sub(" ", s)
            lead, trail = t[:1] == " ", t[-1:] == " "
            t = t.strip(" ")
            if not t:
                self.gap = self.gap or lead
                return
            self.gap = self.gap or lead
        else:
            t, trail = s, False
            if not t:
                return
        if self.breaks or not self.out:
            self.begin()
        elif self.gap:
            self.add(" ")
        more = t.count("\n") if pre and self.indent else 0
        self.add(t.replace("\n", "\n" + "  " * self.indent) if more and self.room.take(2 * self.indent * more) else t)
        self.gap = trail

    def add(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def begin(self) -> None:
        """Pending line breaks, indent and mark."""
        if self.out:
            self.add("\n" * self.breaks)
        deep = self.indent - bool(self.mark)
        self.add(("  " * deep if self.room.take(2 * deep) else "") + self.mark)
        self.breaks, self.mark = 0, ""

    def take(self, other: _Page) -> None:
        """All of another page's text as lines of their own, without copying it."""
        if other.out:
            self.block(1)
            self.begin()
            self.out.append(other.out)
            self.size += other.size
            self.block(1)

    def get(self) -> str:
        flat, open_ = [], [iter(self.out)]
        while open_:
            for x in open_[-1]:
                if isinstance(x, list):
                    open_.append(iter(x))
                    break
                flat.append(x)
            else:
                open_.pop()
        return "".join(flat)


def _table(rows: list[list[tuple[_Page, int, int]]], room: _Room) -> str | None:
    """Rows of (content, columns spanned, rows spanned), aligned; None if there is no room for that."""
    plain = sum(page.size + 3 for row in rows for page, _, _ in row)
    if not room.take(plain):
        return None
    left = room.left  # for places that spans take and for padding
    taken: dict[int, int] = {}  # the row up to which a column is taken by a cell above
    placed = []
    for r, row in enumerate(rows):
        column, own = 0, []
        for page, wide, high in row:
            while taken.get(column, 0) > r:
                own.append((column, column + 1, [""]))
                column += 1
                left -= 3
                if left < 0:
                    return None
            left -= wide if high > 1 else 0
            if left < 0:
                return None
            own.append((column, column + wide, page.get().split("\n")))
            if high > 1:
                for k in range(column, column + wide):
                    taken[k] = r + high
            column += wide
        placed.append(own)
    starts = sorted({c[0] for row in placed for c in row})
    cells = [[(bisect.bisect_left(starts, a), bisect.bisect_left(starts, b), lines, max(map(len, lines))) for a, b, lines in row] for row in placed]
    most = max((long for row in cells for _, _, _, long in row), default=0)
    while True:
        before = _columns(cells, len(starts), most)
        # what comes before the last cell of a line is padded to that cell's column, or to its own length if it is longer
        padded = sum(max((len(c[2]) for c in row), default=0) * (before[row[-1][0]] + sum(max(0, c[3] + 3 - before[c[1]] + before[c[0]]) for c in row[:-1])) for row in cells if row)
        if padded <= left:
            break
        if not most:
            return None
        most //= 2
    room.left = left - padded
    out = []
    for row in cells:
        for i in range(max((len(c[2]) for c in row), default=0)):
            out.append(" | ".join((lines[i] if i < len(lines) else "").ljust(before[b] - before[a] - 3) for a, b, lines, _ in row).rstrip())
    return "\n".join(out)


def _columns(cells: list[list[tuple[int, int, list[str], int]]], n: int, most: int) -> list[int]:
    """Where each of n columns begins, when cells longer than most don't widen theirs."""
    width = [0] * n
    for row in cells:
        for a, b, _, long in row:
            if b == a + 1 and long <= most:
                width[a] = max(width[a], long)
    before = [0, *accumulate(w + 3 for w in width)]
    for row in cells:  # a spanning cell that needs more widens its last column
        for a, b, _, long in row:
            if b > a + 1 and long <= most:
                width[b - 1] = max(width[b - 1], width[b - 1] + long + 3 - (before[b] - before[a]))
    return [0, *accumulate(w + 3 for w in width)]


def _span(value: str | None, most: int) -> int:
    return min(max(int(value), 1), most) if value and value.isascii() and value.isdigit() and len(value) < 10 else 1


def _laid_out(stack: list[tuple], where: dict[str, list[int]]) -> bool:
    """Whether the innermost open table is laid out as one."""
    at = where.get("table")
    return bool(at) and bool(stack[at[-1]][4])


def render(page: str | None, growth: int = GROWTH) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    room = _Room(growth * len(page) + ROOM)
    # open elements: name, whether it hides what is in it, whether it was laid out, whether text around it is visible, what it needs when it closes
    stack: list[tuple] = []
    where: dict[str, list[int]] = {}  # places in the stack by name
    outs, tables, lists, choices = [_Page(room)], [], [], []
    hidden = pre = 0
    visible = True

    def close() -> None:
        nonlocal hidden, pre, visible
        name, hides, laid, visible, more = stack.pop()
        where[name].pop()
        if hides:
            hidden -= 1
        if not laid:
            return
        if name in ("td", "th"):
            if more:
                tables[-1][-1].append((outs.pop(), *more))
            else:
                outs[-1].block(1)
        elif name == "table":
            if more:
                rows = [r for r in tables.pop() if r]
                if rows:
                    outs[-1].block(2)
                    if (text := _table(rows, room)) is not None:
                        outs[-1].text(text, True)
                    else:
                        for cell in (c[0] for row in rows for c in row):
                            outs[-1].take(cell)
        elif name in ("ul", "ol", "menu"):
            lists.pop()
            outs[-1].indent = max(0, outs[-1].indent - 1)
        elif name in ("dd", "blockquote"):
            outs[-1].indent = max(0, outs[-1].indent - 1)
        elif name == "pre":
            pre -= 1
        elif name == "q":
            outs[-1].text('"', False)
        elif name == "option" and more is not None:
            choices[-1].append((more, outs.pop().get()))
            return
        elif name == "select":
            outs.pop()
            options = choices.pop()
            shown = options if more else ([o for o in options if o[0]] or options)[:1]
            for _, text in shown:
                outs[-1].block(1) if more else None
                outs[-1].text(text, False)
        if name in _BLOCK:
            outs[-1].block(_BLOCK[name] if not (name in ("ul", "ol") and lists) else 1)

    def close_to(i: int) -> None:
        while len(stack) > i:
            close()

    def find(names, scope) -> int:
        """The place of the innermost open element of names, -1 if one of scope is open inside it."""
        i = max((where[x][-1] for x in names if where.get(x)), default=-1)
        return i if i > max((where[x][-1] for x in scope if x not in names and where.get(x)), default=-1) else -1

    def say(s: str) -> None:
        if not s:
            return
        if stack and stack[-1][0] == "head" and not s.isspace():
            close()
        if hidden or not visible:
            return
        if stack and stack[-1][0] in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol", "select") and s.isspace():
            return
        outs[-1].text(_html.unescape(s) if "&" in s else s, pre > 0)

    n, at, look, quotes, cdata = len(page), 0, 0, True, page.rfind("]]>")

    def tag_end(i: int) -> int:
        """Where the tag ends: at the first > outside the quotes of attribute values; -1 without one."""
        nonlocal quotes
        k = i
        while quotes:
            m = _MARK.search(page, k)
            if m is None:
                break
            if m.group() == ">":
                return m.start()
            j = m.start() - 1
            while page[j] in " \t\n\r\f":
                j -= 1
            k = page.find(m.group(), m.end()) + 1 if page[j] == "=" else m.end()
            if k == 0:
                break
        quotes = False  # quotes run to the end of the page: from here on they don't count
        return page.find(">", i)

    while at < n:
        lt = page.find("<", look)
        if lt < 0 or lt + 1 >= n:
            say(page[at:])
            break
        c = page[lt + 1]
        if c in "!?":
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                after = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt) and cdata >= lt + 9:
                end = page.find("]]>", lt + 9)
                after = end + 3
            else:
                end = page.find(">", lt)
                if end < 0:
                    say(page[at:])
                    break
                after = end + 1
            say(page[at:lt])
            if page.startswith("<![CDATA[", lt) and cdata >= lt + 9:
                say(page[lt + 9 : end])
            at = look = after
            continue
        m = _NAME.match(page, lt + 1 + (c == "/"))
        if m is None:
            look = lt + 1
            continue
        end = tag_end(m.end())
        if end < 0:  # no > is left
            say(page[at:])
            break
        say(page[at:lt])
        at = look = end + 1
        name = m.group().lower()
        if c == "/":
            if name == "br":
                outs[-1].block(1) if not hidden else None
            elif name == "p" and find(("p",), _SCOPE) < 0:
                outs[-1].block(2) if not hidden else None
            elif (i := find((name,), _SCOPE if name not in ("table", "html", "body") else ())) >= 0:
                close_to(i)
            continue
        if (rule := _IMPLIED.get(name)) is not None:
            while (i := find(*rule)) >= 0:
                close_to(i)
        if stack and stack[-1][0] == "head" and name not in _HEAD:
            close()
        if name in _CLOSES_P and (i := find(("p",), _SCOPE)) >= 0:
            close_to(i)
        attrs: dict[str, str] = {}
        if end > m.end() and not page[m.end() : end].isspace():
            for k, x, y, z in _ATTR.findall(page, m.end(), end):
                attrs.setdefault(k.lower(), x or y or z)
        style = attrs.get("style", "")
        hides = name in _UNSEEN or "hidden" in attrs or _NONE.search(style) is not None or (name == "dialog" and "open" not in attrs)
        seen = set_.group(1).lower() == "visible" if (set_ := _VISIBILITY.search(style)) else visible
        if name in _VOID:
            if not hidden and not hides:
                if name == "br":
                    outs[-1].block(outs[-1].breaks + 1 if outs[-1].breaks == 1 else 1)
                elif name == "hr":
                    outs[-1].block(2)
                elif name == "img" and attrs.get("alt") and seen:
                    say(attrs["alt"])
                elif name == "input" and attrs.get("type", "text").lower() in ("submit", "button", "text") and attrs.get("value") and seen:
                    say(attrs["value"])
            continue
        if name in _RAW:
            found = _END[name].search(page, at)
            stop = found.start() if found else n
            if not hidden and not hides and seen and name in ("textarea", "xmp"):
                outs[-1].block(2 if name == "xmp" else outs[-1].breaks)
                outs[-1].text(_html.unescape(page[at:stop]) if name == "textarea" else page[at:stop].strip("\n"), True)
                outs[-1].block(2 if name == "xmp" else outs[-1].breaks)
            at = look = page.find(">", stop) + 1 or n if found else n
            continue
        hidden += hides
        more = None
        out = outs[-1]
        if not hidden:
            if name in _BLOCK and name != "option":
                out.block(_BLOCK[name] if not (name in ("ul", "ol") and lists) else 1)
            if name in ("ul", "ol", "menu"):
                lists.append([name == "ol", _span(attrs.get("start"), 1 << 40)])
                out.indent += 1
            elif name == "li":
                here = lists[-1] if lists else [False, 1]
                out.mark = f"{here[1]}. " if here[0] else "- "
                out.indent = max(out.indent, 1)
                here[1] += 1
            elif name in ("dd", "blockquote"):
                out.indent += 1
            elif name == "pre":
                pre += 1
            elif name == "table":
                more = True
                tables.append([])
            elif name == "tr" and tables and _laid_out(stack, where):
                tables[-1].append([])
            elif name in ("td", "th"):
                if tables and _laid_out(stack, where):
                    if not tables[-1]:
                        tables[-1].append([])
                    more = (_span(attrs.get("colspan"), 1000), _span(attrs.get("rowspan"), 65534))
                    outs.append(_Page(room))
                else:
                    out.block(1)
            elif name == "q":
                out.text('"', False)
            elif name == "select":
                more = "multiple" in attrs
                choices.append([])
                outs.append(_Page(room))
            elif name == "option" and choices:
                more = "selected" in attrs
                outs.append(_Page(room))
            elif name == "option":
                out.block(1)
        where.setdefault(name, []).append(len(stack))
        stack.append((name, hides, not hidden, visible, more))
        visible = seen
    close_to(0)
    return outs[0].get().strip("\n")


def extract(pages: DataFrame, growth: int = GROWTH) -> DataFrame:
    """page_id and the visible text of every row of pages(page_id, html); growth bounds what layout adds to a page."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = [render(x, growth) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(text, pa.string())], names=["page_id", "text"])

    return pages.selectExpr("cast(page_id as long) page_id", "html").mapInArrow(run, "page_id long, text string")
