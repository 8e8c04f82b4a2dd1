"""Blocks of a document: lines to a tree, with link references and notes collected on the way."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .inline import CLOSE_TAG, OPEN_TAG, _blank, destination, title
from .options import Options
from .text import column_widths, normalize_label

DEEPEST, MOST_DIGITS, MOST_COLUMNS = 32, 9, 128
#: Tags that start an HTML block wherever they begin a line.
BLOCK_TAGS = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main "
    "menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
CALLOUTS = ("note", "tip", "important", "warning", "caution")

_BREAK = re.compile(r"(?:\*[ \t]*){3,}$|(?:-[ \t]*){3,}$|(?:_[ \t]*){3,}$")
_FENCE = re.compile(r"(`{3,})([^`]*)$|(~{3,})(.*)$")
_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_BULLET = re.compile(r"[*+-](?=[ \t]|$)")
_NUMBER = re.compile(rf"(\d{{1,{MOST_DIGITS}}})([.)])(?=[ \t]|$)")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_CALLOUT = re.compile(rf"\[!({'|'.join(CALLOUTS)})\][ \t]*$", re.I)
_TASK = re.compile(r"\[([ xX])\][ \t]")
_NOTE = re.compile(r"\[\^([A-Za-z0-9_-]+)\]:[ \t]*")
_DELIMITER = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
#: Starts of HTML blocks and what ends each; None: a blank line.
_HTML = [
    (re.compile(r"<(?:script|pre|textarea|style)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|textarea|style)", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{'|'.join(BLOCK_TAGS.split())})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:{OPEN_TAG}|{CLOSE_TAG})\s*$"), None),
]


@dataclass(eq=False)
class Block:
    kind: str
    start: int = 0
    end: int = 0
    children: list = field(default_factory=list)
    lines: list = field(default_factory=list)  # (text, place in the document)
    parent: object = None
    blank: bool = False  # a blank line was last in it
    open: bool = True
    level: int = 0
    info: str = ""
    fence: str = ""
    indent: int = 0
    ordered: bool = False
    number: int = 1
    mark: str = ""
    tight: bool = True
    task: str | None = None
    aligns: list = field(default_factory=list)
    widths: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    html: int = 0

    @property
    def text(self) -> str:
        return "\n".join(x for x, _ in self.lines)

    def add(self, child: Block) -> Block:
        child.parent = self
        self.children.append(child)
        return child

    def drop(self, child: Block) -> None:
        """Takes out a child, most often the last one."""
        if self.children[-1] is child:
            self.children.pop()
        else:
            self.children.remove(child)


CONTAINERS = ("document", "quote", "item", "list", "description", "definitions", "note")


class Line:
    """A line being read: place, column, and columns left of a tab that is partly used."""

    def __init__(self, s: str, at: int):
        self.s, self.at, self.i, self.col, self.left = s, at, 0, 0, 0

    def indent(self) -> int:
        """Columns of white space here."""
        i, col = self.i, self.col + self.left
        while i < len(self.s) and self.s[i] in " \t":
            col += 1 if self.s[i] == " " else 4 - col % 4
            i += 1
        return col - self.col

    def skip(self, columns: int) -> None:
        while columns > 0:
            if self.left:
                k = min(self.left, columns)
                self.left -= k
                self.col += k
                columns -= k
                continue
            if self.i >= len(self.s) or self.s[self.i] not in " \t":
                return
            if self.s[self.i] == " ":
                self.i += 1
                self.col += 1
                columns -= 1
            else:
                self.left = 4 - self.col % 4
                self.i += 1

    def take(self, n: int) -> None:
        self.i += n
        self.col += n

    def rest(self) -> str:
        return " " * self.left + self.s[self.i :]

    def bare(self) -> str:
        return self.s[self.i :].lstrip(" \t")

    def spread(self) -> tuple[str, int]:
        """The rest with its leading white space as spaces, and the place behind that."""
        bare = self.bare()
        return " " * self.indent() + bare, self.at + len(self.s) - len(bare)

    def place(self) -> int:
        return self.at + self.i

    def blank(self) -> bool:
        return not self.s[self.i :].strip(" \t")


def split_row(row: str, merged: bool = False) -> list[tuple[str, int]]:
    """Cells of a table's row and the columns each takes."""
    s = row.strip(" \t")
    i = 1 if s.startswith("|") else 0
    cells, begin = [], i
    while i < len(s):
        c = s[i]
        if c == "\\":
            i += 2
            continue
        if c == "`":
            m = re.compile(r"`+").match(s, i)
            close = next((x for x in re.compile(r"`+").finditer(s, m.end()) if len(x[0]) == len(m[0])), None)
            if close is None:
                i = len(s)
                break
            i = close.end()
            continue
        if c == "|":
            span = 1
            while merged and s[i + span : i + span + 1] == "|" and len(cells) + span < 4 * MOST_COLUMNS:
                span += 1
            cells.append((s[begin:i].strip(" \t"), span))
            i += span
            begin = i
            continue
        i += 1
    if begin < len(s) and s[begin:].strip(" \t"):
        cells.append((s[begin:].strip(" \t"), 1))
    return cells[:MOST_COLUMNS]


def reference(s: str, at: int = 0) -> tuple[str, str, str | None, int] | None:
    """A link reference definition at s[at:]: label, destination, title, end."""
    m = re.compile(r"[ \t]{0,3}\[((?:[^\\\[\]]|\\[\s\S]){1,999})\]:").match(s, at)
    if not m or not m[1].strip():
        return None
    i = _blank(s, m.end())
    if i >= len(s):
        return None
    found = destination(s, i)
    if not found or (not found[0] and s[i] != "<"):
        return None
    dest, i = found
    line = _blank(s, i, " \t")
    over = line >= len(s) or s[line] == "\n"
    after = _blank(s, i)
    name = title(s, after) if after > i else None
    if name:
        end = _blank(s, name[1], " \t")
        if end >= len(s) or s[end] == "\n":
            return m[1], dest, name[0], min(end + 1, len(s))
    return (m[1], dest, None, min(line + 1, len(s))) if over else None


class Parser:
    def __init__(self, opts: Options):
        self.o = opts
        self.refs: dict[str, tuple[str, str | None]] = {}
        self.notes: dict[str, Block] = {}
        self.labels: dict[str, str] = {}
        self.comments: list[tuple[int, int]] = []
        self.unended = -1
        #: A fence or HTML block of the document itself that ends with the text for want of its end.
        self.left_open: Block | None = None

    def raw(self, b: Block) -> str:
        """Lines of code or HTML, each with its line feed; a line that ends with the document has none."""
        text = "".join(x + "\n" for x, _ in b.lines)
        return text[:-1] if b.lines and b.lines[-1][1] >= self.unended >= 0 else text

    def parse(self, s: str) -> Block:
        self.root = self.tip = Block("document")
        at = 0
        self.unended = s.rfind("\n") + 1 if s and s[-1] != "\n" else -1  # where a line without a line feed starts
        for part in s.split("\n") if s else []:
            if at == len(s) and part == "":
                break
            self.line(part, at)
            at += len(part) + 1
        if self.tip.parent is self.root and (self.tip.fence or self.tip.kind == "html" and _HTML[self.tip.html][1] is not None):
            self.left_open = self.tip
        while self.tip is not self.root:
            self.finish(self.tip)
        self.root.end = len(s)
        return self.root

    # containers

    def continues(self, b: Block, line: Line) -> bool:
        indent = line.indent()
        if b.kind == "quote":
            if indent > 3 or not line.bare().startswith(">"):
                return False
            self.quote_mark(line)
            return True
        if b.kind in ("item", "description", "note"):
            if line.blank():
                return bool(b.children) or b.kind != "item"
            if indent >= b.indent:
                line.skip(b.indent)
                return True
            return False
        return True

    def quote_mark(self, line: Line) -> None:
        line.skip(line.indent())
        line.take(1)
        if line.indent():
            line.skip(1)

    def line(self, s: str, at: int) -> None:
        if s and s[0].isalpha() and (self.tip is self.root or self.tip.kind == "paragraph" and self.tip.parent is self.root):
            # a letter starts nothing but text
            if self.tip is self.root:
                self.tip = self.root.add(Block("paragraph", at))
            self.tip.lines.append((s[:-1] if s[-1] == "\r" else s, at))
            self.tip.blank = self.root.blank = False
            return
        line = Line(s, at)
        b = self.root
        while b.children and (last := b.children[-1]).open:
            if last.kind not in CONTAINERS:
                break
            if not self.continues(last, line):
                break
            b = last
        leaf = self.tip if self.tip.kind not in CONTAINERS else None
        if self.o.line_comments and not (leaf and leaf.kind in ("code", "html") and leaf.parent is b):
            m = re.match(r" {0,3}//", s)
            if m and not (leaf and leaf.kind in ("code", "html")):
                self.comments.append((at + m.end() - 2, at + len(s.rstrip("\r"))))
                return
        matched = b
        if leaf and leaf.parent is b and leaf.kind in ("code", "html") and self.inside(leaf, line):
            self.mark(leaf, line.blank() and not leaf.fence)
            return
        if not self.starts(matched, line, leaf):
            self.mark(self.tip, False)

    def inside(self, leaf: Block, line: Line) -> bool:
        """A line of an open code or HTML block, or its end."""
        if leaf.kind == "html":
            end = _HTML[leaf.html][1]
            if end is None and line.blank():
                self.finish(leaf)
                return False
            leaf.lines.append((line.rest(), line.place()))
            if end is not None and end.search(line.s, line.i):
                self.finish(leaf)
            return True
        if leaf.fence:
            bare = line.bare()
            if line.indent() <= 3 and re.fullmatch(rf"{re.escape(leaf.fence[0])}{{{len(leaf.fence)},}}[ \t]*", bare):
                self.finish(leaf)
                return True
            line.skip(min(leaf.indent, line.indent()))
            leaf.lines.append((line.rest(), line.place()))
            return True
        if line.indent() >= 4:
            line.skip(4)
        elif line.blank():
            line.skip(line.indent())
        else:
            self.finish(leaf)
            return False
        leaf.lines.append(line.spread())
        return True

    # starts of blocks

    def depth(self, b: Block) -> int:
        n = 0
        while b is not None:
            n += b.kind in ("quote", "list")
            b = b.parent
        return n

    def starts(self, b: Block, line: Line, leaf: Block | None) -> bool:
        """Opens what the line starts; true for a blank line."""
        lazy = leaf is not None and leaf.kind == "paragraph"
        para = leaf if lazy and leaf.parent is b else None
        while True:
            if line.blank():
                self.blank_line(b, line)
                return True
            indent = line.indent()
            bare = line.bare()
            where = b
            if indent >= 4:
                if not lazy and self.o.indented_code_blocks:
                    b = self.under(b)
                    line.skip(4)
                    code = self.open_block(b, Block("code", line.place()))
                    code.lines.append(line.spread())
                    return False
                if lazy or not self.o.indented_code_blocks:
                    break
            if self.o.definition_lists and indent < 4 and re.match(r":[ \t]", bare) and (made := self.description(b, para, line)):
                b, para, lazy = made, None, False
                continue
            if para is not None and indent < 4 and (m := _SETEXT.match(bare)) and self.setext(para, 1 if m[1][0] == "=" else 2):
                return False
            if para is not None and self.o.tables and "-" in bare and self.table(para, bare):
                return False
            if bare[0] == ">" and self.depth(b) < DEEPEST:
                b = self.under(b)
                self.quote_mark(line)
                quote = self.open_block(b, Block("quote", line.place()))
                b, para, lazy, leaf = quote, None, False, None
                if self.o.callouts and (m := _CALLOUT.match(line.bare())) and line.indent() <= 3:
                    quote.info = m[1].lower()
                    return False
                continue
            if m := _ATX.match(bare):
                b = self.under(b)
                body = bare[m.end() :].rstrip(" \t\r")
                body = re.sub(r"(?:^|[ \t]+)#+$", "", body).rstrip(" \t")
                place = line.place() + line.s[line.i :].index("#") + m.end()
                h = self.open_block(b, Block("heading", line.place(), level=len(m[1])))
                h.lines.append((body, place))
                self.finish(h)
                return False
            if m := _FENCE.match(bare):
                b = self.under(b)
                fence = m[1] or m[3]
                self.open_block(b, Block("code", line.place(), fence=fence, info=(m[2] or m[4] or "").strip(" \t\r"), indent=indent))
                return False
            if bare[0] == "<" and self.html_start(b, line, bare, lazy):
                return False
            if leaf is not None and leaf.kind == "table" and leaf.parent is where and not (bare[0] in "*-_" and _BREAK.match(bare)):
                leaf.rows.append((bare, line.place()))
                return False
            if bare[0] in "*-_" and _BREAK.match(bare):
                b = self.under(b)
                self.finish(self.open_block(b, Block("break", line.place(), line.at + len(line.s))))
                return False
            if (self.o.footnotes and para is None and not (lazy and leaf.parent is not b) and (m := _NOTE.match(bare))) and indent < 4:
                b = self.under(b)
                label = m[1].lower()
                line.skip(indent)
                note = Block("note", line.place(), indent=len(m[0].rstrip(" \t")) + 1, info=m[1])
                line.take(len(m[0].rstrip(" \t")))
                note.parent = b
                self.close_to(b)
                b.children.append(note)
                self.tip = note
                if label not in self.notes:
                    self.notes[label] = note
                b, para, lazy, leaf = note, None, False, None
                continue
            if item := self.item(b, line, bare, indent, para, lazy):
                b, para, lazy, leaf = item, None, False, None
                continue
            break
        self.paragraph(b, line, leaf if lazy else None)
        return False

    def under(self, b: Block) -> Block:
        """A container that takes blocks other than items; what is open in it ends."""
        while b.kind in ("list", "definitions"):
            b = b.parent
        self.close_to(b)
        return b

    def close_to(self, b: Block) -> None:
        while self.tip is not b:
            self.finish(self.tip)

    def open_block(self, b: Block, new: Block) -> Block:
        self.close_to(b)
        b.add(new)
        self.tip = new
        return new

    def paragraph(self, b: Block, line: Line, lazy: Block | None) -> None:
        text, place = line.bare(), line.place() + len(line.s[line.i :]) - len(line.bare())
        text = text.rstrip("\r") if text.endswith("\r") else text
        if lazy is not None:
            in_note = False
            x = lazy.parent
            while x is not None and x is not b:
                in_note |= x.kind == "note"
                x = x.parent
            if not in_note:
                lazy.lines.append((text, place))
                return
        b = self.under(b)
        p = self.open_block(b, Block("paragraph", place))
        p.lines.append((text, place))

    def blank_line(self, b: Block, line: Line) -> None:
        while self.tip is not b:
            if self.tip.kind == "code" and not self.tip.fence and self.tip.parent is b:
                return
            self.finish(self.tip)
        if b.children:
            b.children[-1].blank = True
        self.mark(b, not (b.kind == "quote" or b.kind == "item" and not b.children and b.start >= line.at))

    @staticmethod
    def mark(b: Block | None, blank: bool) -> None:
        """Whether the last line in b and in what holds it was blank."""
        while b is not None:
            b.blank = blank
            b = b.parent

    def html_start(self, b: Block, line: Line, bare: str, lazy: bool) -> bool:
        for k, (start, end) in enumerate(_HTML):
            if start.match(bare) and not (k == 6 and lazy):
                if not self.o.allow_html:
                    return False
                b = self.under(b)
                h = self.open_block(b, Block("html", line.place(), html=k))
                h.lines.append((line.rest(), line.place()))
                if end is not None and end.search(bare, 2 if k == 1 else 0):
                    self.finish(h)
                return True
        return False

    def setext(self, para: Block, level: int) -> bool:
        self.strip_references(para)
        if not para.lines:
            return False
        para.kind, para.level, para.mark = "heading", level, "setext"
        self.finish(para)
        return True

    def table(self, para: Block, bare: str) -> bool:
        bare = bare.rstrip(" \t")
        if not _DELIMITER.match(bare) or not ("|" in bare or ":" in bare or "|" in para.lines[-1][0] or True):
            return False
        cells = split_row(bare)
        if "|" not in bare and "|" not in para.lines[-1][0] and len(cells) == 1 and _SETEXT.match(bare):
            return False
        head = split_row(para.lines[-1][0], self.o.merged_table_cells)
        width = sum(n for _, n in head)
        if width != len(cells):
            head = split_row(para.lines[-1][0])
            width = len(head)
        if width != len(cells) or not cells:
            return False
        row = para.lines.pop()
        b = para.parent
        if para.lines:
            self.finish(para)
        else:
            b.drop(para)
            self.tip = b
        t = self.open_block(b, Block("table", row[1]))
        t.aligns = ["center" if c[0] == c[-1] == ":" and len(c) > 1 else "left" if c[0] == ":" else "right" if c[-1] == ":" else "" for c, _ in cells]
        if self.o.table_column_widths:
            t.widths = column_widths([c.count("-") for c, _ in cells])
        t.rows.append(row)
        return True

    def item(self, b: Block, line: Line, bare: str, indent: int, para: Block | None, lazy: bool) -> Block | None:
        m, ordered = _BULLET.match(bare), False
        if not m:
            m, ordered = _NUMBER.match(bare), True
            if not m:
                return None
        empty = not bare[m.end() :].strip(" \t")
        if para is not None and b.kind != "list" and (empty or ordered and int(m[1]) != 1):
            return None
        mark = m[2] if ordered else m[0]
        holder = b
        if b.kind not in ("list",):
            last = b.children[-1] if b.children else None
            holder = last if last is not None and last.kind == "list" and last.open else b
        same = holder.kind == "list" and holder.ordered == ordered and holder.mark == mark
        if not same and self.depth(b) >= DEEPEST:
            return None
        line.skip(indent)
        line.take(m.end())
        after = line.indent()
        pad = 1 if empty or after > 4 else after
        width = m.end() + pad
        line.skip(pad if not empty else min(pad, after))
        if same:
            self.close_to(holder)
        else:
            holder = self.open_block(self.under(b), Block("list", line.place(), ordered=ordered, number=int(m[1]) if ordered else 1, mark=mark))
        item = holder.add(Block("item", line.place(), indent=indent + width))
        self.tip = item
        if self.o.task_lists and not empty and (t := _TASK.match(line.bare())) and line.indent() <= 3:
            item.task = "x" if t[1] in "xX" else " "
            line.skip(line.indent())
            line.take(3)
            line.skip(1)
        return item

    def description(self, b: Block, para: Block | None, line: Line) -> Block | None:
        """A definition's description, its terms taken from the paragraph before it."""
        holder = b.parent if b.kind == "definitions" else b
        if para is not None:
            self.strip_references(para)
            if not para.lines:
                return None
            terms, loose, holder = para, False, para.parent
        else:
            last = holder.children[-1] if holder.children else None
            if last is not None and last.kind == "definitions":
                terms, loose = None, last.blank or last.children[-1].blank
            elif last is not None and last.kind == "paragraph" and last.lines:
                terms, loose = last, True
            else:
                return None
        self.close_to(holder if terms is not para or para is None else para)
        if terms is not None:
            if terms is self.tip:
                self.finish(terms)
            holder.drop(terms)
            before = holder.children[-1] if holder.children else None
            list_ = before if before is not None and before.kind == "definitions" else holder.add(Block("definitions", terms.start))
            for text, place in terms.lines:
                list_.add(Block("term", place)).lines.append((text.rstrip(" \t"), place))
        else:
            list_ = holder.children[-1]
        indent = line.indent()
        line.skip(indent)
        line.take(1)
        after = line.indent()
        pad = 1 if after > 4 else after
        line.skip(pad)
        d = list_.add(Block("description", line.place(), indent=indent + 1 + pad, tight=not loose))
        self.tip = d
        return d

    # ends of blocks

    def strip_references(self, p: Block) -> None:
        if not self.o.allow_link_refs or not p.lines or not p.lines[0][0].startswith("["):
            return
        s, at = p.text, 0
        while at < len(s) and (found := reference(s, at)):
            label, dest, name, at = found
            self.refs.setdefault(normalize_label(label), (dest, name))
        if at:
            n = s[:at].count("\n") + (at >= len(s))
            p.lines = p.lines[n:]

    def finish(self, b: Block) -> None:
        parent, b.open = b.parent, False
        if b.kind == "paragraph":
            self.strip_references(b)
            if b.lines:
                last, place = b.lines[-1]
                b.lines[-1] = (last.rstrip(" \t\r"), place)
            elif b in parent.children[-1:]:
                parent.children.pop()
        elif b.kind == "code" and not b.fence:
            while b.lines and not b.lines[-1][0].strip(" \t"):
                b.lines.pop()
        elif b.kind == "list":
            for k, item in enumerate(b.children):
                more = k < len(b.children) - 1
                inner = item.children
                if more and self.ends_blank(item) or any(self.ends_blank(x) for x in (inner if more else inner[:-1])):
                    b.tight = False
        self.tip = parent

    def ends_blank(self, b: Block) -> bool:
        while b is not None:
            if b.blank:
                return True
            b = b.children[-1] if b.kind in ("list", "item") and b.children else None
        return False
