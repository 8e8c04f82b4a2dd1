"""The tree of a document to HTML, with its headings."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from . import text as T
from .blocks import Block, Parser, split_row
from .inline import parse_inline
from .options import Options

Renderer = Callable[[str | None, str | None, str], str | None]


@dataclass
class Result:
    html: str
    front_matter: str | None = None
    headings: list[dict] = field(default_factory=list)


class Writer:
    def __init__(self, parser: Parser, opts: Options, renderer: Renderer | None = None):
        self.p, self.o, self.renderer = parser, opts, renderer
        self.out: list[str] = []
        self.slugs: dict[str, int] = {}
        self.headings: list[dict] = []
        self.numbers: dict[str, int] = {}
        self.order: list[tuple[str, str]] = []
        self.first_in_item = self.need_line = self.loose_line = False

    def write(self, *parts: str) -> None:
        self.out += parts

    # inline

    def url(self, raw: str, base: bool = False) -> str:
        if not self.o.trusted and not T.is_safe_url(raw):
            return ""
        return T.encode_destination(T.with_base(raw, self.o.link_base_path) if base else raw)

    def text(self, raw: str) -> str:
        return T.escape_text(T.decode_entities(raw))

    def html(self, raw: str) -> str:
        if not self.o.trusted:
            return T.escape_text(raw)
        return T.filter_html(raw) if self.o.disallowed_raw_html else raw

    def inline(self, s: str) -> str:
        if not s:
            return ""
        items = parse_inline(s, self.o, self.p.refs, self.p.notes if self.o.footnotes else None)
        out: list[str] = []
        images = 0
        tails: list[str] = []
        for x in items:
            kind = x[0]
            if kind == "image":
                if not images:
                    out.append(f'<img src="{self.url(x[3])}" alt="')
                    tails.append(x[4])
                images += 1
            elif kind == "end_image":
                images -= 1
                if not images:
                    name = tails.pop()
                    out.append('"' + self.title(name) + " />")
            elif images:
                out.append(self.alt(s, x))
            else:
                out.append(self.item(s, x))
        return "".join(out)

    def alt(self, s: str, x: list) -> str:
        kind = x[0]
        if kind == "text":
            return T.escape_attr(s[x[1] : x[2]])
        if kind in ("escape", "code", "auto", "literal", "math"):
            return T.escape_attr(x[3])
        return {"soft": "\n", "hard": "\n"}.get(kind, "")

    def title(self, name: str | None) -> str:
        return "" if name is None else f' title="{T.escape_attr(T.unescape(name))}"'

    def item(self, s: str, x: list) -> str:
        kind = x[0]
        if kind == "text":
            return self.text(s[x[1] : x[2]])
        if kind == "escape":
            return T.escape_text(x[3])
        if kind == "soft":
            return "\n"
        if kind == "hard":
            return "<br />\n"
        if kind == "code":
            return f"<code>{T.escape_text(x[3])}</code>"
        if kind == "open":
            return f"<{x[3]}>"
        if kind == "close":
            return f"</{x[3]}>"
        if kind == "link":
            return f'<a href="{self.url(x[3], True)}"{self.title(x[4])}>'
        if kind == "end_link":
            return "</a>"
        if kind == "html":
            return self.html(x[3])
        if kind == "auto":
            ok = x[4] or self.o.trusted or T.is_safe_url(x[3])
            return f'<a href="{("mailto:" if x[4] else "") + T.encode_autolink(x[3]) if ok else ""}">{T.escape_text(x[3])}</a>'
        if kind == "literal":
            before = {"www": "http://", "email": "mailto:", "url": ""}[x[4]]
            ok = x[4] != "url" or self.o.trusted or T.is_safe_url(x[3])
            return f'<a href="{before + T.encode_autolink(x[3]) if ok else ""}">{T.escape_text(x[3])}</a>'
        if kind == "math":
            return f'<code class="language-math math-{"display" if x[4] else "inline"}">{T.escape_text(x[3])}</code>'
        if kind == "note":
            if x[3] not in self.numbers:
                self.order.append(("note", x[3]))
                self.numbers[x[3]] = len(self.order)
            label = T.escape_attr(self.p.notes[x[3]].info)
            return f'<sup><a href="#user-content-fn-{label}" id="user-content-fnref-{label}" data-footnote-ref>{self.numbers[x[3]]}</a></sup>'
        self.order.append(("inline", x[3]))
        n = len(self.order)
        k = sum(kind == "inline" for kind, _ in self.order)
        return f'<sup><a href="#user-content-inline-fn-{k}" id="user-content-inline-fnref-{k}" data-footnote-ref>{n}</a></sup>'

    # blocks

    def before(self, kind: str) -> None:
        if self.first_in_item:
            self.write("\n")
            self.first_in_item = self.need_line = False
        elif self.need_line and kind in ("heading", "quote", "list", "table", "definitions"):
            self.write("\n")
            self.need_line = False
        if self.loose_line and kind not in ("heading", "break"):
            self.write("\n")
            self.loose_line = False

    def blocks(self, children: list[Block], backref: str = "") -> None:
        last = max((k for k, b in enumerate(children) if b.kind == "paragraph"), default=-1)
        for k, b in enumerate(children):
            self.block(b, backref if k == last else "")

    def block(self, b: Block, backref: str = "") -> None:
        kind = b.kind
        if kind == "paragraph":
            self.paragraph(b, backref)
            return
        if kind == "note":
            return
        if kind not in ("term", "description"):
            self.before(kind)
        getattr(self, "b_" + kind)(b)

    def paragraph(self, b: Block, backref: str) -> None:
        up = b.parent
        bare = up.kind == "item" and up.parent.tight or up.kind == "description" and up.tight and next((c for c in up.children if c.kind == "paragraph"), None) is b
        body = self.inline(b.text)
        if up.kind == "item" and up.task and up.children[0] is b:
            body = f'<input type="checkbox" {"checked=\"\" " if up.task == "x" else ""}disabled="" /> ' + body
        if bare:
            self.first_in_item = False
            self.write(body, backref)
            self.need_line = True
            return
        if self.first_in_item or self.loose_line:
            self.write("\n")
            self.first_in_item = self.loose_line = False
        self.write("<p>", body, backref, "</p>\n")

    def b_heading(self, b: Block) -> None:
        raw = b.text
        html = self.inline(raw)
        ident = None
        if self.o.heading_ids:
            base = T.slug(raw)
            seen = self.slugs.get(base)
            self.slugs[base] = (seen or 0) + 1
            ident = base if seen is None else f"{base}-{seen}"
        self.headings.append({"level": b.level, "id": ident, "text": T.plain_heading(html)})
        attr = f' id="{T.escape_attr(ident)}"' if ident is not None else ""
        self.write(f"<h{b.level}{attr}>", html, f"</h{b.level}>\n")

    def b_break(self, b: Block) -> None:
        self.write("<hr />\n")

    def b_code(self, b: Block) -> None:
        code = self.p.raw(b)
        if b.fence and self.renderer is not None:
            word, _, meta = re.match(r"([^ \t\n\r\f]*)([ \t\n\r\f]*)([\s\S]*)", b.info).groups()
            try:
                own = self.renderer(T.unescape(word) or None, T.unescape(meta.strip(" \t\n\r\f")) or None, code)
            except Exception:  # a renderer that fails leaves the block to us
                own = None
            if own is not None:
                self.write(own)
                return
        word = re.match(r"[^ \t\n\r\f]*", b.info)[0] if b.info else ""
        kind = f' class="language-{T.escape_attr(T.unescape(word))}"' if word else ""
        self.write(f"<pre><code{kind}>", T.escape_text(code), "</code></pre>\n")

    def b_html(self, b: Block) -> None:
        self.write(self.html(self.p.raw(b)))

    def b_quote(self, b: Block) -> None:
        flags = self.first_in_item, self.need_line, self.loose_line
        self.first_in_item = self.need_line = self.loose_line = False
        if b.info:
            self.write(f'<div class="markdown-alert markdown-alert-{b.info}">\n<p class="markdown-alert-title">{b.info.title()}</p>\n')
            self.blocks(b.children)
            self.write("</div>\n")
        else:
            self.write("<blockquote>\n")
            self.blocks(b.children)
            self.write("</blockquote>\n")
        self.first_in_item, self.need_line, self.loose_line = flags

    def b_list(self, b: Block) -> None:
        if b.ordered:
            self.write("<ol>\n" if b.number == 1 else f'<ol start="{b.number}">\n')
        else:
            self.write("<ul>\n")
        for item in b.children:
            self.write("<li>")
            self.first_in_item, self.loose_line, self.need_line = b.tight, not b.tight, False
            self.blocks(item.children)
            self.first_in_item = self.loose_line = self.need_line = False
            self.write("</li>\n")
        self.write("</ol>\n" if b.ordered else "</ul>\n")

    def b_definitions(self, b: Block) -> None:
        self.write("<dl>\n")
        for x in b.children:
            self.first_in_item = self.need_line = False
            self.loose_line = False
            if x.kind == "term":
                self.write("<dt>", self.inline(x.text), "</dt>\n")
            else:
                self.loose_line = not x.tight
                self.write("<dd>")
                self.blocks(x.children)
                self.loose_line = self.need_line = False
                self.write("</dd>\n")
        self.write("</dl>\n")

    def b_table(self, b: Block) -> None:
        self.write("<table>\n")
        if b.widths:
            self.write("<colgroup>\n", *(f'<col style="width: {self.percent(w)}%">\n' for w in b.widths), "</colgroup>\n")
        self.write("<thead>\n")
        self.row(b, b.rows[0][0], "th")
        self.write("</thead>\n")
        if len(b.rows) > 1:
            self.write("<tbody>\n")
            for row, _ in b.rows[1:]:
                self.row(b, row, "td")
            self.write("</tbody>\n")
        self.write("</table>\n")

    @staticmethod
    def percent(points: int) -> str:
        return f"{points // 100}.{points % 100:02d}".rstrip("0").rstrip(".")

    def row(self, b: Block, row: str, tag: str) -> None:
        self.write("<tr>\n")
        at, width = 0, len(b.aligns)
        for cell, span in [*split_row(row, self.o.merged_table_cells), *[("", 1)] * width]:
            if at >= width:
                break
            span = min(span, width - at)
            attrs = (f' align="{b.aligns[at]}"' if b.aligns[at] else "") + (f' colspan="{span}"' if span > 1 else "")
            self.write(f"<{tag}{attrs}>", self.inline(cell.replace("\\|", "|")), f"</{tag}>\n")
            at += span
        self.write("</tr>\n")

    def notes(self) -> None:
        if not self.order:
            return
        self.write('<section data-footnotes class="footnotes">\n<ol>\n')
        k = 0
        for n, (kind, what) in enumerate(self.order, 1):
            if kind == "note":
                note = self.p.notes[what]
                label = T.escape_attr(note.info)
                inner = Writer(self.p, self.o.with_(inline_footnotes=False), self.renderer)
                self.write(f'<li id="user-content-fn-{label}">\n')
                back = f' <a href="#user-content-fnref-{label}" class="data-footnote-backref" aria-label="Back to reference {n}">↩</a>'
                inner.blocks(note.children, back)
                self.write(*inner.out, "</li>\n")
            else:
                k += 1
                inner = Writer(self.p, self.o.with_(inline_footnotes=False, footnotes=False), self.renderer)
                back = f' <a href="#user-content-inline-fnref-{k}" class="data-footnote-backref" aria-label="Back to reference {n}">↩</a>'
                self.write(f'<li id="user-content-inline-fn-{k}">\n<p>', inner.inline(what), back, "</p>\n</li>\n")
        self.write("</ol>\n</section>\n")


def parse_blocks(s: str, opts: Options) -> tuple[Block, Parser]:
    parser = Parser(opts)
    return parser.parse(s.replace("\0", "\ufffd")), parser


def compile_document(s: str | None, opts: Options, renderer: Renderer | None = None) -> Result:
    """HTML, front matter and headings of one document; a null document is an empty one."""
    front, body = T.front_matter(s or "") if opts.front_matter else (None, s or "")
    root, parser = parse_blocks(body, opts)
    w = Writer(parser, opts, renderer)
    w.blocks(root.children)
    w.notes()
    return Result("".join(w.out), front, w.headings)


def to_html(s: str | None, opts: Options, renderer: Renderer | None = None) -> str:
    return compile_document(s, opts, renderer).html
