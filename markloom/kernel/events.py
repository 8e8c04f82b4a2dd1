"""Flat event lists: of blocks with places in the document, of inline content, and of MDX documents."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from .blocks import Block, Parser, split_row
from .inline import parse_inline
from .mdx import byte_offsets, diagnostics, expression_end, segments, tag_at
from .options import DEFAULT, Options
from .render import parse_blocks
from .text import front_matter

#: Version of the order and balance of events.
VERSION = 2
_PLACES = ("start", "end", "url_start", "url_end")

#: One column for each payload of an event; seq restores the order.
FIELDS = {
    "seq": "int", "layer": "string", "kind": "string", "level": "int", "tight": "boolean", "list_kind": "string", "list_start": "int",
    "list_delim": "string", "task": "string", "callout": "string", "align": "string", "colspan": "int", "basis_points": "int", "info": "string",
    "spaces": "int", "start": "long", "end": "long", "url": "string", "url_start": "long", "url_end": "long", "def_index": "int", "title": "string", "label": "string", "is_email": "boolean", "literal_kind": "string", "text": "string",
}
_INLINE = {
    "text": "Text", "escape": "EscapedChar", "code": "Code", "soft": "SoftBreak", "hard": "HardBreak", "html": "Html", "auto": "Autolink",
    "literal": "AutolinkLiteral", "note": "FootnoteRef", "inline_note": "InlineFootnote", "link": "LinkStart", "end_link": "LinkEnd",
    "image": "ImageStart", "end_image": "ImageEnd",
}
_PAIR = {"em": "Emphasis", "strong": "Strong", "del": "Strikethrough", "sub": "Subscript", "sup": "Superscript", "mark": "Highlight"}


def numbers(refs: dict | None) -> dict[str, int]:
    """The number of each label's definition, the `def_index` of events that refer to it."""
    return {label: k for k, label in enumerate(refs or ())}


def inline_events(s: str, opts: Options = DEFAULT, refs: dict | None = None, notes: dict | None = None, index: dict[str, int] | None = None) -> list[dict]:
    """Events of one piece of inline content; start and end are places in it.

    A link or image by reference has the number of its definition among `refs`, beside the definition's url and title.
    """
    out = []
    index = numbers(refs) if index is None else index
    for x in parse_inline(s, opts, refs, notes):
        kind = x[0]
        e = {"layer": "inline", "start": x[1], "end": x[2]}
        if kind in ("open", "close"):
            e["kind"] = _PAIR[x[3]] + ("Start" if kind == "open" else "End")
        elif kind == "math":
            e["kind"], e["text"] = "MathDisplay" if x[4] else "MathInline", x[3]
        else:
            e["kind"] = _INLINE[kind]
            if kind in ("link", "image"):
                e |= {"url": x[3], "title": x[4]}
                if x[6] is None:
                    e |= {"url_start": x[5], "url_end": x[5] + len(x[3])}
                else:
                    e |= {"kind": e["kind"] + "Ref", "def_index": index[x[6]]}
            elif kind == "auto":
                e |= {"url": x[3], "is_email": x[4], "url_start": x[1] + 1, "url_end": x[2] - 1}
            elif kind == "literal":
                e |= {"url": x[3], "literal_kind": x[4], "url_start": x[1], "url_end": x[2]}
            elif kind == "note":
                e["label"] = x[3]
            elif kind in ("escape", "code", "inline_note", "html"):
                e["text"] = x[3]
        out.append(e)
    return out


def split_mdx(s: str, found: list[dict]) -> list[dict]:
    """Takes expressions and tags out of text events."""
    out = []
    for e in found:
        if e["kind"] != "Text":
            out.append(e)
            continue
        begin, i, end = e["start"], e["start"], e["end"]
        part = s[:end]
        while i < end:
            stop, kind = None, None
            if part[i] == "{":
                stop, kind = expression_end(part, i), "MdxExpression"
            elif part[i] == "<" and (tag := tag_at(part, i)):
                stop, kind = tag.end, "MdxJsxClose" if tag.closing else "MdxJsxSelfClose" if tag.empty else "MdxJsxOpen"
            if stop is None:
                i += 1
                continue
            if begin < i:
                out.append(e | {"start": begin, "end": i})
            out.append({"layer": "inline", "kind": kind, "start": i, "end": stop, "text": part[i:stop]})
            begin = i = stop
        if begin < end:
            out.append(e | {"start": begin, "end": end})
    return out


def promoted(s: str, found: list[dict]) -> list[dict]:
    """A container's paragraph of one tag or expression alone becomes a flow event."""
    out, depth, k = [], 0, 0
    while k < len(found):
        kind = found[k]["kind"]
        if kind == "ParagraphStart" and depth:
            end = next(i for i in range(k, len(found)) if found[i]["kind"] == "ParagraphEnd")
            rest = [e for e in found[k + 1 : end] if not (e["kind"] == "SoftBreak" or e["kind"] == "Text" and not s[e["start"] : e["end"]].strip(" \t\r\n\f"))]
            if len(rest) == 1 and rest[0]["kind"].startswith("Mdx"):
                name = rest[0]["kind"].removeprefix("Mdx")
                out.append(rest[0] | {"layer": "mdx", "kind": "Flow" + name})
                k = end + 1
                continue
        if kind in ("BlockQuoteStart", "ListItemStart", "DefinitionDescriptionStart"):
            depth += 1
        elif kind in ("BlockQuoteEnd", "ListItemEnd", "DefinitionDescriptionEnd"):
            depth -= 1
        out.append(found[k])
        k += 1
    return out


class _Blocks:
    def __init__(self, parser: Parser, opts: Options, inline: bool, mdx: bool = False):
        self.p, self.o, self.inline, self.mdx, self.out = parser, opts, inline, mdx, []
        self.index = numbers(parser.refs)

    def add(self, kind: str, **more) -> None:
        self.out.append({"layer": "block", "kind": kind} | more)

    def content(self, lines: list[tuple[str, int]]) -> None:
        if self.inline:
            s = "\n".join(x for x, _ in lines)
            starts, at = [], 0
            for x, _ in lines:
                starts.append(at)
                at += len(x) + 1

            def place(k: int) -> int:
                n = bisect_right(starts, k) - 1
                return lines[n][1] + k - starts[n]

            found = inline_events(s, self.o, self.p.refs, self.p.notes if self.o.footnotes else None, self.index)
            for e in split_mdx(s, found) if self.mdx else found:
                for a, b in (("start", "end"), ("url_start", "url_end")):
                    if e.get(a) is not None:
                        e[a], e[b] = place(e[a]), place(max(e[b] - 1, e[a])) + (e[b] > e[a])
                self.out.append(e)
            return
        for k, (x, at) in enumerate(lines):
            if k:
                self.add("SoftBreak")
            self.add("Text", start=at, end=at + len(x))

    def feed(self, at: int) -> str:
        """The line feed of a raw line; the text's last line may have none."""
        return "" if at >= self.p.unended >= 0 else "\n"

    def walk(self, b: Block) -> None:
        k = b.kind
        if k == "paragraph":
            self.wrap("Paragraph", b.lines)
        elif k == "heading":
            self.wrap("Heading", b.lines, level=b.level)
        elif k == "break":
            self.add("ThematicBreak", start=b.start, end=b.end)
        elif k == "code":
            self.add("CodeBlockStart", info=b.info if b.fence else None, start=b.start)
            for x, at in b.lines:
                spaces = 0 if b.fence else len(x) - len(x.lstrip(" "))
                if spaces:
                    self.add("VirtualSpaces", spaces=spaces)
                feed = self.feed(at)
                self.add("Code", start=at, end=at + len(x) - spaces + len(feed), text=x[spaces:] + feed)
            self.add("CodeBlockEnd")
        elif k == "html":
            self.add("HtmlBlockStart")
            for x, at in b.lines:
                self.add("HtmlBlockText", start=at, end=at + len(x) + len(self.feed(at)))
            self.add("HtmlBlockEnd")
        elif k == "table":
            self.table(b)
        elif k == "term":
            self.wrap("DefinitionTerm", b.lines)
        elif k != "note":
            name, more = {
                "quote": ("BlockQuote", {"callout": b.info or None}),
                "list": ("List", {"tight": b.tight, "list_kind": "ordered" if b.ordered else "unordered", "list_start": b.number if b.ordered else None, "list_delim": b.mark}),
                "item": ("ListItem", {"task": None if b.task is None else "checked" if b.task == "x" else "unchecked"}),
                "definitions": ("DefinitionList", {}),
                "description": ("DefinitionDescription", {"tight": b.tight}),
            }[k]
            self.add(name + "Start", **more)
            for c in b.children:
                self.walk(c)
            self.add(name + "End", **({"tight": b.tight} if k == "list" else {}))

    def wrap(self, name: str, lines: list, **more) -> None:
        self.add(name + "Start", **more)
        self.content(lines)
        self.add(name + "End", **more)

    def table(self, b: Block) -> None:
        self.add("TableStart")
        if b.widths:
            self.add("TableColumnWidthsStart")
            for w in b.widths:
                self.add("TableColumnWidth", basis_points=w)
            self.add("TableColumnWidthsEnd")
        for k, (row, at) in enumerate(b.rows):
            if k < 2:
                self.add("TableHeadStart" if not k else "TableBodyStart")
            self.add("TableRowStart")
            column, width = 0, len(b.aligns)
            for cell, span in [*split_row(row, self.o.merged_table_cells), *[("", 1)] * width]:
                if column >= width:
                    break
                span = min(span, width - column)
                self.add("TableCellStart", align=b.aligns[column] or None, colspan=span)
                if cell:
                    place = at + max(row.find(cell), 0)
                    self.content([(cell, place)])
                self.add("TableCellEnd")
                column += span
            self.add("TableRowEnd")
            if k == 0:
                self.add("TableHeadEnd")
        if len(b.rows) > 1:
            self.add("TableBodyEnd")
        self.add("TableEnd")


def _numbered(s: str, found: list[dict]) -> list[dict]:
    """Adds seq and turns places into byte offsets."""
    for k, e in enumerate(found):
        e["seq"] = k
    if not s.isascii():
        at = sorted({e[k] for e in found for k in _PLACES if e.get(k) is not None})
        to = dict(zip(at, byte_offsets(s, at)))
        for e in found:
            for f in _PLACES:
                if e.get(f) is not None:
                    e[f] = to[e[f]]
    return found


def block_events(s: str | None, opts: Options = DEFAULT, inline: bool = False) -> list[dict]:
    """Events of all blocks; with inline, text and breaks are replaced by events of inline content."""
    return ended_events(s, opts, inline)[0]


def ended_events(s: str | None, opts: Options = DEFAULT, inline: bool = False) -> tuple[list[dict], bool]:
    """The events of `block_events`, and whether a fence or HTML block is open where the text ends."""
    s = s or ""
    root, parser = parse_blocks(s, opts)
    w = _Blocks(parser, opts, inline)
    for b in root.children:
        w.walk(b)
    for start, end in parser.comments:
        k = next((i for i, e in enumerate(w.out) if (e.get("start") or 0) > start), len(w.out))
        w.out.insert(k, {"layer": "block", "kind": "Comment", "start": start, "end": end})
    return _numbered(s, w.out), parser.left_open is not None


def note_definitions(s: str | None, opts: Options = DEFAULT) -> list[dict]:
    """Definitions of notes that count, the first of each label, and where their bodies start (bytes of UTF-8)."""
    s = s or ""
    _, parser = parse_blocks(s, opts)
    found = sorted(parser.notes.items(), key=lambda x: x[1].start)
    starts = byte_offsets(s, [b.start for _, b in found])
    return [{"label": label, "start": at} for (label, _), at in zip(found, starts)]


def link_references(s: str | None, opts: Options = DEFAULT) -> list[dict]:
    """Link reference definitions by label; the first of a label is the one that counts."""
    _, parser = parse_blocks(s or "", opts)
    return [{"label": k, "url": u, "title": t} for k, (u, t) in parser.refs.items()]


@dataclass
class MdxEvents:
    """Events of an MDX document, the version of their contract, and the definitions that `def_index` counts."""

    events: list[dict]
    link_references: list[dict]
    version: int = VERSION

    def link_reference(self, index: int) -> dict | None:
        return self.link_references[index] if 0 <= index < len(self.link_references) else None


_RANGED = {
    "HtmlBlockText", "Comment", "Text", "Code", "ThematicBreak", "Html", "MathInline", "MathDisplay", "MdxExpression", "MdxJsxOpen", "MdxJsxClose", "MdxJsxSelfClose",
}


def source_range(event: dict) -> tuple[int, int] | None:
    """The primary place of an event: a target's for links, images and autolinks; None for starts and ends."""
    if event.get("url_start") is not None:
        return event["url_start"], event["url_end"]
    if event["layer"] == "mdx" or event["kind"] in _RANGED:
        return event["start"], event["end"]
    return None


def mdx_events(s: str | None, strict: bool = False) -> list[dict]:
    """The events of `mdx_stream` alone."""
    return mdx_stream(s, strict).events


def mdx_stream(s: str | None, strict: bool = False) -> MdxEvents:
    """Events of an MDX document: front matter, ESM, tags and expressions in flow, and what Markdown holds.

    Link references hold for the whole document, the first of a label counts. With strict, a document with
    diagnostics raises ValueError.
    """
    whole = s or ""
    front, body = front_matter(whole)
    shift = len(whole) - len(body)
    if strict and (found := diagnostics(body)):
        raise ValueError("; ".join(d.message for d in found))
    opts = DEFAULT.with_(allow_html=False, front_matter=False, strikethrough=True, autolink_literals=True)
    out = [] if front is None else [{"layer": "mdx", "kind": "FrontMatter", "start": 0, "end": shift, "text": front}]
    parts = segments(body)
    parsed = {k: parse_blocks(x.text, opts) for k, x in enumerate(parts) if x.kind == "Markdown"}
    refs: dict = {}
    for _, p in parsed.values():
        for label, target in p.refs.items():
            refs.setdefault(label, target)
    for k, x in enumerate(parts):
        if x.kind != "Markdown":
            kind = {"Esm": "Esm", "Expression": "FlowExpression"}.get(x.kind, x.kind.replace("JsxBlock", "FlowJsx"))
            out.append({"layer": "mdx", "kind": kind, "start": x.start + shift, "end": x.end + shift, "text": x.text})
            continue
        root, p = parsed[k]
        p.refs = refs
        w = _Blocks(p, opts, True, True)
        for b in root.children:
            w.walk(b)
        w.out = promoted(x.text, w.out)
        for e in w.out:
            for f in _PLACES:
                if e.get(f) is not None:
                    e[f] += x.start + shift
        out += w.out
    return MdxEvents(_numbered(whole, out), [{"label": k, "url": u, "title": t} for k, (u, t) in refs.items()])
