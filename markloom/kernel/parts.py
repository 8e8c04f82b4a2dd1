"""Parts of one document: where it can be cut, what a part has and wants, and a part's HTML.

A cut lies after a blank line and before a line that starts with a letter or `#`: such a line continues no container,
paragraph or table, so all that is open there ends, except a fence or HTML block of the document itself, which is
found when the part before is parsed (`open_end`) and which `resume` follows to its end.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from . import text as T
from .blocks import _HTML, Block
from .options import DEFAULT, Options
from .render import Writer, parse_blocks

_CUT = re.compile(r"\n[ \t]*\r?\n(?=[A-Za-z#])")
#: With definition lists a paragraph may be a term of the list before it; a heading may not.
_CUT_AT_HEADING = re.compile(r"\n[ \t]*\r?\n(?=#{1,6}[ \t])")
_LABEL = re.compile(r"(?=\[((?:[^\\\[\]]|\\[\s\S]){1,999})\])")
_NOTE = re.compile(r"\[\^([A-Za-z0-9_-]+)\]")
#: Stands around a note's label where its number will be; the compiler's output has no NUL of its own.
HOLE = "\0"


def cut(s: str, size: int, opts: Options = DEFAULT) -> list[str]:
    """s in parts that are cut at the first place after each `size` characters; joined they are s."""
    out, start = [], 0
    place = _CUT_AT_HEADING if opts.definition_lists else _CUT
    while (m := place.search(s, start + size)) and m.end() < len(s):
        out.append(s[start : m.end()])
        start = m.end()
    return [*out, s[start:]]


def open_end(s: str, opts: Options) -> str | None:
    """What is open at the end of a part: a fence as it was opened, or the number of the kind of HTML block."""
    return _open(parse_blocks(s, opts)[1].left_open)


def _open(b: Block | None) -> str | None:
    return None if b is None else b.fence or str(b.html)


def resume(s: str, state: str) -> int | None:
    """Where the line ends with which the open block ends, if it does in s."""
    if state[0] in "`~":
        m = re.compile(rf"^ {{0,3}}{re.escape(state[0])}{{{len(state)},}}[ \t]*\r?$", re.M).search(s)
    else:
        m = _HTML[int(state)][1].search(s)
    if m is None:
        return None
    at = s.find("\n", m.end())
    return len(s) if at < 0 else at + 1


@dataclass
class Facts:
    """What a part has for the others and may want of them."""

    open: str | None
    refs: list[dict] = field(default_factory=list)
    notes: list[dict] = field(default_factory=list)
    slugs: dict[str, int] = field(default_factory=dict)
    labels: list[str] = field(default_factory=list)
    note_labels: list[str] = field(default_factory=list)


def _leaves(b: Block, notes: bool):
    for c in b.children:
        if c.kind != "note" or notes:
            yield c
            yield from _leaves(c, notes)


def facts(s: str, opts: Options) -> Facts:
    root, parser = parse_blocks(s, opts)
    labels, noted = set(), set()
    for b in _leaves(root, True):
        for t in (b.text, *[x for row, _ in b.rows for x in (row, row.replace("\\|", "|"))]) if b.kind not in ("code", "html") else ():
            labels.update(T.normalize_label(m[1]) for m in _LABEL.finditer(t))
            noted.update(m[1].lower() for m in _NOTE.finditer(t))
    slugs = Counter(T.slug(b.text) for b in _leaves(root, False) if b.kind == "heading") if opts.heading_ids else {}
    return Facts(
        _open(parser.left_open), [{"label": k, "url": u, "title": t} for k, (u, t) in parser.refs.items()], [{"label": k, "info": b.info} for k, b in parser.notes.items()] if opts.footnotes else [],
        dict(slugs), sorted(labels - {""}) if opts.allow_link_refs else [], sorted(noted) if opts.footnotes else [],
    )


class _Holes(Writer):
    """Leaves the numbers of notes open and says in what order they come up."""

    def item(self, s: str, x: list) -> str:
        if x[0] != "note":
            return super().item(s, x)
        if x[3] not in self.numbers:
            self.numbers[x[3]] = len(self.numbers)
        label = T.escape_attr(self.p.notes[x[3]].info)
        return f'<sup><a href="#user-content-fn-{label}" id="user-content-fnref-{label}" data-footnote-ref>{HOLE}{x[3]}{HOLE}</a></sup>'


@dataclass
class Part:
    html: str
    headings: list[dict]
    order: list[str]
    notes: list[dict]


def compile_part(s: str, opts: Options, refs: dict, notes: dict[str, str], own: set[str], slugs: dict[str, int]) -> Part:
    """A part's HTML with holes. refs, notes (label -> as written): those of the document that it may want; own: the
    labels whose definition in this part is the document's; slugs: how often each heading's id was made before."""
    root, parser = parse_blocks(s, opts)
    mine = {k: b for k, b in parser.notes.items() if k in own}
    parser.refs, parser.notes = refs, {k: mine.get(k) or Block("note", info=info) for k, info in notes.items()} | mine
    w = _Holes(parser, opts)
    w.slugs = dict(slugs)
    w.blocks(root.children)
    done = []
    for label, b in mine.items():
        inner, name = Writer(parser, opts), T.escape_attr(b.info)
        inner.blocks(b.children, f' <a href="#user-content-fnref-{name}" class="data-footnote-backref" aria-label="Back to reference {HOLE}{label}{HOLE}">↩</a>')
        done.append({"label": label, "html": f'<li id="user-content-fn-{name}">\n' + "".join(inner.out) + "</li>\n"})
    return Part("".join(w.out), w.headings, list(w.numbers), done)
