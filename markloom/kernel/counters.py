"""What the compiler did for a document, as numbers that add up over documents (and one that is a maximum)."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .blocks import Block
from .events import _Blocks
from .inline import _SPECIAL, Inline
from .options import DEFAULT, Options
from .render import parse_blocks
from .shapes import _MARK, Shapes

_CONTAINER, _TABLE, _CODE = ("List", "BlockQuote"), ("Table",), ("Code", "VirtualSpaces")
_LINK = {"link", "end_link", "image", "end_image", "auto", "literal"}


@dataclass
class Counts:
    """Block events, all and of some groups; inline parses, their characters, how many took the plain way, their events and marks."""

    documents: int = 0
    block_events: int = 0
    container_events: int = 0
    table_events: int = 0
    code_events: int = 0
    inline_parses: int = 0
    inline_chars: int = 0
    inline_fast_paths: int = 0
    inline_events: int = 0
    inline_links: int = 0
    inline_html: int = 0
    inline_marks: int = 0
    longest_inline: int = 0

    def add(self, other: Counts) -> Counts:
        for name in SUMS:
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.longest_inline = max(self.longest_inline, other.longest_inline)
        return self


SUMS = tuple(f for f in Counts.__dataclass_fields__ if f != "longest_inline")


class _Counting(_Blocks):
    """Walks a tree as for events and keeps no event."""

    def __init__(self, parser, opts: Options):
        super().__init__(parser, opts, True)
        self.n = Counts(documents=1)
        self.contents: list[str] = []

    def add(self, kind: str, **more) -> None:
        n = self.n
        n.block_events += 1
        n.container_events += kind.startswith(_CONTAINER)
        n.table_events += kind.startswith(_TABLE)
        n.code_events += kind.startswith(_CODE)

    def content(self, lines: list[tuple[str, int]]) -> None:
        s, n = "\n".join(x for x, _ in lines), self.n
        self.contents.append(s)
        n.inline_parses += 1
        n.inline_chars += len(s)
        n.longest_inline = max(n.longest_inline, len(s))
        if not _SPECIAL.search(s):
            n.inline_fast_paths += 1
            n.inline_events += bool(s)
            return
        inline = Inline(s, self.o, self.p.refs, self.p.notes if self.o.footnotes else None)
        found = inline.parse()
        n.inline_marks += inline.n_marks
        n.inline_events += len(found)
        n.inline_links += sum(x[0] in _LINK for x in found)
        n.inline_html += sum(x[0] == "html" for x in found)


def counts(s: str | None, opts: Options = DEFAULT) -> Counts:
    """The counts of one document; notes' bodies are not walked, as in its events."""
    if s is None:
        return Counts(documents=1)
    return _walked(s, opts).n


def _walked(s: str, opts: Options) -> _Counting:
    root: Block
    root, parser = parse_blocks(s, opts)
    w = _Counting(parser, opts)
    for b in root.children:
        w.walk(b)
    return w


class ShapedCounts(Shapes):
    """`counts` of texts, once for each shape; characters are counted with a text's own numbers."""

    def __init__(self, opts: Options):
        super().__init__(lambda s: counts(s, opts), ("counts", opts))
        self.opts = opts

    def made(self, text: str):
        w = _walked(text, self.opts)
        known = [(len(_MARK.sub("", s)), [int(k) for k in _MARK.findall(s)]) for s in w.contents]

        def own(runs: list[str]) -> Counts:
            sizes = [n + sum(len(runs[k]) for k in at) for n, at in known]
            return replace(w.n, inline_chars=sum(sizes), longest_inline=max(sizes, default=0))

        return own, 2 * len(text)
