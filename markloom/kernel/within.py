"""What the events of one document stand in: containers around them and headings above them.

A document is taken piece by piece where that changes nothing: it is cut after blank lines where text, a heading or a bracket
begins a line, if it defines no links and notes and no piece leaves a fence open. Pieces of one shape are compiled once.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

from .events import ended_events
from .options import Options
from .shapes import Shapes
from .text import decode_entities

_CUT = re.compile(r"\n\n(?=[A-Za-z#\[])")
_TARGETS = frozenset({"LinkStart", "LinkStartRef", "ImageStart", "ImageStartRef", "Autolink", "AutolinkLiteral", "CodeBlockStart"})


def pieces(s: str, opts: Options) -> list[str]:
    """Pieces that compile one by one as in the whole, unless one leaves a block open; joined they are s."""
    if "]:" in s or opts.definition_lists or opts.line_comments:
        return [s]
    ends = [m.end() for m in _CUT.finditer(s)]
    return [s[a:b] for a, b in zip([0, *ends], [*ends, len(s)]) if a < b]


class Pieces:
    """A document's results by piece: lists of dicts whose places (seq and the like) are the whole document's."""

    def __init__(self, name, opts: Options, places: tuple[str, ...]):
        self.opts, self.places = opts, places
        self.of_piece = Shapes(self.piece, (name, opts))

    def found(self, events: list[dict]) -> list[dict]:
        raise NotImplementedError

    def piece(self, s: str) -> dict:
        self.source = s.replace("\0", "\ufffd").encode()
        events, left_open = ended_events(s, self.opts, True)
        return {"n": len(events), "open": left_open, "rows": self.found(events)}

    def rows(self, s: str) -> Iterator[dict]:
        """Rows of all pieces; they are shared with other documents and not to be changed."""
        done = [self.of_piece(x) for x in pieces(s, self.opts)]
        if any(x["open"] for x in done[:-1]):
            done = [self.of_piece(s)]
        at = 0
        for x in done:
            yield from x["rows"] if not at else ({**r, **{k: r[k] + at for k in self.places}} for r in x["rows"])
            at += x["n"]


class Landmarks(Pieces):
    """Headings (with their plain text), links, images and code blocks."""

    def __init__(self, opts: Options):
        super().__init__("landmarks", opts, ("seq",))

    def found(self, events: list[dict]) -> list[dict]:
        out, heading = [], None
        for e in events:
            kind = e["kind"]
            if kind == "HeadingStart" or kind in _TARGETS:
                row = {k: e.get(k) for k in ("seq", "kind", "level", "url", "info")} | {"text": "" if kind == "HeadingStart" else None}
                out.append(row)
                heading = row if kind == "HeadingStart" else heading
            elif kind == "HeadingEnd":
                heading = None
            if heading is not None and kind == "Text":
                heading["text"] += decode_entities(self.source[e["start"] : e["end"]].decode())
            elif heading is not None and kind in ("Code", "EscapedChar"):
                heading["text"] += e["text"]
        return out

    def under(self, s: str) -> list[dict]:
        """Links, images and code blocks with the headings above them: seq, kind, url, info, path."""
        out, above, path = [], [], []
        for e in self.rows(s):
            if e["kind"] == "HeadingStart":
                above = [x for x in above if x[0] < e["level"]] + [(e["level"], e["text"])]
                path = [x[1] for x in above]
            else:
                out.append({"seq": e["seq"], "kind": e["kind"], "url": e["url"], "info": e["info"], "path": path})
        return out


class Containers(Pieces):
    """Pairs of containers and the events of some kinds in them."""

    def __init__(self, opts: Options, kinds: Collection[str], around: Collection[str]):
        super().__init__(("containers", tuple(kinds), tuple(around)), opts, ("container", "seq"))
        self.kinds, self.starts, self.ends = frozenset(kinds), {k + "Start": k for k in around}, {k + "End" for k in around}

    def found(self, events: list[dict]) -> list[dict]:
        out, stack = [], []
        for e in events:
            kind = e["kind"]
            if kind in self.starts:
                stack.append((e["seq"], self.starts[kind]))
            elif kind in self.ends:
                stack.pop()
            if kind in self.kinds:
                out += [{"container": at, "container_kind": box, "depth": k, "seq": e["seq"], "kind": kind} for k, (at, box) in enumerate(stack, 1)]
        return out

    def pairs(self, s: str) -> list[dict]:
        return list(self.rows(s))


class Nesting(Containers):
    """Numbers of pairs and of their containers by container kind and depth."""

    def __init__(self, opts: Options, kinds: Collection[str], around: Collection[str]):
        super().__init__(opts, kinds, around)
        self.of_piece = Shapes(self.piece, ("nesting", opts, tuple(kinds), tuple(around)))
        self.places = ()

    def found(self, events: list[dict]) -> list[dict]:
        found: dict[tuple, list] = {}
        for p in super().found(events):
            found.setdefault((p["container_kind"], p["depth"]), []).append(p["container"])
        return [{"container_kind": k, "depth": d, "n_events": len(x), "n_containers": len(set(x))} for (k, d), x in found.items()]

    def counts(self, s: str) -> list[dict]:
        sums: dict[tuple, list[int]] = {}
        for r in self.rows(s):
            n = sums.setdefault((r["container_kind"], r["depth"]), [0, 0])
            n[0] += r["n_events"]
            n[1] += r["n_containers"]
        return [{"container_kind": k, "depth": d, "n_events": n, "n_containers": m} for (k, d), (n, m) in sums.items()]
