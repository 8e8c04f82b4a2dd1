"""MDX: a text into segments of Markdown, JSX tags, expressions and ESM; checks, rendering and components."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from .options import MDX, Options
from .render import compile_document

#: What each diagnostic says.
MESSAGES = {
    "UnterminatedExpression": "expected `}` to close this flow expression",
    "UnterminatedJsxTag": "expected `>` to close this JSX tag",
    "InvalidJsxTag": "invalid JSX tag structure",
    "UnexpectedJsxClosingTag": "closing JSX tag has no matching opening tag",
    "MismatchedJsxClosingTag": "closing JSX tag does not match the innermost opening tag",
    "UnclosedJsxTag": "expected a matching closing JSX tag",
    "InvalidEsmPosition": "ESM blocks must begin at column 1 after a blank Markdown line",
}
#: Words that cannot name a component.
RESERVED = frozenset(
    "await break case catch class const continue debugger default delete do else enum export extends false finally for function if implements "
    "import in instanceof interface let new null package private protected public return static super switch this throw true try typeof var void "
    "while with yield arguments eval".split()
)
_ESM = re.compile(r"import(?=[ \t{\"'])(?![ \t]*[(.])|export(?=[ \t{])")
_ESM_BREAK = re.compile(r"import |export |<|\{|#")
_NAME = r"[A-Za-z][\w-]*(?:[.:][A-Za-z][\w-]*)*"
_TAG_START = re.compile(rf"<(/?)(?:({_NAME})|(?=>))", re.A)
_ATTRIBUTE = re.compile(r"[A-Za-z_$:@][\w$:.@-]*", re.A)
_BARE = re.compile(r"[^\s\"'{}<>=/]+")
_SPACES = re.compile(r"[ \t\r\n]*")
_TO_LINE_END = re.compile(r"[ \t]*(?:\r?\n|\r|\Z)")


def quoted(s: str, i: int, escapes: bool = True) -> int | None:
    """Where the string that starts at i ends."""
    q = s[i]
    i += 1
    while i < len(s):
        if s[i] == "\\" and escapes:
            i += 2
        elif s[i] == q:
            return i + 1
        else:
            i += 1
    return None


@lru_cache(maxsize=2)
def _ends(s: str) -> dict[int, int | None]:
    """Where the braces of a text close, as far as they have been looked for; None for those that do not."""
    return {}


def expression_end(s: str, i: int) -> int | None:
    """Where the braces that open at i close; strings, templates and comments are passed over.

    What one look finds for the braces after it is kept, so that openings without an end are passed over once.
    """
    known, opened = _ends(s), []
    while i is not None and i < len(s):
        c = s[i]
        if c in "\"'":
            i = quoted(s, i)
        elif c == "`":
            i = template_end(s, i)
        elif s.startswith("//", i):
            i = s.find("\n", i) + 1 or None
        elif s.startswith("/*", i):
            end = s.find("*/", i + 2)
            i = None if end < 0 else end + 2
        elif c == "{" and i in known:
            i = known[i]
            if not opened:
                return i
        else:
            if c == "{":
                opened.append(i)
            elif c == "}" and opened:
                known[opened.pop()] = i + 1
            i += 1
            if not opened:
                return i
    known.update(dict.fromkeys(opened))
    return None


def template_end(s: str, i: int) -> int | None:
    i += 1
    while i < len(s):
        if s[i] == "\\":
            i += 2
        elif s[i] == "`":
            return i + 1
        elif s.startswith("${", i):
            end = expression_end(s, i + 1)
            if end is None:
                return None
            i = end
        else:
            i += 1
    return None


@dataclass
class Tag:
    name: str
    end: int
    closing: bool = False
    empty: bool = False  # closes itself
    bad_value: bool = False  # an attribute has = and no value


def tag_at(s: str, i: int) -> Tag | None:
    m = _TAG_START.match(s, i)
    if not m:
        return None
    name, closing = m[2] or "", bool(m[1])
    i, bad = m.end(), False
    if not name:
        return Tag("", i + 1, closing)
    while True:
        i = _SPACES.match(s, i).end()
        if s.startswith(">", i):
            return Tag(name, i + 1, closing, False, bad)
        if closing or i >= len(s):
            return None
        if s.startswith("/", i):
            after = _SPACES.match(s, i + 1).end()
            return Tag(name, after + 1, False, True, bad) if s.startswith(">", after) else None
        if s[i] == "{":
            end = expression_end(s, i)
            if end is None:
                return None
            i = end
            continue
        m = _ATTRIBUTE.match(s, i)
        if not m:
            return None
        i = m.end()
        after = _SPACES.match(s, i).end()
        if not s.startswith("=", after):
            continue
        i = _SPACES.match(s, after + 1).end()
        if i >= len(s):
            return None
        if s[i] in "\"'":
            end = quoted(s, i, False)
        elif s[i] == "{":
            end = expression_end(s, i)
        elif s[i] in ">/":
            bad, end = True, i
        else:
            m = _BARE.match(s, i)
            end = m.end() if m else None
        if end is None:
            return None
        i = end


def line_end(s: str, i: int) -> int:
    end = s.find("\n", i)
    return len(s) if end < 0 else end + 1


def esm_end(s: str, i: int) -> int:
    """ESM goes on to a blank line, a semicolon at a line's end or a line that starts something else."""
    begin, i = i, line_end(s, i)
    while i < len(s) and s[i : line_end(s, i)].strip(" \t") not in ("", "\n") and not _ESM_BREAK.match(s, i):
        if s[begin:i].rstrip("\n").rstrip("\r").rstrip(" \t").endswith(";"):
            break
        i = line_end(s, i)
    return i


@dataclass
class Segment:
    kind: str
    text: str
    start: int
    end: int


def _flow(s: str, line: int, first: int) -> tuple[str, int, Tag | None] | None:
    """A tag or an expression that has its lines to itself: kind, end, tag."""
    if s[first] == "{":
        end, kind, tag = expression_end(s, first), "Expression", None
    elif s[first] == "<" and (tag := tag_at(s, first)):
        end = tag.end
        kind = "JsxBlockClose" if tag.closing else "JsxBlockSelfClose" if tag.empty else "JsxBlockOpen"
    else:
        return None
    if end is None:
        return None
    m = _TO_LINE_END.match(s, end)
    return (kind, m.end(), tag) if m else None


def segments(s: str) -> list[Segment]:
    """All of the text, in order, without gaps."""
    out: list[Segment] = []
    begin, i, paragraph = None, 0, False

    def flush(to: int) -> None:
        nonlocal begin
        if begin is not None and begin < to:
            out.append(Segment("Markdown", s[begin:to], begin, to))
        begin = None

    while i < len(s):
        first = i + len(s[i : line_end(s, i)]) - len(s[i : line_end(s, i)].lstrip(" \t"))
        found = None
        if first < len(s) and s[first] not in "\r\n":
            if first == i and not paragraph and _ESM.match(s, i):
                found = ("Esm", esm_end(s, i), None)
            else:
                found = _flow(s, i, first)
            paragraph = found is None
        else:
            paragraph = False
        if found:
            flush(i)
            out.append(Segment(found[0], s[i : found[1]], i, found[1]))
            i = found[1]
        else:
            begin = i if begin is None else begin
            i = line_end(s, i)
    flush(len(s))
    return out


@dataclass
class Diagnostic:
    code: str
    start: int
    end: int
    rel_start: int | None = None
    rel_end: int | None = None

    @property
    def message(self) -> str:
        return MESSAGES[self.code]


def _unfinished(s: str, i: int) -> tuple[str, int]:
    """What is wrong with a tag at i that cannot be read: the kind of thing and its place or end."""
    k = i + 1
    while k < len(s):
        if s[k] == ">":
            return "InvalidJsxTag", k + 1
        if s[k] in "\"'":
            end = quoted(s, k)
        elif s[k] == "{":
            end = expression_end(s, k)
            if end is None:
                return "UnterminatedExpression", k
        else:
            end = k + 1
        if end is None:
            break
        k = end
    return "UnterminatedJsxTag", i


def diagnostics(s: str) -> list[Diagnostic]:
    """What strict reading objects to; it stops at the first construct that has no end."""
    out: list[Diagnostic] = []
    stack: list[tuple[str, int, int]] = []
    i, paragraph = 0, False
    while i < len(s):
        end = line_end(s, i)
        first = i + len(s[i:end]) - len(s[i:end].lstrip(" \t"))
        if first >= len(s) or s[first] in "\r\n":
            paragraph, i = False, end
            continue
        if first == i and not paragraph and _ESM.match(s, i):
            i = esm_end(s, i)
            continue
        if _ESM.match(s, first):
            out.append(Diagnostic("InvalidEsmPosition", first, first + 6))
            paragraph, i = True, end
            continue
        if s[first] == "{" and expression_end(s, first) is None:
            out.append(Diagnostic("UnterminatedExpression", first, len(s)))
            break
        if s[first] == "<" and re.match(r"[/>A-Za-z]", s[first + 1 : first + 2]) and tag_at(s, first) is None:
            code, at = _unfinished(s, first)
            if code == "InvalidJsxTag":
                out.append(Diagnostic(code, first, at))
                paragraph, i = False, _after(s, at)
                continue
            out.append(Diagnostic(code, at, len(s)))
            break
        found = _flow(s, i, first)
        if not found:
            paragraph, i = True, end
            continue
        kind, stop, tag = found
        if tag is not None:
            if tag.bad_value:
                out.append(Diagnostic("InvalidJsxTag", first, tag.end))
            elif kind == "JsxBlockClose":
                _close(out, stack, tag.name, first, tag.end)
            elif kind == "JsxBlockOpen":
                stack.append((tag.name, first, tag.end))
        paragraph, i = False, stop
    return out + [Diagnostic("UnclosedJsxTag", a, b) for _, a, b in stack]


def _after(s: str, i: int) -> int:
    return re.compile(r"[ \t]*\r?\n?").match(s, i).end()


def _close(out: list[Diagnostic], stack: list[tuple[str, int, int]], name: str, start: int, end: int) -> None:
    if not stack:
        out.append(Diagnostic("UnexpectedJsxClosingTag", start, end))
    elif stack[-1][0] == name:
        stack.pop()
    else:
        out.append(Diagnostic("MismatchedJsxClosingTag", start, end, *stack[-1][1:]))
        names = [x[0] for x in stack]
        if name in names:
            del stack[len(names) - 1 - names[::-1].index(name) :]


@dataclass
class MdxOutput:
    body: str
    esm: list[str] = field(default_factory=list)
    front_matter: str | None = None

    def to_component(self, name: str) -> str:
        """A module that exports the body as a component."""
        check_name(name)
        head = "".join(e.rstrip() + "\n" for e in self.esm) + ("\n" if self.esm else "")
        body = self.body.strip()
        lines = "".join(("      " + x if x else "") + "\n" for x in body.split("\n")) if body else ""
        return f"{head}export function {name}() {{\n  return (\n    <>\n{lines}    </>\n  );\n}}\n"


def check_name(name: str) -> None:
    """Raises ValueError unless name can name a component."""
    plain = "".join("_" if c in "$‌‍" else c for c in name)
    if not name or name[0] in "‌‍" or not plain.isidentifier() or name in RESERVED:
        raise ValueError(f"{name!r} cannot name a component")


def render_mdx(s: str | None, opts: Options = MDX) -> MdxOutput:
    """Each Markdown segment by itself to HTML; tags and expressions as they stand; ESM aside."""
    out = MdxOutput("")
    body = []
    for x in segments(s or ""):
        if x.kind == "Esm":
            out.esm.append(x.text)
        elif x.kind == "Markdown":
            r = compile_document(x.text, opts)
            body.append(r.html)
            out.front_matter = r.front_matter if out.front_matter is None else out.front_matter
        else:
            body.append(x.text.strip() + "\n")
    out.body = "".join(body)
    return out


def byte_offsets(s: str, at: list[int]) -> list[int]:
    """Places in the text as places in its UTF-8; at is ascending."""
    if s.isascii():
        return list(at)
    out, last, total = [], 0, 0
    for a in at:
        total += len(s[last:a].encode())
        out.append(total)
        last = a
    return out
