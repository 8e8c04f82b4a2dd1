"""Inline content: one string to a flat list of items, opening and closing marks among them.

An item is [kind, start, end, ...]; start and end are places in the string. Kinds: text, escape, code, soft,
hard, html, auto, literal, math, note, inline_note, open, close, link, end_link, image, end_image.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .options import Options
from .text import PUNCTUATION, normalize_label

MOST_MARKS, LONGEST_TICKS, DEEPEST_PARENS = 4096, 32, 32
#: Characters that count as white space and as punctuation beside a run of marks.
SPACE = set(" \t\n\r   　") | {chr(c) for c in range(0x2000, 0x200B)}
PUNCT = set(PUNCTUATION) | {chr(c) for a, b in ((0xA1, 0xBF), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20BF)) for c in range(a, b + 1)} | {"×", "÷"}

_TAG_NAME = r"[A-Za-z][A-Za-z0-9-]*"
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][A-Za-z0-9_.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
OPEN_TAG = rf"<{_TAG_NAME}{_ATTRIBUTE}*\s*/?>"
CLOSE_TAG = rf"</{_TAG_NAME}\s*>"
_HTML = re.compile(rf"{OPEN_TAG}|{CLOSE_TAG}|<!-->|<!--->|<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[[\s\S]*?\]\]>")
_ENDS = (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>"), ("<!", ">"))
_URI = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*)>")
_EMAIL = re.compile(r"<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*)>")
_TICKS = re.compile(r"`+")
_DOLLARS = re.compile(r"\$+")
_NOTE = re.compile(r"\[\^([A-Za-z0-9_-]+)\]")
_LABEL = re.compile(r"\[((?:[^\\\[\]]|\\.){0,999})\]", re.S)
_LITERAL = re.compile(r"(?:https?|ftp)://(?=[A-Za-z0-9])[^\s<\x00-\x1f]*|www\.(?=[A-Za-z0-9])[^\s<\x00-\x1f]*", re.I)
_AT = re.compile(r"(?<=[A-Za-z0-9.+_-])@[A-Za-z0-9.-]+")
_NAME = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.+_-")
_BEFORE_LITERAL = set(" \t\n\r\f*_~(\"';")
_PLAIN = re.compile(r"[^\\`*_~^=$\[\]!<\n]+")


@dataclass
class Run:
    """A run of one mark character; what has been matched of it stands before and after what is left."""

    ch: str
    start: int
    size: int
    opens: bool
    closes: bool
    full: int = 0
    before: list = field(default_factory=list)
    after: list = field(default_factory=list)


def flanking(s: str, a: int, b: int, ch: str) -> tuple[bool, bool]:
    """Whether the run s[a:b] can open and can close."""
    left_char, right_char = (s[a - 1] if a else "\n"), (s[b] if b < len(s) else "\n")
    space_l, space_r, punct_l, punct_r = left_char in SPACE, right_char in SPACE, left_char in PUNCT, right_char in PUNCT
    left = not space_r and (not punct_r or space_l or punct_l)
    right = not space_l and (not punct_l or space_r or punct_r)
    if ch == "_":
        return left and (not right or punct_l), right and (not left or punct_r)
    return left, right


def trim_literal(url: str) -> str:
    """A bare URL without the punctuation, closing brackets and entity behind it."""
    while url:
        if url[-1] in "?!.,:*_~'\"":
            url = url[:-1]
        elif url[-1] == ")" and url.count(")") > url.count("("):
            url = url[:-1]
        elif m := re.search(r"&[A-Za-z0-9]+;$", url):
            url = url[: m.start()]
        else:
            break
    return url


def literals(s: str) -> dict[int, tuple[int, str]]:
    """Bare URLs, www names and e-mail addresses: start to (end, kind).

    An address is found by its @ and from there backwards, so that long words without one cost nothing.
    """
    out, at, none = {}, 0, len(s) + 1
    link, name, sign, stop = (-1, -1), -1, -1, -1
    while True:
        if link[0] < at:
            m = _LITERAL.search(s, at)
            link = m.span() if m else (none, none)
        if sign <= at:
            m = _AT.search(s, at + 1)
            sign, stop = m.span() if m else (none, none)
            name = sign
            while name > at and m and s[name - 1] in _NAME:
                name -= 1
        start = max(name, at)
        a, at = link if link[0] <= start else (start, stop)
        if a >= none:
            return out
        url = whole = s[a:at]
        kind = "email"
        if re.match(r"(?:https?|ftp)://", url, re.I):
            kind = "url"
        elif url[:4].lower() == "www.":
            kind = "www"
        if kind != "email":
            if a and s[a - 1] not in _BEFORE_LITERAL:
                at = a + 1
                continue
            url = trim_literal(url)
            if kind == "www":
                host = re.split(r"[/?#]", url)[0].split(".")
                if len(host) < 3 or any("_" in x for x in host[-2:]) or not host[1]:
                    at = a + 4
                    continue
            elif len(url) <= url.index("://") + 3:
                continue
        else:
            url = url.rstrip(".-")
            name, _, domain = url.partition("@")
            if "." not in domain or domain.startswith(".") or whole[len(url) :][:1] in ("-", "_"):
                continue
        out[a] = (a + len(url), kind)
        at = a + len(url)


def destination(s: str, at: int) -> tuple[str, int] | None:
    """A link destination at s[at:], and where it ends."""
    if s[at : at + 1] == "<":
        m = re.compile(r"<((?:[^<>\\\n]|\\.)*)>").match(s, at)
        return (m[1], m.end()) if m else None
    depth, i = 0, at
    while i < len(s):
        c = s[i]
        if c == "\\" and i + 1 < len(s) and s[i + 1] in PUNCTUATION:
            i += 2
            continue
        if c == "(":
            depth += 1
            if depth > DEEPEST_PARENS:
                return None
        elif c == ")":
            if not depth:
                break
            depth -= 1
        elif c <= " " or c == "\x7f":
            break
        i += 1
    return None if depth else (s[at:i], i)


_TITLE = re.compile(r"\"((?:[^\"\\]|\\[\s\S])*)\"|'((?:[^'\\]|\\[\s\S])*)'|\(((?:[^()\\]|\\[\s\S])*)\)")


def title(s: str, at: int) -> tuple[str, int] | None:
    m = _TITLE.match(s, at)
    return (next(g for g in m.groups() if g is not None), m.end()) if m else None


def _blank(s: str, at: int, chars: str = " \t\n\r") -> int:
    while at < len(s) and s[at] in chars:
        at += 1
    return at


class Inline:
    def __init__(self, s: str, opts: Options, refs: dict, notes: dict | None):
        self.s, self.o, self.refs, self.notes = s, opts, refs, notes
        self.items: list = []
        self.runs: list[Run] = []
        self.brackets: list[dict] = []
        self.literals = literals(s) if opts.autolink_literals and ("@" in s or "www." in s.lower() or "://" in s) else {}
        self.marks = "*_" + ("~" if opts.strikethrough or opts.subscript else "") + ("^" if opts.superscript else "") + ("=" if opts.highlight else "")
        self.n_marks = 0
        self.missing: set[str] = set()
        self.closes: dict[int, int] = {}

    def text(self, a: int, b: int) -> None:
        if a < b:
            if self.items and isinstance(self.items[-1], list) and self.items[-1][0] == "text" and self.items[-1][2] == a:
                self.items[-1][2] = b
            else:
                self.items.append(["text", a, b])

    def parse(self) -> list:
        s, i, n = self.s, 0, len(self.s)
        waiting = sorted(self.literals, reverse=True)
        while i < n:
            while waiting and waiting[-1] < i:
                waiting.pop()
            if waiting and waiting[-1] == i:
                end, kind = self.literals[i]
                self.items.append(["literal", i, end, s[i:end], kind])
                i = end
                continue
            m = _PLAIN.match(s, i)
            if m:
                end = min(m.end(), waiting[-1]) if waiting else m.end()
                self.text(i, end)
                i = end
                continue
            i = self.special(s[i], i)
        self.resolve(0)
        return self.flat()

    def special(self, c: str, i: int) -> int:
        s, n = self.s, len(self.s)
        if c == "\n":
            return self.line_end(i)
        if c == "\\":
            if i + 1 < n and s[i + 1] == "\n":
                self.items.append(["hard", i, i + 2])
                return _blank(s, i + 2, " \t")
            if i + 1 < n and s[i + 1] in PUNCTUATION:
                self.items.append(["escape", i, i + 2, s[i + 1]])
                return i + 2
        elif c == "`":
            return self.code(i)
        elif c == "<":
            for kind, pattern in (("uri", _URI), ("email", _EMAIL)):
                if m := pattern.match(s, i):
                    self.items.append(["auto", i, m.end(), m[1], kind == "email"])
                    return m.end()
            if self.o.allow_html and not self.endless(i) and (m := _HTML.match(s, i)):
                self.items.append(["html", i, m.end(), m[0]])
                return m.end()
        elif c == "$" and self.o.math:
            return self.math(i)
        elif c == "^" and self.o.inline_footnotes and s[i + 1 : i + 2] == "[":
            end = self.balanced(i + 1)
            if end and s[i + 2 : end].strip(" \t\n\r"):
                self.items.append(["inline_note", i, end + 1, s[i + 2 : end], i + 2])
                return end + 1
            if end:
                self.text(i, end + 1)
                return end + 1
        elif c == "!" and s[i + 1 : i + 2] == "[":
            self.brackets.append({"at": len(self.items), "pos": i + 1, "image": True, "live": True, "runs": len(self.runs)})
            self.items.append(["bracket", i, i + 2])
            return i + 2
        elif c == "[":
            m = _NOTE.match(s, i) if self.notes is not None else None
            if m and m[1].lower() in self.notes and not (i and s[i - 1] == "!"):
                self.items.append(["note", i, m.end(), m[1].lower()])
                return m.end()
            self.brackets.append({"at": len(self.items), "pos": i, "image": False, "live": True, "runs": len(self.runs)})
            self.items.append(["bracket", i, i + 1])
            return i + 1
        elif c == "]":
            return self.close(i)
        if c in self.marks:
            end = i
            while end < n and s[end] == c:
                end += 1
            opens, closes = flanking(s, i, end, c)
            if (opens or closes) and self.usable(c, end - i) and self.n_marks < MOST_MARKS:
                self.n_marks += 1
                run = Run(c, i, end - i, opens, closes, end - i)
                self.items.append(run)
                self.runs.append(run)
            else:
                self.text(i, end)
            return end
        self.text(i, i + 1)
        return i + 1

    def endless(self, i: int) -> bool:
        """Whether the markup that opens at i has no end; an end that is missing once is not looked for again."""
        for opening, end in _ENDS:
            if self.s.startswith(opening, i):
                if end not in self.missing and self.s.find(end, i) < 0:
                    self.missing.add(end)
                return end in self.missing
        return False

    def usable(self, c: str, size: int) -> bool:
        if c == "~":
            return size == 2 and self.o.strikethrough or size == 1 and self.o.subscript
        return c in "*_" or c == "^" and size == 1 or c == "=" and size == 2

    def line_end(self, i: int) -> int:
        s = self.s
        last = self.items[-1] if self.items else None
        spaces = 0
        if isinstance(last, list) and last[0] == "text":
            a = last[2]
            while a > last[1] and s[a - 1] == " ":
                a -= 1
            spaces = last[2] - a
            last[2] = a
            if a == last[1]:
                self.items.pop()
        self.items.append(["hard" if spaces >= 2 else "soft", i - spaces, i + 1])
        return _blank(s, i + 1, " \t")

    def code(self, i: int) -> int:
        s = self.s
        m = _TICKS.match(s, i)
        size = m.end() - i
        if size <= LONGEST_TICKS:
            for close in _TICKS.finditer(s, m.end()):
                if close.end() - close.start() == size:
                    body = s[m.end() : close.start()].replace("\n", " ")
                    if len(body) > 1 and body[0] == body[-1] == " " and body.strip(" "):
                        body = body[1:-1]
                    self.items.append(["code", i, close.end(), body])
                    return close.end()
        self.text(i, m.end())
        return m.end()

    def math(self, i: int) -> int:
        s = self.s
        m = _DOLLARS.match(s, i)
        size = m.end() - i
        if size <= 2:
            for close in _DOLLARS.finditer(s, m.end()):
                if close.end() - close.start() == size:
                    body = s[m.end() : close.start()].replace("\n", " ")
                    if len(body) > 1 and body[0] == body[-1] == " " and body.strip(" "):
                        body = body[1:-1]
                    self.items.append(["math", i, close.end(), body, size == 2])
                    return close.end()
        self.text(i, m.end())
        return m.end()

    def balanced(self, i: int) -> int:
        """Where the bracket at i closes, or 0; what one look finds for the brackets after it is kept."""
        s, known, opened = self.s, self.closes, []
        while i < len(s):
            c = s[i]
            if c == "[" and i in known:
                if not opened:
                    return known[i]
                if not known[i]:
                    break
                i = known[i]
            elif c == "\\":
                i += 1
            elif c == "`":
                m = _TICKS.match(s, i)
                other = next((x for x in _TICKS.finditer(s, m.end()) if x.end() - x.start() == m.end() - i), None)
                i = (other or m).end() - 1
            elif c == "[":
                opened.append(i)
            elif c == "]":
                known[opened.pop()] = i
                if not opened:
                    return i
            i += 1
        known.update(dict.fromkeys(opened, 0))
        return 0

    def close(self, i: int) -> int:
        s = self.s
        if not self.brackets:
            self.text(i, i + 1)
            return i + 1
        b = self.brackets[-1]
        if not b["live"]:
            self.brackets.pop()
            self.text(i, i + 1)
            return i + 1
        found = self.target(b, i)
        if not found:
            self.brackets.pop()
            self.text(i, i + 1)
            return i + 1
        dest, name, place, label, end = found
        self.resolve(b["runs"])
        del self.runs[b["runs"] :]
        kind = "image" if b["image"] else "link"
        start = b["pos"] - b["image"]
        self.items[b["at"]] = [kind, start, b["pos"] + 1, dest, name, place, label]
        for k in range(b["at"] + 1, len(self.items)):
            x = self.items[k]
            if isinstance(x, list) and x[0] == "literal":
                self.items[k] = ["text", x[1], x[2]]
        self.items.append([f"end_{kind}", i, end])
        self.brackets.pop()
        if not b["image"]:
            for other in self.brackets:
                if not other["image"]:
                    other["live"] = False
        return end

    def target(self, b: dict, i: int) -> tuple | None:
        """Destination, title, the destination's place, the label of a definition instead, and where the target ends."""
        s = self.s
        if s[i + 1 : i + 2] == "(":
            at = _blank(s, i + 2, " \t")
            if found := destination(s, at):
                place = at + s.startswith("<", at)
                dest, at = found
                after = _blank(s, at)
                name = title(s, after) if after > at or s[at - 1 : at] == ">" else None
                end = _blank(s, name[1] if name else after, " \t\n\r")
                if s[end : end + 1] == ")":
                    return dest, name[0] if name else None, place, None, end + 1
            if s[at : at + 1] == ")":
                return "", None, at, None, at + 1
        if not self.refs:
            return None
        m = _LABEL.match(s, i + 1)
        own = s[b["pos"] + 1 : i]
        label, end = (m[1], m.end()) if m and m[1].strip() else (own, m.end() if m and m[1] == "" else i + 1)
        if m and m[1].strip() == "" and m[1] != "":
            return None
        if label is own and ("[" in re.sub(r"\\.", "", own) or "]" in re.sub(r"\\.", "", own)):
            return None
        key = normalize_label(label) if len(label) <= 999 and label.strip() else None
        return (*self.refs[key], None, key, end) if key in self.refs else None

    def resolve(self, bottom: int) -> None:
        """Matches closing runs with opening runs at or above bottom."""
        runs, k = self.runs, bottom
        floors: dict[tuple, int] = {}
        while k < len(runs):
            closer = runs[k]
            if not closer.closes or not closer.size:
                k += 1
                continue
            single = closer.ch not in "*_"
            key = (closer.ch, closer.opens, closer.full % 3 if not single else closer.full)
            j, opener = k - 1, None
            while j >= max(bottom, floors.get(key, bottom)):
                o = runs[j]
                if o.ch == closer.ch and o.opens and o.size:
                    if single:
                        ok = o.full == closer.full and (closer.ch == "~" and closer.full == 2 or self.s[o.start + o.full : closer.start].strip(" \t\n\r"))
                    else:
                        ok = not ((closer.opens or o.closes) and (o.full + closer.full) % 3 == 0 and not (o.full % 3 == 0 and closer.full % 3 == 0))
                    if ok:
                        opener = o
                        break
                j -= 1
            if opener is None:
                floors[key] = k
                if not closer.opens:
                    del runs[k]
                else:
                    k += 1
                continue
            del runs[j + 1 : k]
            floors = {key: min(v, j + 1) for key, v in floors.items()}
            k = j + 1
            size = opener.size if single else 2 if opener.size >= 2 and closer.size >= 2 else 1
            tag = {"~": "del" if closer.full == 2 else "sub", "^": "sup", "=": "mark"}.get(closer.ch) or ("strong" if size == 2 else "em")
            opener.size -= size
            left = opener.start + opener.size
            opener.after.insert(0, ["open", left, left + size, tag])
            right = closer.start + closer.full - closer.size
            closer.before.append(["close", right, right + size, tag])
            closer.size -= size
            if not opener.size:
                del runs[j]
                k -= 1
            if not closer.size:
                del runs[k]

    def flat(self) -> list:
        out: list = []
        for x in self.items:
            if isinstance(x, Run):
                out += x.before
                if x.size:
                    left = x.start + sum(y[2] - y[1] for y in x.before)
                    out.append(["text", left, left + x.size])
                out += x.after
            elif x[0] == "bracket":
                out.append(["text", x[1], x[2]])
            elif x[1] < x[2] or x[0] != "text":
                out.append(x)
        return out


_SPECIAL = re.compile(r"[\\`*_~^=$\[\]!<\n@]|www\.|://", re.I)


def parse_inline(s: str, opts: Options, refs: dict | None = None, notes: dict | None = None) -> list:
    if not _SPECIAL.search(s):
        return [["text", 0, len(s)]] if s else []
    return Inline(s, opts, refs or {}, notes).parse()
