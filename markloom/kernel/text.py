"""Escaping, URLs, entities, slugs and other functions of plain strings."""

from __future__ import annotations

import re
from html.entities import html5

import numpy as np

#: The schemes a link may have under the untrusted policy.
SAFE_SCHEMES = ("ftp", "geo", "http", "https", "irc", "ircs", "mailto", "matrix", "sms", "tel", "xmpp")
#: The tags whose opening bracket is escaped by the disallowed-HTML filter.
DISALLOWED_TAGS = ("title", "textarea", "style", "xmp", "iframe", "noembed", "noframes", "script", "plaintext")
LONGEST_SCHEME = 16
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_ENTITY = re.compile(r"&(?:#[xX]([0-9a-fA-F]{1,6})|#([0-9]{1,7})|([A-Za-z][A-Za-z0-9]{0,47}));")
_UNESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")
_DISALLOWED = re.compile(rf"<(?=/?(?:{'|'.join(DISALLOWED_TAGS)})(?:[ \t\n\r>/]|\Z))", re.I)
_FRONT = re.compile(r"\A(-{3}|\+{3})[ \t]*\r?\n((?:.*?\n)??)\1[ \t]*(?:\r?\n|\Z)", re.S)


def escape_text(s: str) -> str:
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def escape_attr(s: str) -> str:
    return escape_text(s).replace("'", "&#39;")


def _decoded(m: re.Match) -> str:
    if m[3]:
        return html5.get(m[3] + ";", m[0])
    code = int(m[1], 16) if m[1] else int(m[2])
    return "\ufffd" if code == 0 or code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)


def decode_entities(s: str) -> str:
    return _ENTITY.sub(_decoded, s) if "&" in s else s


def unescape_backslashes(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s) if "\\" in s else s


def unescape(s: str) -> str:
    """Backslash escapes and entities, each resolved once."""
    if "\\" not in s:
        return decode_entities(s)
    return re.sub(rf"{_UNESCAPE.pattern}|{_ENTITY.pattern}", lambda m: m[1] if m[1] else decode_entities(m[0]), s)


def _percent(c: str) -> str:
    return "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))


_DESTINATION = re.compile(r"\\[!-/:-@\[-`{-~]|[\x00-\x08\x0b\x0c\x0e-\x20\"\\&<>'\x7f]|[^\x00-\x7f]")
_HTML = {"&": "&amp;", "<": "&lt;", ">": "&gt;", "'": "&#39;"}


def encode_destination(url: str) -> str:
    """A link's destination as an attribute value."""

    def one(m: re.Match) -> str:
        c = m[0]
        if len(c) == 2:
            c = c[1]
            return "%22" if c == '"' else "%5C" if c == "\\" else _HTML.get(c, c)
        return _HTML.get(c) or _percent(c)

    return _DESTINATION.sub(one, decode_entities(url))


_AUTOLINK = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x20\\&<>'\"\[\]`]|[^\x00-\x7f]")


def encode_autolink(url: str) -> str:
    return _AUTOLINK.sub(lambda m: {**_HTML, '"': "&quot;"}.get(m[0]) or _percent(m[0]), url)


def is_safe_url(url: str) -> bool:
    """Whether the untrusted policy lets the URL through: relative, or of a known scheme."""
    plain = re.sub(r"[\x00-\x20\x7f]", "", decode_entities(url))
    m = re.match(r"([\x21-\x7e]*?)([:/?#]|[^\x00-\x7f])", plain)
    if not m or m[2] != ":":
        return True
    if len(m[1]) > LONGEST_SCHEME:
        return False
    return not re.fullmatch(r"[A-Za-z][A-Za-z0-9+.-]*", m[1]) or m[1].lower() in SAFE_SCHEMES


def with_base(url: str, base: str | None) -> str:
    """Prefixes a path link with the base path unless it has it already."""
    base = (base or "").rstrip("/")
    if not base or not url.startswith("/") or url.startswith("//"):
        return url
    rest = url[len(base) :]
    return url if url.startswith(base) and (not rest or rest[0] in "/?#") else base + url


def filter_html(s: str) -> str:
    return _DISALLOWED.sub("&lt;", s)


def slug(raw: str) -> str:
    """A heading's id from its source, before repeats are told apart."""
    s = re.sub(r"[*~`\[\]!#]", "", raw)
    s = re.sub(r"[A-Z]", lambda m: m[0].lower(), s)
    s = re.sub(r"[ \t\n\r]+", "-", s)
    return re.sub(r"[\x00-,./:-@\[-^`{-\x7f]", "", s).strip("-") or "heading"


def plain_heading(html: str) -> str:
    """A heading's text from its HTML: tags out, entities resolved."""
    bare = re.sub(r"<(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", "", html)
    return decode_entities(bare)


def normalize_label(label: str) -> str:
    """The key of a link reference."""
    s = decode_entities(label)
    s = re.sub(r"\\([\[\]\\])", r"\1", s)
    return re.sub(r"[ \t\r\n\f\v]+", " ", s).strip(" ").replace("ẞ", "ss").replace("ß", "ss").lower()


def front_matter(s: str) -> tuple[str | None, str]:
    """The content of a leading --- or +++ block, if there is one, and the rest."""
    m = _FRONT.match(s)
    return (m[2], s[m.end() :]) if m else (None, s)


def line_and_column(s: str, at: int) -> tuple[int, int]:
    """1-based line and column (in code points) of a byte offset in the text's UTF-8."""
    before = s.encode()[:at].decode("utf-8", "ignore")
    return before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1


def places(s: str, at: list[int]) -> list[tuple[int, int]]:
    """Lines and columns of many byte offsets: the starts of lines and of characters are found once."""
    raw = np.frombuffer(s.encode(), np.uint8)
    feeds = np.flatnonzero(raw == 10)
    where = np.clip(np.asarray(at, np.int64), 0, len(raw))
    line = np.searchsorted(feeds, where, "left")
    first = np.concatenate([[0], feeds + 1])[line]
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return list(zip((line + 1).tolist(), (before[where] - before[first] + 1).tolist()))


def column_widths(dashes: list[int]) -> list[int]:
    """Widths in hundredths of a per cent from the delimiter's dashes; they add up to 10000."""
    total, out, run, last = sum(dashes), [], 0, 0
    for n in dashes:
        run += n
        now = (run * 10000 + total // 2) // total
        out.append(now - last)
        last = now
    return out
