"""The compiler's regular functions as built-in column expressions, so that they stay in generated code."""

from __future__ import annotations

import json
from collections import defaultdict
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernel.text import DISALLOWED_TAGS, LONGEST_SCHEME, SAFE_SCHEMES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FRONT = r"(?s)\A(-{3}|\+{3})[ \t]*\r?\n((?:.*?\n)??)\1[ \t]*(?:\r?\n|\z)"


def escape_text(c: Column | str) -> Column:
    """& < > " as entities."""
    c = F.col(c) if isinstance(c, str) else c
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def escape_attr(c: Column | str) -> Column:
    return F.replace(escape_text(c), F.lit("'"), F.lit("&#39;"))


def needs_text_escape(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike('[<>&"]')


def needs_attr_escape(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike("[<>&\"']")


def slug(c: Column | str) -> Column:
    """A heading's id from its source, before repeats are told apart."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.regexp_replace(c, r"[*~\x60\[\]!#]", "")
    s = F.translate(s, UPPER, LOWER)
    s = F.regexp_replace(s, r"[ \t\n\r]+", "-")
    s = F.regexp_replace(s, r"[\x00-\x7F&&[^a-z0-9_\-]]", "")
    return F.coalesce(F.nullif(F.trim(s, F.lit("-")), F.lit("")), F.when(c.isNotNull(), F.lit("heading")))


def heading_ids(df: DataFrame, doc: str = "doc_id", seq: str = "seq", base: str = "slug", out: str = "id") -> DataFrame:
    """Tells a document's equal slugs apart: the n-th repeat gets -n. A window over each document and slug."""
    n = F.row_number().over(Window.partitionBy(doc, base).orderBy(seq)) - 1
    return df.withColumn(out, F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), n)))


def front_matter(c: Column | str) -> Column:
    """The content of a leading --- or +++ block, or null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(_FRONT), F.regexp_extract(c, _FRONT, 2))


def without_front_matter(c: Column | str) -> Column:
    return F.regexp_replace(c, _FRONT, "")


def is_safe_url(c: Column | str) -> Column:
    """Whether the untrusted policy lets an entity-decoded URL through."""
    plain = F.regexp_replace(c, r"[\x00-\x20\x7f]", "")
    scheme = F.regexp_extract(plain, r"^([\x21-\x7e&&[^:/?#]]*):", 1)
    known = F.lower(scheme).isin(*SAFE_SCHEMES)
    return (
        F.when(~plain.rlike(r"^[\x21-\x7e&&[^:/?#]]*:"), True)
        .when(F.length(scheme) > LONGEST_SCHEME, False)
        .when(~scheme.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*$"), True)
        .otherwise(known)
    )


def with_base(c: Column | str, base: str) -> Column:
    """Prefixes path links with a base path, unless they have it."""
    c = F.col(c) if isinstance(c, str) else c
    base = base.rstrip("/")
    if not base:
        return c
    has = (c == base) | c.startswith(base + "/") | c.startswith(base + "?") | c.startswith(base + "#")
    return F.when(c.startswith("/") & ~c.startswith("//") & ~has, F.concat(F.lit(base), c)).otherwise(c)


def filter_html(c: Column | str) -> Column:
    """Escapes the opening bracket of tags that raw HTML may not have."""
    return F.regexp_replace(c, rf"(?i)<(?=/?(?:{'|'.join(DISALLOWED_TAGS)})(?:[ \t\n\r>/]|\z))", "&lt;")


def unescape_backslashes(c: Column | str) -> Column:
    return F.regexp_replace(c, r"\\([!-/:-@\[-`{-~])", "$1")


def footnote_label(c: Column | str) -> Column:
    """A note's key, or null where it cannot be one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"\A[A-Za-z0-9_\-]+\z"), F.translate(c, UPPER, LOWER))


def is_thematic_break(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"\A {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}\z")


def is_blank_line(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).rlike(r"\A[ \t]*\z")


def strip_tags(c: Column | str) -> Column:
    """A heading's text from its HTML, entities left as they are."""
    return F.regexp_replace(c, r"<(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", "")


def info_language(c: Column | str) -> Column:
    return F.regexp_extract(c, r"^([^ \t\n\r\f]*)", 1)


def info_meta(c: Column | str) -> Column:
    return F.regexp_extract(c, r"^[^ \t\n\r\f]*[ \t\n\r\f]*((?s).*?)[ \t\n\r\f]*\z", 1)


def basis_points(df: DataFrame, by: list[str], order: str, dashes: str = "dashes", out: str = "basis_points") -> DataFrame:
    """Column widths that add up to 10000 from a table's delimiter dashes."""
    w = Window.partitionBy(*by)
    run = F.sum(dashes).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(dashes).over(w)
    k = F.floor((run * 10000 + F.floor(total / 2)) / total)
    return df.withColumn("_k", k).withColumn(out, F.col("_k") - F.coalesce(F.lag("_k").over(w.orderBy(order)), F.lit(0))).drop("_k")


def note_ordinals(df: DataFrame, doc: str = "doc_id", key: str = "label", seq: str = "seq", out: str = "ordinal") -> DataFrame:
    """Numbers of notes by their first reference."""
    first = df.withColumn("_first", F.min(seq).over(Window.partitionBy(doc, key)))
    return first.withColumn(out, F.dense_rank().over(Window.partitionBy(doc).orderBy("_first"))).drop("_first")


def source_line(text: Column | str, at: Column) -> Column:
    """1-based line of a byte offset."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), at.cast("int")), "UTF-8")
    return F.size(F.split(before, "\n"))


def source_column(text: Column | str, at: Column) -> Column:
    """1-based column, in code points, of a byte offset."""
    before = F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), at.cast("int")), "UTF-8")
    return F.length(F.substring_index(before, "\n", -1)) + 1


_ENTITY = r"&(?:#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{0,47});"
#: Placeholder of a byte order mark, which Java's decoder would take as a mark.
_MARK = 0xFEFF


def _pieces(c: Column, pattern: str, each) -> Column:
    """c cut into what the pattern matches, one after another, and put together from what each makes of them."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), each), "")


def _named() -> Column:
    """Entities' characters by their first two letters and then by name: a map is searched from its start."""
    by: dict[str, dict[str, str]] = defaultdict(dict)
    for name, value in html5.items():
        if name.endswith(";"):
            by[name[:2]][name] = value
    return F.from_json(F.lit(json.dumps(by)), "map<string,map<string,string>>")


def decode_entities(c: Column | str) -> Column:
    """Named and numeric entities as characters; what is none stays as it is."""
    c = F.col(c) if isinstance(c, str) else c

    def one(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#[xX]?([0-9a-fA-F]+);$", 1)
        code = F.when(x.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        bad = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
        number = F.when(bad, F.lit("\ufffd")).when(code == _MARK, F.lit("\ufeff")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        name = F.substring(x, 2, 49)
        known = F.element_at(F.element_at(_named(), F.substring(name, 1, 2)), name)
        return F.when(~x.startswith("&") | (F.length(x) < 3), x).when(x.startswith("&#"), number).otherwise(F.coalesce(known, x))

    return F.when(F.contains(c, F.lit("&")), _pieces(c, rf"(?s){_ENTITY}|[^&]+|&", one)).otherwise(c)


def _percent(x: Column) -> Column:
    return F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1")


def encode_destination(c: Column | str) -> Column:
    """A link's destination as an attribute value."""
    special = r"\x00-\x08\x0b\x0c\x0e-\x20\"\\&<>'\x7f"

    def one(x: Column) -> Column:
        escaped = F.substring(x, 2, 1)
        both = F.when(F.length(x) > 1, F.when(escaped == '"', "%22").when(escaped == "\\", "%5C").otherwise(escape_attr(escaped)))
        return F.when(x.rlike(r"^\\[!-/:-@\[-`{-~]$"), both).when(x.rlike("^[&<>']$"), escape_attr(x)).when(x.rlike(rf"^[{special}\x{{80}}-\x{{10FFFF}}]"), _percent(x)).otherwise(x)

    return _pieces(decode_entities(c), rf"\\[!-/:-@\[-`{{-~]|[{special}]|[\x{{80}}-\x{{10FFFF}}]+|[^{special}\x{{80}}-\x{{10FFFF}}]+", one)


def encode_autolink(c: Column | str) -> Column:
    """An autolink's destination as an attribute value."""
    c = F.col(c) if isinstance(c, str) else c
    special = r"\x00-\x08\x0b\x0c\x0e-\x20\\&<>'\"\[\]`"
    one = lambda x: F.when(x.rlike("^[&<>'\"]$"), escape_attr(x)).when(x.rlike(rf"^[{special}\x{{80}}-\x{{10FFFF}}]"), _percent(x)).otherwise(x)
    return _pieces(c, rf"[{special}]|[\x{{80}}-\x{{10FFFF}}]+|[^{special}\x{{80}}-\x{{10FFFF}}]+", one)


def label_key(c: Column | str) -> Column:
    """The key of a link reference's label: entities and escaped brackets resolved, white space collapsed, case folded."""
    s = F.regexp_replace(decode_entities(c), r"\\([\[\]\\])", "$1")
    s = F.trim(F.regexp_replace(s, r"[ \t\r\n\f\x0b]+", " "))
    return F.lower(F.replace(F.replace(s, F.lit("\u1e9e"), F.lit("ss")), F.lit("\u00df"), F.lit("ss")))
