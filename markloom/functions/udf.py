"""Arrow-batched functions around the compiler, one document a row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernel import events, mdx, render, text, within
from ..kernel.options import MDX, Options, options
from ..kernel.shapes import Once, Shapes

HEADINGS = "array<struct<level:int,id:string,text:string>>"


#: Characters of text whose results are held at once, as an Arrow batch may hold any number of long documents.
PIECE = 1_000_000


def _pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for c in batches:
        first, held = 0, 0
        for k, x in enumerate(c):
            held += 0 if x is None else len(x)
            if held > PIECE:
                yield c.iloc[first : k + 1]
                first, held = k + 1, 0
        if first < len(c) or not len(c):
            yield c.iloc[first:]


def _each(f: Callable, kind: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for c in _pieces(batches):
            yield pd.Series([None if x is None else f(x) for x in c], dtype=object)

    return F.pandas_udf(run, kind)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
#: Columns of events that are places in the text.
PLACES = frozenset({"start", "end", "url_start", "url_end"})


def _rows(f: Callable, fields: dict[str, str]):
    """An array of structs from f's lists of dicts, made column by column; a key that a dict has not is null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in batches:
            for c in _pieces(iter([whole.to_pandas()])):
                texts: dict = {}  # equal texts have equal rows
                at = [texts.setdefault(x, len(texts)) for x in c]
                found = [None if x is None else f(x) for x in texts]
                rows = [e for x in found if x for e in x]
                ends = np.cumsum([0] + [len(x or ()) for x in found])
                columns = [pa.array([e.get(k) for e in rows], _ARROW[t]) for k, t in fields.items()]
                items = pa.StructArray.from_arrays(columns, fields=[pa.field(k, _ARROW[t]) for k, t in fields.items()])
                out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([x is None for x in found], pa.bool_()))
                yield out if len(texts) == len(at) else out.take(pa.array(at, pa.int32()))

    return F.arrow_udf(run, f"array<struct<{','.join(f'`{k}`:{v}' for k, v in fields.items())}>>")


def _parts(f: Callable, names: tuple[str, ...], kind: str):
    """A struct of attributes of f's results."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for c in _pieces(batches):
            rows = [f(x) for x in c]
            yield pd.DataFrame({n: [getattr(r, n) for r in rows] for n in names})

    return F.pandas_udf(run, kind)


def md_to_html(c: Column | str, given: Options | str | dict | None = None, renderer: render.Renderer | None = None) -> Column:
    """HTML of a document; null for null. renderer(language, meta, code) may take fenced code over."""
    opts = options(given)
    bare = opts.with_(front_matter=False)
    f = lambda s: render.to_html(text.front_matter(s)[1] if opts.front_matter else s, bare, renderer)
    # a renderer may look at numbers, and a base path with one may meet them
    alike = renderer is None and not any(x.isdigit() for x in opts.link_base_path or "")
    return _each(Shapes(f, ("html", opts)) if alike else f, "string")(c)


def md_parse(c: Column | str, given: Options | str | dict | None = None, renderer: render.Renderer | None = None) -> Column:
    """Struct of html, front_matter and headings."""
    opts = options(given) if given is not None else options(None, front_matter=True)

    f = lambda s: render.compile_document(s, opts, renderer)
    return _parts(f, ("html", "front_matter", "headings"), f"html string, front_matter string, headings {HEADINGS}")(c)


def md_events(c: Column | str, given: Options | str | dict | None = None, inline: bool = True, kinds: Collection[str] | None = None, fields: Collection[str] | None = None) -> Column:
    """Events of a document's blocks and their content, places in bytes of UTF-8; of some kinds, with some fields only, where named."""
    opts = options(given)
    wanted = {k: v for k, v in events.FIELDS.items() if fields is None or k in fields}
    keep = None if kinds is None else frozenset(kinds)

    def of(s: str) -> list[dict]:
        found = events.block_events(s, opts, inline)
        return [{k: e[k] for k in wanted if k in e} for e in found if keep is None or e["kind"] in keep]

    name = ("events", opts, inline, keep, tuple(wanted))
    return _rows(Once(of, name) if PLACES & set(wanted) else Shapes(of, name), wanted)(c)


LANDMARKS = {"seq": "int", "kind": "string", "level": "int", "text": "string", "url": "string", "info": "string"}


def md_landmarks(c: Column | str, given: Options | str | dict | None = None) -> Column:
    """Headings with their plain text, and links, images and code blocks, in a document's order."""
    opts = options(given)
    kinds = {"LinkStart", "LinkStartRef", "ImageStart", "ImageStartRef", "Autolink", "AutolinkLiteral", "CodeBlockStart"}

    def of(s: str) -> list[dict]:
        out, heading, raw = [], None, s.replace("\0", "\ufffd").encode()
        for e in events.block_events(s, opts, True):
            kind = e["kind"]
            if kind == "HeadingStart":
                heading = e | {"text": ""}
                out.append(heading)
            elif kind == "HeadingEnd":
                heading = None
            elif kind in kinds:
                out.append(e | {"text": None})
            if heading is not None and kind == "Text":
                heading["text"] += text.decode_entities(raw[e["start"] : e["end"]].decode())
            elif heading is not None and kind in ("Code", "EscapedChar"):
                heading["text"] += e["text"]
        return out

    return _rows(of, LANDMARKS)(c)


def md_sections(c: Column | str, given: Options | str | dict | None = None) -> Column:
    """Links, images and code blocks with the texts of the headings above them, outermost first."""
    return _rows(within.Landmarks(options(given)).under, {"seq": "int", "kind": "string", "url": "string", "info": "string", "path": "array<string>"})(c)


def md_containers(c: Column | str, kinds: Collection[str], around: Collection[str], given: Options | str | dict | None = None) -> Column:
    """Pairs of containers (the seq and kind of each) and the events of some kinds in them, numbered from the outermost."""
    fields = {"container": "long", "container_kind": "string", "depth": "int", "seq": "int", "kind": "string"}
    return _rows(within.Containers(options(given), kinds, around).pairs, fields)(c)


def md_nesting(c: Column | str, kinds: Collection[str], around: Collection[str], given: Options | str | dict | None = None) -> Column:
    """How many events of some kinds stand in containers of each kind and depth, and in how many of them."""
    fields = {"container_kind": "string", "depth": "int", "n_events": "long", "n_containers": "long"}
    return _rows(within.Nesting(options(given), kinds, around).counts, fields)(c)


def md_event_counts(c: Column | str, given: Options | str | dict | None = None, inline: bool = True) -> Column:
    """How many events of each kind a document has; counted where they are made."""
    opts = options(given)
    return _each(lambda s: dict(Counter(e["kind"] for e in events.block_events(s, opts, inline))), "map<string,int>")(c)


def md_inline_events(c: Column | str, given: Options | str | dict | None = None) -> Column:
    opts = options(given) if given is not None else options(None, autolink_literals=True)
    return _rows(Once(lambda s: [e | {"seq": k} for k, e in enumerate(events.inline_events(s, opts))], ("inline", opts)), events.FIELDS)(c)


def md_link_references(c: Column | str, given: Options | str | dict | None = None) -> Column:
    opts = options(given)
    return _rows(Shapes(lambda s: events.link_references(s, opts), ("references", opts)), {"label": "string", "url": "string", "title": "string"})(c)


def md_note_definitions(c: Column | str, given: Options | str | dict | None = None) -> Column:
    opts = options(given)
    return _each(Shapes(lambda s: events.note_definitions(s, opts), ("notes", opts), ("start",)), "array<struct<label:string,start:long>>")(c)


def mdx_segments(c: Column | str) -> Column:
    def of(s: str) -> list[dict]:
        found = mdx.segments(s)
        ends = mdx.byte_offsets(s, [x.end for x in found])
        return [{"kind": x.kind, "text": x.text, "start": a, "end": b} for x, a, b in zip(found, [0, *ends], ends)]

    return _each(of, "array<struct<kind:string,text:string,start:long,end:long>>")(c)


def mdx_diagnostics(c: Column | str) -> Column:
    """What strict MDX reading objects to, places in bytes, line and column."""

    def of(s: str) -> list[dict]:
        found = mdx.diagnostics(s)
        names = ("start", "end", "rel_start", "rel_end")
        at = sorted({k for d in found for n in names if (k := getattr(d, n)) is not None})
        to = dict(zip(at, mdx.byte_offsets(s, at)))
        spots = text.places(s, [to[d.start] for d in found])
        return [{"code": d.code, "message": d.message} | {n: to.get(getattr(d, n)) for n in names} | {"line": line, "column": column} for d, (line, column) in zip(found, spots)]

    return _each(of, "array<struct<code:string,message:string,start:long,end:long,rel_start:long,rel_end:long,line:int,column:int>>")(c)


def md_places(c: Column | str, at: Column | str) -> Column:
    """Line and column (from 1, in code points) of each of an array of byte offsets; the text is read once for all of them."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spots in batches:
            asked: dict = {}  # equal texts with equal places have equal rows
            at = [asked.setdefault((s.as_py(), None if a is None else tuple(a)), len(asked)) for s, a in zip(texts, spots.to_pylist())]
            found = [None if s is None or a is None else [{"at": k, "line": n, "column": m} for k, (n, m) in zip(a, text.places(s, list(a)))] for s, a in asked]
            out = pa.array(found, pa.list_(pa.struct([("at", pa.int64()), ("line", pa.int32()), ("column", pa.int32())])))
            yield out if len(found) == len(at) else out.take(pa.array(at, pa.int32()))

    return F.arrow_udf(run, "array<struct<at:long,line:int,column:int>>")(c, at)


def mdx_render(c: Column | str, given: Options | str | dict | None = None) -> Column:
    """Struct of body, esm and front_matter."""
    opts = MDX if given is None else options(given)

    f = lambda s: mdx.render_mdx(s, opts)
    return _parts(f, ("body", "esm", "front_matter"), "body string, esm array<string>, front_matter string")(c)


def mdx_component(c: Column | str, name: str, given: Options | str | dict | None = None) -> Column:
    mdx.check_name(name)
    opts = MDX if given is None else options(given)
    return _each(lambda s: mdx.render_mdx(s, opts).to_component(name), "string")(c)


def mdx_link_references(c: Column | str) -> Column:
    """Link definitions of an MDX document in the order of their numbers (`def_index` of events)."""
    return _each(Once(lambda s: events.mdx_stream(s).link_references, "mdx references"), "array<struct<label:string,url:string,title:string>>")(c)


def mdx_events(c: Column | str) -> Column:
    return _rows(Once(events.mdx_events, "mdx events"), events.FIELDS)(c)


def decode_entities(c: Column | str) -> Column:
    return _each(text.decode_entities, "string")(c)


def encode_destination(c: Column | str) -> Column:
    return _each(text.encode_destination, "string")(c)


def encode_autolink(c: Column | str) -> Column:
    return _each(text.encode_autolink, "string")(c)


def normalize_label(c: Column | str) -> Column:
    return _each(text.normalize_label, "string")(c)
