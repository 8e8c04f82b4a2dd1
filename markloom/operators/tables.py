"""Table functions over tables: a whole table of documents goes in as Arrow batches, rows come out as Arrow tables.

    select doc_id, id from md_headings_of(table(docs) partition by doc_id)

The table has doc_id and text (other columns are passed over). `partition by` deals documents out anew; without it
they stay where they are. A null text has no rows. `register` takes the type of doc_id, as these functions state their columns once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from ..kernel import events, mdx, render
from ..kernel import text as T
from ..kernel.options import options
from ..kernel.shapes import Once

#: Characters of text whose rows are held at once.
PIECE = 1_000_000
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _function(fields: dict[str, str], rows: Callable[[str], list[dict]], key: str, name: tuple):
    """A table function of doc_id and the rows of a document; equal texts are compiled once, under a name that says how."""
    once = Once(rows, name)

    class Handler:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            ids, first, held = batch.column("doc_id"), 0, 0
            for k, text in enumerate(batch.column("text")):
                held += len(text.as_py() or "")
                if held > PIECE or k == batch.num_rows - 1:
                    yield from self.made(ids.slice(first, k + 1 - first), batch.column("text").slice(first, k + 1 - first).to_pylist())
                    first, held = k + 1, 0

        @staticmethod
        def made(ids: pa.Array, texts: list[str | None]) -> Iterator[pa.Table]:
            order: dict = {}
            at = np.array([order.setdefault(x, len(order)) for x in texts], np.int64)
            found = [[] if x is None else once(x) for x in order]
            flat = [e for some in found for e in some]
            sizes = np.array([len(some) for some in found], np.int64)
            starts, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
            if n.sum():
                rows = pa.array(np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n))
                columns = [pa.array([e.get(c) for e in flat], _KINDS[t]).take(rows) for c, t in fields.items()]
                yield pa.table([ids.take(pa.array(np.repeat(np.arange(len(texts)), n))), *columns], names=["doc_id", *fields])

    return arrow_udtf(Handler, returnType=", ".join([f"doc_id {key}", *(f"`{n}` {t}" for n, t in fields.items())]))


def _headings(s: str, preset: str) -> list[dict]:
    return [h | {"seq": k} for k, h in enumerate(render.compile_document(s, options(preset, front_matter=True)).headings)]


def _segments(s: str) -> list[dict]:
    found = mdx.segments(s)
    ends = mdx.byte_offsets(s, [x.end for x in found])
    return [{"seq": k, "kind": x.kind, "text": x.text, "start": a, "end": b} for k, (x, a, b) in enumerate(zip(found, [0, *ends], ends))]


def _diagnostics(s: str) -> list[dict]:
    found = mdx.diagnostics(s)
    at = sorted({k for d in found for k in (d.start, d.end)})
    to = dict(zip(at, mdx.byte_offsets(s, at)))
    spots = T.places(s, [to[d.start] for d in found])
    return [{"code": d.code, "message": d.message, "start": to[d.start], "end": to[d.end], "line": n, "column": m} for d, (n, m) in zip(found, spots)]


def register(spark: SparkSession, key: str = "bigint", preset: str = "default") -> list[str]:
    """Makes md_events_of, md_headings_of, mdx_segments_of and mdx_diagnostics_of known to SQL; their names."""
    made = {
        "md_events_of": _function(events.FIELDS, lambda s: events.block_events(s, options(preset), True), key, ("events of", preset)),
        "md_headings_of": _function({"seq": "int", "level": "int", "id": "string", "text": "string"}, lambda s: _headings(s, preset), key, ("headings of", preset)),
        "mdx_segments_of": _function({"seq": "int", "kind": "string", "text": "string", "start": "long", "end": "long"}, _segments, key, ("segments of",)),
        "mdx_diagnostics_of": _function({"code": "string", "message": "string", "start": "long", "end": "long", "line": "int", "column": "int"}, _diagnostics, key, ("diagnostics of",)),
    }
    for name, f in made.items():
        spark.udtf.register(name, f)
    return list(made)
