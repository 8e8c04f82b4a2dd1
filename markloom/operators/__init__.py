"""SQL names for the compiler: scalar functions and table functions for LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from ..kernel import events, mdx, render, text
from ..kernel.options import MDX, options

_EVENT = ", ".join(f"`{k}` {v}" for k, v in events.FIELDS.items())


def _scalar(f, kind: str = "string"):
    @pandas_udf(kind)
    def run(c: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in c], dtype=object)

    return run


@udtf(returnType=_EVENT)
class MdEvents:
    def eval(self, source: str, preset: str = "default") -> Iterator[tuple]:
        for e in events.block_events(source, options(preset), True) if source is not None else []:
            yield tuple(e.get(k) for k in events.FIELDS)


@udtf(returnType="seq int, level int, id string, text string")
class MdHeadings:
    def eval(self, source: str, preset: str = "default") -> Iterator[tuple]:
        for k, h in enumerate(render.compile_document(source, options(preset, front_matter=True)).headings):
            yield k, h["level"], h["id"], h["text"]


@udtf(returnType="seq int, kind string, text string, start long, end long")
class MdxSegments:
    def eval(self, source: str) -> Iterator[tuple]:
        found = mdx.segments(source or "")
        ends = mdx.byte_offsets(source or "", [x.end for x in found])
        for k, x in enumerate(found):
            yield k, x.kind, x.text, ends[k - 1] if k else 0, ends[k]


@udtf(returnType="code string, message string, start long, end long")
class MdxDiagnostics:
    def eval(self, source: str) -> Iterator[tuple]:
        for d in mdx.diagnostics(source or ""):
            yield d.code, d.message, len(source[: d.start].encode()), len(source[: d.end].encode())


def register(spark: SparkSession) -> None:
    """Makes md_html, md_html_gfm, mdx_body, md_slug, ... and the table functions known to SQL."""
    for name in ("default", "gfm", "commonmark", "minimal"):
        opts = options(name)
        spark.udf.register("md_html" if name == "default" else f"md_html_{name}", _scalar(lambda s, o=opts: render.to_html(s, o)))
    spark.udf.register("mdx_body", _scalar(lambda s: mdx.render_mdx(s, MDX).body))
    for name in ("slug", "decode_entities", "encode_destination", "normalize_label", "escape_text", "escape_attr"):
        spark.udf.register(f"md_{name}", _scalar(getattr(text, name)))
    for name, f in (("md_events", MdEvents), ("md_headings", MdHeadings), ("mdx_segments", MdxSegments), ("mdx_diagnostics", MdxDiagnostics)):
        spark.udtf.register(name, f)
