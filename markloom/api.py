"""The compiler on single documents, for use without Spark."""

from __future__ import annotations

from collections.abc import Mapping

from .kernel import events, mdx, render, text
from .kernel.options import DEFAULT, MDX, Options, options


def to_html(source: str, given: Options | str | Mapping | None = None, renderer: render.Renderer | None = None) -> str:
    """HTML of a document. renderer(language, meta, code) may take fenced code over."""
    return render.compile_document(source, options(given), renderer).html


def parse(source: str, given: Options | str | Mapping | None = None, renderer: render.Renderer | None = None) -> render.Result:
    """HTML, front matter and headings; without options, front matter is looked for."""
    opts = DEFAULT.with_(front_matter=True) if given is None else options(given)
    return render.compile_document(source, opts, renderer)


def transform(source: str, given: Options | str | Mapping | None = None, renderer: render.Renderer | None = None) -> dict:
    """What parse() gives, as a plain dictionary; frontMatter is there only where the document has it."""
    r = parse(source, given, renderer)
    return {"html": r.html, "headings": r.headings} | ({} if r.front_matter is None else {"frontMatter": r.front_matter})


def block_events(source: str, given: Options | str | Mapping | None = None) -> list[dict]:
    return events.block_events(source, options(given))


def inline_events(source: str, given: Options | str | Mapping | None = None) -> list[dict]:
    return events.inline_events(source, options(given))


def mdx_segments(source: str, strict: bool = False) -> list[mdx.Segment]:
    """Segments; with strict, ValueError with the diagnostics for a document that has any."""
    if strict and (found := mdx.diagnostics(source)):
        raise ValueError(found)
    return mdx.segments(source)


def mdx_render(source: str, given: Options | str | Mapping | None = None) -> mdx.MdxOutput:
    return mdx.render_mdx(source, MDX if given is None else options(given))


def mdx_event_stream(source: str, strict: bool = False) -> events.MdxEvents:
    """Events with their version and the link definitions that they count."""
    return events.mdx_stream(source, strict)


def source_range(event: dict) -> tuple[int, int] | None:
    """The primary place of an event in bytes, if it has one."""
    return events.source_range(event)


def mdx_events(source: str, strict: bool = False) -> list[dict]:
    return events.mdx_events(source, strict)


def source_location(source: str, at: int) -> tuple[int, int]:
    """1-based line and column of a byte offset."""
    return text.line_and_column(source, at)
