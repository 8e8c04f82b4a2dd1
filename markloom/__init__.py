"""markloom: a PySpark-native document engine."""

from .api import block_events, inline_events, mdx_event_stream, mdx_events, mdx_render, mdx_segments, parse, source_location, source_range, to_html, transform
from .kernel.options import COMMONMARK, DEFAULT, GFM, MDX, MINIMAL, Options, options

__all__ = ["COMMONMARK", "DEFAULT", "GFM", "MDX", "MINIMAL", "Options", "block_events", "inline_events", "mdx_event_stream", "mdx_events", "mdx_render", "mdx_segments", "options", "parse", "source_location", "source_range", "to_html", "transform"]
