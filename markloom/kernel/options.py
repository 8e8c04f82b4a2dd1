"""Options of a compilation and their presets."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

UNTRUSTED, TRUSTED = "untrusted", "trusted"


@dataclass(frozen=True)
class Options:
    """One field for each construct; the defaults are the default preset."""

    render_policy: str = UNTRUSTED
    allow_html: bool = True
    allow_link_refs: bool = True
    tables: bool = True
    merged_table_cells: bool = False
    table_column_widths: bool = False
    strikethrough: bool = True
    highlight: bool = False
    superscript: bool = False
    subscript: bool = False
    task_lists: bool = True
    autolink_literals: bool = False
    disallowed_raw_html: bool = True
    footnotes: bool = False
    inline_footnotes: bool = False
    front_matter: bool = False
    heading_ids: bool = True
    math: bool = False
    callouts: bool = True
    definition_lists: bool = False
    line_comments: bool = False
    indented_code_blocks: bool = True
    link_base_path: str | None = None

    def __post_init__(self) -> None:
        if self.render_policy not in (UNTRUSTED, TRUSTED):
            raise ValueError(f"render_policy must be {UNTRUSTED!r} or {TRUSTED!r}, not {self.render_policy!r}")

    @property
    def trusted(self) -> bool:
        return self.render_policy == TRUSTED

    def with_(self, **changes) -> Options:
        return replace(self, **changes)


DEFAULT = Options()
_OFF = {f.name: False for f in fields(Options) if f.type == "bool"}
MINIMAL = Options(**_OFF).with_(indented_code_blocks=True)
COMMONMARK = MINIMAL.with_(allow_html=True, allow_link_refs=True)
GFM = COMMONMARK.with_(tables=True, strikethrough=True, task_lists=True, autolink_literals=True, disallowed_raw_html=True)
MDX = DEFAULT.with_(render_policy=TRUSTED, disallowed_raw_html=False, front_matter=True)
PRESETS = {"default": DEFAULT, "minimal": MINIMAL, "commonmark": COMMONMARK, "gfm": GFM, "mdx": MDX}


def options(given: Options | str | Mapping | None = None, **changes) -> Options:
    """Options from a preset's name, a mapping over the default preset (camelCase names too) or Options."""
    if given is None:
        base = DEFAULT
    elif isinstance(given, Options):
        base = given
    elif isinstance(given, str):
        base = PRESETS[given]
    else:
        snake = {"".join("_" + c.lower() if c.isupper() else c for c in k): v for k, v in given.items()}
        unknown = set(snake) - {f.name for f in fields(Options)}
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        base = DEFAULT.with_(**snake)
    return base.with_(**changes) if changes else base
