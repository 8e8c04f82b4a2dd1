"""Documents as relations: events, headings, links, code blocks, tables, notes, MDX segments.

Each takes a DataFrame with a key and a text column and returns a flat one; the compiler runs once for each
document in Arrow batches, and everything after it is columns. Rows are narrow: text leaves with the event
that needs it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native, udf
from ..kernel.events import block_events
from ..kernel.options import options as of
from ..kernel.shapes import Shapes


def _exploded(docs: DataFrame, array, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    return docs.select(key, *more, F.explode(array).alias("_e")).select(key, *more, "_e.*")


def events(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id", inline: bool = True, kinds: tuple[str, ...] | None = None, fields: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each event (of some kinds, with some fields) of blocks and inline content; seq restores a document's order."""
    return _exploded(docs, udf.md_events(F.col(text), options, inline, kinds, fields), key)


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt out by key, so that those of a small file, which Spark reads in one task, come to all cores for the compiler."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), key)


def event_totals(docs: DataFrame, kinds: tuple[str, ...], options=None, text: str = "text", inline: bool = True) -> DataFrame:
    """layer, kind, n, n_docs of events of some kinds, with subtotals by layer and of all (null); rows of docs are counted as documents.

    A task adds up its documents, so a row for each layer and kind leaves it.
    """
    opts, keep = of(options), frozenset(kinds)

    def counted(s: str) -> list[tuple]:
        n = Counter((e["layer"], e["kind"]) for e in block_events(s, opts, inline) if e["kind"] in keep)
        for (layer, _), k in list(n.items()):
            n[layer, None] += k
            n[None, None] += k
        return list(n.items())

    once = Shapes(counted, ("totals", opts, keep, inline))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, n_docs = Counter(), Counter()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                for what, k in once(s) if s is not None else ():
                    n[what] += k
                    n_docs[what] += 1
        if n:
            names, kind = zip(*n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kind, pa.string()), pa.array(n.values(), pa.int64()), pa.array([n_docs[x] for x in n], pa.int64())], ["layer", "kind", "n", "n_docs"])

    return docs.select(text).mapInArrow(run, "layer string, kind string, n long, n_docs long").groupBy("layer", "kind").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def event_counts(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id", inline: bool = True) -> DataFrame:
    """Events of each document by kind; a row for each kind that it has."""
    return docs.select(key, F.explode(udf.md_event_counts(F.col(text), options, inline)).alias("kind", "n"))


def headings(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Outline: seq, level, id, text of every heading."""
    parsed = udf.md_parse(F.col(text), options)["headings"]
    return docs.select(key, F.posexplode(parsed).alias("seq", "_h")).select(key, "seq", "_h.level", "_h.id", "_h.text")


def links(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Links, images and autolinks with their targets and whether the untrusted policy lets them through."""
    found = events(docs, options, text, key, kinds=("LinkStart", "LinkStartRef", "ImageStart", "ImageStartRef", "Autolink", "AutolinkLiteral"))
    return found.select(key, "seq", "kind", "url", "title", "is_email", native.is_safe_url("url").alias("safe"), "start", "end")


def code_blocks(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Code blocks: language, meta, code."""
    found = events(docs, options, text, key, inline=False, kinds=("CodeBlockStart", "VirtualSpaces", "Code"))
    block = F.sum((F.col("kind") == "CodeBlockStart").cast("int")).over(Window.partitionBy(key).orderBy("seq"))
    part = F.coalesce("text", F.repeat(F.lit(" "), F.col("spaces")))
    lines = F.array_sort(F.collect_list(F.when(F.col("kind") != "CodeBlockStart", F.struct("seq", part.alias("part")))))
    whole = found.withColumn("block", block).groupBy(key, "block").agg(F.max("info").alias("info"), lines.alias("_l"))
    code = F.array_join(F.transform("_l", lambda x: x["part"]), "")
    return whole.select(key, "block", native.info_language("info").alias("language"), native.info_meta("info").alias("meta"), code.alias("code"))


def table_cells(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Table cells: table_no, row_no (0 is the head), col_no, align, colspan, and their source."""
    kinds = ["TableStart", "TableRowStart", "TableCellStart", "Text"]
    found = ("TableStart", "TableEnd", "TableRowStart", "TableCellStart", "Text")
    parts = events(docs, options, text, key, inline=False, kinds=found, fields=("seq", "kind", "align", "colspan", "start", "end"))
    inside = Window.partitionBy(key).orderBy("seq")
    count = lambda k: F.sum((F.col("kind") == k).cast("int"))
    depth = count("TableStart").over(inside) - F.coalesce(count("TableEnd").over(inside), F.lit(0))
    cells = parts.withColumn("_in", depth).where("_in > 0").where(F.col("kind").isin(*kinds))
    cells = cells.withColumn("table_no", count("TableStart").over(inside))
    one = Window.partitionBy(key, "table_no").orderBy("seq")
    cells = cells.withColumn("row_no", count("TableRowStart").over(one) - 1)
    row = Window.partitionBy(key, "table_no", "row_no").orderBy("seq")
    cells = cells.withColumn("col_no", count("TableCellStart").over(row) - 1).where(F.col("kind").isin("TableCellStart", "Text"))
    out = cells.groupBy(key, "table_no", "row_no", "col_no").agg(F.max("align").alias("align"), F.max("colspan").alias("colspan"), F.min(F.when(F.col("kind") == "Text", F.col("start"))).alias("start"), F.max(F.when(F.col("kind") == "Text", F.col("end"))).alias("end"))
    return out.where("row_no >= 0 and col_no >= 0")


def link_references(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Link reference definitions, the first of each label."""
    return _exploded(docs, udf.md_link_references(F.col(text), options), key)


def note_references(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """References to notes with their numbers."""
    opts = options if options is not None else {"footnotes": True}
    found = events(docs, opts, text, key, kinds=("FootnoteRef",)).select(key, "seq", "label")
    return native.note_ordinals(found, key)


def note_definitions(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Definitions of notes: label and start, the first of each label."""
    return _exploded(docs, udf.md_note_definitions(F.col(text), options if options is not None else {"footnotes": True}), key)


def segments(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """MDX segments; in order of seq they are the text."""
    return docs.select(key, F.posexplode(udf.mdx_segments(F.col(text))).alias("seq", "_e")).select(key, "seq", "_e.*")


def diagnostics(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What strict MDX reading objects to, with line and column."""
    return _exploded(docs, udf.mdx_diagnostics(F.col(text)), key)


def located(docs: DataFrame, places: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, at, line, column of the byte offsets in places (key, at), each once; docs must have each key once.

    A document's offsets come to its text in one array, and only numbers leave it.
    """
    asked = places.where("at is not null").groupBy(key).agg(F.array_sort(F.collect_set(F.col("at").cast("long"))).alias("_at"))
    found = docs.select(key, F.col(text).alias("_t")).join(asked, key).select(key, F.explode(udf.md_places("_t", "_at")).alias("_e"))
    return found.select(key, "_e.*")


def event_places(docs: DataFrame, kinds: tuple[str, ...], options=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, at, line, column of the starts of events of some kinds, each once: found where a document's events are, without a join."""
    starts = F.transform(udf.md_events(F.col(text), options, kinds=kinds, fields=("start",)), lambda e: e["start"])
    asked = docs.select(key, F.col(text).alias("_t"), F.array_sort(F.array_distinct(starts)).alias("_at"))
    return _exploded(asked, udf.md_places("_t", "_at"), key)


def valid_mdx(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that strict reading accepts."""
    return docs.where(F.size(udf.mdx_diagnostics(F.col(text))) == 0)


def mdx_link_references(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Link definitions of MDX documents: def_index, label, url, title."""
    return docs.select(key, F.posexplode(udf.mdx_link_references(F.col(text))).alias("def_index", "_e")).select(key, "def_index", "_e.*")


def mdx_events(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return _exploded(docs, udf.mdx_events(F.col(text)), key)


def rendered(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id", renderer=None) -> DataFrame:
    """key and html, by the compiler only where a document needs it.

    Documents of plain paragraphs (no character that starts a construct) become HTML in built-in expressions;
    the two kinds are split by a filter, as Spark runs a Python function for all rows of a projection.
    """
    opts = of(options)
    source = F.coalesce(F.col(text), F.lit(""))
    special = r"[\\`*_~^=$\[\]<&#>|\r\t\x00:+-]|(?m)^ |\d[.)]|@|www\.|//| \n| \z"
    plain = ~source.rlike(special)
    parts = F.filter(F.split(source, "\n{2,}"), lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" "))) != "")
    html = F.concat_ws("", F.transform(parts, lambda p: F.concat(F.lit("<p>"), native.escape_text(F.regexp_replace(p, r"^\n+|\n+$", "")), F.lit("</p>\n"))))
    easy = docs.where(plain).select(key, html.alias("html"))
    hard = docs.where(~plain).select(key, udf.md_to_html(source, opts, renderer).alias("html"))
    return easy.unionByName(hard)
