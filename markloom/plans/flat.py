"""Flat documents compiled without Python: lines are classified, grouped as gaps and islands, and written in place.

A document is flat if every line outside its fences is blank, an ATX heading, a thematic break, an item of a tight list
(`- ` and a line) or a line of a paragraph, all of plain text, and every fence is closed; within fences anything may
stand. A line is in a fence if the running number of fence lines before it is odd; a block begins where a line's class
differs from that of the line before, and a running sum of such places numbers the blocks. What a line becomes depends
on its class and on whether it is the first or last of its block. All of it is windows over a document's lines, and
documents that are not flat are told apart by the same pass, by the first line that is of none of these classes.

Constructs that other options switch on need characters that plain text has not; options that switch constructs off
would have to be asked, so it works under the default options only (`heading_ids` may be off).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import native, udf
from ..kernel.options import Options
from ..kernel.options import options as of

#: Plain text: letters first, no character that means something within a line, no space at the end.
_PLAIN = r"\p{L}(?:[^\\`*_~^=$\[\]<>&:@#|!\x00-\x1F\x7F]*[^\\`*_~^=$\[\]<>&:@#|!\x00-\x1F\x7F\s])?"
BLANK, HEADING, BREAK, ITEM, TEXT, FENCE, OTHER = range(7)


def _class(line: Column) -> Column:
    return (
        F.when(line.rlike(r"^[ ]*$"), BLANK).when(line.rlike(r"^ {0,3}```"), FENCE).when(line.rlike(rf"^#{{1,6}} {_PLAIN}$"), HEADING).when(line.isin("***", "___", "---"), BREAK)
        .when(line.rlike(rf"^- {_PLAIN}$"), ITEM).when(line.rlike(rf"^{_PLAIN}$"), TEXT).otherwise(OTHER)
    )


def lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n, line, kind, inside, flat: lines with their classes, whether a fence holds them, and whether they may be in a flat document."""
    source = F.regexp_replace(F.col(text), r"\n\z", "")
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(source, "\n")).alias("n", "line")).withColumn("kind", _class(F.col("line")))
    order = Window.partitionBy(key).orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fence = (F.col("kind") == FENCE).cast("int")
    rows = rows.withColumn("fences", F.coalesce(F.sum(fence).over(before), F.lit(0)))
    rows = rows.withColumn("inside", F.col("fences") % 2 == 1)
    # within a fence a line has no class of its own
    own = F.when(F.col("inside"), None).otherwise(F.col("kind"))
    rows = rows.withColumn("prev", F.lag(own).over(order)).withColumn("last", F.last(F.when(own != BLANK, own), ignorenulls=True).over(before))
    opening, closing = F.col("line").rlike("^```[A-Za-z0-9]*$"), F.col("line") == "```"
    flat = (
        F.when(F.col("kind") == FENCE, F.when(F.col("inside"), closing).otherwise(opening)).when(F.col("inside"), ~F.col("line").rlike(r"[\x00\r]"))
        .when(F.col("kind") == OTHER, False)
        .when(F.col("line") == "---", F.coalesce(F.col("prev") == BLANK, F.col("n") == 0))
        .when(F.col("kind") == TEXT, F.coalesce(F.col("prev") != ITEM, F.lit(True)) & ~F.col("line").rlike("(?i)www[.]|://"))
        .when(F.col("kind") == ITEM, ~(F.coalesce(F.col("prev") == BLANK, F.lit(False)) & F.coalesce(F.col("last") == ITEM, F.lit(False)) & ~F.col("after_fence")))
        .otherwise(True)
    )
    gap = F.last(F.when(F.col("kind") == FENCE, F.col("n")), ignorenulls=True).over(before)
    item = F.last(F.when(~F.col("inside") & (F.col("kind") == ITEM), F.col("n")), ignorenulls=True).over(before)
    rows = rows.withColumn("after_fence", F.coalesce(gap > item, F.lit(False)))
    return rows.withColumn("flat", flat)


def compiled(docs: DataFrame, heading_ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, html of the flat documents among docs; keys must be unique. Null texts are not flat."""
    order = Window.partitionBy(key).orderBy("n")
    rows = lines(docs, text, key)
    kind, inside = F.col("kind"), F.col("inside")
    # islands: a heading, break or fence is a block for itself, items and text go on
    same = ~inside & kind.isin(ITEM, TEXT) & F.coalesce(kind == F.col("prev"), F.lit(False))
    rows = rows.withColumn("block", F.sum(F.when(same, 0).otherwise(1)).over(order))
    rows = rows.withColumn("first", ~same).withColumn("ends", F.coalesce(F.lead("block").over(order) != F.col("block"), F.lit(True)))
    body = native.escape_text(F.regexp_replace("line", r"^(?:#+|-) ", ""))
    level = F.length(F.regexp_extract("line", "^(#*)", 1)).cast("string")
    ident = F.lit("")
    if heading_ids:
        slug = F.when(~inside & (kind == HEADING), native.slug(F.regexp_replace("line", r"^#+ ", "")))
        rows = rows.withColumn("slug", slug)
        repeat = F.row_number().over(Window.partitionBy(key, "slug").orderBy("n")) - 1
        rows = rows.withColumn("repeat", repeat)
        ident = F.concat(F.lit(' id="'), native.escape_attr(F.when(F.col("repeat") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), "repeat"))), F.lit('"'))
    info = F.regexp_extract("line", "^```(.*)$", 1)
    when = lambda c, a: F.when(c, F.lit(a)).otherwise("")
    html = (
        F.when((kind == FENCE) & inside, "</code></pre>\n").when(kind == FENCE, F.concat(F.lit("<pre><code"), F.when(info != "", F.concat(F.lit(' class="language-'), info, F.lit('"'))).otherwise(""), F.lit(">")))
        .when(inside, F.concat(native.escape_text("line"), F.lit("\n"))).when(kind == BREAK, "<hr />\n").when(kind == HEADING, F.concat(F.lit("<h"), level, ident, F.lit(">"), body, F.lit("</h"), level, F.lit(">\n")))
        .when(kind == ITEM, F.concat(when(F.col("first"), "<ul>\n"), F.lit("<li>"), body, F.lit("</li>\n"), when(F.col("ends"), "</ul>\n")))
        .when(kind == TEXT, F.concat(when(F.col("first"), "<p>"), native.escape_text("line"), F.when(F.col("ends"), "</p>\n").otherwise("\n"))).otherwise("")
    )
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", html.alias("html")))), lambda x: x["html"]), "")
    done = rows.groupBy(key).agg(F.bool_and("flat").alias("flat"), F.sum((kind == FENCE).cast("int")).alias("fences"), whole.alias("html"))
    return done.where("flat and fences % 2 = 0").select(key, "html")


def rendered(docs: DataFrame, options: Options | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, html, native: all documents, the flat ones by built-in functions and the others by the compiler; keys unique and not null."""
    opts = of(options)
    if opts.with_(heading_ids=True) != of(None):
        raise ValueError("flat documents are compiled under the default options")
    easy = compiled(docs, opts.heading_ids, text, key)
    hard = docs.join(easy.select(key), key, "left_anti").select(key, udf.md_to_html(text, opts).alias("html"))
    return easy.withColumn("native", F.lit(True)).unionByName(hard.withColumn("native", F.lit(False)))
