"""Queries of the compiler's operators over a folder of tables, and their SQL.

Most are templates: Markdown made from columns, compiled, next to the HTML that SQL makes from the same
columns. Others run over texts as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import queries_structure
from .functions import native, udf
from .kernel.text import DISALLOWED_TAGS, SAFE_SCHEMES
from .plans import relations

NL = "chr(10)"
#: Groups of documents that a table function gets.
PARTS = 1024
_FN = "'<sup><a href=\"#user-content-fn-a' || p_partkey || '\" id=\"user-content-fnref-a' || p_partkey || '\" data-footnote-ref>1</a></sup>'"

#: name: (table, key, Markdown in SQL, options, HTML in SQL). P, S, N stand for the part's name, its size and a line feed.
TEMPLATES: dict[str, tuple[str, str, str, object, str]] = {
    "paragraph": ("part", "p_partkey", "'A ' || P || N || 'b ' || S || N || N || 'c'", None, "'<p>A ' || P || N || 'b ' || S || '</p>' || N || '<p>c</p>' || N"),
    "atx_heading": ("part", "p_partkey", "'## ' || P || ' ##'", None, "'<h2 id=\"' || replace(P, ' ', '-') || '\">' || P || '</h2>' || N"),
    "setext_heading": ("part", "p_partkey", "P || N || '==='", None, "'<h1 id=\"' || replace(P, ' ', '-') || '\">' || P || '</h1>' || N"),
    "heading_no_ids": ("nation", "n_nationkey", "'### ' || n_name", "commonmark", "'<h3>' || n_name || '</h3>' || N"),
    "thematic_break": ("part", "p_partkey", "P || N || N || '* * *' || N || S", None, "'<p>' || P || '</p>' || N || '<hr />' || N || '<p>' || S || '</p>' || N"),
    "fenced_code": ("part", "p_partkey", "'```sql x' || N || P || ' < ' || S || N || '```'", None, "'<pre><code class=\"language-sql\">' || P || ' &lt; ' || S || N || '</code></pre>' || N"),
    "indented_code": ("part", "p_partkey", "'    ' || P || N || N || '    ' || S", None, "'<pre><code>' || P || N || N || S || '</code></pre>' || N"),
    "indented_code_ended": ("part", "p_partkey", "'    ' || P || N || '      ' || S || N", None, "'<pre><code>' || P || N || '  ' || S || N || '</code></pre>' || N"),
    "nesting_limit": ("part", "p_partkey", "repeat('> ', 35) || P", None, "repeat('<blockquote>' || N, 32) || '<p>' || repeat('&gt; ', 3) || P || '</p>' || N || repeat('</blockquote>' || N, 32)"),
    "digit_limit": ("part", "p_partkey", "'123456789. ' || P || N || N || 'x' || N || N || '1234567890. ' || S", None, "'<ol start=\"123456789\">' || N || '<li>' || P || '</li>' || N || '</ol>' || N || '<p>x</p>' || N || '<p>1234567890. ' || S || '</p>' || N"),
    "tick_limit": ("part", "p_partkey", "repeat('`', 32) || P || repeat('`', 32) || ' ' || repeat('`', 33) || S || repeat('`', 33)", None, "'<p><code>' || P || '</code> ' || repeat('`', 33) || S || repeat('`', 33) || '</p>' || N"),
    "column_limit": ("part", "p_partkey", "repeat('a|', 130) || N || repeat('-|', 130) || N || repeat(P || '|', 129)", None, "'<table>' || N || '<thead>' || N || '<tr>' || N || repeat('<th>a</th>' || N, 128) || '</tr>' || N || '</thead>' || N || '<tbody>' || N || '<tr>' || N || repeat('<td>' || P || '</td>' || N, 128) || '</tr>' || N || '</tbody>' || N || '</table>' || N"),
    "tab_indent": ("part", "p_partkey", "'-' || chr(9) || P || N || N || chr(9) || chr(9) || S || N", None, "'<ul>' || N || '<li>' || N || '<p>' || P || '</p>' || N || '<pre><code>' || S || N || '</code></pre>' || N || '</li>' || N || '</ul>' || N"),
    "list_in_quote": ("part", "p_partkey", "'> 1. ' || P || N || '>' || N || '>    ```' || N || '>    ' || S || N || '>    ```' || N || '> 2. *b*' || N", None, "'<blockquote>' || N || '<ol>' || N || '<li>' || N || '<p>' || P || '</p>' || N || '<pre><code>' || S || N || '</code></pre>' || N || '</li>' || N || '<li>' || N || '<p><em>b</em></p>' || N || '</li>' || N || '</ol>' || N || '</blockquote>' || N"),
    "short_rows": ("part", "p_partkey", "'a|b' || N || '-|-' || N || P || N || '1|2|' || S || N", None, "'<table>' || N || '<thead>' || N || '<tr>' || N || '<th>a</th>' || N || '<th>b</th>' || N || '</tr>' || N || '</thead>' || N || '<tbody>' || N || '<tr>' || N || '<td>' || P || '</td>' || N || '<td></td>' || N || '</tr>' || N || '<tr>' || N || '<td>1</td>' || N || '<td>2</td>' || N || '</tr>' || N || '</tbody>' || N || '</table>' || N"),
    "unclosed_fence": ("part", "p_partkey", "'~~~' || N || P || N || S", None, "'<pre><code>' || P || N || S || '</code></pre>' || N"),
    "indented_code_off": ("part", "p_partkey", "'    ' || P", {"indented_code_blocks": False}, "'<p>' || P || '</p>' || N"),
    "blockquote": ("part", "p_partkey", "'> ' || P || N || '> ' || N || '> - ' || S", None, "'<blockquote>' || N || '<p>' || P || '</p>' || N || '<ul>' || N || '<li>' || S || '</li>' || N || '</ul>' || N || '</blockquote>' || N"),
    "lazy_continuation": ("part", "p_partkey", "'> ' || P || N || S", None, "'<blockquote>' || N || '<p>' || P || N || S || '</p>' || N || '</blockquote>' || N"),
    "callout": ("part", "p_partkey", "'> [!WARNING]' || N || '> ' || P", None, "'<div class=\"markdown-alert markdown-alert-warning\">' || N || '<p class=\"markdown-alert-title\">Warning</p>' || N || '<p>' || P || '</p>' || N || '</div>' || N"),
    "tight_list": ("part", "p_partkey", "'- ' || P || N || '- b' || N || '  - ' || S", None, "'<ul>' || N || '<li>' || P || '</li>' || N || '<li>b' || N || '<ul>' || N || '<li>' || S || '</li>' || N || '</ul>' || N || '</li>' || N || '</ul>' || N"),
    "loose_list": ("part", "p_partkey", "'* ' || P || N || N || '* ' || S", None, "'<ul>' || N || '<li>' || N || '<p>' || P || '</p>' || N || '</li>' || N || '<li>' || N || '<p>' || S || '</p>' || N || '</li>' || N || '</ul>' || N"),
    "ordered_list": ("part", "p_partkey", "(S + 1) || '. ' || P || N || (S + 2) || '. z'", None, "'<ol start=\"' || (S + 1) || '\">' || N || '<li>' || P || '</li>' || N || '<li>z</li>' || N || '</ol>' || N"),
    "task_list": ("part", "p_partkey", "'- [x] ' || P || N || '- [ ] ' || S", None, "'<ul>' || N || '<li><input type=\"checkbox\" checked=\"\" disabled=\"\" /> ' || P || '</li>' || N || '<li><input type=\"checkbox\" disabled=\"\" /> ' || S || '</li>' || N || '</ul>' || N"),
    "html_block_trusted": ("part", "p_partkey", "'<div>' || N || P || N || '</div>'", {"render_policy": "trusted"}, "'<div>' || N || P || N || '</div>'"),
    "html_block_ended": ("part", "p_partkey", "'<div>' || N || P || N || N || S", {"render_policy": "trusted"}, "'<div>' || N || P || N || '<p>' || S || '</p>' || N"),
    "html_block_untrusted": ("part", "p_partkey", "'<div>' || P || '</div>'", None, "'&lt;div&gt;' || P || '&lt;/div&gt;'"),
    "disallowed_html": ("part", "p_partkey", "'a <b>' || P || '</b> <script>'", {"render_policy": "trusted"}, "'<p>a <b>' || P || '</b> &lt;script></p>' || N"),
    "table": ("part", "p_partkey", "'| a | b |' || N || '|:--|--:|' || N || '| ' || P || ' | ' || S || ' |'", None, "'<table>' || N || '<thead>' || N || '<tr>' || N || '<th align=\"left\">a</th>' || N || '<th align=\"right\">b</th>' || N || '</tr>' || N || '</thead>' || N || '<tbody>' || N || '<tr>' || N || '<td align=\"left\">' || P || '</td>' || N || '<td align=\"right\">' || S || '</td>' || N || '</tr>' || N || '</tbody>' || N || '</table>' || N"),
    "merged_cells": ("part", "p_partkey", "'a|b' || N || '-|-' || N || '| ' || P || ' ||'", {"merged_table_cells": True}, "'<table>' || N || '<thead>' || N || '<tr>' || N || '<th>a</th>' || N || '<th>b</th>' || N || '</tr>' || N || '</thead>' || N || '<tbody>' || N || '<tr>' || N || '<td colspan=\"2\">' || P || '</td>' || N || '</tr>' || N || '</tbody>' || N || '</table>' || N"),
    "column_widths": ("part", "p_partkey", "'a | ' || P || N || '- | ---'", {"table_column_widths": True}, "'<table>' || N || '<colgroup>' || N || '<col style=\"width: 25%\">' || N || '<col style=\"width: 75%\">' || N || '</colgroup>' || N || '<thead>' || N || '<tr>' || N || '<th>a</th>' || N || '<th>' || P || '</th>' || N || '</tr>' || N || '</thead>' || N || '</table>' || N"),
    "reference_link": ("part", "p_partkey", "'[' || P || '][Ref] [ref] ![ref]' || N || N || '[ref]: /p/' || S || ' \"t\"'", None, "'<p><a href=\"/p/' || S || '\" title=\"t\">' || P || '</a> <a href=\"/p/' || S || '\" title=\"t\">ref</a> <img src=\"/p/' || S || '\" alt=\"ref\" title=\"t\" /></p>' || N"),
    "inline_link": ("part", "p_partkey", "'[*' || P || '*](</p ' || S || '> ''q\"'')'", None, "'<p><a href=\"/p%20' || S || '\" title=\"q&quot;\"><em>' || P || '</em></a></p>' || N"),
    "image": ("part", "p_partkey", "'![a **' || P || '**](x.png)'", None, "'<p><img src=\"x.png\" alt=\"a ' || P || '\" /></p>' || N"),
    "blocked_url": ("part", "p_partkey", "'[' || P || '](javascript:x) ![i](data:y)'", None, "'<p><a href=\"\">' || P || '</a> <img src=\"\" alt=\"i\" /></p>' || N"),
    "base_path": ("part", "p_partkey", "'[a](/' || S || ') [b](/docs/' || S || ') [c](//' || S || ')'", {"link_base_path": "/docs/"}, "'<p><a href=\"/docs/' || S || '\">a</a> <a href=\"/docs/' || S || '\">b</a> <a href=\"//' || S || '\">c</a></p>' || N"),
    "autolink": ("part", "p_partkey", "'<https://e.org/?' || S || '&x> <a@b.co>'", None, "'<p><a href=\"https://e.org/?' || S || '&amp;x\">https://e.org/?' || S || '&amp;x</a> <a href=\"mailto:a@b.co\">a@b.co</a></p>' || N"),
    "autolink_literal": ("part", "p_partkey", "'(www.e.org/' || S || ') https://e.org. a@b.co'", "gfm", "'<p>(<a href=\"http://www.e.org/' || S || '\">www.e.org/' || S || '</a>) <a href=\"https://e.org\">https://e.org</a>. <a href=\"mailto:a@b.co\">a@b.co</a></p>' || N"),
    "emphasis": ("part", "p_partkey", "'*' || P || '* __' || S || '__ ***x** y* a_b_c'", None, "'<p><em>' || P || '</em> <strong>' || S || '</strong> <em><strong>x</strong> y</em> a_b_c</p>' || N"),
    "strikethrough": ("part", "p_partkey", "'~~' || P || '~~ ~' || S || '~'", None, "'<p><del>' || P || '</del> ~' || S || '~</p>' || N"),
    "sub_sup_mark": ("part", "p_partkey", "'H~' || S || '~O x^' || S || '^ ==' || P || '=='", {"subscript": True, "superscript": True, "highlight": True}, "'<p>H<sub>' || S || '</sub>O x<sup>' || S || '</sup> <mark>' || P || '</mark></p>' || N"),
    "code_span": ("part", "p_partkey", "'`` a`' || P || ' `` \\\\* &copy; `<`'", None, "'<p><code>a`' || P || '</code> * © <code>&lt;</code></p>' || N"),
    "line_breaks": ("part", "p_partkey", "P || '  ' || N || S || '\\\\' || N || 'z'", None, "'<p>' || P || '<br />' || N || S || '<br />' || N || 'z</p>' || N"),
    "math": ("part", "p_partkey", "'$x_' || S || '$ $$' || P || '$$'", {"math": True}, "'<p><code class=\"language-math math-inline\">x_' || S || '</code> <code class=\"language-math math-display\">' || P || '</code></p>' || N"),
    "definition_list": ("part", "p_partkey", "P || N || ': ' || S || N || ': z'", {"definition_lists": True}, "'<dl>' || N || '<dt>' || P || '</dt>' || N || '<dd>' || S || '</dd>' || N || '<dd>z</dd>' || N || '</dl>' || N"),
    "line_comment": ("part", "p_partkey", "P || N || '// hidden' || N || S", {"line_comments": True}, "'<p>' || P || N || S || '</p>' || N"),
    "footnote": ("part", "p_partkey", "P || '[^a' || p_partkey || '].' || N || N || '[^a' || p_partkey || ']: ' || S", {"footnotes": True}, "'<p>' || P || " + _FN + " || '.</p>' || N || '<section data-footnotes class=\"footnotes\">' || N || '<ol>' || N || '<li id=\"user-content-fn-a' || p_partkey || '\">' || N || '<p>' || S || ' <a href=\"#user-content-fnref-a' || p_partkey || '\" class=\"data-footnote-backref\" aria-label=\"Back to reference 1\">↩</a></p>' || N || '</li>' || N || '</ol>' || N || '</section>' || N"),
    "inline_footnote": ("part", "p_partkey", "'t^[' || P || ']'", {"inline_footnotes": True}, "'<p>t<sup><a href=\"#user-content-inline-fn-1\" id=\"user-content-inline-fnref-1\" data-footnote-ref>1</a></sup></p>' || N || '<section data-footnotes class=\"footnotes\">' || N || '<ol>' || N || '<li id=\"user-content-inline-fn-1\">' || N || '<p>' || P || ' <a href=\"#user-content-inline-fnref-1\" class=\"data-footnote-backref\" aria-label=\"Back to reference 1\">↩</a></p>' || N || '</li>' || N || '</ol>' || N || '</section>' || N"),
    "front_matter_skipped": ("part", "p_partkey", "'---' || N || 'a: ' || S || N || '---' || N || P", {"front_matter": True}, "'<p>' || P || '</p>' || N"),
    "minimal_preset": ("part", "p_partkey", "'a | b' || N || ':-- | --:' || N || '~~' || P || '~~ <i>'", "minimal", "'<p>a | b' || N || ':-- | --:' || N || '~~' || P || '~~ &lt;i&gt;</p>' || N"),
    "mark_limit": ("nation", "n_nationkey", "repeat('*a* ', 2100) || n_name", None, "'<p>' || repeat('<em>a</em> ', 2048) || repeat('*a* ', 52) || n_name || '</p>' || N"),
    "paren_limit": ("part", "p_partkey", "'[x](' || repeat('(', 32) || S || repeat(')', 32) || ') [y](' || repeat('(', 33) || S || repeat(')', 33) || ')'", None, "'<p><a href=\"' || repeat('(', 32) || S || repeat(')', 32) || '\">x</a> [y](' || repeat('(', 33) || S || repeat(')', 33) || ')</p>' || N"),
}


def _sql(text: str, spark: bool) -> str:
    words = {"P": "p_name", "S": "p_size", "N": NL}
    parts = text.split("'")
    for k in range(0, len(parts), 2):  # outside quotes
        parts[k] = re.sub(r"\b[PSN]\b", lambda m: words[m[0]], parts[k])
    out = "'".join(parts)
    return out if spark else out.replace("\\\\", "\\")


def _template(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    table, key, source, options, _ = TEMPLATES[name]
    rows = relations.dealt(_read(spark, sf_dir, table), key)
    return rows.select(key, udf.md_to_html(F.expr(_sql(source, True)), options).alias("html"))


def _template_sql(name: str) -> str:
    table, key, _, _, html = TEMPLATES[name]
    return f"select {key}, {_sql(html, False)} as html from {table}"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, dealt out for the compiler."""
    return relations.dealt(_read(spark, sf_dir, "part"), "p_partkey")


def native_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escapes of whole pages."""
    p = _read(spark, sf_dir, "pages")
    return p.select("page_id", F.md5(native.escape_text("html")).alias("text_md5"), F.md5(native.escape_attr("html")).alias("attr_md5"), native.needs_text_escape("html").alias("needs"))


def native_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", native.slug(F.coalesce("text", F.lit(""))).alias("slug")).select("doc_id", F.md5("slug").alias("slug_md5"))


def native_heading_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select("p_type", "p_partkey", native.slug("p_brand").alias("slug"))
    return native.heading_ids(p, "p_type", "p_partkey")


def native_safe_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "pages")
    odd = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("JavaScript:"), "url")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("mail to:x"), "url")).otherwise(F.col("url"))
    return p.select("page_id", native.is_safe_url(odd).alias("safe"), native.with_base(F.concat(F.lit("/"), F.col("page_id").cast("string")), "/b").alias("based"))


def native_filter_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages").select("page_id", F.md5(native.filter_html("html")).alias("html_md5"))


def native_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    text = F.concat(F.lit("+++ \nname = "), "p_name", F.lit("\n+++\nbody "), F.col("p_size").cast("string"))
    return p.select("p_partkey", native.front_matter(text).alias("front"), native.without_front_matter(text).alias("body"))


def native_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") % 7 + 3).alias("dashes"))
    return native.basis_points(n, ["n_regionkey"], "n_nationkey").select("n_regionkey", "n_nationkey", F.col("basis_points").cast("long").alias("basis_points"))


def native_note_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_returnflag").alias("label")).distinct()
    return native.note_ordinals(li).select("doc_id", "seq", "label", F.col("ordinal").cast("int").alias("ordinal"))


def render_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML of all documents, by the compiler only where one needs it."""
    html = relations.rendered(_read(spark, sf_dir, "documents"))
    return html.select("doc_id", F.length("html").alias("n_chars"), F.sha2("html", 256).alias("html_sha256"))


def parse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir, "documents").select("doc_id", udf.md_parse("text").alias("r"))
    return d.select("doc_id", F.sha2("r.html", 256).alias("html_sha256"), "r.front_matter", F.size("r.headings").alias("n_headings"))


def _outline_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each region: a heading for it, one for each nation, links and code."""
    n = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = F.concat(F.lit("## "), "n_name", F.lit("\n\n[x](/n/"), F.col("n_nationkey").cast("string"), F.lit(")\n\n```sql k\nselect "), F.col("n_nationkey").cast("string"), F.lit("\n```\n\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("p")))), lambda x: x["p"]), "")
    return n.groupBy("r_regionkey", "r_name").agg(body.alias("b")).select(F.col("r_regionkey").alias("doc_id"), F.concat(F.lit("# "), "r_name", F.lit("\n\n"), "b").alias("text"))


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.headings(_outline_source(spark, sf_dir)).select("doc_id", "seq", "level", "id", "text")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.links(_outline_source(spark, sf_dir)).select("doc_id", "url", "safe")


def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.code_blocks(_outline_source(spark, sf_dir)).select("doc_id", "language", "meta", "code")


def events_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relations.event_counts(_outline_source(spark, sf_dir), inline=False)
    return found.select("doc_id", "kind", F.col("n").cast("long").alias("n"))


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all documents, counted by language and kind."""
    d = _read(spark, sf_dir, "documents")
    n = F.aggregate(F.map_values(udf.md_event_counts("text")), F.lit(0), lambda a, b: a + b)
    return d.select("lang", n.alias("n")).where("n > 0").groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_events"))


def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that parts refer to and that no definition has: an anti join of two relations."""
    p = _parts(spark, sf_dir)
    text = F.concat(F.lit("[a][b"), (F.col("p_partkey") % 3).cast("string"), F.lit("] x\n\n[b"), (F.col("p_size") % 3).cast("string"), F.lit("]: /u"))
    docs = p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))
    wanted = docs.select("doc_id", F.regexp_extract("text", r"\]\[(b\d)\]", 1).alias("label"))
    return wanted.join(relations.link_references(docs), ["doc_id", "label"], "left_anti")


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("a|b\n-|:-:\n"), "p_name", F.lit("|"), F.col("p_size").cast("string")).alias("text"))
    cells = relations.table_cells(p).join(p, "doc_id")
    cut = F.decode(F.substring(F.encode("text", "UTF-8"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")), "UTF-8")
    return cells.select("doc_id", F.col("row_no").cast("int").alias("row_no"), F.col("col_no").cast("int").alias("col_no"), "align", cut.alias("cell"))


def _mdx_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    text = F.concat(F.lit("import A from 'a'\n\n<Card n={"), F.col("p_size").cast("string"), F.lit("}>\n\n# "), "p_name", F.lit("\n\n</Card>\n"), F.when(F.col("p_size") % 2 == 0, "<Box>\n").otherwise("{x}\n"))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def mdx_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.segments(_mdx_source(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def mdx_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.diagnostics(_mdx_source(spark, sf_dir)).select("doc_id", "code", "message", "line", "column")


def mdx_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _mdx_source(spark, sf_dir).select("doc_id", udf.mdx_render("text").alias("r"))
    return d.select("doc_id", "r.body", F.element_at("r.esm", 1).alias("esm"))


def mdx_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _parts(spark, sf_dir).select("p_partkey", F.concat(F.lit("*"), "p_name", F.lit("*")).alias("text"))
    return d.select("p_partkey", udf.mdx_component("text", "Page").alias("module"))


def mdx_event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.mdx_events(_mdx_source(spark, sf_dir)).groupBy("layer", "kind").agg(F.count("*").alias("n"))


def _references_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each part: two definitions, links to them, and code that is indented by two columns more."""
    p = _parts(spark, sf_dir)
    text = F.concat(F.lit("[z]: /z\n[k]: /"), "p_size", F.lit(" 'T'\n\n[k] ![z] [x](/y)\n\n      "), "p_name", F.lit("\n"))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def reference_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by reference with their definitions' numbers, a link with its target's place, virtual spaces and code."""
    kinds = ("LinkStartRef", "ImageStartRef", "LinkStart", "VirtualSpaces", "Code")
    found = relations.events(_references_source(spark, sf_dir), kinds=kinds)
    return found.select("doc_id", "kind", "def_index", "url", (F.col("url_end") - F.col("url_start")).alias("url_size"), "spaces", F.col("text").alias("code"))


def mdx_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of MDX events met with their definitions by number: a join of two relations."""
    docs = _references_source(spark, sf_dir)
    refs = relations.mdx_link_references(docs).select("doc_id", "def_index", "label", F.col("title").alias("of_title"))
    used = relations.mdx_events(docs).where("def_index is not null").select("doc_id", "def_index", "kind")
    return used.join(refs, ["doc_id", "def_index"])


def fenced_renderer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of our own for fenced code; it leaves every block without a language alone."""
    d = _parts(spark, sf_dir).select("p_partkey", F.concat(F.lit("```x y\n"), "p_name", F.lit("\n```\n\n```\nb\n```")).alias("text"))
    return d.select("p_partkey", udf.md_to_html("text", None, _upper).alias("html"))


def native_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, escapes, blank lines, breaks and tags of strings made from columns."""
    p, k = _read(spark, sf_dir, "part"), F.col("p_partkey")
    label = F.when(k % 3 == 0, F.concat(F.lit("Note_"), "p_size")).when(k % 3 == 1, F.concat(F.lit("a b"), "p_size")).otherwise(F.concat(F.lit("X-"), "p_size"))
    line = F.when(k % 3 == 0, F.lit(" \t ")).when(k % 3 == 1, F.lit("- - -")).otherwise(F.concat("p_name"))
    return p.select(
        "p_partkey", native.footnote_label(label).alias("label"), native.unescape_backslashes(F.concat(F.lit("\\\\*\\a\\["), "p_name")).alias("plain"), native.is_blank_line(line).alias("blank"),
        native.is_thematic_break(line).alias("is_break"), native.strip_tags(F.concat(F.lit("<a title='>'>"), "p_name", F.lit("</a>"))).alias("stripped"), native.info_language(F.concat(F.lit("sql "), "p_name")).alias("language"),
        native.info_meta(F.concat(F.lit("sql "), "p_name", F.lit(" "))).alias("meta"),
    )


#: MDX that strict reading objects to, P standing for the part's name: (Markdown in SQL, code, line, column).
OBJECTIONS = [
    ("'a' || N || N || '{' || P || N", "UnterminatedExpression", 3, 1),
    ("'<Card ' || P || N", "UnterminatedJsxTag", 1, 1),
    ("'<Card 1=2>' || P || N", "InvalidJsxTag", 1, 1),
    ("P || N || N || '  </B>' || N", "UnexpectedJsxClosingTag", 3, 3),
    ("'<A>' || N || N || P || N || N || '</B>' || N || '</A>' || N", "MismatchedJsxClosingTag", 5, 1),
    ("'<A>' || N || N || P || N", "UnclosedJsxTag", 1, 1),
    ("P || N || N || '  import x from 1' || N", "InvalidEsmPosition", 3, 3),
]


def mdx_objections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code that strict reading gives, where it stands, over parts."""
    cases = F.coalesce(*[F.when(F.col("p_partkey") % len(OBJECTIONS) == k, F.expr(_sql(x[0], True))) for k, x in enumerate(OBJECTIONS)])
    docs = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), cases.alias("text"))
    return relations.diagnostics(docs).select("doc_id", "code", "line", "column")


def _orders_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each order: a heading, a table of its lines, a list of them in a quote, and a note."""
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag"))), lambda x: x)
    # the number is given, so that small documents are not gathered in a few tasks before they are compiled
    d = li.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").groupBy("l_orderkey").agg(rows.alias("r"))
    row = lambda x: F.concat(F.lit("| *"), x["l_partkey"], F.lit("* | `"), x["l_returnflag"], F.lit("` |\n"))
    item = lambda x: F.concat(F.lit("> - ["), x["l_partkey"], F.lit("](/p/"), x["l_partkey"], F.lit(")[^n]\n"))
    parts = [F.lit("# Order "), F.col("l_orderkey"), F.lit("\n\n| part | flag |\n|---|:-:|\n"), F.array_join(F.transform("r", row), ""), F.lit("\n"), F.array_join(F.transform("r", item), ""), F.lit("\n[^n]: see **"), F.size("r"), F.lit("**\n")]
    return d.select(F.col("l_orderkey").alias("doc_id"), F.concat(*parts).alias("text"))


def render_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with tables, code, lists in quotes, links and notes, one for each order."""
    html = relations.rendered(_orders_source(spark, sf_dir), {"footnotes": True})
    return html.select("doc_id", F.md5("html").alias("html_md5"))


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of these documents by layer and kind, with subtotals."""
    kinds = ("TableRowStart", "TableCellStart", "ListItemStart", "BlockQuoteStart", "HeadingStart", "LinkStart", "Code", "EmphasisStart", "FootnoteRef")
    return relations.event_totals(_orders_source(spark, sf_dir), kinds, {"footnotes": True}).select("layer", "kind", "n", "n_docs")


def links_in_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose places lie between a quote's start and end; a quote's are the events around them. A document's events are one array."""
    found = udf.md_events("text", {"footnotes": True}, kinds=("BlockQuoteStart", "BlockQuoteEnd", "LinkStart"), fields=("seq", "kind", "url"))
    docs = _orders_source(spark, sf_dir).select("doc_id", found.alias("e"))
    ends = F.transform(F.filter("e", lambda x: x["kind"] != "LinkStart"), lambda x: x["seq"])  # these documents have one quote each
    inside = docs.select("doc_id", F.filter("e", lambda x: (x["kind"] == "LinkStart") & (x["seq"] > F.array_min(ends)) & (x["seq"] < F.array_max(ends))).alias("e"))
    return inside.where(F.size("e") > 0).select("doc_id", F.size("e").cast("long").alias("n_links"), F.array_min(F.transform("e", lambda x: x["url"])).alias("least_url"))


def documents_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of documents: with links but no code (except), with a heading and a table (intersect), and a semi join."""
    p = _parts(spark, sf_dir)
    text = F.concat(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("[a](/"), "p_size", F.lit(")\n\n"))).otherwise(""), F.when(F.col("p_partkey") % 3 == 0, F.lit("~~~\nc\n~~~\n\n")).otherwise(""), F.when(F.col("p_partkey") % 5 == 0, F.lit("# h\n\n")).otherwise(""), F.lit("end"))
    found = relations.events(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")), kinds=("LinkStart", "CodeBlockStart", "HeadingStart"), fields=("kind",))
    having = lambda kind: found.where(F.col("kind") == kind).select("doc_id")
    out = having("LinkStart").exceptAll(having("CodeBlockStart")).withColumn("what", F.lit("links, no code"))
    both = having("HeadingStart").intersect(having("LinkStart")).withColumn("what", F.lit("heading and link"))
    some = having("CodeBlockStart").join(having("HeadingStart"), "doc_id", "left_semi").distinct().withColumn("what", F.lit("code under headings"))
    return out.unionAll(both).unionAll(some)


def note_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.note_definitions(_orders_source(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiler's names in SQL, a scalar and a table function."""
    from .operators import register

    register(spark)
    _parts(spark, sf_dir).createOrReplaceTempView("_part_texts")
    try:
        return spark.sql("select p_partkey, md_html_gfm(concat('**', p_name, '**')) as html, h.id, h.level from _part_texts, lateral md_headings(concat('## ', p_name)) h")
    finally:
        spark.catalog.dropTempView("_part_texts")


def inline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of inline content alone: places, emphasis, code, a bare address and a hard break."""
    p = _parts(spark, sf_dir)
    text = F.concat(F.lit("\u00e9 **"), "p_name", F.lit("** `"), "p_size", F.lit("`  \nhttp://a.b/"), "p_size")
    found = p.select("p_partkey", F.explode(udf.md_inline_events(text)).alias("e"))
    return found.select("p_partkey", "e.seq", "e.kind", "e.url", F.when(F.col("e.kind") == "Code", F.col("e.text")).alias("code"))


def mdx_inline_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions and tags within text, and alone in a quote, where they are flow."""
    p = _parts(spark, sf_dir)
    text = F.concat(F.lit("a {"), "p_size", F.lit("} *b* <B n={1}>"), "p_name", F.lit("</B> <C />\n\n> {"), "p_size", F.lit("}\n\n- <D />\n"))
    found = relations.mdx_events(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))
    return found.where("kind like '%Mdx%' or kind like 'Flow%'").select("doc_id", "layer", "kind", "start", "end", F.col("text").alias("source"))


def mdx_segment_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with their places in bytes: they follow each other without gaps and end where the text ends."""
    docs = _mdx_source(spark, sf_dir).withColumn("text", F.concat(F.lit("\u00e9\u20ac\n\n"), "text"))
    found = relations.segments(docs)
    order = Window.partitionBy("doc_id").orderBy("seq")
    return found.select("doc_id", "seq", (F.col("start") == F.coalesce(F.lag("end").over(order), F.lit(0))).alias("follows"), (F.octet_length("text") == F.col("end") - F.col("start")).alias("fits"), F.max("end").over(Window.partitionBy("doc_id")).alias("size"))


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compiler's counters over documents made from orders, by the last digit of the order."""
    from .plans.profile import profile

    docs = _orders_source(spark, sf_dir).withColumn("digit", F.col("doc_id") % 10)
    return profile(docs, "digit", {"footnotes": True}).select("digit", "documents", "block_events", "container_events", "table_events", "inline_parses", "inline_fast_paths", "inline_links", "inline_marks")


def _table_function(spark: SparkSession, docs: DataFrame, select: str) -> DataFrame:
    """A table function over all rows of docs, by SQL; the view is dropped once the plan is made.

    Documents are dealt out in PARTS groups: a group of one document would be a call and an Arrow table of its own.
    """
    from .operators import tables

    tables.register(spark)
    docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).createOrReplaceTempView("_markloom_documents")
    try:
        return spark.sql(select.format("table(_markloom_documents) partition by part"))
    finally:
        spark.catalog.dropTempView("_markloom_documents")


def events_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_function(spark, _references_source(spark, sf_dir), "select doc_id, kind, def_index, url, url_end - url_start as url_size, spaces, text as code from md_events_of({}) where kind in ('LinkStartRef', 'ImageStartRef', 'LinkStart', 'VirtualSpaces', 'Code')")


def headings_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("# "), "p_name", F.lit("\n\n## "), "p_name").alias("text"))
    return _table_function(spark, p, "select doc_id, seq, level, id, text from md_headings_of({})")


def segments_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_function(spark, _mdx_source(spark, sf_dir), "select doc_id, kind, count(*) as n, sum(length(text)) as chars from mdx_segments_of({}) group by doc_id, kind")


def diagnostics_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table_function(spark, _mdx_source(spark, sf_dir), "select doc_id, code, message, line, `column` from mdx_diagnostics_of({})")


def _upper(language: str | None, meta: str | None, code: str) -> str | None:
    return None if language is None else f"<x-{language} {meta}>{code.strip().upper()}</x-{language}>\n"


def longest_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of a window over an outline: each region's last three headings."""
    h = outline(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("seq")))
    return h.withColumn("n", n).where("n <= 3").select("doc_id", "text", "n")


_OUTLINE_SQL = "with n as (select r_regionkey, r_name, n_name, n_nationkey, row_number() over (partition by r_regionkey order by n_nationkey) as k from nation join region on n_regionkey = r_regionkey), h as (select r_regionkey as doc_id, 0 as seq, 1 as level, lower(replace(r_name, ' ', '-')) as id, r_name as text from (select distinct r_regionkey, r_name from n) union all select r_regionkey, k, 2, lower(n_name), n_name from n)"
_ORDERS_SQL = """with r as (select l_orderkey as doc_id, l_linenumber as k, l_partkey as p, l_returnflag as f from lineitem),
h as (select doc_id, count(*) as n, min('/p/' || p) as least, string_agg('<tr>' || chr(10) || '<td><em>' || p || '</em></td>' || chr(10) || '<td align="center"><code>' || f || '</code></td>' || chr(10) || '</tr>' || chr(10), '' order by k, p, f) as cells,
string_agg('<li><a href="/p/' || p || '">' || p || '</a><sup><a href="#user-content-fn-n" id="user-content-fnref-n" data-footnote-ref>1</a></sup></li>' || chr(10), '' order by k, p, f) as items from r group by doc_id)"""
_FRONT = {f.__name__: f for f in (native_escape, native_slug, native_heading_ids, native_safe_url, native_filter_html, native_front_matter, native_widths, native_note_ordinals, render_documents, parse_documents, outline, links, code_blocks, events_by_kind, document_events, dangling_references, table_cells, mdx_segments, mdx_diagnostics, mdx_render, mdx_component, mdx_event_kinds, reference_events, mdx_references, fenced_renderer, longest_outlines, native_scalars, mdx_objections, render_orders, order_events, links_in_quotes, documents_by_content, note_definitions, sql_functions, inline_events, mdx_inline_events, mdx_segment_ranges, order_profile, events_of_table, headings_of_table, segments_of_table, diagnostics_of_table)}
_ESCAPED = "replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_SLUG = r"""regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace({c}, '[*~`\[\]!#]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\r]+', '-', 'g'), '[^a-z0-9_\x{{80}}-\x{{10FFFF}}-]', '', 'g'), '^-+|-+$', '', 'g')"""
_CODES = {"UnclosedJsxTag": "expected a matching closing JSX tag"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f"md_{name}": partial(_template, name) for name in TEMPLATES} | _FRONT | queries_structure.queries()


def oracle_sql() -> dict[str, str]:
    slug = _SLUG.format(c="coalesce(text, '')")
    brand = _SLUG.format(c="p_brand")
    disallowed = "|".join(DISALLOWED_TAGS)
    out = {f"md_{name}": _template_sql(name) for name in TEMPLATES} | queries_structure.oracle_sql() | {
        "native_escape": f"""select page_id, md5({_ESCAPED}) as text_md5, md5(replace({_ESCAPED}, '''', '&#39;')) as attr_md5, regexp_matches(html, '[<>&"]') as needs from pages""",
        "native_slug": f"select doc_id, md5(case when {slug} = '' then 'heading' else {slug} end) as slug_md5 from documents",
        "native_heading_ids": f"with s as (select p_type, p_partkey, {brand} as slug from part), n as (select *, row_number() over (partition by p_type, slug order by p_partkey) - 1 as n from s) select p_type, p_partkey, slug, case when n = 0 then slug else slug || '-' || n end as id from n",
        "native_safe_url": f"with u as (select page_id, lower(regexp_extract(case page_id % 3 when 0 then 'JavaScript:' || url when 1 then 'mailto:x' || url else url end, '^([^:/?#]*):', 1)) as s from pages) select page_id, s = '' or s in {SAFE_SCHEMES} as safe, '/b/' || page_id as based from u",
        "native_filter_html": f"select page_id, md5(regexp_replace(html, '<(/?(?:{disallowed})(?:[ \\t\\n\\r>/]|$))', '&lt;\\1', 'gi')) as html_md5 from pages",
        "native_front_matter": "select p_partkey, 'name = ' || p_name || chr(10) as front, 'body ' || p_size as body from part",
        "native_widths": "with d as (select n_regionkey, n_nationkey, n_nationkey % 7 + 3 as dashes from nation), r as (select *, sum(dashes) over (partition by n_regionkey order by n_nationkey) as run, sum(dashes) over (partition by n_regionkey) as total from d), k as (select *, (run * 10000 + total // 2) // total as k from r) select n_regionkey, n_nationkey, (k - coalesce(lag(k) over (partition by n_regionkey order by n_nationkey), 0))::bigint as basis_points from k",
        "native_note_ordinals": "with l as (select distinct l_orderkey as doc_id, l_linenumber as seq, l_returnflag as label from lineitem), f as (select *, min(seq) over (partition by doc_id, label) as first from l) select doc_id, seq, label, dense_rank() over (partition by doc_id order by first)::int as ordinal from f",
        "outline": f"{_OUTLINE_SQL} select doc_id, seq::int as seq, level, id, text from h",
        "longest_outlines": f"{_OUTLINE_SQL} select doc_id, text, n::int as n from (select doc_id, text, row_number() over (partition by doc_id order by seq desc) as n from h) where n <= 3",
        "links": "select n_regionkey as doc_id, '/n/' || n_nationkey as url, true as safe from nation",
        "code_blocks": "select n_regionkey as doc_id, 'sql' as language, 'k' as meta, 'select ' || n_nationkey || chr(10) as code from nation",
        "events_by_kind": "with c as (select n_regionkey as doc_id, count(*) as n from nation group by 1) select doc_id, kind, case when kind like 'Heading%' then n + 1 when kind = 'Text' then 2 * n + 1 else n end as n from c, (values ('HeadingStart'), ('HeadingEnd'), ('Text'), ('ParagraphStart'), ('ParagraphEnd'), ('CodeBlockStart'), ('Code'), ('CodeBlockEnd')) v(kind)",
        "dangling_references": "select p_partkey as doc_id, 'b' || p_partkey % 3 as label from part where p_partkey % 3 <> p_size % 3",
        "table_cells": "select p_partkey as doc_id, r::int as row_no, c::int as col_no, case when c = 1 then 'center' end as align, case when r = 0 then case when c = 0 then 'a' else 'b' end when c = 0 then p_name else p_size::varchar end as cell from part, (values (0), (1)) a(r), (values (0), (1)) b(c)",
        "mdx_segments": "with k as (select p_partkey as doc_id, p_size, p_name from part) select doc_id, 'Esm' as kind, 1::bigint as n, 18::bigint as chars from k union all select doc_id, 'Markdown', 2, (6 + length(p_name))::bigint from k union all select doc_id, 'JsxBlockOpen', case when p_size % 2 = 0 then 2 else 1 end, (12 + length(p_size::varchar) + case when p_size % 2 = 0 then 6 else 0 end)::bigint from k union all select doc_id, 'JsxBlockClose', 1, 8 from k union all select doc_id, 'Expression', 1, 4 from k where p_size % 2 = 1",
        "mdx_diagnostics": f"select p_partkey as doc_id, 'UnclosedJsxTag' as code, '{_CODES['UnclosedJsxTag']}' as message, 8::int as line, 1::int as column from part where p_size % 2 = 0",
        "mdx_render": "select p_partkey as doc_id, '<Card n={' || p_size || '}>' || chr(10) || '<h1 id=\"' || replace(p_name, ' ', '-') || '\">' || p_name || '</h1>' || chr(10) || '</Card>' || chr(10) || case when p_size % 2 = 0 then '<Box>' else '{x}' end || chr(10) as body, 'import A from ''a''' || chr(10) as esm from part",
        "mdx_component": "select p_partkey, 'export function Page() {' || chr(10) || '  return (' || chr(10) || '    <>' || chr(10) || '      <p><em>' || p_name || '</em></p>' || chr(10) || '    </>' || chr(10) || '  );' || chr(10) || '}' || chr(10) as module from part",
        "mdx_event_kinds": "select layer, kind, sum(n)::bigint as n from (select v.layer, v.kind, case v.k when 0 then 1 when 1 then 1 + (p_size + 1) % 2 else p_size % 2 end as n from part, (values ('mdx', 'Esm', 0), ('mdx', 'FlowJsxOpen', 1), ('mdx', 'FlowJsxClose', 0), ('mdx', 'FlowExpression', 2), ('block', 'HeadingStart', 0), ('block', 'HeadingEnd', 0), ('inline', 'Text', 0)) v(layer, kind, k)) group by layer, kind having sum(n) > 0",
        "reference_events": "select p_partkey as doc_id, v.kind, v.d::int as def_index, case v.kind when 'LinkStartRef' then '/' || p_size else v.u end as url, v.w::bigint as url_size, v.s::int as spaces, case v.kind when 'Code' then p_name || chr(10) end as code from part, (values ('LinkStartRef', 1, null, null, null), ('ImageStartRef', 0, '/z', null, null), ('LinkStart', null, '/y', 2, null), ('VirtualSpaces', null, null, null, 2), ('Code', null, null, null, null)) v(kind, d, u, w, s)",
        "mdx_references": "select p_partkey as doc_id, v.d::int as def_index, v.kind, v.label, v.t as of_title from part, (values (1, 'LinkStartRef', 'k', 'T'), (0, 'ImageStartRef', 'z', null)) v(d, kind, label, t)",
        "native_scalars": "select p_partkey, case p_partkey % 3 when 0 then 'note_' || p_size when 2 then 'x-' || p_size end as label, chr(92) || '*' || chr(92) || 'a[' || p_name as plain, p_partkey % 3 = 0 as blank, p_partkey % 3 = 1 as is_break, p_name as stripped, 'sql' as language, p_name as meta from part",
        "mdx_objections": "select p_partkey as doc_id, case p_partkey % 7 " + " ".join(f"when {k} then '{x[1]}'" for k, x in enumerate(OBJECTIONS)) + " end as code, case p_partkey % 7 " + " ".join(f"when {k} then {x[2]}" for k, x in enumerate(OBJECTIONS)) + " end::int as line, case p_partkey % 7 " + " ".join(f"when {k} then {x[3]}" for k, x in enumerate(OBJECTIONS)) + ' end::int as "column" from part',
        "render_orders": _ORDERS_SQL + """ select doc_id, md5('<h1 id="order-' || doc_id || '">Order ' || doc_id || '</h1>' || chr(10) || '<table>' || chr(10) || '<thead>' || chr(10) || '<tr>' || chr(10) || '<th>part</th>' || chr(10) || '<th align="center">flag</th>' || chr(10) || '</tr>' || chr(10) || '</thead>' || chr(10) || '<tbody>' || chr(10) || cells || '</tbody>' || chr(10) || '</table>' || chr(10) || '<blockquote>' || chr(10) || '<ul>' || chr(10) || items || '</ul>' || chr(10) || '</blockquote>' || chr(10) || '<section data-footnotes class="footnotes">' || chr(10) || '<ol>' || chr(10) || '<li id="user-content-fn-n">' || chr(10) || '<p>see <strong>' || n || '</strong> <a href="#user-content-fnref-n" class="data-footnote-backref" aria-label="Back to reference 1">↩</a></p>' || chr(10) || '</li>' || chr(10) || '</ol>' || chr(10) || '</section>' || chr(10)) as html_md5 from h""",
        "order_events": _ORDERS_SQL + """, e as (select doc_id, layer, kind, c as n from h, lateral (values ('block', 'HeadingStart', 1), ('block', 'BlockQuoteStart', 1), ('block', 'TableRowStart', n + 1), ('block', 'TableCellStart', 2 * n + 2), ('block', 'ListItemStart', n), ('inline', 'LinkStart', n), ('inline', 'Code', n), ('inline', 'EmphasisStart', n), ('inline', 'FootnoteRef', n)) v(layer, kind, c)) select layer, kind, sum(n)::bigint as n, count(distinct doc_id) as n_docs from e group by rollup (layer, kind)""",
        "links_in_quotes": _ORDERS_SQL + " select doc_id, n as n_links, least as least_url from h",
        "documents_by_content": "select p_partkey as doc_id, 'links, no code' as what from part where p_size % 2 = 0 and p_partkey % 3 <> 0 union all select p_partkey, 'heading and link' from part where p_size % 2 = 0 and p_partkey % 5 = 0 union all select p_partkey, 'code under headings' from part where p_partkey % 15 = 0",
        "note_definitions": "select 'n' as label, count(distinct l_orderkey) as n from lineitem",
        "sql_functions": "select p_partkey, '<p><strong>' || p_name || '</strong></p>' || chr(10) as html, replace(p_name, ' ', '-') as id, 2 as level from part",
        "order_profile": _ORDERS_SQL + " select doc_id % 10 as digit, count(*) as documents, sum(18 + 10 * n)::bigint as block_events, sum(4 + 2 * n)::bigint as container_events, sum(12 + 6 * n)::bigint as table_events, sum(3 + 3 * n)::bigint as inline_parses, sum(3)::bigint as inline_fast_paths, sum(2 * n)::bigint as inline_links, sum(2 * n)::bigint as inline_marks from h group by all",
        "inline_events": "select p_partkey, v.s::int as seq, v.k as kind, case v.k when 'AutolinkLiteral' then 'http://a.b/' || p_size end as url, case v.k when 'Code' then p_size::varchar end as code from part, (values (0, 'Text'), (1, 'StrongStart'), (2, 'Text'), (3, 'StrongEnd'), (4, 'Text'), (5, 'Code'), (6, 'HardBreak'), (7, 'AutolinkLiteral')) v(s, k)",
        "mdx_inline_events": "with k as (select p_partkey as doc_id, p_size::varchar as n, p_name as p, length(p_size::varchar) as w, length(p_name) as q from part), e as (select doc_id, 'inline' as layer, 'MdxExpression' as kind, 2 as a, '{' || n || '}' as source from k union all select doc_id, 'inline', 'MdxJsxOpen', 9 + w, '<B n={1}>' from k union all select doc_id, 'inline', 'MdxJsxClose', 18 + w + q, '</B>' from k union all select doc_id, 'inline', 'MdxJsxSelfClose', 23 + w + q, '<C />' from k union all select doc_id, 'mdx', 'FlowExpression', 32 + w + q, '{' || n || '}' from k union all select doc_id, 'mdx', 'FlowJsxSelfClose', 38 + 2 * w + q, '<D />' from k) select doc_id, layer, kind, a::bigint as start, (a + length(source))::bigint as \"end\", source from e",
        "mdx_segment_ranges": "select p_partkey as doc_id, unnest(range(0, 7))::int as seq, true as follows, true as fits, (7 + 19 + 9 + length(p_size::varchar) + 4 + 2 + length(p_name) + 10 + case when p_size % 2 = 0 then 6 else 4 end)::bigint as size from part",
        "headings_of_table": "select p_partkey as doc_id, v.k::int as seq, (v.k + 1)::int as level, replace(p_name, ' ', '-') || case when v.k = 1 then '-1' else '' end as id, p_name as text from part, (values (0), (1)) v(k)",
        "fenced_renderer": "select p_partkey, '<x-x y>' || upper(p_name) || '</x-x>' || chr(10) || '<pre><code>b' || chr(10) || '</code></pre>' || chr(10) as html from part",
    }
    same = {"events_of_table": "reference_events", "segments_of_table": "mdx_segments", "diagnostics_of_table": "mdx_diagnostics"}
    return out | {name: out[other] for name, other in same.items()}
