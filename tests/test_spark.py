"""Queries against their SQL, relations, sources and streams."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from markloom import operators, queries, sources, streaming
from markloom.functions import native, udf
from markloom.kernel import text as T
from markloom.kernel.options import DEFAULT
from markloom.kernel.render import to_html
from markloom.plans import relations

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for file in os.listdir(SMALL):
        db.execute(f"create view {file.removesuffix('.parquet')} as select * from '{SMALL}/{file}'")
    df = queries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    found = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert found == sorted(map(repr, db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({queries.oracle_sql()[name]})").fetchall()))


def test_rendered_splits_only_what_is_the_same(spark):
    texts = ["plain one\n\ntwo 'q' \"r\"", "a *b*", "", None, "x\n\n\n\ny", "tail ", " lead", "1. x", "\n\nstart", "a\n\n", "é\u00a0z", "a | b"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["html"] for r in relations.rendered(rows).collect()}
    assert found == {k: to_html(t, DEFAULT) for k, t in enumerate(texts)}


def test_native_functions_agree_with_the_kernel(spark):
    texts = ["A & B", "# *x* [y](z)", "", "É_a-b!!", "---", "  a\t\nb ", "<b>&\"'", "a.b.c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", native.slug("t").alias("s"), native.escape_text("t").alias("e"), native.escape_attr("t").alias("a"))
    for r in rows.collect():
        assert (r["s"], r["e"], r["a"]) == (T.slug(r["t"]), T.escape_text(r["t"]), T.escape_attr(r["t"]))
    urls = ["javascript:x", "https://a", "/a:b", "1x:y", "a" * 17 + ":b", " ja\tva:x", "é:x", "mailto:x", ""]
    for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", native.is_safe_url("u").alias("s")).collect():
        assert r["s"] == T.is_safe_url(r["u"]), r["u"]


def test_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert relations.headings(rows).count() == relations.links(rows).count() == relations.segments(rows).count() == 0
    none = rows.where("false")
    assert relations.events(none).count() == relations.code_blocks(none).count() == relations.table_cells(none).count() == 0
    assert rows.select(udf.md_to_html("text").alias("h")).where("h is null").count() == 1


def test_notes_and_references(spark):
    rows = spark.createDataFrame([(1, "b[^b] a[^a] b[^b]\n\n[^a]: x\n\n[^b]: y\n\n[L]: /1\n[l]: /2")], "doc_id long, text string")
    assert [(r["label"], r["ordinal"]) for r in relations.note_references(rows).orderBy("seq").collect()] == [("b", 1), ("a", 2), ("b", 1)]
    assert [(r["label"], r["url"]) for r in relations.link_references(rows, {"footnotes": True}).collect()] == [("l", "/1")]


def test_diagnostics_have_lines_and_columns(spark):
    rows = spark.createDataFrame([(1, "é\n\né <A>\n\n  </B>\n"), (2, "fine")], "doc_id long, text string")
    assert [(r["code"], r["line"], r["column"]) for r in relations.diagnostics(rows).collect()] == [("UnexpectedJsxClosingTag", 5, 3)]
    assert [r["doc_id"] for r in relations.valid_mdx(rows).collect()] == [2]


def test_sql_names(spark):
    operators.register(spark)
    assert spark.sql("select md_html('# a') as h").first()["h"] == '<h1 id="a">a</h1>\n'
    assert spark.sql("select id, level from values ('# a\n## b') t(x), lateral md_headings(x)").count() == 2
    assert spark.sql("select * from values ('<A />\nb') t(x), lateral mdx_segments(x)").count() == 2
    assert spark.sql("select kind from values ('*a*') t(x), lateral md_events(x)").count() == 5


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.md").write_text("# A\n\nx")
    (tmp_path / "in/deep/b.mdx").write_text("<B />\n")
    docs = sources.read_documents(spark, str(tmp_path / "in"))
    assert sorted((r["text"], r["is_mdx"]) for r in docs.collect()) == [("# A\n\nx", False), ("<B />\n", True)]
    assert sources.read_binary(spark, str(tmp_path / "in")).count() == 2
    rows = streaming.compile_stream(streaming.stream_documents(spark, str(tmp_path / "in")))
    streaming.write_stream(rows, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["html"] for r in out.collect()) == ["&lt;B /&gt;\n", '<h1 id="a">A</h1>\n<p>x</p>\n']
    sources.write_html(sources.balanced(docs, 2).select("doc_id", udf.md_to_html("text").alias("html")), str(tmp_path / "html"))
    assert spark.read.parquet(str(tmp_path / "html")).where(F.col("html") != "").count() == 2
