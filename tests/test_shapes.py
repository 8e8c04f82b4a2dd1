import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from markloom.functions import udf
from markloom.kernel import events, render, shapes, within
from markloom.kernel.counters import ShapedCounts, counts
from markloom.kernel.options import options
from markloom.operators import tables
from markloom.plans import relations

ATOMS = ["1", "22", "3", "007", " ", "\n", "\n\n", "# ", "> ", "- ", "a", "b ", "*", "**", "`", "[", "]", "(", ")", "|", "1. ", "2) ", "[^1]", "[^n]", "[^n]: ", "[^1]: ", "[1]: /u1", "/", "-", "\n===\n", "|-|-|\n", "    ", "```\n", "[a](/b 2)", ": ", "x1:", "&#4", "<b1>", "\\", "`A`", "`a`", "[`A`]", "[`a`]: /x", "\n\n[c](/c1)\n\n"]
OPTIONS = [{"footnotes": True}, {"math": True, "definition_lists": True, "highlight": True, "autolink_literals": True}, "gfm", "minimal", {"render_policy": "trusted", "merged_table_cells": True, "inline_footnotes": True}]


def _texts(seed: int, n: int):
    r = random.Random(seed)
    for _ in range(n):
        s = "".join(r.choice(ATOMS) for _ in range(r.randint(1, 14)))
        for _ in range(3):  # one shape, other numbers
            to: dict = {}
            yield re.sub(r"[0-9]+", lambda m: to.setdefault(m[0], str(r.choice([0, 1, 2, 10, 123456]))), s)


def _safe(f):
    def run(s: str):
        try:
            return f(s)
        except IndexError:
            return None

    return run


@pytest.mark.parametrize("given", OPTIONS, ids=str)
def test_shapes_compile_alike(given):
    o = options(given)
    f = _safe(lambda s: render.to_html(s, o))
    g, note = shapes.Shapes(f, object()), _safe(lambda s: events.note_definitions(s, o))
    notes, counted = shapes.Shapes(note, object(), ("start",)), ShapedCounts(o)
    for s in _texts(7, 700):
        assert g(s) == f(s), s
        if f(s) is not None:
            assert notes(s) == note(s), s
            assert counted(s) == counts(s, o), s


@pytest.mark.parametrize("given", OPTIONS, ids=str)
def test_pieces_are_the_whole(given):
    o = options(given)
    for s in _texts(8, 500):
        if _safe(lambda s: render.to_html(s, o))(s) is None:
            continue
        w, marks = within.Containers(o, ("LinkStart", "Text"), ("BlockQuote", "List", "ListItem")), within.Landmarks(o)
        assert w.pairs(s) == w.found(events.block_events(s, o, True)), s
        marks.source = s.encode()
        want = marks.found(events.block_events(s, o, True))
        assert list(marks.rows(s)) == want, s


def test_texts_of_one_shape_are_compiled_once():
    calls = []
    g = shapes.Shapes(lambda s: calls.append(s) or render.to_html(s, options(None)), object())
    out = [g(f"# Order {k}\n\n| *{k}* | `{'ANR'[k % 3]}` |\n|-|-|\n| [{k}](/p/{k + 1000}) | x |\n") for k in range(2000, 2500)]
    assert len(calls) == 1 and 'id="order-2499"' in out[-1] and '"/p/3499"' in out[-1] and "<code>A</code>" in out[-1]


DEFINED = ["1", "22", " ", "\n", "\n\n", "> ", "- ", "B ", "`", "[", "]", "(", "[1]: /u1", "[1]: ", "[a 1]: ", "[A 22]:\n", "<1>", " '1'", ' "t 2"', "\t", ": ", "\\", "`A`", "[`A`]: /x", "[`a`]: /`B`", "\n[c 1]: /c1 'x 1'\n", "%20", "&amp;1", "```\n", "1:", "# "]


@pytest.mark.parametrize("given", [None, *OPTIONS], ids=str)
def test_link_references_of_shapes(given):
    r, o = random.Random(9), options(given)
    f = _safe(lambda s: events.link_references(s, o))
    g = shapes.Shapes(f, object())
    for _ in range(1500):
        s = "".join(r.choice(DEFINED) for _ in range(r.randint(1, 9)))
        for _ in range(3):
            t = re.sub(r"[0-9]+", lambda m: str(r.choice([m[0], 0, 7, 123456])), s)
            assert g(t) == f(t), t


def test_link_references_of_one_shape_are_found_once(spark, monkeypatch):
    texts = [(k, None if k == 3 else f"[Click  {k % 3}]: /e/{k} 't'\n\n[click {k % 3}]: /no\n" if k % 4 else "none") for k in range(400)]
    made, calls = [], []
    monkeypatch.setattr(udf, "Shapes", lambda f, name: made.append(shapes.Shapes(f, name)) or made[-1])
    column = udf.md_link_references("s").alias("d")
    found = {r["k"]: r["d"] for r in spark.createDataFrame(texts, "k int, s string").select("k", column).collect()}
    assert found == {k: None if s is None else [(f"click {k % 3}", f"/e/{k}", "t")] if k % 4 else [] for k, s in texts}
    g = shapes.Shapes(lambda s: calls.append(s) or made[0].f(s), object())
    assert [g(s) for _, s in texts if s][-1][0]["url"] == "/e/399" and len(calls) == 3  # in two of them the numbers differ or are equal


def test_a_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(shapes, "LIMIT", 5000)
    g = shapes.Once(lambda s: s * 2, "bounded")
    assert all(g("x" * k) == "x" * 2 * k for k in range(300)) and shapes.cache("bounded").held <= 5000


def test_parts_of_a_small_file_are_dealt_out(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "p"))
    rows = relations.dealt(spark.read.parquet(str(tmp_path / "p")), "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(rows) >= 4 and max(r["count"] for r in rows) < 500


def test_event_totals_are_a_rollup(spark):
    texts = ["# a\n\n*b* [1](2)", "> - [3](4)\n> - `x`", None, "plain", "> - [5](6)\n> - `y`"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = ("HeadingStart", "LinkStart", "Code", "ListItemStart")
    want = relations.events(docs, kinds=kinds).rollup("layer", "kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    assert sorted(map(repr, relations.event_totals(docs, kinds).collect())) == sorted(map(repr, want.collect()))


def test_equal_texts_of_a_batch_share_rows(spark):
    docs = spark.createDataFrame([(k, None if k % 5 == 0 else f"*{k % 3}* [a](/b)") for k in range(60)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r["e"] for r in docs.select("doc_id", udf.md_events("text").alias("e")).collect()}
    assert all((got[k] is None) == (k % 5 == 0) for k in got) and got[1] == got[4] and [e["kind"] for e in got[1]] == ["ParagraphStart", "EmphasisStart", "Text", "EmphasisEnd", "Text", "LinkStart", "Text", "LinkEnd", "ParagraphEnd"]


def test_a_table_function_compiles_equal_texts_once(monkeypatch):
    calls = []
    monkeypatch.setattr(tables, "arrow_udtf", lambda handler, returnType: handler)  # noqa: N803
    f = tables._function({"seq": "int", "text": "string"}, lambda s: calls.append(s) or [{"seq": 0, "text": s}, {"seq": 1}], "bigint", ("once",))
    texts = ["a", None, "b", "a", "b", "a"]
    out = [r for t in f().eval(pa.RecordBatch.from_pydict({"doc_id": list(range(6)), "text": texts})) for r in t.to_pylist()]
    assert calls == ["a", "b"] and out == [x for k, s in enumerate(texts) if s for x in ({"doc_id": k, "seq": 0, "text": s}, {"doc_id": k, "seq": 1, "text": None})]


def test_places_of_events_need_no_join(spark):
    texts = ["\u00e9 [a](/b)\n\n[c](/d) [e](/f)", None, "plain", "> [a](/b)"]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3])], "doc_id long, text string")
    found = relations.event_places(docs, ("LinkStart",))
    at = relations.events(docs.distinct(), kinds=("LinkStart",)).select("doc_id", F.col("start").alias("at"))
    want = [tuple(r) for r in relations.located(docs.distinct(), at).collect()]
    assert "Join" not in found._jdf.queryExecution().toString() and sorted(map(tuple, found.collect())) == sorted([*want, *[r for r in want if r[0] == 3]])
