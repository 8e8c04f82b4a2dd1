"""Native codecs, label keys, places and sketches against the kernel and plain counts."""

import random
from html.entities import html5

from pyspark.sql import functions as F

from markloom.functions import native
from markloom.kernel import text as T
from markloom.operators import sketches
from markloom.plans import references, relations


def test_codecs_agree_with_the_kernel_over_all_entities(spark):
    rng = random.Random(4)
    odd = ["&#0;", "&#x110000;", "&#xD800;", "&#xFEFF;", "&#1234567;", "&#12345678;", "&#x1F600;", "&;", "&x", "&amp", "&#;", "&amp;lt;", "", "&", "&&amp;&", "\\&amp;", "plain"]
    texts = [f"a&{n}b" for n in html5] + odd
    texts += ["".join(rng.choice(["&amp;", "&", "\\", "a", "é", "😀", "\"", "'", "<", "[", "]", "`", " ", "\t", "\n", "%", "&#65;", "\x7f", "\x01", "*", "ß", "ẞ", "É", "  ", "\\[", "\\]"]) for _ in range(12)) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", native.decode_entities("t").alias("d"), native.encode_destination("t").alias("u"), native.encode_autolink("t").alias("a"), native.label_key("t").alias("k"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert (r["d"], r["u"], r["a"], r["k"]) == (T.decode_entities(r["t"]), T.encode_destination(r["t"]), T.encode_autolink(r["t"]), T.normalize_label(r["t"])), r["t"]
    assert spark.createDataFrame([(None,)], "t string").select(native.decode_entities("t"), native.encode_destination("t"), native.label_key("t")).first() == (None, None, None)


def test_labels_meet(spark):
    uses = spark.createDataFrame([("s", "A  b"), ("s", "a B"), ("s", "none"), ("s", " "), ("t", "a b"), (None, "a b"), ("s", None)], "site string, label string")
    definitions = spark.createDataFrame([("s", 2, "a b", "/2"), ("s", 1, "A&#32;B", "/1"), ("s", 3, "idle", "/3"), (None, 1, "a b", "/n")], "site string, pos int, label string, url string")
    found = {tuple(r) for r in references.label_report(uses, definitions, ["site"], "pos", ["url"]).collect()}
    assert found >= {("s", "a b", "used", 2, 2, "/1"), ("s", "none", "undefined", 1, 0, None), ("s", "idle", "unused", 0, 1, "/3"), ("t", "a b", "undefined", 1, 0, None)}
    assert sorted(r["url"] or "" for r in references.resolved(uses.where("site = 's'"), definitions, ["site"], "pos", ["url"]).collect()) == ["", "", "", "/1", "/1"]


def test_places_of_a_long_text(spark):
    rng = random.Random(2)
    text = "".join(rng.choice(["é", "a", "\n", "😀", " "]) for _ in range(3000)) + "x" * 200_000 + "\nend"
    raw = text.encode()
    at = sorted({len(text[:k].encode()) for k in rng.sample(range(len(text)), 400)} | {0, len(raw)})
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    spots = spark.createDataFrame([(1, a) for a in at + at[:5]] + [(2, 0), (3, 0), (1, None), (9, 1)], "doc_id long, at long")
    found = {(r["doc_id"], r["at"]): (r["line"], r["column"]) for r in relations.located(docs, spots).collect()}
    assert found == {(1, a): T.line_and_column(text, a) for a in at} | {(3, 0): (1, 1)}


def test_diagnostics_take_linear_time(spark):
    text = "</B>\n" * 30_000
    rows = relations.diagnostics(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert "text" not in rows.columns and rows.agg(F.max("line"), F.max("column")).first() == (30_000, 1)


def test_sketches_merge(spark):
    df = spark.range(0, 60_000).select((F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), (F.col("id") % 20_000).alias("v"))
    cells = sketches.daily(df.where("id < 30000"), ["a", "b"], "v").unionByName(sketches.daily(df.where("id >= 30000"), ["a", "b"], "v"))
    found = {(r["a"], r["b"], r["level"]): (r["n"], r["n_distinct"]) for r in sketches.cubed(cells, ["a", "b"]).collect()}
    exact = {(r["a"], r["b"], r["level"]): (r["n"], r["d"]) for r in df.cube("a", "b").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d"), F.grouping_id().alias("level")).collect()}
    assert found.keys() == exact.keys() and len(found) == 12
    for k, (n, d) in exact.items():
        assert found[k][0] == n and abs(found[k][1] - d) <= 4 * sketches.error() * d
    assert sketches.merged(cells, ["a"]).where("n = 20000").count() == 3


def test_counters_add_up(spark):
    from pyspark.sql import Observation

    from markloom.kernel.counters import SUMS, Counts, counts
    from markloom.kernel.options import options
    from markloom.plans.profile import profile

    texts = ["# *a* b\n\n- x\n- [y](z)\n\n> <b>q</b> ~~d~~", "plain", "", None, "a|b\n-|-\n`c`|d\n", "    code\n\n```\nx\n```"] * 5
    rows = [("de" if k % 3 else None, t) for k, t in enumerate(texts)]
    seen = Observation()
    found = {r["lang"]: r for r in profile(spark.createDataFrame(rows, "lang string, text string").repartition(4), "lang", "gfm", seen=seen).collect()}
    total = Counts()
    for lang in ("de", None):
        one = Counts()
        for g, t in rows:
            if g == lang:
                one.add(counts(t, options("gfm")))
        assert all(found[lang][n] == getattr(one, n) for n in (*SUMS, "longest_inline"))
        total.add(one)
    assert all(seen.get[n] == getattr(total, n) for n in (*SUMS, "longest_inline")) and total.documents == len(rows) and total.inline_html == 10
