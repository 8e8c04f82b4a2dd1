"""The data source of document trees."""

import os
import time
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from markloom.functions import udf
from markloom.sources import tree as sources
from markloom.sources.tree import DocumentTree, File, TreeReader, TreeWriter, bins, target


def put(folder, files):
    for name, body in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body if isinstance(body, bytes) else body.encode())


def tree(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".")}


@pytest.fixture(autouse=True)
def source(spark):
    spark.dataSource.register(DocumentTree)


def test_bins_are_even():
    files = [File(f"f{k}", f"f{k}", s, 0) for k, s in enumerate([100, 1, 1, 1, 50, 49, 0, 98])]
    found = bins(files, 100)
    assert sorted(f.path for b in found for f in b.files) == sorted(f.path for f in files)
    assert len(found) == 3 and max(sum(f.size for f in b.files) for b in found) <= 101 and bins([], 5) == []


def test_read_with_filters(spark, tmp_path):
    put(tmp_path, {"a.md": "# é", "b/c.mdx": "<B />", "b/d.markdown": b"\xff x", "b/e.txt": "no", "_job-x/f.md": "no", "empty.md": ""})
    docs = spark.read.format("markloom").load(str(tmp_path))
    want = {("a.md", "# é", 4, False), ("b/c.mdx", "<B />", 5, True), ("b/d.markdown", "� x", 3, False), ("empty.md", "", 0, False)}
    assert {tuple(r) for r in docs.collect()} == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        os.remove(tmp_path / "b/d.markdown")
        os.symlink("nowhere", tmp_path / "b/d.markdown")  # cannot be opened, and need not be
        assert [r["doc_id"] for r in spark.read.format("markloom").option("pushdown", "true").load(str(tmp_path)).where("doc_id like 'b/%' and size >= 4 and text like '<%'").collect()] == ["b/c.mdx"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert spark.read.format("markloom").load(str(tmp_path / "none")).count() == 0


def test_write_and_overwrite(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "*a*"), ("x/b.mdx", None), ("c", "c")], "doc_id string, text string").repartition(3)
    out = docs.select("doc_id", udf.md_to_html("text").alias("html"))
    out.write.format("markloom").mode("append").save(str(tmp_path / "site"))
    assert tree(tmp_path / "site") == {"a.html": "<p><em>a</em></p>\n", "x/b.html": "", "c.html": "<p>c</p>\n", "_SUCCESS": ""}
    out.where("doc_id = 'c'").write.format("markloom").mode("overwrite").save(str(tmp_path / "site"))
    assert tree(tmp_path / "site") == {"c.html": "<p>c</p>\n", "_SUCCESS": ""}


@pytest.mark.parametrize("bad", ["same", "name", "task"])
def test_failed_jobs_leave_nothing(spark, tmp_path, bad):
    put(tmp_path / "site", {"old.html": "old"})
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit("x").alias("html"))
    rows = {
        "same": rows.unionByName(rows.limit(1)), "name": rows.withColumn("doc_id", F.when(F.col("doc_id") == "d39", "../up").otherwise(F.col("doc_id"))),
        "task": rows.withColumn("html", F.when(F.col("doc_id") == "d39", F.raise_error(F.lit("broken"))).otherwise(F.col("html"))),
    }[bad]
    with pytest.raises(Exception):
        rows.write.format("markloom").mode("overwrite").save(str(tmp_path / "site"))
    assert tree(tmp_path / "site") == {"old.html": "old"} and os.listdir(tmp_path / "site") == ["old.html"]


def test_names_of_files():
    assert target("file:///a/b.md", (".md",)) == "a/b.html" and target("7", (".md",)) == "7.html"
    for bad in ("", "a/../b", "/"):
        with pytest.raises(ValueError):
            target(bad, (".md",))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    def run():
        rows = spark.readStream.format("markloom").option("maxFilesPerTrigger", 2).load(str(tmp_path / "in"))
        out = rows.select("doc_id", udf.md_to_html("text").alias("html"))
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(tmp_path / "in", {f"{k}.md": f"t{k}" for k in range(5)})
    first = run()
    time.sleep(0.05)
    put(tmp_path / "in", {"0/new.md": "new"})
    assert first == [(f"{k}.md", f"<p>t{k}</p>\n") for k in range(5)]
    assert run() == sorted([*first, ("0/new.md", "<p>new</p>\n")])


def test_the_driver_holds_no_names_of_a_large_tree(tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "LISTED", 50)
    monkeypatch.setattr(sources, "SHARE", 10)
    put(tmp_path, {f"f{k % 3}/sub/{k}.md": f"t{k}" for k in range(300)} | {"top.md": "t", "_no/x.md": "no", ".x.md": "no"})
    reader = TreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted([("top.md", "t"), *((f"f{k % 3}/sub/{k}.md", f"t{k}") for k in range(300))])
    assert len(parts) > 10 and ".md" not in repr([p.files for p in parts])


def test_what_tasks_tell_the_driver_has_no_names(tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "NAMES", 7)
    w = TreeWriter({"path": str(tmp_path)}, SimpleNamespace(names=["doc_id", "html"]), False)
    batch = lambda ids: iter([pa.RecordBatch.from_pydict({"doc_id": [f"d{k % 2}/\u00e9\n{k}.md" for k in ids], "html": [str(k) for k in ids]})])
    told = [w.write(batch(range(k, k + 50))) for k in (0, 50)] + [w.write(iter(()))]
    assert ".html" not in repr(told) and len(told[0].runs) == 8
    w.commit(told)
    assert tree(tmp_path) == {f"d{k % 2}/\u00e9\n{k}.html": str(k) for k in range(100)} | {"_SUCCESS": ""}
