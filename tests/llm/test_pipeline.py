"""Stages of the pipeline against brute-force versions."""

import random
import re

import pytest
from test_llm import SCHEMA, brute_components, words

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def rows():
    rng = random.Random(12)
    vocabulary = {"de": "der die und schön größe nicht ein zug".split(), "en": "the of and with this thing shall be".split()}
    out = []
    passage = " ".join(f"{rng.choice(vocabulary['en'])}{i}" for i in range(60))
    for k in range(90):
        lang = rng.choice(["de", "en"])
        text = " ".join(f"{rng.choice(vocabulary[lang])} {rng.choice(vocabulary[lang])}{rng.randint(0, 99)}" for _ in range(rng.randint(20, 120)))
        if k % 9 == 4:
            text = out[-1][1] + " x"
        if k % 9 == 7:
            text = text[:100] + passage + text[100:]
        out.append((k, text, lang, f"s{k % 3}", len(text), 0.5))
    return out + [(100, "", "de", "s0", 0, 0.5), (101, "12 34", "en", "s0", 5, 0.5), (102, None, None, "s1", 0, 0.5)]


def test_stages(spark, tmp_path):
    given = rows()
    docs = spark.createDataFrame(given, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, docs, "").collect()
    assert {r["doc_id"] for r in one} == set(range(90))
    assert stages["language_id"](spark, docs, "").columns == docs.columns
    two = stages["near_duplicates"](spark, spark.createDataFrame(given[:90], SCHEMA), "")
    assert two.columns == docs.columns
    want = {k for k, (_, c) in brute_components(given[:90]).items() if c == k}
    assert {r["doc_id"] for r in two.collect()} == want and len(want) < 90
    kept = [r for r in given[:90] if r[0] in want]
    three = stages["repeated_passages"](spark, spark.createDataFrame(kept, SCHEMA), "")
    assert three.columns == docs.columns
    seen, texts = set(), {}
    for r in kept:
        b = r[1].encode()
        gone = set()
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone |= set(range(i, i + 100))
            seen.add(b[i : i + 100])
        texts[r[0]] = bytes(c for i, c in enumerate(b) if i not in gone).decode("utf-8", "ignore")
    assert {r["doc_id"]: r["text"] for r in three.collect()} == {k: t for k, t in texts.items() if re.search(r"[^\x20\x09-\x0D]", t)}
    assert all(r["n_chars"] == len(r["text"]) for r in three.collect())
    four = stages["mixture"](spark, three, "")
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} == {r["doc_id"] for r in three.collect()}
    five = stages["encoded"](spark, four, "")
    assert five.count() == four.count() and five.where("not agreed").count() == 0


def test_only_ids_that_go_are_written(spark, monkeypatch):
    """Texts meet the ids of what goes, not of what stays; a doc_id stays with all its rows if one of them does."""
    given = rows()[:90]
    want = {k for k, (_, c) in brute_components(given).items() if c == k}
    written, honest = [], corpus_pipeline.table

    def table(df, name, *a):
        written.append(honest(df, name, *a))
        return written[-1]

    monkeypatch.setattr(corpus_pipeline, "table", table)
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(given, SCHEMA), "").collect()} == want
    assert sum(t.count() for t in written) == 90 - len(want)
    shared = [(1, given[0][1], *given[0][2:]), (2, given[0][1], *given[0][2:]), (2, given[5][1], *given[5][2:])]
    found = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(shared, SCHEMA), "")
    assert sorted(r["doc_id"] for r in found.collect()) == [1, 2, 2]


def test_run(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} <= set(range(90)) and out.count() > 60
    assert all(words(r[1]) for r in rows()[:90])


def test_extra_columns_with_clashing_names(spark):
    docs = spark.createDataFrame(rows()[:30], SCHEMA).selectExpr("*", "1 as d", "2 as c", "3 as z", "4 as n", "5 as `label`", "'q' as kept", "6 as held_out", "7 as node")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() > 0
        if name != "encoded":
            assert out.columns == docs.columns, name


@pytest.mark.parametrize("stage", range(4))
def test_stages_with_names_that_operators_use_themselves(spark, stage):
    names = ["z", "kept", "n_removed", "n_bytes", "codes", "_d", "_c", "_k", "_t", "_h", "_kept", "row", "key", "copy", "times", "d", "c", "s", "bucket", "body"]
    docs = spark.createDataFrame(rows()[:20], SCHEMA).selectExpr("*", *[f"{k} as `{n}`" for k, n in enumerate(names)])
    out = corpus_pipeline.STAGES[stage][1](spark, docs, "")
    assert out.columns == docs.columns
    found = out.collect()
    assert found and all([r[n] for n in names] == list(range(len(names))) for r in found)
