"""Blocks of index lists and grouped answers of the n-gram Jaccard join."""

import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from test_llm import brute_components, by_id

from markloom.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def test_blocks_skip_what_has_no_room():
    rng = np.random.default_rng(4)
    skipped = seen = 0
    for trial in range(40):
        size = int(rng.integers(2, 400))
        n = np.sort(rng.integers(5, rng.choice([20, 60, 400]), size))
        pos = (rng.random(size) * jaccard.prefix_size(n)).astype(np.int64)
        if trial % 2:
            pos[n > np.median(n)] = jaccard.prefix_size(n[n > np.median(n)]) - 1
        blocks = jaccard.Blocks(n, pos)
        for i in range(size - 1):
            found = blocks.after(i)
            all_ = np.arange(i + 1, size)
            want = all_[jaccard.room(n[all_], pos[all_], n[i], pos[i])]
            assert np.isin(want, found).all() and (np.diff(found) > 0).all()
        seen, skipped = seen + blocks.seen, skipped + blocks.skipped
    assert 0 < skipped < seen


def near_copies(seed=3, n=120):
    """A large group of near copies around the limit, some of them one word from each other, and texts of their own."""
    rng = random.Random(seed)
    base, rows = [f"w{k}" for k in range(90)], []
    for k in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
            w[rng.choice([3, 4, 5, 50, rng.randrange(90)])] = f"z{rng.randrange(6)}"
        rows.append((k, " ".join(w), "en", "s", 1, 0.5))
    return rows + [(n + k, " ".join(f"own{k}-{j}" for j in range(30)), "en", "s", 1, 0.5) for k in range(9)]


@pytest.mark.parametrize("partners", [3, 256])
def test_groups_of_partners_lose_nothing(spark, monkeypatch, partners):
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    tables, honest = {}, jaccard.table

    def written(df, name, *a):
        out = honest(df, name, *a)
        tables.setdefault(name, out)
        return out

    monkeypatch.setattr(jaccard, "table", written)
    rows = near_copies()
    found = jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(found).items()} == brute_components(rows)
    links = tables["near"].collect()
    assert links and len({(min(r["x"], r["y"]), max(r["x"], r["y"])) for r in links}) == len(links)
    assert sum(r["derived"] for r in links) > (len(links) / 2 if partners > 3 else 0)


def test_index_entries_that_cannot_be_linked_go():
    """Entries are kept for pairs without the list's leader alone, and no pair with room is lost."""
    rng = np.random.default_rng(6)
    dropped = 0
    for _ in range(30):
        size = int(rng.integers(1, 120))
        n = rng.integers(5, rng.choice([9, 60, 400]), size)
        pos = (rng.random(size) * jaccard.prefix_size(n)).astype(np.int64)
        node, token = rng.permutation(size).astype(np.int64), np.sort(rng.integers(0, rng.choice([2, 9, 40]), size)).astype(np.uint64)
        body = jaccard.pack(token, np.arange(size, dtype=np.uint32), pos.astype(np.uint32), node, n.astype(np.uint32))
        found = jaccard._meet(pa.table([pa.array([0], pa.int32()), pa.array([body], pa.binary())], ["bucket", "body"])).to_pylist()
        kept = {(r["token"], r["x"]): r["size"] for r in found if r["kind"] == 1}
        star = {(r["x"], r["y"]) for r in found if r["kind"] == 0}
        for t in np.unique(token):
            own = np.flatnonzero(token == t)
            own = own[np.lexsort((jaccard.mix(node[own].view(np.uint64)), pos[own]))]
            far = {int(a): {int(b) for b in own if b != a and jaccard.room(n[a], pos[a], n[b], pos[b])} for a in own}
            lead, name = int(own[0]), int(t.view(np.int64))
            assert (name, int(node[lead])) not in kept
            assert all((int(node[lead]), int(node[b])) in star for b in far[lead])
            there = {int(a) for a in own[1:] if (name, int(node[a])) in kept}
            need = {int(a) for a in own[1:] if far[int(a)] - {lead}}
            assert need <= there and (there == need or len(own) > jaccard.LONG_LIST)
            assert {kept[name, int(node[a])] for a in there} <= {len(there)}
            dropped += len(own) - len(there)
    assert dropped


def test_texts_are_dealt_once_to_be_compared(spark):
    z = zstandard.ZstdCompressor()
    texts = spark.createDataFrame([(k, z.compress(r[1].encode())) for k, r in enumerate(near_copies(n=20))], "node long, z binary")
    links = jaccard._links(spark.createDataFrame([(0, 1), (0, 2)], "x long, y long"), texts)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
