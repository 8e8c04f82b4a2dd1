"""Classifier from positives, filter audit and prefix trie: against brute force, SQL and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from markloom.llm import audit, positives, prefixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, part string, n long, score double"


def texts(rng, n=160):
    say = lambda k: " ".join(rng.choice(["the", "of", "Über", "é", "x1", "And", "data", "ÄÖ", "Z"]) + rng.choice(["", str(rng.randint(0, 90))]) for _ in range(k))
    out = ["", None, "   \n\t", "one", "é" * 300, "👍🏽 ok \x00 end", "A" * 900, "ab " * 400, "w" * 300_000, say(400) + " 50%", "x y " * 210, "B b " * 130]
    while len(out) < n:
        k = rng.random()
        t = say(rng.choice([3, 150, 199, 200, 201, 320]))
        out.append(rng.choice(out) if k < 0.3 else t.upper() if k < 0.4 else t + rng.choice(["#", "|", "^~<>"]) if k < 0.6 else t)
    return out


def documents(seed=3):
    rng = random.Random(seed)
    ids = [rng.randrange(400) if k % 9 else None for k in range(160)]  # some shared, some null
    return [(d, t, rng.choice(["a", "b", None, ""]), "clash", 1, 0.5) for d, t in zip(ids, texts(rng))]


def marks(seed=4):
    rng = random.Random(seed)
    return [(k if k % 11 else None, rng.choice([0, 1, None]), rng.choice([0, 0, 1])) for k in range(0, 400, 3)] + [(3, 1, 0), (3, 0, 1)]


def test_counts_of_the_transducer():
    rows = texts(random.Random(8))
    found = audit.counts(pa.array(rows, pa.string()))
    for k, t in enumerate(rows):
        words = WORD.findall(t or "")
        want = (len(t or ""), sum("A" <= c <= "Z" for c in t or ""), sum(c in audit.SYMBOLS for c in t or ""), len(words), len(set(words)))
        assert tuple(int(found[n][k]) for n in ("n_points", "n_capitals", "n_symbols", "n_words", "n_distinct")) == want


def test_equal_hashes_do_not_make_equal_words():
    data = np.frombuffer(b"aa ab aa ba ab aa", np.uint8)
    starts = np.arange(0, 17, 3)
    first = audit.distinct(data, np.zeros(6, np.int64), starts, starts + 2, np.zeros(6, np.uint64))
    assert first.tolist() == [True, True, False, True, False, False]
    long = np.frombuffer(b"x" * 300 + b"y" + b"x" * 300 + b"z" + b"x" * 300 + b"y", np.uint8)
    starts = np.array([0, 301, 602])
    assert audit.distinct(long, np.zeros(3, np.int64), starts, starts + 301, np.zeros(3, np.uint64)).tolist() == [True, True, False]


def brute_audit(rows, labels):
    good, toxic, least = defaultdict(bool), defaultdict(bool), {}
    for d, q, x in labels:
        good[d] |= q == 1 and d is not None
        toxic[d] |= x == 1 and d is not None
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = defaultdict(Counter)
    for d, t, source, *_ in rows:
        t, w = t or "", WORD.findall(t or "")
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and least[t] < d}
        for order in permutations("ABCDE"):
            seen = False
            for k, f in enumerate(order):
                cell, gone = out[source or "", "".join(order), k + 1], bad[f] and not seen
                cell.update(kept=int(not seen and not bad[f]), removed=int(gone), redundant=int(bad[f] and seen), unique_fails=int(bad[f] and sum(bad.values()) == 1), good_lost=int(gone and d is not None and good[d]), toxic_lost=int(gone and d is not None and toxic[d]))
                seen |= bad[f]
    share = Counter()
    for (p, o, k), c in out.items():
        share[p, o[k - 1]] += c["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, k): (*(c[n] for n in names), share[p, o[k - 1]]) for (p, o, k), c in out.items()}


def test_audit_against_brute_force(spark):
    rows, labels = documents(), marks()
    found = audit.audit(spark.createDataFrame(rows, DOCS).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in found.collect()}
    want = brute_audit(rows, labels)
    assert got == want and len(got) == 600 * 3
    assert sum(got["a", "ABCDE", k][1] for k in range(1, 6)) + got["a", "ABCDE", 5][0] == sum(r[2] == "a" for r in rows)


def test_no_documents_no_audit(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert audit.audit(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string, depth string"


def turns(seed, most=6):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-45, 130), 50):
        for t in range(rng.randint(1, most) if c != 40 else 200):
            text = rng.choice(["a b", "a b c", "", None, "x"]) if rng.random() < 0.9 else str(rng.random())
            rows.append((c, rng.choice([None, t, t, t, 0]), rng.choice(["user", "assistant", None, "user"]), text, "clash"))
    rows += [rows[0], rows[0], (None, 1, "user", "lost", ""), (7_000, 1, "user", "w " * 200_000, "")]
    rng.shuffle(rows)
    return rows


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [a[2:] for a in sorted(v)] for c, v in own.items()}
    members, children, saved, leaves, length = defaultdict(list), Counter(), Counter(), Counter(), {}
    for c, mine in own.items():
        h, rest = zlib.crc32(str(c).encode()) % 4, abs(c) % 20
        whole = own.get(c - (rest if c > 0 else -rest), [])[:h] + mine[h:]
        length[c] = len(whole)
        for k in range(len(whole) + 1):
            members[tuple(whole[:k])].append(c)
    for p in members:
        children[p[:-1]] += bool(p)
    for p, m in members.items():
        for k in range(len(p) + 1):
            saved[p[:k]] += (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
            leaves[p[:k]] += not children[p]
    ids = lambda p, m: ",".join(map(str, sorted(c for c in m if length[c] == len(p)))).encode()
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ids(p, m)).hexdigest()) for p, m in members.items()]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force_and_sql(spark, seed):
    rows = turns(seed)
    found = ordered(prefixes.trie(spark.createDataFrame(rows, TURNS).repartition(6)).select(*COLUMNS).collect())
    want = ordered(brute_trie(rows))
    assert found == want
    db = duckdb.connect()
    db.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    assert ordered(db.execute(f"select {', '.join(COLUMNS)} from ({prefixes.sql()})").fetchall()) == want


def test_trie_does_not_depend_on_pieces_or_hashes(spark, monkeypatch):
    """Pieces of 4 depths, blocks of 2 ids, and fingerprints that collide at first."""
    monkeypatch.setattr(prefixes, "CHUNK", 2)
    monkeypatch.setattr(prefixes, "BLOCK", 1)
    tried, honest = [], prefixes.differing
    monkeypatch.setattr(prefixes, "differing", lambda own: tried.append(1) or (own if len(tried) == 1 else honest(own)))
    rows = turns(5)
    assert ordered(prefixes.trie(spark.createDataFrame(rows, TURNS)).select(*COLUMNS).collect()) == ordered(brute_trie(rows))
    assert len(tried) == 2


def test_products_compose():
    k = prefixes.bases(1)
    h = np.random.default_rng(2).integers(0, 1 << 63, (9, 2), dtype=np.uint64)
    at, whole, _ = prefixes.products(np.zeros(9, np.int64), h, k, None)
    _, _, carry = prefixes.products(np.zeros(4, np.int64), h[:4], k, None)
    rest = prefixes.products(np.zeros(5, np.int64), h[4:], k, carry)
    assert rest[0].tolist() == at[4:].tolist() and (rest[1] == whole[4:]).all()
    assert all(int(a) == pow(int(k[0]), n, 1 << 64) for n, a in enumerate(prefixes.power(k[0], np.arange(70))))


def test_collisions_are_seen(spark):
    schema = "f long, g long, depth long, up_f long, up_g long, role string, text string"
    rows = [(1, 1, 2, 0, 0, "u", "a"), (1, 1, 2, 0, 0, "u", "a"), (2, 1, 2, 0, 0, "u", "a")]
    assert prefixes.differing(spark.createDataFrame(rows, schema)).count() == 0
    for other in ((2, 1, 2, 0, 0, "u", "b"), (2, 1, 3, 0, 0, "u", "a"), (2, 1, 2, 9, 0, "u", "a"), (2, 1, 2, 0, 0, "v", "a")):
        assert prefixes.differing(spark.createDataFrame([*rows, other], schema)).count() == 1


def test_no_conversations(spark):
    assert prefixes.trie(spark.createDataFrame([], TURNS)).count() == 0
    assert prefixes.trie(spark.createDataFrame([(None, 1, "u", "x", "")], TURNS)).count() == 0


def web(seed=6, n=900):
    """Plain texts, shouted ones and lists of marks, about one in six of them bad; ids and labels tell nothing else."""
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        bad = rng.random() < 0.17
        t = " ".join("".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 120))) + "."
        rows.append((k, rng.choice([t.upper() + "!!", t.replace(" ", " | "), "spam " * 80]) if bad else t, "s", "p", 1, 0.5))
        if rng.random() < 0.5:
            labels.append((k, 0 if bad else 1, 0))
    return rows, labels


def test_quality_from_positives(spark):
    rows, labels = web()
    rows += [(2_000, "", "s", "p", 1, 0.5), (2_001, None, "s", "p", 1, 0.5), (None, "some text", "s", "p", 1, 0.5), (2_002, "x" * 400_000, "s", "p", 1, 0.5), rows[0]]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = positives.classify(docs.repartition(4), marks).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (2_000, 2_001)}) == 1 and len({r["score"] for r in found if r["doc_id"] == 0}) == 1
    truth = {d: q for d, q, _ in labels}
    held = [(r["score"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and np.mean([s >= 0.5 for s in good]) > 0.95


def test_labels_of_held_out_rows_are_not_learned_from(spark):
    rows, labels = web(9, 300)
    docs, schema = spark.createDataFrame(rows, DOCS), "doc_id long, quality int, toxic int"
    turned = [(d, 1 - q if zlib.crc32(str(d).encode()) % 3 == 1 else q, x) for d, q, x in labels]
    one, two = ({r["doc_id"]: r["score"] for r in positives.classify(docs, spark.createDataFrame(x, schema)).collect()} for x in (labels, turned))
    assert one == two


def test_nothing_to_learn_from(spark):
    docs, none = spark.createDataFrame(web(1, 5)[0], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in positives.classify(docs, none).collect()] == [0.0] * 5
    assert positives.classify(docs.limit(0), none).count() == 0


def test_risk_has_its_gradient():
    rng = np.random.default_rng(3)
    for scale in (1.0, 3.0):  # the second has a negative part below zero, which is turned round
        g_p, g_u = rng.normal(-scale, 1, 7), rng.normal(scale if scale == 1 else -scale * 3, 1, 9)
        value, d_p, d_u = positives.risk(g_p, g_u, 0.9)
        loss = lambda z: np.logaddexp(0, -z)
        negative = loss(-g_u).mean() - 0.9 * loss(-g_p).mean()
        whole = lambda p, u: 0.9 * loss(p).mean() + loss(-u).mean() - 0.9 * loss(-p).mean() if negative >= 0 else -(loss(-u).mean() - 0.9 * loss(-p).mean())
        assert value >= 0
        for k in range(7):
            e = np.eye(7)[k] * 1e-6
            assert abs((whole(g_p + e, g_u) - whole(g_p - e, g_u)) / 2e-6 - d_p[k]) < 1e-6
        for k in range(9):
            e = np.eye(9)[k] * 1e-6
            assert abs((whole(g_p, g_u + e) - whole(g_p, g_u - e)) / 2e-6 - d_u[k]) < 1e-6


def test_prior_of_a_mixture():
    rng = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.9):
        p = rng.normal(2, 1, 4000)
        u = np.where(rng.random(6000) < share, rng.normal(2, 1, 6000), rng.normal(-3, 1, 6000))
        assert abs(positives.share_of_positives(p, u) - share) < 0.06


def test_sample_is_the_rows_of_smallest_hash(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(1)
    rows = [(k, rng.random(positives.WIDTH).astype(np.float32).tolist()) for k in range(400)]
    df = spark.createDataFrame(rows + [rows[0]] * 300, "doc_id long, vector array<float>").repartition(6)
    for n in (40, 300, 1000):
        want = df.select(F.xxhash64("doc_id", "vector").alias("h"), "vector").distinct().orderBy("h").limit(n).collect()
        found = positives.sample(df, n)
        assert found.shape[1] == positives.WIDTH and min(n, 400) * 0.9 <= len(found) <= n
        assert found.tolist() == [list(map(float, r["vector"])) for r in want][: len(found)]
