"""Scans, as-of and interval joins, containers, sections and sessions against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from markloom.kernel.events import block_events
from markloom.operators.intervals import contained
from markloom.operators.scan import asof_join, last_values, running_sums
from markloom.plans import structure
from markloom.streaming import sessions


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bits", [2, 16])
def test_scans_in_chunks(spark, bits):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(60)]), k, rng.choice([None, None, 1, 2, 3])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, at long, k long, v int").repartition(5)
    found = {r["k"]: (r["last"], r["total"]) for r in running_sums(last_values(df, ["g"], "at", {"last": F.col("v")}, [F.col("k")], bits), ["g"], "at", {"total": F.col("v")}, [F.col("k")], bits).collect()}
    last, total = {}, {}
    for g, at, k, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        if v is not None:
            last[g], total[g] = v, total.get(g, 0) + v
        assert found[k] == (last.get(g), total.get(g, 0))


@pytest.mark.parametrize(("within", "strict"), [(None, False), (5, False), (None, True)])
def test_asof_against_brute_force(spark, within, strict):
    rng = random.Random(2)
    left = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for k in range(120)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.randint(0, 9)) for k in range(60)]
    found = asof_join(spark.createDataFrame(left, "id long, g string, at long"), spark.createDataFrame(right, "g string, at long, v long"), ["g"], "at", ["v"], within, strict, bits=3)
    want = []
    for k, g, at in left:
        near = [(a, v) for h, a, v in right if g is not None and h == g and a is not None and at is not None and (a < at if strict else a <= at)]
        best = max(near, default=None)
        want.append((k, g, at, best[1] if best and (within is None or at - best[0] <= within) else None))
    assert rows_of(found) == sorted(want, key=repr)


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_intervals_against_brute_force(spark, bits):
    rng = random.Random(bits)
    spans = [(rng.choice(["a", "b", None]), k, rng.choice([None, *range(-9, 60)]), rng.choice([None, *range(-9, 70)])) for k in range(60)]
    spots = [(rng.choice(["a", "b", None]), k, rng.choice([None, *range(-12, 75)])) for k in range(150)]
    found = contained(spark.createDataFrame(spans, "g string, container long, start long, end long").repartition(3), spark.createDataFrame(spots, "g string, point long, at long"), ["g"], bits)
    want = [(g, c, p) for g, c, a, b in spans for h, p, at in spots if g is not None and g == h and None not in (a, b, at) and a <= at < b]
    assert rows_of(found.drop("depth")) == sorted(want, key=repr)


def test_depth_of_nested_intervals(spark):
    spans = spark.createDataFrame([(1, 10, 0, 9), (1, 11, 0, 5), (1, 12, 2, 4), (1, 13, 6, 8)], "d int, container long, start long, end long")
    spots = spark.createDataFrame([(1, 1, 3), (1, 2, 5), (1, 3, 7), (1, 4, 9)], "d int, point long, at long")
    for bits in (1, 8):
        assert rows_of(contained(spans, spots, ["d"], bits)) == [(1, 10, 1, 1), (1, 10, 2, 1), (1, 10, 3, 1), (1, 11, 1, 2), (1, 12, 1, 3), (1, 13, 3, 2)]


NESTED = ["> > [a](b)\n> - [c](d)\n>   1. [e](f)\n\n[g](h)", "- a\n  > b [x](y)\n- > - [z](w)", "", None, "no", "> [q](r)\n\n> [s](t)\n" * 30]


def test_containers_against_a_stack(spark):
    docs = spark.createDataFrame(list(enumerate(NESTED)), "doc_id long, text string")
    want = []
    for k, t in enumerate(NESTED):
        stack = []
        for e in block_events(t, inline=True) if t is not None else []:
            name = e["kind"].removesuffix("Start").removesuffix("End")
            if name in structure.CONTAINERS:
                stack.append((name, e["seq"])) if e["kind"].endswith("Start") else stack.pop()
            if e["kind"] == "LinkStart":
                want += [(k, at, name, n, e["seq"], "LinkStart") for n, (name, at) in enumerate(stack, 1)]
    assert rows_of(structure.inside(docs, ("LinkStart",))) == sorted(want, key=repr)


def test_sections_of_a_document(spark):
    text = "[0](0)\n\n## B `c` &amp; \\*\n\n[1](1)\n\n# A\n\n[2](2)\n\n### C *d*\n\n~~~ py x\n~~~\n\n## E [3](3)\n\n![4](4)\n\n###### F\n<http://5>\n"
    found = {r["url"] or r["info"]: r["path"] for r in structure.sections(spark.createDataFrame([(1, text), (2, None), (3, "[6](6)")], "doc_id long, text string")).collect()}
    b, a, c, e = "B c & *", "A", "C d", "E 3"
    assert found == {"0": [], "1": [b], "2": [a], "py x": [a, c], "3": [a, e], "4": [a, e], "http://5": [a, e, "F"], "6": []}


def brute_sessions(messages, gap):
    out = []
    for g in {m[0] for m in messages}:
        mine = sorted((m[1], m[2], m[3]) for m in messages if m[0] == g)
        parts = []
        for ts, k, label in mine:
            if not parts or ts - parts[-1][-1][0] > gap:
                parts.append([])
            parts[-1].append((ts, k, label))
        for p in parts:
            for label in {x[2] for x in p if x[2]}:
                first = min(x for x in p if x[2] == label)
                out.append((g, p[0][0], p[-1][0], label, f"/{first[1]}", first[0], first[1], sum(x[2] == label for x in p)))
    return sorted(out, key=repr)


def test_sessions_with_late_rows_and_a_restart(spark, tmp_path):
    """Late rows bring earlier definitions and join sessions; the second run goes on with the first one's state."""
    rng, zero, gap = random.Random(7), datetime(2024, 1, 1), timedelta(minutes=30)
    messages = [(rng.choice(["a", "b", "c", None]), zero + timedelta(seconds=rng.randrange(86_400)), k, rng.choice(["x", "y", None])) for k in range(260)]
    hour = lambda m: (m[1] - zero).total_seconds() // 14_400
    batches = [min(hour(m) + (m[2] % 3 == 0), 6) for m in messages]
    rows = [(g, ts, k, f"[{x.upper()}]: /{k}\n\n[{x}]: /other" if x else "text", int(b)) for (g, ts, k, x), b in zip(messages, batches)]
    rows.append((None, zero + timedelta(days=30), -1, None, 7))
    df = spark.createDataFrame(rows, "grp string, ts timestamp, message_id long, text string, batch int")
    folder = str(tmp_path)
    for part in (range(4), range(4, 8)):
        for k in part:
            df.where(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = sessions.message_stream(spark, f"{folder}/in", 1)
        sessions.run(sessions.first_definitions(stream, "30 minutes", "9 hours"), f"{folder}/out", f"{folder}/state", 3).awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    assert rows_of(found) == brute_sessions(messages, gap)
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
