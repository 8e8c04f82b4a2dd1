"""Mixing sources to target weights by temperature.

Source shares of tokens are raised to an exponent t in 0..1 and normalised; t is bisected (60 halvings,
rounded up to 6 decimals) to the least value, the flattest mixture, that keeps within a repetition limit, or
to the value that meets a target entropy. The budget, in tokens, is given or the least that passes every
source once. A source's quota is its weight times the budget: as many whole passes as fit and a part of one
more. In each pass the source's documents come in a permutation of blocks (doc_id div `BLOCK`) and, in a
block, of documents, both in order of an MD5; the last pass stops once its quota is reached, so its last
document may exceed it by a part. `at` is the place in the mixture, the share of the source's quota before it.

Token counts are words, and one for a document without words. A null source is a source of its own. Rows that repeat both doc_id and text are one
document; its rows are returned as often as it is scheduled, each. A null doc_id is block -1. An empty table
gives an empty schedule. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLOCK, SEED, REPEATS, SOURCES = 1024, "mix", 1.5, 100_000


def weights(sizes: dict[str, int], t: float) -> dict[str, float]:
    total = sum(sizes.values())
    raw = {s: (n / total) ** t for s, n in sizes.items()}
    z = math.fsum(raw.values())
    return {s: x / z for s, x in raw.items()}


def entropy(p: dict[str, float]) -> float:
    return -math.fsum(x * math.log2(x) for x in p.values() if x)


def covering_budget(sizes: dict[str, int], p: dict[str, float]) -> float:
    """The least tokens with which every source is passed once."""
    return max(n / p[s] for s, n in sizes.items())


def repeats(sizes: dict[str, int], p: dict[str, float], budget: float | None) -> float:
    b = covering_budget(sizes, p) if budget is None else budget
    return max(p[s] * b / n for s, n in sizes.items())


def bisect(enough: Callable[[float], bool]) -> float:
    """The least t in 0..1 for which enough(t), where it holds from some t on (1 where it never does)."""
    if enough(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return min(1.0, math.ceil(high * 1e6 - 1e-6) / 1e6)


def exponent(sizes: dict[str, int], target_entropy: float | None = None, limit: float | None = REPEATS, budget: float | None = None) -> float:
    """t for a target entropy in bits, or else for a limit on how often a source is passed."""
    if target_entropy is not None:
        return bisect(lambda t: entropy(weights(sizes, t)) <= target_entropy)
    if limit is None:
        raise ValueError("a target entropy or a repetition limit is needed")
    return bisect(lambda t: repeats(sizes, weights(sizes, t), budget) <= limit)


def light(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy (hash of the text), n_tokens: one row for each document."""
    text = F.coalesce("text", F.lit(""))
    n = F.greatest(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(1)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.xxhash64(text).alias("copy"), n.alias("n_tokens"))
    return rows.groupBy("doc_id", "copy", "n_tokens").agg(F.min("source").alias("source")).select("doc_id", "source", "copy", "n_tokens")


def quotas(found: DataFrame, target_entropy: float | None = None, limit: float | None = REPEATS, budget: float | None = None) -> DataFrame:
    """One row for each source: size, weight, quota (tokens). Sources are few; over `SOURCES` is refused."""
    spark = found.sparkSession
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    sums = found.groupBy(name.alias("s")).agg(F.sum("n_tokens").alias("n")).where("n > 0").limit(SOURCES + 1).collect()
    if len(sums) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    sizes = {r["s"]: r["n"] for r in sorted(sums)}
    rows = []
    if sizes:
        t = exponent(sizes, target_entropy, limit, budget)
        p = weights(sizes, t)
        b = covering_budget(sizes, p) if budget is None else budget
        rows = [(s, n, t, p[s], int(math.floor(p[s] * b + 0.5))) for s, n in sizes.items()]
    return spark.createDataFrame(rows, "s string, size long, exponent double, weight double, quota long")


def schedule(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, copy, n_tokens, epoch, before (tokens of the pass before it), at: every time a document is due."""
    found = table(light(docs), "light")
    q = quotas(found, **how)
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    due = found.withColumn("s", name).join(F.broadcast(q), "s")  # at most SOURCES rows
    due = due.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.expr("(quota - 1) div size").cast("int"))))
    due = due.withColumn("block", F.coalesce(F.floor(F.col("doc_id") / BLOCK), F.lit(-1)))
    key = lambda *c: F.md5(F.concat_ws("|", F.lit(SEED), F.col("epoch").cast("string"), "s", *[F.col(x).cast("string") for x in c]))
    blocks = due.groupBy("s", "epoch", "block").agg(F.sum("n_tokens").alias("tokens")).withColumn("k", key("block"))
    order = Window.partitionBy("s", "epoch").orderBy("k", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("s", "epoch", "block", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "epoch", "block").orderBy("k", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    due = due.withColumn("k", key("doc_id")).withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    due = due.join(blocks, ["s", "epoch", "block"]).withColumn("before", F.col("base") + F.col("inner"))
    start = F.col("epoch").cast("long") * F.col("size") + F.col("before")
    due = due.where(start < F.col("quota")).withColumn("at", (start + 0.5) / F.col("quota"))
    return due.select("doc_id", "source", "copy", "n_tokens", "epoch", "before", "at")


def mix(docs: DataFrame, **how) -> DataFrame:
    """Rows of docs, with docs' columns, each as often as the schedule has it."""
    times = schedule(docs, **how).groupBy("doc_id", "copy").agg(F.count("*").cast("int").alias("times"))
    rows = docs.select(F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))
    met = rows.join(times, F.col("key").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("copy")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def sql(limit: float = REPEATS) -> str:
    """Schedule without hash columns in DuckDB SQL over documents, at a repetition limit and with the covering budget."""
    return f"""
with recursive raw as (select doc_id, coalesce(text, '') as t, min(source) as source, coalesce('=' || min(source), '-') as s from documents group by doc_id, t),
d as (select doc_id, source, s, t, greatest(len([x for x in regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') if x <> '']), 1)::bigint as n_tokens from raw),
sizes as (select * from (select s, sum(n_tokens)::bigint as size from d group by s) where size > 0),
ends as (select max(size)::double as big, min(size)::double as small from sizes),
b(i, low, high) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when pow(big / small, 1 - (low + high) / 2) <= {limit!r} then low else (low + high) / 2 end,
    case when pow(big / small, 1 - (low + high) / 2) <= {limit!r} then (low + high) / 2 else high end from b, ends where i < 60),
t as (select case when big / small <= {limit!r} then 0.0 else least(1.0, ceil(high * 1e6 - 1e-6) / 1e6) end as t from b, ends where i = 60),
raised as (select s, size, pow(size / (select sum(size) from sizes), t) as x from sizes, t),
p as (select s, size, x / (select sum(x) from raised) as p from raised),
q as (select s, size, floor(p * (select max(size / p) from p) + 0.5)::bigint as quota from p),
due as (select doc_id, source, s, t, n_tokens, size, quota, unnest(range(0, (quota - 1) // size + 1)) as epoch from d join q using (s)),
k as (select *, coalesce(floor(doc_id / {BLOCK}), -1)::bigint as block from due),
o as (select *, coalesce(sum(n_tokens) over (partition by s, epoch order by md5('{SEED}|' || epoch || '|' || s || '|' || block), block,
  md5('{SEED}|' || epoch || '|' || s || '|' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from k)
select doc_id, source, n_tokens, epoch::int as epoch, before, (epoch * size + before + 0.5) / quota as at from o where epoch * size + before < quota"""
