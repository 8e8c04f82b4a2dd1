"""Quality rules with risk-controlled cutoffs, in DataFrame expressions only.

Base: a text of fewer than 50 words, or with over half its words in repeated 3-word windows, fails. Each
rule is an integer measure (per mille) and a fixed ladder of cutoffs from loose to strict; a document is
rejected by a rule when its measure exceeds the cutoff chosen for its stratum (language).

Choosing: labelled documents that pass the base are the holdout; equal texts of a stratum count once, as good if any
copy is labelled good. The rules' ladders are walked together from their loose ends, so step j is one vector of cutoffs
(a ladder that has ended keeps its last cutoff). A step is certified when the exact binomial tail P(Bin(n, alpha) <= k) is
at most delta * n / N, where n is the number of good holdouts of the stratum, N of all strata and k the number of good
ones that any rule would reject; the walk ends at the first step that is not (fixed-sequence testing, so a walk needs no
further correction; the strata share delta by their sizes, a weighted Bonferroni correction). With probability 1 - delta
no stratum loses more than a share alpha of its good documents. Among certified steps the one with the most bad less
`price` times good holdouts rejected is taken, the looser of equals, and none unless that is positive. A stratum that has
half of the good holdouts needs about 183 of them where none is rejected, one that has a tenth 262.

Null and empty texts have no words and fail the base. A null lang is a stratum of its own. A stratum without
enough good labels certifies nothing and rejects nothing. doc_ids labelled more than once count as good if
any label is good; null labels and labels of unknown documents are ignored. Rows that repeat give repeated rows;
other columns are ignored; an empty table gives an empty result. A text is whole in one row, whatever its length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_WORDS, ALPHA, DELTA, PRICE = 50, 0.02, 0.05, 20
#: Rule: (numerator, denominator, cutoffs in per mille from loose to strict).
RULES = {
    "symbols": ("n_symbols", "n_words", [1000, 800, 600, 500, 400, 300, 250, 200, 150, 120, 100, 80, 60]),
    "dup_lines": ("n_dup_lines", "n_lines", [900, 800, 700, 600, 550, 500, 450, 400, 350, 300, 250]),
    "repeat_words": ("n_repeat_words", "n_words", [500, 450, 400, 350, 300, 250, 200, 150]),
    "word_length": ("word_chars", "n_words", [20000, 15000, 12000, 10000, 9000, 8000, 7500, 7000, 6500]),
    "capitals": ("n_capitals", "word_chars", [900, 800, 700, 600, 500, 400, 300, 250, 200]),
}

STEPS = max(len(cuts) for _, _, cuts in RULES.values())


def let(value: Column, f) -> Column:
    """f(value), with value computed once for all the lambdas in f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more: sorted hashes of windows bring equal ones together."""
    n = F.size(words)
    last = F.lit(2)

    def covered(at: Column) -> Column:
        gap = lambda i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), F.get(at, i) + 3) - F.get(at, i))
        return F.aggregate(F.sequence(F.lit(0), F.size(at) - 1), F.lit(0), lambda a, i: a + gap(i))

    def twice(s: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
        k = F.sequence(F.lit(0), F.size(s) - 1)
        kept = F.filter(k, lambda i: F.when(i > 0, same(i, i - 1)).otherwise(False) | same(i, i + 1))
        return let(F.array_sort(F.transform(kept, lambda i: F.get(s, i)["i"])), lambda at: F.when(F.size(at) == 0, 0).otherwise(covered(at)))

    def windows(h: Column) -> Column:
        paired = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(paired, twice))

    hashes = F.transform(F.sequence(F.lit(0), n - 1 - last), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, 0).otherwise(let(hashes, windows))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, stratum, copy (hash of the text) and the counts of every whole text."""
    text = F.coalesce("text", F.lit(""))
    n_of = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    per_word = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    per_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-")).alias("stratum"),
        F.struct(F.xxhash64(text), F.length(text)).alias("copy"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        n_of(SYMBOLS).cast("long").alias("n_symbols"),
        n_of(CAPITALS).cast("long").alias("n_capitals"),
        per_word.alias("w"),
        per_line.alias("l"),
    )
    out = out.select("doc_id", "stratum", "copy", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "n_capitals", "l.n_lines")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def measure(rule: str) -> Column:
    top, bottom, _ = RULES[rule]
    return F.floor(1000 * F.col(top) / F.greatest(F.col(bottom), F.lit(1)))


def _log_factorial(x: Column) -> Column:
    y = x + 1.0
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, a: float) -> Column:
    """P(Bin(n, a) <= k), summed downward from k; 1 where k is at or above the mean, where nothing can be certified."""
    k, n = k.cast("double"), n.cast("double")
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(a) + (n - k) * math.log1p(-a))
    terms = F.least(k, F.ceil(12 * F.sqrt(n) + 60)).cast("int")  # beyond 12 deviations nothing is left in double precision
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (k - i) * (1 - a) / ((n - k + i + 1) * a)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    total = F.aggregate(F.when(terms > 0, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>")), zero, step, lambda s: s["sum"])
    return F.when(k >= n * a, 1.0).otherwise(F.least(F.lit(1.0), top * total))


def ladder(rule: str) -> list[int]:
    """The rule's cutoff at each step."""
    cuts = RULES[rule][2]
    return cuts + cuts[-1:] * (STEPS - len(cuts))


def first_step(rule: str) -> Column:
    """The first step at which the rule rejects, STEPS where none does."""
    m = measure(rule)
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in ladder(rule)]), lambda c: c >= m))


def choose(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, price: int = PRICE) -> DataFrame:
    """stratum, n_good (its good holdouts), step (null: none is taken), k_good (good holdouts rejected at the step)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("good"))
    held = found.where("not base_failed").join(known, "doc_id")
    once = held.groupBy("stratum", "copy").agg(F.max("good").alias("good"), F.min(F.least(*[first_step(r) for r in RULES])).alias("first"))
    of = lambda good, j: F.sum(((F.col("good") == good) & (F.col("first") <= j)).cast("long"))
    sums = once.groupBy("stratum").agg(F.sum("good").cast("long").alias("n_good"), F.array(*[F.struct(F.lit(j).alias("step"), of(1, j).alias("k"), of(0, j).alias("caught")) for j in range(STEPS)]).alias("s"))
    total = F.sum("n_good").over(Window.partitionBy(F.lit(1)))  # a row for each stratum
    steps = sums.withColumn("total", total).select("stratum", "n_good", "total", F.explode("s").alias("s")).select("stratum", "n_good", "total", "s.*")
    passed = (F.col("n_good") > 0) & (binomial_tail(F.col("k"), F.col("n_good"), alpha) <= delta * F.col("n_good") / F.col("total"))
    walk = Window.partitionBy("stratum").orderBy("step")
    certified = steps.withColumn("ok", F.min(passed).over(walk)).withColumn("gain", F.when(F.col("ok"), F.col("caught") - price * F.col("k")))
    best = F.max(F.when(F.col("gain") > 0, F.struct("gain", (-F.col("step")).alias("loose"), "k")))
    return certified.groupBy("stratum", "n_good").agg(best.alias("b")).select("stratum", "n_good", (-F.col("b.loose")).alias("step"), F.col("b.k").alias("k_good"))


def apply(docs: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """One row per row of docs (doc_id, text, lang): counts, base_failed, kept, the rules that rejected it, and its
    stratum's evidence: good holdouts, the step certified (null: none) and the good holdouts rejected at it."""
    found = table(measures(docs), "measures")
    out = found.join(choose(found, labels, **limits), "stratum", "left")
    hit = {r: F.coalesce(first_step(r) <= F.col("step"), F.lit(False)) for r in RULES}
    out = out.withColumn("hits", F.filter(F.array(*[F.when(h, F.lit(r)) for r, h in hit.items()]), lambda x: x.isNotNull()))
    kept = ~F.col("base_failed") & (F.size("hits") == 0)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_capitals", "n_lines", F.array_join("hits", ",").alias("rejected_by"), F.coalesce("n_good", F.lit(0)).alias("n_good"), "step", "k_good")


def sql(alpha: float = ALPHA, delta: float = DELTA, price: int = PRICE) -> str:
    """The same in DuckDB SQL over documents and labels."""
    of = {r: f"(1000 * {t} // greatest({b}, 1))" for r, (t, b, _) in RULES.items()}
    first = {r: f"len([c for c in {ladder(r)} if c >= {m}])" for r, m in of.items()}
    hits = ", ".join(f"case when {f} <= step then '{r}' end" for r, f in first.items())
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce('=' || lang, '-') as stratum, coalesce(text, '') as t from documents),
w as (select r, doc_id, stratum, t, [x for x in regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+') if x <> ''] as ws,
  [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as ls from d),
g as (select r, i, count(*) over (partition by r, ws[i], ws[i + 1], ws[i + 2]) as c from (select r, ws, unnest(range(1, len(ws) - 1)) as i from w)),
rep as (select r, count(distinct i + o) as n from g, (values (0), (1), (2)) v(o) where c > 1 group by r),
f as (select w.r, doc_id, stratum, t, len(ws)::bigint as n_words, coalesce(list_sum([length(x) for x in ws]), 0)::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(rep.n, 0)::bigint as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals, len(ls)::bigint as n_lines
  from w left join rep using (r)),
b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from f),
known as (select doc_id, max(quality) as good from labels where quality is not null group by doc_id),
one as (select stratum, t, max(good) as good, min(least({', '.join(first.values())})) as first from b join known using (doc_id) where not base_failed group by all),
tot as (select stratum, sum(good)::bigint as n from one group by stratum),
k as (select stratum, step, n, sum(case when good = 1 and first <= step then 1 else 0 end)::bigint as k, sum(case when good = 0 and first <= step then 1 else 0 end)::bigint as caught
  from one join tot using (stratum), range({STEPS}) x(step) group by all),
p as (select k.*, case when k >= n * {alpha!r} then 1.0 else list_sum([
  exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({alpha!r}) + (n - i) * ln(1 - {alpha!r})) for i in range(0, k::bigint + 1)]) end as p from k),
c as (select *, bool_and(n > 0 and p <= {delta!r} * n / (select sum(n) from tot)) over (partition by stratum order by step) as ok, caught - {price} * k as gain from p),
best as (select stratum, arg_max(step, gain * 1000 - step) as step, arg_max(k, gain * 1000 - step) as k_good from c where ok and gain > 0 group by stratum),
f2 as (select b.*, coalesce(n, 0) as n_good, step, k_good from b left join tot using (stratum) left join best using (stratum)),
h as (select *, list_filter([{hits}], lambda x: x is not null) as hits from f2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and len(hits) = 0 as kept, n_capitals, n_lines,
  array_to_string(hits, ',') as rejected_by, n_good, step::int as step, k_good from h"""
