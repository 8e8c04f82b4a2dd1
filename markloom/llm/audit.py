"""Filter interaction audit: what five filters remove in each of their 120 orders, and whose removal it is.

A table-driven transducer reads a piece of texts as UTF-8 bytes once. Its two states are outside and inside of a
word; its tables give, for a state and a byte's class, the next state and what the step counts: a code point, a
capital, a symbol, a word's first byte, the byte after its last. The next state follows from the class alone
(checked when the tables are made), so the state before each byte is a lookup of the byte before it and a whole
piece is read by array operations. Words go by their spans into an open-addressing hash table for the piece; a span
that meets an occupied place is the same word only if document, length and bytes are (bytes are compared, eight at
once), and otherwise moves on, so counts of distinct words do not depend on hashes.

After that rows are narrow: doc_id, part, a digest of the text and four bits. Whether a text stands at a smaller
doc_id is found from counts by digest, whose partial sums are made before the shuffle, so that one text may make up
any share of the rows; per part 32 counts (one for each set of failed filters) give all 600 rows.

Null text and source count as empty. A null doc_id has no smaller one and is smaller than none. Rows that share a
doc_id are rows of their own; labels that share one count as good or toxic if any of them is. An empty table gives
no rows. Long texts stand alone in a piece; memory is some 40 bytes for each of their bytes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SEPARATORS, mix, pieces, prefix_hash, span_hash, table, utf8

LEAST_WORDS, DISTINCT, CAPITALS, SYMBOLS = 200, 50, 2, "#$%&*|"
FILTERS = "ABCDE"

OUT, IN = 0, 1
SEPARATOR, CAPITAL, SYMBOL, PLAIN, LATER, END = range(6)
POINT, UPPER, SIGN, OPEN, CLOSE = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    out = np.full(256, PLAIN, np.uint8)
    out[SEPARATORS] = SEPARATOR
    out[65:91] = CAPITAL
    out[[ord(c) for c in SYMBOLS]] = SYMBOL
    out[0x80:0xC0] = LATER
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The next state and what is counted, by state and class."""
    after, counts = np.zeros((2, 6), np.uint8), np.zeros((2, 6), np.uint8)
    for kind in (CAPITAL, SYMBOL, PLAIN, LATER):
        after[:, kind] = IN
        counts[OUT, kind] |= OPEN
    for kind in (SEPARATOR, END):
        counts[IN, kind] |= CLOSE
    for kind in (SEPARATOR, CAPITAL, SYMBOL, PLAIN):
        counts[:, kind] |= POINT
    counts[:, CAPITAL] |= UPPER
    counts[:, SYMBOL] |= SIGN
    if (after != after[OUT]).any():
        raise ValueError("the state after a byte must follow from its class alone")
    return after, counts


CLASS = _classes()
NEXT, COUNTS = _tables()


def transduce(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points, capitals and symbols of each text, and the starts and ends of all words; every text is ended by END."""
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(np.arange(rows), sizes)
    stream = np.full(len(data) + rows, END, np.uint8)
    stream[at] = CLASS[data]
    state = np.full(len(stream), OUT, np.uint8)
    state[1:] = NEXT[OUT][stream[:-1]]
    step = COUNTS[state, stream]
    ends = offsets[1:] + np.arange(1, rows + 1)
    total = lambda bit: np.diff(np.concatenate([[0], np.cumsum((step & bit) > 0)])[np.concatenate([[0], ends])])
    spot = lambda bit: np.flatnonzero(step & bit)
    back = np.arange(len(stream)) - np.repeat(np.arange(rows), sizes + 1) if rows else np.empty(0, np.int64)
    return total(POINT), total(UPPER), total(SIGN), back[spot(OPEN)], back[spot(CLOSE)]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the bytes at a[i] and b[i] are the same for lengths[i]."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    same = np.ones(len(a), bool)
    for i in np.flatnonzero(lengths > 256):
        same[i] = np.array_equal(data[a[i] : a[i] + lengths[i]], data[b[i] : b[i] + lengths[i]])
    todo = np.flatnonzero(lengths <= 256)
    for k in range(0, 256, 8):
        todo = todo[lengths[todo] > k]
        if not len(todo):
            break
        left = np.minimum(lengths[todo] - k, 8).astype(np.uint64)
        inside = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - left * np.uint64(8))
        equal = ((eight[a[todo] + k] ^ eight[b[todo] + k]) & inside) == 0
        same[todo[~equal]] = False
        todo = todo[equal]
    return same


def distinct(data: np.ndarray, row: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Which spans are the first of their row with their bytes: insertion into a hash table that compares bytes."""
    if hashes is None:
        hashes = span_hash(prefix_hash(data), starts, ends)
    lengths = ends - starts
    last = np.uint64((1 << max(4, (2 * len(starts)).bit_length())) - 1)
    place = mix(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & last
    held = np.full(int(last) + 1, -1, np.int64)
    first = np.zeros(len(starts), bool)
    todo = np.arange(len(starts))
    while len(todo):
        at = place[todo]
        free = held[at] < 0
        held[at[free][::-1]] = todo[free][::-1]
        holder = held[at]
        mine = holder == todo
        first[todo[mine]] = True
        todo, holder = todo[~mine], holder[~mine]
        alike = np.flatnonzero((row[todo] == row[holder]) & (lengths[todo] == lengths[holder]) & (hashes[todo] == hashes[holder]))
        same = alike[same_bytes(data, starts[todo[alike]], starts[holder[alike]], lengths[todo[alike]])]
        todo = np.delete(todo, same)
        place[todo] = (place[todo] + np.uint64(1)) & last
    return first


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_points, n_capitals, n_symbols, n_words, n_distinct of each text."""
    data, offsets = utf8(column)
    points, capitals, symbols, starts, ends = transduce(data, offsets)
    row = np.searchsorted(offsets, starts, "right") - 1
    first = distinct(data, row, starts, ends)
    size = len(offsets) - 1
    return {"n_points": points, "n_capitals": capitals, "n_symbols": symbols, "n_words": np.bincount(row, minlength=size), "n_distinct": np.bincount(row[first], minlength=size)}


COUNTED = "doc_id long, part string, digest binary, n_points long, n_capitals long, n_symbols long, n_words long, n_distinct long"


def counted(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): its counts and its text's digest, see COUNTED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("doc_id", "part", "digest")] + [pa.array(v, pa.int64()) for v in found.values()], ["doc_id", "part", "digest", *found])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).mapInArrow(run, COUNTED)


def failures() -> Column:
    """A to D as bits 0 to 3."""
    fails = (
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < DISTINCT * F.col("n_words"),
        100 * F.col("n_capitals") > CAPITALS * F.col("n_points"),
        F.col("n_symbols") > 0,
    )
    return sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails (bits of A to E), good, toxic, n: how many rows of docs there are of each kind."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = counted(docs).select("doc_id", "part", "digest", failures().alias("fails"))
    mark = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    kind = ["digest", "part", "fails", "good", "toxic"]
    # the join has dealt rows by doc_id, so this first sum needs no shuffle; a doc_id is then once in each kind
    once = rows.join(marks, "doc_id", "left").select("doc_id", *kind[:3], mark("good"), mark("toxic")).groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    lone = F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0))
    kinds = once.groupBy(*kind).agg(F.sum("n").alias("n"), lone.alias("lone"), F.min("doc_id").alias("least"), F.min_by(F.when(F.col("doc_id").isNotNull(), F.col("n")), "doc_id").alias("at_least"))
    # a digest has as many rows here as its text has kinds: parts and labels, never copies
    first = F.min("least").over(Window.partitionBy("digest"))
    passing = F.col("lone") + F.when(F.col("least") == first, F.col("at_least")).otherwise(0)
    two = F.array(F.struct(F.col("fails"), F.col("passing").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("passing")).alias("n")))
    return kinds.withColumn("passing", passing).select("part", "good", "toxic", F.inline(two)).where("n > 0").groupBy("part", "fails", "good", "toxic").agg(F.sum("n").alias("n"))


STEPS = [(o, k + 1, sum(1 << FILTERS.index(f) for f in o[:k]), 1 << FILTERS.index(o[k])) for o in map("".join, permutations(FILTERS)) for k in range(len(FILTERS))]
ORDERS = len(STEPS) // len(FILTERS)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    # at most 128 cells a part: 32 sets of filters, good or not, toxic or not
    parts = table(cells(docs, labels), "kinds").groupBy("part").agg(F.collect_list(F.struct("fails", "good", "toxic", "n")).alias("cells"))

    def facts(pair: Column) -> Column:
        """What follows from the filters before a filter and from the filter, as bits."""
        before, bit = pair["before"], pair["bit"]
        total = lambda value: F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + value(c))
        where = lambda holds, value: total(lambda c: F.when(holds(c["fails"]), value(c)).otherwise(0))
        has = lambda bits, of: bits.bitwiseAND(of) > 0
        here = lambda x: has(x, bit) & ~has(x, before)
        n = lambda c: c["n"]
        share = F.array(*[F.lit(0 if not k else ORDERS // k) for k in range(len(FILTERS) + 1)])
        return F.struct(
            where(lambda x: ~has(x, before.bitwiseOR(bit)), n).alias("kept"),
            where(here, n).alias("removed"),
            where(lambda x: has(x, bit) & has(x, before), n).alias("redundant"),
            where(lambda x: x == bit, n).alias("unique_fails"),
            where(here, lambda c: c["n"] * c["good"]).alias("good_lost"),
            where(here, lambda c: c["n"] * c["toxic"]).alias("toxic_lost"),
            # of a row's failures each comes first in an equal share of the orders
            where(lambda x: has(x, bit), lambda c: c["n"] * share[F.bit_count(c["fails"])]).alias("shapley"),
        )

    pairs = sorted({(before, bit) for _, _, before, bit in STEPS})
    literal = F.expr("array(" + ", ".join(f"named_struct('before', {before}, 'bit', {bit})" for before, bit in pairs) + ")")
    order = F.expr("array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'at', {pairs.index((before, bit)) + 1})" for o, k, before, bit in STEPS) + ")")
    each = parts.select("part", F.transform(literal, facts).alias("facts")).select("part", "facts", F.explode(order).alias("o"))
    return each.select("part", "o.filter_order", "o.step", F.element_at("facts", F.col("o.at")).alias("f")).select("part", "filter_order", "step", "f.*")


def sql() -> str:
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    letters = ", ".join(f"('{f}', {1 << k})" for k, f in enumerate(FILTERS))
    return rf"""with l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, {words} as w from documents),
e as (select *, min(doc_id) over (partition by text) as least from d),
k as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic, (len(w) < {LEAST_WORDS})::int + 2 * (100 * len(list_distinct(w)) < {DISTINCT} * len(w))::int
+ 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {CAPITALS} * length(text))::int + 8 * regexp_matches(text, '[{SYMBOLS}]')::int + 16 * coalesce(e.doc_id > least, false)::int as fails from e left join l on e.doc_id = l.doc_id),
f as (select * from (values {letters}) v(f, bit)),
o as (select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, (select unnest(range(1, 6))::int as step)),
c as (select part, good, toxic, fails, count(*) as n from k group by all),
r as (select part, filter_order, step, bit, sum(case when fails & (before | bit) = 0 then n else 0 end) as kept, sum(case when fails & bit > 0 and fails & before = 0 then n else 0 end) as removed,
sum(case when fails & bit > 0 and fails & before > 0 then n else 0 end) as redundant, sum(case when fails = bit then n else 0 end) as unique_fails,
sum(case when fails & bit > 0 and fails & before = 0 then n * good else 0 end) as good_lost, sum(case when fails & bit > 0 and fails & before = 0 then n * toxic else 0 end) as toxic_lost from c, s group by part, filter_order, step, bit)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
(sum(removed) over (partition by part, bit))::bigint as shapley from r"""
