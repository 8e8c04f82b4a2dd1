"""A hierarchical Pitman-Yor language model of words.

A word (A-Z lowered) is drawn in the restaurant of the word before it. All these restaurants share one parent, the
restaurant of single words, whose own parent is a uniform choice of the V known words and one unknown. Customers of
a restaurant sit at tables of their dish, and every table sends one customer to the parent. Words are told apart by
their bytes and contexts by whole words, so restaurants grow with the data.

Seating: a sweep draws the number of tables of each dish in each restaurant from its conditional given all others,
with generalised Stirling numbers up to `EXACT` customers and beyond by `STEPS` Metropolis steps, the Stirling numbers
taken at their saddle point (an approximation, best where tables are many). Dishes of a sweep see the other dishes as the sweep before has left them, as is usual
where sampling is spread over machines. After `BURN` sweeps `SAMPLES` seatings are kept and their predictive
probabilities averaged. Discounts come from the counts of counts of all data, n1 / (n1 + 2 n2), kept within
`LIMITS`; strengths are fixed (`STRENGTH`).

How it is spread: texts are cut into pieces of at most `PIECE` bytes; each piece sends its distinct words to buckets
by hash, which number them by frequency, and then its distinct pairs (word, word before) to the buckets of the words.
A bucket holds all pairs of its words. What pairs need from other buckets are the tables and customers of their
contexts; these are added up exactly, in groups of contexts, after each sweep and answered to the buckets that asked.
Every bucket then prices each piece's pairs, and each piece adds up its texts. The number of buckets follows the
bytes of text: results depend on the data alone. A frequent word's tokens are counted in each piece before anything moves, and
its pairs are as many as the words found before it.

The end is a token; it is also the context of a text's first word. Null and empty texts have the end alone. Training
takes the rows whose crc32 of doc_id (as text) modulo 7 is not 2; a null doc_id trains. Without training rows every
probability is 1. Rows are independent; repeated rows train repeatedly and get equal scores. An empty table gives an
empty result; a text of any length is whole in one piece. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, drop, pack, pieces, prefix_hash, span_hash, table, tables, take_spans, unpack, utf8, words

BURN, SAMPLES, EXACT, STEPS = 4, 4, 256, 6
STRENGTH, LIMITS = (20.0, 2.0), (0.1, 0.95)  # strengths of the restaurant of single words and of those below it
PIECE, PER_BUCKET = 4_000_000, 1 << 25
ROW = "bucket long, kind long, body binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def buckets(n_bytes: int) -> int:
    """As many buckets as keep both the messages between pieces and buckets and a bucket's pairs few."""
    tokens = n_bytes / 6
    return max(4, int(np.ceil(max((tokens / (1 << 15)) ** 0.5, tokens / PER_BUCKET))))


# Numbers of tables.


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function for x > 0."""
    x = np.asarray(x, float)
    shift = np.zeros(x.shape)
    for _ in range(8):
        low = x < 8
        shift = np.where(low, shift + np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x - shift


@lru_cache(maxsize=8)
def stirling(d: float, n: int) -> np.ndarray:
    """Logs of generalised Stirling numbers for up to n customers: [customers, tables]."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[1, 1] = 0
    for c in range(1, n):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, out[c, t] + np.log(np.maximum(c - t * d, 1e-300)), -np.inf)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, t - 1], stay)
    return out


def stirling_far(d: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The same for many customers c, from the saddle point of their generating function ((1 - (1 - z)**d) / d)**t."""
    c, t = np.asarray(c, float), np.minimum(np.asarray(t, float), np.asarray(c, float) - 1)
    low, high = np.full(c.shape, -60.0), np.full(c.shape, -1e-12)  # of log(1 - z)
    for _ in range(50):
        middle = (low + high) / 2
        y = np.exp(middle)
        many = t * d * (1 - y) * np.exp((d - 1) * middle) / -np.expm1(d * middle) > c
        low, high = np.where(many, middle, low), np.where(many, high, middle)
    ly = (low + high) / 2
    y = np.exp(ly)
    z = -np.expm1(ly)
    bend = np.maximum(c * (1 + z * (1 - d) / y - c / t), 1e-9)
    return log_gamma(c + 1) - log_gamma(t + 1) - t * np.log(d) + t * np.log(-np.expm1(d * ly)) - c * np.log(z) - 0.5 * np.log(2 * np.pi * bend)


class Pull:
    """Weights of a dish's tables: the restaurant's (theta + d (others + i)) times the parent's probability of the dish,
    (own + i) / (all + i), where a parent without the dish gives `new` / all to the first and goes on from 1 - discount."""

    def __init__(self, others: np.ndarray, theta: float, d: float, own: np.ndarray, new: np.ndarray, total: np.ndarray, above: float):
        self.start, self.d = theta / d + others, d
        self.none = own <= 0
        self.new, self.total = np.maximum(new, 1e-300), np.maximum(total, 1e-300)
        self.own = np.where(self.none, 1 - above + self.new, own + self.new)

    def take(self, rows: np.ndarray) -> Pull:
        out = object.__new__(Pull)
        out.d = self.d
        for name in ("start", "none", "new", "total", "own"):
            setattr(out, name, getattr(self, name)[rows])
        return out

    def upto(self, k: int) -> np.ndarray:
        """Log weights of 1..k tables, a row for each dish."""
        i = np.arange(k)
        own = self.own[:, None] + i - self.none[:, None]
        own[:, 0] = np.where(self.none, self.new, own[:, 0])
        return np.cumsum(np.log(self.d * (self.start[:, None] + i) * own / (self.total[:, None] + i)), axis=1)

    def at(self, t: np.ndarray) -> np.ndarray:
        """Log weight of t tables of each dish."""
        first = np.where(self.none, np.log(self.new), 0.0)
        more = t - self.none
        return t * np.log(self.d) + log_gamma(self.start + t) - log_gamma(self.start) + first + log_gamma(self.own + more) - log_gamma(self.own) - log_gamma(self.total + t) + log_gamma(self.total)


def seat(c: np.ndarray, t: np.ndarray, pull: Pull, known: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables for dishes of c customers, t tables now."""
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    edge = np.searchsorted(c[order], np.arange(2, EXACT + 2))
    for k in range(2, EXACT + 1):
        group = order[edge[k - 2] : edge[k - 1]]
        for rows in np.array_split(group, max(1, len(group) * k // 2_000_000)):
            if len(rows):
                w = known[k, 1 : k + 1] + pull.take(rows).upto(k)
                w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
                out[rows] = 1 + (w < rng.random((len(rows), 1)) * w[:, -1:]).sum(axis=1)
    rows = order[edge[-1] :]
    if len(rows):
        many, now, of = c[rows], np.minimum(t[rows], c[rows] - 1), pull.take(rows)
        value = stirling_far(of.d, many, now) + of.at(now)
        for _ in range(STEPS):
            width = np.maximum(1, np.sqrt(now)).astype(np.int64)
            to = now + np.rint(rng.normal(size=len(rows)) * width).astype(np.int64)
            back = np.maximum(1, np.sqrt(np.maximum(to, 1))).astype(np.int64)
            fit = (to >= 1) & (to < many)
            to = np.where(fit, to, now)
            found = stirling_far(of.d, many, to) + of.at(to)
            step = (to - now).astype(float)
            turn = 0.5 * (step / width) ** 2 - 0.5 * (step / back) ** 2 + np.log(width / back)  # steps are wider where tables are many
            go = fit & (np.log(rng.random(len(rows))) < found - value + turn)
            now, value = np.where(go, to, now), np.where(go, found, value)
        out[rows] = now
    return out


def discount(once: int, twice: int) -> float:
    return float(np.clip(once / (once + 2 * twice), *LIMITS)) if once else LIMITS[0]


class Level:
    """One sweep's view of the restaurant of single words: all its customers and tables, the known words, discounts."""

    def __init__(self, customers: int, tables: int, v: int, d: tuple[float, float]):
        self.customers, self.tables, self.v, self.d = customers, tables, v, d

    def new(self, tables: float | np.ndarray) -> float | np.ndarray:
        """Weight of a new table of one given word, beside `tables` tables."""
        return (STRENGTH[0] + self.d[0] * tables) / (self.v + 1)

    def single(self, c0: np.ndarray, t0: np.ndarray) -> np.ndarray:
        """Probability of words that have c0 customers at t0 tables."""
        return (c0 - self.d[0] * t0 + self.new(self.tables)) / (STRENGTH[0] + self.customers)

    def paired(self, c: np.ndarray, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, p0: np.ndarray) -> np.ndarray:
        """Probability of words after contexts: c customers at t tables, of all that the context has."""
        return (c - self.d[1] * t + (STRENGTH[1] + self.d[1] * tables) * p0) / (STRENGTH[1] + customers)

    def sweep(self, up: np.ndarray, c: np.ndarray, t: np.ndarray, tables: np.ndarray, ones: np.ndarray, t0: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """New numbers of tables of pairs (of word up, c customers, t tables, in restaurants of so many tables) and words.

        ones: each word's pairs of one customer, which have one table each.
        """
        c0 = ones + np.bincount(up, weights=t, minlength=len(ones)).astype(np.int64)
        left = c0[up] - t
        t0_left = np.minimum(t0[up], left)
        new = np.broadcast_to(self.new(self.tables), len(c))
        pull = Pull(tables - t, STRENGTH[1], self.d[1], left - self.d[0] * t0_left, new, STRENGTH[0] + self.customers - t, self.d[0])
        t = seat(c, t, pull, stirling(self.d[1], EXACT), rng)
        c0 = ones + np.bincount(up, weights=t, minlength=len(ones)).astype(np.int64)
        base = _Flat(self.tables - t0, STRENGTH[0], self.d[0], 1 / (self.v + 1))
        return t, seat(c0, np.minimum(t0, c0), base, stirling(self.d[0], EXACT), rng)


class _Flat(Pull):
    """Weights of tables under a parent whose probability of every dish is p."""

    def __init__(self, others: np.ndarray, theta: float, d: float, p: float):
        self.start, self.d, self.p = theta / d + others, d, p

    def take(self, rows: np.ndarray) -> _Flat:
        out = object.__new__(_Flat)
        out.start, out.d, out.p = self.start[rows], self.d, self.p
        return out

    def upto(self, k: int) -> np.ndarray:
        return np.cumsum(np.log(self.d * self.p * (self.start[:, None] + np.arange(k))), axis=1)

    def at(self, t: np.ndarray) -> np.ndarray:
        return t * np.log(self.d * self.p) + log_gamma(self.start + t) - log_gamma(self.start)


# Texts to numbered words and pairs.


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    b, k, body = zip(*rows) if rows else ([], [], [])
    return pa.table([pa.array(b, pa.int64()), pa.array(k, pa.int64()), pa.array(body, pa.binary())], ["bucket", "kind", "body"])


def _ranges(cut: np.ndarray) -> list[tuple[int, slice]]:
    return [(int(k), slice(int(cut[k]), int(cut[k + 1]))) for k in np.flatnonzero(np.diff(cut))]


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers as the narrowest signed kind that holds them."""
    top = int(np.abs(x).max(initial=0))
    return x.astype(np.int8 if top < 1 << 7 else np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _cut(n: int):
    """Texts as rows (-1, piece, tokens and the like) and their distinct words as (bucket, piece, words, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, limit=PIECE):
            data, offsets = utf8(batch.column("text"))
            data = LOWER[data]
            starts, ends, first = words(data, offsets)
            met = take_spans(data, starts, ends).dictionary_encode()
            names = pa.concat_arrays([pa.array([b""], pa.large_binary()), met.dictionary.cast(pa.large_binary())])
            at = first + np.arange(len(offsets))
            stream = np.zeros(at[-1], np.int32)
            inner = np.ones(at[-1], bool)
            inner[at[1:] - 1] = False
            stream[inner] = met.indices.to_numpy() + 1
            held, ids = batch.column("held_out").to_numpy(zero_copy_only=False), batch.column("doc_id")
            counts = np.bincount(stream, weights=np.repeat(~held, np.diff(at)), minlength=len(names)).astype(np.int64)
            raw, cuts = utf8(names)
            bucket = (span_hash(prefix_hash(raw), cuts[:-1], cuts[1:]) % np.uint64(n)).astype(np.int64)
            place = pc.sort_indices(names).to_numpy()
            order = place[np.argsort(bucket[place], kind="stable")]
            local = np.empty(len(order), np.int32)
            local[order] = np.arange(len(order))
            text = pack(local[stream], np.diff(at).astype(np.int32), held, np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.array([local[0]]))
            rows = [(-1, piece, text)]
            for b, s in _ranges(np.searchsorted(bucket[order], np.arange(n + 1))):
                some = names.take(pa.array(order[s]))
                raw, cuts = utf8(some)
                rows.append((b, piece, pack(raw, _small(np.diff(cuts)), _small(counts[order[s]]))))
            yield _rows(rows).combine_chunks().to_batches()[0]
            piece += 1

    return run


def _named(n: int):
    """Numbers of a bucket's words, by falling counts: to each piece those of its words and their counts."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        parts = [unpack(b) for b in group.column("body").to_pylist()]
        lists = []
        for raw, sizes, _ in parts:
            cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            lists.append(pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(raw.tobytes())]))
        met = pa.concat_arrays(lists).dictionary_encode()
        where = met.indices.to_numpy()
        totals = np.bincount(where, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
        place = pc.sort_indices(met.dictionary).to_numpy()
        order = place[np.argsort(-totals[place], kind="stable")]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order)) * n + bucket
        out, end = [], 0
        for piece, p in zip(group.column("kind").to_pylist(), parts):
            own = where[end : end + len(p[1])]
            out.append((bucket, piece, pack(_small(number[own]), _small(totals[own]))))
            end += len(p[1])
        known = np.array([totals.sum(), (totals > 0).sum()])
        return _rows([*out, (bucket, -1, pack(known))])

    return run


def _asked(n: int):
    """A piece's texts as places among its pairs, with what their words' counts say; its pairs, to the words' buckets."""

    def run(group: pa.Table) -> pa.Table:
        piece = group.column("kind")[0].as_py()
        found = dict(zip(group.column("bucket").to_pylist(), group.column("body").to_pylist()))
        stream, sizes, held, ids, none, end = unpack(found.pop(-1))
        words_of = [unpack(found[b]) for b in sorted(found)]
        number, count = (np.concatenate([w[k].astype(np.int64) for w in words_of]) for k in (0, 1))
        by_word, by_number = np.lexsort((number, number % n)), np.argsort(number)
        rank, rank_before = np.empty(len(number), np.int64), np.empty(len(number), np.int64)
        rank[by_word] = rank_before[by_number] = np.arange(len(number))
        before = np.concatenate([end, stream[:-1]])
        pairs, place = np.unique(rank[stream] << 32 | rank_before[before], return_inverse=True)
        train = np.bincount(place, weights=np.repeat(~held, sizes), minlength=len(pairs)).astype(np.int64)
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
        known, logs = np.add.reduceat((count[stream] > 0).astype(np.int64), at), np.add.reduceat(np.log10(count[stream] + 1.0), at)
        rows = [(-1, piece, pack(_small(place), sizes, held, ids, none, known, logs))]
        word, context = number[by_word][pairs >> 32], number[by_number][pairs & 0xFFFFFFFF]
        for b, s in _ranges(np.searchsorted(word % n, np.arange(n + 1))):
            own, runs = np.unique(word[s] // n, return_counts=True)
            rows.append((b, piece, pack(own.astype(np.uint64), _small(runs), context[s].astype(np.uint64), _small(train[s]))))
        return _rows(rows)

    return run


# A bucket's pairs: kind 0 holds all of them, 1 their seating, 2 and up are messages to groups of contexts, below 0
# answers, and from ASKED on the places of a piece's pairs among them.
ASKED = 1 << 62


def _to_groups(bucket: int, contexts: np.ndarray, n: int, want: np.ndarray, *values: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Shares of the values of distinct contexts, one message to each group of contexts."""
    group = contexts % n
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(n + 1))
    return [(bucket, 2 + g, pack((contexts[i] // n).astype(np.uint64), want[i], *[_small(v[i]) for v in values])) for g, s in _ranges(cut) for i in [order[s]]]


def _met(group: pa.Table) -> pa.Table:
    """Sums of a group's contexts over all buckets, for each bucket's contexts that it wants."""
    kind = group.column("kind")[0].as_py()
    parts = [unpack(b) for b in group.column("body").to_pylist()]
    one, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    totals = [np.bincount(where, weights=np.concatenate([p[k] for p in parts]), minlength=len(one)).astype(np.int64) for k in range(2, len(parts[0]))]
    ends = np.cumsum([len(p[0]) for p in parts])
    return _rows([(b, 1 - kind, pack(*[_small(t[where[end - len(p[0]) : end][p[1]]]) for t in totals])) for b, p, end in zip(group.column("bucket").to_pylist(), parts, ends)])


def _answers(found: dict[int, bytes], contexts: np.ndarray, n: int) -> list[np.ndarray]:
    """What the groups have answered about the contexts, in their order."""
    answers = [unpack(found[k]) for k in sorted((k for k in found if k < 0), reverse=True)]
    order = np.argsort(contexts % n, kind="stable")
    out = []
    for x in zip(*answers):
        values = np.empty(len(contexts), np.int64)
        values[order] = np.concatenate(x)
        out.append(values)
    return out


def _opened(n: int):
    """A bucket's pairs with their counts over all pieces, and one table for each that has customers.

    Only pairs of two customers or more can change; of the others each word's number is kept.
    """

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        parts = [unpack(b) for b in group.column("body").to_pylist()]
        word = np.concatenate([np.repeat(p[0], p[1]) for p in parts]).astype(np.int64)
        contexts, before = np.unique(np.concatenate([p[2] for p in parts]), return_inverse=True)
        pairs, where = np.unique(word << 32 | before, return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([p[3] for p in parts])).astype(np.int64)
        ends = np.cumsum([len(p[2]) for p in parts])
        asks = [(bucket, ASKED + k, pack(where[end - len(p[2]) : end].astype(np.uint64))) for k, p, end in zip(group.column("kind").to_pylist(), parts, ends)]
        word, before = pairs >> 32, contexts.astype(np.int64)[pairs & 0xFFFFFFFF]
        own, runs = np.unique(word, return_counts=True)
        rows = [(bucket, 0, pack(own.astype(np.uint64), _small(runs), before.astype(np.uint64), _small(counts)))]
        train = counts > 0
        word, before, counts = word[train], before[train], counts[train]
        up = np.unique(word, return_inverse=True)[1]
        many = counts > 1
        ones = np.bincount(up[~many], minlength=int(up.max(initial=-1)) + 1)
        mine, at = np.unique(before[many], return_inverse=True)
        c0 = np.bincount(up, minlength=len(ones))
        sums = np.array([c0.sum(), len(ones), (counts == 1).sum(), (counts == 2).sum(), (c0 == 1).sum(), (c0 == 2).sum()], np.int64)
        state = pack(_small(ones), _small(up[many]), _small(at), _small(counts[many]), mine.astype(np.uint64), np.zeros(len(mine), np.int8), np.ones(int(many.sum()), np.int8), np.ones(len(ones), np.int8))
        rows += [*asks, (bucket, 1, state), (bucket, -1, pack(sums))]
        some, times = np.unique(before, return_counts=True)
        return _rows(rows + _to_groups(bucket, some, n, np.isin(some, mine), times))

    return run


def _swept(sweep: int, n: int, level: Level):
    """One sweep of a bucket, given the sums over all; of the last sweeps the seatings are kept behind the present one."""

    def run(group: pa.Table) -> pa.Table:
        bucket, found = group.column("bucket")[0].as_py(), dict(zip(group.column("kind").to_pylist(), group.column("body").to_pylist()))
        ones, up, at, counts, mine, outer, t, t0, *kept = unpack(found[1])
        mine, change = mine.astype(np.int64), _answers(found, mine.astype(np.int64), n)
        outer = outer.astype(np.int64) + (change[0] if change else 0)
        rng = np.random.default_rng([bucket, sweep])
        args = [x.astype(np.int64) for x in (up, counts, t)]
        new, new0 = level.sweep(*args, outer[at], ones.astype(np.int64), t0.astype(np.int64), rng)
        if sweep >= BURN:
            kept += [_small(new), _small(new0)]
        sums = np.array([ones.sum() + new.sum(), new0.sum()], np.int64)
        state = pack(ones, up, at, counts, mine.astype(np.uint64), _small(outer), _small(new), _small(new0), *kept)
        shift = np.bincount(at, weights=new - args[2], minlength=len(mine)).astype(np.int64)
        return _rows([(bucket, 1, state), (bucket, -1, pack(sums)), *_to_groups(bucket, mine, n, np.ones(len(mine), bool), shift)])

    return run


def _seatings(static: list[np.ndarray], state: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tables of all pairs and of all words (0 where none trains) in each kept seating."""
    runs, counts = static[1], static[3]
    known = np.add.reduceat(counts > 0, np.cumsum(runs) - runs) > 0
    out = []
    for s in range(SAMPLES):
        t, t0 = np.minimum(counts, 1).astype(np.int64), np.zeros(len(runs), np.int64)
        t[counts > 1], t0[known] = state[8 + 2 * s], state[9 + 2 * s]
        out.append((t, t0))
    return out


def _closed(n: int):
    """All contexts of a bucket's pairs, with its share of their customers and of their tables in each kept seating."""

    def run(group: pa.Table) -> pa.Table:
        bucket, found = group.column("bucket")[0].as_py(), dict(zip(group.column("kind").to_pylist(), group.column("body").to_pylist()))
        static = unpack(found[0])
        contexts, at = np.unique(static[2].astype(np.int64), return_inverse=True)
        shares = [np.bincount(at, weights=x, minlength=len(contexts)).astype(np.int64) for x in (static[3], *(t for t, _ in _seatings(static, unpack(found[1]))))]
        return _rows(_to_groups(bucket, contexts, n, np.ones(len(contexts), bool), *shares))

    return run


def _priced(n: int, levels: list[Level]):
    """Log10 probabilities of a bucket's pairs, to each piece those of the pairs it has asked for."""

    def run(group: pa.Table) -> pa.Table:
        bucket, found = group.column("bucket")[0].as_py(), dict(zip(group.column("kind").to_pylist(), group.column("body").to_pylist()))
        own, runs, before, counts = static = unpack(found[0])
        contexts, at = np.unique(before.astype(np.int64), return_inverse=True)
        customers, *outer = _answers(found, contexts, n)
        up = np.repeat(np.arange(len(own)), runs)
        p = np.zeros(len(counts))
        for level, tables, (t, t0) in zip(levels, outer, _seatings(static, unpack(found[1]))):
            p0 = level.single(np.bincount(up, weights=t, minlength=len(own)), t0)
            p += level.paired(counts, t, customers[at], tables[at], p0[up])
        logs = np.log10(p / len(levels)).astype(np.float32)
        return _rows([(bucket, k - ASKED, pack(logs[unpack(body)[0]])) for k, body in found.items() if k >= ASKED])

    return run


def _scored(n_train: int, v: int):
    names, kinds = zip(*[(c.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]]) for c in RESULT.split(", ")])

    def run(group: pa.Table) -> pa.Table:
        found = dict(zip(group.column("bucket").to_pylist(), group.column("body").to_pylist()))
        place, sizes, held, ids, none, known, logs = unpack(found.pop(-1))
        price = np.concatenate([unpack(found[b])[0] for b in sorted(found)]).astype(np.float64)
        at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[:-1]
        score, base = np.add.reduceat(price[place], at), logs - sizes * np.log10(n_train + v + 1)
        columns = [pa.array(ids, mask=none), pa.array(held), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(np.full(len(ids), n_train)), pa.array(base), pa.array(score)]
        return pa.table([c.cast(k) for c, k in zip(columns, kinds)], list(names))

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bodies = [unpack(x)[0].astype(np.int64) for batch in batches for x in batch.column("body").to_pylist()]
    if bodies:
        yield _rows([(0, 0, pack(np.sum(bodies, axis=0)))]).to_batches()[0]


def totals(rows: DataFrame) -> list[int]:
    """Sums over all buckets of a few whole numbers each; a row for each partition comes to the driver."""
    found = [unpack(r["body"])[0] for r in rows.select("body").mapInArrow(_added, ROW).collect()]
    return [int(x) for x in np.sum(found, axis=0)] if found else []


def score(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), see RESULT; log10 probabilities of whole texts."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    n = buckets(docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0)
    cut = table(docs.mapInArrow(_cut(n), ROW), "cut", "none")
    named = table(cut.where("bucket >= 0").groupBy("bucket").applyInArrow(_named(n), ROW), "named", "none")
    n_train, v = totals(named.where("kind = -1")) or (0, 0)
    met = cut.where("bucket = -1").unionAll(named.where("kind >= 0"))
    texts, pairs = tables(met.groupBy("kind").applyInArrow(_asked(n), ROW), "asked", {"texts": F.col("bucket") < 0, "pairs": F.lit(True)}, "none")
    drop(cut, named)
    parts = {"static": F.col("kind") == 0, "asks": F.col("kind") >= ASKED, "state": F.lit(True)}
    static, asks, state = tables(pairs.groupBy("bucket").applyInArrow(_opened(n), ROW), "pairs", parts, "none")
    drop(pairs)
    customers, seated, *of_counts = totals(state.where("kind = -1")) or [0] * 6
    d = discount(*of_counts[2:]), discount(*of_counts[:2])
    levels = [Level(customers, seated, v, d)]
    for sweep in range(BURN + SAMPLES):
        answers = state.where("kind > 1").groupBy("kind").applyInArrow(_met, ROW)
        now = table(state.where("kind = 1").unionAll(answers).groupBy("bucket").applyInArrow(_swept(sweep, n, levels[-1]), ROW), "seating", "none")
        drop(state)
        state = now
        levels.append(Level(*(totals(state.where("kind = -1")) or [0, 0]), v, d))
    kept = static.unionAll(state.where("kind = 1"))
    answers = table(kept.groupBy("bucket").applyInArrow(_closed(n), ROW).groupBy("kind").applyInArrow(_met, ROW), "closed", "none")
    model = kept.unionAll(answers).unionAll(asks)
    prices = table(model.groupBy("bucket").applyInArrow(_priced(n, levels[-SAMPLES:]), ROW), "prices", "none")
    drop(static, state, answers, asks)
    return texts.unionAll(prices).groupBy("kind").applyInArrow(_scored(n_train, v), RESULT)
