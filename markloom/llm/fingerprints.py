"""Document fingerprints by one-permutation MinHash.

The hash of each 5-word shingle (A-Z lowered; fewer words: all of them as one) is drawn once; its top bits
choose a bin and each bin keeps its least hash. Empty bins are filled by optimal densification: bin i asks
the bins in an order of its own, fixed by a hash, until one was not empty. Of every bin the low bits are packed; the
share m of equal entries then estimates likeness as (m - 2**-b) / (1 - 2**-b), which takes away chance matches.

Null and empty texts and texts without words have the empty fingerprint; two of those are alike (1), one of
them and any other is not (0). Equal texts have equal fingerprints. Repeated rows and ties in doc_id are
ordered by a hash of the text; a null doc_id comes first. A text of any length is whole in one row. Other columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, mix, prefix_hash, ragged, span_hash, utf8, words

BINS, BITS, SHINGLE = 512, 4, 5
ROWS = 2000  # that a task compares at once at most, as each has bins whatever its length
_STEP = 0x9E3779B97F4A7C15
_NONE = np.uint64(2**64 - 1)
#: _ORDER[i, j]: how many bins an empty bin i asks before bin j.
_ORDER = np.argsort(np.argsort(mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1), axis=1).astype(np.int16)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, in order and with repeats, and where each text's start."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = span_hash(prefix_hash(data), starts, ends)
    n_words = np.diff(first)
    counts = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    at = ragged(first[:-1], counts)
    stop = np.repeat(first[1:], counts)
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        here = at + j
        inside = here < stop
        total += np.where(inside, mix(h[np.minimum(here, max(len(h) - 1, 0))] + np.uint64(_STEP * (j + 1) & 2**64 - 1)), np.uint64(0)) if len(h) else np.uint64(0)
    return mix(total), np.concatenate([[0], np.cumsum(counts)])


def fingerprints(column: pa.Array) -> np.ndarray:
    """Low bits of each bin, rows of BINS bytes; a text without shingles has 255 everywhere."""
    h, at = shingles(column)
    if len(column) > ROWS:
        return np.concatenate([_binned(h[at[k] : at[min(k + ROWS, len(column))]], at[k : k + ROWS + 1] - at[k]) for k in range(0, len(column), ROWS)])
    return _binned(h, at)


def _binned(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    least = np.full(n * BINS, _NONE, np.uint64)
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    row = np.repeat(np.arange(n), np.diff(at))
    np.minimum.at(least, row * BINS + (h >> shift).astype(np.int64), h)
    least = least.reshape(n, BINS)
    full = least != _NONE
    some = full.any(axis=1)
    for r in np.flatnonzero(some & ~full.all(axis=1)):
        there, empty = np.flatnonzero(full[r]), np.flatnonzero(~full[r])
        least[r, empty] = least[r, there[_ORDER[empty][:, there].argmin(axis=1)]]
    out = ((least >> np.uint64(17)) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    out[~some] = 255
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    same = ((a == b).mean(axis=1) - chance) / (1 - chance)
    none_a, none_b = a[:, 0] == 255, b[:, 0] == 255
    return np.where(none_a | none_b, (none_a & none_b).astype(float), np.clip(same, 0, 1))


def packed(prints: np.ndarray) -> list[str]:
    """BITS bits of each bin, as hex digits."""
    bits = np.unpackbits((prints << (8 - BITS)).astype(np.uint8)[:, :, None], axis=2)[:, :, :BITS]
    rows = np.packbits(bits.reshape(len(prints), -1), axis=1)
    return ["" if p[0] == 255 else r.tobytes().hex() for p, r in zip(prints, rows)]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import pieces

        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed(fingerprints(batch.column("text"))), pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _bounds(docs: DataFrame, parts: int) -> tuple[np.ndarray, dict[int, int]]:
    """Shard bounds on doc_id (at most one for each partition), and each shard's least doc_id."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"))
    marks = [(i + 1) / parts for i in range(parts - 1)] or [0.5]
    row = ids.agg(F.percentile_approx("d", marks, 10_000).alias("b")).first()
    bounds = np.unique(np.array(row["b"] or [], np.int64))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            d = batch.column("d").to_numpy()
            shard = np.searchsorted(bounds, d)
            for s in np.unique(shard).tolist():
                found[s] = min(found.get(s, 2**63 - 1), int(d[shard == s].min()))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["shard", "d"])

    firsts = ids.mapInArrow(least, "shard long, d long").groupBy("shard").agg(F.min("d").alias("d"))
    return bounds, {r["shard"]: r["d"] for r in firsts.collect()}


def _deal(bounds: np.ndarray, firsts: dict[int, int]):
    """Each row to its shard, and a shard's first rows also behind the shard before it (in a circle)."""
    shards = sorted(firsts)
    before = {firsts[s]: shards[i - 1] for i, s in enumerate(shards)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = []
            for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                key, body = -(2**63) if d is None else d, (text or "").encode()
                tie, z = hashlib.blake2b(body, digest_size=8).digest(), pack.compress(body)
                rows.append((int(np.searchsorted(bounds, key)), False, d, tie, z))
                if key in before:
                    rows.append((before[key], True, d, tie, z))
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["shard", "halo", "doc_id", "tie", "z"])

    return run


def _compare(items: list[tuple[int | None, str]], after: str) -> pa.RecordBatch:
    texts = [t for _, t in items]
    nexts = [*texts[1:], after]
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, nexts)]
    own = fingerprints(pa.array([*texts, after], pa.large_string()))
    changed = fingerprints(pa.array(edited, pa.large_string()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in items], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array(packed(own[:-1]), pa.string()),
            pa.array(packed(changed), pa.string()),
            pa.array(likeness(own[:-1], changed)),
            pa.array(likeness(own[:-1], own[1:])),
        ],
        [c.split()[0] for c in RESULT.split(", ")],
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    items: list[tuple[int | None, str]] = []
    shard, closed, size = None, False, 0
    for batch in batches:
        for s, halo, d, z in zip(*(batch.column(c).to_pylist() for c in ("shard", "halo", "doc_id", "z"))):
            if s != shard:
                shard, closed = s, False
            if closed:
                continue
            text = unpack.decompress(z).decode()
            if halo:
                yield _compare(items, text)
                items, size, closed = [], 0, True
                continue
            if size > 1_000_000 or len(items) >= ROWS:
                yield _compare(items, text)
                items, size = [], 0
            items.append((d, text))
            size += len(text)


def compare(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, its edited text's (the last quarter taken from the next document) and both likenesses."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds, firsts = _bounds(docs, parts)
    dealt = docs.mapInArrow(_deal(bounds, firsts), "shard long, halo boolean, doc_id long, tie binary, z binary")
    return dealt.repartitionById(parts, F.col("shard").cast("int")).sortWithinPartitions("shard", "halo", "doc_id", "tie").mapInArrow(_neighbours, RESULT)
