"""Shared pieces: shared-folder tables, Arrow batches as byte arrays, words and their hashes.

Words are maximal runs of characters other than space and \\t..\\r. Word hashes are 64-bit polynomial
hashes of the word's bytes, mixed; two different words get the same hash with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; where it is unset, in local mode, one under the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    return base.rstrip("/")


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts lineage: writes df as Parquet to the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def tables(df: DataFrame, name: str, parts: dict[str, Column], codec: str = "zstd") -> list[DataFrame]:
    """The same for several tables made in one pass: rows go to the first part whose condition they meet."""
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    part = F.coalesce(*[F.when(c, F.lit(k)) for k, c in parts.items()])
    df.withColumn("_part", part).write.partitionBy("_part").option("compression", codec).parquet(path)
    out = []
    for k in parts:
        _written.append(f"{path}/_part={k}")
        there = spark._jvm.org.apache.hadoop.fs.Path(_written[-1])
        some = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
        out.append(spark.read.schema(df.schema).parquet(_written[-1]) if some else spark.createDataFrame([], df.schema))
        out[-1].folder = _written[-1]
    return out


NULL_ID = -(2**63)


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """d, c, text of docs (doc_id, text), none of them null, and, if asked for, the other columns in a struct `row`.

    Rows are told apart by d and c.

    d is the doc_id, the least number for null. c is 0 where the doc_id is the row's own, and else a 64-bit hash of
    the text, so that only rows that share both doc_id and text are one.
    """
    key, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    own = docs.select(key.alias("d")).where("d is not null").groupBy("d").count().where("count > 1").isEmpty()
    c = F.when(key.isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(text)) if own else F.xxhash64(text)
    return docs.select(F.coalesce(key, F.lit(NULL_ID)).alias("d"), c.alias("c"), text.alias("text"), *([F.struct(*[docs[f"`{n}`"] for n in docs.columns if n != "text"]).alias("row")] if whole else []))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that clear_tables() will remove."""
    _written.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop(*some: DataFrame) -> None:
    """Removes tables made here that nothing will read again, and lets Spark clean up shuffles out of use."""
    spark = SparkSession.active()
    for t in some:
        if t.folder in _written:
            _written.remove(t.folder)
            _delete(spark, t.folder)
    gc.collect()
    spark._jvm.System.gc()


def clear_tables(spark: SparkSession) -> None:
    """Removes what table() has written from this process; results that read it can no longer be computed."""
    while _written:
        _delete(spark, _written.pop())


def release() -> None:
    """Gives memory that is free inside this worker back to the machine, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not with every C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that column has at most limit bytes in each; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size.astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, end - start)
            start = end
    release()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row starts; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.ones(1, np.uint64)
            step = base
            while len(a) < size:
                a = np.concatenate([a, a * np.uint64(step)])
                step = step * step & _MASK
            out.append(a[:size])
        _powers = (out[0], out[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i]: polynomial hash of the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, equal for equal bytes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (with the total last)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATORS[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def take_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as a binary array."""
    lengths = ends - starts
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offs[1:])
    index = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], lengths)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(data[index])])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (lengths[i] of them) for each i in turn."""
    offs = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - offs, lengths)


def binary_rows(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """data cut at offsets (in elements of data) as a binary array."""
    offs = np.ascontiguousarray(offsets * data.itemsize, np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data))])


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with like bytes side by side, compressed; unsigned 64-bit ones as differences."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        body = np.diff(a, prepend=a.dtype.type(0)) if a.dtype == np.uint64 else a
        raw = np.ascontiguousarray(body).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
        z = zstandard.ZstdCompressor(level=1).compress(raw)
        out += [a.dtype.str.ljust(4).encode(), len(a).to_bytes(8, "little"), len(z).to_bytes(8, "little"), z]
    return b"".join(out)


def unpack(body: bytes) -> list[np.ndarray]:
    out, at = [], 2
    for _ in range(int.from_bytes(body[:2], "little")):
        kind, n, size = np.dtype(body[at : at + 4].decode().strip()), int.from_bytes(body[at + 4 : at + 12], "little"), int.from_bytes(body[at + 12 : at + 20], "little")
        raw = zstandard.ZstdDecompressor().decompress(body[at + 20 : at + 20 + size], max_output_size=max(1, n * kind.itemsize)) if n else b""
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.empty(0, kind)
        out.append(np.cumsum(a, dtype=np.uint64) if kind == np.uint64 else a)
        at += 20 + size
    return out


class _Known:
    """Spans' hashes in ascending order and the ids of each."""

    def __init__(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.starts = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are, and which of them are there."""
        at = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        there[inside] = self.keys[at[inside]] == keys[inside]
        return at, there

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[at]
        return self.ids[ragged(self.starts[at], sizes)], sizes

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Adds keys in ascending order that are not there."""
        at = np.searchsorted(self.keys, keys)
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        self.keys, self.starts, self.sizes = np.insert(self.keys, at, keys), np.insert(self.starts, at, starts), np.insert(self.sizes, at, sizes)
        self.ids = np.concatenate([self.ids, ids])


class SpanCache:
    """Ids of spans already encoded, by the spans' hashes; it only saves time.

    There are two generations: when the young one holds over `limit` spans it becomes the old one, and what is
    asked for again moves to the young one, so that frequent spans are never encoded again.
    """

    def __init__(self, limit: int = 300_000):
        self.limit = limit
        self.young, self.old = _Known(), _Known()

    def get(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """All spans' ids, one span after another, and each span's number of ids.

        encode(spans: binary array) -> (ids, offsets) is called once with the distinct spans that are not known.
        """
        if not len(starts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        hashes = span_hash(prefix_hash(data), starts, ends)
        keys, one, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.young.keys) > self.limit:
            self.young, self.old = _Known(), self.young
        young = self.young.find(keys)[1]
        at, old = self.old.find(keys)
        old &= ~young
        if old.any():
            self.young.add(keys[old], *self.old.take(at[old]))
        new = ~young & ~old
        if new.any():
            ids, offs = encode(take_spans(data, starts[one[new]], ends[one[new]]))
            self.young.add(keys[new], ids, np.diff(offs))
        return self.young.take(self.young.find(keys)[0][which])
