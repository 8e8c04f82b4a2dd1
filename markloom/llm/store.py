"""Token ids in a content-addressed store.

A rolling hash over the last ids of each document cuts its id stream into chunks. A chunk is named by the
BLAKE2b digest of its bytes and stored once; a document is a recipe, the list of its chunks' digests, with
the Merkle root over them. write() makes one pass over the texts and one shuffle: chunks meet by digest,
copies made by one task are dropped before the shuffle.

Files under the store's folder, all Parquet:
  kind=chunk      digest, payload (little-endian ids of 2 bytes, 4 where the vocabulary needs it), n_ids
  documents       doc_id, row, n_tokens, root, recipe (digests, 16 bytes each), start; in ascending doc_id order

Null and empty texts have the end id alone. Rows that repeat a doc_id are documents of their own, in the
order of `row`. Null doc_ids come first. Other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, SpanCache, mix, new_folder, pieces, powers, table, utf8, words

WINDOW, MASK_BITS, LEAST, MOST = 16, 10, 128, 8192
MARKS = ".,;:!?"
DIGEST = 16
ROW = "kind string, key binary, doc_id long, n long, payload binary, root binary"


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once.

    Valid where the tokenizer's normaliser and splitter work on each run of non-white characters alone. Where it
    lowers letters, words differ by case no more (but for texts with "<|", which may hold special tokens); where it
    also parts letters from punctuation, one mark at a word's end is a word of its own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.cache = SpanCache()
        ids = lambda *words: [i for w in words for i in self.library.encode(w, add_special_tokens=False).ids]
        self.lowers = all(ids(x) == ids(x.lower()) for x in ("Word", "wORD'S", "ÀbC", "A\u0301Z", "1A-B"))
        self.parts = all(ids(w + m) == ids(w, m) for w in ("word", "it's", "x1y", "wörd", "a--b") for m in MARKS)

    def fresh(self, spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.library.encode_batch_fast(spans.cast(pa.large_string()).to_pylist(), add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter(chain.from_iterable(found), np.int32, int(ends[-1])), np.concatenate([[0], ends])

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text's, and where each text starts."""
        data, offsets = utf8(column)
        if self.lowers and b"<|" not in data.tobytes():
            data = LOWER[data]
        starts, ends, first = words(data, offsets)
        if self.parts:
            before, last = data[np.maximum(ends - 2, 0)] | 32, data[ends - 1]
            cut = (ends - starts > 1) & (before >= ord("a")) & (before <= ord("z")) & np.isin(last, np.frombuffer(MARKS.encode(), np.uint8))
            first = first + np.concatenate([[0], np.cumsum(cut)])[first]
            starts, ends = np.sort(np.concatenate([starts, ends[cut] - 1])), np.sort(np.concatenate([ends, ends[cut] - 1]))
        ids, sizes = self.cache.get(data, starts, ends, self.fresh)
        totals = np.concatenate([[0], np.cumsum(sizes)])[first]
        at = totals + np.arange(len(offsets))
        out = np.full(at[-1], end, np.int32)
        inner = np.ones(len(out), bool)
        inner[at[1:] - 1] = False
        out[inner] = ids
        return out, at


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cuts(ids: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each text ids[at[i]:at[i + 1]] the ends of its chunks, from its own start; the content alone decides."""
    n = len(ids)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    begin = np.maximum(np.arange(1, n + 1) - WINDOW, np.repeat(at[:-1], np.diff(at)))
    rolled = mix((total[1:] - total[begin]) * down[begin])
    marks = np.flatnonzero((rolled >> np.uint64(64 - MASK_BITS)) == 0) + 1
    lo, hi = np.searchsorted(marks, at[:-1], "right"), np.searchsorted(marks, at[1:], "left")
    out = []
    for i, (start, stop) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        ends, last = [], start
        for mark in [*marks[lo[i] : hi[i]].tolist(), stop]:
            if mark - last < LEAST and mark != stop:
                continue
            while mark - last > MOST:
                last += MOST
                ends.append(last - start)
            ends.append(mark - start)
            last = mark
        out.append(ends)
    return out


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary tree over the digests; an odd one moves up as it is."""
    level = [hashlib.blake2b(b"\0" + d, digest_size=DIGEST).digest() for d in digests]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=DIGEST).digest() for a, b in zip(level[::2], level[1::2])]
        level = pairs + level[len(pairs) * 2 :]
    return level[0] if level else bytes(DIGEST)


def _rows(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen, row = encoder(tokenizer), set(), 0
        task = TaskContext.get().partitionId()
        for batch in pieces(batches, limit=4_000_000):
            ids, at = enc.encode(batch.column("text"), end)
            raw = ids.astype(f"<u{enc.width}").tobytes()
            keys, kinds, docs, ns, payloads, roots = [], [], [], [], [], []
            for doc, start, ends in zip(batch.column("doc_id").to_pylist(), at.tolist(), cuts(ids, at)):
                recipe, last = [], 0
                for stop in ends:
                    body = raw[(start + last) * enc.width : (start + stop) * enc.width]
                    digest = hashlib.blake2b(body, digest_size=DIGEST).digest()
                    recipe.append(digest)
                    if digest not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(digest)
                        keys.append(digest), kinds.append("chunk"), docs.append(None), ns.append(stop - last), payloads.append(body), roots.append(None)
                    last = stop
                keys.append(task.to_bytes(4, "big") + row.to_bytes(8, "big")), kinds.append("document"), docs.append(doc), ns.append(last), payloads.append(b"".join(recipe)), roots.append(merkle(recipe))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(ns, pa.int64()), pa.array(payloads, pa.binary()), pa.array(roots, pa.binary())], ["kind", "key", "doc_id", "n", "payload", "root"])

    return run


def write(docs: DataFrame, tokenizer: str, end: int = 1, folder: str | None = None) -> str:
    """Writes all texts of docs (doc_id, text) to a new store and returns its folder."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "store")
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_rows(tokenizer, end), ROW)
    once = rows.dropDuplicates(["kind", "key"])
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/raw")
    raw = spark.read.schema(ROW).parquet(f"{folder}/raw")
    _documents(raw, f"{folder}/documents")
    return folder


def _documents(raw: DataFrame, folder: str) -> None:
    """Recipes in ascending doc_id order, with the number of ids before each document."""
    docs = raw.where("kind = 'document'").select("doc_id", F.col("key").alias("row"), F.col("n").alias("n_tokens"), "root", F.col("payload").alias("recipe"))
    order = ["doc_id", "row"]
    parts = table(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "parts")
    sums = parts.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    done = parts.join(bases, "part").withColumn("start", F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    done.repartitionByRange(*order).sortWithinPartitions(*order).drop("part", "base").write.option("compression", "zstd").parquet(folder)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(ROW).parquet(f"{folder}/raw").where("kind = 'chunk'").select(F.col("key").alias("digest"), F.col("n").alias("n_ids"), "payload")


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC-32 polynomial, bits reflected."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(maxsize=1 << 16)
def _shift(n: int) -> int:
    """x ** (8 n) modulo the CRC-32 polynomial."""
    out, power, e = 1 << 31, 1 << 30, 8 * n
    while e:
        if e & 1:
            out = _times(power, out)
        power, e = _times(power, power), e >> 1
    return out


def crc32_of_parts(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a whole from (CRC-32, bytes) of its parts."""
    out = 0
    for crc, size in parts:
        out = _times(_shift(size), out) ^ crc
    return out


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, crcs, sizes = [], [], []
        for digest, n, body in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_ids", "payload"))):
            good.append(hashlib.blake2b(body, digest_size=DIGEST).digest() == digest)
            ids = np.frombuffer(body, f"<u{len(body) // max(n, 1)}").astype("<u4").tobytes()
            crcs.append(zlib.crc32(ids))
            sizes.append(len(ids))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(good, pa.bool_()), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())], ["digest", "good", "crc", "size"])


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            found = sorted(r.pop("parts"), key=lambda x: x["at"])
            digests = [x["digest"] for x in found]
            r["ids_crc32"] = crc32_of_parts([(x["crc"], x["size"]) for x in found])
            r["n_tokens"], said = sum(x["size"] for x in found) // 4, r["n_tokens"]
            r["n_chunks"] = len(found)
            r["verified"] = all(x["good"] for x in found) and merkle(digests) == r["root"] and r["n_tokens"] == said
            r["root"] = r["root"].hex()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("n_chunks", pa.int64()), ("verified", pa.bool_()), ("root", pa.string())]))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, n_chunks, verified, root.

    Each stored chunk is read once, checked against its name and reduced to its CRC; recipes put the CRCs
    together, so no chunk that many documents share is copied to each of them.
    """
    known = chunks(spark, folder).mapInArrow(_read_chunks, "digest binary, good boolean, crc long, size long")
    docs = documents(spark, folder)
    n = F.length("recipe") / DIGEST
    steps = docs.select("row", "doc_id", "start", "n_tokens", "root", "recipe").select(
        "row", "doc_id", "start", "n_tokens", "root",
        F.explode(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(i.alias("at"), F.substring(F.col("recipe"), i * DIGEST + 1, F.lit(DIGEST)).alias("digest")))).alias("s"),
    ).select("row", "doc_id", "start", "n_tokens", "root", "s.at", "s.digest")
    joined = steps.join(known, "digest")
    whole = joined.groupBy("row", "doc_id", "start", "n_tokens", "root").agg(F.collect_list(F.struct("at", "digest", "good", "crc", "size")).alias("parts"))
    return whole.drop("row").mapInArrow(_assemble, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long, verified boolean, root string")


def read_ids(spark: SparkSession, folder: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id and the ids of documents (all, or those in doc_ids), put together from their chunks."""
    docs = documents(spark, folder)
    if doc_ids is not None:
        docs = docs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    n = F.length("recipe") / DIGEST
    steps = docs.select("row", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.substring(F.col("recipe"), i * DIGEST + 1, F.lit(DIGEST)))).alias("at", "digest"))
    whole = steps.join(chunks(spark, folder), "digest").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "n_ids", "payload"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(p["payload"], f"<u{len(p['payload']) // p['n_ids']}").astype(np.int64) for p in r]) for r in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tolist() for x in ids], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return whole.select("doc_id", "parts").mapInArrow(run, "doc_id long, ids array<long>")


def manifest(spark: SparkSession, folder: str, fan: int = 1024) -> str:
    """Root over all documents' roots in ascending doc_id order, level by level, as hex digits."""
    level = documents(spark, folder).select("doc_id", "row", "start", F.hex("root").alias("root"))
    level = level.select((F.col("start") / fan).cast("long").alias("block"), F.struct("start", "doc_id", "row", "root").alias("s"))
    while True:
        blocks = level.groupBy("block").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("s")).getField("root"), ""), 256).alias("root"))
        if blocks.limit(2).count() < 2:
            return (blocks.first() or {"root": hashlib.sha256(b"").hexdigest()})["root"]
        level = blocks.select((F.col("block") / fan).cast("long").alias("block"), F.struct("block", "root").alias("s"))
