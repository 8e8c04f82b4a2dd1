"""Suffix-array dedup: every byte covered by a `LENGTH`-byte string that also starts earlier is removed.

Texts are UTF-8 bytes; an earlier start is one in a smaller doc_id or before it in the same document, and
matches end with their document. Three steps keep what moves between machines small and the result exact:

1. Anchors. Every string of `LENGTH` bytes has one anchor, the `GRAM`-byte gram in it with the least hash
   (leftmost of equals), so equal strings have equal anchors. Starts with the same anchor form an interval;
   its span (from the first start to the last string's end) is hashed as a whole.
2. Intervals meet by anchor. Equal spans: all but the first have all starts repeated. Only where spans with
   one anchor differ, mostly at the ends of repeated passages, is the first interval of each span open.
3. The open intervals' bytes meet by anchor and get a suffix array by bucket-pointer refinement: buckets of
   4-byte prefixes are refined by sorting on the bucket pointers at offsets 4, 8, 16, ..., each round using the
   pointers that the round before has updated, and leaving out what stands alone; starts that share a bucket
   at depth `LENGTH` have equal strings, and all but the first are repeated.

Gram and span hashes have 64 bits each (40 choose the anchor). Null and empty texts have nothing to remove. A
null doc_id comes first; rows that share a doc_id come in the order of a hash of their text, and rows that
also share the text are one document whose result each of them gets. A text of any length is whole in one row. Other
columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, keyed, mix, pack, pieces, powers, prefix_hash, ragged, span_hash, table, unpack, utf8

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1  # grams in a string
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of starts: text, first start, last start, anchor (all from the data's start), hashes of gram and span."""
    sizes = np.diff(offsets)
    starts = ragged(offsets[:-1], np.maximum(sizes - LENGTH + 1, 0))
    none = np.empty(0, np.int64)
    if not len(starts):
        return none, none, none, none, np.empty(0, np.uint64), np.empty(0, np.uint64)
    prefix = prefix_hash(data)
    n = len(data) - GRAM + 1
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(prefix))[1][:n])
    low = (gram & ~_PLACE) | (np.arange(n, dtype=np.uint64) & _PLACE)
    width = 1
    while width * 2 <= REACH:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
    least = low[starts]
    place = (least & _PLACE).astype(np.int64)
    if len(data) > int(_PLACE):
        place = starts + ((place - starts) & int(_PLACE))
    first = np.ones(len(starts), bool)
    first[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(first)
    left, right, anchor = starts[at], starts[np.append(at[1:], len(starts)) - 1], place[at]
    span = mix(span_hash(prefix, left, right + LENGTH) ^ (anchor - left).astype(np.uint64))
    doc = np.searchsorted(offsets, left, "right") - 1
    # the least hashes are alike in their top bits, so they are mixed once more to be dealt evenly
    return doc, left, right, anchor, mix(gram[anchor] * np.uint64(0xD6E8FEB86659FD93)), span


def _firsts(group: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """For rows sorted by group and order: 0 for a group's first row and rows equal to it in order, 1 for later ones."""
    n = len(group)
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = np.ones(n, bool)
    for a in order:
        same &= a == a[head]
    return (~same).astype(np.int8)


def bucket_pointers(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each position a pointer to its bucket in the suffix array; positions with equal pointers have equal
    bytes to that depth (padded with zeros at the end of data)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint32)
    first = (padded[:n] << 24) | (padded[1 : n + 1] << 16) | (padded[2 : n + 2] << 8) | padded[3 : n + 3]
    order = np.argsort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[order][1:] != first[order][:-1]
    pointer = np.empty(n, np.int64)
    pointer[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0
    known = 4
    active = np.arange(n)
    while known < depth and len(active):
        sizes = np.bincount(pointer[active], minlength=n)
        active = active[sizes[pointer[active]] > 1]
        step = min(known, depth - known)
        later = active + step
        behind = np.where(later < n, pointer[np.minimum(later, n - 1)], -1)
        order = np.lexsort((behind, pointer[active]))
        active, behind = active[order], behind[order]
        own = pointer[active]
        bucket = np.ones(len(active), bool)
        bucket[1:] = own[1:] != own[:-1]
        new = bucket.copy()
        new[1:] |= behind[1:] != behind[:-1]
        rank = np.arange(len(active))
        begin = np.flatnonzero(bucket)[np.cumsum(bucket) - 1] if len(active) else rank
        pointer[active] = own + (np.flatnonzero(new)[np.cumsum(new) - 1] - begin if len(active) else 0)
        known += step
    return pointer


def _emit(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "body"])


def _anchor_rows(bits: int):
    """Buckets 0.. hold intervals by their anchor's hash; those below 0 intervals already known to be repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1_000_000):
            data, offsets = utf8(batch.column("text"))
            doc, left, right, anchor, gram, span = anchors(data, offsets)
            if not len(doc):
                continue
            d, c = batch.column("d").to_numpy(), batch.column("c").to_numpy()
            start = left - offsets[doc]
            code = (start << 16) | ((right - left) << 8) | (anchor - left)
            order = np.lexsort((start, c[doc], d[doc], span, gram))
            doc, gram, span, code = doc[order], gram[order], span[order], code[order]
            group = mix(gram) + span
            later = _firsts(group, (d[doc], c[doc], code)) == 1
            rows = []
            if later.any():
                rows.append((-1 - int(d[doc[0]] % (1 << bits)), pack(d[doc[later]], c[doc[later]], code[later])))
            keep = ~later
            doc, gram, span, code = doc[keep], gram[keep], span[keep], code[keep]
            at = np.searchsorted(gram >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
            for b in range(1 << bits):
                s = slice(at[b], at[b + 1])
                if at[b] < at[b + 1]:
                    own, index = np.unique(doc[s], return_inverse=True)
                    rows.append((b, pack(gram[s], span[s].view("V8"), index.astype(np.uint16 if len(own) < 1 << 16 else np.uint32), code[s], d[own], c[own])))
            yield _emit(rows)

    return run


def _meet(group: pa.Table) -> pa.Table:
    """d, c, code, gram: repeated intervals (gram null) and open ones."""
    names = ["d", "c", "code", "gram"]
    parts = [unpack(b) for b in group.column("body").to_pylist()]
    if group.column("bucket")[0].as_py() < 0:
        d, c, code = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return pa.table([pa.array(d), pa.array(c), pa.array(code), pa.nulls(len(d), pa.int64())], names)
    gram, span, code = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).view(np.uint64), np.concatenate([p[3] for p in parts])
    d, c = np.concatenate([p[4][p[2]] for p in parts]), np.concatenate([p[5][p[2]] for p in parts])
    order = np.lexsort((code, c, d, span, gram))
    gram, span, code, d, c = gram[order], span[order], code[order], d[order], c[order]
    n = len(gram)
    pair = np.ones(n, bool)
    pair[1:] = (gram[1:] != gram[:-1]) | (span[1:] != span[:-1])
    later = _firsts(np.cumsum(pair), (d, c, code)) == 1
    new = np.ones(n, bool)
    new[1:] = gram[1:] != gram[:-1]
    spans = np.add.reduceat(pair.astype(np.int64), np.flatnonzero(new))
    open_ = pair & (spans[np.cumsum(new) - 1] > 1)
    take = later | open_
    return pa.table([pa.array(d[take]), pa.array(c[take]), pa.array(code[take]), pa.array(gram[take].view(np.int64), mask=later[take])], names)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, limit=1_000_000):
        body = pa.array([z.compress(t.encode()) for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names if n != "text"), body], [*(n for n in batch.schema.names if n != "text"), "z"])


def _snippets(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in pieces(batches, "z", 1_000_000):
            rows = []
            for d, c, body, open_ in zip(*(batch.column(n).to_pylist() for n in ("d", "c", "z", "open"))):
                data = z.decompress(body)
                for x in open_:
                    start, more = x["code"] >> 16, x["code"] >> 8 & 255
                    rows.append((x["gram"] % 2**64 >> (64 - bits), x["gram"], d, c, start, data[start : start + more + LENGTH]))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["bucket", "gram", "d", "c", "start", "bytes"])

    return run


def _refine(group: pa.Table) -> pa.Table:
    """d, c, code: runs of starts whose strings also start earlier."""
    gram = group.column("gram").to_numpy()
    order = np.argsort(gram, kind="stable")
    gram, group = gram[order], group.take(pa.array(order))
    d, c, start = (group.column(n).to_numpy() for n in ("d", "c", "start"))
    data, offsets = utf8(group.column("bytes").combine_chunks())
    edges = np.append(np.flatnonzero(np.append(True, gram[1:] != gram[:-1])), len(gram))
    out = [[], [], []]
    k = 0
    while k < len(edges) - 1:
        j = k + 1
        while j < len(edges) - 1 and offsets[edges[j + 1]] - offsets[edges[k]] < 400_000:
            j += 1
        rows = slice(edges[k], edges[j])
        offs = offsets[edges[k] : edges[j] + 1]
        pointer = bucket_pointers(data[offs[0] : offs[-1]])
        counts = np.diff(offs) - LENGTH + 1
        own = np.repeat(np.arange(edges[k], edges[j]), counts)
        inner = ragged(np.zeros(len(counts), np.int64), counts)
        bucket = pointer[ragged(offs[:-1] - offs[0], counts)]
        place = start[own] + inner
        by = np.lexsort((place, c[own], d[own], bucket))
        later = np.zeros(len(own), bool)
        later[by] = _firsts(bucket[by], (d[own][by], c[own][by], place[by])) == 1
        first = later.copy()
        first[1:] &= ~later[:-1] | (own[1:] != own[:-1])
        last = later.copy()
        last[:-1] &= ~later[1:] | (own[1:] != own[:-1])
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        for x, y in zip(out, (d[own[a]], c[own[a]], (place[a] << 16) | ((b - a) << 8))):
            x.append(y)
        k = j
    return pa.table([pa.array(np.concatenate(x)) for x in out], ["d", "c", "code"])


def repeated(given: DataFrame) -> DataFrame:
    """d, c, code of every repeated interval of starts in rows (d, c, text)."""
    spark = given.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bits = max(4, (parts - 1).bit_length())
    rows = given.mapInArrow(_anchor_rows(bits), "bucket int, body binary")
    met = table(rows.groupBy("bucket").applyInArrow(_meet, "d long, c long, code long, gram long"), "intervals")
    needs = met.where("gram is not null").groupBy("d", "c").agg(F.collect_set(F.struct("code", "gram")).alias("open"))
    texts = given.mapInArrow(_packed, "d long, c long, z binary").join(needs, ["d", "c"])
    snippets = texts.mapInArrow(_snippets(bits), "bucket int, gram long, d long, c long, start long, bytes binary")
    more = snippets.groupBy("bucket").applyInArrow(_refine, "d long, c long, code long")
    return met.where("gram is null").select("d", "c", "code").unionAll(more)


def _cut(batches: Iterator[pa.RecordBatch], keep: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for batch in pieces(batches, "z", 1_000_000):
        n_bytes, removed, spans, hashes, kept = [], [], [], [], []
        for body, codes in zip(batch.column("z").to_pylist(), batch.column("codes")):
            data = z.decompress(body)
            n_bytes.append(len(data))
            if codes.is_valid:
                x = codes.values.to_numpy()
                gone = np.zeros(len(data) + 1, np.int64)
                np.add.at(gone, x >> 16, 1)
                np.add.at(gone, (x >> 16) + (x >> 8 & 255) + LENGTH, -1)
                inside = np.cumsum(gone[:-1]) > 0
                removed.append(int(inside.sum()))
                spans.append(int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum()))
                data = np.frombuffer(data, np.uint8)[~inside].tobytes()
            else:
                removed.append(0), spans.append(0)
            hashes.append(hashlib.sha256(data).hexdigest())
            if keep:
                kept.append(data.decode("utf-8", "ignore"))
        out = [pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string())]
        more = [pa.array(kept, pa.string())] if keep else []
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *out, *more], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep else [])])


def dedup(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs (doc_id, text).

    With whole, a struct `row` with all columns of docs but text takes doc_id's place and `kept` comes last, the remaining bytes
    as text; a character that lost some of its bytes is left out of it.
    """
    rows = keyed(docs, whole)
    gone = repeated(rows.select("d", "c", "text")).groupBy("d", "c").agg(F.collect_list("code").alias("codes"))
    first = "row" if whole else "doc_id"
    kind = f"row {rows.schema['row'].dataType.simpleString()}" if whole else "doc_id long"
    rows = rows if whole else rows.withColumn("doc_id", F.when(F.col("d") != NULL_ID, F.col("d")))
    met = rows.select("d", "c", first, "text").mapInArrow(_packed, f"d long, c long, {kind}, z binary").join(gone, ["d", "c"], "left")
    out = f"{kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept string" if whole else "")
    return met.mapInArrow(lambda it: _cut(it, whole, [first]), out)
