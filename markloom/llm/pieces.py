"""SentencePiece encoding and decoding with a score-ordered agenda of adjacent symbol pairs.

A merge-type (BPE) vocabulary is applied by always joining the adjacent pair whose joined piece has the
best score, the leftmost of equals. No piece of such a vocabulary has a word mark after another character
or a line feed inside, so a text falls into segments that no merge crosses; each distinct segment of an
Arrow batch is encoded once, all of a batch together as arrays (short ones) or with a heap (long ones).
Every distinct segment is then checked against the sentencepiece library. A row with a segment that
differs takes the library's ids for its whole text, and its ``agreed`` is false.

Null and empty texts have only the begin and end ids. Rows are independent: repeated rows give repeated
results, other columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanCache, pieces, ragged, take_spans, utf8

MARK = 0x2581
NONE = np.int32(2**31 - 1)
LONG = 96
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agreed boolean"


class PieceModel:
    """A merge-type model with byte fallback: its characters, its pairs and the score order of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        self.cache, self.disagreeing = SpanCache(), set()
        self.bytes_at = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(m.is_byte(int(i)) for i in self.bytes_at):
            raise ValueError("the vocabulary has no byte fallback")
        plain = {m.id_to_piece(i): i for i in range(self.size) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
        if any(m.is_unused(i) for i in plain.values()):
            raise ValueError("the vocabulary has unused pieces")
        order = {s: r for r, s in enumerate(sorted({m.get_score(i) for i in plain.values()}, reverse=True))}
        self.rank = np.full(self.size, NONE, np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        pairs = {}
        for piece, i in plain.items():
            self.rank[i] = order[m.get_score(i)]
            if len(piece) == 1:
                self.char[ord(piece)] = i
            elif "\n" in piece or any(c == chr(MARK) and p != chr(MARK) for p, c in zip(piece, piece[1:])):
                raise ValueError(f"piece {piece!r} crosses a segment's end")
            for k in range(1, len(piece)):
                a, b = plain.get(piece[:k]), plain.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
            if len(piece) > 1 and any(c not in plain for c in piece):
                raise ValueError(f"piece {piece!r} has a character that is no piece")
        self._slots(pairs)

    def _slots(self, pairs: dict[int, int]) -> None:
        """Open addressing: as many probes as the longest run needs, one or two for most keys."""
        bits = max(4, int(np.ceil(np.log2(max(1, len(pairs)) * 6))))
        self.shift = np.uint64(64 - bits)
        self.keys = np.full((1 << bits) + 64, -1, np.int64)
        self.merged = np.full((1 << bits) + 64, -1, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        at = self._slot(keys)
        self.probes = 1
        for key, slot, merged in zip(keys.tolist(), at.tolist(), pairs.values()):
            k = 0
            while self.keys[slot + k] >= 0:
                k += 1
            self.keys[slot + k], self.merged[slot + k] = key, merged
            self.probes = max(self.probes, k + 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that joins a and b, or -1."""
        key = a.astype(np.int64) * self.size + b
        key[(a < 0) | (b < 0)] = -2
        at = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        for _ in range(self.probes):
            found = self.keys[at]
            hit = found == key[left]
            out[left[hit]] = self.merged[at[hit]]
            go = ~hit & (found >= 0)
            if not go.any():
                break
            left, at = left[go], at[go] + 1
        return out

    def ranks(self, merged: np.ndarray) -> np.ndarray:
        return np.where(merged < 0, NONE, self.rank[merged])

    def agenda(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(position, piece) of what is left of one segment; a heap of pairs, best score and leftmost first."""
        ids, n = list(symbols), len(symbols)
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        joined = self.pair(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist() if n > 1 else []
        heap = [(int(self.rank[m]), i, ids[i], ids[i + 1], m) for i, m in enumerate(joined) if m >= 0]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            m = int(self.pair(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))[0])
            if m >= 0:
                heapq.heappush(heap, (int(self.rank[m]), i, ids[i], ids[j], m))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = m, False, right[j]
            if right[i] < n:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        return [(i, ids[i]) for i in range(n) if alive[i]]

    def _together(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of equally long segments: what is left of each, -2 where a symbol was joined to its left one."""
        n, length = symbols.shape
        ids = symbols.copy()
        if length == 1:
            return ids
        joined = np.full((n, length), -1, np.int32)
        joined[:, :-1] = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, length - 1)
        ranks = self.ranks(joined)
        right = np.tile(np.arange(1, length + 1, dtype=np.int16), (n, 1))
        left = np.tile(np.arange(-1, length - 1, dtype=np.int16), (n, 1))
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(axis=1)
            go = ranks[rows, at] != NONE
            rows, at = rows[go], at[go]
            after = right[rows, at].astype(np.int64)
            ids[rows, at] = joined[rows, at]
            ids[rows, after] = -2
            ranks[rows, after] = NONE
            beyond = right[rows, after].astype(np.int64)
            right[rows, at] = beyond
            has = beyond < length
            left[rows[has], beyond[has]] = at[has]
            before = left[rows, at].astype(np.int64)
            first = np.where(has, ids[rows, np.minimum(beyond, length - 1)], -1)
            second = np.where(before >= 0, ids[rows, np.maximum(before, 0)], -1)
            now = ids[rows, at]
            both = self.pair(np.concatenate([now, second]), np.concatenate([first, now]))
            joined[rows, at], behind = both[: len(rows)], both[len(rows) :]
            ranks[rows, at] = self.ranks(joined[rows, at])
            some = before >= 0
            joined[rows[some], before[some]] = behind[some]
            ranks[rows[some], before[some]] = self.ranks(behind[some])
        return ids

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments (bytes of valid UTF-8, cut at offsets), one after another, and where each starts."""
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        cuts = heads[offsets]
        symbols = self.char[np.where(points == 32, MARK, points)]
        lengths = np.diff(cuts)
        left = np.full(len(symbols), -2, np.int32)
        order = np.argsort(lengths, kind="stable")
        by = np.searchsorted(lengths[order], np.arange(1, LONG + 2))
        for length in range(1, LONG + 1):
            rows = order[by[length - 1] : by[length]]
            if len(rows):
                index = cuts[rows][:, None] + np.arange(length)
                left[index] = self._together(symbols[index])
        for row in order[by[LONG] :].tolist():
            start = int(cuts[row])
            for i, piece in self.agenda(symbols[start : int(cuts[row + 1])].tolist()):
                left[start + i] = piece
        alone = np.flatnonzero(left == -1)
        if not len(alone):
            kept = left != -2
            return left[kept], np.concatenate([[0], np.cumsum(kept)])[cuts]
        counts = (left != -2).astype(np.int64)
        starts = np.concatenate([np.flatnonzero((data & 0xC0) != 0x80), [len(data)]])
        counts[alone] = starts[alone + 1] - starts[alone]
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(ends[-1], np.int32)
        kept = left >= 0
        out[ends[:-1][kept]] = left[kept]
        out[ragged(ends[alone], counts[alone])] = self.bytes_at[data[ragged(starts[alone], counts[alone])]]
        return out, ends[cuts]


@lru_cache(maxsize=4)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with the word mark put before each, as a space: bytes, starts of segments, first segment of each text."""
    some = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][some], np.uint8(32))
    offsets = offsets + np.concatenate([[0], np.cumsum(some)])
    n = len(data)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    space, line = data == 32, data == 10
    mark = np.zeros(n, bool)
    mark[2:] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
    start = line.copy()
    start[1:] |= (space[1:] & ~space[:-1] & ~mark[:-1]) | line[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(start)
    return data, np.append(starts, n), np.searchsorted(starts, offsets)


def encode_batch(m: PieceModel, column: pa.Array, check: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts with begin and end ids, where each text starts in them, and whether the library agrees."""
    data, cuts, first = split(*utf8(column))
    n_rows = len(column)
    bad = m.disagreeing

    def fresh(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offs = utf8(spans)
        ids, at = m.segments(raw, offs)
        if check:
            theirs = m.library.encode(["\n" + x for x in spans.cast(pa.large_string()).to_pylist()], num_threads=1)
            sizes = np.fromiter(map(len, theirs), np.int64, len(theirs)) - 2
            flat = np.fromiter(chain.from_iterable(theirs), np.int32, int(sizes.sum()) + 2 * len(sizes))
            skip = np.ones(len(flat), bool)
            heads = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
            skip[heads] = skip[heads + 1] = False
            flat = flat[skip]
            if len(flat) != len(ids) or not (flat == ids).all():
                for k, x in enumerate(spans.to_pylist()):
                    if theirs[k][2:] != ids[at[k] : at[k + 1]].tolist():
                        bad.add(x)
        return ids, at

    ids, sizes = m.cache.get(data, cuts[:-1], cuts[1:], fresh)
    row_of = np.repeat(np.arange(n_rows), np.diff(first))
    totals = np.bincount(row_of, weights=sizes, minlength=n_rows).astype(np.int64) + 2
    starts = np.concatenate([[0], np.cumsum(totals)])
    out = np.empty(starts[-1], np.int32)
    out[starts[:-1]] = m.library.bos_id()
    out[starts[1:] - 1] = m.library.eos_id()
    inner = np.ones(len(out), bool)
    inner[starts[:-1]] = inner[starts[1:] - 1] = False
    out[inner] = ids
    agreed = np.ones(n_rows, bool)
    if bad:
        agreed[row_of[[x in bad for x in take_spans(data, cuts[:-1], cuts[1:]).to_pylist()]]] = False
    if not agreed.all():
        parts = np.split(out, starts[1:-1])
        for r in np.flatnonzero(~agreed):
            parts[r] = np.array(m.library.encode(column[r].as_py(), add_bos=True, add_eos=True), np.int32)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        out = np.concatenate(parts)
    return out, starts, agreed


def encode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): see RESULT; with keep_ids also ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in pieces(batches, limit=1_000_000):
            ids, starts, agreed = encode_batch(m, batch.column("text"))
            lists = [ids[a:b].tolist() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            decoded = m.library.decode(lists, num_threads=1)
            raw = ids.astype("<u4").tobytes()
            columns = [
                batch.column("doc_id"),
                pa.array(np.diff(starts)),
                pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                pa.array(agreed),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agreed"]
            if keep_ids:
                columns += [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)), pa.array(decoded)]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = RESULT + (", ids array<int>, decoded string" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kind)
