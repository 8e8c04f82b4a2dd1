"""Language identification with a convolutional network over bytes, trained and applied in numpy.

The network reads fixed windows of 256 bytes: filters of 2, 3 and 4 bytes (a table per offset, so a
convolution is a sum of table rows), rectified, max-pooled over the window, then a softmax. Training takes a
bounded sample: of the rows allowed for it, the `PER_LANG` with the smallest hash of each language (at most
`SAMPLE` in all), and from each a stretch of `STRETCH` characters at a place set by the hash. Prediction reads
whole texts in windows and averages the windows' probabilities, weighted by their bytes.

Beside the languages the network has a class for what is none of them: random words in scripts that the sample does not
have (`foreign`). It takes probability away and is never an answer, so a text in a script that nobody taught gets its
nearest language with a score near 0, and `accepted` turns it away. Languages in a script that the sample has are told apart by nothing of
this kind.

Null, empty and letterless texts are `und` with score 0, as are all texts where nothing can be learned from.
Rows are independent; repeated rows get equal results; other columns are ignored. lang, source and doc_id are
no inputs of a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, ragged, utf8

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
PER_LANG, SAMPLE, STRETCH, LEAST = 400, 20_000, 768, 0.3
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = True
OTHER = 40
#: First and last code points of the letters of scripts.
SCRIPTS = {
    "Greek": (0x391, 0x3C9), "Cyrillic": (0x410, 0x44F), "Armenian": (0x561, 0x586), "Hebrew": (0x5D0, 0x5EA), "Arabic": (0x621, 0x64A), "Devanagari": (0x905, 0x939), "Bengali": (0x985, 0x9B9),
    "Tamil": (0xB85, 0xBB9), "Thai": (0xE01, 0xE2E), "Georgian": (0x10D0, 0x10F0), "Hiragana": (0x3041, 0x3096), "Katakana": (0x30A1, 0x30FA), "Han": (0x4E00, 0x9FFF), "Hangul": (0xAC00, 0xD7A3),
}
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Network:
    langs: list[str]
    tables: np.ndarray  # offset, byte, filter
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max over positions of each filter, and where it is."""
        n = windows.shape[1] - self.tables.shape[0] + 1
        total = self.tables[0][windows[:, :n]]
        for j in range(1, self.tables.shape[0]):
            total += self.tables[j][windows[:, j : j + n]]
        at = total.argmax(axis=1)
        return np.take_along_axis(total, at[:, None, :], 1)[:, 0] + self.bias, at

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        n = windows.shape[1] - self.tables.shape[0] + 1
        best = np.empty((len(windows), self.tables.shape[2]), np.float32)
        for k in range(0, len(windows), 32):
            part = windows[k : k + 32]
            total = np.take(self.tables[0], part[:, :n], axis=0)
            for j in range(1, self.tables.shape[0]):
                total += np.take(self.tables[j], part[:, j : j + n], axis=0)
            best[k : k + 32] = total.max(axis=1)
        z = np.maximum(best + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the last of each padded with zero bytes; their texts and their bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    row = np.repeat(np.arange(len(sizes)), counts)
    start = ragged(np.zeros(len(sizes), np.int64), counts) * WINDOW
    length = np.minimum(WINDOW, sizes[row] - start)
    out = np.zeros((len(row), WINDOW), np.uint8)
    inside = np.arange(WINDOW) < length[:, None]
    out[inside] = data
    return out, row, length


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letters = np.concatenate([[0], np.cumsum(LETTERS[data])])
    high = np.concatenate([[0], np.cumsum(data >= 0x80)])
    out = np.diff(ascii_letters[offsets]) > 0
    for i in np.flatnonzero(~out & (np.diff(high[offsets]) > 0)):
        text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
        out[i] = any(unicodedata.category(c)[0] == "L" for c in text)
    return out


def foreign(texts: list[str], each: int = OTHER, seed: int = 3) -> list[str]:
    """Texts of random words, `each` in every script of which no more than one letter in a hundred of the texts is."""
    rng = np.random.default_rng(seed)
    known, out = "".join(texts), []
    letters = np.fromiter(map(ord, known), np.int64, len(known))
    total = max(1, int((letters > 64).sum()))
    for first, last in SCRIPTS.values():
        if ((letters >= first) & (letters <= last)).sum() * 100 > total:
            continue
        usable = [chr(c) for c in range(first, last + 1) if unicodedata.category(chr(c))[0] == "L"]
        for _ in range(each):
            some = rng.permutation(len(usable))[:200]  # a text has few letters, and some of them often
            weights = 1 / np.arange(1, len(some) + 1)
            picked = rng.choice(some, 260, p=weights / weights.sum())
            gaps = rng.random(260) < rng.choice([0.02, 0.18])
            out.append("".join(usable[k] + (" " if g else "") for k, g in zip(picked, gaps)))
    return out


def fit(texts: list[str], langs: list[str | None], epochs: int = 12, rate: float = 0.05, seed: int = 7) -> Network | None:
    """Adagrad on cross entropy; the gradient of a max-pooled filter goes to the bytes at its maximum.

    Texts whose language is None are the last class, which has no name.
    """
    names = sorted({x for x in langs if x is not None})
    classes = [*names, *([None] if None in langs else [])]
    if not names:
        return None
    rng = np.random.default_rng(seed)
    deep, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    width = np.repeat(WIDTHS, FILTERS)
    used = np.arange(deep)[:, None] < width
    net = Network(names, (rng.normal(0, 0.3, (deep, 256, n_filters)) * used[:, None, :]).astype(np.float32), np.zeros(n_filters, np.float32), rng.normal(0, 0.3, (n_filters, len(classes))).astype(np.float32), np.zeros(len(classes), np.float32))
    x, row, length = windows_of(*utf8(pa.array(texts, pa.large_string())))
    x, row = x[length >= 16], row[length >= 16]
    y = np.array([classes.index(lang) for lang in langs], np.int64)[row] if len(row) else np.empty(0, np.int64)
    weight = (1.0 / np.maximum(np.bincount(y, minlength=len(classes)), 1))[y] * len(y) / len(classes) if len(y) else np.empty(0)
    params = [net.tables, net.bias, net.out, net.out_bias]
    squares = [np.full_like(p, 1e-6) for p in params]
    for _ in range(epochs):
        for k in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            if not len(k):
                continue
            b = x[k]
            # shorter stretches too, so that short texts are not strange to it
            b = np.where(np.arange(WINDOW) < rng.choice([24, 48, 96, WINDOW, WINDOW, WINDOW], len(k))[:, None], b, 0).astype(np.uint8)
            h, at = net.pooled(b)
            a = np.maximum(h, 0)
            z = a @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(k)), y[k]] -= 1
            p *= (weight[k] / len(k))[:, None]
            back = (p @ net.out.T) * (h > 0)
            g = np.zeros_like(net.tables)
            f = np.arange(n_filters)
            for j in range(deep):
                np.add.at(g[j], (np.take_along_axis(b, at + j, 1), np.broadcast_to(f, at.shape)), back * used[j])
            for q, s, d in zip(params, squares, (g, back.sum(0), a.T @ p, p.sum(0))):
                s += d * d
                q -= (rate * d / np.sqrt(s)).astype(np.float32)
    return net


def train(docs: DataFrame) -> Network | None:
    """docs: text, lang and a key column doc_id that orders the sample; only rows that may be learned from."""
    rows = docs.where("lang is not null and text is not null").select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    at = F.pmod("h", F.greatest(F.length("text") - STRETCH, F.lit(1))) + 1
    rows = rows.select("lang", "h", F.substring(F.col("text"), at.cast("int"), F.lit(STRETCH)).alias("text"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= PER_LANG)
    sample = [r for r in first.orderBy("n", "h", "text").limit(SAMPLE).collect() if any(c.isalpha() for c in r.text)]
    texts = [r.text for r in sample]
    others = foreign(texts)
    return fit(texts + others, [*(r.lang for r in sample), *[None] * len(others)])


def decide(column: pa.Array, net: Network | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages and scores of whole texts, and the probability that a text is of any language learned."""
    data, offsets = utf8(column)
    n = len(column)
    lang, score, known = np.full(n, "und", object), np.zeros(n), np.zeros(n)
    if net is not None and len(data):
        x, row, length = windows_of(data, offsets)
        p = net.probabilities(x) * length[:, None]
        total = np.zeros((n, p.shape[1]))
        some = np.flatnonzero(np.diff(offsets) > 0)
        total[some] = np.add.reduceat(p, np.searchsorted(row, some), axis=0) / np.diff(offsets)[some][:, None]
        total = total[:, : len(net.langs)]
        good = has_letter(data, offsets)
        lang[good] = np.array(net.langs, object)[total.argmax(axis=1)[good]]
        score[good] = np.clip(total.max(axis=1)[good], 0, 1)
        known[good] = np.clip(total.sum(axis=1)[good], 0, 1)
    return lang, score, known


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """One row per row of docs (doc_id, text), see RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1_000_000):
            lang, score, _ = decide(batch.column("text"), net)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, RESULT)


def accepted(docs: DataFrame, net: Network | None, least: float = LEAST) -> DataFrame:
    """Rows of docs, with docs' columns, whose text is of a learned language with a probability of at least `least`.

    Where nothing could be learned no language can be told, and every text with a letter passes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1_000_000):
            if net is None:
                yield batch.filter(pa.array(has_letter(*utf8(batch.column("text"))), pa.bool_()))
                continue
            yield batch.filter(pa.array(decide(batch.column("text"), net)[2] >= least, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows."""
    return predict(docs, train(docs.where(~held_out())))
