"""Quality classifier from positive and unlabelled texts: a small network that minimises the non-negative risk.

Texts become vectors (`vectors`): rates of pairs of neighbouring byte classes, which have shouting, markup, lists
and digits in any language, and rates of repeated words and lines, of word lengths and of line lengths. Whole texts
are read once, in Arrow batches, and the vectors are written as a table; all that follows reads that.

Only rows whose crc32(doc_id as text) mod 3 is not 1 are learned from: trusted positives are documents with labels
of which all have quality 1, the unlabelled are any documents; labels of bad documents are not used. Of both a
bounded sample goes to the driver, the `POSITIVES` and `UNLABELLED` rows with the smallest hash of doc_id and
vector (rows that are the same count once there); a positive may be among the unlabelled too. The share of positives among the unlabelled (the class prior)
is estimated first: a network tells positives from unlabelled, and over the rows that it has not learned from,
the least ratio of the shares above a threshold, with a confidence bound on both shares, is the prior. Then the
network is fitted to the risk prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with logistic loss; where
the second part is below zero in a batch, its gradient is turned round. The score is the logistic of the output.

Null and empty texts have a vector (of zeros) and a score as any other. Where there are no positives or nothing
unlabelled nothing is learned and every score is 0. Repeated rows get equal scores; other columns are ignored. Long
texts stand alone in a batch; memory is some 60 bytes for each of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audit import distinct
from .common import pieces, table, utf8, words
from .langid import held_out

POSITIVES, UNLABELLED = 6000, 12_000
HIDDEN, EPOCHS, RATE, BATCH, DECAY = 16, 100, 0.01, 256, 1e-4
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, MARK, HIGH, EDGE = range(9)
EXTRA = ("log_words", "distinct_words", "word_length", "longest_word", "lines", "repeated_lines", "repeated_neighbours", "short_words")
WIDTH = 81 + len(EXTRA)
RESULT = "doc_id long, held_out boolean, score double, predicted int"


def _classes() -> np.ndarray:
    out = np.full(256, MARK, np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:] = LOWER, UPPER, DIGIT, HIGH
    out[[9, 11, 12, 32]], out[[10, 13]] = SPACE, LINE
    out[[ord(c) for c in ".,;:?'\"-()"]] = STOP
    return out


CLASS = _classes()


def vectors(column: pa.Array) -> np.ndarray:
    """WIDTH numbers for each text: 81 rates of pairs of classes (the ends of a text are a class), and EXTRA."""
    data, offsets = utf8(column)
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((rows, WIDTH), np.float32)
    if not len(data):
        return out
    row = np.repeat(np.arange(rows), sizes)
    kind = CLASS[data]
    before = np.empty(len(data), np.uint8)
    before[1:] = kind[:-1]
    before[offsets[:-1][sizes > 0]] = EDGE
    n = np.maximum(sizes, 1)
    pairs = np.bincount(row * 81 + before * 9 + kind, minlength=rows * 81).reshape(rows, 81)
    last = offsets[1:][sizes > 0] - 1
    pairs[sizes > 0, kind[last] * 9 + EDGE] += 1
    out[:, :81] = np.sqrt(pairs / n[:, None])
    starts, ends, _ = words(data, offsets)
    word_row = row[starts]
    count = np.bincount(word_row, minlength=rows)
    per = np.maximum(count, 1)
    first = distinct(data, word_row, starts, ends)
    length = ends - starts
    line_end = kind == LINE
    cuts = np.unique(np.concatenate([offsets[:-1][sizes > 0], np.flatnonzero(line_end) + 1]))
    cuts = cuts[cuts < len(data)]
    stops = np.append(cuts[1:], len(data))
    full = stops - cuts > 1
    line_row = row[cuts[full]]
    lines = np.bincount(line_row, minlength=rows)
    new_line = distinct(data, line_row, cuts[full], stops[full] - line_end[stops[full] - 1])
    neighbours = np.flatnonzero((word_row[1:] == word_row[:-1]) & (length[1:] == length[:-1])) if len(starts) > 1 else np.empty(0, np.int64)
    same = neighbours[~first[neighbours + 1]]
    same = same[data[starts[same]] == data[starts[same + 1]]]
    most = np.zeros(rows)
    np.maximum.at(most, word_row, length)
    out[:, 81:] = np.stack([
        np.log1p(count) / 8, np.bincount(word_row[first], minlength=rows) / per, np.bincount(word_row, length, rows) / per / 8, np.log1p(most) / 4,
        np.minimum(lines / per, 1), 1 - np.bincount(line_row[new_line], minlength=rows) / np.maximum(lines, 1), np.bincount(word_row[same], minlength=rows) / per,
        np.bincount(word_row[length < 3], minlength=rows) / per,
    ], axis=1)
    return out


def vector_table(docs: DataFrame) -> DataFrame:
    """doc_id and vector of each row of docs (doc_id, text), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            v = vectors(batch.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * WIDTH, pa.int32()), pa.array(v.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), rows], ["doc_id", "vector"])

    return table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, vector array<float>"), "vectors")


@dataclass
class Network:
    """One hidden layer of rectified sums of standardised numbers."""

    middle: np.ndarray
    spread: np.ndarray
    params: list[np.ndarray]
    prior: float = 0.0

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.params[0] + self.params[1], 0)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.spread, -6, 6)

    def output(self, x: np.ndarray) -> np.ndarray:
        return self.hidden(self.scaled(x)) @ self.params[2] + self.params[3]


def logistic(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(g / 2))


def risk(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk of outputs for positives and unlabelled, and the steps' gradients by output.

    Where the part for negatives is below zero, the risk has it as zero, and the step goes against that part.
    """
    loss = lambda z: np.logaddexp(0, -z)
    n_p, n_u = max(len(g_p), 1), max(len(g_u), 1)
    negative = loss(-g_u).sum() / n_u - prior * loss(-g_p).sum() / n_p
    value = prior * loss(g_p).sum() / n_p + max(0.0, negative)
    d_u, d_p = logistic(g_u) / n_u, -prior * logistic(g_p) / n_p
    if negative >= 0:
        return value, d_p - prior * logistic(-g_p) / n_p, d_u
    return value, -d_p, -d_u


def cross(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss of positives against unlabelled, both with half the weight."""
    return 0.0, -0.5 * logistic(-g_p) / max(len(g_p), 1), 0.5 * logistic(g_u) / max(len(g_u), 1)


def fit(p: np.ndarray, u: np.ndarray, prior: float, of=risk, epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on batches that hold both kinds in their proportions."""
    rng = np.random.default_rng(seed)
    middle, spread = u.mean(0), u.std(0) + 1e-3
    width = p.shape[1]
    net = Network(middle, spread, [rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)], prior)
    p, u = net.scaled(p), net.scaled(u)
    first, second = [np.zeros_like(q) for q in net.params], [np.zeros_like(q) for q in net.params]
    steps = max(1, -(-(len(p) + len(u)) // BATCH))
    t = 0
    for _ in range(epochs):
        for a, b in zip(np.array_split(rng.permutation(len(p)), steps), np.array_split(rng.permutation(len(u)), steps)):
            t += 1
            x = np.concatenate([p[a], u[b]])
            h = net.hidden(x)
            g = h @ net.params[2] + net.params[3]
            _, d_p, d_u = of(g[: len(a)], g[len(a) :], prior)
            d = np.concatenate([d_p, d_u])
            back = np.outer(d, net.params[2]) * (h > 0)
            for k, grad in enumerate((x.T @ back, back.sum(0), h.T @ d, d.sum(keepdims=True))):
                grad = grad + DECAY * net.params[k]
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                net.params[k] = net.params[k] - RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return net


def share_of_positives(g_p: np.ndarray, g_u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The prior from outputs of a network for rows it has not learned from.

    Above a threshold stand a share of the positives and a share of the unlabelled; their ratio is the prior where
    only positives stand there. The threshold is the one with the least upper bound of the ratio.
    """
    if not len(g_p) or not len(g_u):
        return 1.0
    at = np.unique(g_p)
    above_p = 1 - np.searchsorted(np.sort(g_p), at) / len(g_p)
    above_u = 1 - np.searchsorted(np.sort(g_u), at) / len(g_u)
    room = np.sqrt(np.log(4 / delta) / (2 * len(g_p))) + np.sqrt(np.log(4 / delta) / (2 * len(g_u)))
    best = np.argmin(above_u / above_p + (1 + gamma) / above_p * room)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 1.0))


def prior_of(p: np.ndarray, u: np.ndarray) -> float:
    """Mean of two estimates, each on the half that its network has not seen."""
    found = []
    for half in (0, 1):
        net = fit(p[half::2], u[half::2], 0.5, cross, EPOCHS // 3, 11 + half) if len(p[half::2]) and len(u[half::2]) else None
        found.append(1.0 if net is None else share_of_positives(net.output(p[1 - half :: 2]), net.output(u[1 - half :: 2])))
    return sum(found) / 2


def sample(rows: DataFrame, n: int) -> np.ndarray:
    """Vectors of the n rows with the smallest hash of doc_id and vector, rows that are the same once.

    Rows whose hash is too large to be among them are left out where they are, so about 2n rows leave the tasks however
    many there are.
    """
    total = rows.count()
    h = F.xxhash64("doc_id", "vector")
    bound = 2**63 - 1 if total <= 2 * n else (2 * n << 64) // total - 2**63
    few = rows.select(h.alias("h"), "vector").where(F.col("h") <= bound).dropDuplicates(["h"]).orderBy("h").limit(n).select("vector")
    return np.array([r[0] for r in few.collect()], np.float64).reshape(-1, WIDTH)


def train(found: DataFrame, labels: DataFrame) -> Network | None:
    """A network from a table of vectors and labels (doc_id, quality)."""
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"))
    rows = found.where(~held_out())
    p, u = sample(rows.join(good.where("good = 1"), "doc_id", "left_semi"), POSITIVES), sample(rows, UNLABELLED)
    if not len(p) or not len(u):
        return None
    return fit(p, u, prior_of(p, u))


def predict(found: DataFrame, net: Network | None) -> DataFrame:
    """One row for each row of a table of vectors, see RESULT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = batch.column("vector").flatten().to_numpy().reshape(n, WIDTH)
            score = np.zeros(n) if net is None else logistic(net.output(v.astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return found.select("doc_id", held_out().alias("held_out"), "vector").mapInArrow(run, RESULT)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows of docs (doc_id, text), learned from those that are not held out."""
    found = vector_table(docs)
    return predict(found, train(found, labels))
