"""Exact self join of documents' word-shingle sets at a Jaccard similarity of 0.8, with set-relation skipping.

Sets of 5-word shingles (A-Z lowered; fewer words: all of them as one) are ordered by one global order, rare
shingles first: by a counting sketch of fixed size, then by hash. Two sets that are similar enough share a
shingle among the first n - ceil(0.8 n) + 1 of both, so index lists hold those only. Then:

* Equal sets are one node. Their answers are the same.
* Each list, sorted by size, is a row of blocks of `BLOCK` sets with their least size and greatest room (size less position);
  a block is skipped as a whole where these leave no room for enough common shingles, then a set in it for its own.
* First each list's sets are checked against the list's leader only (the one with the fewest rarer shingles, so
  most like the original of a group of near copies, and of these the least hash, so that a group has few leaders). Sets found similar to the leader take over its component.
* Then all pairs of a list that still lie in different components are candidates, those with its leader apart, which are
  answered; a set that has room with none of its list but the leader is not asked again. Parity bitmaps (an exact
  bound on the difference) drop most, the others are checked. Within a component nothing is checked again, so
  groups of copies cost a star, not all their pairs, and no link between components is missed.
* Partners of one set are answered together, up to some `PARTNERS` of them (a set with more is asked in several groups, and
  its text goes once to each). Among the partners, those that are highly similar to one before them (this is tested) take
  its answers: the overlap with that one, less and more what the two differ in, decides most pairs by bounds alone,
  the others by meeting the few shingles that differ. Links say whether they were derived so.

Shingles and sets are known by 64-bit hashes. Texts without words have no set and are alone. A null doc_id
counts as the smallest, and its component is then null. Rows that share a doc_id are documents of their own
with that id; repeated rows get equal results. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, binary_rows, keyed, mix, pack, pieces, ragged, table, unpack
from .components import components
from .fingerprints import shingles
from .suffixes import _packed

CELLS, SLICES = 1 << 20, 256
LEAST_BITS, MOST_BITS, LONG_LIST = 64, 8192, 32
BLOCK, PARTNERS = 32, 256


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def needed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common shingles that two sets of these sizes need: 100 * common >= 80 * union."""
    return (4 * (a + b) + 8) // 9


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in pieces(batches, limit=1_000_000):
        h, _ = shingles(batch.column("text"))
        counts += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=CELLS)
    if counts.any():
        parts = counts.astype(np.uint32).reshape(SLICES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([pack(p) for p in parts], pa.binary())], ["slice", "body"])


def _add(group: pa.Table) -> pa.Table:
    total = np.zeros(CELLS // SLICES, np.int64)
    for body in group.column("body").to_pylist():
        total += unpack(body)[0]
    ranks = np.log2(total + 1).astype(np.uint8)
    return pa.table([group.column("slice").slice(0, 1).combine_chunks(), pa.array([ranks.tobytes()], pa.binary())], ["slice", "ranks"])


def sketch(docs: DataFrame) -> np.ndarray:
    """How common each of `CELLS` groups of shingles is over all documents, as a logarithm; its size is fixed."""
    rows = docs.select("text").mapInArrow(_sketch, "slice int, body binary").groupBy("slice").applyInArrow(_add, "slice int, ranks binary")
    out = np.zeros((SLICES, CELLS // SLICES), np.uint8)
    for r in rows.collect():
        out[r["slice"]] = np.frombuffer(r["ranks"], np.uint8)
    return out.reshape(-1)


def ordered_sets(column: pa.Array, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in the global order, and where each text's start."""
    h, at = shingles(column)
    doc = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(at))
    key = (doc << 8) | ranks[(h >> np.uint64(44)).astype(np.int64)]
    order = np.lexsort((h, key))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(column) + 1))


def bitmaps(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of shingles by their low bits, about one bit for each shingle: bytes of all sets, and where each starts."""
    n = np.diff(at)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    starts = np.concatenate([[0], np.cumsum(bits)])
    place = (h & (np.repeat(bits, n) - 1).astype(np.uint64)).astype(np.int64) + np.repeat(starts[:-1], n)
    parity = (np.bincount(place, minlength=starts[-1]) & 1).astype(np.uint8)
    return np.packbits(parity), starts // 8


def _profiles(ranks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=1_000_000):
            h, at = ordered_sets(batch.column("text"), ranks)
            n = np.diff(at)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
            node = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(n.astype(np.uint64)))
            sizes = np.where(n > 0, prefix_size(n), 0)
            first = h[ragged(at[:-1], sizes)]
            bits, starts = bitmaps(h, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("c"), pa.array(n), pa.array(node.view(np.int64)), binary_rows(first, np.concatenate([[0], np.cumsum(sizes)])).cast(pa.binary()), binary_rows(bits, starts).cast(pa.binary())],
                ["d", "c", "n", "node", "prefix", "bits"],
            )

    return run


def _postings(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column="prefix", limit=4_000_000):
            lists = batch.column("prefix").to_pylist()
            sizes = np.array([len(x) // 8 for x in lists], np.int64)
            # prefixes hold the least hashes, so these are mixed once more to be dealt evenly
            token = mix(np.frombuffer(b"".join(lists), np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            own = np.repeat(np.arange(len(lists), dtype=np.uint32), sizes)
            pos = ragged(np.zeros(len(sizes), np.int64), sizes).astype(np.uint32)
            order = np.argsort(token, kind="stable")
            token, own, pos = token[order], own[order], pos[order]
            at = np.searchsorted(token >> np.uint64(64 - width), np.arange((1 << width) + 1))
            node, n = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            rows = []
            for b in range(1 << width):
                s = slice(at[b], at[b + 1])
                if at[b] < at[b + 1]:
                    some, index = np.unique(own[s], return_inverse=True)
                    rows.append((b, pack(token[s], index.astype(np.uint32), pos[s], node[some], n[some].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "body"])

    return run


def room(na: np.ndarray, i: np.ndarray, nb: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets whose first common shingle is i of one and j of the other can have enough in common.

    A linked pair passes at its first common shingle, so no link is lost where later ones do not pass.
    """
    return (np.minimum(na - i, nb - j) >= needed(na, nb)) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))


FOUND = "kind int, bucket int, token long, x long, y long, n int, pos int, size int"


def paired(token: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which entries have room with another of their list; in lists of over LONG_LIST + 1 entries all count as such."""
    order = np.lexsort((n, token))
    t, a, p = token[order], n[order], pos[order]
    keep = np.zeros(len(t), bool)
    i = np.arange(len(t))
    for k in range(1, LONG_LIST + 2):
        i = i[i + k < len(t)]
        i = i[t[i + k] == t[i]]
        if not len(i):
            break
        go = i if k > LONG_LIST else i[room(a[i], p[i], a[i + k], p[i + k])]
        keep[go] = keep[go + k] = True
        if k > LONG_LIST:
            keep |= np.isin(t, t[go])
    out = np.empty(len(t), bool)
    out[order] = keep
    return out


def _meet(group: pa.Table) -> pa.Table:
    """kind 0: pairs of a list's leader and another set; kind 1: the other sets that can be linked with each other.

    What has room with the leader alone is decided by kind 0.
    """
    bucket = group.column("bucket")[0].as_py()
    parts = [unpack(b) for b in group.column("body").to_pylist()]
    token, pos = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64)
    node, n = np.concatenate([p[3][p[1]] for p in parts]), np.concatenate([p[4][p[1]] for p in parts]).astype(np.int64)
    order = np.lexsort((mix(node.view(np.uint64)), pos, token))
    token, pos, node, n = token[order], pos[order], node[order], n[order]
    new = np.ones(len(token), bool)
    new[1:] = token[1:] != token[:-1]
    group_of = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group_of]
    star = ~new & room(n, pos, n[head], pos[head])
    x, y = node[head][star], node[star]
    pairs = np.unique(np.stack([x, y]), axis=1) if len(x) else np.empty((2, 0), np.int64)
    m, rest = pairs.shape[1], np.flatnonzero(~new)
    rest = rest[paired(token[rest], n[rest], pos[rest])]
    k, sizes = len(rest), np.bincount(group_of[rest], minlength=1)[group_of[rest]]
    none = np.arange(m + k) < m
    token = np.concatenate([np.zeros(m, np.int64), token[rest].view(np.int64)])
    return pa.table(
        [
            pa.array(np.where(none, 0, 1).astype(np.int32)),
            pa.array(np.full(m + k, bucket, np.int32)),
            pa.array(token, mask=none),
            pa.array(np.concatenate([pairs[0], node[rest]])),
            pa.array(np.concatenate([pairs[1], np.zeros(k, np.int64)]), mask=~none),
            pa.array(np.concatenate([np.zeros(m, np.int64), n[rest]]).astype(np.int32), mask=none),
            pa.array(np.concatenate([np.zeros(m, np.int64), pos[rest]]).astype(np.int32), mask=none),
            pa.array(np.concatenate([np.zeros(m, np.int64), sizes]).astype(np.int32), mask=none),
        ],
        [c.split()[0] for c in FOUND.split(", ")],
    )


class Bitmaps:
    """Parity bitmaps of a list's sets, rows of a matrix for each width, and the same folded to half the width."""

    def __init__(self, bits: list[bytes]):
        self.width = np.array([len(x) for x in bits], np.int64)
        self.row = np.zeros(len(bits), np.int64)
        self.full: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            m = np.frombuffer(b"".join(bits[k] for k in own), np.uint8).reshape(len(own), w)
            self.full[w], self.half[w] = m, m[:, : w // 2] ^ m[:, w // 2 :]

    def differ(self, i: int, j: np.ndarray) -> np.ndarray:
        """Bits in which set i and sets j, of the same width or twice it, differ: no more than their shingles do."""
        w = int(self.width[i])
        own = self.full[w][self.row[i]]
        out = np.zeros(len(j), np.int64)
        same = self.width[j] == w
        for pick, of in ((same, self.full.get(w)), (~same, self.half.get(2 * w))):
            if pick.any():
                out[pick] = np.bitwise_count(of[self.row[j[pick]]] ^ own).sum(axis=1)
        return out


class Blocks:
    """A list's sets by size, in blocks with summaries."""

    def __init__(self, n: np.ndarray, pos: np.ndarray):
        self.n, self.pos, self.reach = n, pos, np.searchsorted(n, (5 * n) // 4, "right")
        starts = np.arange(0, len(n), BLOCK)
        self.least, self.room = n[starts], np.maximum.reduceat(n - pos, starts)
        self.skipped = self.seen = 0

    def after(self, i: int) -> np.ndarray:
        """The sets behind set i that are not skipped with their block, nor too large."""
        stop = int(self.reach[i])
        blocks = np.arange((i + 1) // BLOCK, -(-stop // BLOCK))
        bound = needed(self.n[i], self.least[blocks])
        go = (self.room[blocks] >= bound) & (self.n[i] - self.pos[i] >= bound)
        self.seen, self.skipped = self.seen + len(blocks), self.skipped + int((~go).sum())
        j = (blocks[go, None] * BLOCK + np.arange(BLOCK)).ravel()
        return j[(j > i) & (j < stop)]


def _across(group: pa.Table) -> pa.Table:
    """Pairs of a list's sets in different components that nothing rules out.

    Blocks without room are skipped whole, then sets with too little room or too many different bits. In long
    lists a pair is left to the list of its first common shingle: what stands before in both is compared.
    """
    token, node, label = (group.column(c).to_numpy() for c in ("token", "x", "label"))
    n, pos = group.column("n").to_numpy().astype(np.int64), group.column("pos").to_numpy().astype(np.int64)
    order = np.lexsort((pos, n, token))
    edges = np.append(np.flatnonzero(np.append(True, np.diff(token[order]) != 0)), len(token))
    mixed = [(a, b) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if (label[order[a:b]] != label[order[a]]).any()]
    out, held = [np.empty((2, 0), np.int64)], 0
    bits, earlier = group.column("bits").to_pylist() if mixed else [], group.column("earlier")
    for a, b in mixed:
        own = order[a:b]
        ln, lp, ll, lx = n[own], pos[own], label[own], node[own]
        maps = Bitmaps([bits[k] for k in own])
        before = [np.frombuffer(earlier[k].as_py(), np.uint64) for k in own] if b - a > LONG_LIST else None
        blocks = Blocks(ln, lp)
        for i in range(len(own) - 1):
            j = blocks.after(i)
            j = j[(ll[j] != ll[i]) & room(ln[j], lp[j], ln[i], lp[i])]
            if len(j):
                j = j[maps.differ(i, j) <= ln[i] + ln[j] - 2 * needed(ln[i], ln[j])]
                if before is not None and len(before[i]) and len(j):
                    counts = np.array([len(before[k]) for k in j])
                    hit = np.isin(np.concatenate([before[k] for k in j]), before[i])
                    j = j[np.bincount(np.repeat(np.arange(len(j)), counts), weights=hit, minlength=len(j)) == 0]
                out.append(np.stack([np.minimum(lx[i], lx[j]), np.maximum(lx[i], lx[j])]))
                held += len(j)
                if held > 1_000_000:
                    out, held = [np.unique(np.concatenate(out, axis=1), axis=1)], 0
    pairs = np.unique(np.concatenate(out, axis=1), axis=1)
    return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles in both of two sets in order of their hashes."""
    if len(a) < len(b):
        a, b = b, a
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum()) if len(b) else 0


def likenesses(sets: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray] | None]:
    """For each set a highly similar one before it, and what only that one and only this one has.

    Sets meet by their least shingle (under a hash of its own), which similar sets mostly share; whether the two are
    alike is then seen from what they differ in: at most a quarter of the set's size.
    """
    first: dict[int, int] = {}
    out: list[tuple[int, np.ndarray, np.ndarray] | None] = []
    for k, h in enumerate(sets):
        lead = first.setdefault(int(mix(h ^ np.uint64(0xA24BAED4963EE407)).min()), k)
        gone = more = h[:0]
        if lead != k:
            gone, more = np.setdiff1d(sets[lead], h, assume_unique=True), np.setdiff1d(h, sets[lead], assume_unique=True)
        out.append((lead, gone, more) if lead != k and 4 * (len(gone) + len(more)) <= len(h) else None)
    return out


def answers(own: np.ndarray, partners: list[int], sets: list[np.ndarray], like: list) -> tuple[list[bool], int]:
    """Whether own is linked with each partner, and how many of these answers come from a similar set's."""
    found = answered(own, partners, sets, like)
    return [linked for linked, _ in found], sum(derived for _, derived in found)


def answered(own: np.ndarray, partners: list[int], sets: list[np.ndarray], like: list) -> list[tuple[bool, bool]]:
    """For each partner whether own is linked with it, and whether that comes from a similar set's answer.

    The overlap with the similar set is computed once. It bounds the overlap with the partner by what the two differ
    in; where the bounds leave it open, own is met with the few shingles that differ, never with the whole set.
    """
    led = Counter(like[k][0] for k in partners if like[k] is not None)
    led.update(k for k in partners if k in led)
    known: dict[int, int] = {}
    out: list[tuple[bool, bool]] = []
    for k in partners:
        least = int(needed(np.int64(len(own)), np.int64(len(sets[k]))))
        lead = k if like[k] is None or led[like[k][0]] < 2 else like[k][0]
        if lead not in known:
            known[lead] = common(own, sets[lead])
        n = known[lead]
        if lead != k:
            gone, more = like[k][1:]
            if n - len(gone) >= least or n + len(more) < least:
                out.append((n - len(gone) >= least, True))
                continue
            n += common(own, more) - common(own, gone)
        out.append((n >= least, lead != k))
    return out


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among groups in order: a set (y null), then its partners. Each text of a piece is cut once."""
    z = zstandard.ZstdDecompressor()
    group, own = None, None
    for batch in pieces(batches, column="z", limit=1_000_000):
        texts = [z.decompress(body).decode() for body in batch.column("z").to_pylist()]
        h, at = ordered_sets(pa.array(texts, pa.large_string()), np.zeros(CELLS, np.uint8))
        sets = [h[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        x, y, g = (batch.column(c) for c in ("x", "y", "g"))
        keys = list(zip(x.to_pylist(), g.to_pylist()))
        first = y.is_null().to_pylist()
        keep, derived = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        starts = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            if first[a]:
                group, own, a = keys[a], sets[a], a + 1
            if a < b:
                assert group == keys[a], "a set stands before its partners"
                some = sets[a:b]
                keep[a:b], derived[a:b] = zip(*answered(own, list(range(b - a)), some, likenesses(some)))
        out = pa.RecordBatch.from_arrays([x, y, pa.array(derived)], ["x", "y", "derived"])
        yield out.filter(pa.array(keep))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """x, y, derived: the pairs that are links. A set's partners come to it, not it to each of them."""
    spread = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a pair that two lists lead in both ways is asked once
    low, high = F.least("x", "y"), F.greatest("x", "y")
    once = pairs.groupBy(low.alias("a"), high.alias("b")).agg(F.min("x").alias("x")).select("x", F.when(F.col("x") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("y"))
    once = table(once, "pairs")  # read three times below
    groups = once.groupBy("x").agg(F.ceil(F.count("*") / PARTNERS).alias("groups"))
    side = once.join(groups, "x").select("x", "y", F.pmod(F.xxhash64("y"), "groups").alias("g"))
    own = groups.select("x", F.lit(None).cast("long").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("g"))
    # sets and partners meet the texts in one join, so that texts are dealt once
    asked = own.unionByName(side).withColumn("node", F.coalesce("y", "x")).join(texts, "node").select("x", "g", "y", "z")
    dealt = asked.repartition(spread, "x", "g").sortWithinPartitions("x", "g", F.col("y").asc_nulls_first())
    return dealt.mapInArrow(_check, "x long, y long, derived boolean")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    width = max(4, (parts - 1).bit_length())
    given = keyed(docs)
    ranks = spark.sparkContext.broadcast(sketch(given))  # CELLS bytes

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _profiles(ranks.value)(batches)

    found = table(given.mapInArrow(profiles, "d long, c long, n long, node long, prefix binary, bits binary"), "profiles")
    some = found.where("n > 0")
    first = some.groupBy("node").agg(F.min("d").alias("least"), F.min_by("c", F.struct("d", "c")).alias("c"))
    one = some.select("node", "n", "prefix").dropDuplicates(["node"])
    lists = one.mapInArrow(_postings(width), "bucket int, body binary").groupBy("bucket").applyInArrow(_meet, FOUND)
    lists = table(lists, "lists")
    star = lists.where("kind = 0").select("x", "y").distinct()
    entries = lists.where("kind = 1")
    named = lists.select(F.explode(F.array("x", "y")).alias("node")).where("node is not null").distinct()
    wanted = first.join(named, "node").select(F.col("least").alias("d"), "c", "node")
    texts = table(given.mapInArrow(_packed, "d long, c long, z binary").join(wanted, ["d", "c"]).select("node", "z").dropDuplicates(["node"]), "texts")
    near = table(_links(star, texts), "near").select("x", "y")
    labels = components(near)
    maps = some.select(F.col("node").alias("x"), "bits", "prefix").dropDuplicates(["x"])
    placed = entries.join(labels.withColumnRenamed("node", "x"), "x", "left").withColumn("label", F.coalesce("label", "x"))
    earlier = F.when(F.col("size") > LONG_LIST, F.substring(F.col("prefix"), F.lit(1), F.col("pos") * 8)).otherwise(F.lit(b""))
    placed = placed.drop("y", "kind").join(maps, "x").withColumn("earlier", earlier).drop("prefix")
    close = placed.groupBy("bucket").applyInArrow(_across, "x long, y long").distinct()
    more = table(_links(close, texts), "more").select("x", "y")
    labels = components(more, labels)
    least = first.select("node", "least").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = least.groupBy("label").agg(F.min("least").alias("component"))
    of = least.select("node", "label").join(lowest, "label").select("node", "component")
    shown = lambda c: F.when(F.col(c) == NULL_ID, None).otherwise(F.col(c))
    out = found.select("d", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(of, "node", "left")
    return out.select(shown("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce(shown("component"), F.when(F.col("component").isNull(), shown("d"))).alias("component_id"))
