"""Prefix trie of conversations that are rebuilt on heads of others, by fingerprints that compose.

A sequence of turns has a fingerprint: its length n and, in two lanes of 64 bits, the value h of the turns' hashes
as the digits of a number in base K. Sequences one after another are (n, h) (m, k) = (n + m, h K**m + k), which is
associative and has inverses on the left as K is odd: the product of a conversation's turns after its first h is
taken from products of its own prefixes, and put behind the product of its base's head. So a rebuilt
conversation's prefixes get their fingerprints from stored turns (conv_id, position); no rebuilt text is made.

Turns are sorted over all partitions, so a conversation may have any share of the rows; products are taken within a
partition and carried over partition borders (a row or two for each partition goes through the driver). Every stored turn
stands at one node only. Equality does not rest on hashes: all stored turns of a node are compared as they are, role
and text, and so are their parents' fingerprints, depth by depth; should two differ, everything is done again with
other bases. Sums over subtrees come without recursion: each node belongs to its smallest member, a conversation owns
the lower end of its path, and what it owns counts at every node above that end.

conv_id has no conversation where it is null; such rows are left out. Turns of a conversation are ordered by turn (null first), then role, then text; repeated rows are turns
of their own. Other columns are ignored; an empty table has no conversation, and no root. A node's ids are hashed in
order as they come from a sort (no list of them is held), in blocks of at most 4,096 made before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, table, utf8, words

HEADS, STEP = 4, 20
#: Depths that are summed in one piece, and conv_ids in one block, as powers of two.
CHUNK, BLOCK = 16, 12
FINGERPRINT = ["f", "g"]


def bases(seed: int) -> np.ndarray:
    """An odd base for each lane."""
    return np.random.default_rng(seed + 71).integers(1, 1 << 62, 2, dtype=np.uint64) * np.uint64(4) + np.uint64(3)


def power(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """base**n modulo 2**64."""
    out, square, n = np.ones(len(n), np.uint64), int(base), n.astype(np.uint64)
    while n.any():
        out = np.where(n & np.uint64(1), out * np.uint64(square), out)
        n = n >> np.uint64(1)
        square = square * square % (1 << 64)
    return out


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def turn_hashes(role: pa.Array, text: pa.Array, seed: int) -> np.ndarray:
    """Two lanes for each turn; role and text are told apart."""
    key = seed.to_bytes(8, "little")
    out = np.empty((len(role), 2), np.uint64)
    for k, (r, t) in enumerate(zip(role, text)):
        r, t = r.as_py().encode(), t.as_py().encode()
        out[k] = np.frombuffer(hashlib.blake2b(len(r).to_bytes(8, "little") + r + t, digest_size=16, key=key).digest(), "<u8")
    return out


def products(conv: np.ndarray, hashes: np.ndarray, k: np.ndarray, carry: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Positions (from 1) and products of each conversation's turns up to each, rows in order; carry: (conv, n, lanes)."""
    n = len(conv)
    first = np.ones(n, bool)
    first[1:] = conv[1:] != conv[:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    at = np.arange(n) - start + 1
    out = np.empty((n, 2), np.uint64)
    for lane in (0, 1):
        up, down = power(k[lane], np.arange(n + 1)), power(inverse(k[lane]), np.arange(n + 1))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes[:, lane] * down[1:], dtype=np.uint64)])
        out[:, lane] = (total[1:] - total[start]) * up[1:]
    if carry is not None and carry[0] == conv[0]:
        on = conv == conv[0]
        on &= np.cumsum(first) == 1
        for lane in (0, 1):
            out[on, lane] += carry[2][lane] * power(k[lane], at[on])
        at[on] += carry[1]
    return at, out, (conv[-1], int(at[-1]), out[-1].copy())


_STORED = "part int, conv_id long, at long, p long, q long, t long, u long, words long, role string, text string"


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def stored(conversations: DataFrame, seed: int) -> DataFrame:
    """Turns in order with their places and products, as far as their partition knows them; written as a table."""
    k = bases(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry = TaskContext.get().partitionId(), None
        for batch in pieces(batches):
            conv = batch.column("conv_id").to_numpy()
            hashes = turn_hashes(batch.column("role"), batch.column("text"), seed)
            at, product, carry = products(conv, hashes, k, carry)
            data, offsets = utf8(batch.column("text"))
            n_words = np.diff(words(data, offsets)[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(conv), part, np.int32)), batch.column("conv_id"), pa.array(at), *map(_signed, (product[:, 0], product[:, 1], hashes[:, 0], hashes[:, 1])), pa.array(n_words.astype(np.int64)), batch.column("role"), batch.column("text")],
                ["part", "conv_id", "at", "p", "q", "t", "u", "words", "role", "text"],
            )

    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a text's first letters only, as keys are sampled; rows that are equal so far stay together
    dealt = rows.repartitionByRange(spread, "conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32))
    return table(dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text").mapInArrow(run, _STORED), "turns")


def carried(turns: DataFrame, seed: int) -> dict[int, tuple[int, int, int, int]]:
    """For each partition that begins inside a conversation: its conv_id, and the turns and the product before it.

    A partition has at most one conversation that began before it, so this is a row a partition.
    """
    k = [int(x) for x in bases(seed)]
    last = turns.groupBy("conv_id", "part").agg(F.max("at").alias("n"), F.max_by(F.struct("p", "q"), "at").alias("e"))
    many = last.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n", "e"))).alias("x")).where("size(x) > 1")
    out: dict[int, tuple[int, int, int, int]] = {}
    for row in many.collect():
        n, product = 0, [0, 0]
        for x in row["x"]:
            if n:
                out[x["part"]] = (row["conv_id"], n, *product)
            product = [(a * pow(b, x["n"], 1 << 64) + c) % (1 << 64) for a, b, c in zip(product, k, (x["e"]["p"], x["e"]["q"]))]
            n += x["n"]
    return out


def placed(turns: DataFrame, before: dict[int, tuple[int, int, int, int]], seed: int) -> DataFrame:
    """The same with places and products within whole conversations."""
    if not before:
        return turns
    k = bases(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv = batch.column("part").to_numpy(), batch.column("conv_id").to_numpy()
            at, lanes = batch.column("at").to_numpy().copy(), [batch.column(c).to_numpy().copy().view(np.uint64) for c in "pq"]
            for x in np.unique(part):
                if int(x) not in before:
                    continue
                of, n, *product = before[int(x)]
                on = (part == x) & (conv == of)
                for lane in (0, 1):
                    lanes[lane][on] += np.uint64(product[lane]) * power(k[lane], at[on])
                at[on] += n
            columns = dict(zip(batch.schema.names, batch.columns)) | {"at": pa.array(at), "p": _signed(lanes[0]), "q": _signed(lanes[1])}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return turns.mapInArrow(run, turns.schema)


def plans(turns: DataFrame) -> DataFrame:
    """How each conversation is rebuilt: turns taken from its base (head) with their products, what its own turns lose (cut), n and length."""
    near = turns.where(f"at < {HEADS}")
    first = near.groupBy("conv_id").agg(*[F.max(F.when(F.col("at") == k, F.col(c))).alias(f"{c}{k}") for k in range(1, HEADS) for c in "pq"])
    size = turns.groupBy("conv_id").agg(F.max("at").alias("n"))
    every = size.join(first, "conv_id")
    c = F.col("conv_id")
    # a base keeps its turns whatever its h, as its head is its own
    own = every.withColumn("base", c - c % STEP).withColumn("h", F.when(F.col("base") == c, 0).otherwise(F.crc32(c.cast("string")) % HEADS))
    base = every.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), *[F.col(f"{x}{k}").alias(f"base_{x}{k}") for k in range(1, HEADS) for x in "pq"])
    both = own.join(base, "base", "left")
    both = both.withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("cut", F.least("h", "n"))
    pick = lambda names, at: F.coalesce(*[F.when(F.col(at) == k, F.col(x)) for k, x in enumerate(names, 1)], F.lit(0).cast("long"))
    return both.select(
        "conv_id", "n", "head", "cut", (F.col("head") + F.col("n") - F.col("cut")).alias("length"),
        *[pick([f"base_{x}{k}" for k in range(1, HEADS)], "head").alias(f"head_{x}") for x in "pq"],
        *[pick([f"{x}{k}" for k in range(1, HEADS)], "cut").alias(f"cut_{x}") for x in "pq"],
        F.array(F.struct(F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("g")), *[F.struct(F.col(f"base_p{k}").alias("f"), F.col(f"base_q{k}").alias("g")) for k in range(1, HEADS)]).alias("heads"),
    )


def own_paths(turns: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Nodes of conversations' own turns after their heads: conv_id, depth, f, g, up_f, up_g (the parent's), last, words, role, text."""
    k = bases(seed)
    schema = "conv_id long, depth long, f long, g long, up_f long, up_g long, last boolean, words long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(name).to_numpy()
            bits = lambda name: get(name).view(np.uint64)
            m = get("at") - get("cut")
            lanes, ups = [], []
            for lane, (x, y) in enumerate((("p", "t"), ("q", "u"))):
                # the head's product, the inverse of what is cut, then the own prefix
                f = bits(x) + (bits(f"head_{x}") - bits(f"cut_{x}")) * power(k[lane], m)
                lanes.append(f)
                ups.append((f - bits(y)) * inverse(k[lane]))
            columns = [batch.column("conv_id"), pa.array(get("head") + m), *map(_signed, (*lanes, *ups)), pa.array(get("at") == get("n")), batch.column("words"), batch.column("role"), batch.column("text")]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    # a long conversation's turns are joined in pieces, so that its key does not grow with it
    piece = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("n", CHUNK))).alias("piece")).drop("heads", "length")
    rows = turns.withColumn("piece", F.shiftright("at", CHUNK)).drop("part").join(piece, ["conv_id", "piece"]).where("at > cut")
    rows = rows.select("conv_id", "at", "n", *[F.col(x).cast("long").alias(x) for x in ("cut", "head")], "p", "q", "t", "u", "head_p", "head_q", "cut_p", "cut_q", "words", "role", "text")
    return rows.mapInArrow(run, schema)


def head_paths(plan: DataFrame) -> DataFrame:
    """Nodes of the roots and heads: conv_id, depth, f, g, up_f, up_g, last; their turns are stored with the bases."""
    at = F.explode(F.sequence(F.lit(0), F.col("head").cast("int"))).alias("depth")
    rows = plan.select("conv_id", "heads", "length", at)
    here, up = F.element_at("heads", F.col("depth") + 1), F.when(F.col("depth") > 0, F.element_at("heads", F.greatest("depth", F.lit(1))))
    return rows.select("conv_id", F.col("depth").cast("long").alias("depth"), here["f"].alias("f"), here["g"].alias("g"), up["f"].alias("up_f"), up["g"].alias("up_g"), (F.col("depth") == F.col("length")).alias("last"))


def differing(own: DataFrame) -> DataFrame:
    """Fingerprints whose stored turns, depths or parents are not all the same: least and greatest of each are compared."""
    same = ("depth", "up_f", "up_g", "role", "text")
    groups = own.groupBy(*FINGERPRINT).agg(*[f(x).alias(f"{x}_{n}") for x in same for n, f in (("least", F.min), ("most", F.max))])
    return groups.where(" or ".join(f"{x}_least <> {x}_most" for x in same))


def paths(conversations: DataFrame, seed: int = 1) -> DataFrame:
    """All nodes of all rebuilt conversations (conv_id, depth, f, g, up_f, up_g, last, words) under fingerprints that were verified."""
    while True:
        local = stored(conversations, seed)
        turns = placed(local, carried(local, seed), seed)
        plan = table(plans(turns), "plans")
        own = own_paths(turns, plan, seed)
        if differing(own).isEmpty():
            narrow = own.drop("role", "text")
            return table(narrow.unionByName(head_paths(plan).withColumn("words", F.lit(None).cast("long"))), "paths")
        seed += 1


def ends(rows: DataFrame) -> DataFrame:
    """f, g, ends_sha256 of nodes at which conversations end: a stream of blocks in order through the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for f, g, block in zip(batch.column("f").to_pylist(), batch.column("g").to_pylist(), batch.column("block")):
                if now != (f, g):
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (f, g), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(block.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["f", "g", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], ["f", "g", "ends_sha256"])

    few = rows.where("last").groupBy(*FINGERPRINT, F.shiftright("conv_id", BLOCK).alias("k")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("block"))
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return few.repartition(spread, *FINGERPRINT).sortWithinPartitions(*FINGERPRINT, "k").select(*FINGERPRINT, "block").mapInArrow(run, "f long, g long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = paths(conversations)
    none, piece = F.lit(0).cast("long"), F.shiftright("depth", CHUNK).alias("piece")
    found = rows.groupBy(*FINGERPRINT).agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.coalesce(F.max("words"), none).alias("words"), F.min("up_f").alias("up_f"), F.min("up_g").alias("up_g"))
    below = found.where("depth > 0").groupBy(F.col("up_f").alias("f"), F.col("up_g").alias("g")).agg(F.count("*").alias("n_children"))
    leaf = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    nodes = found.join(below, FINGERPRINT, "left").select(*found.columns, F.coalesce("n_children", none).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), leaf.alias("leaves"), piece)
    nodes = table(nodes, "nodes")

    # what a conversation owns: sums over pieces of its path, where it begins and what it hangs from
    pieces_of = nodes.groupBy("conv_id", "piece").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.min("depth").alias("top"), F.min_by(F.struct("up_f", "up_g"), "depth").alias("up"))
    pieces_of = table(pieces_of, "owned")
    owner = pieces_of.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.min("top").alias("top"), F.min_by("up", "top").alias("up")).select("conv_id", "saved", "leaves", "top", "up.*")
    inner = nodes.where("n_children > 0 and depth > 0").select(F.col("f").alias("up_f"), F.col("g").alias("up_g"), F.col("conv_id").alias("parent"))
    root = F.broadcast(nodes.where("depth = 0").select(F.col("conv_id").alias("parent")))  # one row
    parents = owner.where("top > 1").join(inner, ["up_f", "up_g"]).select("conv_id", "parent").unionByName(owner.where("top = 1").crossJoin(root).select("conv_id", "parent"))
    lower = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    under = pieces_of.select("conv_id", "piece", F.min("top").over(Window.partitionBy("conv_id")).alias("top"), *[F.coalesce(F.sum(x).over(lower), none).alias(f"{x}_lower") for x in ("saved", "leaves")]).join(parents, "conv_id", "left")

    # a node's own part: the rest of its piece and the pieces below
    down = Window.partitionBy("conv_id", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    mine = nodes.select("*", *[F.sum(x).over(down).alias(f"{x}_own") for x in ("saved", "leaves")]).join(under, ["conv_id", "piece"])

    # what others own below it: each counts at the nodes above its own part's top
    others = owner.where("top > 0 and (saved > 0 or leaves > 0)").select("conv_id", "saved", "leaves", "top", F.explode(F.sequence(none, F.shiftright("top", CHUNK))).alias("piece"))
    passed = rows.select("conv_id", "depth", *FINGERPRINT, piece).join(others, ["conv_id", "piece"]).where("depth < top")
    passed = passed.groupBy(*FINGERPRINT).agg(F.sum("saved").alias("saved_others"), F.sum("leaves").alias("leaves_others"))

    out = mine.join(passed, FINGERPRINT, "left").join(ends(rows), FINGERPRINT, "left")
    total = lambda x: (F.col(f"{x}_own") + F.col(f"{x}_lower") + F.coalesce(f"{x}_others", none))
    parent = F.when(F.col("depth") == F.col("top"), F.col("parent")).otherwise(F.col("conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def sql() -> str:
    polynomial = 0xEDB88320
    steps = f"flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, {', '.join(['-1'] * 8)}]))"
    shift = f"case when b >= 0 then xor(a, b) when a & 1 = 1 then xor(a >> 1, {polynomial}) else a >> 1 end"
    return rf"""with t as (select conv_id::bigint as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) as turn from conversations where conv_id is not null),
o as (select c, list(turn order by i) as turns, xor(list_reduce(list_prepend(4294967295::bigint, any_value({steps})), lambda a, b: {shift}), 4294967295) % {HEADS} as h from t group by c),
r as (select o.c, coalesce(b.turns, [])[1:o.h] || o.turns[o.h + 1:] as turns from o left join o b on b.c = o.c - o.c % {STEP}),
p as (select c, len(turns) as n, d, turns[1:d] as prefix from r, lateral (select unnest(range(0, len(turns) + 1)) as d)),
v as (select d, prefix, min(c) as conv_id, count(*) as n_convs, string_agg(c::varchar, ',' order by c) filter (n = d) as ends, case when d = 0 then 0 else len(regexp_extract_all(prefix[d].x, '[^ 	-
]+')) end as words from p group by d, prefix),
k as (select d - 1 as d, prefix[1:d - 1] as prefix, count(*) as n_children from v where d > 0 group by all),
w as (select v.*, coalesce(n_children, 0) as n_children from v left join k on k.d = v.d and k.prefix = v.prefix),
u as (select a as d, prefix[1:a] as prefix, sum((n_convs - 1) * words) as saved, sum((n_children = 0)::int) as leaves from w, lateral (select unnest(range(0, d + 1)) as a) group by all)
select w.conv_id, w.d as depth, q.conv_id as parent_conv_id, w.n_convs, w.n_children, u.leaves::bigint as n_leaves, u.saved::bigint as saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256
from w join u on u.d = w.d and u.prefix = w.prefix left join v q on q.d = w.d - 1 and q.prefix = w.prefix[1:w.d - 1]"""
