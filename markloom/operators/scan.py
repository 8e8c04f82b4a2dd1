"""Running values over ordered rows, and as-of joins made of them, in windows that no group can fill.

A window over a whole group puts the group in one task. Here a group is cut into chunks of `2**bits` places: a
window runs in each chunk, one row a chunk carries on what the chunk leaves behind, and a window over those rows
(a few thousand for the longest group) gives what stands before each chunk. Everything is built-in columns.

Rows whose place is null come before all others of their group and are a chunk of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
_BEFORE = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def place(df: DataFrame, at: str) -> Column:
    """A long that is in the order of at: itself, or microseconds of a time."""
    kind = df.schema[at].dataType.typeName()
    return F.unix_micros(F.col(at).cast("timestamp")) if kind in ("timestamp", "timestamp_ntz", "date") else F.col(at).cast("long")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names])


def last_values(df: DataFrame, by: list[str], at: str, values: dict[str, Column], ties: list[Column] | None = None, bits: int = BITS) -> DataFrame:
    """df with, for each of values, the last of its group that is not null, up to and with the row.

    Rows are in the order of at and then of ties, which should leave none equal.
    """
    order, chunk = [F.col(at).asc_nulls_first(), *(ties or [])], "_chunk"
    rows = df.select("*", F.shiftright(place(df, at), bits).alias(chunk), *[v.alias(f"_v_{n}") for n, v in values.items()])
    rows = rows.withColumn("_at", F.struct(*[F.col(at), *(ties or [])]))
    inner = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(*_SO_FAR)
    local = rows.select("*", *[F.last(f"_v_{n}", ignorenulls=True).over(inner).alias(f"_l_{n}") for n in values])
    ends = rows.groupBy(*by, chunk).agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col("_at"))).alias(f"_e_{n}") for n in values])
    outer = Window.partitionBy(*by).orderBy(F.col(chunk).asc_nulls_first()).rowsBetween(*_BEFORE)
    before = ends.select(*by, chunk, *[F.last(f"_e_{n}", ignorenulls=True).over(outer).alias(f"_b_{n}") for n in values])
    out = local.join(before, _same(local, before, [*by, chunk]), "left")
    return out.select(*[local[c] for c in df.columns], *[F.coalesce(local[f"_l_{n}"], before[f"_b_{n}"]).alias(n) for n in values])


def running_sums(df: DataFrame, by: list[str], at: str, values: dict[str, Column], ties: list[Column] | None = None, bits: int = BITS) -> DataFrame:
    """df with the sum of each of values over its group up to and with the row; null counts as nothing."""
    order, chunk, none = [F.col(at).asc_nulls_first(), *(ties or [])], "_chunk", F.lit(0).cast("long")
    rows = df.select("*", F.shiftright(place(df, at), bits).alias(chunk), *[F.coalesce(v.cast("long"), none).alias(f"_v_{n}") for n, v in values.items()])
    inner = Window.partitionBy(*by, chunk).orderBy(*order).rowsBetween(*_SO_FAR)
    local = rows.select("*", *[F.sum(f"_v_{n}").over(inner).alias(f"_l_{n}") for n in values])
    totals = rows.groupBy(*by, chunk).agg(*[F.sum(f"_v_{n}").alias(f"_e_{n}") for n in values])
    outer = Window.partitionBy(*by).orderBy(F.col(chunk).asc_nulls_first()).rowsBetween(*_BEFORE)
    before = totals.select(*by, chunk, *[F.coalesce(F.sum(f"_e_{n}").over(outer), none).alias(f"_b_{n}") for n in values])
    out = local.join(before, _same(local, before, [*by, chunk]), "left")
    return out.select(*[local[c] for c in df.columns], *[(local[f"_l_{n}"] + F.coalesce(before[f"_b_{n}"], none)).alias(n) for n in values])


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, columns: list[str], within: int | None = None, strict: bool = False, ties: list[str] | None = None, bits: int = BITS) -> DataFrame:
    """All rows of left with columns of the last row of right of the same group whose at is not later (strict: earlier).

    Both have by and at; left must not have columns. Of right's rows with one at the greatest by ties (else by columns)
    counts. within: no match that lies further back (in units of `place`). Null groups and places match nothing.

    Both sides are united in one order and the last row of right is carried on, so nothing is compared pair by pair.
    """
    names = [c for c in left.columns]
    order = ties or columns
    found = F.struct(place(right, at).alias("_at"), *[F.col(c).alias(f"_t_{k}") for k, c in enumerate(order)], *columns)
    sides = right.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, at]])).select(*by, at, found.alias("_right"))
    mine = left.select(*[F.col(c) for c in [*by, at]], F.struct(*names).alias("_row"))
    both = mine.unionByName(sides, allowMissingColumns=True)
    side = F.when(F.col("_right").isNull(), F.lit(0 if strict else 2)).otherwise(1)
    done = last_values(both, by, at, {"_found": F.col("_right")}, [side, F.col("_right")], bits).where("_row is not null")
    near = F.lit(True) if within is None else place(both, at) - F.col("_found._at") <= within
    return done.select(*[F.col("_row")[c].alias(c) for c in names], *[F.when(near, F.col("_found")[c]).alias(c) for c in columns])
