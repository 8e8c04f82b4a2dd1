"""Which intervals hold which points: one sorted sweep with the open intervals at hand.

Places are cut into buckets of `2**bits`; a point goes to its bucket, an interval to each bucket that it touches, and
rows are dealt by group and bucket, so a group may be of any size. A task reads its rows in order of place, once,
with a stack of the intervals that are open: what has ended comes off, and every point is written with what is left.
Nested intervals (blocks of documents) are a stack proper; where intervals cross, those that have ended below the
top stay until they come up and are passed over. The work is that of the sort and of the pairs that come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs that are held before they are written.
HELD = 100_000


class Sweep:
    """Open intervals, innermost last, and pairs found."""

    def __init__(self) -> None:
        self.group, self.open, self.pairs = None, [], []

    def enter(self, group: tuple) -> None:
        if group != self.group:
            self.group, self.open = group, []

    def close(self, at: int) -> None:
        while self.open and self.open[-1][0] <= at:
            self.open.pop()

    def add(self, key: int, at: int, end: int | None, row: int) -> None:
        """An interval (key, at, end) or, without an end, a point that stands in row `row`."""
        self.close(at)
        if end is not None:
            self.open.append((end, key))
            return
        depth = 0
        for until, container in self.open:
            if until > at:
                depth += 1
                self.pairs.append((row, container, depth))


def contained(intervals: DataFrame, points: DataFrame, by: list[str], bits: int = 12) -> DataFrame:
    """by, container, point, depth: pairs with start <= at < end; depth counts from the outermost open interval.

    intervals: by, container (long), start, end; points: by, point (long), at; places are longs. Intervals that hold
    nothing (end <= start) and rows with a null in by or a place pair with nothing. Of intervals with one start the
    longer is the outer one.
    """
    known = lambda names: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in names])
    width = F.lit(1 << bits).cast("long")
    touched = F.explode(F.sequence(F.shiftright("start", bits), F.shiftright(F.col("end") - 1, bits)))
    wide = intervals.where(known([*by, "start", "end"]) & (F.col("start") < F.col("end"))).select(*by, touched.alias("_bucket"), F.col("container").cast("long").alias("_key"), F.col("start").cast("long").alias("_start"), F.col("end").cast("long").alias("_end"))
    rows = wide.select(*by, "_bucket", "_key", F.greatest("_start", F.col("_bucket") * width).alias("_at"), "_start", "_end")
    spots = points.where(known([*by, "at"])).select(*by, F.shiftright(F.col("at").cast("long"), bits).alias("_bucket"), F.col("point").cast("long").alias("_key"), F.col("at").cast("long").alias("_at"), F.lit(None).cast("long").alias("_start"), F.lit(None).cast("long").alias("_end"))
    kinds = {f.name: f for f in rows.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c].dataType.simpleString()}" for c in by] + ["container long", "point long", "depth int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep()
        for batch in batches:
            groups = list(zip(*[batch.column(c).to_pylist() for c in [*by, "_bucket"]]))
            keys = batch.column("_key")
            for k, (key, at, end) in enumerate(zip(keys.to_pylist(), batch.column("_at").to_pylist(), batch.column("_end").to_pylist())):
                sweep.enter(groups[k])
                sweep.add(key, at, end, k)
                if len(sweep.pairs) >= HELD or k == batch.num_rows - 1 and sweep.pairs:
                    row, container, depth = zip(*sweep.pairs)
                    at_row = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(c).take(at_row) for c in by] + [pa.array(container, pa.int64()), keys.take(at_row), pa.array(depth, pa.int32())], [*by, "container", "point", "depth"])
                    sweep.pairs.clear()

    order = [*by, "_bucket", F.col("_at"), F.col("_end").isNull(), F.col("_start"), F.col("_end").desc()]
    return rows.unionByName(spots).repartition(*by, "_bucket").sortWithinPartitions(*order, "_key").mapInArrow(run, schema)
