"""Counters of the compiler over tables: each task adds up its documents, an aggregate adds up the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..kernel.counters import SUMS, Counts, ShapedCounts
from ..kernel.options import options as of

#: Groups whose counts a task holds before it writes them.
HELD = 10_000


def partial(docs: DataFrame, by: str, options=None, text: str = "text") -> DataFrame:
    """by and counts, a row (or a few) for each value of by in each task."""
    counts = ShapedCounts(of(options))
    names = [*SUMS, "longest_inline"]

    def out(held: dict, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), kind), *(pa.array([getattr(c, n) for c in held.values()], pa.int64()) for n in names)], [by, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for group, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(group, Counts()).add(Counts(documents=1) if s is None else counts(s))
            if len(held) > HELD:
                yield out(held, batch.column(0).type)
                held = {}
        if held:
            yield out(held, batch.column(0).type)

    return docs.select(by, text).mapInArrow(run, ", ".join([f"`{by}` {docs.schema[by].dataType.simpleString()}", *(f"{n} long" for n in names)]))


def profile(docs: DataFrame, by: str, options=None, text: str = "text", seen: Observation | None = None) -> DataFrame:
    """by and counts; with an Observation also their totals, once the result has been computed."""
    parts = partial(docs, by, options, text)
    if seen is not None:
        parts = parts.observe(seen, *[F.sum(n).alias(n) for n in SUMS], F.max("longest_inline").alias("longest_inline"))
    return parts.groupBy(by).agg(*[F.sum(n).alias(n) for n in SUMS], F.max("longest_inline").alias("longest_inline"))
