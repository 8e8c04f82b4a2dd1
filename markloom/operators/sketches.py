"""Counts of distinct values over cubes from stored sketches.

`daily` makes one sketch for each finest cell, once; such tables can be kept, appended to by day and united. `cubed`
merges them into every level: sketches merge where distinct counts do not add up, so no level reads the data again.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_SIZE = 12


def error(log_size: int = LOG_SIZE) -> float:
    """Standard error of an estimate, as a share of the count."""
    return 1.04 / sqrt(1 << log_size)


def daily(df: DataFrame, by: list[str], value: str, log_size: int = LOG_SIZE) -> DataFrame:
    """by, n, sketch: rows and a sketch of the values of each cell; null values are no values."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(value, log_size).alias("sketch"))


def merged(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, n, sketch of coarser cells, or of cells of several tables."""
    return cells.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def cubed(cells: DataFrame, by: list[str]) -> DataFrame:
    """Every combination of by and of all (level: grouping_id), n and the estimated number of distinct values."""
    levels = cells.cube(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"), F.grouping_id().alias("level"))
    return levels.select(*by, "level", "n", F.hll_sketch_estimate("sketch").alias("n_distinct"), "sketch")
