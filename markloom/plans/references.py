"""Labels that are used and labels that are defined, met by a join on a folded key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import native


def first_definitions(definitions: DataFrame, by: list[str], order: str, label: str = "label") -> DataFrame:
    """Of each group and folded label the definition that comes first: by, key, and the other columns; n_definitions."""
    rest = [c for c in definitions.columns if c not in by]
    keyed = definitions.withColumn("key", native.label_key(label)).where("key <> ''")
    first = keyed.groupBy(*by, "key").agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("_d"), F.count("*").alias("n_definitions"))
    return first.select(*by, "key", *[F.col("_d")[c].alias(c) for c in rest], "n_definitions")


def resolved(uses: DataFrame, definitions: DataFrame, by: list[str], order: str, columns: list[str], label: str = "label") -> DataFrame:
    """uses with columns of the definition that counts, null where there is none."""
    first = first_definitions(definitions, by, order, label).select(*by, F.col("key").alias("_key"), *columns)
    return uses.withColumn("_key", native.label_key(label)).join(first, [*by, "_key"], "left").drop("_key")


def label_report(uses: DataFrame, definitions: DataFrame, by: list[str], order: str, columns: list[str], label: str = "label") -> DataFrame:
    """by, key, status (used, unused, undefined), n_uses, n_definitions and columns of the definition that counts.

    Both sides are counted by label before they meet, so a label that is used everywhere is one row.
    """
    used = uses.select(*by, native.label_key(label).alias("key")).where("key <> ''").groupBy(*by, "key").agg(F.count("*").alias("n_uses"))
    first = first_definitions(definitions, by, order, label).select(*by, "key", "n_definitions", *columns)
    none = F.lit(0).cast("long")
    both = used.join(first, [*by, "key"], "full")
    status = F.when(F.col("n_uses").isNull(), "unused").when(F.col("n_definitions").isNull(), "undefined").otherwise("used")
    return both.select(*by, "key", status.alias("status"), F.coalesce("n_uses", none).alias("n_uses"), F.coalesce("n_definitions", none).alias("n_definitions"), *columns)
