"""Readers and writers of document trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_documents(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".md", ".mdx", ".markdown")) -> DataFrame:
    """doc_id (the path), text, is_mdx of every document under a folder, one row a file."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{','.join(suffixes)}}}").text(path, wholetext=True)
    rows = rows.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))
    return rows.withColumn("is_mdx", F.col("doc_id").endswith(".mdx"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of files read as bytes; bytes that are no UTF-8 become U+FFFD."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"), "length", "modificationTime")


def balanced(docs: DataFrame, partitions: int, text: str = "text") -> DataFrame:
    """Documents dealt by size, so that long ones do not meet in one partition."""
    return docs.repartition(partitions, F.xxhash64(text), F.length(text))


def write_html(rendered: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes key and html as Parquet."""
    rendered.write.mode(mode).parquet(path)
