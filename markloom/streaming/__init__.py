"""Documents as a stream: stateless, a document a row (state is kept in `sessions`)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import udf


def stream_documents(spark: SparkSession, path: str, files_per_trigger: int = 1000, suffixes: tuple[str, ...] = (".md", ".mdx", ".markdown")) -> DataFrame:
    """doc_id (the path) and text of files as they come into a folder, one row a file."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{','.join(suffixes)}}}").text(path, wholetext=True)
    return rows.select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def compile_stream(docs: DataFrame, options=None) -> DataFrame:
    """html, front_matter and headings of each document of a stream, with counts observed as `compiled`."""
    out = docs.select("doc_id", udf.md_parse(F.col("text"), options).alias("r")).select("doc_id", "r.*")
    return out.observe("compiled", F.count("*").alias("documents"), F.sum(F.length("html")).alias("html_chars"))


def write_stream(rows: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream's rows to Parquet; once: what is there now, and then it ends."""
    w = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
