"""A corpus pipeline: documents through five of the operators, each stage written and read again.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of docs. None has a SQL form (a
network, a join by similarity, a suffix array, a tokenizer), so ORACLE_SQL is None and tests compare the
stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm import jaccard, langid, mixing, pieces, suffixes
from markloom.llm.common import table
from markloom.session import ship

PIECES = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, and those that are less than `langid.LEAST` likely to be of any learned language."""
    net = langid.train(docs.where(~langid.held_out()))
    return langid.accepted(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates; of repeated rows one."""
    groups = jaccard.join(docs)
    n_kept = F.count_if(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # the ids of what goes are few beside those of what stays, so that texts need not be dealt out to meet them
    odd = table(groups.groupBy("doc_id").agg(n_kept.alias("n_kept")).where("n_kept <> 1"), "odd")
    rows = docs.select(F.struct(*[docs[f"`{n}`"] for n in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    out = rows.join(odd.where("n_kept = 0").select("doc_id"), F.col("id").eqNullSafe(F.col("doc_id")), "left_anti").select("row.*")
    return out if odd.where("n_kept > 1").isEmpty() else out.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand earlier in the corpus; a document of which only white space is left goes."""
    done = suffixes.dedup(docs, whole=True)
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    left = done.where((F.col("n_removed") == 0) | F.col("kept").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once or more, as its source's weight has it."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of what is left, as digests."""
    import public_tokenizers

    return pieces.encode(docs, str(public_tokenizers.path(PIECES)))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("encoded", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
