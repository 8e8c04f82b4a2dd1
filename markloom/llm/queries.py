"""Queries of this subpackage's operators over a folder of tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import audit, fingerprints, hpylm, jaccard, langid, mixing, pieces, positives, prefixes, quality, spans, store, suffixes

DOCUMENTS = "documents"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and its verdict under cutoffs certified on the labels."""
    return quality.apply(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op2_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through the content-addressed store and back."""
    folder = store.write(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))
    return store.read_digests(spark, folder)


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that repeat in runs, removed from every document."""
    return spans.dedup(_documents(spark, sf_dir)).drop("kept")


def op4_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under a model of the training documents."""
    return hpylm.score(_documents(spark, sf_dir))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from two thirds of the documents."""
    return langid.identify(_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time a document is due in the mixture of sources."""
    return mixing.schedule(_documents(spark, sf_dir)).drop("copy")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against its edited text's and the next document's."""
    return fingerprints.compare(_documents(spark, sf_dir))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts through the agenda encoder and the library's decoder."""
    return pieces.encode(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document in strings of 100 bytes that also start earlier."""
    return suffixes.dedup(_documents(spark, sf_dir))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates."""
    return jaccard.join(_documents(spark, sf_dir))


def op11_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, learned from trusted positives and unlabelled documents."""
    return positives.classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their orders, by source."""
    return audit.audit(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of rebuilt conversations."""
    return prefixes.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_store, op3_spans, op4_hpylm, op5_langid, op6_mixing, op7_fingerprints, op8_pieces, op9_suffixes, op10_jaccard, op11_positives, op12_audit, op13_prefixes)}


def oracle_sql() -> dict:
    return {"op1_quality": quality.sql(), "op3_spans": spans.sql(), "op6_mixing": mixing.sql(), "op12_audit": audit.sql(), "op13_prefixes": prefixes.sql()}
