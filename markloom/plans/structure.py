"""What a document's events stand in: containers around them, and the headings above them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udf
from ..operators.scan import last_values, running_sums

CONTAINERS = ("BlockQuote", "Callout", "List", "ListItem", "FootnoteDefinition", "DefinitionList", "DefinitionDescription")


def containers(found: DataFrame, key: str = "doc_id", kinds: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """key, kind, level, start, end of each container among events (key, seq, kind): the seq of its two events.

    The level is a running sum of starts and ends; an end belongs to the last start of its level.
    """
    marks = found.where(F.col("kind").isin(*[k + e for k in kinds for e in ("Start", "End")])).select(key, "seq", "kind")
    opens = F.col("kind").endswith("Start")
    levels = running_sums(marks, [key], "seq", {"_open": F.when(opens, 1).otherwise(-1)})
    levels = levels.select(key, "seq", "kind", (F.col("_open") + F.when(opens, 0).otherwise(1)).alias("level"))
    paired = last_values(levels, [key, "level"], "seq", {"start": F.when(opens, F.col("seq"))})
    return paired.where(~opens).select(key, F.expr("substring(kind, 1, length(kind) - 3)").alias("kind"), F.col("level").cast("int").alias("level"), F.col("start").cast("long").alias("start"), F.col("seq").cast("long").alias("end"))


def inside(docs: DataFrame, kinds: tuple[str, ...], options=None, text: str = "text", key: str = "doc_id", around: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """Pairs of containers and the events of some kinds in them: key, container and seq, the kinds of both, and depth.

    The containers of an event are numbered from the outermost. They are found where a document's events are, in order.
    """
    return docs.select(key, F.explode(udf.md_containers(F.col(text), kinds, around, options)).alias("_e")).select(key, "_e.*")


def nesting(docs: DataFrame, kinds: tuple[str, ...], options=None, text: str = "text", key: str = "doc_id", around: tuple[str, ...] = CONTAINERS) -> DataFrame:
    """key, container_kind, depth, n_events, n_containers: the pairs of `inside` counted by kind and depth, for each row of docs."""
    return docs.select(key, F.explode(udf.md_nesting(F.col(text), kinds, around, options)).alias("_e")).select(key, "_e.*")


def sections(docs: DataFrame, options=None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Links, images and code blocks under their headings: key, seq, kind, url, info, path (heading texts, outermost first).

    The headings above are carried on where a document's events are, in order.
    """
    return docs.select(key, F.explode(udf.md_sections(F.col(text), options)).alias("_e")).select(key, "_e.*")
