"""Substring dedup by sliding spans of sentences, in DataFrame expressions.

A text is cut into sentences after each line feed, after . ! ? , ; : with white space behind it, and after a word of six
letters or more that ends in one of `ENDS` (`SIGNS` cut without white space). What stands next to a place decides
whether it is a cut, whatever the length of the sentence around it, so a passage is cut alike wherever it stands.
Every run of `SPAN` consecutive sentences is hashed (64 + 32 bits, white space at sentences' ends left out); runs meet
by hash over all documents. The first run (smallest doc_id, then position) stays; every sentence covered by a run that
is not the first of its kind is removed.

Null and empty texts have no sentences; a text of fewer than `SPAN` sentences has no run and stays. Texts are whole in
one row, whatever their length. Rows that share a doc_id are told apart by a hash of their text and are all as early
as the first; repeats between them stay, and rows that repeat both are treated alike. A null doc_id counts as the
smallest. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, drop, keyed, table

SPAN = 5
BLANK = r"[ \t\x0B\x0C\r]+"
#: The last of a word's six letters after which a sentence is cut, and signs of scripts without blanks.
ENDS, SIGNS = "nstNSTнситαςνנהםنةया다는", "。！？，、；：的是了のはを"
STOP, MARK = rf"[.!?,;:]{BLANK}|\n|\p{{L}}{{5}}[{ENDS}]{BLANK}|[{SIGNS}]", "\x01"
SENTENCE = rf"[\s\S]*?(?:{STOP})|[\s\S]+"


def let(value: Column, f) -> Column:
    """f(value), with value computed once for all the lambdas in f."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sentences(text: Column) -> Column:
    """Array of sentences; joined they are the text.

    A mark is put behind the stops and the text split there, which Java does much faster than matching the
    parts; a text that has the mark itself is matched.
    """
    marked = F.filter(F.split(F.regexp_replace(text, f"({STOP})", f"$1{MARK}"), MARK), lambda s: s != "")
    return F.when(F.instr(text, MARK) > 0, F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))).otherwise(marked)


def runs(rows: DataFrame) -> DataFrame:
    """d, c, pos, h, g, again (an equal run stands earlier in the document): each run of rows (d, c, text)."""

    def of(k: Column) -> Column:
        def run(i: Column) -> Column:
            part = [F.get(k, i + j) for j in range(SPAN)]
            return F.struct(F.xxhash64(*part).alias("h"), F.hash(*part).alias("g"), i.alias("pos"))

        return F.array_sort(F.when(F.size(k) >= SPAN, F.transform(F.sequence(F.lit(0), F.size(k) - SPAN), run)))

    def marked(r: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(r, i - 1)
            again = F.when(i == 0, False).otherwise((before["h"] == x["h"]) & (before["g"] == x["g"]))
            return F.struct(x["pos"].alias("pos"), x["h"].alias("h"), x["g"].alias("g"), again.alias("again"))

        return F.transform(r, one)

    core = F.transform(sentences(F.col("text")), lambda s: F.trim(F.translate(s, "\t\n\x0b\x0c\r", "     ")))
    return rows.select("d", "c", F.explode(let(core, lambda k: let(of(k), marked))).alias("r")).select("d", "c", "r.*")


def repeated(rows: DataFrame) -> DataFrame:
    """d, c, at (sorted positions of runs that are not the first of their kind)."""
    found = table(runs(rows), "runs")
    shared = table(found.groupBy("h", "g").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("h", "g", "first"), "shared")
    drop()
    later = found.where("not again").join(shared, ["h", "g"]).where("d > first").select("d", "c", "pos")
    both = later.unionAll(found.where("again").select("d", "c", "pos"))
    out = table(both.groupBy("d", "c").agg(F.sort_array(F.collect_set("pos")).alias("at")), "repeated")
    drop(found, shared)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the remaining text), n_sentences, n_removed, n_bytes, kept_sha256 for every row of docs (doc_id, text)."""
    rows = keyed(docs)
    met = rows.join(repeated(rows), ["d", "c"], "left").select(F.when(F.col("d") != NULL_ID, F.col("d")).alias("doc_id"), "text", "at")

    def cut(s: Column) -> Column:
        at = F.col("at")
        k = F.sequence(F.lit(0), F.size(at) - 1)
        opens = F.filter(k, lambda i: F.when(i == 0, True).otherwise(F.get(at, i) - F.get(at, i - 1) > SPAN))
        closes = F.filter(k, lambda i: F.when(i == F.size(at) - 1, True).otherwise(F.get(at, i + 1) - F.get(at, i) > SPAN))
        spans = F.zip_with(opens, closes, lambda a, b: F.struct(F.get(at, a).alias("a"), (F.get(at, b) + SPAN).alias("b")))

        def rest(x: Column) -> Column:
            piece = lambda i: F.slice(s, F.coalesce(F.get(x, i - 1)["b"], F.lit(0)) + 1, F.coalesce(F.get(x, i)["a"], F.size(s)) - F.coalesce(F.get(x, i - 1)["b"], F.lit(0)))
            return F.flatten(F.transform(F.sequence(F.lit(0), F.size(x)), lambda i: F.when(i == 0, F.slice(s, F.lit(1), F.get(x, F.lit(0))["a"])).otherwise(piece(i))))

        left = F.when(at.isNull(), s).otherwise(let(spans, rest))
        return F.struct(F.size(s).cast("long").alias("n"), left.alias("left"))

    out = met.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), let(sentences(F.col("text")), cut).alias("x"))
    out = out.select("doc_id", "n_bytes", F.col("x.n").alias("n_sentences"), (F.col("x.n") - F.size("x.left")).alias("n_removed"), F.array_join("x.left", "").alias("kept"))
    return out.select("doc_id", "kept", "n_sentences", "n_removed", (F.col("n_bytes") - F.octet_length("kept")).alias("n_bytes_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def sql() -> str:
    """The same, without the kept text, in DuckDB SQL over documents with distinct doc_ids."""
    part = [f"k{j}" for j in range(SPAN)]
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as (select doc_id, t, regexp_extract_all(t, '{SENTENCE}') as s from d),
k as (select doc_id, s, [trim(translate(x, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')) for x in s] as k from s),
r as (select doc_id, i - 1 as pos, {', '.join(f'k[i + {j}] as {p}' for j, p in enumerate(part))} from (select doc_id, k, unnest(range(1, len(k) - {SPAN - 2})) as i from k)),
n as (select *, row_number() over (partition by {', '.join(part)} order by doc_id, pos) as n from r),
x as (select distinct doc_id, pos + o as pos from n, (values {', '.join(f'({j})' for j in range(SPAN))}) v(o) where n > 1),
g as (select doc_id, list(pos) as gone from x group by doc_id),
l as (select s.doc_id, t, s, coalesce(gone, []) as gone from s left join g using (doc_id)),
f as (select doc_id, t, s, gone, array_to_string([s[i] for i in range(1, len(s) + 1) if not list_contains(gone, i - 1)], '') as kept from l)
select doc_id, len(s)::bigint as n_sentences, len(gone)::bigint as n_removed, (strlen(t) - strlen(kept))::bigint as n_bytes_removed, sha256(kept) as kept_sha256 from f"""
