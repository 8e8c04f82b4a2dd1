"""One long document compiled in many tasks: cut, compiled part by part, and put together by joins and windows.

What parts of a document share is little: definitions of links and notes (the first of a label counts), the numbers of
notes (by first reference) and of equal heading ids (by order). Parts are cut at safe places and dealt out; a first
pass finds what each part defines and may want; definitions then meet wants in a join on (document, label), counts of
heading ids come from a window; a second pass writes HTML with holes for the numbers of notes, which are filled by
built-in functions. A block that runs over a cut (a long fence, say) takes the parts up to its end with it.

The result has the bytes of a compilation in one piece, as rows in order of `part`. Documents with inline notes are
compiled whole. A null text is one row with null; an empty one a row with ''. Keys should be unique and not null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import udf
from ..kernel import parts as K
from ..kernel import text as T
from ..kernel.options import Options
from ..kernel.options import options as of
from ..session import scratch

#: Characters of a part, and the number that a document's first note has among its parts.
SIZE, NOTES = 200_000, 1 << 40


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _typed(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"


def cut(docs: DataFrame, options=None, size: int = SIZE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, part, text: parts of about `size` characters, without front matter if the options have it."""
    opts = of(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                s = batch.column(text)[k].as_py()
                found = [None] if s is None else K.cut(T.front_matter(s)[1] if opts.front_matter else s, size, opts)
                for at in range(0, len(found), 16):
                    some = found[at : at + 16]
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([k] * len(some))), pa.array(range(at, at + len(some)), pa.int64()), pa.array(some, pa.string())], [key, "part", "text"])

    return docs.select(key, text).mapInArrow(run, f"{_typed(docs, key)}, part long, text string")


def gathered(rows: DataFrame, size: int = SIZE, text: str = "text", key: str = "doc_id", order: str = "seq") -> DataFrame:
    """key, part, text: the same for documents that stand in rows, in order of a column of longs from 0 to below NOTES; none is held whole.

    Parts begin where rows do, so a row must begin at a safe place, after a blank line. A part's number is its first row's place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, now, start, last, held, some = None, None, 0, None, 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([start], pa.int64()), pa.array(["".join(some)], pa.string())], [key, "part", "text"])

        for batch in batches:
            kind = batch.column(0).type
            for k, at, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if some and (k != now or (held >= size and at != last)):
                    yield out()
                    held, some = 0, []
                if not some:
                    now, start = k, at
                some.append(s or "")
                held, last = held + len(some[-1]), at
        if some:
            yield out()

    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(key, F.col(order).cast("long").alias("part"), text).repartitionByRange(spread, key, "part").sortWithinPartitions(key, "part")
    return dealt.mapInArrow(run, f"{_typed(rows, key)}, part long, text string")


FACTS = "open string, refs array<struct<label:string,url:string,title:string>>, notes array<struct<label:string,info:string>>, slugs map<string,int>, labels array<string>, note_labels array<string>"


def _facts(rows: DataFrame, opts: Options, key: str) -> DataFrame:
    """rows with what each part has and may want."""

    def of_text(s: str) -> K.Facts:
        return K.facts(s or "", opts)

    found = udf._parts(of_text, tuple(x.split()[0] for x in FACTS.split(", ")), FACTS)
    return rows.select(key, "part", "text", found("text").alias("f")).select(key, "part", "text", "f.*")


def _whole(parts: DataFrame, opts: Options, key: str) -> DataFrame:
    """key, part, text of documents in which blocks run over cuts, cut at their ends instead: a stream of parts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, target = None, None, 0
        for batch in batches:
            out = []
            for k, part, s, left in zip(batch.column(key), batch.column("part").to_pylist(), batch.column("text").to_pylist(), batch.column("open").to_pylist()):
                s = s or ""
                if now != k:
                    now, state = k, None
                if state is not None:
                    end = K.resume(s, state)
                    taken, s = (s, "") if end is None else (s[:end], s[end:])
                    out.append((k, target, part, taken))
                    if end is None:
                        continue
                    left = K.open_end(s, opts)
                if s or part == 0:
                    out.append((k, part, part, s))
                state, target = left, part if s or part == 0 else target
            yield pa.RecordBatch.from_arrays([pa.array([x[0].as_py() for x in out], batch.column(key).type), *[pa.array([x[i] for x in out], pa.int64()) for i in (1, 2)], pa.array([x[3] for x in out], pa.string())], [key, "part", "piece", "text"])

    spread = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = parts.select(key, "part", "text", "open").repartition(spread, key).sortWithinPartitions(key, "part").mapInArrow(run, f"{_typed(parts, key)}, part long, piece long, text string")
    pieces = F.array_sort(F.collect_list(F.struct("piece", "text")))
    return moved.groupBy(key, "part").agg(F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"))


def split(docs: DataFrame, options=None, size: int = SIZE, text: str = "text", key: str = "doc_id", order: str | None = None) -> DataFrame:
    """key, part, text, and what each part has and may want, with no block over a cut. With order, documents stand in rows as for `gathered`."""
    opts, spark = of(options), docs.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (cut(docs, opts, size, text, key) if order is None else gathered(docs, size, text, key, order)).repartition(spread, key, "part")
    found = _kept(_facts(dealt, opts, key), "parts")
    last = found.groupBy(key).agg(F.max("part").alias("last"))
    running = found.join(last, key).where("open is not null and part < last").select(key).distinct()
    if running.isEmpty():
        return found
    whole = _facts(_whole(found.join(running, key, "left_semi"), opts, key).repartition(spread, key, "part"), opts, key)
    return _kept(found.join(running, key, "left_anti").unionByName(whole), "parts")


def _wanted(found: DataFrame, key: str) -> DataFrame:
    """found with the definitions of links and notes that each part may use, its own notes that count, and earlier slugs."""
    refs = found.select(key, "part", F.posexplode("refs").alias("k", "d")).groupBy(key, "d.label").agg(F.min_by(F.struct("d.url", "d.title"), F.struct("part", "k")).alias("to"))
    links = found.select(key, "part", F.explode("labels").alias("label")).join(refs, [key, "label"]).groupBy(key, "part").agg(F.collect_list(F.struct("label", "to.url", "to.title")).alias("use_refs"))
    noted = found.select(key, "part", F.explode("notes").alias("n")).groupBy(key, F.col("n.label").alias("label")).agg(F.min_by(F.struct("part", "n.info"), "part").alias("to"))
    uses = found.select(key, "part", F.explode("note_labels").alias("label")).join(noted, [key, "label"]).groupBy(key, "part").agg(F.collect_list(F.struct("label", "to.info")).alias("use_notes"))
    own = noted.select(key, "to.part", "label").groupBy(key, "part").agg(F.collect_list("label").alias("own"))
    before = F.sum("n").over(Window.partitionBy(key, "slug").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    slugs = found.select(key, "part", F.explode("slugs").alias("slug", "n")).withColumn("before", before).where("before > 0").groupBy(key, "part").agg(F.collect_list(F.struct("slug", F.col("before").cast("long").alias("before"))).alias("earlier"))
    out = found.select(key, "part", "text")
    for more in (links, uses, own, slugs):
        out = out.join(more, [key, "part"], "left")
    return out


def compiled(docs: DataFrame, options=None, size: int = SIZE, text: str = "text", key: str = "doc_id", order: str | None = None) -> DataFrame:
    """key, part, html: in order of part they are the HTML of the document. With order, documents stand in rows as for `gathered`."""
    opts = of(options)
    if order is not None and (opts.inline_footnotes or opts.front_matter):
        raise ValueError("documents in rows are compiled without inline notes and front matter")
    if opts.inline_footnotes:
        return docs.select(key, F.lit(0).cast("long").alias("part"), udf.md_to_html(text, opts).alias("html"))
    found = _wanted(split(docs, opts, size, text, key, order), key)
    schema = f"{_typed(docs, key)}, part long, html string, order array<string>, notes array<struct<label:string,html:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a part is large
                row = {c: batch.column(c)[k].as_py() for c in ("text", "use_refs", "use_notes", "own", "earlier")}
                if row["text"] is None:
                    html, order, notes = None, [], []
                else:
                    p = K.compile_part(
                        row["text"], opts, {x["label"]: (x["url"], x["title"]) for x in row["use_refs"] or ()}, {x["label"]: x["info"] for x in row["use_notes"] or ()},
                        set(row["own"] or ()), {x["slug"]: x["before"] for x in row["earlier"] or ()},
                    )
                    html, order, notes = p.html, p.order, p.notes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).slice(k, 1), batch.column("part").slice(k, 1), pa.array([html], pa.string()), pa.array([order], pa.list_(pa.string())), pa.array([notes], pa.list_(pa.struct([("label", pa.string()), ("html", pa.string())])))],
                    [key, "part", "html", "order", "notes"],
                )

    done = found.mapInArrow(run, schema)
    if not opts.footnotes:
        return done.select(key, "part", "html")
    done = _kept(done, "html")
    first = done.select(key, "part", F.posexplode("order").alias("k", "label")).groupBy(key, "label").agg(F.min(F.struct("part", "k")).alias("at"))
    numbers = first.select(key, "label", F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("n"))
    here = done.select(key, "part", F.explode("order").alias("label")).join(numbers, [key, "label"]).groupBy(key, "part").agg(F.map_from_entries(F.collect_list(F.struct("label", F.col("n").cast("string")))).alias("numbers"))
    filled = F.array_join(F.transform(F.split("html", K.HOLE), lambda x, k: F.when(k % 2 == 1, F.element_at("numbers", x)).otherwise(x)), "")
    body = done.join(here, [key, "part"], "left").select(key, "part", F.when(F.col("numbers").isNull(), F.col("html")).otherwise(filled).alias("html"))
    notes = done.select(key, F.explode("notes").alias("x")).select(key, "x.label", "x.html").join(numbers, [key, "label"])
    most = F.max("n").over(Window.partitionBy(key))
    item = F.regexp_replace("html", f"{K.HOLE}[^{K.HOLE}]*{K.HOLE}", F.col("n").cast("string"))
    section = F.concat(F.when(F.col("n") == 1, '<section data-footnotes class="footnotes">\n<ol>\n').otherwise(""), item, F.when(F.col("n") == F.col("most"), "</ol>\n</section>\n").otherwise(""))
    return body.unionByName(notes.withColumn("most", most).select(key, (F.lit(NOTES) + F.col("n")).alias("part"), section.alias("html")))


def digests(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_chars, html_md5 of `compiled` documents: a task takes a document's parts in order, as MD5 must, and holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, md5, kind = None, 0, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([n], pa.int64()), pa.array([md5.hexdigest()])], [key, "n_chars", "html_md5"])

        for batch in batches:
            kind = batch.column(0).type
            for k, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                if md5 is None or k != now:
                    if md5 is not None:
                        yield out()
                    now, n, md5 = k, 0, hashlib.md5()
                s = html.as_py() or ""
                n += len(s)
                md5.update(s.encode())
        if md5 is not None:
            yield out()

    spread = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.select(key, "part", "html").repartition(spread, key).sortWithinPartitions(key, "part")
    return dealt.select(key, "html").mapInArrow(run, f"{_typed(parts, key)}, n_chars long, html_md5 string")
