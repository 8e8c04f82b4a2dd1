"""Link definitions of a stream of messages, first wins, by session: arbitrary state with event-time timers.

A message is a row with a group, a time, an id and Markdown. The messages of a group whose times are not more than a
gap apart are a session, and a session's definitions are those of one document: of each label the first counts,
by time and id, in whatever order messages arrive. A message that comes late may bring a definition before the one
that is kept, or join two sessions; then their definitions are merged, again the first of each label. When the watermark
has passed a session's end by the gap nothing can reach it any more: its definitions are written and its state is dropped, by
the batch that brings its share messages or else by a timer. So state holds the open sessions only, the first of each label; messages later than the
watermark allows are dropped and counted by Spark (numRowsDroppedByWatermark).

Groups are dealt out in shares. Each read and write of state is a question of the Python worker to the JVM, whatever its size, so a share's open
sessions are one value, which a batch reads and writes once, and it has one timer, at the first end of a session. A task holds the open
sessions of one share, whose rows of a batch are read in the pieces in which Arrow brings them. A null group is a group; null times are dropped by the watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import udf
from ..session import settings

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "grp string, session_start timestamp, session_end timestamp, label string, url string, first_ts timestamp, message_id long, n_definitions long"


#: Shares of groups: so many that the open sessions of one are few. They stay as they are for as long as a checkpoint is used.
SHARES = 1024

Groups = dict[str | None, tuple[dict[int, int], dict[int, dict[str, tuple]]]]


def _by_group(part: pd.DataFrame) -> Iterator[tuple[str | None, dict[str, np.ndarray]]]:
    """The rows of each group of a piece, in columns."""
    codes, groups = pd.factorize(part["grp"], use_na_sentinel=False)
    order, ends = np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes)).tolist()
    columns = {c: part[c].to_numpy()[order] for c in ("at", "message_id", "label", "url")}
    for grp, first, end in zip(groups, [0, *ends], ends):
        yield None if pd.isna(grp) else grp, {c: x[first:end] for c, x in columns.items()}


class FirstDefinitions(StatefulProcessor):
    """Of each group of a share its sessions (start -> end) and their definitions (start -> label -> time, id, url, number).

    State is the time of the share's timer and JSON: [[group, [[start, end, {label: [time, id, url, number]}]]]].
    """

    def __init__(self, gap: int):
        self.gap = gap  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer long, sessions string")

    def _read(self) -> tuple[int | None, Groups]:
        timer, known = self.open.get() or (None, "[]")
        return timer, {grp: ({s: e for s, e, _ in found}, {s: d for s, _, d in found}) for grp, found in json.loads(known)}

    def _reach(self, ends: dict[int, int], first: int, last: int) -> int:
        """The start of the session that a run of messages from first to last belongs to; sessions that it joins become one."""
        near = sorted(s for s, e in ends.items() if s - self.gap <= last and first <= e + self.gap)
        start, end = min([first, *near]), max([last, *(ends[s] for s in near)])
        for s in near:
            if s != start:
                del ends[s]
                self._move(s, start)
        ends[start] = end
        return start

    def _move(self, old: int, new: int) -> None:
        for label, value in self.definitions.pop(old, {}).items():
            self._define(new, label, value)

    def _define(self, start: int, label: str, value: tuple) -> None:
        """Keeps the earlier of a definition of the group at hand and the one that is known, and counts both."""
        mine = self.definitions.setdefault(start, {})
        known = mine.get(label)
        mine[label] = value if known is None else (*min(tuple(known[:3]), tuple(value[:3])), known[3] + value[3])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        """Messages of a group and piece that are not more than a gap apart meet its sessions as one run, with the first of each label."""
        timer, groups = self._read()
        for part in rows:
            for grp, mine in _by_group(part):
                ends, self.definitions = groups.setdefault(grp, ({}, {}))
                for first, last, found in self._runs(mine):
                    start = self._reach(ends, first, last)
                    for label, value in found.items():
                        self._define(start, label, value)
        yield from self._closed(timer, groups, timerValues)

    def _runs(self, part: Mapping[str, pd.Series | np.ndarray]) -> Iterator[tuple[int, int, dict[str, tuple]]]:
        """First and last time, and the first definition of each label (with their number), of messages that belong together."""
        first, last, found = None, None, {}
        rows = sorted(zip(part["at"].tolist(), part["message_id"].tolist(), part["label"].tolist(), part["url"].tolist()), key=lambda x: (x[0], x[1], x[3] or ""))
        for at, ident, label, url in rows:
            if first is not None and at - last > self.gap:
                yield first, last, found
                first, found = None, {}
            first, last = at if first is None else first, at
            if label is not None and label == label:
                known = found.get(label)
                found[label] = (at, ident, url, 1) if known is None else (*known[:3], known[3] + 1)
        if first is not None:
            yield first, last, found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        timer, groups = self._read()  # Spark removes the timer that has fired
        yield from self._closed(None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer, groups, timerValues)

    def _closed(self, timer: int | None, groups: Groups, timerValues) -> Iterator[pd.DataFrame]:
        """Writes the sessions that nothing can reach any more; keeps the others, with a timer at the first end of one."""
        now = timerValues.getCurrentWatermarkInMs() * 1000
        found, left = [], []
        for grp, (ends, definitions) in groups.items():
            for start in [s for s, e in ends.items() if e + self.gap < now]:
                end = ends.pop(start)
                found += [(grp, start, end, label, url, at, ident, n) for label, (at, ident, url, n) in definitions.pop(start, {}).items()]
            if ends:
                left.append((grp, [(s, e, definitions.get(s, {})) for s, e in ends.items()]))
        due = (min(e for _, some in left for _, e, _ in some) + self.gap) // 1000 + 1 if left else None
        if timer is not None and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and timer != due:
            self.handle.registerTimer(due)
        if left:
            self.open.update((due, json.dumps(left, ensure_ascii=False, separators=(",", ":"))))
        else:
            self.open.clear()
        if found:
            out = pd.DataFrame(found, columns=["grp", "session_start", "session_end", "label", "url", "first_ts", "message_id", "n_definitions"])
            yield out.assign(**{c: pd.to_datetime(out[c], unit="us", utc=True) for c in ("session_start", "session_end", "first_ts")})

    def close(self) -> None:
        pass


def first_definitions(messages: DataFrame, gap: str, delay: str, options=None, shares: int = SHARES) -> DataFrame:
    """The definitions of closed sessions, see RESULT; messages: grp, ts, message_id, text, a stream.

    gap: the longest pause in a session; delay: how late messages may come. Both are intervals, as in '30 minutes'. shares: see SHARES.
    """
    spark = messages.sparkSession
    micros = spark.sql(f"select cast((timestamp '2000-01-01' + interval {gap} - timestamp '2000-01-01') as interval second) as g").first()["g"]
    pause = int(micros.total_seconds() * 1_000_000)
    defined = messages.withWatermark("ts", delay).select(F.col("grp").cast("string").alias("grp"), "ts", F.col("message_id").cast("long").alias("message_id"), F.explode_outer(udf.md_link_references("text", options)).alias("d"))
    share = F.pmod(F.xxhash64("grp"), F.lit(shares)).cast("int").alias("share")
    rows = defined.select(share, "grp", "ts", F.unix_micros("ts").alias("at"), "message_id", "d.label", "d.url")
    return rows.groupBy("share").transformWithStateInPandas(FirstDefinitions(pause), RESULT, "Append", "EventTime")


def run(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> StreamingQuery:
    """Appends what the stream holds now to Parquet and ends; state is kept in the checkpoint for the next run."""
    spark = stream.sparkSession
    more = {} if partitions is None else {"spark__sql__shuffle__partitions": str(partitions)}
    with settings(spark, spark__sql__streaming__stateStore__providerClass=STORE, **more):
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def replay(rows: DataFrame, batch: str, n: int, folder: str, files: int | None = None) -> DataFrame:
    """rows as a stream that brings those of batch 0, 1, ... n-1 in turn, each in as many files (None: one a core).

    A file has a row that only marks it, so that none is empty and each batch has all its files.
    """
    spark = rows.sparkSession
    files = files or spark.sparkContext.defaultParallelism
    kept = rows.drop(batch)
    marks = spark.range(files).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema.fields], F.lit(True).alias("_mark"), F.col("id").cast("int").alias("_file"))
    for k in range(n):
        some = rows.where(F.col(batch) == k).drop(batch).select("*", F.lit(False).alias("_mark"), F.pmod(F.xxhash64(*kept.columns), F.lit(files)).cast("int").alias("_file"))
        some.unionByName(marks).repartitionById(files, "_file").drop("_file").write.mode("append").parquet(folder)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return spark.readStream.schema(f"{kinds}, _mark boolean").option("maxFilesPerTrigger", files).parquet(folder).where("not _mark").drop("_mark")


def message_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Messages (grp, ts, message_id, text) from Parquet files as they come into a folder."""
    return spark.readStream.schema("grp string, ts timestamp, message_id long, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(path)
