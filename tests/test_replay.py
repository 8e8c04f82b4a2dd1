import random
from datetime import datetime, timedelta
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from markloom.streaming import sessions
from test_structure import brute_sessions


def test_a_batch_of_a_replay_has_many_files(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("message_id"), (F.col("id") % 3).alias("batch"))
    one = spark.createDataFrame([(100, 3)], "message_id long, batch long")
    stream = sessions.replay(rows.unionByName(one), "batch", 4, str(tmp_path / "in"), 4)
    assert len(list(Path(tmp_path / "in").glob("*.parquet"))) == 16
    seen = []
    stream.writeStream.foreachBatch(lambda df, k: seen.append((k, sorted(r[0] for r in df.collect())))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination()
    assert [x for _, x in sorted(seen)] == [[k for k in range(40) if k % 3 == b] for b in range(3)] + [[100]]


def test_runs_of_messages():
    p = sessions.FirstDefinitions(10)
    part = pd.DataFrame({"at": [30, 5, 0, 12, 5], "message_id": [9, 2, 1, 4, 3], "label": ["a", "a", None, "b", "a"], "url": ["/4", "/1", None, "/3", "/2"]})
    assert list(p._runs(part)) == [(0, 12, {"a": (5, 2, "/1", 2), "b": (12, 4, "/3", 1)}), (30, 30, {"a": (30, 9, "/4", 1)})]
    ends = {-9: -5, 14: 16, 40: 41}
    p.sessions = type("S", (), {"removeKey": lambda self, k: None})()
    p._move = lambda old, new: None
    assert p._reach(ends, 0, 12) == -9 and ends == {-9: 16, 40: 41}


class Handle:
    """State and timers of one share; `asked` counts what goes to the JVM."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked += 1
        self.value = value

    def clear(self):
        self.update(None)

    def registerTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.asked += 1
        self.timers.remove(at)


def test_a_share_is_read_and_written_once_a_batch():
    """Sessions of many groups over batches with late rows and two pieces each, against brute force."""
    rng, gap, delay = random.Random(3), 5000, 60_000
    p, handle, out = sessions.FirstDefinitions(gap), Handle(), []
    p.init(handle)
    messages = [(rng.choice([*"abcdefg", "nan", None]), rng.randrange(400_000), k, rng.choice(["x", "ä\"", None])) for k in range(900)]
    batches = [[m for m in messages if min((m[1] + (m[2] % 4 == 0) * 40_000) // 40_000, 9) == b] for b in range(10)] + [[]] * 3
    high = 0
    for batch in batches:
        now, before = TimerValues(0, max(high - delay, 0) // 1000 if batch else 10_000), handle.asked
        part = pd.DataFrame([(g, at, k, x, x and f"/{k}") for g, at, k, x in batch], columns=["grp", "at", "message_id", "label", "url"])
        pieces = [x for x in (part[::2], part[1::2]) if len(x)]
        if pieces:
            out += p.handleInputRows((0,), iter(pieces), now)
        for at in sorted(t for t in handle.timers if t < now.getCurrentWatermarkInMs()):
            out += p.handleExpiredTimer((0,), now, ExpiredTimerInfo(at))
            handle.timers.discard(at)
        assert handle.asked - before <= 4 and len(handle.timers) <= 1
        high = max([high, *(m[1] for m in batch)])
    assert handle.value is None and not handle.timers
    found = sorted(map(tuple, pd.concat(out).itertuples(index=False)), key=repr)
    want, zero = [], datetime(1970, 1, 1)
    for row in brute_sessions([(g, timedelta(microseconds=at), k, x) for g, at, k, x in messages], timedelta(microseconds=gap)):
        want.append(tuple(pd.Timestamp(zero + v, tz="UTC") if isinstance(v, timedelta) else v for v in row))
    assert found == sorted(want, key=repr) and len(found) > 300


def test_groups_share_state_in_a_stream(spark, tmp_path):
    rng, zero, gap = random.Random(8), datetime(2024, 1, 1), timedelta(minutes=30)
    messages = [(rng.choice([*map(str, range(12)), None]), zero + timedelta(seconds=rng.randrange(200_000)), k, rng.choice(["x", "y", None])) for k in range(500)]
    rows = [(g, ts, k, f"[{x}]: /{k}" if x else "text", int((ts - zero).total_seconds() // 50_000)) for g, ts, k, x in messages]
    rows.append((None, zero + timedelta(days=30), -1, None, 4))
    df = spark.createDataFrame(rows, "grp string, ts timestamp, message_id long, text string, batch int")
    stream = sessions.replay(df, "batch", 5, f"{tmp_path}/in", 2)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")  # times are instants, whatever the session's zone
    try:
        sessions.run(sessions.first_definitions(stream, "30 minutes", "9 hours", shares=3), f"{tmp_path}/out", f"{tmp_path}/state", 2).awaitTermination()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, found.collect()), key=repr) == brute_sessions(messages, gap)
