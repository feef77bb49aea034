"""Streams with control rows: restarts, pauses that span them, timers."""

import pandas as pd
from pyspark.sql import functions as F

from relspark.plans import streams
from relspark.streaming import controlled


def test_restart_goes_on_from_the_checkpoint(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for part in range(4):
        events.where((F.col("event_id") >= 250 * part) & (F.col("event_id") < 250 * (part + 1))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        got = controlled.run_available(spark, f"{tmp_path}/events.parquet", base=f"{tmp_path}/base")
    want = streams.controlled_states(spark, sf)
    states = got.where("kind = 'state'").select("seq", "session", "active", "state")
    assert sorted(map(str, states.collect())) == sorted(map(str, want.collect())) and want.where("active").count() > 0
    audit = streams.stream_audit_events(spark, sf)
    assert sorted(map(str, got.where("kind = 'audit'").select("seq", "session", "event").collect())) == sorted(map(str, audit.collect()))


class Value:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return self.rows[0]

    def update(self, v):
        self.rows = [v]

    def clear(self):
        self.rows = []


class Rows(Value):
    def get(self):
        return iter(list(self.rows))

    def appendValue(self, v):  # noqa: N802
        self.rows.append(v)


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):  # noqa: N802
        return Value()

    def getListState(self, *_):  # noqa: N802
        return Rows()

    def listTimers(self):  # noqa: N802
        return iter(list(self.timers))

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.append(t)


class Clock:
    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return 1000


def test_pauses_expire_and_idle_sessions_are_forgotten():
    s = controlled.Sessions(0.65, 0.45, 2, 3, 0.0, pause_ms=50, idle_ms=900)
    s.init(Handle())
    rows = [(1, 10, 0.9, None, 0), (2, 20, None, "pause", 0), (3, 30, 0.8, None, 0), (4, 25, 0.8, None, 0)]
    out = pd.concat(s.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["seq", "us", "p", "command", "epoch"])]), Clock()))
    assert [(r.kind, r.seq, r.state or r.event) for r in out.itertuples()] == [("state", 1, "MONITOR"), ("audit", 2, "PAUSE")]
    assert s.handle.timers == [1050]
    out = pd.concat(s.handleExpiredTimer((7,), Clock(), None))
    assert [(r.kind, r.state or r.event) for r in out.itertuples()] == [("state", "ELEVATED"), ("audit", "ACTIVATED"), ("audit", "NOTIFIED"), ("state", None), ("audit", "LATE"), ("audit", "PAUSE_EXPIRED")]
    assert not s.held.exists() and s.handle.timers == [1050, 1900]
    out = pd.concat(s.handleExpiredTimer((7,), Clock(), None))
    assert out["event"].tolist() == ["FORGOTTEN"] and not s.kept.exists()
