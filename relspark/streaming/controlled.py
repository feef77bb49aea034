"""Session states over a stream with control rows, and an append-only audit of what happened to each session.

The rules for scored rows are those of relspark.streaming.sessions. A row with a command steers its session instead:
`reset` forgets it, `pause` holds its scored rows back until `resume` (or a reset, or the pause's timer), when they are
judged in order. A row of a later epoch than the session's forgets the session first, which resets all sessions without
touching those that stay silent. Held rows are in a list of the state store, so a long pause costs disk, not memory.

Output rows are of two kinds, `state` (one for each scored row that was judged) and `audit`; one file sink partitioned by
kind writes both, so each is there exactly once after a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from relspark.operators.storage import new_folder

OUTPUT = "kind string, session long, seq long, active boolean, state string, event string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FRESH = ("", False, None, None, False)


class Sessions(StatefulProcessor):
    """One session's new rows in, judged rows and audit events out."""

    def __init__(self, on: float, off: float, k: int, m: int, cooldown_seconds: float | None, pause_ms: int | None, idle_ms: int | None):
        self.on, self.off, self.k, self.m, self.pause_ms, self.idle_ms = on, off, k, m, pause_ms, idle_ms
        self.step = None if cooldown_seconds is None else int(cooldown_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("session", "flags string, active boolean, last_us long, sent_us long, paused boolean, epoch long")
        self.held = handle.getListState("held", "seq long, us long, p double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flags, active, last, sent, paused, epoch = self.kept.get() if self.kept.exists() else (*FRESH, None)
        out: list[tuple] = []
        new = pd.concat(list(rows)).sort_values("seq")
        for seq, us, p, command, now in zip(new["seq"].tolist(), new["us"].tolist(), new["p"].tolist(), new["command"].tolist(), new["epoch"].tolist(), strict=True):
            if epoch is not None and now > epoch:
                self.replay(key[0], (flags, active, last, sent), out)
                (flags, active, last, sent, paused), out[len(out) :] = FRESH, [("audit", key[0], seq, None, None, "RESET_ALL")]
            epoch = now if epoch is None else max(epoch, now)
            if command is None or command != command:
                if paused:
                    self.held.appendValue((seq, us, p))
                else:
                    flags, active, last, sent = self.judge(key[0], (flags, active, last, sent), seq, us, p, out)
                continue
            out.append(("audit", key[0], seq, None, None, command.upper()))
            if command == "pause":
                paused = True
                continue
            flags, active, last, sent = self.replay(key[0], (flags, active, last, sent), out)
            paused = False
            if command == "reset":
                flags, active, last, sent, paused = FRESH
        self.kept.update((flags, active, last, sent, paused, epoch))
        if wait := self.pause_ms if paused else self.idle_ms:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait)
        yield pd.DataFrame(out, columns=["kind", "session", "seq", "active", "state", "event"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A pause that has lasted too long ends; a session that has been silent too long is forgotten."""
        out: list[tuple] = []
        *state, paused, epoch = self.kept.get() if self.kept.exists() else (*FRESH, None)
        if paused:
            state = self.replay(key[0], tuple(state), out)
            out.append(("audit", key[0], None, None, None, "PAUSE_EXPIRED"))
            self.kept.update((*state, False, epoch))
            if self.idle_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.kept.clear()
            out.append(("audit", key[0], None, None, None, "FORGOTTEN"))
        yield pd.DataFrame(out, columns=["kind", "session", "seq", "active", "state", "event"])

    def replay(self, session: int, state: tuple, out: list[tuple]) -> tuple:
        if self.held.exists():
            for seq, us, p in self.held.get():
                state = self.judge(session, state, seq, us, p, out)
            self.held.clear()
        return state

    def judge(self, session: int, state: tuple, seq: int, us: int, p: float, out: list[tuple]) -> tuple:
        flags, active, last, sent = state
        if last is not None and us < last:
            out += [("state", session, seq, None, None, None), ("audit", session, seq, None, None, "LATE")]
            return state
        flags, before = (flags + ("1" if p >= self.on else "0"))[-self.m :], active
        if p >= self.on and flags.count("1") >= self.k:
            active = True
        elif p <= self.off:
            active = False
        out.append(("state", session, seq, active, "ELEVATED" if active else "MONITOR" if p > self.off else "LOW", None))
        if active != before:
            out.append(("audit", session, seq, None, None, "ACTIVATED" if active else "RELEASED"))
        if active and self.step is not None and (sent is None or us - sent >= self.step):
            sent = us
            out.append(("audit", session, seq, None, None, "NOTIFIED"))
        return flags, active, us, sent


def controlled_states(stream: DataFrame, on: float = 0.65, off: float = 0.45, k: int = 2, m: int = 3, cooldown_seconds: float | None = None, pause_ms: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """stream: (seq, session, us, p, command, epoch), streaming. The state store must be RocksDB when the query starts."""
    time = "processingTime" if pause_ms or idle_ms else "none"
    processor = Sessions(on, off, k, m, cooldown_seconds, pause_ms, idle_ms)
    return stream.groupBy("session").transformWithStateInPandas(processor, OUTPUT, "append", time)


def controls(df: DataFrame) -> DataFrame:
    """Events as scored rows and, at some ids, control rows; every 61st comes with a time three days before its own."""
    seq = F.col("event_id")
    command = F.when(seq % 97 == 0, "reset").when(seq % 89 == 0, "pause").when(seq % 83 == 0, "resume")
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.when(seq % 61 == 0, 3 * 86_400_000_000).otherwise(0)
    return df.select(seq.alias("seq"), F.col("user_id").alias("session"), us.alias("us"), (F.col("value") / (F.col("value") + 20)).alias("p"), command.alias("command"), F.floor(seq / 4000).cast("long").alias("epoch"))


def run_available(spark: SparkSession, path: str, base: str | None = None, files_per_trigger: int = 1, **rules) -> DataFrame:
    """Runs over what a folder or glob holds and returns all rows written so far; the same base goes on from its checkpoint."""
    base = base or new_folder(spark, "controlled")
    schema = spark.read.parquet(path).schema
    rows = controls(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))
    out = controlled_states(rows, **rules)
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = out.writeStream.format("parquet").partitionBy("kind").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(out.schema).parquet(f"{base}/out")
