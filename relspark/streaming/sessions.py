"""The states of sessions over a stream, with the same rules as relspark.operators.temporal.

Rows are taken in order of arrival; a row earlier than its session's last one is reported late and leaves the state as
it was, so no watermark drops it. State: the last elevated flags, whether active, the last time and notification.
Idle sessions are forgotten after a timeout, if one is given.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from relspark.operators.storage import new_folder

OUTPUT = "seq long, session long, active boolean, state string, late boolean, notify boolean"
STATE = "flags string, active boolean, last_us long, sent_us long"


def updater(on: float, off: float, k: int, m: int, cooldown_seconds: float, idle_ms: int | None):
    """State function: one session's new rows in, their states out."""
    step = int(cooldown_seconds * 1_000_000)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        flags, active, last, sent = state.get if state.exists else ("", False, None, None)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for seq, p, us in zip(rows["seq"], rows["p"], rows["us"], strict=True):
            if last is not None and us < last:
                out.append((seq, key[0], None, None, True, False))
                continue
            last = us
            flags = (flags + ("1" if p >= on else "0"))[-m:]
            if p >= on and flags.count("1") >= k:
                active = True
            elif p <= off:
                active = False
            notify = active and (sent is None or us - sent >= step)
            sent = us if notify else sent
            out.append((seq, key[0], active, "ELEVATED" if active else "MONITOR" if p > off else "LOW", False, notify))
        state.update((flags, active, last, sent))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["seq", "session", "active", "state", "late", "notify"])

    return update


def session_states(stream: DataFrame, on: float = 0.65, off: float = 0.45, k: int = 2, m: int = 3, cooldown_seconds: float = 900.0, idle_ms: int | None = None) -> DataFrame:
    """stream: (seq, session, us, p), streaming or not."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("session").applyInPandasWithState(updater(on, off, k, m, cooldown_seconds, idle_ms), OUTPUT, STATE, "append", timeout)


def events_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Scored events from a growing folder (or glob) of parquet files."""
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return df.select(F.col("event_id").alias("seq"), F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("value") / (F.col("value") + 20)).alias("p"))


def run_available(spark: SparkSession, path: str, out: str | None = None) -> DataFrame:
    """Runs over what is there and returns the states written: exactly once, by the sink's log and the checkpoint."""
    base = f"{out}/stream-{uuid.uuid4().hex}" if out else new_folder(spark, "stream")
    glob = path.rsplit("/", 1)
    states = session_states(events_stream(spark, f"{glob[0]}/{glob[1].replace('events.parquet', 'events.parque[t]')}"))
    query = states.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start(f"{base}/out")
    query.awaitTermination()
    return spark.read.schema(states.schema).parquet(f"{base}/out").select("seq", "session", "active", "state")
