"""Streams whose state is kept for each client: concurrent requests with resets, and the exact rolling quota.

Events of a client wait in its state until the watermark has passed them and are then handled in the order of time, so that
results equal those of a batch however events arrive; a timer wakes the client at its earliest waiting event. Repeated
events are one while they wait, and later ones lie behind the watermark, where Spark drops them. A client whose
counter is reset, or whose successes have all expired, keeps no state. What a client gets in a batch waits as one value, so that
state is read and written by batch and not by event. State lies in RocksDB, not in the workers' memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.network import concurrency_key

#: Counters are reset every quarter of an hour; quotas are those of a day.
RESET_US = 15 * 60 * 1_000_000
DAY_US = 24 * 60 * 60 * 1_000_000
EVENTS = "events binary"  # (at_us, step, id) of some events of a client, as arrays of longs
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State that outgrows memory, and that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InTimeOrder(StatefulProcessor):
    """Events (id, at_us, step) of a client, handled once each in the order of (at_us, step, id)."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", EVENTS)
        self.due = handle.getValueState("due", "at_ms long")
        self.open(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        at = new["at_us"].to_numpy()
        self.waiting.appendList([(np.stack([at, new["step"].to_numpy(), new["id"].to_numpy()]).astype(np.int64).tobytes(),)])
        self._wake(-(-int(at.min()) // 1000))
        yield self.empty()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.due.exists() and self.due.get()[0] <= now:
            self.due.clear()
        parts = [np.frombuffer(x[0], dtype=np.int64).reshape(3, -1) for x in self.waiting.get()] if self.waiting.exists() else []
        every = np.unique(np.concatenate([np.empty((3, 0), dtype=np.int64), *parts], axis=1), axis=1)
        n = int(np.searchsorted(every[0], 1000 * now, side="right"))
        at, step, ident = every[:, :n].tolist()
        ripe = list(zip(ident, at, step))
        if n < every.shape[1]:
            self.waiting.put([(np.ascontiguousarray(every[:, n:]).tobytes(),)])
            self._wake(-(-int(every[0, n]) // 1000))
        else:
            self.waiting.clear()
        until = self.expire(1000 * now) if not ripe else None
        out = self.handle_events(key, ripe) if ripe else self.empty()
        if ripe:
            until = self.expire(1000 * now)
        if until is not None:
            self._wake(-(-until // 1000))
        yield out

    def _wake(self, at_ms: int) -> None:
        """A timer at this time, unless there is an earlier one."""
        if self.due.exists():
            old = self.due.get()[0]
            if old <= at_ms:
                return
            self.handle.deleteTimer(old)
        self.due.update((at_ms,))
        self.handle.registerTimer(at_ms)

    def close(self) -> None:
        pass

    def open(self, handle) -> None:
        raise NotImplementedError

    def handle_events(self, key, events: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def expire(self, now_us: int) -> int | None:
        """Drop what has ended; when to look again."""
        raise NotImplementedError

    def empty(self) -> pd.DataFrame:
        raise NotImplementedError


CONCURRENCY = "client string, id long, step int, at_us long, running int"


class ConcurrencyCounter(InTimeOrder):
    """Requests of a client that run at once: an end counts down, not below 0, and all counters start anew at fixed times."""

    def __init__(self, reset_us: int = RESET_US):
        self.reset_us = reset_us

    def open(self, handle) -> None:
        self.counter = handle.getValueState("counter", "running int, period long")

    def handle_events(self, key, events: list[tuple]) -> pd.DataFrame:
        running, period = self.counter.get() if self.counter.exists() else (0, -1)
        out = []
        for ident, at, step in events:
            if at // self.reset_us != period:
                running, period = 0, at // self.reset_us
            running = running + 1 if step > 0 else max(0, running - 1)
            out.append(running)
        self.counter.update((running, period))
        return pd.DataFrame({"client": key[0], "id": [e[0] for e in events], "step": np.array([e[2] for e in events], dtype=np.int32), "at_us": [e[1] for e in events], "running": np.array(out, dtype=np.int32)})

    def expire(self, now_us: int) -> int | None:
        if not self.counter.exists():
            return None
        end = (self.counter.get()[1] + 1) * self.reset_us
        if end <= now_us:
            self.counter.clear()
            return None
        return end

    def empty(self) -> pd.DataFrame:
        return pd.DataFrame({"client": pd.Series(dtype=str), "id": pd.Series(dtype="int64"), "step": pd.Series(dtype="int32"), "at_us": pd.Series(dtype="int64"), "running": pd.Series(dtype="int32")})


QUOTA = "client string, id long, used long"


class RollingQuota(InTimeOrder):
    """Successes (step 1) of a client in the day up to each of its requests, those of the same moment included."""

    def open(self, handle) -> None:
        self.successes = handle.getListState("successes", "at_us long")

    def handle_events(self, key, events: list[tuple]) -> pd.DataFrame:
        at = np.array([e[1] for e in events])
        old = np.array([x[0] for x in self.successes.get()], dtype=np.int64) if self.successes.exists() else np.empty(0, dtype=np.int64)
        every = np.concatenate([old, at[[e[2] > 0 for e in events]]])  # both ascend, and new ones are later
        used = np.searchsorted(every, at, side="right") - np.searchsorted(every, at - DAY_US, side="left")
        kept = every[np.searchsorted(every, at[-1] - DAY_US, side="left") :]
        if len(kept):
            self.successes.put([(x,) for x in kept.tolist()])
        else:
            self.successes.clear()
        return pd.DataFrame({"client": key[0], "id": [e[0] for e in events], "used": used})

    def expire(self, now_us: int) -> int | None:
        if not self.successes.exists():
            return None
        last = max(x[0] for x in self.successes.get())
        if last + DAY_US < now_us:
            self.successes.clear()
            return None
        return last + DAY_US + 1000

    def empty(self) -> pd.DataFrame:
        return pd.DataFrame({"client": pd.Series(dtype=str), "id": pd.Series(dtype="int64"), "used": pd.Series(dtype="int64")})


def _watched(events: DataFrame, time_col: str, late: str) -> DataFrame:
    return events.withWatermark(time_col, late).withColumn("at_us", F.unix_micros(F.col(time_col)))


def concurrency_stream(events: DataFrame, late: str = "1 minute", reset_us: int = RESET_US, time_col: str = "created") -> DataFrame:
    """events(id, ip, created, step: +1 start, -1 end) -> client, id, step, at_us, running, once the watermark has passed."""
    use_rocksdb(events.sparkSession)
    rows = _watched(events, time_col, late).select(time_col, concurrency_key(F.col("ip")).alias("client"), "id", "at_us", F.col("step").cast("int").alias("step"))
    return rows.groupBy("client").transformWithStateInPandas(ConcurrencyCounter(reset_us), CONCURRENCY, "Append", "EventTime")


def quota_stream(logs: DataFrame, key: str = "user_id", late: str = "10 minutes", time_col: str = "created") -> DataFrame:
    """logs(id, created, code, key) -> client, id, used: successes in the day up to each request, once the watermark has passed."""
    use_rocksdb(logs.sparkSession)
    rows = _watched(logs.filter(F.col(key).isNotNull()), time_col, late).select(time_col, F.col(key).cast("string").alias("client"), "id", "at_us", F.when(F.col("code") == 200, 1).otherwise(0).cast("int").alias("step"))
    return rows.groupBy("client").transformWithStateInPandas(RollingQuota(), QUOTA, "Append", "EventTime")


def run_to_end(spark: SparkSession, source: DataFrame, last: DataFrame, flow, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """All that ``flow`` makes of ``source`` read as a stream; ``last`` (a row far behind all others) moves the watermark past them.

    Run after run from one checkpoint: a run that stops is taken up by the next one.
    """
    source.write.mode("append").parquet(f"{folder}/in")

    def once() -> None:
        stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/in")
        flow(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    once()
    last.write.mode("append").parquet(f"{folder}/in")
    once()
    return spark.read.parquet(f"{folder}/out")
