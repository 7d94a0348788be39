"""Keyed streams against batches and plain restatements: order, repetition, restarts, resets."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vireo.operators import accounts, analytics
from vireo.streaming import stateful

START = datetime(2024, 1, 1)


def flow_over(spark, folder, batches, schema, flow):
    """The flow's rows over batches that arrive one after the other, each run anew from the checkpoint."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).parquet(f"{folder}/in")
        q = flow(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{folder}/out").collect()


def restated(events, reset_us):
    """client -> running by plain counters."""
    counter, out = {}, {}
    for ident, ip, at, step in sorted(events, key=lambda e: (e[2], e[3], e[0])):
        us = int((at - START).total_seconds() * 1e6) + int((START - datetime(1970, 1, 1)).total_seconds()) * 10**6
        running, period = counter.get(ip, (0, None))
        if us // reset_us != period:
            running = 0
        running = running + 1 if step > 0 else max(0, running - 1)
        counter[ip] = running, us // reset_us
        out[ip, ident, step] = running
    return out


def test_concurrency_equals_batch_however_events_arrive(spark, tmp_path):
    rnd = random.Random(2)
    events = []
    for i in range(120):
        at = START + timedelta(seconds=rnd.randrange(3600), microseconds=rnd.choice([0, 0, 500, 999_999]))
        ip = f"10.0.0.{rnd.randrange(4)}"
        events += [(i, ip, at, 1), (i, ip, at + timedelta(seconds=rnd.choice([1, 20, 300, 2000])), -1)]
    events.sort(key=lambda e: e[2])
    batches = [events[k : k + 60] for k in range(0, len(events), 60)]
    for b in batches:
        rnd.shuffle(b)
    batches[1] = batches[1] + batches[1][:9]  # repeated within a batch
    last = [(10**6, "~", START + timedelta(days=2), 1)]
    schema = "id long, ip string, created timestamp, step int"
    got = flow_over(spark, str(tmp_path), [*batches, last, [(10**6 + 1, "~", START + timedelta(days=4), 1)]], schema, stateful.concurrency_stream)
    out = {(r.client, r.id, r.step): r.running for r in got if r.client != "~"}
    assert len(out) == sum(r.client != "~" for r in got)
    assert out == restated(events, stateful.RESET_US)
    df = spark.createDataFrame(events, schema).select("id", F.col("ip").alias("key"), F.unix_micros("created").alias("at_time"), "step")
    assert {(r.key, r.id, r.step): r.running for r in accounts.running_concurrency(df, "key", stateful.RESET_US).collect()} == out
    # without resets and with every end behind its start, the greatest value is the batch's peak
    peak = {r.key: r.peak for r in accounts.peak_concurrency(df, "key").collect()}
    running = {r.key: r.m for r in accounts.running_concurrency(df, "key", 10**18).groupBy("key").agg(F.max("running").alias("m")).collect()}
    assert peak == running


def test_late_and_repeated_events(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [(1, "a", at(0), 1), (2, "a", at(100), 1)],
        [(3, "a", at(600), 1)],  # the watermark passes 0 and 100
        [(1, "a", at(0), 1), (4, "a", at(50), 1), (3, "a", at(600), 1), (5, "a", at(560), -1)],  # repeated; late; repeated; in time
        [(9, "~", at(90_000), 1)], [(10, "~", at(190_000), 1)],
    ]
    got = flow_over(spark, str(tmp_path), batches, "id long, ip string, created timestamp, step int", stateful.concurrency_stream)
    assert sorted((r.id, r.running) for r in got if r.client == "a") == [(1, 1), (2, 2), (3, 2), (5, 1)]


def test_rolling_quota_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for i in range(150):
        at = START + timedelta(minutes=rnd.randrange(0, 60 * 24 * 4, 30))
        rows.append((i, rnd.choice([1, 2, 3, None]), rnd.choice([200, 200, 402]), at))
    rows += [(1000, 1, 200, START), (1001, 1, 402, START + timedelta(days=1)), (1002, 1, 402, START + timedelta(days=1, microseconds=1))]
    rows.sort(key=lambda r: r[3])
    batches = [rows[k : k + 60] for k in range(0, len(rows), 60)]
    schema = "id long, user_id int, code int, created timestamp"
    got = flow_over(spark, str(tmp_path), [*batches, [(10**6, 99, 402, START + timedelta(days=20))], [(10**6 + 1, 99, 402, START + timedelta(days=40))]], schema, stateful.quota_stream)
    batch = analytics.rolling_success(spark.createDataFrame(rows, schema).filter("user_id IS NOT NULL"), "user_id").collect()
    assert sorted((r.client, r.id, r.used) for r in got if r.client != "99") == sorted((str(r.user_id), r.id, r.used) for r in batch)


@pytest.mark.parametrize("per_batch", [1, 1000])
def test_run_to_end(spark, tmp_path, per_batch):
    rows = [(i, "c", START + timedelta(seconds=i), 1) for i in range(20)]
    schema = "id long, ip string, created timestamp, step int"
    last = spark.createDataFrame([(99, "~", START + timedelta(days=9), 1)], schema)
    out = stateful.run_to_end(spark, spark.createDataFrame(rows, schema).repartition(2), last, lambda s: stateful.concurrency_stream(s, late="1 hour"), str(tmp_path), per_batch)
    assert sorted((r.id, r.running) for r in out.collect() if r.client == "c") == [(i, i + 1) for i in range(20)]


def test_a_batch_waits_as_one_value():
    import pandas as pd

    class State:
        def __init__(self):
            self.rows = []

        exists = lambda self: bool(self.rows)
        get = lambda self: self.rows
        clear = lambda self: self.rows.clear()
        put = lambda self, rows: setattr(self, "rows", list(rows))
        appendList = lambda self, rows: self.rows.extend(rows)

    class Value(State):
        get = lambda self: self.rows
        update = lambda self, row: setattr(self, "rows", list(row))

    class Handle:
        getListState = lambda self, *_: State()
        getValueState = lambda self, *_: Value()
        registerTimer = deleteTimer = lambda self, _: None

    class Now:
        getCurrentWatermarkInMs = lambda self: 2

    counter = stateful.ConcurrencyCounter(10**9)
    counter.init(Handle())
    batch = pd.DataFrame({"id": [5, 3, 4, 4, 9], "at_us": [2000, 1000, 1000, 1000, 2001], "step": [-1, 1, 1, 1, 1]})
    list(counter.handleInputRows(("c",), iter([batch]), None))
    assert len(counter.waiting.rows) == 1
    list(counter.handleInputRows(("c",), iter([batch[:2]]), None))
    out = list(counter.handleExpiredTimer(("c",), Now(), None))[0]
    assert out["id"].tolist() == [3, 4, 5] and out["running"].tolist() == [1, 2, 1] and out["step"].tolist() == [1, 1, -1]
    assert len(counter.waiting.rows) == 1  # the one that is not ripe
