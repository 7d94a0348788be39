"""Windows from a first request, against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest

from vireo.operators import rate_limits

START = datetime(2024, 1, 1)


def restated(rows, width, most):
    out, begun = [], {}
    for i, c, at in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        start, n = begun.get(c, (None, 0))
        if start is None or at >= start + width:
            start, n = at, 0
        begun[c] = start, n + 1
        out.append((i, c, start, n + 1, n + 1 > most))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, slices", [(1, 64), (2, 3)])
def test_against_a_loop(spark, monkeypatch, seed, slices):
    monkeypatch.setattr(rate_limits, "SLICE", slices)
    rnd = random.Random(seed)
    rows, i = [], 0
    for c in ("busy", "even", "rare", None):
        at = START + timedelta(seconds=rnd.randrange(100))
        for _ in range({"busy": 300, "even": 60, "rare": 30}.get(c, 20)):
            at += timedelta(seconds={"busy": rnd.choice([0, 1, 7, 13]), "even": 60}.get(c, rnd.choice([5, 59, 60, 61, 119, 120, 121, 500])), microseconds=rnd.choice([0, 0, 1]) if c != "even" else 0)
            rows.append((i, c, at))
            i += 1
    rows += [(1000, "busy", None), rows[3]]
    df = spark.createDataFrame(rows, "id long, ip string, created timestamp").repartition(3)
    got = rate_limits.first_request_windows(df, "ip", 60, 5).collect()
    assert sorted(((r.id, r.ip, r.window_start, r.nth, r.limited) for r in got), key=str) == restated(rows, timedelta(seconds=60), 5)


def test_long_unbroken_series(spark):
    rows = [(i, "c", START + timedelta(seconds=40 * i)) for i in range(400)]
    got = rate_limits.first_request_windows(spark.createDataFrame(rows, "id long, ip string, created timestamp"), "ip", 60, 1).collect()
    assert sorted(((r.id, r.ip, r.window_start, r.nth, r.limited) for r in got), key=str) == restated(rows, timedelta(seconds=60), 1)


def test_empty(spark):
    assert rate_limits.first_request_windows(spark.createDataFrame([], "id long, ip string, created timestamp"), "ip", 60, 1).count() == 0
