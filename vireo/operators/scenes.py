"""Scene boundaries: threshold, pairing, and the scene around a point of time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.2


def scene_threshold(changes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return changes.filter(F.col("score") > threshold)


def scene_intervals(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Consecutive boundaries of a key as half-open scenes [start_time, end_time)."""
    w = Window.partitionBy(key).orderBy(*order)
    return changes.withColumn("end_time", F.lead("t").over(w)).filter("end_time IS NOT NULL").select(key, F.col("t").alias("start_time"), "end_time")


def parse_scene_log(text: Column) -> Column:
    """(t, score) pairs of a detector's text log."""
    t = F.regexp_extract_all(text, F.lit(r"pts_time:([0-9.]+)"), F.lit(1))
    s = F.regexp_extract_all(text, F.lit(r"scene_score=([0-9.]+)"), F.lit(1))
    return F.transform(F.arrays_zip(t.alias("t"), s.alias("s")), lambda x: F.struct(x["t"].cast("double").alias("t"), x["s"].cast("double").alias("score")))


def clamp_duration(value: Column, default: float, low: float, high: float) -> Column:
    """A request's duration within limits; null, zero and NaN mean the default."""
    return F.least(F.greatest(F.when(value.isNull() | F.isnan(value.cast("double")) | (value == 0), F.lit(default)).otherwise(value), F.lit(low)), F.lit(high))


def strong_boundaries(boundaries: list[tuple[float, float]], shortest: float) -> list[float]:
    """Times left when, from the highest score down, each boundary removes neighbours closer than ``shortest``."""
    left = list(boundaries)
    for level in sorted({s for _, s in boundaries}, reverse=True):
        if level <= 0:  # scores are positive; the search for the next level ends at 0
            break
        done: set[int] = set()
        while True:
            at = next((i for i, b in enumerate(left) if b[1] == level and id(b) not in done), None)
            if at is None:
                break
            own = left[at]
            done.add(id(own))
            first, last = at, at
            while first > 0 and own[0] - left[first - 1][0] < shortest:
                first -= 1
            while last + 1 < len(left) and left[last + 1][0] - own[0] < shortest:
                last += 1
            left[first : last + 1] = [own]
    return [t for t, _ in left]


def scene_window(t: float, duration: float | None, changes: list[tuple[float, float]] | None, shortest: float, longest: float) -> tuple[float, float, float] | None:
    """(start, end, duration) of the scene around ``t``; None without a file or outside of it."""
    if duration is None or t < 0 or duration <= 0 or t > duration:
        return None
    if changes is not None:
        times = strong_boundaries([(0.0, 1.0), *[(float(a), float(s)) for a, s in changes], (float(duration), 1.0)], shortest)
        for start, end in zip(times, times[1:]):
            if start <= t < end:
                return max(0.0, max(start, t - longest)), min(duration, min(end, t + longest)), duration
    return max(0.0, t - shortest), min(t + shortest, duration), duration


def scene_windows(requests: DataFrame, shortest: float = 0.5, longest: float = 5.0) -> DataFrame:
    """requests(.., t, duration, changes array<struct<t,score>>) with ``scene`` (null, or start_time, end_time, duration)."""

    @F.arrow_udf("start_time double, end_time double, duration double")
    def window(t: pa.Array, duration: pa.Array, changes: pa.Array) -> pa.Array:
        # only one row's boundaries are Python objects at a time
        when, score = changes.values.field("t"), changes.values.field("score")
        some, ends = changes.is_valid().to_pylist(), changes.offsets.to_pylist()
        rows = []
        for i, (a, d) in enumerate(zip(t.to_pylist(), duration.to_pylist())):
            at = slice(ends[i], ends[i + 1])
            rows.append(scene_window(np.nan if a is None else float(a), None if d is None or np.isnan(d) else float(d), list(zip(when[at].to_pylist(), score[at].to_pylist())) if some[i] else None, shortest, longest))
        named = [pa.array([None if r is None else r[k] for r in rows], pa.float64()) for k in range(3)]
        return pa.StructArray.from_arrays(named, names=["start_time", "end_time", "duration"])

    return requests.withColumn("scene", window("t", "duration", "changes"))
