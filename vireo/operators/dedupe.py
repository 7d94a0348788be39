"""Removal of near-duplicate frames in time order, against the frames kept so far."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WITHIN = 2.0
KEPT = 50


class Keeper:
    """Which frames of a file stay, given in time order, batch after batch.

    A frame goes if the last kept frame of its vector is less than ``WITHIN`` before and among the last ``KEPT`` kept ones; that
    one is both the nearest in time and the latest kept, so no other need be looked at. Frames whose vector stood nowhere
    in the time before stay without a look; only the others are decided one by one.
    """

    def __init__(self) -> None:
        self.kept = 0
        self.last: dict[int, tuple[float, int]] = {}  # by vector: time and number of its last kept frame

    def admit(self, times: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """vectors: a number for each, equal for equal ones."""
        n = len(times)
        order = np.lexsort((np.arange(n), vectors))
        before = np.full(n, -1)
        same = vectors[order[1:]] == vectors[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        seen = np.array([self.last.get(v, (-np.inf,))[0] for v in vectors[before < 0].tolist()])
        since = np.empty(n)
        since[before < 0] = times[before < 0] - seen
        since[before >= 0] = times[before >= 0] - times[before[before >= 0]]
        stays = np.ones(n, dtype=bool)
        gone = 0  # frames dropped so far in this batch
        kept_of = np.arange(n)  # the last kept frame of the vector at each place, or -2 for one of an earlier batch
        doubtful = np.flatnonzero(since < WITHIN)
        drops = []
        for i in doubtful.tolist():
            p = int(before[i])
            k = -2 if p < 0 else int(kept_of[p])
            if k == -2:
                t, place = self.last[int(vectors[i])]
            else:
                t, place = times[k], self.kept + k - bisect_left(drops, k)
            if times[i] - t < WITHIN and self.kept + i - gone - place <= KEPT:
                stays[i] = False
                kept_of[i] = k
                drops.append(i)
                gone += 1
        places = self.kept + np.cumsum(stays) - 1
        for i in kept_of[order[np.append(~same, True)]].tolist() if n else ():  # once for each vector
            if i >= 0:
                self.last[int(vectors[i])] = (float(times[i]), int(places[i]))
        self.kept += n - gone
        if len(self.last) > 100_000:  # those that no later frame can meet
            self.last = {v: x for v, x in self.last.items() if self.kept - x[1] <= KEPT}
        return stays


def dedupe_frames(frames: DataFrame) -> DataFrame:
    """frame_id, file_id, time, vector without frames that repeat one kept shortly before in the same file.

    Numbered by file and streamed in time order: a task holds the last kept frame of each vector of one file, however long
    it is. Vectors are told apart by 64-bit hashes that Spark computes. A table bucketed by file isn't dealt out again.
    """
    in_time = Window.partitionBy("file_id").orderBy("time", "frame_id")
    ordered = frames.select("frame_id", "file_id", "time", "vector", F.xxhash64("vector").alias("_code")).withColumn("_n", F.row_number().over(in_time))

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file_id, keeper = None, Keeper()
        for pdf in batches:
            good = []
            for f, part in pdf.groupby("file_id", sort=False, dropna=False):
                if f != file_id:
                    file_id, keeper = f, Keeper()
                good.append(keeper.admit(part["time"].to_numpy(), part["_code"].to_numpy()))
            yield pdf[np.concatenate(good)].drop(columns=["_code", "_n"]) if good else pdf.drop(columns=["_code", "_n"])

    return ordered.mapInPandas(apply, ordered.drop("_code", "_n").schema)
