"""Structured Streaming forms: directory scan, staged ingestion, traffic, limits, stateful dedupe."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.network import client_network
from ..functions.text import base_name, episode_number, folder, is_media_path
from ..operators.dedupe import KEPT, WITHIN

LISTING = StructType().add("path", "string").add("modificationTime", "timestamp").add("length", "long").add("content", "binary")


def watch_directory(spark: SparkSession, root: str) -> DataFrame:
    """New media files below a folder, as (path relative to it, catalog_id, episode); contents are not read."""
    found = spark.readStream.format("binaryFile").schema(LISTING).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{webm,mkv,mp4}").load(root)
    prefix = root.removeprefix("file://").rstrip("/") + "/"
    path = F.substring_index(F.col("path"), prefix, -1)
    rows = found.select(path.alias("path")).filter(is_media_path(F.col("path")))
    return rows.select("path", folder(F.col("path")).cast("int").alias("catalog_id"), episode_number(base_name(F.col("path"))).alias("episode"))


def append_new(stream: DataFrame, table: str, checkpoint: str, once: bool = True):
    """Append the rows whose path the table lacks; scans every minute, or once over what is there.

    A replay of a batch finds the paths that its first run added and appends the rest.
    """

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["path"])
        try:
            new = new.join(batch.sparkSession.read.parquet(table).select("path"), "path", "left_anti")
        except Exception as e:  # the table doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        new.write.mode("append").parquet(table)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


def run_stage(pending: DataFrame, work, table: str, checkpoint: str):
    """A stage of ingestion: each pending row once through ``work(DataFrame) -> DataFrame``; a replayed batch replaces its results."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return pending.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def traffic(logs: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by time and code, final once the watermark has passed."""
    return logs.withWatermark("created", late).groupBy(F.window("created", width).alias("w"), "code").agg(F.count("*").alias("count")).select(F.col("w.start").alias("date_time"), "code", "count")


def rate_limits(logs: DataFrame, most: int = 100, width: str = "60 seconds", late: str = "1 minute") -> DataFrame:
    """Networks over their limit in tumbling windows (an approximation of windows that start at a first request)."""
    counted = logs.withWatermark("created", late).groupBy(F.window("created", width).alias("w"), client_network(F.col("ip")).alias("network")).agg(F.count("*").alias("requests"))
    return counted.filter(F.col("requests") > most).select("network", F.col("w.start").alias("window_start"), "requests")


def quota_use(logs: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Successes of a network in 24 hour windows that slide by the hour."""
    ok = logs.filter("code = 200").withWatermark("created", late)
    return ok.groupBy(F.window("created", "24 hours", "1 hour").alias("w"), client_network(F.col("ip")).alias("network")).agg(F.count("*").alias("used")).select("network", F.col("w.end").alias("until"), "used")


FRAME = StructType([StructField("frame_id", LongType()), StructField("file_id", IntegerType()), StructField("time", DoubleType()), StructField("vector", ArrayType(IntegerType()))])
KEPT_STATE = StructType([StructField("times", ArrayType(DoubleType())), StructField("vectors", ArrayType(ArrayType(IntegerType())))])


class FrameDeduper(StatefulProcessor):
    """The last kept frames of a file are the state; frames arrive in time order over batches."""

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", KEPT_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times, vectors = self.kept.get() if self.kept.exists() else ([], [])
        times, vectors = list(times), [tuple(v) for v in vectors]
        frames = pd.concat(list(rows)).sort_values(["time", "frame_id"])
        good = []
        for t, v in zip(frames["time"], frames["vector"].map(tuple)):
            fresh = not any(t - a < WITHIN and b == v for a, b in zip(times[-KEPT:], vectors[-KEPT:]))
            good.append(fresh)
            if fresh:
                times, vectors = [*times, float(t)][-KEPT:], [*vectors, v][-KEPT:]
        self.kept.update((times, [[int(x) for x in v] for v in vectors]))
        yield frames[good][[f.name for f in FRAME]]

    def close(self) -> None:
        pass


def dedupe_stream(frames: DataFrame) -> DataFrame:
    return frames.groupBy("file_id").transformWithStateInPandas(FrameDeduper(), FRAME, "append", "None")
