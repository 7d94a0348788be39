"""Sources: media listings, frame blobs, catalogue documents, media description, images."""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD = 26_214_400
FRAMES = "array<struct<time:double,vector:array<int>>>"


def media_listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of media files below a folder; only metadata is read, as content isn't selected."""
    prefix = root.removeprefix("file://").rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{webm,mkv,mp4}").load(root)
    return found.select(F.substring_index(F.col("path"), prefix, -1).alias("path"), "length")


def frames_from_blobs(files: DataFrame, blob_col: str = "color_layout") -> DataFrame:
    """(file_id, time, vector): zstd-compressed JSON lists of frames, unpacked in Arrow batches and exploded."""

    @F.pandas_udf("string")
    def unpack(blob: pd.Series) -> pd.Series:
        import zstandard

        return blob.map(lambda b: None if b is None else zstandard.ZstdDecompressor().decompressobj().decompress(bytes(b)).decode())

    rows = files.select(F.col("id").alias("file_id"), F.explode(F.from_json(unpack(F.col(blob_col)), FRAMES)).alias("f"))
    return rows.select("file_id", "f.time", "f.vector")


def pack_frames(frames: list[dict]) -> bytes:
    import zstandard

    return zstandard.compress(json.dumps(frames).encode(), 19)


def catalog_documents(spark: SparkSession, path: str) -> DataFrame:
    """(id, json) from files of one JSON document a line."""
    raw = spark.read.text(path)
    return raw.select(F.get_json_object("value", "$.id").cast("int").alias("id"), F.col("value").alias("json")).filter("id IS NOT NULL")


def media_info(paths: DataFrame) -> DataFrame:
    """path -> (path, media_info): ffprobe's JSON, '{}' where it fails or isn't there."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = shutil.which("ffprobe")
        for pdf in batches:
            out = []
            for p in pdf["path"]:
                run = subprocess.run([tool, "-v", "quiet", "-of", "json", "-show_format", "-show_streams", p], capture_output=True, text=True, timeout=60) if tool else None
                out.append(run.stdout if run is not None and run.returncode == 0 else "{}")
            yield pd.DataFrame({"path": pdf["path"], "media_info": out})

    return paths.select("path").mapInPandas(probe, "path string, media_info string")


def small_enough(uploads: DataFrame, content_col: str = "content") -> DataFrame:
    return uploads.filter(F.octet_length(content_col) <= MAX_UPLOAD)


def id_range(spark: SparkSession, first: int, last: int) -> DataFrame:
    return spark.range(first, last)
