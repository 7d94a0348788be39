"""Raw video frames: files of RGB rasters one after another, and the decoder's log that tells their times.

A clip is a file ``<name>.rgb`` of whole rasters (bytes after the last whole one are left out) and a text ``<name>.log`` whose lines
hold ``pts_time:<seconds>``. The n-th raster belongs to the n-th time; rasters or times without a partner are left out, so a clip
without a log has no frames.

Files are split by bytes on both sides, so one long clip is many tasks: rasters have a known size, and times are numbered within
each split of the log and moved up by the number of times in the splits before.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WIDTH, HEIGHT = 320, 180
BLOCK_BYTES = 32 << 20
BATCH_BYTES = 4 << 20
TIME = r"pts_time:\s*(\d+\.?\d*)"


def _open_root(root: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root)
    return system, base.rstrip("/")


@dataclass
class Piece:
    """``count`` rasters of a file from number ``first`` on."""

    path: str
    name: str
    first: int
    count: int


class Block(InputPartition):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces


class RawFrames(DataSource):
    """Format ``rawframes``: (name, frame, data), or (name, frame, vector) with option ``layout``.

    Options: ``width``, ``height``, ``extension`` (rgb), ``blockBytes`` (of one task). With ``layout`` the descriptor is computed where
    the bytes are read, and no raster leaves the worker. Small files share a task.
    """

    @classmethod
    def name(cls) -> str:
        return "rawframes"

    def _layout(self) -> bool:
        return self.options.get("layout", "false").lower() == "true"

    def schema(self) -> str:
        return "name string, frame long, " + ("vector array<int>" if self._layout() else "data binary")

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        size = int(o.get("width", WIDTH)), int(o.get("height", HEIGHT))
        if min(size) < 1:
            raise ValueError("width and height must be positive")
        return RawFrameReader(o["path"], *size, o.get("extension", "rgb"), int(o.get("blockBytes", BLOCK_BYTES)), self._layout())


class RawFrameReader(DataSourceReader):
    def __init__(self, root: str, width: int, height: int, extension: str, block_bytes: int, layout: bool):
        self.root, self.width, self.height, self.extension, self.layout = root, width, height, extension, layout
        self.raster = 3 * width * height
        self.most = max(1, block_bytes // self.raster)

    def partitions(self) -> list[Block]:
        """Only names and sizes are read here, as in any listing of files."""
        from pyarrow import fs

        system, base = _open_root(self.root)
        suffix = "." + self.extension
        blocks, pieces, room = [], [], self.most
        for info in sorted(system.get_file_info(fs.FileSelector(base, recursive=True)), key=lambda i: i.path):
            if info.type != fs.FileType.File or not info.path.endswith(suffix):
                continue
            first, every = 0, info.size // self.raster
            while first < every:
                count = min(room, every - first)
                pieces.append(Piece(info.path, posixpath.relpath(info.path, base).removesuffix(suffix), first, count))
                first, room = first + count, room - count
                if not room:
                    blocks.append(Block(pieces))
                    pieces, room = [], self.most
        return [*blocks, Block(pieces)]

    def read(self, partition: Block) -> Iterator:
        import pyarrow as pa

        from ..operators.descriptor import colour_layout

        system, _ = _open_root(self.root)
        step = max(1, BATCH_BYTES // self.raster)
        for piece in partition.pieces:
            with system.open_input_file(piece.path) as file:
                for at in range(piece.first, piece.first + piece.count, step):
                    count = min(step, piece.first + piece.count - at)
                    raw = file.read_at(count * self.raster, at * self.raster)
                    rasters = [raw[i * self.raster : (i + 1) * self.raster] for i in range(count)]
                    if self.layout:
                        last = ("vector", pa.array([colour_layout(r, self.width, self.height) for r in rasters], pa.list_(pa.int32())))
                    else:
                        last = ("data", pa.array(rasters, pa.binary()))
                    columns = {"name": pa.array([piece.name] * count), "frame": pa.array(range(at, at + count), pa.int64()), last[0]: last[1]}
                    yield pa.RecordBatch.from_pydict(columns)


def raw_frames(spark: SparkSession, root: str, width: int = WIDTH, height: int = HEIGHT, layout: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    spark.dataSource.register(RawFrames)
    options = {"width": width, "height": height, "layout": str(layout).lower(), "blockBytes": block_bytes}
    return spark.read.format("rawframes").options(**options).load(root)


def frame_times(spark: SparkSession, root: str, extension: str = "log") -> DataFrame:
    """(name, frame, time): the n-th time of each log, counted from 0."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").text(root)
    base = _open_root(root)[1] + "/"
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    below = F.substr(path, F.instr(path, F.lit(base)) + F.lit(len(base)))
    name = F.regexp_replace(below, rf"\.{extension}$", "")
    # Lines keep a file's order within a split: a split is read by one task, in order.
    found = lines.select(
        name.alias("name"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"),
        F.regexp_extract_all("value", F.lit(TIME), F.lit(1)).alias("times"),
    ).filter(F.size("times") > 0)
    each = found.select("name", "split", "line", F.posexplode("times").alias("pos", "time"))
    numbered = each.withColumn("n", F.row_number().over(Window.partitionBy("name", "split").orderBy("line", "pos")))
    before = Window.partitionBy("name").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("name", "split").agg(F.sum(F.size("times")).alias("count"))
    starts = counts.select("name", "split", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    return numbered.join(starts, ["name", "split"]).select("name", (F.col("start") + F.col("n") - 1).alias("frame"), F.col("time").cast("double").alias("time"))


def timed_frames(spark: SparkSession, root: str, **options) -> DataFrame:
    """(name, frame, time, data or vector): rasters of all clips below a folder with their times."""
    return raw_frames(spark, root, **options).join(frame_times(spark, root), ["name", "frame"])


def write_files(files: DataFrame, root: str) -> int:
    """Write files(name, data) below a folder, each by the task that holds its row; their number.

    Null data is an empty file, rows without a name are left out. A repeated task writes the same file again.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open_root(root)
        for pdf in batches:
            for name, data in zip(pdf["name"], pdf["data"]):
                path = f"{base}/{name}"
                system.create_dir(posixpath.dirname(path), recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(b"" if data is None else bytes(data))
            yield pd.DataFrame({"n": [len(pdf)]})

    done = files.select("name", "data").filter("name IS NOT NULL").mapInPandas(write, "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
