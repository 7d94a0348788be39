"""Tables derived from others, refreshed for what has changed; frames laid out by file.

A derived table lies in buckets of its key. A table of changes notes the keys whose rows may be other than before; a refresh derives
the rows of these keys anew, and writes the buckets that hold one of them into a folder of its own: what else these buckets
held, and the new rows. A line of the manifest then names, for each bucket written, its folder, and up to which change the table
is current. Other buckets keep their files, readers keep the version that they began with, and a refresh that is stopped is
not seen. A key without rows now simply has none; a bucket without rows has no folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number long, change long, folder string, buckets array<int>, filled array<int>"


def _found(read: Callable[[], list]) -> list:
    """Rows of a table that may not be there yet."""
    try:
        return read()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return []
        raise


class DerivedTable:
    """``derive`` maps rows of the base (or those of some keys) to derived rows; both have ``key``."""

    def __init__(self, spark: SparkSession, root: str, derive: Callable[[DataFrame], DataFrame], key: str = "id", buckets: int = 64):
        self.spark, self.root, self.derive, self.key, self.buckets = spark, root.rstrip("/"), derive, key, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> list:
        return _found(lambda: self.spark.read.schema(MANIFEST).json(f"{self.root}/_manifest").orderBy("number").collect())

    def _changes(self) -> list[int]:
        """Numbers of the changes noted so far."""
        return sorted(r[0] for r in _found(lambda: self.spark.read.schema("n long").json(f"{self.root}/_changes/_noted").select("n").distinct().collect()))

    def note(self, changed: DataFrame) -> int:
        """Note keys that are new, other than before, or gone."""
        n = 1 + max(self._changes(), default=0)
        changed.select(self.key).distinct().write.mode("overwrite").parquet(f"{self.root}/_changes/change={n}")
        self.spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("append").json(f"{self.root}/_changes/_noted")
        return n

    def _current(self) -> dict[int, str]:
        """The folder of each bucket that has rows."""
        out: dict[int, str] = {}
        for m in self._manifest():
            for b in m["buckets"]:
                out.pop(b, None)
            for b in m["filled"]:
                out[b] = m["folder"]
        return out

    def files(self) -> dict[int, str]:
        """Where each bucket lies."""
        return {b: f"{self.root}/{folder}/bucket={b}" for b, folder in self._current().items()}

    def read(self, schema=None, buckets: set[int] | None = None) -> DataFrame:
        """The table as it is now, or some buckets of it; ``schema`` is that of an empty table."""
        paths = [p for b, p in sorted(self.files().items()) if buckets is None or b in buckets]
        if not paths:
            if schema is None:
                raise FileNotFoundError(self.root)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(*paths)

    def refresh(self, base: DataFrame) -> set[int]:
        """Bring the table up to date with the changes noted since the last refresh; the buckets that were written."""
        manifest = self._manifest()
        since = max((m["change"] for m in manifest), default=0)
        new = [n for n in self._changes() if n > since]
        if not new:
            return set()
        keys = self.spark.read.parquet(*[f"{self.root}/_changes/change={n}" for n in new]).select(self.key).distinct()
        touched = {r[0] for r in keys.select(self._bucket().alias("bucket")).distinct().collect()}
        rows = self.derive(base.join(keys, self.key, "left_semi"))
        old = self.read(rows.schema, touched)
        kept = old.join(keys, self.key, "left_anti").select(*rows.columns)
        folder = f"v-{uuid.uuid4().hex}"
        every = kept.unionByName(rows).withColumn("bucket", self._bucket())
        every.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{self.root}/{folder}")
        filled = sorted(r[0] for r in self.spark.read.schema("bucket int").parquet(f"{self.root}/{folder}").select("bucket").distinct().collect())
        line = (1 + max((m["number"] for m in manifest), default=0), max(new), folder, sorted(touched), filled)
        self.spark.createDataFrame([line], MANIFEST).coalesce(1).write.mode("append").json(f"{self.root}/_manifest")
        return touched


def write_frames_by_file(frames: DataFrame, table: str, buckets: int = 64) -> DataFrame:
    """Frames as a table bucketed by file and sorted by time, to which later files are added in the same way.

    Joins by file (a search's filter, a clean-up) and windows over a file's frames (removal of near-duplicates) read it without
    dealing out frames.
    """
    writer = frames.write.bucketBy(buckets, "file_id").sortBy("file_id", "time", "frame_id").option("compression", "zstd")
    writer.mode("append").saveAsTable(table)
    return frames.sparkSession.table(table)
