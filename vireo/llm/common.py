"""Shared plumbing: the cluster's shared folder, written intermediate tables, raw files in that folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..session import ensure_importable

_LOCAL_DIR: list[str] = []
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else the context's own.

    Only a local session without either gets a temporary folder; on a cluster that is an error.
    """
    ensure_importable(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL_DIR:
            _LOCAL_DIR.append(tempfile.mkdtemp(prefix="vireo-shared-"))
            atexit.register(shutil.rmtree, _LOCAL_DIR[0], ignore_errors=True)
        found = "file://" + _LOCAL_DIR[0]
        spark.sparkContext.setCheckpointDir(found)
    path = spark._jvm.org.apache.hadoop.fs.Path(found)  # without a scheme it is in the cluster's default store
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def ddl(kind: T.DataType) -> str:
    """A type as text, whatever the names of its fields."""
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{ddl(f.dataType)}" for f in kind) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{ddl(kind.elementType)}>"
    if isinstance(kind, T.MapType):
        return f"map<{ddl(kind.keyType)},{ddl(kind.valueType)}>"
    return kind.simpleString()


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that no other run uses."""
    path = f"{shared_dir(spark).rstrip('/')}/vireo/{tag}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def cleanup(spark: SparkSession) -> None:
    """Delete all that operators of this process wrote to the shared folder, once no result is read any more."""
    discard(spark, *_MADE)
    _MADE.clear()


def materialize(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._vireo_path = path
    return out


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes the shuffle files of a step when the step is done, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete written tables or folders that no later step reads."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._vireo_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@lru_cache(maxsize=64)
def _filesystem(base: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(base)


def open_store(base: str):
    """(filesystem, folder) of a shared folder's URI, usable on any executor."""
    if base.startswith("file:"):
        base = "file:///" + base[5:].lstrip("/")
    return _filesystem(base)


def put_file(base: str, name: str, data: bytes) -> None:
    """Write one file below ``base``; names are unique for each attempt, so no attempt disturbs another."""
    files, root = open_store(base)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/{name}") as f:
        f.write(data)


def get_file(base: str, name: str) -> bytes:
    files, root = open_store(base)
    with files.open_input_stream(f"{root}/{name}") as f:
        return f.read()


def by_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Deal rows by ``block`` to about as many tasks as there are blocks.

    A block's rows are small beside the block that its task loads, so their size must not decide on the number of tasks.
    """
    n = blocks.select("block").distinct().count()
    return rows.repartition(max(1, n), "block")


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
