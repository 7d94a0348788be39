"""Inverted file with scalar quantisation: lists around centroids as partitions of a table, few of which a search reads.

Every frame is assigned to its nearest centroid and kept with one byte a component beside its whole vector. A search is one
plan for all its queries: the lists that a block of queries probes are joined to the table by list, so that partitions of other
lists aren't read, and dealt to cells of bounded size (see :mod:`.nearest`). A task compares each query with the codes of its own
lists, ranks the best few times ``candidates`` by exact distance, and sends on ``candidates`` of them. Only frames of lists that
aren't probed, or whose code misleads by more than the surplus, can be missed; :func:`recall` measures how many.

Centroids are fitted on a bounded sample (``SAMPLE`` frames by hash order); bounds of components are those of all frames. Both
lie beside the table, in a model of ``lists`` rows that passes through the driver (16384 lists of 33 components: 4 MB).
Null vectors and those of another length than most are not indexed; nor is anything of an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import by_cell, nearest_of_each
from .nearest import STRETCH, Nearest, exact_distances, expanded, expanded_queries, in_order, matrices, shape_of

SAMPLE = 50_000
ROUNDS = 8
SEED = 5
ROWS = 2048  # vectors that are compared with all centroids at once
SPLITS = 16  # tasks that write a list at most
SURPLUS = 3
READ = 1_000_000


@dataclass
class Model:
    centroids: np.ndarray
    low: np.ndarray
    step: np.ndarray


def fit_centroids(frames: DataFrame, lists: int) -> np.ndarray:
    rows = frames.select("vector", F.xxhash64("frame_id").alias("h")).orderBy("h").limit(SAMPLE).collect()
    x = np.array([r["vector"] for r in rows], dtype=np.float64)
    if not len(x):
        return np.zeros((0, 0))
    centroids = x[np.random.default_rng(SEED).choice(len(x), size=min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(x, centroids)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        count = np.bincount(near, minlength=len(centroids))[:, None]
        centroids = np.where(count > 0, sums / np.maximum(count, 1), centroids)
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray, n: int = 1) -> np.ndarray:
    """The numbers of the n nearest centroids of each vector, nearest first."""
    out = []
    for at in range(0, len(x), ROWS):
        d = (centroids**2).sum(1)[None, :] - 2 * x[at : at + ROWS] @ centroids.T
        out.append(d.argmin(1)[:, None] if n == 1 else np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.empty((0, n), dtype=np.int64)


def fit(frames: DataFrame, lists: int) -> Model:
    centroids = fit_centroids(frames, lists)
    n = centroids.shape[1]
    bounds = frames.agg(*[f(F.get("vector", F.lit(i)).cast("double")).alias(f"{k}{i}") for i in range(n) for k, f in (("low", F.min), ("high", F.max))]).first() if n else {}
    low, high = (np.array([bounds[f"{k}{i}"] for i in range(n)]) for k in ("low", "high"))
    return Model(centroids, low, np.where(high > low, (high - low) / 255, 1.0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def encode(frames: DataFrame, model: Model) -> DataFrame:
    """frames with ``list`` and ``code`` (one byte a component, shifted to -128..127)."""
    held = frames.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vector"))
            code = np.clip(np.rint((x - m.low) / m.step), 0, 255).astype(np.int16) - 128
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest(x, m.centroids)[:, 0].astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(code.astype(np.int8).ravel()))], names=[*b.schema.names, "list", "code"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema)
    return frames.mapInArrow(apply, f"{schema}, list int, code array<tinyint>")


def write_index(frames: DataFrame, path: str, lists: int = 64) -> None:
    """Write the table partitioned by list, and the model beside it."""
    spark = frames.sparkSession
    rows = frames.select("frame_id", "file_id", F.col("time").cast("double").alias("time"), "vector").filter("vector IS NOT NULL")
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.filter(F.size("vector") == (usual["n"] if usual else -1))
    model = fit(rows, lists)
    split = F.pmod(F.xxhash64("frame_id"), F.lit(SPLITS))
    encode(rows, model).repartition("list", split).write.mode("overwrite").option("compression", "zstd").partitionBy("list").parquet(f"{path}/lists")
    made = [(int(k), c.tolist(), model.low.tolist(), model.step.tolist()) for k, c in enumerate(model.centroids)]
    spark.createDataFrame(made, "list int, centroid array<double>, low array<double>, step array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    # an index without frames has no partitions to tell its columns from
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/columns")


def read_model(spark: SparkSession, path: str) -> Model:
    rows = spark.read.parquet(f"{path}/model").orderBy("list").collect()
    return Model(np.array([r["centroid"] for r in rows]), np.array(rows[0]["low"]), np.array(rows[0]["step"])) if rows else Model(np.zeros((0, 0)), np.zeros(0), np.zeros(0))


def probes_of(queries: DataFrame, model: Model, probes: int) -> DataFrame:
    """queries(query_id, qvec) with ``lists``, those to read, nearest first. Queries of another length than the index have no match."""
    held = queries.sparkSession.sparkContext.broadcast(model)
    kind = {f.name: f.dataType.simpleString() for f in queries.schema}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            if not b.num_rows:
                continue
            near = nearest(_matrix(b.column("qvec")), m.centroids, min(max(2, probes), len(m.centroids)))[:, :probes]
            at = pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(near.astype(np.int32).ravel()))], names=[*b.schema.names, "lists"])

    fits = queries.select("query_id", "qvec").filter(F.size("qvec") == len(model.low))
    return fits.mapInArrow(apply, f"query_id {kind['query_id']}, qvec {kind['qvec']}, lists array<int>")


def guessed_places(code: np.ndarray, lists: np.ndarray, q: np.ndarray, probed: np.ndarray, model: Model, k: int) -> Nearest:
    """For each query the k rows of its lists that are nearest by their codes. Rows are sorted by list; probed(queries, lists) are true or false."""
    found, shifted = Nearest(len(q), k), expanded_queries(q - model.low - 128 * model.step)
    numbers, starts = np.unique(lists, return_index=True)
    for number, start, end in zip(numbers, starts, [*starts[1:], len(lists)]):
        of = np.flatnonzero(probed[:, number])
        for at in range(start, end, STRETCH) if len(of) else ():
            found.add(shifted[of] @ expanded(code[at : min(end, at + STRETCH)] * model.step).T, of, at)
    return found


def search(spark: SparkSession, path: str, queries: DataFrame, probes: int = 8, candidates: int = 1000, surplus: int = SURPLUS) -> DataFrame:
    """query_id, frame_id, file_id, time, score: the nearest frames of each query within its nearest lists."""
    model = read_model(spark, path)
    kind = queries.schema["query_id"].dataType.simpleString()
    if not len(model.centroids):
        return spark.read.parquet(f"{path}/columns").select(F.lit(None).cast(kind).alias("query_id"), "frame_id", "file_id", "time", F.lit(0.0).alias("score"))
    index = spark.read.parquet(f"{path}/lists")
    known = queries.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids")).first()
    blocks, groups = shape_of(known["n"], index.count(), 2 * len(model.low))
    held = spark.sparkContext.broadcast(model)

    def compare(rows: pa.Table, queries: pa.Table) -> pa.Table:
        m = held.value
        rows = rows.take(pa.array(in_order(rows["frame_id"])))
        rows = rows.take(pa.array(np.argsort(rows["list"].to_numpy(), kind="stable")))
        by_id = np.empty(len(rows), np.int64)
        by_id[in_order(rows["frame_id"])] = np.arange(len(rows))
        wanted, found, scores = [], [], []
        (_, code), (place, x) = (matrices(rows[c]).get(len(m.low), (None, None)) for c in ("code", "vector"))
        number, q = matrices(queries["qvec"]).get(len(m.low), (np.empty(0, np.int64), np.empty((0, len(m.low)))))
        if code is not None and len(x) == len(rows):
            probed = np.zeros((len(q), len(m.centroids)), bool)
            for i, lists in enumerate(queries["lists"].take(pa.array(number)).to_pylist()):
                probed[i, lists] = True
            near = guessed_places(code.astype(np.float64), rows["list"].to_numpy(), q.astype(np.float64), probed, m, surplus * candidates)
            for i in range(len(q)):
                at = near.of(i)[1]
                exact = exact_distances(x[at].astype(np.float64), q[i : i + 1].astype(np.float64))[0]
                best = np.lexsort((by_id[at], exact))[:candidates]
                wanted.append(np.full(len(best), number[i]))
                found.append(at[best])
                scores.append(exact[best])
        joined = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((wanted, np.int64), (found, np.int64), (scores, np.float64))]
        out = rows.select(["frame_id", "file_id", "time"]).take(pa.array(joined[1]))
        return pa.table([queries["query_id"].take(pa.array(joined[0])), *out.columns, pa.array(joined[2])], names=["query_id", *out.column_names, "score"])

    block = F.pmod(F.xxhash64("query_id", "qvec"), F.lit(blocks)).cast("int")
    asked = probes_of(queries, model, probes).withColumn("block", block)
    read = asked.select("block", F.explode("lists").alias("list")).distinct()
    group = F.pmod(F.xxhash64("frame_id", "file_id", "time"), F.lit(groups)).cast("int")
    # at most so many rows are broadcast
    rows = index.join(F.broadcast(read) if blocks * len(model.centroids) <= READ else read, "list").withColumn("cell", F.col("block") * groups + group).drop("block")
    asked = asked.withColumn("cell", F.explode(F.sequence(F.col("block") * groups, F.col("block") * groups + groups - 1))).drop("block")
    types = {f.name: f.dataType.simpleString() for f in index.schema}
    out = by_cell(rows, asked, blocks * groups, compare, f"query_id {kind}, frame_id {types['frame_id']}, file_id {types['file_id']}, time double, score double")
    return out if groups == 1 and known["ids"] == known["n"] else nearest_of_each(out, candidates)


def recall(found: DataFrame, exact: DataFrame) -> float:
    n = exact.count()
    return found.join(exact.select("query_id", "frame_id"), ["query_id", "frame_id"], "left_semi").count() / n if n else 1.0
