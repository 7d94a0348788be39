"""Frame search: exact k-nearest frames, merged to intervals of a file, best intervals, joined to files and catalogue.

Queries and frames are dealt to cells (see :mod:`.nearest`); frames travel to them in packs and are read there pack by pack, in the
order of their ids, and only the nearest ``candidates`` of each query leave a cell. All pairs are compared, so the work grows with
both tables; a task holds its queries, some packs and what is nearest so far. Where a query has several cells (few queries, or
more than some million frames), its rows are ranked in ``SALTS`` parts first, so that what all tasks send never meets in one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import similarity
from .nearest import BLOCK, Stream, matrices, packer, shape_of, unpacked

MAX_QUERIES = 10
CANDIDATES = 1000
SALTS = 64
GAP = 5.0
RESULTS = 10
WHOLE = ("array<tinyint>", "array<smallint>", "array<int>")


def nearest_frames(frames: DataFrame, queries: DataFrame, candidates: int = CANDIDATES) -> DataFrame:
    """frames x queries(query_id, qvec) -> query_id, frame_id, file_id, time, score: the ``candidates`` nearest.

    Vectors of another length than the query's, null ones and those with a null component are no match.
    """
    kinds = [queries.schema["qvec"].dataType.simpleString(), frames.schema["vector"].dataType.simpleString()]
    whole = all(k in WHOLE for k in kinds)
    numbers = lambda name, kind: F.col(name).cast("array<int>" if whole else kind if kind == "array<float>" else "array<double>").alias(name)
    asked = queries.filter("qvec IS NOT NULL").select("query_id", numbers("qvec", kinds[0]))
    every = frames.filter("vector IS NOT NULL").select("frame_id", "file_id", F.col("time").cast("double").alias("time"), numbers("vector", kinds[1]))
    known = asked.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("ids")).first()
    blocks, groups = shape_of(known["n"], every.count(), 1, BLOCK)
    found = _by_cells(every, asked, candidates, whole, blocks, groups)
    return found if groups == 1 and known["ids"] == known["n"] else nearest_of_each(found, candidates)


def by_cell(rows: DataFrame, asked: DataFrame, cells: int, compare, schema: str) -> DataFrame:
    """``compare(rows, queries)`` for each cell, a task for a few cells whatever their size in bytes."""
    left, right = (x.repartition(cells, "cell").groupBy("cell") for x in (rows, asked))
    return left.cogroup(right).applyInArrow(compare, schema)


def _by_cells(every: DataFrame, asked: DataFrame, candidates: int, whole: bool, blocks: int, groups: int) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in [*every.schema, *asked.schema]}

    def cell(packs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        queries, streams = [], None
        for _, is_row, pack in packs:
            some = unpacked(pack)
            if not is_row.as_py():
                queries.append(some)
                continue
            if streams is None and queries:  # they come before all rows
                asked = pa.concat_tables(queries)
                streams = {length: (number, Stream(q, candidates, whole)) for length, (number, q) in matrices(asked["qvec"]).items()}
            for length, (place, x) in matrices(some["vector"]).items() if streams else ():
                if length in streams:
                    streams[length][1].add(x, some.select(["frame_id", "file_id", "time"]).take(pa.array(place)))
        for number, stream in (streams or {}).values():
            if not stream.parts:
                continue
            of, score, rows = stream.nearest()
            if whole and len(score) and score.max() > np.iinfo(np.int32).max:
                raise OverflowError("a squared distance is no int")
            score = pa.array(score.astype(np.int32 if whole else np.float64), from_pandas=False)
            yield from pa.table([asked["query_id"].take(pa.array(number[of])), *rows.columns, score], names=["query_id", *rows.column_names, "score"]).combine_chunks().to_batches(100_000)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = (x for b in batches for x in zip(b.column("cell").to_pylist(), b.column("is_row"), b.column("pack")))
        for _, of_cell in groupby(packs, key=lambda x: x[0]):
            yield from cell(of_cell)

    packed = lambda rows, vector: rows.mapInArrow(packer(vector), "number long, pack binary")
    block, group = F.shiftright("number", 32).cast("int") % blocks, F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")
    cells = lambda first, last, step: F.explode(F.sequence(first, last, F.lit(step))).alias("cell")
    rows = packed(every.sort("frame_id"), "vector").select(cells(group, F.lit(blocks * groups - 1), groups), F.lit(True).alias("is_row"), "number", "pack")
    queries = packed(asked.repartition(blocks), "qvec").select(cells(block * groups, block * groups + groups - 1, 1), F.lit(False).alias("is_row"), "number", "pack")
    schema = f"query_id {kind['query_id']}, frame_id {kind['frame_id']}, file_id {kind['file_id']}, time double, score {'int' if whole else 'double'}"
    return queries.union(rows).repartitionById(blocks * groups, "cell").sortWithinPartitions("cell", "is_row", "number").mapInArrow(compare, schema)


def nearest_of_each(scored: DataFrame, candidates: int) -> DataFrame:
    """The ``candidates`` rows of least score (then frame_id) of each query, ranked in parts first; without a score is no match."""
    scored = scored.filter("score IS NOT NULL")
    nearest_first = ("score", "frame_id")
    by_part = F.row_number().over(Window.partitionBy("query_id", "salt").orderBy(*nearest_first))
    some = scored.withColumn("salt", F.pmod(F.xxhash64("frame_id"), F.lit(SALTS))).withColumn("rank", by_part).filter(F.col("rank") <= candidates).drop("salt", "rank")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*nearest_first))
    return some.withColumn("rank", rank).filter(F.col("rank") <= candidates).drop("rank")


def merge_matches(hits: DataFrame, gap: float = GAP) -> DataFrame:
    """Hits of a file less than ``gap`` apart become one interval with its best score and that score's first time."""
    by_file = Window.partitionBy("query_id", "file_id").orderBy("time", "frame_id")
    opens = F.when(F.col("time") - F.lag("time").over(by_file) < gap, 0).otherwise(1)
    island = F.sum("opens").over(by_file.rowsBetween(Window.unboundedPreceding, 0))
    return (
        hits.withColumn("opens", opens)
        .withColumn("island", island)
        .groupBy("query_id", "file_id", "island")
        .agg(F.min("time").alias("from_time"), F.max("time").alias("to_time"), F.min("score").alias("score"), F.min_by("time", F.struct("score", "time")).alias("at_time"))
        .drop("island")
    )


def best_matches(matches: DataFrame, results: int = RESULTS) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "from_time", "file_id"))
    return matches.withColumn("rank", rank).filter(F.col("rank") <= results)


def frame_search(frames: DataFrame, queries: DataFrame, files: DataFrame, candidates: int = CANDIDATES, results: int = RESULTS) -> DataFrame:
    """The whole search. Files are joined behind the limit, so a missing file makes the result shorter.

    They are joined by merging: files compress so well that Spark, which goes by the size on disk, would gather them in the driver.
    """
    best = best_matches(merge_matches(nearest_frames(frames, queries, candidates)), results)
    known = files.select(F.col("id").alias("file_id"), "catalog_id", "path", "duration", "episode")
    return best.join(known.hint("merge"), "file_id").select("query_id", "rank", "file_id", "catalog_id", F.substring_index("path", "/", -1).alias("filename"), "episode", "from_time", "at_time", "to_time", "duration", similarity(F.col("score")).alias("similarity"))


def frame_search_filtered(frames: DataFrame, queries: DataFrame, files: DataFrame, catalog_id: int, **options) -> DataFrame:
    """The search within the files of one catalogue entry; no such file: no rows."""
    wanted = files.filter(F.col("catalog_id") == catalog_id)
    return frame_search(frames.join(wanted.select(F.col("id").alias("file_id")), "file_id", "left_semi"), queries, wanted, **options)


def with_catalog(results: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add the catalogue document of each result; unknown entries keep their bare id. Documents aren't gathered in the driver either."""
    return results.join(catalog.select(F.col("id").alias("catalog_id"), F.col("json").alias("catalog_json")).hint("merge"), "catalog_id", "left")
