"""Ingestion as a graph of stages: each row of a stage is worked on once, as soon as all that it needs is there.

A stage's results are a table (key, ok, result), a folder for each batch. A stage is a stream over the files table and over the
results of the stages that it needs, whichever comes last, so that nothing is polled: a batch's files are joined to the
result tables as they stand then, those that are ready and have no result yet go through the stage's work, and the batch's folder is
replaced, so that a replay does no harm. ``ok`` is the state of three values: no row is pending, true is done, false
has failed and is never tried again. Tables are joined by merging: results compress so well that Spark, which
goes by the size of files, would gather them in the driver to broadcast them. All streams run over what is there and stop; a run that was stopped is taken up
by the next, stage by stage, from the checkpoints.

Defined cases: a file whose key for a stage is null never gets ready for it; several files of one key are one row of that stage; work
that returns keys it wasn't asked for, or none for some, leaves those without a result (until the next batch, with ``retry``); an empty files table ends at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..session import checkpointed

RESULT = "key long, ok boolean, result string"


@dataclass(frozen=True)
class Stage:
    """``work`` maps rows of the files table, one for each ``key``, to (key, ok, result).

    With ``retry`` each batch also brings what earlier work gave no result for (a scan of the files table).
    """

    name: str
    key: str
    work: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    retry: bool = False


class StageGraph:
    def __init__(self, spark: SparkSession, root: str, stages: list[Stage], files_schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), files_schema
        self.stages = {s.name: s for s in stages}
        seen: set[str] = set()
        for s in stages:
            if not set(s.needs) <= seen:
                raise ValueError(f"{s.name} needs a stage that doesn't stand before it")
            seen.add(s.name)
        self._ensure("files", files_schema)
        for s in stages:
            self._ensure(f"results/{s.name}", RESULT)

    def _ensure(self, table: str, schema: str) -> None:
        """A table has a folder without rows from the beginning, so that it can be read."""
        self.spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{table}/batch=-1")

    def add_files(self, files: DataFrame, batch: int) -> None:
        """Files that are new; the same batch again replaces itself."""
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        files.write.mode("overwrite").parquet(f"{self.root}/files/batch={batch}")

    def files(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, batch long").parquet(f"{self.root}/files").drop("batch")

    def results(self, name: str, but: int | None = None) -> DataFrame:
        out = self.spark.read.schema(f"{RESULT}, batch long").parquet(f"{self.root}/results/{name}")
        return (out if but is None else out.filter(F.col("batch") != but)).drop("batch")

    def ready(self, files: DataFrame, name: str, but: int | None = None) -> DataFrame:
        """Of these files one row for each key that is ready for a stage and has no result of it."""
        stage = self.stages[name]
        for n in stage.needs:
            done = self.results(n).filter("ok").select(F.col("key").alias(self.stages[n].key)).distinct()
            files = files.join(done.hint("merge"), self.stages[n].key, "left_semi")
        settled = self.results(name, but).select(F.col("key").alias(stage.key))
        return files.filter(F.col(stage.key).isNotNull()).join(settled.hint("merge"), stage.key, "left_anti").dropDuplicates([stage.key])

    def _triggers(self, stage: Stage) -> DataFrame:
        """A stream of the files that a new file or a new result concerns."""
        read = lambda table, schema: self.spark.readStream.schema(f"{schema}, batch long").parquet(f"{self.root}/{table}").drop("batch")
        files = read("files", self.schema)
        out = files
        for n in stage.needs:
            key = self.stages[n].key
            new = read(f"results/{n}", RESULT).filter("ok").select(F.col("key").alias(key))
            out = out.unionByName(new.hint("merge").join(self.files().hint("merge"), key).select(*files.columns))
        return out

    def start(self, name: str):
        stage = self.stages[name]

        def write(batch: DataFrame, number: int) -> None:
            todo = checkpointed(self.ready(self.files() if stage.retry else batch, name, number))
            done = stage.work(todo).select("key", "ok", F.col("result").cast("string").alias("result"))
            done.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/results/{name}/batch={number}")

        stream = self._triggers(stage).writeStream.queryName(f"stage_{name}").foreachBatch(write)
        return stream.option("checkpointLocation", f"{self.root}/state/{name}").trigger(availableNow=True).start()

    def run(self) -> None:
        """All stages over all that is there, those that need nothing from each other side by side."""
        done: set[str] = set()
        while len(done) < len(self.stages):
            level = [s.name for s in self.stages.values() if s.name not in done and set(s.needs) <= done]
            queries = [self.start(n) for n in level]
            errors = []
            for q in queries:
                try:
                    q.awaitTermination()
                except Exception as e:
                    errors.append(e)
            if errors:
                raise errors[0]
            done.update(level)

    def states(self) -> DataFrame:
        """The files with a column for each stage: null pending, true done, false failed."""
        out = self.files()
        for s in self.stages.values():
            of = self.results(s.name).groupBy("key").agg(F.min("ok").alias(s.name)).withColumnRenamed("key", f"_{s.name}")
            out = out.join(of.hint("merge"), F.col(s.key) == F.col(f"_{s.name}"), "left").drop(f"_{s.name}")
        return out


PROGRESS = "name string, run string, batch long, at string, rows long, seconds double"


class ProgressTable(StreamingQueryListener):
    """Appends a row for each batch of each stream to a table, when a stream ends or ``every`` rows are held."""

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.path, self.every, self.rows = spark, path, every, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((p.name, str(p.runId), int(p.batchId), p.timestamp, int(p.numInputRows), float(p.batchDuration) / 1000))
        if len(self.rows) >= self.every:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)
