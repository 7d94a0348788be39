"""The stage graph: gating, failures, late prerequisites, restart in the middle, progress."""

import time

import pytest
from pyspark.sql import functions as F

from vireo.streaming.stages import ProgressTable, Stage, StageGraph

SCHEMA = "id long, path string, catalog_id long"


def graph(spark, root, log, known, broken=()):
    """log: (stage, key) of all work done; known: catalogue ids; broken: stages whose work raises."""

    def work(name, key, ok):
        def f(todo):
            if name in broken:
                raise RuntimeError(f"{name} is down")
            rows = todo.collect()
            log.extend((name, r[key]) for r in rows)
            return todo.select(F.col(key).alias("key"), ok.alias("ok"), F.lit(name).alias("result"))

        return f

    some = F.col("catalog_id").isin(sorted(known)) if known else F.lit(False)

    def catalogue(todo):
        return work("catalogue", "catalog_id", F.lit(True))(todo.filter(some))

    i = F.col("id")
    return StageGraph(spark, root, [
        Stage("catalogue", "catalog_id", catalogue, retry=True), Stage("media", "id", work("media", "id", i % 5 != 0)), Stage("scenes", "id", work("scenes", "id", F.lit(True))),
        Stage("colours", "id", work("colours", "id", i % 3 != 0), ("media",)), Stage("load", "id", work("load", "id", i % 7 != 0), ("catalogue", "media", "scenes", "colours")),
    ], SCHEMA)


def want(i, catalog_id, known):
    c = True if catalog_id in known else None
    media = i % 5 != 0
    colours = (i % 3 != 0) if media else None
    ready = c and media and colours
    return i, c, media, True, colours, (i % 7 != 0) if ready else None


def rows(n, start=0):
    return [(i, f"p{i}", None if i % 11 == 0 else i // 2) for i in range(start, start + n)]


def states(g):
    return sorted((r.id, r.catalogue, r.media, r.scenes, r.colours, r.load) for r in g.states().collect())


def test_from_files_to_loaded_with_a_restart(spark, tmp_path):
    log, root = [], str(tmp_path)
    files = spark.createDataFrame(rows(40), SCHEMA)
    broken = graph(spark, root, log, range(15), broken=("colours",))
    broken.add_files(files, 0)
    with pytest.raises(Exception, match="is down"):
        broken.run()
    assert {n for n, _ in log} == {"catalogue", "media", "scenes"}
    g = graph(spark, root, log, range(15))
    g.run()
    assert states(g) == sorted(want(i, c, range(15)) for i, _, c in rows(40))
    assert len(log) == len(set(log))  # nothing was done twice, nothing failed was tried again
    before = len(log)
    g.run()
    assert len(log) == before
    # new files, and catalogue entries that appear later: whatever comes last sets off the load
    more = graph(spark, root, log, range(40))
    more.add_files(spark.createDataFrame(rows(10, 40), SCHEMA), 1)
    more.run()
    assert len(log) == len(set(log))
    assert states(more) == sorted(want(i, c, range(40)) for i, _, c in rows(50))


def test_order_of_stages_and_no_files(spark, tmp_path):
    stage = Stage("a", "id", lambda t: t, ("b",))
    with pytest.raises(ValueError):
        StageGraph(spark, str(tmp_path / "x"), [stage], SCHEMA)
    g = graph(spark, str(tmp_path / "y"), [], [])
    g.run()
    assert states(g) == []


def test_progress_is_a_table(spark, tmp_path):
    listener = ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    try:
        g = graph(spark, str(tmp_path / "g"), [], range(15))
        g.add_files(spark.createDataFrame(rows(5), SCHEMA), 0)
        g.run()
        for _ in range(50):
            time.sleep(0.2)
            if (tmp_path / "progress").exists() and {f"stage_{n}" for n in g.stages} <= {r.name for r in spark.read.parquet(str(tmp_path / "progress")).collect()}:
                break
        found = spark.read.parquet(str(tmp_path / "progress")).collect()
        assert {r.name for r in found} == {f"stage_{n}" for n in g.stages} and all(r.seconds >= 0 for r in found)
        assert sum(r.rows for r in found if r.name == "stage_media") == 5
    finally:
        spark.streams.removeListener(listener)


def test_results_are_not_broadcast(spark, tmp_path):
    """However well results compress, they aren't gathered in the driver."""
    g = graph(spark, str(tmp_path), [], range(15))
    g.add_files(spark.createDataFrame(rows(20), SCHEMA), 0)
    for df in (g.states(), g.ready(g.files(), "load")):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    g.run()
    assert states(g) == sorted(want(i, c, range(15)) for i, _, c in rows(20))
