"""Refreshes of derived tables equal whole recomputations and leave other buckets' files alone; frames by file need no dealing."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from vireo.operators import dedupe, frames, pipeline
from vireo.sources import derived


def derive(base):
    return base.select("id", F.explode(F.split("text", " ")).alias("word")).filter("word <> ''").distinct()


def test_refresh_equals_recomputation(spark, tmp_path):
    schema = "id int, text string"
    base = {i: f"a{i} b c{i % 3}" for i in range(200)}
    table = derived.DerivedTable(spark, str(tmp_path / "t"), derive, buckets=16)

    def frame(ids=None):
        return spark.createDataFrame([(i, t) for i, t in base.items() if ids is None or i in ids], schema)

    def listing():
        return {b: sorted(f.name for f in Path(p).glob("part-*")) for b, p in table.files().items()}

    def check():
        assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, derive(frame()).collect()))

    table.note(frame())
    assert table.refresh(frame()) == set(range(16))
    check()
    assert table.refresh(frame()) == set()
    rnd = random.Random(1)
    for _ in range(2):
        before, changed = listing(), rnd.sample(sorted(base), 3)
        base[changed[0]], base[changed[1]] = "new words here", ""
        gone = changed[2]
        del base[gone]
        base[1000 + gone] = "z"
        # two changes are noted, one refresh takes both
        table.note(spark.createDataFrame([(i,) for i in changed], "id int"))
        table.note(spark.createDataFrame([(1000 + gone,)], "id int"))
        touched = table.refresh(frame())
        check()
        after = listing()
        assert 0 < len(touched) <= 4 and all(after.get(b) == f for b, f in before.items() if b not in touched)
        assert all(after.get(b) != before.get(b) for b in touched)
    # everything goes
    table.note(frame())
    base.clear()
    table.refresh(frame())
    assert table.files() == {} and table.read("id int, word string").count() == 0


def exchanges(df, name):
    """Exchanges above a scan of the table."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    executed = df._jdf.queryExecution().executedPlan().toString()
    assert name in plan
    lines = executed.split("== Initial Plan ==")[-1].split("\n")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    depth, above = lines[at].index("FileScan"), []
    for x in reversed(lines[:at]):
        start = len(x) - len(x.lstrip(" :+-*(0123456789)"))
        if start < depth:
            depth = start
            above.append(x)
    return [x for x in above if "Exchange" in x]


def test_frames_by_file_are_not_dealt_out(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rnd = random.Random(4)
        rows = [(i, i % 7, rnd.randint(0, 99) / 4, [rnd.randint(0, 1)]) for i in range(600)]
        plain = spark.createDataFrame(rows, "frame_id long, file_id int, time double, vector array<int>")
        name = f"frames_by_file_{rnd.getrandbits(40)}"
        table = derived.write_frames_by_file(plain.filter("file_id < 4"), name, 4)
        table = derived.write_frames_by_file(plain.filter("file_id >= 4"), name, 4)
        assert table.count() == 600
        gone = spark.createDataFrame([(2,), (5,)], "id int")
        cleaned = pipeline.without(table, gone, "file_id")
        assert exchanges(cleaned, name) == [] and sorted(map(str, cleaned.collect())) == sorted(map(str, pipeline.without(plain, gone, "file_id").collect()))
        kept = dedupe.dedupe_frames(table)
        assert exchanges(kept, name) == []
        assert sorted(r.frame_id for r in kept.collect()) == sorted(r.frame_id for r in dedupe.dedupe_frames(plain).collect())
        files = spark.createDataFrame([(i, i % 2, f"{i}/x.mp4", 9.0, 1) for i in range(7)], "id int, catalog_id int, path string, duration double, episode int")
        some = table.join(files.filter("catalog_id = 1").select(F.col("id").alias("file_id")), "file_id", "left_semi")
        assert exchanges(some, name) == []
        q = spark.createDataFrame([(1, [0])], "query_id int, qvec array<int>")
        assert frames.frame_search_filtered(table, q, files, 1).count() == frames.frame_search_filtered(plain, q, files, 1).count() > 0
        spark.sql(f"DROP TABLE {name}")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
