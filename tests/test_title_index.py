"""The written index finds what a scan of all titles finds, before and after updates."""

import random

import pytest

from vireo.operators import catalog
from vireo.operators.title_index import TitleIndex, _literal_runs


def titles(seed, ids):
    rnd = random.Random(seed)
    words = ["red", "widget", "Blue", "ÉTÉ", "ab", "x", "wid", "get", "100%", "a_b", "東京物語", "ring"]
    return [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in ids for _ in range(rnd.randint(1, 3))]


QUERIES = ["red widget", "wid", "x", "été", "東京物語", "100%", "r%t", "g_t blue"]


def rows(df):
    return sorted((r.id, r.title, round(r.similarity, 9), r.json) for r in df.collect())


def test_equals_a_scan_through_updates(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"j{i}") for i in range(200)], "id int, json string")
    schema = "id int, title string"
    now = dict.fromkeys(range(60))
    for i, t in titles(1, range(60)):
        now[i] = [*(now[i] or []), t]
    index = TitleIndex(spark, str(tmp_path / "index"), buckets=8)
    flat = lambda d: [(i, t) for i, ts in d.items() for t in ts or []]
    index.update(spark.createDataFrame([(i,) for i in now], "id int"), spark.createDataFrame(flat(now), schema))

    def check(queries):
        every = spark.createDataFrame(flat(now), schema).distinct()
        for q in queries:
            assert rows(index.search(docs, q, 1000)) == rows(catalog.title_search(every, docs, q, 1000)), q

    check(QUERIES)
    # some entries change, one loses all titles, some are new; the others aren't written again
    changed = {i: [] for i in range(50, 70)}
    for i, t in titles(2, range(51, 70)):
        changed[i].append(t)
    now.update(changed)
    before = {p.name for p in (tmp_path / "index").iterdir()}
    second = index.update(spark.createDataFrame([(i,) for i in changed], "id int"), spark.createDataFrame(flat(now), schema))
    assert {p.name for p in (tmp_path / "index").iterdir()} - before == {second}
    assert {r.id for r in spark.read.parquet(f"{tmp_path}/index/{second}/titles").collect()} == set(range(51, 70))
    check(QUERIES[:4])
    index.compact()
    assert len(index._segments()) == 1
    check(QUERIES[:2])


def test_only_buckets_of_the_query_are_read(spark, tmp_path):
    index = TitleIndex(spark, str(tmp_path / "index"), buckets=32)
    t = spark.createDataFrame(titles(3, range(300)), "id int, title string")
    index.update(t.select("id"), t)
    read = index._postings(0, ["rin"]).inputFiles()
    buckets = {f.split("bucket=")[1].split("/")[0] for f in read if "/postings/" in f}
    every = {p.name.split("=")[1] for p in tmp_path.glob("index/*/postings/bucket=*")}
    plan = index._postings(0, ["rin"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and len(every) > 16 and buckets


def test_stopped_update_is_not_seen(spark, tmp_path):
    index = TitleIndex(spark, str(tmp_path / "index"), buckets=4)
    t = spark.createDataFrame([(1, "red widget")], "id int, title string")
    index.update(t.select("id"), t)
    (tmp_path / "index" / "leftover" / "titles").mkdir(parents=True)
    assert [r.title for r in index.titles().collect()] == ["red widget"]
    with pytest.raises(ValueError):
        index.search(t, " ")


def test_literal_runs():
    assert _literal_runs("red widget") == ["red widget"] and _literal_runs("ab%cde_f") == ["cde"] and _literal_runs("a\\%bcd") == ["bcd"] and _literal_runs("%") == []


def test_a_text_of_many_entries_is_indexed_once(spark, tmp_path):
    index = TitleIndex(spark, str(tmp_path / "index"), buckets=4)
    few = spark.range(3000).selectExpr("cast(id AS int) AS id", "element_at(array('red widget', 'blue ring', 'Red wid'), cast(id % 3 AS int) + 1) AS title")
    segment = index.update(few.select("id"), few)
    postings = spark.read.parquet(f"{tmp_path}/index/{segment}/postings")
    assert postings.select("number").distinct().count() == 3 and postings.count() < 100
    docs = few.selectExpr("id", "cast(id AS string) AS json")
    assert rows(index.search(docs, "red widget", 5000)) == rows(catalog.title_search(few, docs, "red widget", 5000))
    assert rows(index.search(docs, "ri", 5000)) == rows(catalog.title_search(few, docs, "ri", 5000))
