"""A request's source by order of precedence; tables as SQL knows them; pages that couldn't be had."""

from vireo.operators.uploads import request_sources
from vireo.sources import remote, sinks


def test_precedence(spark):
    big = bytes(26_214_401)
    rows = [
        (1, "x", "http://a.example.org/", [b"f"], b"b"), (2, "", "http://a.example.org/", [b"f"], b"b"), (3, None, "", [b"f", b"g"], b"b"), (4, None, None, [], b"b"),
        (5, None, None, None, b""), (6, None, None, None, None), (7, None, None, [b""], b"b"), (8, None, None, [None, b"g"], b"b"), (9, None, "http://10.0.0.1/", [b"f"], b"b"),
        (10, None, "no address", None, b"b"), (11, None, None, [big], b"b"), (12, None, None, None, big[:-1]),
    ]
    df = spark.createDataFrame(rows, "id int, vector string, url string, files array<binary>, body binary")
    got = {r["id"]: (r["source"], r["status"], None if r["content"] is None else bytes(r["content"])) for r in request_sources(df).collect()}
    assert got == {
        1: ("vector", 200, None), 2: ("url", 200, None), 3: ("file", 200, b"f"), 4: ("body", 200, b"b"), 5: (None, 405, None), 6: (None, 405, None), 7: ("file", 400, None),
        8: ("file", 400, None), 9: ("url", 400, None), 10: ("url", 400, None), 11: ("file", 413, None), 12: ("body", 200, big[:-1]),
    }
    assert request_sources(df.limit(0)).count() == 0


def test_described(spark):
    sinks.register({"seen_by_sql": spark.createDataFrame([(1, "a")], "id int, name string")})
    spark.range(3).write.mode("overwrite").saveAsTable("kept_by_sql")
    try:
        got = {tuple(r) for r in sinks.described(spark).collect()}
        assert {("seen_by_sql", True, "id", "int"), ("seen_by_sql", True, "name", "string"), ("kept_by_sql", False, "id", "bigint")} <= got
    finally:
        spark.catalog.dropTempView("seen_by_sql")
        spark.sql("DROP TABLE kept_by_sql")


def test_failed_pages(spark, monkeypatch):
    def read(**options):
        reader = remote.CatalogReader({"url": "http://127.0.0.1:9/{ids}", "pause": "0", "first": "1", "last": "60", **options})
        return [row for page in reader.partitions() for row in reader.read(page)]

    monkeypatch.setattr(remote, "fetch", lambda url, pause: [{"id": 1}] if "/1," in url else None)
    assert read() == [(1, '{"id": 1}')]
    assert read(failures="true") == [(1, '{"id": 1}'), *((i, None) for i in range(51, 61))]
