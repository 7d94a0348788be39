import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from vireo.api import Engine, RequestError, parse_query
from vireo.functions.tokens import ShortIds
from vireo.sources import remote, sinks, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine({"frames": views.frames(spark, SF), "files": views.files(spark, SF), "catalog": views.catalog(spark, SF), "logs": views.logs(spark, SF), "users": views.users(spark, SF), "tiers": views.tiers(spark)})


def test_search(engine):
    q = engine.t["frames"].first().vector
    whole = engine.search(q).collect()
    assert whole and whole[0].similarity <= 1
    assert sorted(map(str, engine.search([q, q]).filter("query_id = 1").drop("query_id").collect())) == sorted(map(str, engine.search(q).drop("query_id").collect()))
    assert engine.search([x + 0.5 for x in q]).count() > 0
    assert engine.search(q, catalog_id="12x").count() == len(whole)
    assert engine.search(q, catalog_id=1, with_catalog=True).count() == 0
    assert engine.search(image=(bytes(30 * 30 * 3), 30, 30)).count() > 0


@pytest.mark.parametrize("call, status", [
    (lambda e: e.search(), 405), (lambda e: e.search([[1] * 33] * 11), 400), (lambda e: e.search([1, 2]), 400), (lambda e: e.search("###"), 400),
    (lambda e: e.titles(" "), 400), (lambda e: e.stats("speed", "year", views.as_of()), 400), (lambda e: e.stats("x", "day", views.as_of()), 400),
    (lambda e: e.me(views.as_of(), api_key="none"), 403), (lambda e: e.new_user("x", 1), 400),
])
def test_errors(engine, call, status):
    with pytest.raises(RequestError) as e:
        call(engine)
    assert e.value.status == status


def test_other_requests(engine):
    assert engine.stats("traffic", "day", views.as_of()).count() > 0 and engine.stats("accuracy", "day", views.as_of()).count() > 0
    assert engine.status().count() == 1 and engine.status("2").count() >= 0
    assert engine.titles("ring").count() > 0
    assert engine.me(views.as_of(), ip="192.0.2.9").first().quota_used == 0
    user = engine.t["users"].first()
    assert engine.me(views.as_of(), api_key=user.api_key).first().id == user.id
    f = engine.t["files"].filter("scene_changes IS NOT NULL").first()
    assert engine.scene(f.path, 2.0) is not None and engine.scene("none", 1.0) is None
    assert engine.new_user("new@example.com", 1).first().id > user.id
    assert len(parse_query("IBgHEw0NExYYDw4QDw8NEhARDg0TIgwaERMRGhMIDAsJ")) == 33


def test_short_ids():
    s = ShortIds()
    assert s.encode([1, 2, 3]) == "86Rf07" and s.decode("86Rf07") == [1, 2, 3]
    other = ShortIds.salted("salt")
    for numbers in ([0], [5, 0, 123456789, 1 << 40], list(range(9))):
        assert other.decode(other.encode(numbers)) == numbers
    assert s.decode("") == [] and s.decode("!!") == [] and s.encode([]) == ""
    with pytest.raises(ValueError):
        s.encode([-1])


def test_snapshots(spark, tmp_path):
    t = sinks.Snapshots(spark, f"{tmp_path}/t")
    assert not t.exists()
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), "id")
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string"), "id")
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    t.truncate()
    assert t.read().count() == 0 and t.read().columns == ["id", "x"]
    sinks.append(spark.range(3).toDF("a"), f"{tmp_path}/log")
    sinks.append(spark.range(3).toDF("a"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 6


def test_remote_catalog(spark):
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            ids = [int(x) for x in self.path.split("=")[1].split(",")]
            calls.append(ids[0])
            if calls.count(ids[0]) == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps([{"id": i, "title": {"native": f"t{i}"}} for i in ids if i % 2]).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    remote.register(spark)
    df = spark.read.format("remote_catalog").option("url", f"http://127.0.0.1:{server.server_port}/p?ids={{ids}}").option("first", 1).option("last", 120).load()
    assert sorted(r.id for r in df.collect()) == list(range(1, 121, 2))
    server.shutdown()
