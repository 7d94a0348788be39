"""Golden values, procedural restatements with random input, edges."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vireo.functions import network, text, tokens, vectors
from vireo.operators import accounts, analytics, catalog, dedupe, descriptor, frames, pipeline, scenes
from vireo.sources import readers, views

#: What descriptors of these images must be, and a vector in the form that callers send.
GOLDEN = {
    "ramp": [30, 15, 16, 16, 16, 16, 16, 15, 16, 15, 16, 16, 16, 16, 15, 15, 15, 16, 15, 16, 15, 32, 16, 16, 16, 16, 16, 32, 16, 16, 16, 16, 16],
    "black": [2] + [16] * 20 + [32] + [16] * 5 + [32] + [16] * 5,
    "white": [61] + [16] * 20 + [32] + [16] * 5 + [32] + [16] * 5,
}
SAMPLE = "IBgHEw0NExYYDw4QDw8NEhARDg0TIgwaERMRGhMIDAsJ"


def test_descriptor_golden():
    n = 320 * 180 * 3
    assert descriptor.colour_layout(bytes(i % 256 for i in range(n)), 320, 180) == GOLDEN["ramp"]
    assert descriptor.colour_layout(bytes(n), 320, 180) == GOLDEN["black"]
    assert descriptor.colour_layout(b"\xff" * n, 320, 180) == GOLDEN["white"]
    grey = descriptor.colour_layout(b"\x80" * n, 320, 180)
    assert grey == descriptor.colour_layout(b"\x80" * n, 320, 180) and len(grey) == 33


def test_descriptor_udf(spark):
    df = spark.createDataFrame([(bytearray(10 * 10 * 3), 10, 10), (bytearray(5), 10, 10), (None, 1, 1)], "data binary, width int, height int")
    got = [r[0] for r in df.select(descriptor.colour_layout_udf("data", "width", "height")).collect()]
    assert got == [GOLDEN["black"], None, None]


def test_parse_vector(spark):
    want = [32, 24, 7, 19, 13, 13, 19, 22, 24, 15, 14, 16, 15, 15, 13, 18, 16, 17, 14, 13, 19, 34, 12, 26, 17, 19, 17, 26, 19, 8, 12, 11, 9]
    df = spark.createDataFrame([(SAMPLE,), (SAMPLE[:-4],), ("???",), (None,)], "x string")
    assert [r[0] for r in df.select(vectors.parse_vector(F.col("x"))).collect()] == [want, None, None, None]


def islands(hits, gap=5.0):
    out = {}
    for t, s in sorted(hits):
        last = out.get(len(out) - 1)
        if last and t - last[1] < gap:
            last[1] = t
            if s < last[2]:
                last[2], last[3] = s, t
        else:
            out[len(out)] = [t, t, s, t]
    return sorted(map(tuple, out.values()))


def test_merge_matches(spark):
    rnd = random.Random(1)
    rows = [(1, i, i % 3, rnd.randint(0, 400) * 0.5 if i % 2 else rnd.randint(0, 40) * 5.0, rnd.randint(0, 9)) for i in range(200)]
    rows = list({(r[2], r[3]): r for r in rows}.values())
    got = frames.merge_matches(spark.createDataFrame(rows, "query_id int, frame_id int, file_id int, time double, score int")).collect()
    for f in range(3):
        mine = sorted((r.from_time, r.to_time, r.score, r.at_time) for r in got if r.file_id == f)
        assert mine == islands([(r[3], r[4]) for r in rows if r[2] == f])


def test_search_joins_files_behind_the_limit(spark):
    f = spark.createDataFrame([(i, i, i * 10.0, [i, 0]) for i in range(30)], "frame_id int, file_id int, time double, vector array<int>")
    q = spark.createDataFrame([(1, [0, 0])], "query_id int, qvec array<int>")
    files = spark.createDataFrame([(i, 1, f"1/{i}.mp4", 1.0, 1) for i in range(5, 30)], "id int, catalog_id int, path string, duration double, episode int")
    assert sorted(r.file_id for r in frames.frame_search(f, q, files).collect()) == [5, 6, 7, 8, 9]
    assert frames.frame_search_filtered(f, q, files, 99).count() == 0


def kept_frames(rows):
    kept = []
    for i, t, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if not any(t - a < 2 and b == v for _, a, b in kept[-50:]):
            kept.append((i, t, v))
    return [k[0] for k in kept]


def test_dedupe_frames(spark):
    rnd = random.Random(2)
    rows = [(i, i % 3, rnd.randint(0, 600) / 4 if i % 3 else rnd.randint(0, 100) / 50, [rnd.randint(0, 1 if i % 3 else 70)]) for i in range(900)]
    got = dedupe.dedupe_frames(spark.createDataFrame(rows, "frame_id long, file_id int, time double, vector array<int>")).collect()
    for f in range(3):
        assert sorted(r.frame_id for r in got if r.file_id == f) == sorted(kept_frames([(r[0], r[2], r[3]) for r in rows if r[1] == f]))


@pytest.mark.parametrize("seed", range(4))
def test_dedupe_batch_after_batch(seed):
    rnd = random.Random(seed)
    rows = sorted((rnd.randint(0, 400) / rnd.choice([1, 4, 50]), rnd.randint(0, rnd.choice([2, 70]))) for _ in range(700))
    keeper, got, at = dedupe.Keeper(), [], 0
    while at < len(rows):
        some = rows[at : at + rnd.choice([1, 3, 60, 300])]
        stays = keeper.admit(np.array([t for t, _ in some]), np.array([v for _, v in some]))
        got += [at + k for k in np.flatnonzero(stays).tolist()]
        at += len(some)
    assert got == kept_frames([(i, t, v) for i, (t, v) in enumerate(rows)])


def test_scene_window():
    w = scenes.scene_window
    assert w(-1, 10, [], 0.5, 5) is None and w(11, 10, [], 0.5, 5) is None and w(1, None, [], 0.5, 5) is None and w(0, 0, [], 0.5, 5) is None
    assert w(5, 100, None, 0.5, 5) == (4.5, 5.5, 100)
    assert w(3, 10, [(2.0, 0.5), (4.0, 0.9)], 0.5, 5) == (2.0, 4.0, 10)
    assert w(50, 100, [], 0.5, 5) == (45, 55, 100)
    assert w(10, 10, [(2.0, 0.5)], 0.5, 5) == (9.5, 10, 10)
    # the stronger of two near boundaries stays, also against an end of the file
    assert w(3, 10, [(2.0, 0.5), (2.4, 0.9)], 0.5, 5) == (2.4, 8, 10)
    assert scenes.strong_boundaries([(0.0, 1.0), (0.2, 1.0), (9.0, 0.3), (9.3, 0.2), (9.4, 1.0)], 0.5) == [0.0, 9.4]


def test_scene_windows_and_log(spark):
    df = spark.createDataFrame([(3.0, 10.0, [(2.0, 0.5), (4.0, 0.9)]), (3.0, None, None), (-1.0, 10.0, None)], "t double, duration double, changes array<struct<t:double,score:double>>")
    got = [(r.scene.start_time, r.scene.end_time) if r.scene else None for r in scenes.scene_windows(df).collect()]
    assert got[0] == (2.0, 4.0) and all(g is None or g == (None, None) or g[0] != g[0] for g in got[1:])
    log = spark.createDataFrame([("pts_time:1.5 x\nlavfi.scene_score=0.4\npts_time:2 \nlavfi.scene_score=0.25",)], "x string")
    assert [tuple(x) for x in log.select(scenes.parse_scene_log(F.col("x"))).first()[0]] == [(1.5, 0.4), (2.0, 0.25)]


def test_networks(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("2001:db8::1",), ("::1",), ("fe80:0:0:1:2:3:4:5",), ("2001:0DB8:0000:1::",)], "ip string")
    assert [r[0] for r in df.select(network.client_network(F.col("ip"))).collect()] == ["10.0.0.1/32", "2001:db8:0:0::/64", "0:0:0:0::/64", "fe80:0:0:1::/64", "2001:db8:0:1::/64"]
    assert [r[0] for r in df.select(network.concurrency_key(F.col("ip"))).collect()] == ["10.0.0.1", "2001:db8::1", "::1", "fe80:0:0:1", "2001:0DB8:0000:1"]


def test_trigram_similarity(spark):
    df = spark.createDataFrame([("word", "two words"), ("", "a"), ("abc", "ABC"), ("...", "")], "a string, b string")
    got = [r[0] for r in df.select(text.trigram_similarity(text.trigrams(F.col("a")), text.trigrams(F.col("b")))).collect()]
    assert got == pytest.approx([4 / 11, 0, 1, 0])


def test_episode_numbers(spark):
    names = {"Name - 01.mp4": 1, "[x] Name [02].mkv": 2, "Name S01E13.webm": 13, "Name EP07 end.mp4": 7, "Name 5.mp4": 5, "Name.mp4": None, "Name - 00.mp4": None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(text.episode_number(F.col("n"))).collect()] == list(names.values())


def test_safe_urls(spark):
    urls = {"http://a.org/": True, "https://u@8.8.8.8:80/x": True, "ftp://a.org": False, "http://127.0.0.1/": False, "http://[::1]/": False, "http://172.31.0.1": False, "http://172.32.0.1": True, "http://": False, "file:///x": False}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(text.is_safe_url(F.col("u"))).collect()] == list(urls.values())


def test_written_forms_of_private_addresses(spark):
    unsafe = ["[::ffff:10.0.0.1]", "[::ffff:8.8.8.8]", "[fe80::1]", "[ff02::1]", "[::]", "2130706433", "0x7f.1", "0177.0.0.1", "127.1", "100.64.0.1", "198.18.0.9", "224.0.0.1", "10.0.0.1", "0.0.0.0"]
    safe = ["100.128.0.1", "198.20.0.1", "1.2.3.4", "a1.example.org", "1e100.net", "[2001:4860::8888]", "172.15.0.1"]
    df = spark.createDataFrame([(f"http://{h}/x",) for h in unsafe + safe], "u string")
    assert [r[0] for r in df.select(text.is_safe_url(F.col("u"))).collect()] == [False] * len(unsafe) + [True] * len(safe)


def test_crawl_end_against_a_loop(spark):
    import random

    def loop(ids, known):
        current, last = (known, known) if known is not None else (1, 0)
        while True:
            block = range(current, current + 50)
            last = max([last, *(i for i in block if i in ids)])
            if block[-1] - last >= 200:
                return block[-1]
            current += 50

    for seed in range(6):
        rnd = random.Random(seed)
        known = rnd.randint(1, 300)
        ids, at = set(), rnd.randint(1, 200)
        for _ in range(25):
            at += rnd.choice([1, 3, 40, 150, 199, 201, 230, 249, 251])
            ids.add(at)
        found = spark.createDataFrame([(i,) for i in sorted(ids)], "id int")
        assert catalog.crawl_end(found, known).first()[0] == loop(ids, known)
    assert catalog.crawl_end(found.limit(0), 1).first()[0] == loop(set(), 1) == 250
    assert catalog.crawl_end(found.limit(0), None).first()[0] == loop(set(), None) == 200
    some = spark.createDataFrame([(1,), (50,), (130,), (700,)], "id int")
    assert catalog.crawl_end(some, None).first()[0] == loop({1, 50, 130, 700}, None)


def test_refresh_blocks_go_down_from_the_last_but_one(spark):
    ids = [3, 5, None, *range(10, 140), 139, 200]
    got = {r.id: r.block for r in catalog.refresh_blocks(spark.createDataFrame([(i,) for i in ids], "id int").repartition(3)).collect()}
    assert got == {i: k // 50 for k, i in enumerate(sorted({i for i in ids if i and i < 200}, reverse=True))}
    assert catalog.refresh_blocks(spark.createDataFrame([], "id int")).count() == 0


def test_accounts_of_several_requests(spark):
    users = spark.createDataFrame([(1, "a@b.c", "k1"), (2, "d@b.c", "k2")], "id int, email string, api_key string")
    tiers = spark.createDataFrame([(1,)], "id int")
    asked = spark.createDataFrame([(1, "new@b.c", 1), (2, "new@b.c", 1), (3, None, 1), (4, "x", 1), (5, "e@b.c", None), (6, "e@b.c", 7), (7, "a@b.c", 1)], "request_id int, email string, tier int")
    got = {r.request_id: (r.code, r.error) for r in accounts.new_accounts(users, tiers, asked).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 200, 2: 409, 3: 400, 4: 400, 5: 400, 6: 400, 7: 409}
    assert got[5][1] == "Error: tier cannot be empty" and got[6][1] == "Error: invalid tier number"
    resets = spark.createDataFrame([(1, "k1", "12345678"), (2, "k1", "short"), (3, None, "12345678"), (4, "k9", None)], "request_id int, api_key string, password string")
    assert {r.request_id: r.code for r in accounts.password_resets(users, resets).collect()} == {1: 200, 2: 400, 3: 403, 4: 403}
    logins = spark.createDataFrame([(1, "a@b.c", "p"), (2, "a@b.c", None), (3, None, "p")], "request_id int, email string, password string")
    assert {r.request_id: (r.code, r.api_key) for r in accounts.login(users.withColumn("password", F.lit("p")), logins).collect()} == {1: (200, "k1"), 2: (403, None), 3: (403, None)}


def test_nearest_frames_in_blocks_and_parts(spark, monkeypatch):
    rows = [(i, i % 3, float(i), [(i * 7) % 11, (i * 5) % 13]) for i in range(200)]
    every = spark.createDataFrame(rows, "frame_id long, file_id int, time double, vector array<int>")
    wanted = every.filter("frame_id % 20 = 0").select(F.col("frame_id").alias("query_id"), F.col("vector").alias("qvec"))
    monkeypatch.setattr(frames, "BLOCK", 4)
    got = sorted((r.query_id, r.score, r.frame_id) for r in frames.nearest_frames(every, wanted, 15).collect())
    want = []
    for q in range(0, 200, 20):
        near = sorted((sum((a - b) ** 2 for a, b in zip(r[3], rows[q][3])), r[0]) for r in rows)[:15]
        want += [(q, s, f) for s, f in near]
    assert got == sorted(want)


def test_templates(spark):
    got = spark.range(1).select(text.fill_template(F.lit("Hi {{name}}!"), name=F.lit("<a & 'b'>"))).first()[0]
    assert got == "Hi &lt;a &amp; &#39;b&#39;&gt;!"


def test_missing_catalog_ids_nulls(spark):
    files = spark.createDataFrame([(1,), (2,), (None,)], "catalog_id int")
    known = spark.createDataFrame([(1,)], "id int")
    assert pipeline.missing_catalog_ids(files, spark.createDataFrame([(1,), (None,)], "id int")).count() == 0
    assert [r[0] for r in pipeline.missing_catalog_ids(files, known).collect()] == [2]
    assert len(pipeline.missing_catalog_ids(files, known.limit(0)).collect()) == 3


def test_percentiles_of_nulls_and_unknown_period(spark):
    logs = spark.createDataFrame([("2024-01-30 10:00:00", None), ("2024-01-30 11:00:00", 3), ("2024-01-30 11:30:00", 5)], "created string, search_time int").withColumn("created", F.col("created").cast("timestamp_ntz"))
    rows = sorted(analytics.percentiles(logs, "hour", "search_time", views.as_of()).collect())
    assert [r.p50 for r in rows] == [None, 3] and rows[1].p100 == 5
    with pytest.raises(ValueError):
        analytics.traffic(logs, "year", views.as_of())


def test_admission_table(spark):
    """Full queue of 8: a request passes only if those of its priority and above are few enough."""
    queue = spark.createDataFrame([(0, 5), (2, 2), (5, 1)], "priority int, queued int")
    assert {r.priority: r.waiting for r in accounts.queue_depth(queue).collect()} == {0: 8, 2: 3, 5: 1}
    row = lambda *a: spark.range(1).select(accounts.admission(*[F.lit(x) for x in a])).first()[0]
    assert row(100, 100, 1, 1, 1, 8) == 402 and row(99, 100, 1, 1, 8, 8) == 200
    assert row(0, 100, 2, 1, 1, 8) == 402 and row(0, 100, 1, 1, 9, 8) == 503
    assert spark.range(1).select(accounts.quota_message(F.lit(100), F.lit(100))).first()[0] == "Search quota depleted (quota per 24 hours: 100, used: 100)"


def test_webhook_ties(spark):
    j = '{"included":[{"type":"tier","id":"x","attributes":{"amount_cents":5}},{"type":"tier","id":"y","attributes":{"amount_cents":5}}]}'
    df = spark.createDataFrame([(j,), ('{"included":[]}',), ("{}",)], "j string")
    assert [r[0] for r in df.select(accounts.webhook_top_tier(F.col("j"))).collect()] == ["x", None, None]


def test_titles_with_missing_lists(spark):
    c = spark.createDataFrame([(1, '{"title":{"native":"a","romaji":"a","english":""},"synonyms":null}'), (2, "{}")], "id int, json string")
    assert [tuple(r) for r in catalog.catalog_titles(c).collect()] == [(1, "a")]
    with pytest.raises(ValueError):
        catalog.title_search(catalog.catalog_titles(c), c, "  ")


def test_tokens(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("m",), (None,)], "m string")
    for kind, key in (("sha1", b"k"), ("sha512", b"key" * 60), ("sha256", b"key" * 60)):
        assert df.select(tokens.hmac_hex(key, kind)("m")).first()[0] == hmac.new(key, b"m", kind).hexdigest()
    assert [r[0] for r in df.select(tokens.hmac_hex(b"k")("m")).collect()] == [hmac.new(b"k", b"m", "sha256").hexdigest(), None]
    assert len(df.select(tokens.scrypt_base64(b"s")("m")).first()[0]) == 88
    assert tokens.api_key(1, bytes(32)).startswith("AQAA")
    assert [r[0] for r in spark.createDataFrame([(1, 2, 0, 0), (1, 1, 301, 0), (1, 1, 300, 0)], "a int, b int, n int, e int").select(tokens.token_status(F.col("a"), F.col("b"), F.col("n"), F.col("e"))).collect()] == [403, 410, 200]


def test_readers(spark, tmp_path):
    frames_in = [{"time": 0.5, "vector": [1, 2]}, {"time": 1.0, "vector": [3, 4]}]
    df = spark.createDataFrame([(7, bytearray(readers.pack_frames(frames_in))), (8, None)], "id int, color_layout binary")
    assert [(r.file_id, r.time, r.vector) for r in readers.frames_from_blobs(df).collect()] == [(7, 0.5, [1, 2]), (7, 1.0, [3, 4])]
    (tmp_path / "12").mkdir()
    for n in ("a.mp4", "b.txt"):
        (tmp_path / "12" / n).write_text("x")
    assert [tuple(r) for r in readers.media_listing(spark, f"file://{tmp_path}").collect()] == [("12/a.mp4", 1)]
    assert readers.media_info(spark.createDataFrame([("/nowhere",)], "path string")).first().media_info == "{}"


def test_new_ids(spark):
    old = spark.createDataFrame([(5,), (9,)], "id long")
    new = spark.range(20).select(F.col("id").cast("string").alias("name")).repartition(3)
    assert sorted(r.id for r in accounts.with_new_ids(old, new).collect()) == list(range(10, 30))


def test_inverted_file_recall(spark, tmp_path):
    import numpy as np

    from vireo.operators import ann

    rng = np.random.default_rng(1)
    centres = rng.integers(0, 64, size=(20, 8))
    rows = [(i, i % 9, i * 1.0, [int(x) for x in np.clip(centres[i % 20] + rng.integers(-3, 4, size=8), 0, 63)]) for i in range(4000)]
    every = spark.createDataFrame(rows, "frame_id long, file_id int, time double, vector array<int>")
    q = every.filter("frame_id IN (3, 500, 1234)").select(F.col("frame_id").alias("query_id"), F.col("vector").alias("qvec"))
    path = f"{tmp_path}/ivf"
    odd = spark.createDataFrame([(9001, 1, 1.0, None), (9002, 1, 1.0, [1, 2])], every.schema)
    ann.write_index(every.unionByName(odd), path, 20)
    exact = frames.nearest_frames(every, q, 50)
    found = ann.search(spark, path, q, probes=6, candidates=50)
    assert ann.recall(found, exact) >= 0.95
    score = {(r.query_id, r.frame_id): r.score for r in exact.collect()}
    assert all(score.get((r.query_id, r.frame_id), r.score) == r.score for r in found.collect())
    assert ann.recall(ann.search(spark, path, q, probes=20, candidates=50), exact) == 1
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.count() == 4000 and max(r.n for r in lists.select(F.size("code").alias("n")).distinct().collect()) == 8
    plan = ann.search(spark, path, q, probes=2, candidates=5)._jdf.queryExecution().toString()
    assert "Union" not in plan and "dynamicpruning" in plan.lower()


def test_inverted_file_without_frames(spark, tmp_path):
    from vireo.operators import ann

    none = spark.createDataFrame([], "frame_id long, file_id int, time double, vector array<int>")
    ann.write_index(none, f"{tmp_path}/none", 4)
    q = spark.createDataFrame([(1, [1, 2])], "query_id long, qvec array<int>")
    assert ann.search(spark, f"{tmp_path}/none", q).count() == 0


def test_distances_of_one_length_are_flat(spark):
    every = spark.createDataFrame([(1, 1, 0.0, [1, 2, 3]), (2, 1, 0.0, [3, 2, 1]), (3, 1, 0.0, [9, 9])], "frame_id long, file_id int, time double, vector array<int>")
    q = spark.createDataFrame([(7, [1.5, 2.0, 2.0])], "query_id int, qvec array<double>")
    got = {r.frame_id: r.score for r in frames.nearest_frames(every, q, 5).collect()}
    assert got == {1: 1.25, 2: 3.25}  # a vector of another length is no match
    whole = frames.nearest_frames(every, q.select("query_id", F.expr("array(1, 2, 2) AS qvec")), 2).collect()
    assert {r.frame_id: r.score for r in whole}[1] == 1


def test_nearest_frames_by_cells(spark, monkeypatch):
    """Several blocks and groups, ties by id, repeated queries and odd vectors: the same as one comparison of all pairs."""
    from vireo.operators import nearest

    rows = [(i, i % 3, float(i), [(i * 7) % 11, (i * 5) % 13]) for i in range(300)] + [(900, 1, 0.0, None), (901, 1, 0.0, [1]), (902, 1, 0.0, [1, None])]
    every = spark.createDataFrame(rows, "frame_id long, file_id int, time double, vector array<int>")
    asked = [(q, rows[q][3]) for q in range(0, 300, 20)] + [(20, [0, 0]), (None, [3, 3]), (77, [5]), (78, None)]
    monkeypatch.setattr(frames, "BLOCK", 4)
    monkeypatch.setattr(nearest, "NUMBERS", 128)
    want = {}
    for q, v in asked:
        for i, _, _, x in rows:
            if v and x and len(v) == len(x) and None not in x:
                want.setdefault(q, []).append((sum((a - b) ** 2 for a, b in zip(x, v)), i))
    want = sorted(((str(q), s, i) for q, near in want.items() for s, i in sorted(near)[:15]))
    for kind in ("int", "double"):
        e = every.withColumn("vector", F.col("vector").cast(f"array<{kind}>"))
        w = spark.createDataFrame(asked, "query_id long, qvec array<int>").withColumn("qvec", F.col("qvec").cast(f"array<{kind}>"))
        found = frames.nearest_frames(e, w, 15)
        assert found.schema["score"].dataType.simpleString() == kind
        assert sorted((str(r.query_id), r.score, r.frame_id) for r in found.collect()) == want


def test_cells_are_bounded():
    from vireo.operators.nearest import BLOCK, NUMBERS, shape_of

    for q, n in ((1, 1), (10, 10**9), (30_000, 600_000), (10**6, 10**7), (0, 0)):
        blocks, groups = shape_of(q, n, 33)
        assert q / blocks <= BLOCK and 33 * n / groups <= NUMBERS + 33


def test_a_query_keeps_a_bounded_number_of_each_stretch():
    import numpy as np

    from vireo.operators.nearest import nearest_of_cell

    rng = np.random.default_rng(3)
    x, q = rng.integers(0, 4, (20_000, 5)), rng.integers(0, 4, (3, 5))
    for whole, kind in ((True, np.int32), (False, np.float64)):
        near = nearest_of_cell(x.astype(kind), q.astype(kind), 50, whole)
        for i in range(3):
            d = ((x - q[i]) ** 2).sum(1)
            want = np.lexsort((np.arange(len(x)), d))[:50]
            score, at = near.of(i)
            assert at.tolist() == want.tolist() and score.tolist() == d[want].tolist()


def test_frames_travel_in_packs(spark, monkeypatch):
    """A block of queries gets packs of frames in the order of their ids, not a row for each frame; the nearest are the same."""
    from vireo.operators import nearest

    rows = [(f"f{(i * 37) % 500:03d}", i % 3, float(i), [(i * 7) % 11, (i * 5) % 13]) for i in range(500)] + [("none", 1, 0.0, None)]
    every = spark.createDataFrame(rows, "frame_id string, file_id int, time double, vector array<int>")
    asked = [(q, rows[q][3]) for q in range(0, 500, 5)]
    queries = spark.createDataFrame(asked, "query_id long, qvec array<int>")
    monkeypatch.setattr(nearest, "PACK", 100)
    packs = every.coalesce(1).mapInArrow(nearest.packer("vector"), "number long, pack binary").orderBy("number").collect()
    assert [nearest.unpacked(nearest.pa.scalar(p.pack, nearest.pa.binary())).num_rows for p in packs] == [50] * 10 + [1]
    monkeypatch.setattr(frames, "BLOCK", 10)
    found = frames.nearest_frames(every, queries, 15)
    assert "CoGroups" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(q, s, f) for q, v in asked for s, f in sorted((sum((a - b) ** 2 for a, b in zip(r[3], v)), r[0]) for r in rows[:-1])[:15]]
    assert sorted((r.query_id, r.score, r.frame_id) for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("kind", [np.int32, np.float64])
def test_a_stream_holds_what_is_nearest(monkeypatch, kind):
    import pyarrow as pa

    from vireo.operators import nearest

    monkeypatch.setattr(nearest, "HELD", 100)
    rng = np.random.default_rng(8)
    x, q = rng.integers(0, 6, (5000, 4)), rng.integers(0, 6, (7, 4))
    x[3000:] *= 2000  # no longer exact as single precision
    stream, most = nearest.Stream(q.astype(kind), 20, kind == np.int32), 0
    for at in range(0, 5000, 64):
        stream.add(x[at : at + 64].astype(kind), pa.table({"id": np.arange(at, min(5000, at + 64))}))
        most = max(most, sum(map(len, stream.parts)))
    of, score, rows = stream.nearest()
    assert most < 7 * 20 + 2 * max(100, 7 * 20) and rows["id"].to_numpy().max() < 5000
    for i in range(7):
        d = ((x - q[i]) ** 2).sum(1)
        want = np.lexsort((np.arange(5000), d))[:20]
        assert rows["id"].to_numpy()[of == i].tolist() == want.tolist() and score[of == i].tolist() == d[want].tolist()


def test_files_and_documents_are_not_broadcast(spark, tmp_path):
    """However well they compress; results without an entry stay."""
    f = spark.createDataFrame([(i, i, i * 10.0, [i, 0]) for i in range(6)], "frame_id int, file_id int, time double, vector array<int>")
    q = spark.createDataFrame([(1, [0, 0])], "query_id int, qvec array<int>")
    files = spark.createDataFrame([(i, i % 2, f"1/{i}.mp4", 1.0, 1) for i in range(6)], "id int, catalog_id int, path string, duration double, episode int")
    for name, df in (("files", files), ("catalog", spark.createDataFrame([(1, "{}"), (7, "{}")], "id int, json string"))):
        df.write.parquet(f"{tmp_path}/{name}")
    files, catalog = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("files", "catalog"))
    found = frames.with_catalog(frames.frame_search(f, q, files), catalog)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.rank, r.file_id, r.catalog_json) for r in found.collect()) == [(i + 1, i, "{}" if i % 2 else None) for i in range(6)]


def test_upsert_of_ids_that_meet(spark, tmp_path):
    """The query and its SQL agree where an id that is sent under a new number is an old entry's."""
    import duckdb

    from vireo.plans import oracle, queries

    part = spark.createDataFrame([(i, f"n{i}", "b", "t", i % 9) for i in (4, 5, 8, 16, 1_000_008, 1_000_012, 1_000_020)] + [(None, "n", "b", "t", 3)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = queries.QUERIES["catalog_upsert"](spark, str(tmp_path)).select("id", F.col("updated").cast("string").alias("updated"), "json").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(f"SELECT id, strftime(updated, '%Y-%m-%d %H:%M:%S'), json FROM ({oracle.SQL['catalog_upsert']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert [r.json for r in got if r.id == 1_000_008] == ["{}"]


def test_scene_windows_hold_one_row_as_objects(spark):
    """Null lists, empty ones and null requests; lists reach Python as arrays, not as an object for each boundary."""
    rows = [(0, 3.0, 10.0, [(2.0, 0.5), (6.0, 0.9)]), (1, 3.0, 10.0, None), (2, 3.0, 10.0, []), (3, 3.0, None, [(2.0, 0.5)]), (4, 30.0, 10.0, [(2.0, 0.5)]), (5, 7.0, 10.0, [(2.0, 0.5), (6.0, 0.9)])]
    df = spark.createDataFrame(rows, "id int, t double, duration double, changes array<struct<t: double, score: double>>").coalesce(1)
    made = scenes.scene_windows(df)
    got = {r.id: r.scene and tuple(r.scene) for r in made.collect()}
    want = {i: scenes.scene_window(t, d, c, 0.5, 5.0) for i, t, d, c in rows}
    assert {k: v if v and v[0] is not None else None for k, v in got.items()} == want
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
