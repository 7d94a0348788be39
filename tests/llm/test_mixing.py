from collections import defaultdict

import pytest

from vireo.llm import mixing


def brute_targets(sizes: dict, cycle=(5, 2, 1), most=3) -> dict:
    """Water-filling by rounds: share by weight, clamp, reshare until none is above its clamp."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in clamped]
        left = total - sum(clamped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not above:
            return {**clamped, **share}
        clamped |= above


SCHEMA = "doc_id long, text string, source string, size int, target string"


@pytest.fixture
def docs(spark):
    rows = [(i, "w " * (i % 37 + 1), s, 1, "clash") for s, n in (("a", 300), ("b", 40), ("c", 5), (None, 60), ("é", 90)) for i in range(n)]
    rows += [(None, "x y", "a", 1, ""), (7, None, "a", 1, ""), (8, "", "b", 1, ""), (9, " \t\n", None, 1, ""), (1, "w w", "a", 1, ""), (1, "w w", "a", 1, ""), (5000, "v " * 20000, "a", 1, "")]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_taken_and_reruns(docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(rows, key=key) == sorted(again, key=key)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r, d in zip(sorted(rows, key=lambda r: (r.source_size, r.doc_id or -1)), rows):
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies
    words = {(r.doc_id, r.text, r.source): len((r.text or "").split()) for r in docs.collect()}
    per_source = defaultdict(int)
    for (_, _, s), _ in words.items():
        per_source[s] += 0
    for r in docs.collect():
        per_source[r.source] += len((r.text or "").split())
    want = brute_targets(dict(per_source))
    for r in rows:
        sizes[r.source_size] = r.source_size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for s, n in per_source.items():
        assert target[n] == pytest.approx(want[s])
        longest = max(len((r.text or "").split()) for r in docs.collect() if r.source == s)
        assert abs(taken[n] - target[n]) <= longest


def test_take_mix_keeps_columns(docs):
    out = mixing.take_mix(docs)
    assert out.columns == [*docs.columns, "copies"]
    assert out.filter("copies < 1").count() == 0


def test_salted_plan_is_the_same(docs, monkeypatch):
    want = sorted(map(str, mixing.mix_sources(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == want


def test_empty_table(spark):
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_empty_texts(spark):
    out = mixing.mix_sources(spark.createDataFrame([(1, None, "a", 1, ""), (2, "", None, 1, "")], SCHEMA)).collect()
    assert [(r.size, r.taken) for r in out] == [(0, 0), (0, 0)]


def test_a_cut_may_fall_between_equal_rows(spark):
    """Null ids and repeated rows: each source's words come within half a document of its target."""
    rows = [(None, "a b c", "a", 1, "")] * 41 + [(None, f"t{i % 3} x", "b", 1, "") for i in range(60)] + [(4, "z " * 7, "c", i, "") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = mixing.mix_sources(docs).collect()
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        longest[r.source_size] = max(longest[r.source_size], r.size)
    assert len(got) == len(rows) and len(target) == 3
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 for s in target)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(got, key=key) == sorted(mixing.mix_sources(docs.coalesce(1)).collect(), key=key)
    mixed = mixing.take_mix(docs)
    assert mixed.selectExpr("sum(copies * size(split(trim(text), ' ')))").first()[0] == sum(taken.values())
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.take_mix(docs.coalesce(2)).collect()))
