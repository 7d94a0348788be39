"""The pipeline's stages against plain Python on a small table, and each stage's own decisions."""

import random

import pytest

import corpus_pipeline as P

from .test_mixing import brute_targets
from .test_ngram_join import brute as brute_groups
from .test_suffix_dedup import brute as brute_repeats

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    passage, item = text(90), text(25)
    texts = [text(rnd.randint(20, 120)) for _ in range(60)]
    texts += [texts[0], texts[0], texts[1] + " more", passage + " " + text(80), text(70) + " " + passage, text(40) + " " + item, None, "", "123 456", "ü" * 300 + passage, "ЖЩ!! " * 80]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (6, text(50), "en", "s1", 1), (None, texts[7], "en", None, 2), (None, text(30), None, None, 2)]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns

    one = P.identify_language(spark, docs, sf_dir)
    assert one.columns == columns
    junk = "ЖЩ!! " * 80  # like no language: nor are its own letters enough to make it one
    assert sorted(r.text for r in one.collect()) == sorted(r.text for r in docs.collect() if r.text and any(c.isalpha() for c in r.text) and r.text != junk)
    assert {r.lang for r in one.collect()} == {"en"}  # a missing language is filled in

    before = [(r.doc_id, r.text) for r in one.collect()]
    two = P.one_of_each_group(spark, one, sf_dir)
    assert two.columns == columns
    after = two.collect()
    groups = brute_groups([(i, t) for i, (_, t) in enumerate(before)])
    assert len(after) == len({g[2] for g in groups})
    smallest = {}
    for i, _, g in groups:
        d = before[i][0]
        smallest[g] = min(smallest.get(g, float("inf")), float("inf") if d is None else d)
    assert sorted(float("inf") if r.doc_id is None else r.doc_id for r in after) == sorted(smallest.values())

    three = P.remove_repeats(spark, two, sf_dir)
    assert three.columns == columns
    want = brute_repeats([r.text for r in after], 400)
    got = {(r.doc_id, r.source, r.text[-20:]): r for r in three.collect()}
    assert len(got) == sum(w[0] > w[1] for w in want)
    by_id = {}
    for r in three.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    for r, w in zip(after, want):
        if w[1] == 0:
            assert r in by_id[r.doc_id]
        elif w[0] == w[1]:  # nothing is left
            assert r.doc_id not in by_id
        else:
            assert any(len(x.text.encode()) == w[0] - w[1] and x.n_chars == len(x.text) for x in by_id[r.doc_id])

    four = P.drop_contaminated(spark, three, sf_dir)
    assert four.columns == columns
    gone = {r.doc_id for r in three.collect()} - {r.doc_id for r in four.collect()}
    assert gone == {65}

    five = P.mix(spark, four, sf_dir)
    assert five.columns == [*columns, "copies"]
    words = lambda r: len(r.text.split())
    size, taken = {}, {}
    for r in four.collect():
        size[r.source] = size.get(r.source, 0) + words(r)
    for r in five.collect():
        taken[r.source] = taken.get(r.source, 0) + words(r) * r.copies
    target = brute_targets(size)
    longest = max(words(r) for r in four.collect())
    assert all(abs(taken.get(s, 0) - target[s]) <= longest / 2 for s in size)
    assert {tuple(r)[:-1] for r in five.collect()} <= {tuple(r) for r in four.collect()}


def test_run_is_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, P.run(spark, sf_dir).collect())) == sorted(map(key, docs.collect()))


def test_documents_that_share_nothing_and_no_language(spark, sf_dir):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20)), None, "a", 1) for i in range(50)] + [(99, "12 34", None, "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in docs.collect()) == list(range(50))


def test_empty_documents(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_repeated_rows_with_odd_columns(spark):
    """Columns named like the stage's own, with dots, and maps pass untouched; of rows of one id and text one stays."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text, 77, "a", {"k": 1}, 5), (1, text, 77, "a", {"k": 1}, 5), (1, text, 78, "a", {"k": 2}, 5), (2, text + " x", 1, "b", None, 6), (3, "other words " * 9, 2, "c", {}, 7), (None, None, 3, "d", None, 8), (None, None, 3, "d", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _n int, `a.b` string, m map<string,int>, doc int").repartition(3)
    got = P.one_of_each_group(spark, docs, "")
    assert got.columns == docs.columns
    out = got.collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "3", "None", "None"]
    assert {(r["_n"], r["a.b"]) for r in out} <= {(77, "a"), (78, "a"), (2, "c"), (3, "d")}
