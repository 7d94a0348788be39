import random

import pytest
from pyspark.sql import functions as F

from vireo.llm import langid

LETTERS = {"aa": "etaoinshr", "bb": "éèàourstl", "cc": "жзиклмноп"}


def text(rnd, lang, n=40):
    return " ".join("".join(rnd.choices(LETTERS[lang], k=rnd.randint(2, 7))) for _ in range(n))


@pytest.fixture
def docs(spark):
    rnd = random.Random(1)
    rows = [(i, text(rnd, lang := rnd.choice(list(LETTERS)), rnd.randint(5, 60)), lang, "x", 1.0) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double").repartition(3)


def test_held_out_accuracy(docs):
    langs, p = langid.learn_prototypes(docs.filter(langid.fold("doc_id", 4) != 2))
    assert langs == sorted(LETTERS)
    out = langid.identify_languages(docs.filter(langid.fold("doc_id", 4) == 2), langs, p, keep=["doc_id", "lang"]).collect()
    assert len(out) > 20
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_defined_cases(spark, docs):
    langs, p = langid.learn_prototypes(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 .,!"), (4, "é"), (None, "eta " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify_languages(odd, langs, p, keep=["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0.0
    assert got[4].lang_pred in langs and got[None].lang_pred == "aa"
    assert langid.identify_languages(odd.limit(0), langs, p).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    langs, p = langid.learn_prototypes(docs)
    assert langs == []
    assert [r.lang_pred for r in langid.identify_languages(docs, langs, p).collect()] == ["und", "und"]


def test_pieces_give_the_same_counts(monkeypatch):
    t = "Hello,  wörld! " * 50
    want = langid.trigram_counts(t)
    monkeypatch.setattr(langid, "PIECE", 7)
    got = langid.trigram_counts(t)
    assert all((a == b).all() for a, b in zip(want[:2], got[:2])) and want[2] == got[2]


def test_fold_is_crc32_of_the_text(spark):
    import zlib

    rows = spark.range(50).select("id", langid.fold("id", 10).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 10 for r in rows)


def plain(texts, train):
    """Languages and scores by plain integers: bind, bundle, compare, one trigram after another."""
    import math

    def bundle(t):
        s = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        s = " " + " ".join(s.split()) + " " if s.strip() else ""
        out = [0] * langid.DIM
        for i in range(len(s) - 2):
            v = [langid.letter_vector(ord(c) if c != " " else 32).tolist() for c in s[i : i + 3]]
            for k in range(langid.DIM):
                out[k] += v[0][k - 2] * v[1][k - 1] * v[2][k]
        return out

    sums = {}
    for t, lang in train:
        if t is not None and lang is not None:
            sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * langid.DIM), bundle(t))]
    out = []
    for t in texts:
        v = bundle(t)
        if not any(c.isalpha() for c in t or "") or not sums:
            out.append(("und", 0.0))
            continue
        cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        best = max(sorted(sums), key=lambda lang: cosine(v, sums[lang]))
        out.append((best, max(0.0, cosine(v, sums[best]))))
    return out


def test_against_plain_integers(spark):
    rnd = random.Random(2)
    rows = [(text(rnd, lang := rnd.choice(list(LETTERS)), rnd.randint(1, 6)), lang) for _ in range(30)]
    rows += [(None, "aa"), ("", "aa"), ("1 2", "bb"), ("Éé\u0301 x", None), ("ETA eta", "bb"), rows[0], rows[0], ("x", "aa")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    learnt = docs.filter("doc_id % 4 <> 2")
    langs, p = langid.learn_prototypes(learnt)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_languages(docs, langs, p).collect()}
    want = plain([t for t, _ in rows], [r for i, r in enumerate(rows) if i % 4 != 2])
    for i, (lang, score) in enumerate(want):
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-5)


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a"), (3, "same text", "a"), (3, "same text", "a")], "doc_id long, text string, lang string")
    langs, p = langid.learn_prototypes(docs)
    assert [r.lang_pred for r in langid.identify_languages(docs, langs, p).collect()] == ["a"] * 4
