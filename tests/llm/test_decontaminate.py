import hashlib
import random
import re

import pytest

from vireo.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    out = []
    for _, text in docs:
        w, hit, found = words(text), set(), set()
        for k, item in items:
            v = words(item)
            m = min(n, len(v))
            for i in range(len(v) - m + 1 if v else 0):
                for j in range(len(w) - m + 1):
                    if w[j : j + m] == v[i : i + m]:
                        hit.update(range(j, j + m))
                        if k is not None:
                            found.add(str(k))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture
def data():
    rnd = random.Random(1)
    vocabulary = ["".join(rnd.choices("abcé", k=3)) for _ in range(60)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.randint(1, 25)))) for i in range(12)] + [(3, "a a a"), (None, "null id item"), (40, None), (41, " .,"), (42, "Rep rep rep rep rep rep rep rep rep rep rep rep"), (43, "Rep rep rep rep rep rep rep rep rep rep rep rep")]
    docs = []
    for i in range(60):
        t = " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 40)))
        for _ in range(rnd.randint(0, 2)):
            v = (rnd.choice(items)[1] or "").split()
            a = rnd.randint(0, len(v))
            t += " -- ".join(["", *v[a : a + rnd.randint(1, 15)]]) + "\n" + " ".join(rnd.choices(vocabulary, k=5)).upper()
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "..."), (103, "null ID\0item"), (104, "rep " * 40), (104, "rep " * 40), (None, "a A a"), (105, "a " * 3000)]
    return docs, items


@pytest.mark.parametrize("shard", [250_000, 7])
def test_against_brute_force(spark, data, monkeypatch, shard):
    monkeypatch.setattr(D, "SHARD_WINDOWS", shard)
    docs, items = data
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, spans string, n_words int")
    bench = spark.createDataFrame([(k, t, 0) for k, t in items], "item_id long, text string, doc int")
    got = sorted(tuple(r)[1:] for r in D.contamination_report(df, bench).collect())
    assert got == sorted(brute(docs, items))


def test_original_spans(spark):
    item = "The quick-brown fox; jumps over the lazy dog again and again"
    text = "é!! THE  quick brown, fox jumps over the lazy dog AGAIN. Not more"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    r = D.find_contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    (s,) = r.spans
    assert text.encode()[s.a : s.b].decode() == "THE  quick brown, fox jumps over the lazy dog AGAIN"


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.contamination_report(docs, none).collect()] == [False]
    assert D.contamination_report(docs.limit(0), none).count() == 0


def test_a_benchmark_of_some_megabytes_stays_small():
    """Windows are word numbers, so the automaton takes bytes for words, not for letters."""
    import resource

    rnd = random.Random(3)
    vocabulary = [("".join(rnd.choices("abcdefghij", k=9))).encode() for _ in range(50_000)]
    items = [(k, rnd.choices(vocabulary, k=500)) for k in range(400)]  # 2 MB of text
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    machine = D.Automaton(items)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700 * 1024
    text = b" ".join(items[7][1][40:60]) + b" xx " + b" ".join(items[9][1][:9])
    assert machine.scan(text) == (30, [(0, 20)], {7})


def test_the_automaton_is_built_once_in_a_worker():
    a = D._automaton("s", [(0, [b"a", b"b"])], 10)
    assert D._automaton("s", [(0, [b"a", b"b"])], 10) is a
    assert D._automaton("t", [(0, [b"a"])], 10) is not a and len(D._BUILT) == 1
