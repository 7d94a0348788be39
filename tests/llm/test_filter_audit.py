import random
from itertools import permutations

import pytest

from vireo.llm import filter_audit


def words(t):
    for c in "\t\n\v\f\r":
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for i, (d, text, lang) in enumerate(docs):
        t = text or ""
        w = words(t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs)
        rows.append((lang or "", {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for k, x in enumerate(order):
                removed = [r for r in left if r[1][x]]
                earlier = [r for r in mine if r[1][x] and not any(r is y for y in left)]
                left = [r for r in left if not r[1][x]]
                total[x] += len(removed)
                out[part, "".join(order), k + 1] = [len(left), len(removed), len(earlier), sum(r[1][x] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed), x]
        for key, v in out.items():
            if key[0] == part:
                v[6] = total[v[6]]
    return out


def run(spark, docs, labels):
    df = spark.createDataFrame([(*r, 1, "m") for r in docs], "doc_id long, text string, lang string, n int, mask string").repartition(4)
    lab = spark.createDataFrame([(*r, "p") for r in labels], "doc_id long, quality int, toxic int, part string")
    got = filter_audit.audit_filters(df, lab).collect()
    out = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got}
    assert len(out) == len(got)
    return out


def test_against_brute_force(spark):
    rnd = random.Random(1)
    texts = []
    for i in range(70):
        n = rnd.choice([0, 3, 99, 100, 101, 150])
        pool = [f"w{rnd.randrange(rnd.choice([30, 4000]))}{rnd.choice('éxX')}" for _ in range(n)]
        texts.append(rnd.choice(["", " ", "\n\t"]) + rnd.choice([" ", "\t ", "\r\n"]).join(pool) + rnd.choice(["", " # ", "A" * 200, "|", "\v"]))
    texts += [None, "", "", None, "x" * 300_000, "W w " * 40_000, texts[3], texts[3], texts[5]]
    docs = [(i * 7 % 100, t, rnd.choice(["en", "fr", None, ""])) for i, t in enumerate(texts)]
    docs += [(None, texts[3], "en"), (None, texts[3], "en"), docs[8], docs[8], docs[9], (0, texts[3], "en"), (0, "other", "xx")]
    labels = [(d, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for d in range(0, 100, 2)] + [(None, 1, 1), (4, 1, 1), (4, 0, 0), (6, 0, 1), (1000, 1, 1)]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_ties_at_the_bounds(spark):
    exact = " ".join(f"w{i}" for i in range(80)) + " w0" * 20  # 100 words, 80 different
    docs = [(1, exact, "a"), (2, exact + " w0", "a"), (3, " ".join(["A" + "b" * 9] * 1), "a"), (4, "AA" + "b" * 8, "a"), (5, "é" * 9 + "A", "a")]
    assert run(spark, docs, []) == brute(docs, [])


def test_empty_tables(spark):
    assert run(spark, [], []) == {} and run(spark, [], [(1, 1, 1)]) == {}
    one = run(spark, [(1, "x", None)], [])
    assert len(one) == 600 and {k[0] for k in one} == {""}


@pytest.mark.parametrize("filters", [1, 3])
def test_transform_is_inverted_exactly(spark, filters):
    rnd = random.Random(filters)
    rows = [(rnd.choice("ab"), rnd.randrange(1 << filters), rnd.choice([1, 1 << 50]), rnd.random() < 0.5, rnd.random() < 0.5) for _ in range(200)]
    df = spark.createDataFrame(rows, "part string, mask int, n long, good boolean, toxic boolean")
    for r in filter_audit.mask_cells(filter_audit.parity_sums(df, filters), filters).collect():
        for m in range(1 << filters):
            mine = [x for x in rows if x[0] == r.part and x[1] == m]
            assert (r.docs[m], r.good[m], r.toxic[m]) == (sum(x[2] for x in mine), sum(x[2] for x in mine if x[3]), sum(x[2] for x in mine if x[4]))
