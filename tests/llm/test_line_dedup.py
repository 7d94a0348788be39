import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vireo.llm import line_dedup

WHITE = " \t\n\v\f\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def brute(rows, min_docs=10, min_chars=1, keep_first=False):
    """(id, lines, dropped, text) for each row."""
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    gone = {k for k, n in docs.items() if n >= min_docs and len(k) >= min_chars}
    first = {}
    if keep_first:
        for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)):
            for j, x in enumerate((rows[i][1] or "").split("\n")):
                first.setdefault(key(x), (i, j))
    out = []
    for i, (d, t) in enumerate(rows):
        parts = (t or "").split("\n")
        rest = [x for j, x in enumerate(parts) if key(x) not in gone or first.get(key(x)) == (i, j)]
        out.append((d, len(parts), len(parts) - len(rest), "\n".join(rest)))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    common = [f"Line {i} é" for i in range(12)] + ["", "x", "\t", "ß ", " y "]
    rows = []
    for i in range(150):
        own = [rnd.choice(["", " ", "\t"]) + rnd.choice([str.upper, str.lower, str])(rnd.choice(common[: rnd.randint(1, 17)])) + rnd.choice(["", "\r", " \v"]) if rnd.random() < 0.3 else f"own {i} {j}" for j in range(rnd.randint(1, 9))]
        rows.append((i * 7 % 1000, "\n".join(own)))
    rows += [(2000, None), (2001, ""), (2002, "\n\n"), (2003, " \n\t"), (2004, "line 0 é\n" * 5), (2005, "long " * 300_000 + "\nLINE 1 é\n" + "z\n" * 5000)]
    rows += [(3000 + i, "nine\nten" if i < 9 else "ten") for i in range(10)]
    return rows + [(4000, "one row\nmany times")] * 11 + [(4001, "same line\n" * 12)]


def run(spark, rows, n=5, **options):
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, n_lines int, kept string, `a.b` int").repartition(n)
    return df, line_dedup.drop_shared_lines(df, **options)


@pytest.mark.parametrize("seed, block, bits", [(1, 8 << 20, (20, 28)), (2, 500, (3 + 4, 10))])
def test_against_brute_force(spark, monkeypatch, seed, block, bits):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(line_dedup, "FILTER_BITS", bits)
    rows = corpus(seed)
    df, out = run(spark, rows, with_text=True)
    got = out.collect()
    assert got[0].doc.asDict().keys() == set(df.columns)
    want = brute(rows)
    assert sorted((r.doc.doc_id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in got) == sorted(want)
    report = line_dedup.line_report(df).collect()
    assert sorted(tuple(r) for r in report) == sorted((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in want)


@pytest.mark.parametrize("options", [{"min_docs": 2}, {"min_docs": 3, "min_chars": 2}, {"min_docs": 10, "keep_first": True}])
def test_options(spark, monkeypatch, options):
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 800)
    rows = list({r[0]: r for r in corpus(3)}.values())
    _, out = run(spark, rows, with_text=True, **options)
    assert sorted((r.doc.doc_id, r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in out.collect()) == sorted(brute(rows, **options))


def test_odd_ids_and_empty_table(spark):
    rows = [(None, "a\nb"), (None, "a\nc")] * 5 + [(1, None)]
    _, out = run(spark, rows, with_text=True)
    assert sorted((str(r.doc.doc_id), r.n_lines, r.n_dropped, bytes(r.kept).decode()) for r in out.collect()) == sorted((str(d), n, k, t) for d, n, k, t in brute(rows))
    assert run(spark, [])[1].count() == 0
    assert run(spark, [(1, None), (2, "")])[1].count() == 2
    with pytest.raises(ValueError):
        run(spark, rows, min_docs=1)


def test_filters_of_tasks_combine():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 1 << 63, 300, dtype=np.uint64) for _ in range(3)]
    parts[1][:50], parts[2][:20], parts[2][30:60] = parts[0][:50], parts[0][:20], parts[1][100:130]
    seen = []
    for p in parts:
        s = line_dedup.SeenTwice(16)
        s.add(p)
        seen.append(np.concatenate([s.once, s.twice]))
    for order in ([0, 1, 2], [2, 0, 1]):
        total = seen[order[0]]
        for k in order[1:]:
            total = line_dedup.merge(total, seen[k])
        every = np.concatenate(parts)
        own, n = np.unique(every, return_counts=True)
        again = line_dedup.sketch.in_bloom(total[len(total) // 2 :], own.view(np.int64))
        assert again[n > 1].all() and again[n == 1].mean() < 0.1


def test_parts_are_the_text():
    text = b"a\n" * 10 + b"b" * 50 + b"\n\n" + b"c"
    old = line_dedup.PART
    try:
        for size in (1, 2, 7, 1000):
            line_dedup.PART = size
            assert b"\n".join(line_dedup.parts(text)) == text
            assert list(line_dedup.parts(b"")) == [b""]
    finally:
        line_dedup.PART = old
