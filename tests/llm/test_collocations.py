import random
import re
from collections import Counter

import numpy as np
import pytest

from vireo.llm import collocations as C
from vireo.llm import textcodes


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\v\f\r]", low)]


def brute(rows, min_count, top, percent=100, longest=5):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    best = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= min_count:
            best[lang, p] = min((1000 * a * total[lang] // (f[lang, p[:c]] * f[lang, p[c:]]), c) for c in range(1, len(p)))
    covered = {(lang, p[i : i + k]) for (lang, p) in best for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * f[lang, p] >= percent * f[lang, p[i : i + k]]}
    out = []
    for lang in total:
        mine = sorted(((-s, -f[lang, p], " ".join(p).encode(), p, c) for (x, p), (s, c) in best.items() if x == lang and (x, p) not in covered))[:top]
        out += [(lang, i + 1, " ".join(p), -a, f[lang, p[:c]], f[lang, p[c:]], total[lang], -s) for i, (s, a, _, p, c) in enumerate(mine)]
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [f"{x}{i}" for i in range(25) for x in ("w", "É", "z'")]
    fixed = [" ".join(rnd.sample(vocabulary, rnd.randint(2, 7))) for _ in range(12)]
    rows = []
    for i in range(150):
        w = []
        for _ in range(rnd.randint(0, 40)):
            w.append(rnd.choice(fixed) if rnd.random() < 0.4 else rnd.choice(vocabulary))
            w.append(rnd.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!? "]))
        rows.append((rnd.choice([str.upper, str])("".join(w)), rnd.choice(["en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" \n.", "xx"), ("a " * 400, "en"), ("a b " * 200, "fr"), rows[0], rows[0]]


def run(spark, rows, n=4, **options):
    df = spark.createDataFrame([(i, *r, 1, "p") for i, r in enumerate(rows)], "doc_id long, text string, lang string, n int, phrase string").repartition(n)
    return sorted(tuple(r) for r in C.mine_phrases(df, **options).collect())


@pytest.mark.parametrize("seed, tile, bits, options", [
    (1, 1 << 19, (16, 27), {}), (2, 300, (7, 7), {}), (3, 300, (16, 27), {"top": 7, "covered_percent": 60}),
])
def test_against_brute_force(spark, monkeypatch, seed, tile, bits, options):
    monkeypatch.setattr(textcodes, "TILE", tile)
    monkeypatch.setattr(C, "BUCKET_BITS", bits)
    monkeypatch.setattr(C, "FLUSH", 500)
    rows = corpus(seed)
    got = run(spark, rows, min_count=10, **options)
    assert got == brute(rows, 10, options.get("top", C.TOP), options.get("covered_percent", 100))
    assert any(len(r[2].split(" ")) > 3 for r in got)


def test_fewer_words_and_no_phrases(spark):
    rows = corpus(4)
    assert run(spark, rows, min_count=8, max_words=2) == brute(rows, 8, C.TOP, longest=2)
    assert run(spark, rows, min_count=100_000) == []
    assert run(spark, [(None, None), ("", "en")]) == [] and run(spark, []) == []


def test_products_past_64_bits(spark):
    n, a, l, r = 3 * 10**15 + 7, 10**14 + 3, 2 * 10**14 + 1, 10**14 + 9
    f = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)], "part string, phrase string, words int, n long")
    got = C.scored_candidates(f, spark.createDataFrame([("en", n)], "part string, total long")).first()
    assert (got.l, got.r, got.score) == (l, r, 1000 * a * n // (l * r))


@pytest.mark.parametrize("tile", [64, 500, 1 << 19])
def test_long_texts_count_every_phrase_once(monkeypatch, tile):
    monkeypatch.setattr(textcodes, "TILE", tile + textcodes.LONG_WORD)
    rnd = random.Random(tile)
    text = "".join(rnd.choice(["ab", "c", "D" * 300, "é"]) + rnd.choice([" ", ". ", "\t"]) for _ in range(3000)).encode()
    for texts in ([text], [b"x y", text, b"", b"y x"]):
        want = Counter(tuple(w[i : i + k]) for t in texts for w in pieces(t.decode()) for k in range(1, 6) for i in range(len(w) - k + 1))
        got, code = Counter(), {}
        for tile_, text_no in C.tiles(texts, 4):
            for k in range(1, 6):
                own = C.phrase_codes(tile_, np.zeros(len(tile_.words), dtype=np.uint64), k)
                for i in range(len(tile_.words) - k + 1):
                    if tile_.piece[i] == tile_.piece[i + k - 1] and i + k - 1 >= tile_.skip:
                        p = tuple(tile_.data[s:e].decode() for s, e in zip(tile_.starts[i : i + k], tile_.ends[i : i + k]))
                        got[p] += 1
                        assert code.setdefault(p, own[i]) == own[i] and text_no[i] == text_no[i + k - 1]
        assert got == want and len(set(code.values())) == len(code)
