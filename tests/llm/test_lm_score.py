import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.llm import lm_score


def tokens(t):
    for c in "\t\n\v\f\r":
        t = (t or "").replace(c, " ")
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split(" ") if w] + ["</s>"]


def brute(rows, order):
    """Scores by plain dictionaries, for each b of the grid, and the grid's leave-one-out choice."""
    counts = [Counter() for _ in range(order + 1)]
    for t, train in rows:
        if train:
            s = ["<s>", *tokens(t)]
            for i in range(len(s)):
                for k in range(1, order + 1):
                    if i >= k - 1:
                        counts[k][tuple(s[i - k + 1 : i + 1])] += 1
    n = sum(c for g, c in counts[1].items() if g != ("<s>",))
    v = len(counts[1]) - (("<s>",) in counts[1])

    def score(t, b, less):
        s, low, full, known = ["<s>", *tokens(t)], 0.0, 0.0, 0
        for i in range(1, len(s)):
            c = counts[1][(s[i],)]
            known += c > 0
            p = (max(c - less, 0) + 0.1) / (max(n - less, 0) + 0.1 * (v + 1))
            low += math.log10(p)
            for k in range(2, order + 1):
                if i >= k - 1:
                    g = tuple(s[i - k + 1 : i + 1])
                    p = (max(counts[k][g] - less, 0) + b * p) / (max(counts[k - 1][g[:-1]] - less, 0) + b)
            full += math.log10(p)
        return len(s) - 1, known, low, full

    best = max(lm_score.GRID, key=lambda b: sum(score(t, b, 1)[3] for t, train in rows if train))
    return [(*score(t, best, 0)[:2], n, *score(t, best, 0)[2:]) for t, _ in rows]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_dictionaries(spark, monkeypatch, order):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(lm_score, "PART", 7)
    monkeypatch.setattr(lm_score, "GROUP", 100)
    rnd = random.Random(order)
    vocabulary = [f"w{i}é" for i in range(40)]
    rows = [(" ".join(rnd.choices(vocabulary[: rnd.randint(2, 40)], k=rnd.randint(0, 60))), i % 3 > 0) for i in range(60)]
    rows += [(None, True), ("", False), ("\n\t", True), ("NEW new WORD", False), ("w1é " * 2000, True), rows[0], rows[0]]
    df = spark.createDataFrame([(i, t, f, "c") for i, (t, f) in enumerate(rows)], "doc_id long, text string, train boolean, score string").repartition(4)
    got = {r.doc.doc_id: r for r in lm_score.score_texts(df, F.col("train"), order=order, keep=["doc_id"]).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(brute(rows, order)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert (r.base_score, r.score) == pytest.approx(want[3:], rel=1e-9)


def test_words_beside_an_enormous_one_stay_apart(spark):
    rnd = random.Random(7)
    one, other = ([f"{rnd.getrandbits(40):x}" for _ in range(3000)] for _ in range(2))
    rows = [(" ".join([*one, "w" * (3 << 20)]), True), (" ".join([*other, one[5], "w" * (3 << 20)]), False)]
    got = {r.doc.doc_id: r for r in lm_score.score_texts(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, train boolean"), F.col("train"), order=2, keep=["doc_id"]).collect()}
    for i, want in enumerate(brute(rows, 2)):
        assert (got[i].n_tokens, got[i].n_known) == want[:2]
        assert (got[i].base_score, got[i].score) == pytest.approx(want[3:], rel=1e-9)


def test_no_training_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm_score.score_texts(df, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(r.base_score) for r in got)
    assert lm_score.score_texts(df.limit(0), F.lit(True)).count() == 0


def test_state_weights_add_up(spark):
    """All continuations of a history, and one unknown word, have probability 1 together."""
    words = ["a", "b", "c", "d"]
    rows = [("a b a c", True), ("b b d a", True), ("a", True)]
    probes = [("a " + w, False) for w in [*words, "unknown"]] + [("a", False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + probes)], "doc_id long, text string, train boolean")
    got = {r.doc.doc_id: r.score for r in lm_score.score_texts(df, F.col("train"), keep=["doc_id"]).collect()}
    # P(w | a) = score('a w') - score('a') with the end tokens' own steps taken off by brute force
    want = brute(rows + probes, 2)
    assert [got[i] for i in range(len(want))] == pytest.approx([w[4] for w in want])


def test_states_carry_histories_and_failure_arcs_shorten_them():
    """Trigrams over the tokens 0 1 2 0 1 3: what is seen is an arc, all else goes by failure arcs."""
    tokens = np.array([0, 1, 2, 0, 1, 3])
    number, counts = [], []
    for k in (1, 2, 3):
        grams = [tuple(tokens[i - k + 1 : i + 1]) if i >= k - 1 else None for i in range(len(tokens))]
        own = sorted({g for g in grams if g})
        number.append(np.array([own.index(g) if g else -1 for g in grams]))
        counts.append(np.array([grams.count(g) for g in own]))
    a = lm_score.Automaton(counts, number, n=6, v=4, grid=(2.0,))
    word = {w: number[0][list(tokens).index(w)] for w in range(4)}

    def go(*words):
        state, w = np.array([0]), None
        for x in words:
            state, w = a.step(state, np.array([word[x]]))
        return int(state[0]), 10 ** float(w[0, 0])

    low = {w: (list(tokens).count(w) + 0.1) / (6 + 0.5) for w in range(4)}
    assert go(1)[1] == pytest.approx(low[1])
    assert go(0, 1)[1] == pytest.approx((2 + 2 * low[1]) / (2 + 2))
    second = (1 + 2 * low[2]) / (2 + 2)
    assert go(0, 1, 2)[1] == pytest.approx((1 + 2 * second) / (2 + 2))
    # after (0, 1) the token 0 has no arc in any history: two failure arcs, each 2 / (2 + 2)
    assert go(0, 1, 0)[1] == pytest.approx(0.5 * 0.5 * low[0])
    assert go(3, 0, 1)[0] == go(0, 1)[0] != go(1)[0]
    assert a.fail[go(0, 1)[0]] == go(1)[0] and a.fail[go(1)[0]] == 0
