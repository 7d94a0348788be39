import random
import re
from collections import defaultdict

import numpy as np

import corpus_pipeline as P
from vireo.llm import passages, suffix_dedup, textcodes

from .test_pipeline import SCHEMA


def brute(texts, length, n):
    """What is left of the texts."""
    data = [(t or "").encode() for t in texts]
    words = [[(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    bytes_at, docs_of = defaultdict(int), defaultdict(set)
    for i, d in enumerate(data):
        for k in range(len(d) - length + 1):
            bytes_at[d[k : k + length]] += 1
        for k in range(len(words[i]) - n + 1):
            docs_of[tuple(d[a:b] for a, b in words[i][k : k + n])].add(i)
    out = []
    for i, d in enumerate(data):
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            if bytes_at[d[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        for k in range(len(words[i]) - n + 1):
            if len(docs_of[tuple(d[a:b] for a, b in words[i][k : k + n])]) > 1:
                gone[words[i][k][0] : words[i][k + n - 1][1]] = [True] * (words[i][k + n - 1][1] - words[i][k][0])
        out.append(bytes(c for c, g in zip(d, gone) if not g))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdé", k=rnd.randint(1, 5))) for _ in range(500)]
    text = lambda n: rnd.choice([" ", "\n", "  "]).join(rnd.choices(vocabulary, k=n))
    shared = [rnd.choices(vocabulary, k=rnd.randint(45, 70)) for _ in range(5)]
    texts = [text(rnd.randint(0, 90)) + " " + rnd.choice([" ", "\t\n"]).join(rnd.choice(shared)) + rnd.choice([" ", "x "]) + text(rnd.randint(0, 60)) for _ in range(40)]
    alone = text(60)
    return [*texts, None, "", " \n", texts[0], texts[0], alone + "! " + alone, "a " * 49, "a " * 50, "b " * 150, "b " * 51, "w " * 60 + "end"]


def test_passages_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 2000), (2, 8 << 20)):
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
        texts = corpus(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc.doc_id: r for r in suffix_dedup.remove_repeats(docs, with_text=True, words=50).collect()}
        want = brute(texts, 400, 50)
        assert len(got) == len(texts)
        assert [bytes(got[i].kept) for i in range(len(texts))] == want
        assert sum(w != (t or "").encode() for w, t in zip(want, texts)) > 20


def test_stage_cuts_short_passages_of_fifty_words(spark):
    rnd = random.Random(5)
    text = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=4)) for _ in range(n))
    passage, clean, alone = text(55), text(80), text(52)
    assert len(passage) < 400
    rows = [(1, text(40) + "\n" + passage + "\n" + text(30)), (2, text(35) + " " + passage + " " + text(60)), (3, clean), (4, alone + "\n" + text(3) + "\n" + alone), (5, text(90) + " " + passage[: len(passage) * 4 // 5])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id: r for r in P.remove_repeats(spark, docs, "").collect()}
    assert all(passage not in got[i].text and len(got[i].text) == len(dict(rows)[i]) - len(passage) == got[i].n_chars for i in (1, 2))
    assert all(got[i].text == dict(rows)[i] for i in (3, 4, 5))


def test_runs():
    h = textcodes.mix(np.arange(40, dtype=np.uint64) % np.uint64(10))
    for n in (1, 2, 7, 8, 30, 40):
        out = passages.runs(h, n)
        assert len(out) == 41 - n and len(np.unique(out)) == min(10, 41 - n) and (out[10:] == out[:-10]).all()
    assert len(passages.runs(h, 41)) == 0
