import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vireo.llm import suffix_dedup, textcodes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choices("abcdefgh éü", k=n))
    passages = [text(rnd.randint(300, 900)) for _ in range(6)]
    texts = []
    for _ in range(40):
        t = text(rnd.randint(0, 700))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            t += p[a : a + rnd.randint(200, len(p))] + text(rnd.randint(0, 300))
        texts.append(t)
    texts += [None, "", "a" * 399, "b" * 400, "c" * 401, "d" * 3000, "ab" * 700, texts[3], texts[3], texts[4] + "z", "e" * 500, "e" * 450]
    return texts


def run(spark, texts, length=400, parts=4):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_bytes int").repartition(parts)
    rows = suffix_dedup.repeat_report(df, length=length).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}
    assert len(rows) == len(texts)
    return [got[i] for i in range(len(texts))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    assert run(spark, texts) == brute(texts, 400)


def test_other_length(spark):
    texts = corpus(3)
    assert run(spark, texts, length=130) == brute(texts, 130)


@pytest.mark.parametrize("hot, fan", [(2, 1024), (2, 3), (20_000, 2)])
def test_hot_triggers_small_blocks_in_groups(spark, monkeypatch, hot, fan):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "FAN", fan)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    texts = corpus(4)
    assert run(spark, texts) == brute(texts, 400)


@pytest.mark.parametrize("length", [5, 8, 17, 64, 100])
def test_window_ranks_are_the_order_of_the_windows(length):
    rng = np.random.default_rng(length)
    data = np.concatenate([rng.integers(0, 2, 300), np.tile(rng.integers(0, 256, 40), 5)]).astype(np.uint8)
    at = rng.permutation(len(data) - length + 1)
    raw = data.tobytes()
    own = [raw[i : i + length] for i in at]
    number = {w: k for k, w in enumerate(sorted(set(own)))}
    assert suffix_dedup.window_ranks(data, at, length).tolist() == [number[w] for w in own]


def test_equal_phrases_of_a_block_are_dealt_once():
    block = suffix_dedup._Block(400)
    text = "".join(random.Random(8).choices("abc", k=3000)).encode()
    for t in (text, b"x" + text, text):
        block.add(t)
    got = block.parse()
    assert 0 < (got["weight"] > 0).sum() <= len(got["p"]) // 2 + 8
    assert (got["weight"][got["first"]] > 0).all()


def test_long_texts_in_tiles(monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abc", k=9000))]
    texts.append(texts[0][2000:5000] + "".join(rnd.choices("abc", k=4000)) + texts[0][100:700])
    monkeypatch.setattr(textcodes, "TILE", 2048)
    block = suffix_dedup._Block(400)
    for t in texts:
        block.add(t.encode())
    got = block.parse()
    windows = Counter()
    for lo, hi in zip(got["lo"].tolist(), got["hi"].tolist()):
        windows.update(range(lo, hi + 1))
    ends = [len(texts[0]), len(texts[0]) + len(texts[1])]
    assert set(windows) == set(range(ends[0] - 399)) | set(range(ends[0], ends[1] - 399))
    assert set(windows.values()) == {1}
    assert all(h - 200 <= p and lo <= p <= lo + 200 for p, lo, h in zip(got["p"], got["lo"], got["hi"]))


def test_keeps_columns_and_text(spark):
    texts = corpus(6)[:8]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in suffix_dedup.remove_repeats(df, with_text=True).collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert r.doc.asDict() == {"doc_id": r.doc.doc_id, "text": texts[r.doc.doc_id]}


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "q" * 500), (None, None), (1, "q" * 500)], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffix_dedup.repeat_report(df).collect()) == [0, 500, 500]
    assert suffix_dedup.repeat_report(df.limit(0)).count() == 0
