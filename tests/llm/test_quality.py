import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from vireo.llm import quality as Q
from vireo.llm import common, sketch, textcodes


def tokens(t):
    return ["<s>", *(t or "").split(), "</s>"]


class Brute:
    """The same model by dictionaries."""

    def __init__(self, texts):
        self.c = Counter((a, b) for t in texts for a, b in zip(tokens(t), tokens(t)[1:]))
        self.d = Q.discounts(*[sum(v == k for v in self.c.values()) for k in (1, 2, 3, 4)])
        self.total, kinds = Counter(), defaultdict(Counter)
        n = Counter(w for _, w in self.c)
        for (h, _), v in self.c.items():
            self.total[h] += v
            kinds[h][min(v, 3)] += 1
        self.gamma = {h: sum(self.d[k - 1] * m for k, m in kinds[h].items()) / self.total[h] for h in kinds}
        d1 = Q.discounts(*[sum(v == k for v in n.values()) for k in (1, 2, 3, 4)])
        off = {w: min(v, d1[min(v, 3) - 1]) for w, v in n.items()}
        all_n = sum(n.values())
        self.unknown = (sum(off.values()) / all_n if all_n else 1.0) / (len(n) + 1)
        self.low = {w: (v - off[w]) / all_n + self.unknown for w, v in n.items()}

    def p(self, h, w):
        low = self.low.get(w, self.unknown)
        if h not in self.total:
            return low
        c = self.c.get((h, w), 0)
        return max(c - (self.d[min(c, 3) - 1] if c else 0), 0) / self.total[h] + self.gamma[h] * low

    def score(self, t):
        s = tokens(t)
        return sum(math.log10(self.p(a, b)) for a, b in zip(s, s[1:]))


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(1)
    words = {lang: [f"{lang}{i}" for i in range(50)] for lang in ("aa", "bb")}
    rows = []
    for i in range(400):
        lang = rnd.choice(["aa", "bb"])
        good = i % 5 > 0
        w = rnd.choices(words[lang], weights=range(50, 0, -1), k=rnd.randint(20, 60))
        rows.append((i, " ".join(w if good else [x.upper() + "!!" for x in w]), lang, int(good)))
    return rows


def test_model_against_dictionaries(spark, data, monkeypatch):
    monkeypatch.setattr(Q, "BLOCK_BYTES", 3000)
    texts = [r[1] for r in data if r[3]][:60] + ["", "aa1 aa1 aa1 aa1"]
    model = Q.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    brute = Brute(texts)
    assert model.d == pytest.approx(brute.d) and model.unknown == pytest.approx(brute.unknown)
    probe = [(i, t) for i, t in enumerate([*texts[:5], None, "", "unknown words", "aa1 unknown aa2", data[0][1], "bb3 " * 3000])]
    got = {r.doc.doc_id: r for r in Q.perplexities(spark.createDataFrame(probe, "doc_id long, text string").repartition(4), model, ["doc_id"]).collect()}
    for i, t in probe:
        assert got[i].n_tokens == len(tokens(t)) - 1
        assert got[i].log10_prob == pytest.approx(brute.score(t), rel=1e-9)


def test_slices_have_the_whole_model(spark, data, monkeypatch):
    texts = [r[1] for r in data if r[3]][:60]
    model = Q.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    brute = Brute(texts)
    monkeypatch.setattr(Q, "BLOCK_BYTES", 500)
    monkeypatch.setattr(Q, "SLICE_BLOCKS", 1)
    monkeypatch.setattr(Q, "COPIES", 3)
    made, slices = [], Q._slices
    monkeypatch.setattr(Q, "_slices", lambda tables, n: made.append(n) or slices(tables, n))
    got = Q.perplexities(spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").repartition(4), model, ["doc_id"]).collect()
    assert made[0] > 20 and len(got) == len(data)
    for r in got:
        assert r.log10_prob == pytest.approx(brute.score(data[r.doc.doc_id][1]), rel=1e-9)
    for n in (1, 3, 4, 7):
        rows = slices(spark.createDataFrame([(5,), (6,)], "shard int"), n).collect()
        assert sorted((r.shard, r.slice) for r in rows) == [(s, i) for s in (5, 6) for i in range(n)]


def test_probabilities_add_up(data):
    brute = Brute([r[1] for r in data if r[3]][:60])
    for h in ("<s>", "aa0", "bb7", "never seen"):
        assert sum(brute.p(h, w) for w in brute.low) + brute.p(h, "unknown") == pytest.approx(1)


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, "x") for i, t, lang, _ in rows], "doc_id long, text string, lang string, keep string").repartition(3)
    return Q.classify_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()


def test_keeps_clean_and_rejects_junk(spark, data):
    got = run(spark, data, [(i, q, 0) for i, _, _, q in data if i % 2])
    assert len(got) == len(data)
    by_id = {r.doc_id: r for r in got}
    assert sum(by_id[i].keep for i, _, _, q in data if q) >= 0.97 * sum(r[3] for r in data)
    assert not any(by_id[i].keep for i, _, _, q in data if not q)


def test_defined_cases(spark, data):
    odd = data + [(None, "aa1 aa2", "aa", 1), (500, None, None, 1), (501, "", "cc", 1), (500, "aa3 aa4", "aa", 1), (1, "aa3", "aa", 1)]
    got = run(spark, odd, [(i, q, 0) for i, _, _, q in data] + [(1, 0, 0), (None, 1, 0)])
    assert len(got) == len(odd) and all(r.threshold is not None for r in got)
    none = run(spark, odd[:20], [])
    assert all(r.keep and r.threshold is None for r in none) and len(none) == 20
    assert run(spark, [], []) == []


def test_thresholds_of_all_that_was_not_learnt(spark, data, monkeypatch):
    rows = data + [(1000 + i, f"cc{i} cc{i % 3} cc0", "cc", 1) for i in range(8)]
    learnt, train = [], Q.train
    monkeypatch.setattr(Q, "train", lambda docs: learnt.extend(r.id for r in docs.collect()) or train(docs))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    got = Q.classify_quality(docs, labels, trusted=40, quantile=0.8).collect()
    left = {r[0] for r in rows if r[3]} - set(learnt)
    assert 10 < len(learnt) < 60
    for lang in ("aa", "bb", "cc"):
        own = sorted(-r.log10_prob / r.n_tokens for r in got if r.lang == lang and r.doc_id in left)
        want = (math.floor(own[math.ceil(0.8 * len(own)) - 1] / Q.BIN) + 1) * Q.BIN
        assert all(math.log10(r.threshold) == pytest.approx(want) for r in got if r.lang == lang)


def test_learns_from_ten_thousand_by_default(spark, monkeypatch):
    learnt, train = [], Q.train
    monkeypatch.setattr(Q, "train", lambda docs: learnt.append(docs.count()) or train(docs))
    docs = spark.range(6000).selectExpr("id AS doc_id", "'a b' AS text", "'aa' AS lang")
    Q.classify_quality(docs, docs.selectExpr("doc_id", "1 AS quality"))
    assert 4500 < learnt[0] < 5100  # all but the fifth that is held out


def test_discounts():
    assert Q.discounts(0, 0, 0, 0) == (0.0, 0.0, 0.0)
    assert Q.discounts(10, 5, 3, 2) == pytest.approx((0.5, 1.1, 3 - 4 * 0.5 * 2 / 3))


def test_blocks_keep_known_words_and_one_unknown():
    texts = [b"a b a", b"", b"c a \xc3\xa9 zz"]
    tokens, starts = Q._tokens(texts)
    known = Q._wide(tokens[:5])  # begin, a, b, a, end
    bits = np.zeros(1 << 17, dtype=np.uint8)
    for at in sketch.bloom_places(known.view(np.int64), 20):
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
    own, number = Q._possible(tokens, bits)
    back, at = textcodes.unpack_tokens(textcodes.pack_tokens(own, number, starts))
    assert at.tolist() == starts.tolist()
    assert back.tolist() == np.where(np.isin(tokens, tokens[:5]), tokens, Q.UNKNOWN).tolist()


def test_learns_from_all_that_is_trusted(spark, monkeypatch):
    learnt, train = [], Q.train
    monkeypatch.setattr(Q, "train", lambda docs: learnt.append(docs.count()) or train(docs))
    docs = spark.range(14000).selectExpr("id AS doc_id", "'a b' AS text", "'aa' AS lang")
    Q.classify_quality(docs, docs.selectExpr("doc_id", "1 AS quality"))
    assert 10900 < learnt[0] < 11500  # a sample of 10,000 left some 8,000


def test_shards_follow_the_model(spark, data, monkeypatch):
    texts = [r[1] for r in data if r[3]][:60]
    model = Q.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    codes, shards, deal = model.words.count() + model.pairs.count(), [], Q._deal
    monkeypatch.setattr(Q, "SHARD_CODES", 100)
    monkeypatch.setattr(Q, "_deal", lambda table, what, n: shards.append(n) or deal(table, what, n))
    got = Q.perplexities(spark.createDataFrame([r[:2] for r in data], "doc_id long, text string").repartition(4), model, ["doc_id"]).collect()
    assert shards == [-(-codes // 100)] * 2 and shards[0] > 5
    brute = Brute(texts)
    assert all(r.log10_prob == pytest.approx(brute.score(data[r.doc.doc_id][1]), rel=1e-9) for r in got) and len(got) == len(data)


def test_rounds_leave_nothing_but_scores(spark, data, monkeypatch):
    texts = [r[1] for r in data if r[3]][:60]
    brute = Brute(texts)
    model = Q.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    monkeypatch.setattr(Q, "ROUND_BYTES", 10_000)
    made, asked, left = [], [], []
    write, ask, score = Q.materialize, Q._ask, Q._score_round
    gone = lambda path: not spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    monkeypatch.setattr(Q, "materialize", lambda df, tag, **more: made.append((tag, write(df, tag, **more))) or made[-1][1])
    monkeypatch.setattr(Q, "_ask", lambda rows, base, *more: asked.append(base) or ask(rows, base, *more))
    monkeypatch.setattr(Q, "_score_round", lambda *args: left.append([gone(p) for p in asked]) or score(*args))
    docs = spark.createDataFrame([(*r[:2], {"k": r[0]}) for r in data] + [(None, None, None)] * 3, "doc_id long, text string, extra map<string, int>").repartition(4)
    got = Q.perplexities(docs, model, ["doc_id", "extra"], last=True).collect()
    assert len(asked) == Q.ROUNDS and left == [[True] * k for k in range(Q.ROUNDS)]
    assert all(gone(t._vireo_path) == (tag != "quality-scored") for tag, t in made) and all(map(gone, asked))
    assert gone(model.words._vireo_path) and gone(model.pairs._vireo_path)
    assert len(got) == len(data) + 3
    for r in got:
        assert r.log10_prob == pytest.approx(brute.score(None if r.doc.doc_id is None else data[r.doc.doc_id][1]), rel=1e-9)


def test_shuffles_are_freed_only_within(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), common.shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key) == before
