import random

import numpy as np
import pytest

from vireo.llm import graph, ngram_join, textcodes

SPACE = " \t\n\v\f\r"


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingles(text):
    w = words(text)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n=120):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choices("abcdeé", k=4)) for _ in range(400)]
    passage = " ".join(rnd.choices(vocabulary, k=30))
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.5 and texts:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            w = rnd.choices(vocabulary, k=rnd.randint(3, 90))
            texts.append(" ".join(w) + (" " + passage if kind < 0.7 else ""))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    texts += [None, "", " \n\t", "one", "ONE", "One\ttwo", "x " * 5000, "X  " * 5000, texts[0].upper() + "\n"]
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)] + [(None, texts[3]), (5, texts[4]), (5, texts[5]), (6, texts[6]), (6, texts[6])]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, n int, component string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("few", [2, 64])
def test_hot_near_copies_and_small_salts(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "SALT", 3)
    monkeypatch.setattr(ngram_join, "POSTINGS", 50)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "INDEX", 16)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(80):
        w = list(base)
        w[i % 60] = f"x{i}"
        if i % 3 == 0:
            w[(i * 7) % 60] = "y"
        rows.append((i, " ".join(w)))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("partitions, shared", [(1, 3), (8, 1), (211, 0)])
def test_few_shared_shingles(spark, partitions, shared):
    common = " ".join(f"c{i}" for i in range(4 + shared))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30)) + (" " + common if shared and i < 3 else "")) for i in range(50)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()), key=str)
    assert got == brute(rows)


def test_templated_pages_that_do_not_link_make_no_searches(spark, monkeypatch):
    template = " ".join(f"t{i}" for i in range(81))
    rows = [(i, template + " " + " ".join(f"p{i}x{j}" for j in range(19))) for i in range(300)]
    searched = []
    search = ngram_join._search
    monkeypatch.setattr(ngram_join, "_search", lambda rows, roles, *a: searched.append(roles.count()) or search(rows, roles, *a))
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.filter("doc_id = component_id").count() == 300
    assert sum(searched) == 0


def block_documents(n, seed=9):
    """Documents made of half of 40 blocks of words each, in any order."""
    rnd = random.Random(seed)
    blocks = [" ".join(f"b{k}w{i}" for i in range(30)) for k in range(40)]
    return [(i, " ".join(rnd.sample(blocks, 20))) for i in range(n)]


def test_searches_of_documents_with_common_blocks_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", 4)
    monkeypatch.setattr(ngram_join, "INDEX", 32)
    search, searched = ngram_join._search, []
    for n in (200, 400):
        count = []
        monkeypatch.setattr(ngram_join, "_search", lambda rows, roles, *a: count.append(roles.filter("role = 1").count()) or search(rows, roles, *a))
        got = ngram_join.similar_groups(spark.createDataFrame(block_documents(n), "doc_id long, text string"))
        assert got.filter("doc_id = component_id").count() == n
        searched.append(sum(count))
    assert 0 < searched[1] <= 2.1 * searched[0]


@pytest.mark.parametrize("bitmaps, queries", [(1 << 9, 7), (1 << 21, 4096)])
def test_copies_among_documents_with_common_blocks(spark, monkeypatch, bitmaps, queries):
    monkeypatch.setattr(ngram_join, "FEW", 2)
    monkeypatch.setattr(ngram_join, "INDEX", 16)
    monkeypatch.setattr(ngram_join, "BITMAPS", bitmaps)
    monkeypatch.setattr(ngram_join, "QUERIES", queries)
    rows, rnd = block_documents(60), random.Random(2)
    for i, (_, text) in enumerate(rows[:30]):
        w = text.split(" ")
        for _ in range(rnd.randint(1, 25)):
            w[rnd.randrange(len(w))] = f"z{rnd.random()}"
        rows.append((100 + i, " ".join(w[: rnd.randint(450, 600)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df).collect()), key=str) == brute(rows)


def test_bitmaps_in_blocks_equal_those_of_each_pair():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, size=500, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[: rng.integers(2, 500)], size=rng.integers(1, 400))) for _ in range(120)]
    bits, comps = [ngram_join.bitmap(s) for s in sets], rng.integers(0, 5, len(sets)).tolist()
    known = ngram_join.Bitmaps([len(s) for s in sets], comps, bits, 75)
    for s, c, b in zip(sets, comps, bits):
        want = [i for i, (t, d, x) in enumerate(zip(sets, comps, bits)) if d != c and ngram_join.may_link(len(s), len(t), ngram_join.least_difference(b, x))]
        assert sorted(known.may_link(len(s), c, b).tolist()) == want


def test_entries_without_a_fitting_partner_are_dropped():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        lists, size, indexed = np.sort(rng.integers(0, 4, n)), rng.integers(1, 40, n), rng.random(n) < 0.5
        want = []
        for i in range(n):
            fits = [j for j in range(n) if j != i and lists[j] == lists[i] and 100 * min(size[i], size[j]) >= 75 * max(size[i], size[j])]
            want.append(any((indexed[j] and size[j] <= size[i]) or (indexed[i] and size[i] <= size[j]) for j in fits))
        got = ngram_join._with_partner(lists, size, indexed)
        assert all(g or not w for g, w in zip(got, want))  # none is lost
        assert got.sum() <= sum(any(lists[j] == lists[i] and j != i and (indexed[i] or indexed[j]) for j in range(n)) for i in range(n))


def test_search_finds_all_links_in_an_index():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
    sets = []
    for _ in range(60):
        base = sets[rng.integers(len(sets))] if len(sets) > 5 and rng.random() < 0.7 else np.sort(rng.choice(pool, rng.integers(1, 120), replace=False))
        keep = rng.random(len(base)) < 0.93
        sets.append(base[keep] if keep.any() else base)
    for k in (1, 2, len(sets)):
        index = ngram_join.Index(list(range(k)), sets[:k], 75)
        for s in sets:
            want = [i for i in range(k) if ngram_join.linked(len(np.intersect1d(s, sets[i])), len(s), len(sets[i]))]
            assert index.search(s).tolist() == want


def test_empty_table(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_word_hashes_do_not_depend_on_tiles(monkeypatch):
    texts = [b"", b"One two", b" a\tb\n" * 50, ("é" * 9000 + " z").encode(), b"word " * 500]
    want = list(textcodes.word_hashes(texts))
    monkeypatch.setattr(textcodes, "TILE", 64)
    got = list(textcodes.word_hashes(texts))
    assert all(np.array_equal(a, b) for a, b in zip(want, got))
    assert len(want[1]) == 2 and len(want[0]) == 0


def twins(n):
    """Two words of n bytes that sums of powers modulo 2^64 can't tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_enormous_and_crafted_words():
    rnd = random.Random(5)
    texts = []
    for mb in (0, 1, 2, 5):
        for _ in range(2):
            w = [f"{rnd.getrandbits(40):x}" for _ in range(3000)]
            w[1500:1500] = [rnd.choice("xyz") * (mb << 20)] * (mb > 0)
            texts.append(" ".join(w) if rnd.random() < 0.5 else "\n\t" + "  ".join(w) + " ")
    texts += [x for n in (128, 256, 2048, 4096) for x in twins(n)]
    texts += [("q" * (3 << 20)) + " a", "a " + "q" * (3 << 20), "q" * (3 << 20), "b" * textcodes.TILE + " c", "b" * (4 * textcodes.TILE) + "\v" + "c" * textcodes.TILE]
    got = list(textcodes.word_hashes(x.encode() for x in texts))
    known = {}
    for t, h in zip(texts, got):
        own = words(t)
        assert len(own) == len(h)
        for w, x in zip(own, h.tolist()):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)


def test_texts_with_an_enormous_word_are_compared_by_all_their_words(spark):
    rnd = random.Random(6)
    one, other = ([f"{rnd.getrandbits(40):x}" for _ in range(4000)] for _ in range(2))
    long = "w" * (3 << 20)
    near = [*one[:4000], long, *one[:10]]
    rows = [(1, " ".join([*one, long])), (2, " ".join([*other, long])), (3, " ".join(near)), *[(4 + i, "s t u v " + x) for i, x in enumerate(twins(2048))]]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100, **{200 + k: 200 for k in range(30)}}


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, size=rng.integers(1, 400), dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, size=rng.integers(1, len(pool) + 1))) for _ in range(2))
        d = ngram_join.least_difference(ngram_join.bitmap(a), ngram_join.bitmap(b))
        common = len(np.intersect1d(a, b))
        assert d <= len(a) + len(b) - 2 * common
        if ngram_join.linked(common, len(a), len(b)):
            assert ngram_join.may_link(len(a), len(b), d)
