import numpy as np
import pytest

from vireo.llm import embedding_join as E


def brute(rows):
    ok = []
    for _, v, label in rows:
        good = v is not None and label is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, dtype=np.float32).astype(np.float64) if good else None)
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] is not None and ok[j] is not None and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted([(d, links[i], least.get(find(i)), d == least.get(find(i))) for i, (d, _, _) in enumerate(rows)], key=str)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        if i and rng.random() < 0.5:
            v = np.array(out[rng.integers(len(out))][1]) + rng.normal(size=dim) * rng.choice([0.0, 0.01, 0.02, 0.03])
            v = v * rng.choice([1.0, 2.0])
        else:
            v = rng.normal(size=dim) / np.sqrt(dim)
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, kept string, code int").repartition(3)
    return sorted([tuple(r) for r in E.near_duplicates(df).collect()], key=str)


def test_against_brute_force(spark):
    rows = vectors(300, 64, 1)
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * 64, 1), (403, [float("nan")] + [1.0] * 63, 1), (404, [None] + [1.0] * 63, 1), (405, [float("inf")] * 64, 1), (406, rows[5][1], None), (407, [1.0] * 8, 1), (408, [1.0] * 8, 1), (None, rows[6][1], rows[6][2]), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2])]
    assert run(spark, rows) == brute(rows)


def test_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 20)
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    base /= np.linalg.norm(base)
    rows = vectors(300, 64, 2) + [(1000 + i, [float(np.float32(x)) for x in base + rng.normal(size=64) * 0.012], 1) for i in range(120)]
    got, want = run(spark, rows), brute(rows)
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g == w for g, w in zip(got, want)) >= 0.98 * len(want)


@pytest.mark.parametrize("dim", [4, 16, 64])
def test_recall_of_a_pair_at_the_threshold(dim):
    rng = np.random.default_rng(5)
    window, least = E.calibrate(dim)
    x = rng.normal(size=(2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * side
    found = sum(len(list(E.links_between(x[i : i + 1], y[i : i + 1], window, least, 0.98, False))) for i in range(len(x)))
    assert found >= 0.99 * len(x)


def around(centre_share, n, dim, seed):
    """Unit vectors around one centre, with this cosine between each two of them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x *= np.sqrt(1 - centre_share) / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] += np.sqrt(centre_share)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("share", [0.0, 0.8])
def test_cells_of_a_label(share):
    """Cells of 200 000 vectors are near the size aimed at, few for each vector, and pairs at the threshold meet."""
    x = around(share, 200_000, 64, 7)
    thresholds = E.fit_trees(x[:20_000], len(x))
    trees, levels, _ = thresholds.shape
    cells = E.cells_of(x, thresholds)
    fullest = max(np.bincount(cells[:, t]).max() for t in range(trees))
    assert levels >= 1 and trees <= E.MAX_TREES and fullest <= 3 * len(x) / 2**levels
    if share == 0.0:
        assert fullest <= 3 * E.CELL and trees <= 15
    y = E.neighbours(x[50_000:60_000], 0.9801, np.random.default_rng(8))
    assert (cells[50_000:60_000] == E.cells_of(y, thresholds)).any(axis=1).mean() >= 0.999


def test_trees_of_degenerate_samples():
    same = np.ones((500, 8)) / np.sqrt(8)
    assert E.cells_of(same, E.fit_trees(same, 10_000_000)).shape[0] == 500
    assert E.fit_trees(np.ones((500, 1)), 10_000_000).shape[1] == 0
    assert E.fit_trees(np.empty((0, 8)), 10_000_000).shape[1] == 0


def test_trees_joined_to_the_rows(spark, monkeypatch):
    """Trees beyond what is broadcast give the same rows."""
    monkeypatch.setattr(E, "CELL", 20)
    rows = vectors(200, 64, 6)
    held = run(spark, rows)
    monkeypatch.setattr(E, "BROADCAST_TREES", -1)
    assert run(spark, rows) == held


def test_many_halvings(spark, monkeypatch):
    """A label with far more vectors than a cell holds is halved on more directions than ten."""
    monkeypatch.setattr(E, "CELL", 0.2)
    rows = vectors(250, 64, 4)
    assert np.ceil(np.log2(sum(r[2] == 0 for r in rows) / 3 / 0.2)) > 6
    got, want = run(spark, rows), brute(rows)
    assert sum(g == w for g, w in zip(got, want)) >= 0.98 * len(want)


def test_empty_table(spark):
    assert run(spark, []) == []
