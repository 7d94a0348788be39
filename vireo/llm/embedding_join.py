"""Near-duplicate vectors by collision counting over sorted one-dimensional projections.

Unit vectors with cosine >= 0.98 are at most 0.2 apart, so their projections on a few orthonormal directions are
close. A label of more than ``CELL`` vectors is dealt to cells by several trees: each halves it on one random direction
after the other, at medians of the label's own vectors (in the first levels at those of each node), until a cell holds
about ``CELL``. A vector is in one cell of each tree. Depth and number of trees are chosen for each label, on a bounded
sample of it, so that a simulated pair at the threshold shares a cell with probability ``RECALL`` at the least number
of comparisons; where halving doesn't pay (few dimensions, a tight label), the label stays one cell.
Within a cell, each further projection of the residents is sorted,
each query's window around its own projection is looked up in it, and the windows' members are counted. Pairs
whose count passes are verified by their cosine in double precision. Window and count are calibrated by
simulation so that a pair at the threshold passes with probability ``RECALL``.

Every pair counts once: in the first tree that has both in one cell, by the cells that the rows carry. Equal vectors are one
node with a weight. A task returns link counts and a spanning forest of its links, never the pairs; a cell with
many residents is split into blocks, a task for each two of them.

Trees are fitted on a sample of at most ``SAMPLE`` vectors a label (fewer if long: ``SAMPLE_BYTES``); all vectors are
dealt and compared.

An empty table gives no rows; equal cosines and repeated vectors make no difference, as every pair is judged for itself.

Defined cases: a vector that is null, empty, zero or has null or non-finite components, and any with a null
label, links with nothing and is its own component; vectors of unequal length aren't compared; a null id is
ignored in minima; repeated rows link with each other; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, ensure_importable, materialize
from .graph import components

COSINE = 0.98
RECALL = 0.9999
PROJECTIONS = 16
CELL = 2000  # residents aimed at for a cell
MAX_SPLITS = 40  # halvings of a label: cells would hold CELL of 10^15 vectors
MAX_TREES = 40
OWN_LEVELS = 6  # levels of a tree with a median for each node; deeper ones have one for each node of this level
BROADCAST_LABELS = 100_000
BROADCAST_TREES = 64 << 20  # bytes of trees that executors hold; more are joined to the rows
BLOCK = 4096  # residents of a cell handled by one task
SAMPLE = 20_000
SAMPLE_BYTES = 32 << 20
SEED = 11


def counting(dim: int) -> int:
    """Number of projections that count: all directions if there are few."""
    return PROJECTIONS if dim >= 2 * PROJECTIONS else dim


@lru_cache(maxsize=8)
def directions(dim: int) -> np.ndarray:
    """The orthonormal columns that count."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, counting(dim))))[0]


@lru_cache(maxsize=4)
def tree_directions(dim: int) -> np.ndarray:
    """(tree, dim, level): random directions, orthonormal within a tree as far as there are dimensions."""
    rng = np.random.default_rng(SEED + 2)
    step = min(dim, MAX_SPLITS)
    trees = []
    for _ in range(MAX_TREES):
        runs = [np.linalg.qr(rng.standard_normal((dim, step)))[0] for _ in range(-(-MAX_SPLITS // step))]
        trees.append(np.concatenate(runs, axis=1)[:, :MAX_SPLITS])
    return np.stack(trees)


def calibrate(dim: int, cosine: float = COSINE) -> tuple[float, int]:
    """(window, least count) that a pair at the threshold keeps to with probability RECALL."""
    apart = np.sqrt(2 - 2 * cosine)
    rng = np.random.default_rng(SEED + 1)
    x = rng.standard_normal((200_000, counting(dim)))
    rest = rng.chisquare(dim - counting(dim), len(x)) if dim > counting(dim) else 0.0
    x *= apart / np.sqrt((x**2).sum(axis=1) + rest)[:, None]
    window = 2 * apart / np.sqrt(dim)
    counts = (np.abs(x) <= window).sum(axis=1)
    return float(window), int(np.quantile(counts, 1 - RECALL, method="lower"))


def _prepare(rows: DataFrame) -> DataFrame:
    """id, label, code, dim, vector (bytes of floats as doubles), code null if it links with nothing."""
    fields = {f.name: ddl(f.dataType) for f in rows.schema}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, dims, blobs = [], [], []
            for label, v in zip(b.column("label").to_pylist(), b.column("embedding")):
                x = None
                if label is not None and v.is_valid and len(v.values) and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                blob = x.tobytes() if x is not None else None
                blobs.append(blob)
                dims.append(len(x) if x is not None else None)
                codes.append(xxhash.xxh3_64_intdigest(repr(label).encode() + b"|" + blob) - (1 << 63) if blob else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(codes, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], names=["id", "label", "code", "dim", "vector"])

    return rows.mapInArrow(apply, f"id {fields['id']}, label {fields['label']}, code long, dim int, vector binary")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """(row, tree): the cell of each unit vector in each tree; bit j is its side at level j."""
    cells = np.zeros((len(x), len(thresholds)), dtype=np.int64)
    for t, levels in enumerate(thresholds):
        projected = x @ tree_directions(x.shape[1])[t][:, : len(levels)]
        for j, at_node in enumerate(levels):
            cells[:, t] |= (projected[:, j] > at_node[cells[:, t] & (len(at_node) - 1)]).astype(np.int64) << j
    return cells


def fit_medians(x: np.ndarray, trees: int, levels: int) -> np.ndarray:
    """(tree, level, node) -> median of the sample's vectors at that node."""
    own = max(0, min(OWN_LEVELS, levels - 1, int(np.log2(max(1, len(x) / 256)))))
    out = np.zeros((trees, levels, 1 << own))
    for t in range(trees):
        projected = x @ tree_directions(x.shape[1])[t][:, :levels]
        cell = np.zeros(len(x), dtype=np.int64)
        for j in range(levels):
            node, p = cell & ((1 << own) - 1), projected[:, j]
            n = np.bincount(node, minlength=1 << own)
            middle = np.cumsum(n) - n + n // 2
            out[t, j] = np.where(n > 0, p[np.lexsort((p, node))][np.minimum(middle, len(x) - 1)], np.median(p))
            cell |= (p > out[t, j][node]).astype(np.int64) << j
    return out


def neighbours(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector a random one at this cosine."""
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * x + np.sqrt(1 - cosine**2) * side


def fit_trees(x: np.ndarray, n: int, cosine: float = COSINE) -> np.ndarray:
    """Thresholds (tree, level, node) for a label of ``n`` unit vectors of which ``x`` is a sample; no level: one cell.

    Of all depths the one with the fewest comparisons, each with as many trees as a pair at the threshold needs to
    share a cell with probability RECALL.
    """
    wanted = min(MAX_SPLITS, int(np.ceil(np.log2(max(1.0, n / CELL)))))
    if wanted < 1 or len(x) < 2 or x.shape[1] < 2:
        return np.zeros((1, 0, 1))
    thresholds = fit_medians(x, MAX_TREES, wanted)
    rng = np.random.default_rng(SEED + 3)
    home = cells_of(x, thresholds)
    apart = np.concatenate([home ^ cells_of(neighbours(x, cosine, rng), thresholds) for _ in range(-(-SAMPLE // len(x)))])
    best, cost = np.zeros((1, 0, 1)), 1.0
    for k in range(1, wanted + 1):
        missed = np.ones(len(apart), dtype=bool)
        for t in range(MAX_TREES):
            missed &= (apart[:, t] & ((1 << k) - 1)) != 0
            if missed.mean() <= 1 - RECALL:
                sizes = np.unique(home[:, t] & ((1 << k) - 1), return_counts=True)[1]
                together = (sizes * (sizes - 1)).sum() / (len(x) * (len(x) - 1))
                found = (t + 1) * max(0.5**k, float(together))
                if found < cost:
                    best, cost = thresholds[: t + 1, :k], found
                break
    return best


TREES = "trees int, levels int, nodes int, thresholds binary"


def _fit(sample: DataFrame, cosine: float) -> DataFrame:
    """(label, dim, trees, levels, nodes, thresholds) for each label of a sample (label, dim, n, vector)."""
    label_type = ddl(sample.schema["label"].dataType)

    def apply(t: pa.Table) -> pa.Table:
        dim = t.column("dim")[0].as_py()
        x = unit(np.frombuffer(b"".join(t.column("vector").to_pylist()), dtype=np.float64).reshape(-1, dim))
        found = np.ascontiguousarray(fit_trees(x, t.column("n")[0].as_py(), cosine))
        made = [pa.array([v], pa.int32()) for v in found.shape] + [pa.array([found.tobytes()], pa.binary())]
        return pa.Table.from_arrays([t.column("label")[:1], t.column("dim")[:1], *made], names=["label", "dim", "trees", "levels", "nodes", "thresholds"])

    return sample.select("label", "dim", "n", "vector").groupBy("label", "dim").applyInArrow(apply, f"label {label_type}, dim int, {TREES}")


def _deal(nodes: DataFrame, held, with_vector: bool = True) -> DataFrame:
    """(label, dim, tree, cell [, code, weight, vector, cells]): each vector in one cell of each tree of its label.

    ``held`` is a broadcast of thresholds by model; without it they are columns of the rows.
    """
    label_type = ddl(nodes.schema["label"].dataType)
    names = ["label", "dim", "tree", "cell"] + ["code", "weight", "vector", "cells"] * with_vector
    no_tree = np.zeros((1, 0, 1))

    def trees_of(part: pa.RecordBatch) -> np.ndarray:
        model = part.column("model")[0].as_py()
        if model is None:
            return no_tree
        if held is not None:
            return held.value[model]
        shape = [part.column(c)[0].as_py() for c in ("trees", "levels", "nodes")]
        return np.frombuffer(part.column("thresholds")[0].as_py()).reshape(shape)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            model, dims = b.column("model").fill_null(-1).to_numpy(), b.column("dim").to_numpy()
            for m, dim in np.unique(np.stack([model, dims]), axis=1).T.tolist():
                at = np.flatnonzero((model == m) & (dims == dim))
                thresholds = trees_of(b.slice(int(at[0]), 1))
                step = max(1, (16 << 20) // (8 * dim * len(thresholds)))
                for s in range(0, len(at), step):
                    part = b.take(pa.array(at[s : s + step]))
                    if thresholds.shape[1]:
                        cells = cells_of(unit(np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=np.float64).reshape(part.num_rows, dim)), thresholds)
                    else:
                        cells = np.zeros((part.num_rows, 1), dtype=np.int64)
                    out = part.take(pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1])))
                    tree = np.tile(np.arange(cells.shape[1], dtype=np.int32), part.num_rows)
                    columns = [out.column("label"), out.column("dim"), pa.array(tree), pa.array(cells.ravel())]
                    if with_vector:
                        rows = pa.array([c.tobytes() for c in cells], pa.binary()).take(pa.array(np.repeat(np.arange(part.num_rows), cells.shape[1])))
                        columns += [out.column("code"), out.column("weight"), out.column("vector"), rows]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"label {label_type}, dim int, tree int, cell long" + ", code long, weight long, vector binary, cells binary" * with_vector
    return nodes.mapInArrow(apply, schema)


def links_between(x: np.ndarray, y: np.ndarray, window: float, least: int, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers (i, j) of linked rows of x and y (same: of x alone, i < j)."""
    cols = directions(x.shape[1])
    px, py = x @ cols, y @ cols
    orders = [np.argsort(py[:, j], kind="stable") for j in range(py.shape[1])]
    lists = [py[o, j] for j, o in enumerate(orders)]
    step = max(1, 1_000_000 // max(1, len(y)))
    for s in range(0, len(x), step):
        e = min(s + step, len(x))
        counts = np.zeros((e - s) * len(y), dtype=np.int32)
        for j, (order, values) in enumerate(zip(orders, lists)):
            lo = np.searchsorted(values, px[s:e, j] - window, side="left")
            hi = np.searchsorted(values, px[s:e, j] + window, side="right")
            n = hi - lo
            row = np.repeat(np.arange(e - s), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            counts += np.bincount(row * len(y) + order[place], minlength=len(counts)).astype(np.int32)
        i, j = np.divmod(np.flatnonzero(counts >= least), len(y))
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        for a in range(0, len(i), 50_000):
            p, q = i[a : a + 50_000], j[a : a + 50_000]
            good = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
            if good.any():
                yield p[good], q[good]


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least number that each of n nodes reaches."""
    label = np.arange(n)
    if not pairs:
        return label
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def _compare(table: pa.Table, settings: dict[int, tuple[float, int]], cosine: float) -> pa.Table:
    """kind 0: (code, links found), kind 1: (code, code) of a spanning forest."""
    dim = table.column("dim")[0].as_py()
    window, least = settings[dim]
    side = table.column("side").to_numpy()
    code, weight = table.column("code").to_numpy(), table.column("weight").to_numpy()
    x = unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype=np.float64).reshape(-1, dim))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    links = np.zeros(len(x), dtype=np.int64)
    tree = table.column("tree")[0].as_py()
    earlier = np.frombuffer(b"".join(table.column("cells").to_pylist()), dtype=np.int64).reshape(len(x), -1)[:, :tree]
    # side 0: residents of a block; 1: those of another block
    r, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    whole = not table.column("across")[0].as_py()
    for left, right, same in [(r, r, True)] * whole + [(v, r, False)]:
        if len(left) and len(right):
            for i, j in links_between(x[left], x[right], window, least, cosine, same):
                i, j = left[i], right[j]
                if tree:
                    new = ~(earlier[i] == earlier[j]).any(axis=1)
                    i, j = i[new], j[new]
                found.append((i, j))
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
    root = _forest(len(x), found)
    some, edge = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(x)))
    return pa.table({"kind": pa.array(np.repeat([0, 1], [len(some), len(edge)]).astype(np.int32)), "a": pa.array(np.concatenate([code[some], code[edge]])), "b": pa.array(np.concatenate([links[some], code[root[edge]]]))})


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = vectors.sparkSession
    ensure_importable(spark)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").alias("embedding"))
    prepared = materialize(_prepare(rows), "vectors")
    valid = prepared.filter("code IS NOT NULL")
    nodes = materialize(valid.groupBy("code").agg(F.count("*").alias("weight"), F.min("id").alias("least"), F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("vector").alias("vector")), "vector-nodes")
    sizes = materialize(nodes.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > CELL).withColumnsRenamed({"label": "of_label", "dim": "of_dim"}), "vector-sizes")
    of_label = (F.col("label") == F.col("of_label")) & (F.col("dim") == F.col("of_dim"))
    labels = sizes.count()
    held, models = None, None
    if labels:
        few = F.greatest(F.lit(1000), F.least(F.lit(SAMPLE), F.floor(F.lit(SAMPLE_BYTES) / (8 * F.col("dim")))))
        drawn = F.pmod(F.xxhash64("code", F.lit(SEED)), F.lit(1 << 30)) < few / F.col("n") * (1 << 30)
        sample = nodes.join(F.broadcast(sizes) if labels <= BROADCAST_LABELS else sizes, of_label).filter(drawn)
        fitted = _fit(sample, cosine).filter("levels > 0").withColumnsRenamed({"label": "of_label", "dim": "of_dim"})
        models = materialize(fitted.withColumn("model", F.monotonically_increasing_id()), "vector-trees")
        size, labels = models.agg(F.coalesce(F.sum(F.octet_length("thresholds")), F.lit(0)), F.count("*")).first()
        if size <= BROADCAST_TREES:
            table = {r["model"]: np.frombuffer(r["thresholds"]).reshape(r["trees"], r["levels"], r["nodes"]) for r in models.drop("of_label").collect()}
            held = spark.sparkContext.broadcast(table)
            light = models.select("of_label", "of_dim", "model")
            placed = nodes.join(F.broadcast(light) if labels <= BROADCAST_LABELS else light, of_label, "left").drop("of_label", "of_dim")
        else:
            placed = nodes.join(models, of_label, "left").drop("of_label", "of_dim")
    else:
        placed = nodes.withColumn("model", F.lit(None).cast("long"))
    columns = ["label", "dim", "model", "code", "weight", "vector"] + ["trees", "levels", "nodes", "thresholds"] * (models is not None and held is None)
    placed = placed.select(*columns)
    dims = [r["dim"] for r in nodes.select("dim").distinct().collect()]
    settings = {dim: calibrate(dim, cosine) for dim in dims}
    cell = ["label", "dim", "tree", "cell"]
    # cells are computed twice, so that no table of all vectors in all trees is written
    per_cell = materialize(_deal(placed, held, with_vector=False).groupBy(*cell).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "vector-cells")
    full = per_cell.filter("blocks > 1").withColumnsRenamed({c: f"_{c}" for c in cell})
    full = F.broadcast(full) if full.count() <= BROADCAST_LABELS else full
    dealt = _deal(placed, held).join(full, [F.col(c) == F.col(f"_{c}") for c in cell], "left").drop(*[f"_{c}" for c in cell]).withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    # residents: (own, j) for all j; the lesser block is side 0
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(j, own).alias("i"), F.greatest(j, own).alias("j"), F.when(own <= j, 0).otherwise(1).alias("side")))
    dealt = dealt.withColumn("task", F.explode(tasks)).select(*cell, "task.*", "code", "weight", "vector", "cells").withColumn("across", F.col("i") != F.col("j"))
    out = materialize(dealt.groupBy(*cell, "i", "j").applyInArrow(lambda t: _compare(t, settings, cosine), "kind int, a long, b long"), "vector-links")
    links = out.filter("kind = 0").groupBy(F.col("a").alias("code")).agg(F.sum("b").alias("links"))
    comps = materialize(components(out.filter("kind = 1").select("a", "b")), "vector-components")
    by_code = nodes.select("code", "weight", "least").join(links, "code", "left").join(comps, F.col("code") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "code"))
    roots = by_code.groupBy("comp").agg(F.min("least").alias("component_id"))
    by_code = by_code.join(roots, "comp").select("code", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    joined = prepared.select("id", "code").join(by_code, "code", "left")
    component = F.when(F.col("code").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CASE WHEN label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings
), links AS (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.r)::BIGINT AS n_links, component_id,
  v.vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least ON least.a = v.r
"""
