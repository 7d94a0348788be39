"""The nearest rows of each query, by cells: a cell is a block of queries against a group of rows, compared in one task.

Rows are dealt to groups and queries to blocks, each of bounded size, so that a task holds a bounded part of either
whatever the size of both. A task compares stretches of rows with all its queries as matrices and keeps each query's
nearest; what is farther than a query's worst so far is dropped at once, so at most ``k`` rows of a query leave a cell.
Rows that are compared with many blocks travel as packs: some thousand of them as one Arrow stream in one binary value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1024  # queries of a cell
NUMBERS = 1 << 24  # components of the rows of a cell
CELLS = 48  # cells that a search is dealt to where there is work for them
PAIRS = 1_000_000  # that are worth a cell
STRETCH = 4096  # rows that are compared with all queries of a cell at once, and of a pack at most
PACK = 1 << 20  # components of the rows of a pack
HELD = 1 << 20  # rows that a task holds before it lets go of those that are no query's nearest


def shape_of(queries: int, rows: int, length: int, block: int = BLOCK) -> tuple[int, int]:
    """How many blocks of queries and groups of rows there are."""
    groups = max(1, -(-rows * max(1, length) // NUMBERS))
    wanted = min(CELLS, max(1, queries * rows // PAIRS))
    blocks = max(1, -(-queries // block), min(-(-queries // 16), -(-wanted // groups)))
    return blocks, max(groups, min(-(-rows // STRETCH), -(-wanted // blocks)))


class Nearest:
    """The k least scores of each query and where they stand; of equal ones those that came first, NaN last."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.worst = np.full(queries, np.nan)  # nothing is as far as NaN: all that comes is taken
        self.scores = [np.empty(0)] * queries
        self.places = [np.empty(0, np.int64)] * queries
        self.waiting: list[list] = [[] for _ in range(queries)]
        self.waits = np.zeros(queries, np.int64)

    def add(self, scores: np.ndarray, of: np.ndarray, first: int) -> None:
        """Scores (queries, rows) of the queries numbered ``of`` and of the rows from ``first`` on."""
        near = ~(scores >= self.worst[of][:, None].astype(scores.dtype))
        for i, q in enumerate(of):
            at = np.flatnonzero(near[i])
            if len(at):
                self.waiting[q].append((scores[i, at], at + first))
                self.waits[q] += len(at)
                if self.waits[q] >= self.k:
                    self._settle(q)

    def _settle(self, q: int) -> None:
        score = np.concatenate([self.scores[q], *[s for s, _ in self.waiting[q]]])
        place = np.concatenate([self.places[q], *[p for _, p in self.waiting[q]]])
        self.waiting[q], self.waits[q] = [], 0
        if len(score) > 2 * self.k:
            some = np.flatnonzero(~(score > np.partition(score, self.k - 1)[self.k - 1]))
            score, place = score[some], place[some]
        order = np.argsort(score, kind="stable")[: self.k]
        self.scores[q], self.places[q] = score[order], place[order]
        if len(order) == self.k:
            self.worst[q] = score[order[-1]]

    def of(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of a query, nearest first."""
        if self.waiting[q]:
            self._settle(q)
        return self.scores[q], self.places[q]


def expanded(x: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Rows as ``times`` takes them: a distance is one product of matrices."""
    return np.concatenate([x, (x * x).sum(1, keepdims=True), np.ones((len(x), 1))], axis=1).astype(kind)


def expanded_queries(q: np.ndarray, kind: type = np.float64) -> np.ndarray:
    return np.concatenate([-2 * q, np.ones((len(q), 1)), (q * q).sum(1, keepdims=True)], axis=1).astype(kind)


def exact_distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(queries, rows) squared distances, summed component by component in order."""
    total = np.zeros((len(q), len(x)))
    for i in range(x.shape[1]):
        d = (x[None, :, i] - q[:, i, None]).astype(np.float64)
        total += d * d
    return total


def matrices(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length; null vectors and those with a null component are left out."""
    lists = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    end = np.cumsum(np.maximum(size, 0))
    start = end - np.maximum(size, 0)
    whole = size >= 0
    if flat.null_count:
        nulls = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        whole &= nulls[end] == nulls[start]
        flat = flat.fill_null(0)
    values = flat.to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(size[whole]):
        rows = np.flatnonzero(whole & (size == n))
        out[int(n)] = rows, values[start[rows][:, None] + np.arange(n)] if len(rows) < len(size) else values.reshape(len(rows), n)
    return out


class Compared:
    """Scores of some queries, all of one length. Whole numbers are compared as products of matrices as long as that is exact."""

    def __init__(self, q: np.ndarray, whole: bool):
        self.whole, self.most = whole, self._most(q) if whole else 0.0
        self.q = q.astype(np.float64) if whole else q
        self.ready: dict[type, np.ndarray] = {}

    @staticmethod
    def _most(m: np.ndarray) -> float:
        return float(np.abs(m.astype(np.float64)).max()) if m.size else 0.0

    def stretches(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The number of the first row of each stretch of x, and scores (queries, rows)."""
        bound = 4 * max(self.most, self._most(x)) ** 2 * x.shape[1] if self.whole else np.inf
        kind = np.float32 if bound < 2**24 else np.float64
        if bound < 2**53 and kind not in self.ready:
            self.ready[kind] = expanded_queries(self.q, kind)
        for at in range(0, len(x), STRETCH):
            some = x[at : at + STRETCH]
            some = some.astype(np.float64) if self.whole else some
            yield at, self.ready[kind] @ expanded(some, kind).T if bound < 2**53 else exact_distances(some, self.q)


def nearest_of_cell(x: np.ndarray, q: np.ndarray, k: int, whole: bool) -> Nearest:
    """x, q: rows and queries of one length."""
    found, of = Nearest(len(q), k), np.arange(len(q))
    for at, scores in Compared(q, whole).stretches(x):
        found.add(scores, of, at)
    return found


class Stream:
    """The nearest of rows that come part by part, in the order that decides between equal scores.

    Of what came it holds, beside the last ``HELD`` rows or as many as stayed before, only the rows that are nearest to a query.
    """

    def __init__(self, q: np.ndarray, k: int, whole: bool):
        self.compared, self.found, self.of = Compared(q, whole), Nearest(len(q), k), np.arange(len(q))
        self.parts: list[pa.Table] = []
        self.held = self.stayed = 0

    def add(self, x: np.ndarray, rows: pa.Table) -> None:
        """The vectors of rows, and what is to be known of them."""
        for at, scores in self.compared.stretches(x):
            self.found.add(scores, self.of, self.held + at)
        self.parts.append(rows)
        self.held += len(x)
        if self.held > self.stayed + max(HELD, self.stayed):
            self._let_go()

    def _let_go(self) -> None:
        places = [self.found.of(q)[1] for q in self.of]
        stay = np.unique(np.concatenate(places))
        self.parts = [pa.concat_tables(self.parts).take(pa.array(stay)).combine_chunks()]
        self.found.places = [np.searchsorted(stay, p) for p in places]
        self.held = self.stayed = len(stay)

    def nearest(self) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        """Numbers of queries, scores, and rows; each query's nearest first."""
        near = [self.found.of(q) for q in self.of]
        rows = pa.concat_tables(self.parts).take(pa.array(np.concatenate([p for _, p in near])))
        return np.repeat(self.of, [len(p) for _, p in near]), np.concatenate([s for s, _ in near]).astype(np.float64), rows


def packer(vector: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows to packs (number, pack), numbered in the order of partitions and rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for b in batches:
            longest = pc.max(pc.list_value_length(b.column(vector))).as_py() if b.num_rows else None
            size = max(1, min(STRETCH, PACK // max(1, longest or 1)))
            for at in range(0, b.num_rows, size):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(b.slice(at, size))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["number", "pack"])
                number += 1

    return pack


def unpacked(pack: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(pack.as_buffer()).read_all()


def in_order(ids: pa.ChunkedArray) -> np.ndarray:
    """Places of rows in the order of their ids, null first."""
    return pc.sort_indices(ids, null_placement="at_start").to_numpy()
