"""Fixed-size summaries of a whole column, built in every task and combined by chunks in two steps."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = 16
SALTS = 64
BLOOM_BITS = (20, 27)


def chunk_rows(summary: np.ndarray, salt: int) -> list[tuple[int, int, bytes]]:
    return [(k, salt % SALTS, zlib.compress(part.tobytes(), 1)) for k, part in enumerate(np.split(summary, CHUNKS))]


def combine(parts: DataFrame, dtype: str, how: Callable, finish: Callable = lambda x: x) -> np.ndarray:
    """(chunk, salt, blob) of every task -> the one summary, whose size is fixed; ``finish`` is applied to each whole chunk."""

    def fold(last: bool) -> Callable:
        def apply(pdf: pd.DataFrame) -> pd.DataFrame:
            total = None
            for blob in pdf["blob"]:
                x = np.frombuffer(zlib.decompress(blob), dtype=dtype)
                total = x.copy() if total is None else how(total, x)
            return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "blob": [zlib.compress((finish(total) if last else total).tobytes(), 1)]})

        return apply

    some = parts.groupBy("chunk", "salt").applyInPandas(fold(False), "chunk int, blob binary")
    got = some.groupBy("chunk").applyInPandas(fold(True), "chunk int, blob binary").collect()
    if not got:
        return finish(np.zeros(0, dtype=dtype))
    kind = finish(np.zeros(0, dtype=dtype)).dtype
    return np.concatenate([np.frombuffer(zlib.decompress(r["blob"]), dtype=kind) for r in sorted(got, key=lambda r: r["chunk"])])


def bloom_places(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = codes.view(np.uint64)
    with np.errstate(over="ignore"):
        return tuple(((u * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def bloom_filter(codes: DataFrame) -> np.ndarray:
    """Packed bits of a one-column table of longs: 16 bits for each, within BLOOM_BITS (16 MiB to broadcast at most).

    A fuller filter lets more pass, never less, so beyond the bound results stay and only more is moved.
    """
    low, high = BLOOM_BITS
    bits = min(high, max(low, (16 * codes.count()).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(1 << (bits - 3), dtype=np.uint8)
        salt = 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for at in bloom_places(x, bits):
                np.bitwise_or.at(packed, at >> 3, (1 << (at & 7)).astype(np.uint8))
            salt = int(x[0]) if len(x) else salt
        rows = chunk_rows(packed, abs(salt))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["chunk", "salt", "blob"])

    return combine(codes.mapInArrow(build, "chunk int, salt int, blob binary"), "uint8", np.bitwise_or)


def in_bloom(packed: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if len(packed) == 0:
        return np.zeros(len(codes), dtype=bool)
    found = np.ones(len(codes), dtype=bool)
    for at in bloom_places(codes, (8 * len(packed)).bit_length() - 1):
        found &= (packed[at >> 3] >> (at & 7)) & 1 > 0
    return found
