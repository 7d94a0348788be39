"""Colour layout descriptor: 33 small integers of an RGB frame, in Arrow batches with NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

GRID = 8
# Fixed values of the descriptor: luma weights, scales, piecewise quantisers as (above, base, right shift).
LUMA = (0.299, 0.587, 0.114)
Y_DC = ((192, 112, 2), (160, 96, 1), (96, 32, 0), (64, 16, 1))
C_DC = ((191, 63, 63), (160, 56, 2), (144, 48, 1), (112, 16, 0), (96, 8, 1), (64, 0, 2))
Y_TERMS, C_TERMS = 21, 6


def _cosines() -> np.ndarray:
    """Orthonormal DCT-II matrix, to seven digits."""
    k, n = np.meshgrid(np.arange(GRID), np.arange(GRID), indexing="ij")
    m = np.cos((2 * n + 1) * k * np.pi / (2 * GRID)) * np.where(k == 0, np.sqrt(1 / GRID), np.sqrt(2 / GRID))
    return np.array([float(f"{x:.6e}") for x in m.ravel()]).reshape(GRID, GRID)


def _zigzag() -> np.ndarray:
    """Cells by anti-diagonals, in alternating direction."""
    cells = sorted(((r, c) for r in range(GRID) for c in range(GRID)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * GRID + c for r, c in cells])


COSINES, ZIGZAG = _cosines(), _zigzag()


def _dct(shape: np.ndarray) -> np.ndarray:
    rows = np.zeros((GRID, GRID))
    for k in range(GRID):
        rows += np.outer(shape[:, k], COSINES[:, k])
    rows = rows.astype(np.float32).astype(np.float64)
    out = np.zeros((GRID, GRID))
    for k in range(GRID):
        out += np.outer(COSINES[:, k], rows[k])
    return np.floor(out + 0.499999).astype(np.int16).astype(np.int64)


def _steps(x: int, table: tuple[tuple[int, int, int], ...]) -> int | None:
    for above, base, shift in table:
        if x > above:
            return base + ((x - above) >> shift)
    return None


def _ac(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -256, 255)
    size = np.abs(x)
    size = np.select([size > 127, size > 63], [64 + (size >> 2), 32 + (size >> 1)], size)
    return np.where(x < 0, -size, size) + 128


def colour_layout(data: bytes, width: int, height: int) -> list[int]:
    image = np.frombuffer(data, dtype=np.uint8, count=3 * width * height).reshape(height, width, 3).astype(np.float64)
    xs, ys = (np.ceil(np.arange(GRID + 1) * n / GRID).astype(int) for n in (width, height))
    prefix = np.zeros((height + 1, width + 1, 3))
    prefix[1:, 1:] = image.cumsum(0).cumsum(1)
    sums = np.diff(np.diff(prefix[ys][:, xs], axis=0), axis=1)
    count = np.outer(np.diff(ys), np.diff(xs))
    inverse = np.divide(1.0, count * 256.0, out=np.zeros(count.shape), where=count > 0)
    r, g, b = np.moveaxis(sums * inverse[..., None], -1, 0)
    luma = LUMA[0] * r + LUMA[1] * g + LUMA[2] * b
    planes = [np.floor(219 * luma + 16.5), np.floor(126.336 * (b - luma) + 128.5), np.floor(159.712 * (r - luma) + 128.5)]
    y, cb, cr = (_dct(np.where(count > 0, p, 0.0)).ravel() for p in planes)
    dc_y = _steps(int(y[0]) >> 3, Y_DC)
    out = [(dc_y if dc_y is not None else int(y[0]) >> 3 >> 2) >> 1, *(_ac(y[ZIGZAG[1:Y_TERMS]] >> 1) >> 3).tolist()]
    for c in (cb, cr):
        out += [_steps(int(c[0]) >> 3, C_DC) or 0, *(_ac(c[ZIGZAG[1:C_TERMS]]) >> 3).tolist()]
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def colour_layout_udf(data: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or len(d) < 3 * w * h else colour_layout(d, int(w), int(h)) for d, w, h in zip(data, width, height)])


def crop_decision(width: Column, height: Column, new_width: Column, new_height: Column) -> Column:
    """What border removal does: crop near 16:9 and 4:3; crop and letterbox near 21:9 after a clear loss; else keep."""
    ratio = new_width / new_height
    near = lambda target, off: F.abs(ratio - target) < off
    shrunk = ((width - new_width) / width > 0.05) | ((height - new_height) / height > 0.05)
    return F.when(near(16 / 9, 0.05) | near(4 / 3, 0.05), "crop").when(near(21 / 9, 0.1) & shrunk, "letterbox").otherwise("keep")
