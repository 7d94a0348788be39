"""Preparing images for a search: fit, cut dark borders, letterbox; raw RGB rasters in Arrow batches.

Images of one size are worked on together. Resampling takes exact means of areas, in whole numbers, from running sums; it isn't
that of an imaging library, so rasters differ slightly from what one would give, and enlarged images keep their blocks.

An image is fitted inside of 320 x 320. If borders are to be cut, its brightness is stretched (1 % of the pixels at either end
saturate), each pixel takes the darkest values around it, so that small bright marks in a border go, and the box of what is left
above the threshold is the area without borders. Near 16:9 and 4:3 the box is cut out; near 21:9, if it is clearly smaller than the
image, it is cut out and fitted into 320 x 180 on black; else the image stays as it is. So does an image that is dark all over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

FIT = 320
LETTERBOX = (320, 180)
THRESHOLD, AROUND = 30, 2
BATCH_PIXELS = 1 << 22


def _sums(x: np.ndarray, size: int, axis: int) -> np.ndarray:
    """``size`` sums of equal stretches along an axis, times ``size``; whole numbers even where a stretch ends inside a pixel."""
    n = x.shape[axis]
    if n == size:
        return x * size
    ends = np.arange(size + 1) * n
    low, part = ends // size, ends % size
    running = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis)], axis)
    shape = [1] * x.ndim
    shape[axis] = size + 1
    at = np.take(running, low, axis) * size + np.take(x, np.minimum(low, n - 1), axis) * part.reshape(shape)
    return np.diff(at, axis=axis)


def area_resize(images: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means of areas of images (n, h, w, 3), halves rounded up."""
    h, w = images.shape[1:3]
    if (w, h) == (width, height):
        return images
    total = _sums(_sums(images.astype(np.int64), height, 1), width, 2)
    return ((2 * total + h * w) // (2 * h * w)).astype(np.uint8)


def fitted(width: int, height: int, most_width: int, most_height: int) -> tuple[int, int]:
    """The largest size of this shape within limits."""
    if width * most_height >= height * most_width:
        return most_width, max(1, (2 * height * most_width + width) // (2 * width))
    return max(1, (2 * width * most_height + height) // (2 * height)), most_height


def _darkest(x: np.ndarray, axis: int) -> np.ndarray:
    n = x.shape[axis]
    pad = [(0, 0)] * x.ndim
    pad[axis] = (AROUND, AROUND)
    x = np.moveaxis(np.pad(x, pad, mode="edge"), axis, 0)
    out = np.minimum(x[:n], x[2 * AROUND :])
    for i in range(1, 2 * AROUND):
        np.minimum(out, x[i : i + n], out=out)
    return np.moveaxis(out, 0, axis)


def lit_boxes(images: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(left, top, width, height) of the area without dark borders of each image."""
    n, h, w = images.shape[:3]
    # ranks of brightness from counts of its 256 values
    cut = (h * w - 1) // 100
    low, high = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, image in enumerate(images):
        luma = image[..., 0] * np.uint32(299)
        luma += image[..., 1] * np.uint32(587)
        luma += image[..., 2] * np.uint32(114)
        upto = np.cumsum(np.bincount((luma // np.uint32(1000)).ravel(), minlength=256))
        low[k], high[k] = np.searchsorted(upto, [cut, h * w - 1 - cut], side="right")
    # (x - low) * 255 / (high - low) > THRESHOLD, where there is anything to stretch
    flat = high == low
    above = np.where(flat, THRESHOLD * 255, 255 * low + THRESHOLD * (high - low))
    dark = _darkest(_darkest(images, 1), 2)
    lit = np.maximum(np.maximum(dark[..., 0], dark[..., 1]), dark[..., 2]) > (above // 255).astype(np.uint8)[:, None, None]
    boxes = []
    for rows, cols in zip(lit.any(2), lit.any(1)):
        if rows.any():
            top, left = int(rows.argmax()), int(cols.argmax())
            boxes.append((left, top, w - int(cols[::-1].argmax()) - left, h - int(rows[::-1].argmax()) - top))
        else:
            boxes.append((0, 0, w, h))
    return boxes


def decide(width: int, height: int, new_width: int, new_height: int) -> str:
    """The rule of ``descriptor.crop_decision``."""
    ratio = new_width / new_height
    if abs(ratio - 16 / 9) < 0.05 or abs(ratio - 4 / 3) < 0.05:
        return "crop"
    shrunk = (width - new_width) / width > 0.05 or (height - new_height) / height > 0.05
    return "letterbox" if abs(ratio - 21 / 9) < 0.1 and shrunk else "keep"


def without_borders(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    left, top, w, h = box
    what = decide(image.shape[1], image.shape[0], w, h)
    if what == "keep":
        return image
    inner = image[top : top + h, left : left + w]
    if what == "crop":
        return inner
    out = np.zeros((LETTERBOX[1], LETTERBOX[0], 3), np.uint8)
    new_w, new_h = fitted(w, h, *LETTERBOX)
    x, y = (LETTERBOX[0] - new_w) // 2, (LETTERBOX[1] - new_h) // 2
    out[y : y + new_h, x : x + new_w] = area_resize(inner[None], new_w, new_h)[0]
    return out


def prepare(images: np.ndarray, cut_borders: np.ndarray) -> list[np.ndarray]:
    """Images (n, h, w, 3) of one size, prepared; which of them lose their borders."""
    h, w = images.shape[1:3]
    out = list(area_resize(images, *fitted(w, h, FIT, FIT)))
    cut = np.flatnonzero(cut_borders)
    if len(cut):
        for i, box in zip(cut, lit_boxes(np.stack([out[i] for i in cut]))):
            out[i] = without_borders(out[i], box)
    return out


@F.pandas_udf(StructType([StructField("data", BinaryType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))
def prepare_image_udf(data: pd.Series, width: pd.Series, height: pd.Series, cut_borders: pd.Series) -> pd.DataFrame:
    """The prepared raster and its size; nulls for an image without data or size, or with fewer bytes than its size takes."""
    rows: list[tuple] = [(None, None, None)] * len(data)
    sizes: dict[tuple[int, int], list[int]] = {}
    for i, (d, w, h) in enumerate(zip(data, width, height)):
        if d is not None and pd.notna(w) and pd.notna(h) and w > 0 and h > 0 and len(d) >= 3 * w * h:
            sizes.setdefault((int(w), int(h)), []).append(i)
    for (w, h), at in sizes.items():
        step = max(1, BATCH_PIXELS // (w * h))
        for some in (at[i : i + step] for i in range(0, len(at), step)):
            images = np.stack([np.frombuffer(data.iloc[i], np.uint8, 3 * w * h).reshape(h, w, 3) for i in some])
            cut = np.array([cut_borders.iloc[i] is not None and bool(cut_borders.iloc[i]) for i in some])
            for i, image in zip(some, prepare(images, cut)):
                rows[i] = (image.tobytes(), image.shape[1], image.shape[0])
    return pd.DataFrame(rows, columns=["data", "width", "height"], dtype=object)
