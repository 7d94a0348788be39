"""Image preparation equals a plain computation pixel by pixel; borders go by the rule of shapes."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from vireo.operators import descriptor
from vireo.operators import prepare_image as p
from vireo.session import ensure_importable

RNG = np.random.default_rng(5)


def slow_resize(image, width, height):
    h, w = image.shape[:2]

    def shares(n, size, i):
        a, b = Fraction(i * n, size), Fraction((i + 1) * n, size)
        return [(k, min(b, k + 1) - max(a, k)) for k in range(n) if min(b, k + 1) > max(a, k)]

    out = np.zeros((height, width, 3), np.uint8)
    for y in range(height):
        for x in range(width):
            for c in range(3):
                s = sum(fy * fx * int(image[ky, kx, c]) for ky, fy in shares(h, height, y) for kx, fx in shares(w, width, x))
                out[y, x, c] = int(s * width * height / (w * h) + Fraction(1, 2))
    return out


@pytest.mark.parametrize("shape", [(7, 5, 3, 4), (4, 6, 9, 11), (6, 6, 3, 2), (5, 5, 5, 5), (1, 1, 3, 2), (9, 2, 1, 1)])
def test_area_means(shape):
    w, h, new_w, new_h = shape
    images = RNG.integers(0, 256, (3, h, w, 3), dtype=np.uint8)
    got = p.area_resize(images, new_w, new_h)
    for image, out in zip(images, got):
        assert (out == slow_resize(image, new_w, new_h)).all()


def slow_box(image):
    h, w = image.shape[:2]
    luma = sorted((299 * int(r) + 587 * int(g) + 114 * int(b)) // 1000 for r, g, b in image.reshape(-1, 3))
    cut = (h * w - 1) // 100
    low, high = luma[cut], luma[-1 - cut]
    lit = []
    for y in range(h):
        for x in range(w):
            around = image[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].min((0, 1))
            value = int(around.max())
            if (value if high == low else Fraction((value - low) * 255, high - low)) > 30:
                lit.append((x, y))
    if not lit:
        return 0, 0, w, h
    xs, ys = [x for x, _ in lit], [y for _, y in lit]
    return min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1


def test_boxes_equal_plain_search():
    images = np.stack([RNG.integers(0, 80, (24, 30, 3), dtype=np.uint8) for _ in range(6)])
    images[0, :5] = 3
    images[1, :, -7:] = 0
    images[2] = 0
    images[3] = 200
    images[4, :6], images[4, 2:4, 10:12] = 1, 255  # a small bright mark in a border
    images[4, 6:] = 150
    assert p.lit_boxes(images) == [slow_box(i) for i in images]
    assert p.lit_boxes(images)[2] == (0, 0, 30, 24)
    assert p.lit_boxes(images)[4][1] == 8


def bars(width, height, top, left, value=180):
    image = np.zeros((height, width, 3), np.uint8)
    image[top : height - top, left : width - left] = value
    return image


@pytest.mark.parametrize(
    "made, shape",
    [
        ((320, 180, 0, 0), (180, 320)),  # nothing to cut
        ((320, 240, 30, 0), (176, 320)),  # bars above and below 16:9: cut as found
        ((320, 180, 0, 40), (180, 236)),  # 4:3 in 16:9
        ((320, 180, 20, 0), (180, 320)),  # 21:9 in 16:9: letterboxed
        ((320, 137, 0, 0), (137, 320)),  # 21:9 already
        ((320, 320, 100, 100), (320, 320)),  # a square is no screen
    ],
)
def test_shapes(made, shape):
    image = bars(*made)
    got = p.prepare(image[None], np.array([True]))[0]
    assert got.shape[:2] == shape
    assert (p.prepare(image[None], np.array([False]))[0] == image).all()


def test_letterbox_is_filled_and_centred():
    got = p.prepare(bars(320, 180, 20, 0)[None], np.array([True]))[0]
    lit = (got > 0).any((1, 2))
    assert got.shape == (180, 320, 3) and lit.sum() == p.fitted(320, 136, 320, 180)[1]
    assert set(np.unique(got)) == {0, 180}


def test_decision_is_the_column_rule(spark):
    sizes = [(320, 180, int(w), int(h)) for w, h in zip(RNG.integers(1, 321, 400), RNG.integers(1, 181, 400))]
    sizes += [(320, 180, 320, 137), (320, 137, 313, 134), (640, 275, 610, 262)]
    df = spark.createDataFrame(sizes, "w int, h int, a int, b int").select("*", descriptor.crop_decision(*(F.col(c) for c in "whab")).alias("d"))
    assert [r["d"] for r in df.collect()] == [p.decide(*s) for s in sizes]


def test_udf_on_odd_rows(spark):
    ensure_importable(spark)
    image = bars(64, 48, 6, 0)
    rows = [
        (1, image.tobytes(), 64, 48, True), (2, None, 64, 48, True), (3, b"", 64, 48, True), (4, image.tobytes()[:-1], 64, 48, True), (5, image.tobytes(), None, 48, True),
        (6, image.tobytes(), 0, 48, True), (7, image.tobytes(), -64, 48, True), (8, image.tobytes() + b"rest", 64, 48, None), (9, bytes(3 * 5000), 5000, 1, True), (10, image.tobytes(), 64, 48, False),
    ]
    df = spark.createDataFrame(rows, "id int, data binary, w int, h int, cut boolean").select("id", p.prepare_image_udf("data", "w", "h", "cut").alias("p"))
    got = {r["id"]: r["p"] for r in df.collect()}
    assert all(got[i]["data"] is None and got[i]["width"] is None for i in (2, 3, 4, 5, 6, 7))
    assert (got[8]["width"], got[8]["height"]) == (320, 240) == (got[10]["width"], got[10]["height"])
    assert (got[9]["width"], got[9]["height"], len(got[9]["data"])) == (320, 1, 960)
    assert got[1]["data"] == p.prepare(image[None], np.array([True]))[0].tobytes()
    assert spark.createDataFrame([], df.schema).count() == 0


def test_boxes_are_those_of_sorted_brightness():
    """Ranks from counts and byte-wise comparisons give the boxes that sorting whole numbers gives."""
    rng = np.random.default_rng(5)
    images = rng.integers(0, 256, (40, 30, 40, 3)).astype(np.uint8)
    for k, image in enumerate(images):
        image[: k % 7] //= 9
        image[:, 40 - k % 11 :] //= 12
        if k % 5 == 0:
            image[:] = k
        elif k % 3 == 0:
            image //= np.uint8(k)
    got = p.lit_boxes(images)
    for image, box in zip(images.astype(np.int64), got):
        h, w = image.shape[:2]
        ranked = np.sort((image @ np.array([299, 587, 114]) // 1000).ravel())
        cut = (h * w - 1) // 100
        low, high = ranked[cut], ranked[-1 - cut]
        above = 30 * 255 if high == low else 255 * low + 30 * (high - low)
        wide = np.pad(image, ((2, 2), (2, 2), (0, 0)), mode="edge")
        dark = np.min([wide[i : i + h, j : j + w] for i in range(5) for j in range(5)], axis=0)
        rows, cols = np.nonzero(dark.max(-1) * 255 > above)
        want = (cols.min(), rows.min(), np.ptp(cols) + 1, np.ptp(rows) + 1) if len(rows) else (0, 0, w, h)
        assert tuple(map(int, want)) == box


def test_brightness_takes_little_memory():
    import tracemalloc

    images = np.full((8, 180, 320, 3), 90, np.uint8)
    tracemalloc.start()
    p.lit_boxes(images)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * images.nbytes
