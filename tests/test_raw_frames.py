"""Rasters and times are paired by number, wherever files are split."""

import re

import numpy as np
import pytest

from vireo.operators.descriptor import colour_layout
from vireo.session import ensure_importable
from vireo.sources import raw_frames

W, H = 8, 4
RASTER = 3 * W * H


def times_of(log):
    return [float(x) for line in log.decode().split("\n") for x in re.findall(raw_frames.TIME, line)]


def line(i):
    return b"[info @ 0x1] n: %d pts: 7 pts_time:%s duration" % (i, str(i / 8).encode())


@pytest.fixture(scope="module")
def clips(spark, tmp_path_factory):
    ensure_importable(spark)
    rng = np.random.default_rng(3)
    raw = lambda n, rest=0: rng.integers(0, 256, n * RASTER + rest, dtype=np.uint8).tobytes()
    files = {
        "long": (raw(500), b"\n".join(line(i) for i in range(500))),
        "more times": (raw(3, 5), b"\n".join([line(0), b"no time here", line(1) + b" " + line(2), line(3)])),
        "fewer+times": (raw(4), line(0) + b"\npts_time:  9.\npts_time:x\n"),
        "deep/er/clip.x": (raw(2), line(5) + b"\r\n" + line(4)),
        "empty": (b"", line(0)),
        "short": (raw(0, RASTER - 1), line(0)),
        "quiet": (raw(2), b""),
        "no log": (raw(2), None),
        "no raster": (None, line(0)),
    }
    rows = [(f"{n}.{e}", d) for n, pair in files.items() for e, d in zip(("rgb", "log"), pair) if d is not None]
    root = str(tmp_path_factory.mktemp("raw frames+"))
    written = spark.createDataFrame([*rows, ("null.rgb", None), (None, b"x"), ("other.txt", b"pts_time:1")], "name string, data binary")
    assert raw_frames.write_files(written, root) == len(rows) + 2
    want = set()
    for name, (data, log) in files.items():
        if data is not None and log is not None:
            want |= {(name, i, t, data[i * RASTER : (i + 1) * RASTER]) for i, t in zip(range(len(data) // RASTER), times_of(log))}
    assert len(want) == 500 + 3 + 2 + 2
    return root, want


@pytest.mark.parametrize("block", [1, 7 * RASTER, 1 << 20])
def test_pairs(spark, clips, block):
    root, want = clips
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    opening = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = raw_frames.timed_frames(spark, root, width=W, height=H, block_bytes=block).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", opening)
    assert len(got) == len(want)
    assert {(r["name"], r["frame"], r["time"], bytes(r["data"])) for r in got} == want


def test_long_log_is_split(spark, clips):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = spark.read.text(clips[0] + "/long.log").selectExpr("_metadata.file_block_start AS at").distinct()
        assert lines.count() > 5
        assert raw_frames.raw_frames(spark, clips[0], W, H, block_bytes=RASTER * 50).rdd.getNumPartitions() > 9
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_descriptors_where_bytes_are_read(spark, clips):
    root, want = clips
    got = raw_frames.timed_frames(spark, root, width=W, height=H, layout=True).collect()
    assert {(r["name"], r["frame"], tuple(r["vector"])) for r in got} == {(n, i, tuple(colour_layout(d, W, H))) for n, i, _, d in want}


def test_empty_folder_and_bad_size(spark, tmp_path):
    ensure_importable(spark)
    (tmp_path / "e").mkdir()
    assert raw_frames.raw_frames(spark, str(tmp_path / "e"), W, H).collect() == []
    with pytest.raises(Exception, match="positive"):
        raw_frames.raw_frames(spark, str(tmp_path / "e"), 0, H).collect()
