import os
import struct
import zlib

import numpy as np

from scriptorium.operators import quality as QL


def write_png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + rgb[y].tobytes() for y in range(h))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data) & 0xFFFFFFFF)

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def checker(h, w, lo, hi):
    yy, xx = np.mgrid[0:h, 0:w]
    g = np.where((yy + xx) % 2 == 0, lo, hi).astype(np.uint8)
    return np.stack([g, g, g], axis=-1)


def test_cascade_on_images(spark, tmpdir_path):
    cases = {"flat.png": np.full((100, 100, 3), 128, np.uint8), "good.png": checker(600, 600, 0, 255),
             "small.png": checker(100, 100, 0, 255), "dull.png": checker(600, 600, 100, 105)}
    for name, arr in cases.items():
        write_png(os.path.join(tmpdir_path, name), arr)
    with open(os.path.join(tmpdir_path, "broken.png"), "wb") as f:
        f.write(b"not an image")
    m = QL.verdict(QL.image_metrics(QL.read_images(spark, tmpdir_path)))
    got = {os.path.basename(r.path): (r.verdict, r.message) for r in m.collect()}
    assert got["broken.png"] == ("unreadable", "The image cannot be read") and len(got) == 5
    assert got["flat.png"] == ("blurry", "The image is blurry (focus measure = 0.00)")
    assert got["good.png"][0] == "good"
    assert got["small.png"][0] == "low_resolution"
    assert got["dull.png"] == ("low_contrast", "The image has low contrast")


def test_cascade_bounds(spark):
    df = spark.createDataFrame([(50.0, 5, 100), (200.0, 5, 100), (200.0, 15, 100), (200.0, 15, 500), (100.0, 15, 500)],
                               "blur double, contrast int, height int")
    assert [r.verdict for r in QL.verdict(df).collect()] == ["blurry", "low_contrast", "low_resolution", "good", "good"]


def test_laplacian_matches_definition():
    g = np.arange(30, dtype=np.float64).reshape(5, 6) ** 1.5
    p = np.pad(g, 1, mode="reflect")
    lap = np.array([[p[i, j + 1] + p[i + 2, j + 1] + p[i + 1, j] + p[i + 1, j + 2] - 4 * p[i + 1, j + 1]
                     for j in range(6)] for i in range(5)])
    assert abs(QL.laplacian_variance(g) - lap.var()) < 1e-9
