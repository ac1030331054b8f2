"""Image kernels, file headers, signatures and the job state machine."""

import hashlib
import hmac
import math
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from rastermill.functions import signing
from rastermill.operators import palette, raster
from rastermill.sources import images as files
from rastermill.streaming import lifecycle


def some_image(h=7, w=6, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4)).astype(float)


def clamp(v, n):
    return min(max(v, 0), n - 1)


def test_blur_equals_the_double_sum():
    im, s = some_image(), 0.8
    r = math.ceil(2.5 * s)
    g = [math.exp(-0.5 * (i / s) ** 2) for i in range(-r, r + 1)]
    g = [x / sum(g) for x in g]
    out = raster.blur(im, s)
    for y in range(7):
        for x in range(6):
            a = c = 0.0
            for i in range(-r, r + 1):
                for j in range(-r, r + 1):
                    p = im[clamp(y + i, 7), clamp(x + j, 6)]
                    a += g[i + r] * g[j + r] * p[3]
                    c += g[i + r] * g[j + r] * p[3] * p[0]
            assert abs(out[y, x, 0] - c / a) <= 0.5 + 1e-6 and abs(out[y, x, 3] - a) <= 0.5 + 1e-6


def test_bilateral_equals_the_plain_loop():
    im = some_image(5, 5, 2)
    out = raster.bilateral(im, 2, 30.0)
    for y in range(5):
        for x in range(5):
            t = c = 0.0
            for i in range(max(0, y - 2), min(5, y + 3)):
                for j in range(max(0, x - 2), min(5, x + 3)):
                    p = im[i, j]
                    w = math.exp(-((i - y) ** 2 + (j - x) ** 2) / (2 * (2 / 1.5) ** 2) - sum((p[k] - im[y, x, k]) ** 2 for k in range(3)) / 1800.0) * p[3]
                    t += w
                    c += w * p[1]
            assert abs(out[y, x, 1] - c / t) <= 0.5 + 1e-6


def test_flat_images_stay_as_they_are():
    flat = np.full((6, 5, 4), 120.0)
    flat[..., 3] = 255
    assert (raster.blur(flat, 1.2) == flat).all() and (raster.bilateral(flat, 2, 22) == flat).all() and (raster.smooth_chroma(flat) == flat).all()
    assert (raster.upscale(flat, 3) == 120 + (np.arange(4) == 3) * 135).all() and raster.upscale(flat, 3).shape == (18, 15, 4)
    clear = np.zeros((3, 3, 4))
    assert (raster.blur(clear, 1) == 0).all() and (raster.bilateral(clear, 1, 9) == 0).all()


def test_clusters_keep_weight_and_find_plain_colours():
    rng = np.random.default_rng(3)
    centres = np.array([[0.2, 0, 0], [0.9, 0.05, 0], [0.6, 0.2, 0.1]])
    at = np.repeat(centres, 20, axis=0) + rng.normal(0, 0.004, (60, 3))
    w = np.sort(rng.integers(50, 90, 60).astype(float))[::-1]
    groups = palette.cluster(w, np.hstack([at * w[:, None], at * w[:, None] * 255]), (at * at).sum(axis=1) * w)
    assert len(groups) == 3 and abs(sum(g[0] for g in groups) - w.sum()) < 1e-6
    assert len(palette.cluster(w, np.hstack([at * w[:, None]] * 2), (at * at).sum(axis=1) * w, most=2)) == 2
    assert len(palette.cluster(w[:1], np.hstack([at[:1]] * 2), w[:1])) == 1


def png(width, height):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress((b"\0" + b"\1\2\3\4" * width) * height)) + chunk(b"IEND", b"")


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x11\x08" + struct.pack(">HH", height, width) + bytes(12)


def riff(form, body):
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + form + struct.pack("<I", len(body)) + body


def test_header_sizes():
    assert files.header_size(png(3, 2)) == (3, 2) and files.header_size(jpeg(300, 20)) == (300, 20)
    assert files.header_size(b"\xff\xd8\xff\xda" + bytes(40)) is None and files.header_size(None) is None and files.header_size(b"text") is None
    assert files.header_size(riff(b"VP8 ", bytes(6) + struct.pack("<HH", 40, 30) + bytes(10))) == (40, 30)
    assert files.header_size(riff(b"VP8L", b"\x2f" + struct.pack("<I", 99 | 49 << 14) + bytes(20))) == (100, 50)
    assert files.header_size(riff(b"VP8X", bytes(4) + (639).to_bytes(3, "little") + (479).to_bytes(3, "little") + bytes(10))) == (640, 480)


def test_files_are_refused_by_their_headers(spark, tmp_path):
    for name, data in (("a.png", png(3, 2)), ("b.png", png(1, 1)[:16] + struct.pack(">II", 30000, 30000) + png(1, 1)[24:]), ("c.jpg", jpeg(10, 10) + bytes(3 << 20)), ("d.txt", b"hello"), ("e.jpg", b"\xff\xd8\xff\xd9")):
        (tmp_path / name).write_bytes(data)
    got = files.decodable(files.with_sizes(files.files(spark, str(tmp_path))))
    assert {r["path"][-5:]: (r["refusal"], r["width"]) for r in got.collect()} == {"a.png": (None, 3), "b.png": ("dimensions", 30000), "c.jpg": ("padding", 10), "d.txt": ("unsupported", None), "e.jpg": ("unreadable", None)}
    w, h = files.png_size(F.col("content"))
    assert files.files(spark, str(tmp_path), "a.png").select(w, h).first()[:] == (3, 2)
    assert files.objects(spark, str(tmp_path), "*.jpg").count() == 2


def test_hmac_equals_the_standard_library(spark):
    for key in (b"Jefe", b"\x0b" * 20, b"k" * 64):
        got = spark.createDataFrame([("what do ya want for nothing?",)], "m string").select(signing.hmac_sha256(key, F.col("m"))).first()[0]
        assert got == hmac.new(key, b"what do ya want for nothing?", hashlib.sha256).hexdigest()


def test_decisions():
    assert lifecycle.decide("queued", 0, "success") == ("completed", 1, "ack", False)
    assert lifecycle.decide("queued", 1, "transient") == ("queued", 2, "retry", False)
    assert lifecycle.decide("queued", 2, "transient") == ("failed", 3, "ack", True)
    assert lifecycle.decide("queued", 0, "permanent") == ("failed", 1, "ack", True)
    assert lifecycle.decide("failed", 3, "success") == ("failed", 3, "ack", False)
