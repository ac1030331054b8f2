"""Image files: decoding, shrinking, writing, and what is cut from JPEG."""

import os
import struct

import numpy as np

from rastermill.sources import images


def test_png_files_become_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {f"{k}.png": rng.integers(0, 256, (5 + k, 7, 4), dtype=np.uint8) for k in range(3)}
    for name, p in made.items():
        p[..., 3] = np.where(p[..., 3] < 128, 0, p[..., 3])
        (tmp_path / name).write_bytes(images.png(p))
    (tmp_path / "broken.png").write_bytes(b"no image")
    got = images.decoded(spark, str(tmp_path)).collect()
    assert {os.path.basename(r["path"]) for r in got} == set(made)
    for r in got:
        p = made[os.path.basename(r["path"])]
        seen = np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4)
        assert (seen[..., 3] == p[..., 3]).all() and (seen[p[..., 3] > 0] == p[p[..., 3] > 0]).all()
    files = spark.createDataFrame([(1, 7, 5, made["0.png"].tobytes())], "image_id long, width int, height int, rgba binary").coalesce(1)
    cells = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in images.pixels_of(files).collect()}
    assert cells == {(x, y): tuple(int(v) for v in made["0.png"][y, x]) for y in range(5) for x in range(7)}
    assert images.pixels_of(files, most=8).count() == 6


def test_shrinking_equals_plain_means():
    rng = np.random.default_rng(2)
    p = rng.integers(0, 256, (11, 13, 4), dtype=np.uint8)
    p[:4, :4, 3] = 0
    got = images.shrunk(p, 20)
    assert got.shape == (4, 5, 4) and images.shrunk(p, None) is p and images.shrunk(p, 143) is p
    for y in range(4):
        for x in range(5):
            block = p[3 * y : 3 * y + 3, 3 * x : 3 * x + 3].reshape(-1, 4).astype(float)
            a = block[:, 3]
            want = [np.floor((block[:, k] * a).sum() / a.sum() + 0.5) if a.sum() else 0 for k in range(3)] + [np.floor(a.mean() + 0.5)]
            assert got[y, x].tolist() == want


def test_jpeg_metadata_is_cut(spark):
    part = lambda kind, data: bytes([0xFF, kind]) + struct.pack(">H", len(data) + 2) + data
    keep = [part(0xE0, b"JFIF12"), part(0xE1, b"Exif\0\0abcd"), part(0xEE, b"Adobe"), part(0xDB, b"q" * 9), bytes([0xFF, 0xDA]) + b"scan \xff\xe2 data \xff\xd9"]
    drop = [part(0xE1, b"http://ns"), part(0xE1, b"Exif\0\0two"), part(0xFE, b"comment"), part(0xE2, b"ICC"), part(0xED, b"8BIM")]
    whole = b"\xff\xd8" + keep[0] + keep[1] + drop[0] + drop[1] + keep[2] + drop[2] + b"\xff" + drop[3] + keep[3] + drop[4] + keep[4]
    clean = b"\xff\xd8" + b"".join(keep)
    assert images.without_metadata(whole) == clean and images.without_metadata(clean) == clean
    for odd in (None, b"", b"\xff\xd8", whole[:40], b"\x89PNG", b"\xff\xd8\xff\xe1\x00"):
        assert images.without_metadata(odd) == odd
    rows = spark.createDataFrame([(whole,), (None,)], "b binary").select(images.strip_metadata("b").alias("b")).collect()
    assert bytes(rows[0]["b"]) == clean and rows[1]["b"] is None


def test_objects_are_replaced_and_deleted_by_key(spark, tmp_path):
    at = str(tmp_path / "objects")
    images.write_objects(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "user int, job int, body string"), at, "user", "job")
    images.write_objects(spark.createDataFrame([(1, 2, "new")], "user int, job int, body string"), at, "user", "job")
    assert sorted(map(tuple, spark.read.parquet(at).select("user", "job", "body").collect())) == [(1, 1, "a"), (1, 2, "new"), (2, 1, "c")]
    assert images.delete_object(spark, f"{at}/user=1/job=1") and not images.delete_object(spark, f"{at}/user=1/job=1")
    assert spark.read.parquet(at).count() == 2


def test_every_file_is_decoded_or_told_why_not(spark, tmp_path):
    rng = np.random.default_rng(3)
    p = rng.integers(0, 256, (5, 7, 4), dtype=np.uint8)
    p[..., 3] = 255
    (tmp_path / "a.png").write_bytes(images.png(p))
    (tmp_path / "cut.png").write_bytes(images.png(p)[:60])
    (tmp_path / "note.txt").write_bytes(b"no image")
    (tmp_path / "b.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8L" + b"\0" * 4 + b"\x2f" + b"\0" * 20)
    (tmp_path / "bomb.png").write_bytes(images.png(p)[:16] + struct.pack(">II", 100_000, 9) + images.png(p)[24:])
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(16, 8, 1)
    for x in range(16):
        for y in range(8):
            picture.setRGB(x, y, 0xFF0000 if x < 8 else 0x0000FF)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(tmp_path / "plain.jpg")))
    plain = (tmp_path / "plain.jpg").read_bytes()
    for k in range(1, 9):
        tiff = b"II*\0\x08\0\0\0" + struct.pack("<HHHIHH", 1, 0x0112, 3, 1, k, 0) + b"\0" * 4
        block = b"Exif\0\0" + tiff
        (tmp_path / f"turn{k}.jpg").write_bytes(plain[:2] + b"\xff\xe1" + struct.pack(">H", len(block) + 2) + block + plain[2:])
    got = {os.path.basename(r["path"]): r for r in images.decode_files(spark, str(tmp_path)).collect()}
    assert len(got) == 14
    assert got["a.png"]["error"] is None and bytes(got["a.png"]["rgba"]) == p.tobytes()
    assert got["cut.png"]["error"] == "Failed to decode image/png image" and got["note.txt"]["error"] == 'Unsupported image type "unknown"'
    assert got["b.webp"]["error"] == 'Unsupported image type "image/webp"' and got["bomb.png"]["error"] == "Image is too large"
    base = np.frombuffer(got["plain.jpg"]["rgba"], np.uint8).reshape(8, 16, 4)
    assert base[4, 2, 0] > 200 and base[4, 13, 2] > 200
    red = {1: (2, 4), 2: (13, 4), 3: (13, 4), 4: (2, 4), 5: (4, 2), 6: (4, 2), 7: (4, 13), 8: (4, 13)}
    for k, (x, y) in red.items():
        r = got[f"turn{k}.jpg"]
        assert (r["width"], r["height"]) == ((16, 8) if k < 5 else (8, 16))
        assert np.frombuffer(r["rgba"], np.uint8).reshape(r["height"], r["width"], 4)[y, x, 0] > 200, k


def test_images_are_decoded_once_for_both(spark):
    rows = spark.createDataFrame([(1, 4, 2, bytes(range(32))), (2, 1, 1, b"abcd")], "image_id long, width int, height int, rgba binary")
    seen, small = images.inspected_and_shrunk(rows, lambda p: p.groupBy("image_id").count(), 2)
    assert {r["image_id"]: r["count"] for r in seen.collect()} == {1: 8, 2: 1} and small.count() == 2 + 1


def test_ids_are_asked_for_as_they_are_written(spark):
    from rastermill.operators import service

    t = spark.createDataFrame([(7, "a"), (70, "b")], "id long, v string")
    assert [service.find(t, id=x).count() for x in ("7", "07", "7.0", " 7", "x", "")] == [1, 0, 0, 0, 0, 0] and service.find(t, v="b", id="70").count() == 1
    asked = spark.createDataFrame([("7",), ("007",), (None,)], "asked string")
    assert sorted((str(r["asked"]), r["v"]) for r in service.lookup(asked, t, "id").collect()) == [("007", None), ("7", "a"), ("None", None)]
    assert "id" in t.columns and "cast(id" not in service.find(t, id="7")._jdf.queryExecution().optimizedPlan().toString().lower()
