"""Image files as tables: listing, sizes from headers, and which files may be decoded."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .shared import save


def objects(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modified, length) of stored files; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 15 << 20) -> DataFrame:
    """(path, length, content) of files up to a size; larger ones have no content, and are told apart so."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return f.select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))


def kind(content: Column) -> Column:
    """The type that a file's first bytes show, or null."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "image/png").when(F.startswith(head, F.lit("FFD8FF")), "image/jpeg").when(head.rlike("^52494646.{8}57454250"), "image/webp")


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height of a PNG, by column functions alone."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return number(17), number(21)


def header_size(b: bytes | None) -> tuple[int, int] | None:
    """(width, height) by the header of a PNG, JPEG or WebP file; None where it can't be told."""
    b = b or b""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return struct.unpack(">II", b[16:24])
    if b[:3] == b"\xff\xd8\xff":
        return _jpeg_size(b)
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        form, body = b[12:16], b[20:]
        if form == b"VP8 ":
            return int.from_bytes(body[6:8], "little") & 0x3FFF, int.from_bytes(body[8:10], "little") & 0x3FFF
        if form == b"VP8L":
            packed = int.from_bytes(body[1:5], "little")
            return (packed & 0x3FFF) + 1, (packed >> 14 & 0x3FFF) + 1
        if form == b"VP8X":
            return int.from_bytes(body[4:7], "little") + 1, int.from_bytes(body[7:10], "little") + 1
    return None


def _jpeg_size(b: bytes) -> tuple[int, int] | None:
    """The first frame header; scans or the end before one mean that there is none."""
    at = 2
    while at + 9 < len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in (0xD9, 0xDA):
            return None
        elif marker == 1 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            return w, h
        else:
            at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return None


def with_sizes(table: DataFrame, content_col: str = "content") -> DataFrame:
    """`table` with `mime`, `width` and `height` (null where unreadable)."""

    @F.pandas_udf("struct<width long, height long>")
    def sizes(c: pd.Series) -> pd.DataFrame:
        got = [header_size(None if x is None else bytes(x)) or (None, None) for x in c]
        return pd.DataFrame({"width": pd.array([g[0] for g in got], "Int64"), "height": pd.array([g[1] for g in got], "Int64")})

    return table.withColumn("mime", kind(F.col(content_col))).withColumn("_size", sizes(content_col)).withColumns({"width": F.col("_size.width"), "height": F.col("_size.height")}).drop("_size")


def decodable(sized: DataFrame) -> DataFrame:
    """`sized` with `refusal`: why a file must not be decoded, or null. Filter on it before any kernel."""
    too_large = (F.col("width") > 12000) | (F.col("height") > 12000) | (F.col("width") * F.col("height") > 4_000_000)
    padded = (F.col("mime") != "image/png") & (F.col("length") > (2 << 20) + 3 * F.col("width") * F.col("height"))
    return sized.withColumn("refusal", F.when(F.col("mime").isNull(), "unsupported").when(F.col("width").isNull(), "unreadable").when(too_large, "dimensions").when(padded, "padding"))


def decoded(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, width, height, rgba) of the PNG and JPEG files of a folder, decoded by Spark's own image reader.

    `rgba` holds four bytes a pixel, row by row. Files that can't be read have no row. The reader hands rows from
    the top, channels as blue, green, red and alpha.
    """
    found = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)

    def run(batches):
        for b in batches:
            out = []
            for n, data in zip(b.column("channels").to_pylist(), b.column("data").to_pylist(), strict=True):
                p = np.frombuffer(data, np.uint8).reshape(-1, n)
                colour = p[:, [2, 1, 0]] if n >= 3 else np.repeat(p[:, :1], 3, axis=1)
                alpha = p[:, 3:4] if n == 4 else np.full((len(p), 1), 255, np.uint8)
                out.append(np.hstack([colour, alpha]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("width"), b.column("height"), pa.array(out, pa.binary())], ["path", "width", "height", "rgba"])

    cells = found.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return cells.mapInArrow(run, "path string, width int, height int, rgba binary")


def exif_orientation(b: bytes | None) -> int:
    """How a JPEG's picture is to be turned, 1 (not at all) to 8, by its first Exif block; 1 where it doesn't say."""
    for kind, start, end in jpeg_segments(b) if b and b[:2] == b"\xff\xd8" else ():
        tiff = b[start + 10 : end]
        if kind == 0xE1 and b[start + 4 : start + 8] == b"Exif" and len(tiff) >= 14:
            order = "little" if tiff[:2] == b"II" else "big"
            number = lambda at, n, tiff=tiff, order=order: int.from_bytes(tiff[at : at + n], order)
            at = number(4, 4)
            for entry in range(at + 2, min(at + 2 + 12 * number(at, 2), len(tiff) - 11), 12):
                if number(entry, 2) == 0x0112:
                    return v if 1 <= (v := number(entry + 8, 2)) <= 8 else 1
            return 1
    return 1


def turned(image: np.ndarray, orientation: int) -> np.ndarray:
    """A picture (height, width, 4) as it is to be seen."""
    if orientation >= 5:
        image = image.transpose(1, 0, 2)
    rows, columns = {2: (1, -1), 3: (-1, -1), 4: (-1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}.get(orientation, (1, 1))
    return np.ascontiguousarray(image[::rows, ::columns])


def decode_files(spark: SparkSession, path: str, glob: str = "*", max_bytes: int = 15 << 20) -> DataFrame:
    """(path, mime, width, height, rgba, error) of every file of a folder: decoded and turned as its Exif block says, or why not.

    What a header says is too large is told so, whatever it decodes to; Spark's reader still meets the file, so a folder
    of unknown files is to be sifted by `decodable` first. Formats without a decoder here, WebP among them, are told as
    unsupported. Width and height are of what is seen.
    """
    same = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    given = decodable(with_sizes(files(spark, path, glob, max_bytes))).select("path", same(F.col("path")).alias("_at"), "mime", "content", F.when(F.col("length") > max_bytes, "dimensions").otherwise(F.col("refusal")).alias("_refusal"))
    found = decoded(spark, path, glob).select(same(F.col("path")).alias("_from"), F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("rgba").alias("_rgba"))
    both = given.join(found, (F.col("_at") == F.col("_from")) & F.col("_refusal").isNull(), "left")

    def run(batches):
        for b in batches:
            out = []
            for mime, content, refusal, w, h, rgba in zip(*(b.column(c).to_pylist() for c in ("mime", "content", "_refusal", "_w", "_h", "_rgba")), strict=True):
                if refusal in ("dimensions", "padding"):
                    out.append((None, None, None, "Image is too large"))
                elif mime is None or mime == "image/webp":
                    out.append((None, None, None, f'Unsupported image type "{mime or "unknown"}"'))
                elif rgba is None:
                    out.append((None, None, None, f"Failed to decode {mime} image"))
                else:
                    seen = np.frombuffer(rgba, np.uint8).reshape(h, w, 4)
                    seen = turned(seen, exif_orientation(content) if mime == "image/jpeg" else 1)
                    out.append((seen.shape[1], seen.shape[0], seen.tobytes(), None))
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.string()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("mime"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["path", "mime", "width", "height", "rgba", "error"])

    return both.mapInArrow(run, "path string, mime string, width int, height int, rgba binary, error string")


def inspected_and_shrunk(decoded_images: DataFrame, inspect, most: int, id_col: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """(what `inspect` makes of pixels at full size, pixels of at most `most` an image), of images that are decoded once.

    The decoded images are written, so both read the same bytes.
    """
    kept = save(decoded_images.select(id_col, "width", "height", "rgba"), "decoded")
    return inspect(pixels_of(kept, id_col)), pixels_of(kept, id_col, most)


def pixels_of(images: DataFrame, id_col: str = "image_id", most: int | None = None) -> DataFrame:
    """(image_id, x, y, r, g, b, a) of `decoded` rows with an id; shrunk by a whole factor to `most` pixels at most.

    A block's colour is the mean of its pixels weighted by alpha, its alpha a plain mean; halves go up. Images
    leave in batches of rows of pixels, so a large one is never a batch of objects.
    """

    def run(batches):
        for b in batches:
            for image, w, h, data in zip(*(b.column(c).to_pylist() for c in ("i", "width", "height", "rgba")), strict=True):
                p = shrunk(np.frombuffer(data, np.uint8).reshape(h, w, 4), most)
                rows, width = p.shape[:2]
                for top in range(0, rows, max(1, 65536 // width)):
                    part = p[top : top + max(1, 65536 // width)]
                    y, x = np.divmod(np.arange(part.shape[0] * width, dtype=np.int32), width)
                    flat = part.reshape(-1, 4).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), image)), pa.array(x), pa.array(y + np.int32(top)), *[pa.array(flat[:, k]) for k in range(4)]], ["image_id", "x", "y", *"rgba"])

    return images.select(F.col(id_col).cast("long").alias("i"), "width", "height", "rgba").mapInArrow(run, "image_id long, x int, y int, r int, g int, b int, a int")


def shrunk(image: np.ndarray, most: int | None) -> np.ndarray:
    """An image (height, width, 4) as it is, or in blocks of the least whole size that leaves at most `most` of them."""
    h, w, _ = image.shape
    k = 1
    while most is not None and -(-h // k) * -(-w // k) > most:
        k += 1
    if k == 1:
        return image
    p = image.astype(np.int64)
    p[..., :3] *= p[..., 3:]
    for axis in (0, 1):
        p = np.add.reduceat(p, np.arange(0, p.shape[axis], k), axis=axis)
    sides = [np.diff(np.r_[np.arange(0, n, k), n]) for n in (h, w)]
    count = (sides[0][:, None] * sides[1])[..., None]
    alpha = p[..., 3:]
    colour = np.where(alpha > 0, (2 * p[..., :3] + alpha) // np.maximum(1, 2 * alpha), 0)
    return np.concatenate([colour, (2 * alpha + count) // (2 * count)], axis=2).astype(np.uint8)


def png(image: np.ndarray) -> bytes:
    """A PNG file of 8-bit RGBA from an array (height, width, 4)."""
    h, w, _ = image.shape
    rows = np.hstack([np.zeros((h, 1), np.uint8), np.ascontiguousarray(image, np.uint8).reshape(h, 4 * w)]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def jpeg_segments(b: bytes):
    """(kind, start, end) of each part of a JPEG up to and with its scans; ends early where it is broken."""
    at = 2
    while at + 3 < len(b) and b[at] == 0xFF:
        while b[at + 1] == 0xFF and at + 2 < len(b):  # padding between parts
            at += 1
        kind = b[at + 1]
        if kind == 0xDA:
            yield kind, at, len(b)
            return
        alone = kind in (0x01, 0xD8, 0xD9) or 0xD0 <= kind <= 0xD7
        end = at + 2 if alone else at + 2 + int.from_bytes(b[at + 2 : at + 4], "big")
        if not alone and (end > len(b) or end < at + 4):
            return
        yield kind, at, end
        at = end


def without_metadata(b: bytes | None) -> bytes | None:
    """A JPEG without comments and application data, but for JFIF, the first Exif block and Adobe's colour mark.

    What isn't a whole JPEG, or has nothing to drop, comes back as it is.
    """
    if b is None or b[:2] != b"\xff\xd8":
        return b
    kept, exif = [b[:2]], False
    parts = list(jpeg_segments(b))
    if not parts or parts[-1][0] != 0xDA:
        return b
    for kind, start, end in parts:
        first_exif = kind == 0xE1 and not exif and b[start + 4 : start + 8] == b"Exif" and end - start >= 10
        exif = exif or first_exif
        if kind != 0xFE and (kind not in range(0xE1, 0xF0) or kind == 0xEE or first_exif):
            kept.append(b[start:end])
    return b"".join(kept)


@F.arrow_udf(BinaryType())
def strip_metadata(content: pa.Array) -> pa.Array:
    return pa.array([without_metadata(b) for b in content.to_pylist()], pa.binary())


def write_objects(objects: DataFrame, path: str, *keys: str) -> None:
    """Write rows under folders named by their keys; a second write of a key replaces what was there, and no other."""
    objects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def delete_object(spark: SparkSession, path: str) -> bool:
    """Delete a stored object or folder; nothing happens if it isn't there. Says whether it was."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
