"""Filters of whole images as numpy kernels. An image is a float array of (height, width, 4), alpha last."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .regions import gathered


def blur(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable Gaussian of radius ceil(2.5 sigma), edges repeated, colours weighted by alpha."""
    radius = max(1, int(np.ceil(2.5 * sigma)))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    planes = np.concatenate([image[..., :3] * image[..., 3:], image[..., 3:]], axis=2)
    for axis in (0, 1):
        pad = np.pad(planes, [(radius, radius) if a == axis else (0, 0) for a in range(3)], mode="edge")
        n = planes.shape[axis]
        planes = sum(w * np.take(pad, range(i, i + n), axis=axis) for i, w in enumerate(k))
    return _rounded(planes)


def bilateral(image: np.ndarray, radius: int, range_sigma: float) -> np.ndarray:
    """Mean over a square, weighted by distance, by likeness of colour, and by alpha; nothing outside counts."""
    spatial = max(1.0, radius / 1.5)
    h, w, _ = image.shape
    total = np.zeros((h, w, 4))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            to = np.s_[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
            tap = image[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
            d2 = ((tap[..., :3] - image[to][..., :3]) ** 2).sum(axis=2)
            weight = np.exp(-(dx * dx + dy * dy) / (2 * spatial**2) - d2 / (2 * range_sigma**2)) * tap[..., 3]
            total[to] += np.concatenate([tap[..., :3] * weight[..., None], weight[..., None]], axis=2)
    out = _rounded(total)
    out[..., 3] = image[..., 3]
    return out


def upscale(image: np.ndarray, factor: int) -> np.ndarray:
    """Bilinear by a whole factor, pixel centres at halves, colours premultiplied while they mix."""
    planes = np.concatenate([image[..., :3] * image[..., 3:], image[..., 3:]], axis=2)
    for axis in (0, 1):
        n = planes.shape[axis]
        at = np.clip((np.arange(n * factor) + 0.5) / factor - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        t = (at - low).reshape([-1 if a == axis else 1 for a in range(3)])
        planes = np.take(planes, low, axis=axis) * (1 - t) + np.take(planes, np.minimum(low + 1, n - 1), axis=axis) * t
    return _rounded(planes)


def smooth_chroma(image: np.ndarray, radius: int = 4, luma_sigma: float = 12.0) -> np.ndarray:
    """Colour difference averaged where lightness is alike: repairs the colour blocks of lossy files."""
    r, g, b, a = np.moveaxis(image, 2, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb, cr = (b - y) * 0.564, (r - y) * 0.713
    h, w = y.shape
    sums = np.zeros((3, h, w))
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            to = np.s_[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
            fro = np.s_[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
            weight = np.exp(-((y[fro] - y[to]) ** 2) / (2 * luma_sigma**2)) * (a[fro] > 0)
            for s, v in zip(sums, (cb[fro], cr[fro], 1.0), strict=True):
                s[to] += weight * v
    some = sums[2] > 0
    cb, cr = (np.where(some, s / np.where(some, sums[2], 1), c) for s, c in zip(sums, (cb, cr), strict=False))
    red, blue = y + cr / 0.713, y + cb / 0.564
    green = (y - 0.299 * red - 0.114 * blue) / 0.587
    return np.clip(np.rint(np.stack([red, green, blue, a], axis=2)), 0, 255)


def _rounded(planes: np.ndarray) -> np.ndarray:
    """From premultiplied sums to colours: halves to even, 0 to 255."""
    weight = planes[..., 3:]
    colour = np.where(weight > 0, planes[..., :3] / np.where(weight > 0, weight, 1), 0)
    return np.clip(np.rint(np.concatenate([colour, weight], axis=2)), 0, 255)


def apply(pixels: DataFrame, kernel) -> DataFrame:
    """Run a kernel (array to array) on each image of (image_id, x, y, r, g, b, a)."""
    images = gathered(pixels, dict.fromkeys("rgba", "double"))

    def run(batches):
        for t in batches:
            for i in range(t.num_rows):
                image = np.stack([t.column(c)[i].values.to_numpy() for c in "rgba"], axis=1).reshape(-1, t.column("width")[i].as_py(), 4)
                out = kernel(image)
                h, w, _ = out.shape
                y, x = np.divmod(np.arange(h * w), w)
                flat = out.reshape(-1, 4).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, t.column("image_id")[i].as_py(), np.int64)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), *(pa.array(flat[:, k]) for k in range(4))], ["image_id", "x", "y", "r", "g", "b", "a"])

    return images.mapInArrow(run, "image_id long, x int, y int, r int, g int, b int, a int")
