"""Labels of pixels between areas, and of areas too small to stay: whole-image kernels, an image a unit of work."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pictures as kernels
from .images import flat_mask
from .pictures import Pictures
from .regions import component_roots, dense, within_budget

#: Edge pixels that are looked at together: bounds the memory of their candidate sets.
BLOCK = 200_000


def around(bits: np.ndarray, ys: np.ndarray, xs: np.ndarray, radius: int, stride: int) -> np.ndarray:
    """For each place the union of the bit sets (words, height, width) over a square, every `stride` pixels."""
    words, h, w = bits.shape
    seen = np.zeros((words, len(ys)), np.uint64)
    for dy in range(-radius, radius + 1, stride):
        for dx in range(-radius, radius + 1, stride):
            y, x = ys + dy, xs + dx
            inside = np.flatnonzero((y >= 0) & (y < h) & (x >= 0) & (x < w))
            seen[:, inside] |= bits[:, y[inside], x[inside]]
    return seen


def candidates(own: np.ndarray, flat: np.ndarray, ys: np.ndarray, xs: np.ndarray, n_labels: int, radius: int) -> np.ndarray:
    """(places, labels): which labels flat pixels near each place have; the square grows to four radii while there are none."""
    words = -(-n_labels // 64)
    bits = np.zeros((words, *own.shape), np.uint64)
    for k in range(words):
        here = flat & (own // 64 == k)
        bits[k][here] = np.uint64(1) << (own[here] % 64).astype(np.uint64)
    seen = np.zeros((words, len(ys)), np.uint64)
    for r in (radius, 2 * radius, 4 * radius):
        none = np.flatnonzero(~seen.any(axis=0))
        stride = max(2 if radius >= 6 else 1, r // 4 if r >= 6 else 1)
        seen[:, none] = around(bits, ys[none], xs[none], r, stride)
    label = np.arange(n_labels)
    return (seen[label // 64] >> (label % 64).astype(np.uint64)[:, None] & np.uint64(1)).astype(bool).T


def best_blend(rgb: np.ndarray, colours: np.ndarray, pairs) -> tuple[np.ndarray, np.ndarray]:
    """(distance, label) of the pair whose mixtures come closest to each colour: the label of the larger part."""
    least, label = np.full(len(rgb), np.inf), np.full(len(rgb), -1)
    for a, b in pairs:
        way = colours[b] - colours[a]
        t = np.clip((rgb - colours[a]) @ way / max(way @ way, 1e-30), 0, 1)
        off = np.round(np.linalg.norm(colours[a] + t[:, None] * way - rgb, axis=1), 9)
        closer = off < least
        least[closer] = off[closer]
        label[closer] = np.where(np.round(t[closer], 9) < 0.5, a, b)
    return least, label


def sided(rgb: np.ndarray, lab: np.ndarray, own: np.ndarray, flat: np.ndarray, opaque: np.ndarray, colours: np.ndarray, tints: np.ndarray, radius: int = 3, preference: float = 0.1) -> np.ndarray:
    """Labels of an image (height, width): -1 where it isn't opaque, `own` where it is flat.

    Another pixel may be a mixture of two colours that flat pixels around it have, and then joins the one it
    has more of. Where its own colour is around, a mixture must fit within 0.06 and no more than 0.02 worse;
    where it isn't, within 0.15 and better. With one colour around, that one is mixed with any. Else a pixel
    whose own colour isn't around takes the closest that is, nearer than `preference` in OKLab. Of equal mixtures
    the one of the lowest labels counts. `rgb` and `colours` are 0 to 1, `lab` and `tints` OKLab.
    """
    out = np.where(opaque, own, -1)
    all_y, all_x = np.nonzero(opaque & ~flat)
    if len(colours) < 2:
        return out
    for start in range(0, len(all_y), BLOCK):
        ys, xs = all_y[start : start + BLOCK], all_x[start : start + BLOCK]
        sets, which = np.unique(candidates(own, flat, ys, xs, len(colours), radius), axis=0, return_inverse=True)
        order, ends = np.argsort(which.ravel(), kind="stable"), np.cumsum(np.bincount(which.ravel(), minlength=len(sets)))
        for labels, at in zip(sets, np.split(order, ends[:-1]), strict=True):
            near = np.flatnonzero(labels)
            if not len(near):
                continue
            y, x = ys[at], xs[at]
            mine, p = own[y, x], rgb[y, x]
            home = labels[mine]
            alone = np.round(np.linalg.norm(p - colours[mine], axis=1), 9)
            least, label = best_blend(p, colours, combinations(near, 2))
            if len(near) == 1 and not home.all():
                away = ~home
                least[away], label[away] = best_blend(p[away], colours, [(near[0], b) for b in range(len(colours)) if b != near[0]])
            fits = np.where(home, (least < 0.06) & (least <= alone + 0.02), (least < 0.15) & (least < alone))
            d2 = np.round(((lab[y, x][:, None] - tints[near]) ** 2).sum(axis=2), 9)
            local = np.where(d2.min(axis=1) < preference**2, near[d2.argmin(axis=1)], mine)
            out[y, x] = np.where(fits, label, np.where(home, mine, local))
    return out


def _palettes(palette: DataFrame) -> DataFrame:
    """(image_id, names, p_r ... p_n): an image's colours as arrays, by label."""
    p = palette.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("label").cast("long").alias("label"), *[F.col(c).cast("double").alias(c) for c in "rgblmn"]))).alias("p"))
    return p.select("image_id", F.col("p.label").alias("names"), *[F.col(f"p.{c}").alias(f"p_{c}") for c in "rgblmn"])


def _stack(batch: pa.RecordBatch, names, i: int) -> np.ndarray:
    return np.stack([batch.column(c)[i].values.to_numpy() for c in names], axis=-1)


def nearest(lab: np.ndarray, tints: np.ndarray) -> np.ndarray:
    """The place in `tints` that is closest in OKLab to each colour; ties: the first."""
    d = ((lab[:, None] - tints) ** 2).astype(float)
    return np.round(d[..., 0] + d[..., 1] + d[..., 2], 9).argmin(axis=1)


def blended(pixels: DataFrame, palette: DataFrame, radius: int = 3, preference: float = 0.1, opaque: int = 128) -> DataFrame:
    """(image_id, width, labels, names, p_l, p_m, p_n): an image's labels by `sided`, row by row, and its palette's; an image a row.

    Pixels meet their palette an image at a time, so pixels that are by images in their tasks, as drawn ones are, are not moved.
    """
    flat = flat_mask(pixels, opaque=opaque)
    p = flat.select(F.col("image_id").cast("long").alias("image_id"), *[F.col(c).cast("int").alias(c) for c in "xyrgb"], *"lmn", F.coalesce("flat", F.lit(False)).alias("flat"), F.coalesce(F.col("a") >= opaque, F.lit(False)).alias("solid"))
    q = palette.select(F.col("image_id").cast("long").alias("image_id"), F.col("label").cast("long").alias("label"), *[F.col(c).cast("double").alias(c) for c in "rgblmn"])

    def run(key, left, right):
        names = ["image_id", "width", "labels", "names", "p_l", "p_m", "p_n"]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names)
        of = lambda t, columns: np.stack([t.column(c).to_numpy() for c in columns], axis=-1)
        x, y = left.column("x").to_numpy(), left.column("y").to_numpy()
        rows, w = np.lexsort([x, y]), int(x.max()) + 1
        rgb, lab = of(left, "rgb")[rows], of(left, "lmn")[rows]
        flat, solid = (left.column(c).to_numpy()[rows].reshape(-1, w) for c in ("flat", "solid"))
        by_label = right.sort_by("label")
        known, colours, tints = by_label.column("label").to_numpy(), of(by_label, "rgb"), of(by_label, "lmn")
        _, first, which = np.unique(rgb @ np.array([65536, 256, 1]), return_index=True, return_inverse=True)
        own = nearest(lab[first], tints)[which].reshape(-1, w)
        found = sided(rgb.reshape(-1, w, 3) / 255, lab.reshape(-1, w, 3), own, flat, solid, colours / 255, tints, radius, preference)
        label = np.where(found < 0, -1, known[found]).ravel()
        values = [[key[0].as_py()], [w], [label], [known], *[[tints[:, k]] for k in range(3)]]
        return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    kind = "image_id long, width int, labels array<long>, names array<long>, p_l array<double>, p_m array<double>, p_n array<double>"
    return p.groupBy("image_id").cogroup(q.groupBy("image_id")).applyInArrow(run, kind)


def blend_labels(pixels: DataFrame, palette: DataFrame, radius: int = 3, preference: float = 0.1, opaque: int = 128) -> DataFrame:
    """(image_id, x, y, label) of pixels (image_id, x, y, r, g, b, a) by `sided`; images without a palette have no row.

    `palette` is (image_id, label, r, g, b, l, m, n).
    """
    each = blended(pixels, palette, radius, preference, opaque).select("image_id", "width", F.posexplode("labels").alias("i", "label"))
    return each.select("image_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), "label")


def labels_of(pictures: Pictures, radius: int = 3, preference: float = 0.1, opaque: int = 128) -> DataFrame:
    """`blend_labels` of pictures in the tasks that have them, piles of them at a time."""

    def run(pile):
        label = kernels.mixed(pile, radius, preference, opaque)[0]
        k, y, x = np.indices(label.shape, np.int32).reshape(3, -1)
        yield kernels.placed(pile, (k, y, x), {"label": np.where(label.ravel() < 0, -1, pile.names[k, label.ravel()])})

    return pictures.map(run, "image_id long, x int, y int, label long")


def merged_sizes(pictures: Pictures, min_area: int = 2, most: int = 6000, hard: int = 40000, radius: int = 3, preference: float = 0.1, opaque: int = 128) -> DataFrame:
    """(image_id, label, n, n_regions): pixels and regions of each label of pictures, after `blended` and `merged`."""

    def run(pile):
        for k, label in enumerate(kernels.mixed(pile, radius, preference, opaque)[0]):
            tints = pile.tints[k]

            def apart(p, q, tints=tints):
                return float(np.round(((tints[p] - tints[q]) ** 2).sum(), 12)) if p >= 0 and q >= 0 else np.inf

            grid = within_budget(label, min_area, most, hard, apart)
            roots = component_roots(grid)
            found, n = np.unique(grid, return_counts=True)
            firsts = grid.ravel()[np.unique(roots)]
            names = np.where(found < 0, -1, pile.names[k, found])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), pile.ids[k])), pa.array(names), pa.array(n), pa.array([int((firsts == v).sum()) for v in found], pa.int64())], ["image_id", "label", "n", "n_regions"])

    return pictures.map(run, "image_id long, label long, n long, n_regions long")


def merged(images: DataFrame, min_area: int = 2, most: int = 6000, hard: int = 40000) -> DataFrame:
    """(image_id, width, labels) of rows as `blended` has them, after `regions.within_budget`, where the closer colour in OKLab breaks ties."""

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                w, known, tints = b.column("width")[i].as_py(), b.column("names")[i].values.to_numpy(), _stack(b, ["p_l", "p_m", "p_n"], i)
                place = {int(k): t for k, t in zip(known, tints, strict=True)}

                def apart(p, q, place=place):
                    return float(np.round(((place[p] - place[q]) ** 2).sum(), 12)) if p in place and q in place else np.inf

                out.append(within_budget(b.column("labels")[i].values.to_numpy().reshape(-1, w), min_area, most, hard, apart).ravel().astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("width"), pa.array(out, pa.list_(pa.int64()))], ["image_id", "width", "labels"])

    return images.mapInArrow(run, "image_id long, width int, labels array<long>")


def merged_rows(images: DataFrame, palette: DataFrame, min_area: int = 2, most: int = 6000, hard: int = 40000) -> DataFrame:
    """`merged` of images as `regions.dense` rows, with a palette."""
    return merged(images.join(_palettes(palette).hint("merge"), "image_id"), min_area, most, hard)


def merged_labels(labels: DataFrame, palette: DataFrame, min_area: int = 2, most: int = 6000, hard: int = 40000) -> DataFrame:
    """(image_id, x, y, label) of labels (image_id, x, y, label) by `merged`."""
    each = merged_rows(dense(labels), palette, min_area, most, hard).select("image_id", "width", F.posexplode("labels").alias("i", "label"))
    return each.select("image_id", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), "label")
