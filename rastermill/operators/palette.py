"""A palette for each image from its OKLab cells: seeds, a few rounds of means, then merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS, MOST_SEEDS = 6, 1025
#: Colours that leave a task together.
TOGETHER = 1 << 12


def cluster(weight: np.ndarray, sums: np.ndarray, squares: np.ndarray, most: int = 48, reach: float = 0.05, least: float = 0.001) -> list[np.ndarray]:
    """Clusters as arrays (weight, three OKLab sums, three sRGB sums, squares), the heaviest first.

    Cells come heaviest first. One seeds a centre if it is farther than `reach` from all before; six rounds
    of weighted means follow; clusters of less than the share `least` go, unless all would; then the pair
    whose merging costs least in Ward's sense merges, until at most `most` are left and the pair is farther
    than `reach` apart. Well separated pairs don't merge once few enough are left.
    """
    at = sums[:, :3] / weight[:, None]
    centres = at[:1]
    for p in at[1:]:
        if len(centres) >= MOST_SEEDS:
            break
        if ((centres - p) ** 2).sum(axis=1).min() > reach * reach:
            centres = np.vstack([centres, p])
    parts = np.column_stack([weight, sums, squares])
    for _ in range(ROUNDS):
        near = ((at[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        groups = np.zeros((len(centres), parts.shape[1]))
        np.add.at(groups, near, parts)
        groups = groups[groups[:, 0] > 0]
        centres = groups[:, 1:4] / groups[:, :1]
    heavy = groups[:, 0] >= max(1.0, weight.sum() * least)
    groups = groups[heavy] if heavy.any() else groups
    total = weight.sum()
    while len(groups) > 1:
        w, c = groups[:, 0], groups[:, 1:4] / groups[:, :1]
        d2 = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        cost = w[:, None] * w[None] / (w[:, None] + w[None]) * d2
        if len(groups) <= most:
            spread = np.sqrt(np.maximum(0, groups[:, 7] / w - (c * c).sum(axis=1)))
            large = w >= 0.005 * total
            apart = large[:, None] & large[None] & (d2 >= reach * reach / 4) & (np.sqrt(d2) > 3 * (spread[:, None] + spread[None]))
            cost[apart] = np.inf
        cost[np.tril_indices(len(groups))] = np.inf
        i, j = np.unravel_index(int(cost.argmin()), cost.shape)
        if not np.isfinite(cost[i, j]) or len(groups) <= most and d2[i, j] > reach * reach:
            break
        groups[i] += groups[j]
        groups = np.delete(groups, j, axis=0)
    return sorted(groups, key=lambda g: -g[0])


def extract(bins: DataFrame, most: int = 48, reach: float = 0.05) -> DataFrame:
    """(image_id, label, weight, l, m, n, r, g, b) from `images.palette_bins`: cells shrink an image to at
    most a few thousand rows before one task clusters it."""
    sums = [f"sum_{c}" for c in ("l", "m", "n", "r", "g", "b")]
    order = F.struct((-F.col("weight")).alias("o"), "bin_l", "bin_m", "bin_n", F.col("weight").cast("double").alias("w"), *[F.col(c).cast("double").alias(c) for c in sums], "sum_sq")
    images = bins.groupBy("image_id").agg(F.array_sort(F.collect_list(order)).alias("c")).select("image_id", *[F.col(f"c.{k}").alias(k) for k in ("w", *sums, "sum_sq")])

    def rows(done: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        n = [len(g) for _, g in done]
        g = np.concatenate([g for _, g in done])
        means = g[:, 1:7] / g[:, :1]
        columns = [np.repeat(np.array([i for i, _ in done], np.int64), n), np.concatenate([np.arange(k, dtype=np.int32) for k in n]), g[:, 0], *means[:, :3].T, *np.floor(means[:, 3:] + 0.5).T]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["image_id", "label", "weight", "l", "m", "n", "r", "g", "b"])

    def run(batches):
        done, held = [], 0
        for t in batches:
            for i in range(t.num_rows):
                w, *s, q = (t.column(k)[i].values.to_numpy() for k in ("w", *sums, "sum_sq"))
                done.append((t.column("image_id")[i].as_py(), np.stack(cluster(w, np.stack(s, axis=1), q, most, reach))))
                held += len(done[-1][1])
                if held >= TOGETHER:
                    yield rows(done)
                    done, held = [], 0
        if done:
            yield rows(done)

    return images.mapInArrow(run, "image_id long, label int, weight double, l double, m double, n double, r double, g double, b double")
