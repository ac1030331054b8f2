"""Traces of many small pictures: sides are cut in piles of pictures, boundaries are sorted, pixels are gathered once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions import color
from rastermill.operators import curves
from rastermill.operators.regions import component_roots

RNG = np.random.default_rng(5)
PICTURES = [RNG.integers(-1, 3, (h, w)) for h in (1, 3, 8) for w in (1, 2, 8) for _ in range(3)] + [np.full((8, 8), -1), np.zeros((3, 2), int)]


def plain(k, grid):
    return [(k, p, q, closed, tuple(c[:, 0].tolist()), tuple(c[:, 1].tolist())) for p, q, closed, c in curves.chains(component_roots(grid))]


@pytest.mark.parametrize("together", [1, 100, 1 << 18])
def test_piles_have_the_chains_of_each_picture(monkeypatch, together):
    monkeypatch.setattr(curves, "TOGETHER", together)
    rows = curves.chain_rows([7 * k for k in range(len(PICTURES))], PICTURES).to_pylist()
    got = sorted((r["image_id"], r["left"], r["right"], r["closed"], tuple(r["xs"]), tuple(r["ys"])) for r in rows)
    assert got == sorted(c for k, grid in enumerate(PICTURES) for c in plain(7 * k, grid))
    assert len({(r["image_id"], r["chain"]) for r in rows}) == len(rows)
    assert curves.chain_rows([], []).num_rows == 0


def test_every_side_is_in_one_chain():
    for grid in PICTURES:
        roots = component_roots(grid)
        p = np.pad(roots, 1, constant_values=-1)
        sides = (p[1:, 1:-1] != p[:-1, 1:-1]).sum() + (p[1:-1, 1:] != p[1:-1, :-1]).sum()
        assert sides == sum(len(c) - (not closed) for *_, closed, c in curves.chains(roots))
        for left, right, _, c in curves.chains(roots):  # the first step has its regions on its sides
            (x, y), (u, v) = c[0], c[1 % len(c)]
            dx, dy = u - x, v - y
            cells = {(1, 0): ((y, x + 1), (y + 1, x + 1)), (0, 1): ((y + 1, x + 1), (y + 1, x)), (-1, 0): ((y + 1, x), (y, x)), (0, -1): ((y, x), (y, x + 1))}[dx, dy]
            assert (left, right) == tuple(p[at] for at in cells)


@pytest.fixture(scope="module")
def pictures(spark):
    r = np.random.default_rng(8)
    rows = [(k, x, y, *r.integers(0, 256, 3).tolist(), int(r.integers(-1, 3))) for k in range(6) for y in range(7) for x in range(5 + k % 2)]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, label long")


def test_regions_go_on_from_batch_to_batch(spark, pictures):
    fitted = curves.fitted_chains(curves.region_chains(pictures), points=False)
    assert "xs" not in fitted.columns
    found = curves.region_loops(fitted)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(str, found.collect()))
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, curves.region_loops(fitted).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    areas = {(r.image_id, r.region): sum(v.area for v in r.loops) for r in found.collect()}
    grids = {k: np.array([v for *_, v in sorted((r.y, r.x, r.label) for r in pictures.where(F.col("image_id") == k).collect())]).reshape(7, -1) for k in range(6)}
    for k, grid in grids.items():
        ids, n = np.unique(component_roots(grid), return_counts=True)
        assert {i: areas[k, i] for i in ids.tolist()} == dict(zip(ids.tolist(), n.tolist(), strict=True))
    assert len(areas) == sum(len(np.unique(component_roots(g))) for g in grids.values())


@pytest.mark.parametrize("stacked", [True, False])
def test_pixels_with_labels_are_gathered_once(pictures, stacked):
    drawn = curves.traced(pictures, stacked=stacked)
    shown = drawn._jdf.queryExecution().executedPlan().toString()
    assert "rastermill-regions-" in shown and "y#" not in shown.replace("xy#", "")  # no pixel is read or moved any more
    pixels, labels = pictures.drop("label"), pictures.select("image_id", "x", "y", "label")
    apart = curves.traced(pixels, labels, stacked=stacked)
    assert sorted(drawn.collect()) == sorted(apart.collect()) and drawn.count() == 6


def test_regions_have_mean_colours(pictures):
    k, grid = 0, np.array([v for *_, v in sorted((r.y, r.x, r.label) for r in pictures.where("image_id = 0").collect())]).reshape(7, -1)
    rgb = np.array([v for *_, v in sorted((r.y, r.x, (r.r, r.g, r.b)) for r in pictures.where("image_id = 0").collect())])
    roots = component_roots(grid).ravel()
    want = set()
    for i in np.unique(roots):
        if grid.ravel()[i] >= 0:
            full = "".join(f"{int(np.floor(v + 0.5)):02x}" for v in rgb[roots == i].mean(axis=0))
            want.add("#" + (full[::2] if full[::2] == full[1::2] else full))
    svg = curves.traced(pictures.where("image_id = 0"), stacked=False).first().svg
    assert {s.split('"')[0] for s in svg.split('fill="')[1:]} == want


def test_hex_colours(spark):
    rows = [(r, g, b) for r in (0, 1, 15, 16, 17, 34, 170, 200, 255) for g in (0, 17, 18, 255) for b in (0, 9, 17, 238, 255)] + [(None, 1, 2)]
    for r, g, b, got in spark.createDataFrame(rows, "r int, g int, b int").withColumn("c", color.hex_colour(F.col("r"), F.col("g"), F.col("b"))).collect():
        full = None if r is None else f"{r:02x}{g:02x}{b:02x}"
        assert got == (full and "#" + (full[::2] if full[::2] == full[1::2] else full))
