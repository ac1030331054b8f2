"""A picture from pixels to SVG text, and the polygon search on long straight runs."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions import presets
from rastermill.operators import curves, images, trace


def frame(spark, *grids):
    rows = [(k, x, y, *map(int, g[y, x])) for k, g in enumerate(grids) for y in range(g.shape[0]) for x in range(g.shape[1])]
    return spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, a int")


def picture():
    g = np.full((24, 24, 4), 255)
    g[..., :3] = 240
    g[12:, :, :3] = (30, 90, 30)
    for x in range(3, 20):
        g[5, x, :3] = (200, 20, 20)
    g[18, 18, :3] = (90, 140, 90)  # a speck
    g[:2, :2, 3] = 0
    return g


def test_details_have_their_own_paths(spark):
    flat = np.full((24, 24, 4), 255)
    flat[..., :3] = (10, 20, 200)
    drawn = {r["image_id"]: r for r in trace.trace(frame(spark, picture(), flat)).collect()}
    fills = re.findall(r'<path fill="([^"]*)"', drawn[0]["svg"])
    assert sorted(fills) == sorted(["#c81414", "#f0f0f0", "#1e5a1e"]) and drawn[0]["n_paths"] == 3
    assert re.findall(r'<path fill="([^"]*)"', drawn[1]["svg"]) == ["#0a14c8"] and 'viewBox="0 0 24 24"' in drawn[1]["svg"]
    plain = trace.trace(frame(spark, picture()), trace.Options(detail_pixels=0, thin_radius=0)).first()
    assert "#c81414" not in plain["svg"]


def test_ramps_become_gradients_where_they_are_better(spark):
    g = np.full((24, 32, 4), 255)
    g[..., :3] = 240
    x = np.arange(20)
    g[2:22, 2:22, 0], g[2:22, 2:22, 1], g[2:22, 2:22, 2] = 40 + 8 * x, 60, 200 - 6 * x
    p = frame(spark, g)
    tints = images.with_oklab(spark.createDataFrame([(0, 0, 1, 240, 240, 240), (0, 1, 1, 116, 60, 143)], "image_id long, label int, weight int, r int, g int, b int"))
    with_ramps = trace.trace(p, trace.Options(detail_pixels=0, thin_radius=0, gradients=True), tints).first()["svg"]
    assert with_ramps.count("<linearGradient") == 1 and 'fill="url(#g0)"' in with_ramps and with_ramps.index("<defs>") < with_ramps.index("<path") and 'fill="#f0f0f0"' in with_ramps
    without = trace.trace(p, trace.Options(detail_pixels=0, thin_radius=0), tints).first()["svg"]
    assert "Gradient" not in without and 'fill="#743c8f"' in without


def test_no_pixels_no_picture(spark):
    assert trace.trace(frame(spark, picture()).limit(0)).count() == 0


def test_options_come_from_modes_and_presets():
    assert trace.options_for("quick") == trace.Options(colours=32, merge=0.05)
    assert trace.options_for("professional", "sketch") == trace.Options(colours=64, merge=0.045, min_area=12, gradients=True)
    assert trace.options_for("none such", "qrCode").colours == 2 and len(presets.DEFAULTS) == 25


def ring(w, h):
    return np.array([(x, 0) for x in range(w)] + [(w, y) for y in range(h)] + [(w - x, h) for x in range(w)] + [(0, h - y) for y in range(h)])


def test_long_straight_outlines_are_quick():
    began = time.time()
    for points in (ring(2000, 2000), ring(2000, 9)):
        start, segments = curves.fit_chain(points, True, curves.Fit())
        assert 4 <= len(segments) <= 6 and curves.deviation(points, True, start, segments) <= 1
    assert time.time() - began < 5


@pytest.mark.parametrize("seed", range(6))
def test_inner_points_of_runs_change_no_polygon(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    steps = [(1, 0)] * 9 + [(0, 1)] * 2
    points = [(0, 0)]
    while len(points) < 700:
        dx, dy = steps[int(rng.integers(len(steps)))]
        for _ in range(int(rng.integers(1, 160)) if dx else 1):
            points.append((points[-1][0] + dx, points[-1][1] + dy))
    points = np.array(points)
    monkeypatch.setattr(curves, "MOST_PASSED", 10**6)
    few = curves.polygon(points, 0.5)
    assert len(curves.corner_candidates(points)) < len(points)
    monkeypatch.setattr(curves, "RUN_ENDS", 10**6)
    every = curves.polygon(points, 0.5)
    assert len(curves.corner_candidates(points)) == len(points)
    assert len(every) <= len(few) <= len(every) + 2


def test_sampled_pixels_and_palette_support(spark):
    p = frame(spark, np.full((30, 50, 4), 255), np.full((3, 3, 4), 255))
    assert {r["image_id"]: r["n"] for r in images.sampled(p, 100).groupBy("image_id").agg(F.count("*").alias("n")).collect()} == {0: 10 * 17, 1: 9}
    s = {r["image_id"]: r["use_all"] for r in images.palette_support(images.flat_mask(p)).collect()}
    assert s == {0: False, 1: True} and images.palette_pixels(p).count() == 1509
