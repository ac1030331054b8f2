"""Ramps inside regions, borders, sizes and path text, each against plain loops or known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastermill.functions import sizing
from rastermill.operators import edges, gradients, images, markup, regions


def frame(spark, grid, colour, label="region"):
    h, w = grid.shape
    rows = [(1, x, y, *(int(v) for v in colour(x, y)), 255, int(grid[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, f"image_id long, x int, y int, r int, g int, b int, a int, {label} long")


def test_edge_distance_equals_the_plain_search(spark):
    grid = np.random.default_rng(3).integers(0, 12, (9, 11)) // 11
    got = {(r.x, r.y): r.distance for r in gradients.edge_distance(frame(spark, grid, lambda x, y: (0, 0, 0)), cap=4).collect()}
    h, w = grid.shape
    edge = [(x, y) for y in range(h) for x in range(w) if any(0 <= x + i < w and 0 <= y + j < h and grid[y + j, x + i] != grid[y, x] for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))]
    assert edge
    for (x, y), d in got.items():
        assert d == min([4] + [1 + max(abs(x - i), abs(y - j)) for i, j in edge])


def test_a_linear_ramp_is_found_and_kept_in_two_stops(spark):
    p = gradients.edge_distance(frame(spark, np.zeros((12, 20)), lambda x, y: (10 + 8 * x, 100, 200 - 6 * x)))
    linear = gradients.linear_ramps(p)
    fit = linear.where(gradients.has_ramp()).first()
    assert abs(abs(fit.ux) - 1) < 1e-9 and fit.rms < 1e-6 and abs(fit.slope_r * fit.ux - 8 / 255) < 1e-9
    placed = gradients.along_axis(p, linear)
    stops = gradients.linear_stops(gradients.profile(placed, bins=10), linear, bins=10)
    s = stops.first().stops
    assert len(s) == 2 and s[0].offset == 0 and s[1].offset == 1
    kept = gradients.fill_errors(placed, stops).first()
    assert kept.kept and kept.gradient_error < kept.flat_error / 10


def test_flat_and_noisy_regions_have_no_ramp(spark):
    rng = np.random.default_rng(1)
    p = gradients.edge_distance(frame(spark, np.zeros((12, 12)), lambda x, y: rng.integers(0, 256, 3)))
    assert gradients.linear_ramps(p).where(gradients.has_ramp()).count() == 0
    flat = gradients.edge_distance(frame(spark, np.zeros((1, 30)), lambda x, y: (7, 7, 7)))  # a line spans no plane
    assert gradients.linear_ramps(flat).first().ramp == 0
    assert gradients.linear_ramps(flat.where("false")).count() == 0


def test_a_radial_ramp_beats_the_plane(spark):
    p = gradients.edge_distance(frame(spark, np.zeros((21, 21)), lambda x, y: (round(240 - 15 * np.hypot(x - 10, y - 10)), 50, 50)))
    got = gradients.radial_ramps(p, gradients.linear_ramps(p)).first()
    assert got.accepted and abs(got.slope_r * 255 + 15) < 0.1 and abs(got.radius - np.hypot(10, 10)) < 1e-6


def test_simplified_stops_stay_within_the_tolerance():
    rng = np.random.default_rng(5)
    stops = [(i / 23, *np.cumsum(rng.normal(0, 3, 3))) for i in range(24)]
    few = gradients.simplified(stops, 3.0)
    assert few[0] == stops[0] and few[-1] == stops[-1] and len(few) < len(stops)
    for o, *c in stops:
        for k in range(3):
            assert abs(np.interp(o, [s[0] for s in few], [s[k + 1] for s in few]) - c[k]) <= 3.0 + 1e-9
    assert gradients.simplified(stops[:1], 3.0) == stops[:1]


def test_colour_between_and_beyond_stops(spark):
    stops = "array(named_struct('offset', 0.2D, 'r', 10D, 'g', 0D, 'b', 0D), named_struct('offset', 0.6D, 'r', 50D, 'g', 0D, 'b', 0D))"
    d = spark.sql(f"select {stops} as s, explode(array(0D, 0.2D, 0.3D, 0.6D, 1D)) as t")
    assert [round(r.c, 9) for r in d.select(gradients.colour_at(F.col("s"), F.col("t"), "r").alias("c")).collect()] == [10, 10, 20, 50, 50]


def test_a_blended_sliver_dissolves_and_a_stroke_stays(spark):
    def run(tint):
        tints = {0: (0, 0, 0), 1: tint, 2: (250, 250, 250)}
        grid = np.array([[0, 0, 0, 1, 2, 2, 2]] * 5)
        p = frame(spark, grid, lambda x, y: tints[grid[y, x]], "label").withColumn("region", F.col("label"))
        palette = spark.createDataFrame([(1, k, *v) for k, v in tints.items()], "image_id long, label long, r int, g int, b int")
        return {r.label for r in edges.dissolve(p, palette, 0.8).where("x = 3").collect()}

    assert run((60, 60, 60)) == {0} and run((200, 200, 200)) == {2}
    assert run((250, 0, 0)) == {1}


def test_gaps_need_opaque_surroundings(spark):
    p = frame(spark, np.zeros((7, 7)), lambda x, y: (0, 0, 0))
    holed = p.withColumn("a", F.when(F.expr("x = 3 and y = 3 or x = 0"), 0).otherwise(255))
    assert tuple(edges.gap_pixels(p, holed).first()) == (1, 49, 1)
    assert edges.gap_pixels(holed, holed).first().gaps == 0


def test_junction_moves_to_the_crossing_of_its_lines(spark):
    rows = [(1, 5.0, 5.0, 1.0, 0.0, 9.0, 5.4, 400), (1, 5.0, 5.0, 0.0, 1.0, 4.7, 9.0, 400), (1, 0.0, 5.0, 1.0, 0.0, 3.0, 5.2, 400), (1, 0.0, 5.0, 0.0, 1.0, 0.5, 3.0, 400)]
    ends = spark.createDataFrame(rows, "image_id long, jx double, jy double, dx double, dy double, cx double, cy double, support int")
    got = {r.jx: (r.x, r.y) for r in edges.refine_junctions(ends, spark.createDataFrame([(1, 10, 10)], "image_id long, width int, height int")).collect()}
    assert got[5.0] == pytest.approx((4.7, 5.4), abs=1e-3) and got[0.0] == pytest.approx((0.0, 5.2), abs=1e-3)


def test_short_numbers(spark):
    d = spark.sql("select explode(array(0.5D, -0.5D, 10D, 0D, -0.0001D, 12.34D, 100D)) as v")
    assert [r.t for r in d.select(sizing.path_number(F.col("v"), 2).alias("t")).collect()] == [".5", "-.5", "10", "0", "0", "12.34", "100"]


def test_structure_counts_implicit_segments(spark):
    svg = '<svg><path fill="red" d="m1 2 3 4h5v-6z"/><path d="M0 0c1 1 2 2 3 3 4 4 5 5 6 6-1-1-.5.5 7 7z"/><path fill="none" d="m0 0h9"/></svg>'
    got = markup.path_structure(spark.createDataFrame([(1, svg), (2, ""), (3, None)], "id long, svg string"), "id", "svg").orderBy("id").collect()
    assert tuple(got[0])[2:] == (2, 6, 3) and tuple(got[1])[1:] == (0, 0, 0, 0)


def test_empty_paths_and_groups_go(spark):
    d = spark.createDataFrame([('<svg><g><g id="a"> </g></g><path fill="x" d=" "/><path d="m0 0z"/></svg>',)], "t string")
    assert d.select(markup.cleaned(F.col("t")).alias("t")).first().t == '<svg><path d="m0 0z"/></svg>'


def test_a_radial_ramp_becomes_stops_and_text(spark):
    grid = np.zeros((21, 21))
    p = gradients.edge_distance(frame(spark, grid, lambda x, y: (round(240 - 12 * np.hypot(x - 10, y - 10)), 60, 60)))
    linear = gradients.linear_ramps(p)
    radial = gradients.radial_ramps(p, linear)
    assert radial.first().accepted
    stops = gradients.radial_stops(gradients.profile(gradients.around_centre(p, radial), bins=8), radial, bins=8)
    s = stops.first().stops
    assert s[0].offset == 0 and s[-1].offset == 1 and abs(s[0].r - 240) < 3 and abs(s[-1].r - (240 - 12 * np.hypot(10, 10))) < 3 and len(s) <= 4
    fills = stops.join(radial, ["image_id", "region"]).withColumns({"shape": F.lit("radial"), "place": F.array(F.col("cx") + 0.5, F.col("cy") + 0.5, "radius")})
    text = markup.gradient_definitions(fills).first().defs
    assert text.startswith('<defs><radialGradient id="g0" gradientUnits="userSpaceOnUse" cx="10.5" cy="10.5" r="14.14"><stop offset="0" stop-color="#') and text.endswith("</radialGradient></defs>")


def test_definitions_are_numbered_by_region_and_short(spark):
    fill = "image_id long, region long, shape string, place array<double>, stops array<struct<offset: double, r: double, g: double, b: double>>"
    rows = [(1, 9, "linear", [0.0, -0.001, 12.345, 3.0], [(0.0, 255.0, 0.0, 17.0), (0.6666, 1.4, 1.5, 300 / 3)]), (1, 2, "radial", [1.0, 2.0, 3.5], [(1.0, 0.0, 0.0, 0.0)])]
    got = markup.gradient_definitions(spark.createDataFrame(rows, fill)).first().defs
    assert got == (
        '<defs><radialGradient id="g0" gradientUnits="userSpaceOnUse" cx="1" cy="2" r="3.5"><stop offset="1" stop-color="#000"/></radialGradient>'
        '<linearGradient id="g1" gradientUnits="userSpaceOnUse" x1="0" y1="0" x2="12.35" y2="3"><stop offset="0" stop-color="#f01"/><stop offset="0.667" stop-color="#010264"/></linearGradient></defs>'
    )
    assert markup.gradient_definitions(spark.createDataFrame([], fill)).count() == 0


@pytest.mark.parametrize("factor", [1, 2, 3, 4])
def test_masks_grow_strictly(spark, factor):
    mask = np.random.default_rng(factor).random((4, 5)) < 0.7
    rows = [(1, x, y, bool(mask[y, x])) for y in range(4) for x in range(5)]
    got = {(r.x, r.y): r.mask for r in images.upscale_mask(spark.createDataFrame(rows, "image_id long, x int, y int, mask boolean"), factor).collect()}
    lower = lambda v, n: (max(0, int(np.floor((v + 0.5) / factor - 0.5))), n - 1)
    assert len(got) == 20 * factor * factor
    for (x, y), v in got.items():
        (a, w), (b, h) = lower(x, 5), lower(y, 4)
        taps = mask[b, a] & mask[b, min(w, a + 1)] & mask[min(h, b + 1), a] & mask[min(h, b + 1), min(w, a + 1)]
        assert v == (mask[y, x] if factor == 1 else taps)


def test_varying_regions_form_groups(spark):
    varying = spark.createDataFrame([(1, r) for r in (1, 2, 3, 5, 6, 9)] + [(2, 1)], "image_id long, region long")
    pairs = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 6), (1, 8, 9), (2, 1, 3)], "image_id long, low long, high long")
    assert {(r.image_id, r.region): r.grp for r in regions.varying_groups(varying, pairs).collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 5): 5, (1, 6): 5}


def test_a_ramp_straight_up_keeps_the_sign_of_zero(spark, tmp_path):
    """Colours that all fall from row to row, and one that doesn't: the direction is the SQL's, whichever sign its zero has."""
    import duckdb

    from rastermill.plans import queries

    falling, mixed = [0.2, 0.1, 0.0, -0.1, -0.18, 0.0, 0.0, 0.0], [0.1, 0.0, 0.1, 0.0, -0.1, 0.1, 0.2, 0.2]
    con, at = duckdb.connect(), tmp_path / "embeddings.parquet"
    rows = ", ".join(f"({i}, 0, {[v for v in rows for _ in range(8)]}::float[])" for i, rows in enumerate((falling, mixed)))
    con.execute(f"copy (select * from (values {rows}) t(vec_id, label, embedding)) to '{at}' (format parquet)")
    con.execute(f"create view embeddings as select * from '{at}'")
    for name in ("gradient_profile", "gradient_definitions", "gradient_linear_ramps"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
        assert want and sorted(map(tuple, got.collect())) == sorted(want)
