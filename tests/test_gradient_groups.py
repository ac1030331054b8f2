import numpy as np

from rastermill.operators import gradients


def sums_of(x, y, rgb):
    return np.array([len(x), x.sum(), y.sum(), (x * x).sum(), (x * y).sum(), (y * y).sum(), *(k for c in rgb.T for k in (c.sum(), (c * x).sum(), (c * y).sum(), (c * c).sum()))], float)


def test_a_plane_equals_least_squares():
    rng = np.random.default_rng(4)
    x, y = (v.ravel().astype(float) for v in np.meshgrid(np.arange(9), np.arange(7)))
    rgb = np.round(np.outer(x, [3, 5, 1]) + np.outer(y, [2, 0, 4]) + rng.normal(0, 4, (63, 3)))
    m = np.stack([x, y, np.ones(63)], 1)
    off = rgb - m @ np.linalg.lstsq(m, rgb, rcond=None)[0]
    assert abs(gradients.plane(sums_of(x, y, rgb))[0] - np.sqrt((off**2).mean()) / 255) < 1e-9
    assert gradients.plane(sums_of(x[:1], y[:1], rgb[:1])) == (0.0, 0.0)


def test_strips_of_one_ramp_are_a_group_and_another_ramp_is_not():
    y, x = (v.ravel().astype(float) for v in np.mgrid[:8, :8])
    strips = []
    for k in range(4):
        across = x + 8 * k
        colour = np.outer(across * 4, [1, 1, 1]) if k < 3 else np.outer(200 - y * 9, [1, 0, 1])
        strips.append(sums_of(across, y, np.round(colour)))
    assert gradients.merged(np.array(strips), [(1, 2), (2, 3), (0, 1)], 0.02) == [0, 0, 0, 3]
    assert gradients.merged(np.array(strips), [], 0.02) == [0, 1, 2, 3]


def test_groups_of_a_table(spark):
    rows = [(1, x, y, x * 4, x * 4, x * 4, x // 8, 2) for x in range(16) for y in range(8)] + [(2, x, y, 9, 9, 9, 0, 2) for x in range(8) for y in range(8)]
    p = spark.createDataFrame(rows, "image_id long, x int, y int, r int, g int, b int, region long, distance int")
    pairs = spark.createDataFrame([(1, 0, 1, 8)], "image_id long, low long, high long, border long")
    got = gradients.merged_ramps(gradients.ramp_sums(p), pairs).collect()
    assert sorted((r["image_id"], r["region"], r["grp"], r["n"]) for r in got) == [(1, 0, 0, 64), (1, 1, 0, 64)]
    assert gradients.merged_ramps(gradients.ramp_sums(p.limit(0)), pairs).count() == 0
