import numpy as np

from rastermill.operators import labelling, regions


def one_by_one(rgb, lab, own, flat, opaque, colours, tints, radius, preference):
    h, w = own.shape
    out = np.where(opaque, own, -1)

    def mixed(p, pairs):
        best = (np.inf, -1)
        for a, b in pairs:
            way = colours[b] - colours[a]
            t = min(1.0, max(0.0, float((p - colours[a]) @ way / (way @ way)) if way @ way else 0.0))
            off = round(float(np.linalg.norm(colours[a] + t * way - p)), 9)
            if off < best[0]:
                best = (off, a if round(t, 9) < 0.5 else b)
        return best

    for y in range(h):
        for x in range(w):
            if not opaque[y, x] or flat[y, x]:
                continue
            near = set()
            for r in (radius, 2 * radius, 4 * radius):
                stride = max(2 if radius >= 6 else 1, r // 4 if r >= 6 else 1)
                if not near:
                    near = {int(own[y + b, x + a]) for b in range(-r, r + 1, stride) for a in range(-r, r + 1, stride) if 0 <= y + b < h and 0 <= x + a < w and flat[y + b, x + a]}
            if not near:
                continue
            mine, p, near = own[y, x], rgb[y, x], sorted(near)
            alone = round(float(np.linalg.norm(p - colours[mine])), 9)
            pairs = [(a, b) for a in near for b in near if a < b]
            if len(near) == 1 and mine not in near:
                pairs = [(near[0], b) for b in range(len(colours)) if b != near[0]]
            off, label = mixed(p, pairs)
            if (off < 0.06 and off <= alone + 0.02) if mine in near else (off < 0.15 and off < alone):
                out[y, x] = label
            elif mine not in near:
                d, k = min((round(float(((lab[y, x] - tints[c]) ** 2).sum()), 9), c) for c in near)
                if d < preference**2:
                    out[y, x] = k
    return out


def test_sides_equal_one_by_one():
    rng = np.random.default_rng(11)
    moved = 0
    for radius, k, share in ((1, 3, 0.1), (2, 5, 0.03), (3, 70, 0.05), (6, 4, 0.01), (1, 2, 0.0), (1, 1, 0.5)):
        for _ in range(4):
            h, w = rng.integers(1, 14, 2)
            colours = rng.random((k, 3))
            own = rng.integers(0, k, (h, w))
            other = rng.integers(0, k, (h, w))
            t = rng.random((h, w, 1)) * 0.7
            rgb = np.clip(colours[own] * (1 - t) + colours[other] * t + rng.normal(0, 0.03, (h, w, 3)), 0, 1)
            own = ((rgb[:, :, None] - colours) ** 2).sum(axis=3).argmin(axis=2)
            lab, tints = rgb * 0.5, colours * 0.5
            opaque = rng.random((h, w)) > 0.1
            flat = opaque & (rng.random((h, w)) < share)
            got = labelling.sided(rgb, lab, own, flat, opaque, colours, tints, radius, 0.1)
            assert (got == one_by_one(rgb, lab, own, flat, opaque, colours, tints, radius, 0.1)).all()
            moved += int((got[opaque] != own[opaque]).sum())
    assert moved > 20


def test_a_blend_joins_the_side_it_has_more_of(spark):
    # white, a pixel of two thirds white, black: a grey close to it is a palette colour too, but nowhere around
    row = [255] * 4 + [170] + [0] * 4
    px = spark.createDataFrame([(1, x, y, v, v, v, 255) for y in range(5) for x, v in enumerate(row)] + [(2, x, 0, 9, 9, 9, 0) for x in range(3)], "image_id long, x int, y int, r int, g int, b int, a int")
    colours = [(1, 3, 255), (1, 5, 0), (1, 9, 180), (2, 4, 9)]
    from rastermill.operators.images import with_oklab

    palette = with_oklab(spark.createDataFrame([(i, k, v, v, v) for i, k, v in colours], "image_id long, label int, r int, g int, b int"))
    got = {(r["image_id"], r["x"], r["y"]): r["label"] for r in labelling.blend_labels(px, palette).collect()}
    assert len(got) == 48
    assert {got[1, x, y] for y in range(5) for x in range(5)} == {3} and {got[1, x, y] for y in range(5) for x in range(5, 9)} == {5}
    assert {got[2, x, 0] for x in range(3)} == {-1}
    assert labelling.blend_labels(px.limit(0), palette).count() == 0


def test_ties_go_to_the_closer_colour(spark):
    g = np.array([[0] * 3 + [7] + [1] * 3])
    assert regions.merge_small(g, 2)[0, 3] == 1
    assert regions.merge_small(g, 2, lambda p, q: 0 if {p, q} == {0, 7} else 1)[0, 3] == 0
    labels = spark.createDataFrame([(1, x, 0, int(v)) for x, v in enumerate(g[0])], "image_id long, x int, y int, label long")
    palette = spark.createDataFrame([(1, k, 0, 0, 0, v, 0.0, 0.0) for k, v in ((0, 0.5), (1, 0.9), (7, 0.6))], "image_id long, label int, r int, g int, b int, l double, m double, n double")
    assert [r["label"] for r in labelling.merged_labels(labels, palette).orderBy("x").collect()] == [0] * 4 + [1] * 3


def test_the_budget_coarsens_noise_but_keeps_a_pattern():
    rng = np.random.default_rng(2)
    noise = rng.integers(0, 5, (60, 60))
    n = len(np.unique(regions.component_roots(noise)))
    few = regions.within_budget(noise, 1, most=n // 3, hard=10)
    assert len(np.unique(regions.component_roots(few))) <= n // 3
    board = np.indices((40, 40)).sum(axis=0) % 2
    assert (regions.within_budget(board, 1, most=100, hard=2000) == board).all()
    assert len(np.unique(regions.component_roots(regions.within_budget(board, 1, most=100, hard=200)))) < 25
    assert (regions.within_budget(board, 1) == board).all()
