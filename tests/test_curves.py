"""Chains, polygons and curves against brute force on small shapes."""

import itertools
import random

import numpy as np
import pytest

from rastermill.operators import curves
from rastermill.operators.regions import component_roots


def grids(seed, n=12, size=9):
    rng = np.random.default_rng(seed)
    for _ in range(n):
        yield component_roots(rng.integers(0, 3, (size, size + 2)))


def test_chains_cover_every_side_once():
    for grid in grids(1):
        h, w = grid.shape
        p = np.pad(grid, 1, constant_values=-1)
        want = {((x, y), (x + 1, y)) for y in range(h + 1) for x in range(w) if p[y, x + 1] != p[y + 1, x + 1]} | {((x, y), (x, y + 1)) for y in range(h) for x in range(w + 1) if p[y + 1, x] != p[y + 1, x + 1]}
        degree = {}
        for a, b in want:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        seen = []
        for left, right, closed, points in curves.chains(grid):
            walk = [tuple(q) for q in points.tolist()]
            walk += walk[:1] if closed else []
            seen += [tuple(sorted(e)) for e in itertools.pairwise(walk)]
            assert left != right and all(degree[q] == 2 for q in walk[1:-1]) and (closed or degree[walk[0]] > 2 < degree[walk[-1]])
            for (x1, y1), (x2, y2) in itertools.pairwise(walk):  # the regions on both sides never change
                mx, my, dx, dy = (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1
                at = lambda s: p[int(my + s * dx / 2 + 1), int(mx - s * dy / 2 + 1)]
                assert (at(-1), at(1)) == (left, right)
        assert len(seen) == len(set(seen)) and set(seen) == {tuple(sorted(e)) for e in want}


def stairs(seed):
    rng = random.Random(seed)
    points, way = [(0, 0)], rng.randrange(2)
    for _ in range(rng.randrange(3, 14)):
        way = way if rng.random() < 0.6 else 1 - way
        x, y = points[-1]
        points.append((x + 1, y) if way == 0 else (x, y + 1))
    return np.array(points)


def straight(points, i, j, off):
    """Whether all between are close to the directions by which the side may leave: by each point's own cone."""
    d = points[j] - points[i]
    for k in range(i + 1, j):
        e = points[k] - points[i]
        if abs(d[0] * e[1] - d[1] * e[0]) > off * np.hypot(*d) + 1e-9 and np.hypot(*e) > off or d @ e <= 0 and np.hypot(*e) > off:
            return False
    return True


@pytest.mark.parametrize("seed", range(40))
def test_polygon_has_the_fewest_sides(seed):
    points = stairs(seed)
    n, reach, sums = len(points), curves.straight_reach(points, 0.55), curves.prefix_sums(points)
    assert all(straight(points, i, int(reach[i]), 0.55) for i in range(n - 1))
    got = curves.polygon(points, 0.55)
    assert got[0] == 0 and got[-1] == n - 1 and all(b <= reach[a] for a, b in itertools.pairwise(got))

    def penalty(corners):
        return sum(float(curves.side_penalty(sums, points, np.array([a]), b)[0]) for a, b in itertools.pairwise(corners))

    best = None
    for k in range(n):
        every = [(0, *mid, n - 1) for mid in itertools.combinations(range(1, n - 1), k)]
        ways = [c for c in every if all(b <= reach[a] for a, b in itertools.pairwise(c))]
        if ways:
            best = min(map(penalty, ways))
            assert len(got) == k + 2
            break
    assert np.isclose(penalty(got), best)


def test_long_and_short_chains_reach_alike():
    for seed in range(30):
        points = np.vstack([stairs(seed), stairs(seed + 100)[1:] + stairs(seed)[-1], stairs(seed + 200)[1:] + stairs(seed)[-1] + stairs(seed + 100)[-1]])
        long = np.vstack([points + k * (points[-1] - points[0]) for k in range(4)])
        long = long[np.r_[True, (np.diff(long, axis=0) != 0).any(axis=1)]]
        assert len(long) > 48 or len(points) < 16
        assert (curves.straight_reach(long, 0.9) == curves._short_reach(long.astype(float).tolist(), 0.9)).all()


def test_penalty_and_lines_equal_plain_sums():
    points = stairs(3).astype(float)
    n = len(points)
    d = points[-1] - points[0]
    mid = (points[0] + points[-1]) / 2
    plain = np.sqrt(sum(((p - mid)[0] * -d[1] + (p - mid)[1] * d[0]) ** 2 for p in points))
    assert np.isclose(curves.side_penalty(curves.prefix_sums(points), points, np.array([0]), n - 1)[0], plain)
    centre, way = curves.best_line(points)
    cost = lambda t: sum(((p - centre)[0] * -np.sin(t) + (p - centre)[1] * np.cos(t)) ** 2 for p in points)
    assert cost(np.arctan2(way[1], way[0])) <= min(cost(t) for t in np.linspace(0, np.pi, 721)) + 1e-9


def circle(r, size):
    y, x = np.mgrid[:size, :size]
    return component_roots(((x + 0.5 - size / 2) ** 2 + (y + 0.5 - size / 2) ** 2 <= r * r).astype(int))


def test_a_disc_becomes_few_curves_close_to_it():
    grid = circle(40, 100)
    left, right, closed, points = next(c for c in curves.chains(grid) if -1 not in c[:2])
    start, segments = curves.fit_chain(points, closed)
    assert closed and all(s[0] == "C" for s in segments) and len(segments) <= 16
    at, radii = start, []
    for s in segments:
        radii += np.hypot(*(curves.bezier(at, *s[1:], np.linspace(0, 1, 20)) - 50).T).tolist()
        at = s[-1]
    assert np.allclose(at, start) and max(abs(r - 40) for r in radii) < 0.8 and curves.deviation(points, closed, start, segments) <= 1


def test_a_square_keeps_its_corners():
    grid = np.zeros((20, 20), int)
    grid[5:15, 4:16] = 1
    *_, closed, points = next(c for c in curves.chains(component_roots(grid)) if -1 not in c[:2])
    start, segments = curves.fit_chain(points, closed)
    assert {tuple(np.round(s[-1], 6)) for s in segments} >= {(4, 5), (16, 5), (16, 15), (4, 15)} and all(s[0] == "L" for s in segments)


@pytest.mark.parametrize("seed", range(6))
def test_ends_stay_and_backwards_is_the_same_path(seed):
    for grid in grids(seed, 4, 14):
        for _, _, closed, points in curves.chains(grid):
            start, segments = curves.fit_chain(points, closed)
            end = segments[-1][-1]
            if not closed:
                assert np.array_equal(start, points[0]) and np.array_equal(end, points[-1])
            else:
                assert np.allclose(start, end)
            assert curves.deviation(points, closed, start, segments) <= 1
            again = curves.backwards(*curves.backwards(start, segments))
            assert np.array_equal(again[0], start) and len(again[1]) == len(segments) and all(a[0] == b[0] and np.array_equal(np.array(a[1:]), np.array(b[1:])) for a, b in zip(again[1], segments, strict=True))


def test_lines_merge_and_numbers_are_short():
    p = lambda *v: np.array(v, float)
    got = curves.merged_lines(p(0, 0), [("L", p(1, 0)), ("L", p(3, 0)), ("L", p(3, 0)), ("L", p(3, 2)), ("L", p(3, 1))])
    assert [s[1].tolist() for s in got] == [[3, 0], [3, 2], [3, 1]]
    assert [curves.number(v, 2) for v in (0.5, -0.5, -0.001, 3, 10, 1.25, -2.1)] == [".5", "-.5", "0", "3", "10", "1.25", "-2.1"]
    assert curves.path_of(p(1, 2), [("C", p(1, 2.5), p(2, 3), p(4, 0)), ("L", p(0, 0))]) == "M1 2C1 2.5 2 3 4 0L0 0"


def sampled(path):
    """Points along each loop of path data made of M, L, C and Z."""
    import re

    loops = []
    for command, rest in re.findall("([MLCZ])([^MLCZ]*)", path):
        v = np.array(list(map(float, re.findall(r"-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", rest)))).reshape(-1, 2)
        if command == "M":
            loops.append([v[0]])
        elif command == "L":
            loops[-1].append(v[0])
        elif command == "C":
            loops[-1] += list(curves.bezier(loops[-1][-1], *v, np.linspace(0, 1, 60)[1:]))
    return [np.array(x) for x in loops]


def filled(loops, shape):
    """Even-odd fill at pixel centres."""
    y, x = np.mgrid[: shape[0], : shape[1]] + 0.5
    inside = np.zeros(shape, bool)
    for p in loops:
        for (x1, y1), (x2, y2) in zip(p, np.roll(p, -1, axis=0), strict=True):
            crosses = (y1 > y) != (y2 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                inside ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
    return inside


def test_drawn_regions_cover_the_image_without_gaps(spark):
    import re

    y, x = np.mgrid[:40, :48]
    grid = np.where((x - 20) ** 2 + (y - 18) ** 2 < 150, 1, np.where(x + y > 60, 2, 0))
    grid[(x - 20) ** 2 + (y - 18) ** 2 < 30] = -1
    grid[5:9, 40:45] = 3
    cells = [(7, int(b), int(a), int(grid[a, b]), 10 * int(grid[a, b]) + 10, 20, 30) for a in range(40) for b in range(48)]
    df = spark.createDataFrame(cells, "image_id long, x int, y int, label long, r int, g int, b int")
    cut = curves.traced(df, df.select("image_id", "x", "y", "label"), stacked=False).first()
    areas, drawn = 0.0, {}
    for colour, d in re.findall(r'fill="([^"]+)"[^>]* d="([^"]*)"', cut["svg"]):
        loops = sampled(d)
        areas += sum(curves.shoelace(p, True) / 2 for p in loops)
        drawn[colour] = filled(loops, grid.shape)
    hole = (grid == -1).sum()
    assert cut["n_paths"] == 4 and abs(areas - (48 * 40 - hole)) < 6
    padded = np.pad(grid, 1, mode="edge")
    border = sum((padded[1 + dy : 41 + dy, 1 + dx : 49 + dx] != grid).astype(int) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))) > 0
    for colour, mask in drawn.items():  # centres on a fitted diagonal may fall to either side
        label = (int(colour[1:3], 16) - 10) // 10
        assert not ((mask != (grid == label)) & ~border).any()
    assert (sum(m.astype(int) for m in drawn.values()) > 1).sum() == 0
    stacked = curves.traced(df, df.select("image_id", "x", "y", "label")).first()
    paint = np.full(grid.shape, -1)
    for colour, d in re.findall(r'fill="([^"]+)"[^>]* d="([^"]*)"', stacked["svg"]):
        paint[filled(sampled(d), grid.shape)] = (int(colour[1:3], 16) - 10) // 10
    assert not ((paint != grid) & ~border).any() and 'viewBox="0 0 48 40"' in stacked["svg"]


def test_no_path_strays_more_than_a_pixel():
    y, x = np.mgrid[:256, :256]
    disc = ((2 * x - 255) ** 2 + (2 * y - 255) ** 2 <= (246 + 64) ** 2).astype(int)  # each step within its limit, all together 1.03 off
    fits = [(p, closed, curves.fit_within(p, closed)) for _, _, closed, p in curves.chains(component_roots(disc))]
    assert max(off for _, _, (*_, off) in fits) <= 1 < max(curves.deviation(p, c, *curves.fit_chain(p, c)) for p, c, _ in fits)
    assert all(off == curves.deviation(p, c, start, segments) for p, c, (start, segments, off) in fits)
    p, c, _ = fits[1]
    start, segments, off = curves.fit_within(p, c, curves.Fit(stray=1e-9))
    assert off < 1e-9 and all(kind == "L" for kind, *_ in segments) and (start == p[0]).all() and (segments[-1][-1] == p[-1]).all()


def test_chains_that_come_again_are_fitted_once(spark, monkeypatch, tmp_path):
    cells = [(k, i % 8, i // 8, (i * i // 7 + k % 3) % 4) for k in range(12) for i in range(64)]
    found = curves.region_chains(spark.createDataFrame(cells, "image_id long, x int, y int, label long").coalesce(1))
    log, real = str(tmp_path / "fits"), curves.fit_within

    def counted(points, closed, fit):
        with open(log, "a") as f:
            f.write("x")
        return real(points, closed, fit)

    monkeypatch.setattr(curves, "fit_within", counted)
    got = {(r.image_id, r.chain): r for r in curves.fitted_chains(found.repartition(1)).collect()}
    with open(log) as f:
        fits = len(f.read())
    assert fits < len(got) / 2
    for r in got.values():
        points = np.stack([r.xs, r.ys], axis=1)
        start, segments, off = real(points, r.closed)
        end, back = curves.backwards(start, segments)
        assert (r.path, r.back, r.x1, r.y2, r.off) == (curves.path_of(start, segments, move=False), curves.path_of(end, back, move=False), start[0], end[1], off)
