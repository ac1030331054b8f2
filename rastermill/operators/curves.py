"""Boundaries of regions as smooth paths: shared chains of pixel sides, polygons over them, and curves.

A chain is what two regions share between two junctions, or a closed loop. It is fitted once, so both regions
draw the same edge. Each chain is a row of its own and a unit of work; an image is one only while its
chains are cut. The steps follow P. Selinger, "Potrace: a polygon-based tracing algorithm" (2003), with directions
kept as angles.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import asin, atan2, cos, hypot, pi, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..sources.shared import save
from .regions import STEPS, TOGETHER, component_roots, dense, gathered, grids, merge_small


@dataclass(frozen=True)
class Fit:
    """How chains are fitted: pixels that a side may be off, sharpness beyond which a vertex is a corner, pixels
    that merged curves may be off, whether vertices of straight outlines go back to the pixel grid, and pixels that a
    path may stray from its chain in all."""

    reach: float = 0.9
    corner: float = 1.0
    merge: float = 0.3
    snap: bool = False
    stray: float = 1.0


# ---------------------------------------------------------------- chains of an image


def chains(regions: np.ndarray) -> list[tuple[int, int, bool, np.ndarray]]:
    """(left, right, closed, corners) of each stretch of sides between two regions; outside the image is -1.

    Junctions, where three or more sides meet, end a chain. A closed chain's first corner isn't repeated.
    """
    (left, right, xs, ys), longer = cut_sides(regions)
    return [*[(p, q, closed, np.array(points)) for p, q, closed, points in longer], *[(p, q, False, np.stack([x, y], axis=1)) for p, q, x, y in zip(left.tolist(), right.tolist(), xs, ys, strict=True)]]


def cut_sides(regions: np.ndarray) -> tuple[tuple[np.ndarray, ...], list[tuple[int, int, bool, list]]]:
    """`chains` of one side, all at once as (left, right, xs, ys), and the longer ones, which are walked along, corners as pairs.

    Between small regions most sides have a junction at either end.
    """
    h, w = regions.shape
    p = np.pad(regions.astype(np.int64), 1, constant_values=-1)
    flat, down = p[:-1, 1:-1] != p[1:, 1:-1], p[1:-1, :-1] != p[1:-1, 1:]

    def met(across: np.ndarray, along: np.ndarray) -> np.ndarray:
        n = np.zeros((h + 1, w + 1), np.int8)
        n[:, :-1] += across
        n[:, 1:] += across
        n[:-1] += along
        n[1:] += along
        return n

    degree = met(flat, down)
    ends = degree > 2
    east, south = flat & ends[:, :-1] & ends[:, 1:], down & ends[:-1] & ends[1:]
    (y, x), (v, u) = np.nonzero(east), np.nonzero(south)
    single = np.r_[p[y, x + 1], p[v + 1, u + 1]], np.r_[p[y + 1, x + 1], p[v + 1, u]], np.stack([np.r_[x, u], np.r_[x + 1, u]], axis=1), np.stack([np.r_[y, v], np.r_[y, v + 1]], axis=1)
    flat, down = flat & ~east, down & ~south
    left_of = p.tolist()
    flat_left, down_left, degrees = flat.tolist(), down.tolist(), degree.tolist()

    def has(x: int, y: int, way: int) -> bool:
        if way == 0:
            return x < w and flat_left[y][x]
        if way == 1:
            return y < h and down_left[y][x]
        return x > 0 and flat_left[y][x - 1] if way == 2 else y > 0 and down_left[y - 1][x]

    def take(x: int, y: int, way: int) -> None:
        if way in (0, 2):
            flat_left[y][x - (way == 2)] = False
        else:
            down_left[y - (way == 3)][x] = False

    def sides(x: int, y: int, way: int) -> tuple[int, int]:
        """Regions left and right of a step; y grows downwards."""
        around = {0: ((y, x + 1), (y + 1, x + 1)), 1: ((y + 1, x + 1), (y + 1, x)), 2: ((y + 1, x), (y, x)), 3: ((y, x), (y, x + 1))}[way]
        return tuple(left_of[r][c] for r, c in around)

    def walk(x: int, y: int, way: int):
        beside, points = sides(x, y, way), [(x, y)]
        while True:
            take(x, y, way)
            x, y = x + STEPS[way][0], y + STEPS[way][1]
            if (x, y) == points[0] and degrees[y][x] == 2:
                return (*beside, True, points)
            points.append((x, y))
            if degrees[y][x] != 2:
                return (*beside, False, points)
            way = next(k for k in range(4) if has(x, y, k))

    out = []
    for y, x in np.argwhere(ends & (met(flat, down) > 0)).tolist():
        out += [walk(x, y, way) for way in range(4) if has(x, y, way)]
    for y, x in np.argwhere(flat).tolist():
        if flat_left[y][x]:
            out.append(walk(x, y, 0))
    return single, out


# ---------------------------------------------------------------- polygons


#: Points that a side may pass at most; of a straight run, how many from its ends may be corners.
MOST_PASSED, RUN_ENDS = 400, 32


def corner_candidates(points: np.ndarray) -> np.ndarray:
    """Positions without the inner points of long straight runs. What holds at a run's ends holds between them: how far
    its points are from a side changes evenly along it."""
    n = len(points)
    at = np.arange(n)
    way = np.diff(points, axis=0)
    turns = np.r_[True, (way[1:] != way[:-1]).any(axis=1), True] if n > 1 else np.ones(n, bool)
    before = np.maximum.accumulate(np.where(turns, at, 0))
    after = np.minimum.accumulate(np.where(turns, at, n - 1)[::-1])[::-1]
    return at[np.minimum(at - before, after - at) < RUN_ENDS]


def straight_reach(points: np.ndarray, off: float) -> np.ndarray:
    """For each point the last one that a straight side from it may end at, with all between at most `off` from it, and no
    more than `MOST_PASSED` of them.

    Every point between leaves a cone of directions; a side must end inside the cone of all before its end. Cones
    are narrowed over a stretch of points at once, longer ones where a side goes on.
    """
    p = points.astype(float)
    n = len(p)
    out = np.full(n, n - 1)
    if n <= 48:
        return _short_reach(p.tolist(), off)
    for i in range(n - 1):
        low, high, base, last, at, size = -pi, pi, None, i + 1, i + 1, 32
        end = min(n, i + MOST_PASSED + 2)
        while at < end:
            d = p[at : min(end, at + size)] - p[i]
            r = np.hypot(d[:, 0], d[:, 1])
            turn = np.arctan2(d[:, 1], d[:, 0])
            base = turn[0] if base is None else base
            turn = (turn - base + pi) % (2 * pi) - pi
            width = np.arcsin(np.minimum(1.0, off / np.maximum(r, 1e-9)))
            lows = np.maximum.accumulate(np.r_[low, turn - width])
            highs = np.minimum.accumulate(np.r_[high, turn + width])
            open_till = int(np.argmax(np.r_[(lows[1:] > highs[1:]) | (r == 0), True]))  # the first point that closes the cone
            upto = min(open_till + 1, len(turn))
            fits = np.flatnonzero((turn[:upto] >= lows[:upto] - 1e-12) & (turn[:upto] <= highs[:upto] + 1e-12) & (r[:upto] > 0))
            if len(fits):
                last = at + int(fits[-1])
            if open_till < len(turn):
                break
            low, high, at, size = lows[-1], highs[-1], at + size, size * 2
        out[i] = last
    return out


def _short_reach(p: list[list[float]], off: float) -> np.ndarray:
    """The same for few points, one by one."""
    n = len(p)
    out = np.full(n, n - 1)
    for i, (x, y) in enumerate(p[:-1]):
        low, high, last = -pi, pi, i + 1
        base = atan2(p[i + 1][1] - y, p[i + 1][0] - x)
        for j in range(i + 1, n):
            dx, dy = p[j][0] - x, p[j][1] - y
            r = hypot(dx, dy)
            if r == 0:
                break
            turn = (atan2(dy, dx) - base + pi) % (2 * pi) - pi
            if low - 1e-12 <= turn <= high + 1e-12:
                last = j
            width = asin(min(1.0, off / r))
            low, high = max(low, turn - width), min(high, turn + width)
            if low > high:
                break
        out[i] = last
    return out


def prefix_sums(points: np.ndarray) -> np.ndarray:
    """Running sums of 1, x, y, xx, xy, yy, from none on: any stretch is the difference of two rows."""
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    terms = np.stack([np.ones(len(x)), x, y, x * x, x * y, y * y], axis=1)
    return np.vstack([np.zeros(6), np.cumsum(terms, axis=0)])


def side_penalty(sums: np.ndarray, points: np.ndarray, i: np.ndarray, j: int) -> np.ndarray:
    """Root of the summed squared distances of the points i..j from the sides i to j, times the sides' lengths."""
    n, x, y, xx, xy, yy = (sums[j + 1] - sums[i]).T
    px, py = ((points[i, k] + points[j, k]) / 2 for k in (0, 1))
    ex, ey = points[i, 1] - points[j, 1], points[j, 0] - points[i, 0]
    a, b, c = xx - 2 * x * px + n * px * px, xy - x * py - y * px + n * px * py, yy - 2 * y * py + n * py * py
    return np.sqrt(np.maximum(0.0, ex * ex * a + 2 * ex * ey * b + ey * ey * c))


def polygon(points: np.ndarray, off: float) -> list[int]:
    """Corners, as positions from first to last, of the open polygon of fewest sides; of those the least penalty."""
    at = corner_candidates(points)
    n, reach, sums = len(at), straight_reach(points[at], off), prefix_sums(points)
    sides, cost, before = np.full(n, 1 << 30), np.full(n, np.inf), np.zeros(n, np.int64)
    sides[0] = cost[0] = 0
    first = np.maximum.accumulate(reach)
    for j in range(1, n):
        i = np.arange(int(np.searchsorted(first, j)), j)
        i = i[reach[i] >= j]
        fewest = sides[i].min()
        i = i[sides[i] == fewest]
        total = cost[i] + side_penalty(sums, points, at[i], at[j])
        k = int(total.argmin())
        sides[j], cost[j], before[j] = fewest + 1, total[k], i[k]
    out = [n - 1]
    while out[-1]:
        out.append(int(before[out[-1]]))
    return at[out[::-1]].tolist()


def closed_polygon(points: np.ndarray, off: float) -> np.ndarray:
    """Corners of a closed chain: cut once at its first point, then at a corner far from there."""
    ring = lambda start: np.vstack([np.roll(points, -start, axis=0), points[start : start + 1]])
    corners = polygon(ring(0), off)
    start = corners[len(corners) // 2]
    return (np.array(polygon(ring(start), off)[:-1]) + start) % len(points)


def best_line(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, direction) of the line closest to the points."""
    centre = points.mean(axis=0)
    d = points - centre
    a, b, c = (d[:, 0] ** 2).sum(), (d[:, 0] * d[:, 1]).sum(), (d[:, 1] ** 2).sum()
    turn = atan2(2 * b, a - c) / 2
    return centre, np.array([cos(turn), sin(turn)])


def adjusted(points: np.ndarray, corners: np.ndarray, closed: bool) -> np.ndarray:
    """Vertices moved, at most half a pixel each way, to where the lines through both sides' points nearly meet.

    Ends of open chains are junctions, which other chains share: they stay.
    """
    n, m = len(points), len(corners)
    out = points[corners].astype(float)
    forms = []
    for k in range(m if closed else m - 1):
        i, j = int(corners[k]), int(corners[(k + 1) % m])
        span = np.arange(i, j + 1) if j > i else np.arange(i, j + n + 1) % n
        centre, (dx, dy) = best_line(points[span].astype(float))
        normal = np.array([-dy, dx])
        forms.append((np.outer(normal, normal), centre))
    for k in range(m) if closed else range(1, m - 1):
        (q1, c1), (q2, c2) = forms[k - 1], forms[k % len(forms)]
        q, v, at = q1 + q2, q1 @ c1 + q2 @ c2, out[k].copy()
        try:
            best = np.linalg.solve(q, v)
        except np.linalg.LinAlgError:
            best = np.linalg.lstsq(q + 1e-9 * np.eye(2), v + 1e-9 * at, rcond=None)[0]
        if np.abs(best - at).max() > 0.5:  # the least value on the border of the unit square
            tries = [at]
            for axis in (0, 1):
                for edge in (at[axis] - 0.5, at[axis] + 0.5):
                    free = 1 - axis
                    t = (v[free] - q[free, axis] * edge) / q[free, free] if q[free, free] > 1e-12 else at[free]
                    p = np.empty(2)
                    p[axis], p[free] = edge, min(max(t, at[free] - 0.5), at[free] + 0.5)
                    tries.append(p)
            best = min(tries, key=lambda p: p @ q @ p - 2 * v @ p)
        out[k] = best
    return out


# ---------------------------------------------------------------- curves: (kind, control points), from `start` on


def sharpness(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """How far a vertex b stands out between the middles of its sides: 0 for none, beyond 1 for a corner."""
    d = abs(c[0] - a[0]) + abs(c[1] - a[1])
    area = abs((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))
    if d == 0:
        return 4 / 3
    away = area / d
    return (1 - 1 / away if away > 1 else 0.0) / 0.75


def smoothed(vertices: np.ndarray, closed: bool, corner: float, sharp: np.ndarray) -> tuple[np.ndarray, list]:
    """(start, segments): a curve around each soft vertex from one side's middle to the next's, lines to corners and
    to vertices that are `sharp`."""
    m = len(vertices)
    if closed and m < 3 or not closed and m == 2:
        return vertices[0], [("L", p) for p in vertices[1:]] + ([("L", vertices[0])] if closed else [])
    start = (vertices[-1] + vertices[0]) / 2 if closed else vertices[0]
    out = []
    for k in range(m) if closed else range(1, m - 1):
        b = vertices[k]
        a = (vertices[k - 1] + b) / 2 if closed or k > 1 else vertices[0]
        c = (b + vertices[(k + 1) % m]) / 2 if closed or k < m - 2 else vertices[-1]
        s = sharpness(vertices[k - 1], b, vertices[(k + 1) % m])
        if s >= corner or sharp[k]:
            out += [("L", b), ("L", c)]
        else:
            s = min(max(s, 0.55), 1.0)
            out.append(("C", a + s * (b - a), c + s * (b - c), c))
    return start, out


def bezier(p: np.ndarray, c1: np.ndarray, c2: np.ndarray, q: np.ndarray, t: np.ndarray) -> np.ndarray:
    t = t[:, None]
    return (1 - t) ** 3 * p + 3 * (1 - t) ** 2 * t * c1 + 3 * (1 - t) * t * t * c2 + t**3 * q


def one_curve(start: np.ndarray, run: list, off: float):
    """One curve in place of several with the ends' directions kept, or None beyond `off` pixels.

    The lengths of both handles are the least squares over samples of the curves, placed by length.
    """
    at, samples = start, [start[None]]
    for _, c1, c2, q in run:
        samples.append(bezier(at, c1, c2, q, np.linspace(0, 1, 9)[1:]))
        at = q
    p = np.vstack(samples)
    u, v = run[0][1] - start, run[-1][2] - at
    if not u.any() or not v.any():
        return None
    u, v = u / hypot(*u), v / hypot(*v)
    t = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
    if t[-1] == 0:
        return None
    t /= t[-1]
    b0, b1, b2, b3 = (1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3
    rest = p - np.outer(b0 + b1, start) - np.outer(b2 + b3, at)
    m = np.stack([np.outer(b1, u).ravel(), np.outer(b2, v).ravel()], axis=1)
    (s, e), *_ = np.linalg.lstsq(m, rest.ravel(), rcond=None)
    if s <= 0 or e <= 0:
        return None
    new = ("C", start + s * u, at + e * v, at)
    fine = bezier(start, new[1], new[2], at, np.linspace(0, 1, 4 * len(p)))
    apart = np.sqrt(((p[:, None] - fine[None]) ** 2).sum(axis=2).min(axis=1)).max()
    return new if apart <= off else None


def merged_curves(start: np.ndarray, segments: list, off: float, most: int = 12) -> list:
    """Runs of curves that turn by less than half a circle become one where that is close enough, the longest first found."""
    out, i, at = [], 0, start
    while i < len(segments):
        best, end = segments[i], i
        turned, j, way = 0.0, i, None
        while j < len(segments) and j - i < most and segments[j][0] == "C":
            _, c1, c2, q = segments[j]
            first = atan2(*(c1 - (at if j == i else segments[j - 1][-1]))[::-1])
            last = atan2(*(q - c2)[::-1])
            turned += sum(abs((b - a + pi) % (2 * pi) - pi) for a, b in ((way if way is not None else first, first), (first, last)))
            way = last
            if turned >= pi:
                break
            if j > i:
                one = one_curve(at, segments[i : j + 1], off)
                if one is None:
                    break
                best, end = one, j
            j += 1
        out.append(best)
        at, i = best[-1], end + 1
    return out


def merged_lines(start: np.ndarray, segments: list) -> list:
    """Consecutive lines of one direction become one; empty ones go."""
    out, at = [], start
    for seg in segments:
        if seg[0] == "L" and np.abs(seg[1] - at).max() < 1e-9:
            continue
        if out and seg[0] == "L" == out[-1][0]:
            before = start if len(out) == 1 else out[-2][-1]
            d, e = out[-1][1] - before, seg[1] - out[-1][1]
            if abs(d[0] * e[1] - d[1] * e[0]) < 1e-9 and d @ e > 0:
                out[-1] = seg
                at = seg[-1]
                continue
        out.append(seg)
        at = seg[-1]
    return out


def square_corners(points: np.ndarray, corners: np.ndarray, closed: bool, least: int = 3) -> np.ndarray:
    """Which corners of a polygon are true right angles: straight runs of at least so many sides meet in them."""
    steps = np.diff(np.vstack([points, points[:1]]) if closed else points, axis=0)
    n = len(steps)

    def run(at: int, way: int) -> tuple[int, np.ndarray]:
        first, k = steps[at % n], 1
        while k < least and (closed or 0 <= at + way * k < n) and (steps[(at + way * k) % n] == first).all():
            k += 1
        return k, first

    out = np.zeros(len(corners), bool)
    for i, c in enumerate(corners.tolist()):
        if closed or 0 < c < n:
            (before, a), (after, b) = run(c - 1, -1), run(c, 1)
            out[i] = before >= least and after >= least and a @ b == 0
    return out


def backwards(start: np.ndarray, segments: list) -> tuple[np.ndarray, list]:
    """The same path from its end to its start, as the region on the other side draws it."""
    ends = [start, *[s[-1] for s in segments]]
    return ends[-1], [("L", ends[k]) if s[0] == "L" else ("C", s[2], s[1], ends[k]) for k, s in reversed(list(enumerate(segments)))]


def fit_chain(points: np.ndarray, closed: bool, fit: Fit = Fit()) -> tuple[np.ndarray, list]:
    """(start, segments) of a chain: polygon, vertices, curves, merged. Open chains keep both ends."""
    points = np.asarray(points)
    if len(points) < 3 or not closed and (np.diff(points, axis=0) == points[1] - points[0]).all():
        points = points[[0, -1]] if not closed else points
        return points[0].astype(float), [("L", p.astype(float)) for p in points[1:]]
    corners = closed_polygon(points, fit.reach) if closed else np.array(polygon(points, fit.reach))
    vertices = adjusted(points, corners, closed)
    if fit.snap:
        vertices = np.rint(vertices)
    start, segments = smoothed(vertices, closed, fit.corner, square_corners(points, corners, closed))
    return start, merged_lines(start, merged_curves(start, segments, fit.merge))


def deviation(points: np.ndarray, closed: bool, start: np.ndarray, segments: list) -> float:
    """How far the path strays from the chain: the largest distance of a sample of it to the chain's sides."""
    at, samples = start, [start[None]]
    for seg in segments:
        t = np.linspace(0, 1, 9)[1:]
        samples.append(bezier(at, *seg[1:], t) if seg[0] == "C" else at + np.outer(t, seg[1] - at))
        at = seg[-1]
    p = np.vstack(samples)
    a = points.astype(float)
    b = np.roll(a, -1, axis=0) if closed else a[1:]
    a = a if closed else a[:-1]
    worst = 0.0
    for k in range(0, len(p), 256):  # bounded memory for long chains
        q = p[k : k + 256, None]
        t = np.clip(((q - a) * (b - a)).sum(2) / np.maximum(1e-12, ((b - a) ** 2).sum(1)), 0, 1)
        worst = max(worst, float(np.sqrt((((a + t[..., None] * (b - a)) - q) ** 2).sum(2).min(1)).max()))
    return worst


def fit_within(points: np.ndarray, closed: bool, fit: Fit = Fit()) -> tuple[np.ndarray, list, float]:
    """(start, segments, deviation) of `fit_chain`, at most `fit.stray` from the chain.

    What each step may be off adds up. A path beyond that is fitted again with curves merged less, not merged, and without
    curves; the chain itself is the last resort.
    """
    for f in (fit, replace(fit, merge=fit.merge / 2), replace(fit, merge=0.0), replace(fit, merge=0.0, corner=0.0)):
        start, segments = fit_chain(points, closed, f)
        off = deviation(points, closed, start, segments)
        if off <= fit.stray:
            return start, segments, off
    p = np.asarray(points).astype(float)
    start, segments = p[0], merged_lines(p[0], [("L", q) for q in (np.vstack([p[1:], p[:1]]) if closed else p[1:])])
    return start, segments, deviation(points, closed, start, segments)


def number(v: float, digits: int) -> str:
    text = f"{round(v, digits) + 0.0:.{digits}f}"
    return (text.rstrip("0").rstrip(".") if "." in text else text).replace("-0.", "-.").removeprefix("0") or "0"


def path_of(start: np.ndarray, segments: list, digits: int = 2, move: bool = True) -> str:
    """Path data of absolute commands with so many decimals; without the first move where a path goes on."""
    join = lambda *ps: " ".join(number(float(v), digits) for p in ps for v in p)
    return (f"M{join(start)}" if move else "") + "".join(s[0] + join(*s[1:]) for s in segments)


# ---------------------------------------------------------------- over tables


def region_chains(labels: DataFrame, min_area: int = 1, drawn: bool = False) -> DataFrame:
    """(image_id, chain, left, right, closed, xs, ys): the chains of each image (image_id, x, y, label).

    Regions are named by their first pixel in row-major order, outside the image by -1; those below `min_area`
    have joined a neighbour. `drawn` is as for `regions.gathered`.
    """
    return chains_of(dense(labels, drawn), min_area)


def chains_of(images: DataFrame, min_area: int = 1) -> DataFrame:
    """`region_chains` of images as `dense` rows."""

    def run(batches):
        for b in batches:
            yield chain_rows(b.column("image_id").to_pylist(), [merge_small(grid, min_area) if min_area > 1 else grid for grid in grids(b)])

    return images.mapInArrow(run, CHAINS)


def plane_chains(pictures: DataFrame, draw, plane: str = "r") -> DataFrame:
    """`region_chains` of pictures that `draw` makes in tasks (`roles.drawn`), whose labels are the values of one plane."""

    def run(batches):
        for b in draw(batches):
            yield chain_rows(b.column("image_id").to_pylist(), [v.values.to_numpy().astype(np.int64).reshape(-1, w) for w, v in zip(b.column("width").to_pylist(), b.column(plane), strict=True)])

    return pictures.mapInArrow(run, CHAINS)


CHAINS = "image_id long, chain int, left long, right long, closed boolean, xs array<int>, ys array<int>"


def piled(pictures: list[np.ndarray]):
    """(numbers of pictures, pile): pictures of one shape on top of each other with an empty row, -1, below each, few or small enough for
    `TOGETHER` pixels, so that array steps are paid for once; what lies in different pictures never touches."""
    by_shape: dict[tuple, list[int]] = {}
    for k, grid in enumerate(pictures):
        by_shape.setdefault(grid.shape, []).append(k)
    for (h, w), numbers in by_shape.items():
        most = max(1, TOGETHER // ((h + 1) * w))
        for i in range(0, len(numbers), most):
            some = numbers[i : i + most]
            pile = np.full((len(some), h + 1, w), -1, np.int64)
            for k, n in enumerate(some):
                pile[k, :h] = pictures[n]
            yield some, pile


def piled_roots(pile: np.ndarray) -> np.ndarray:
    """For each pixel of a pile the smallest row-major index, in the pile, of its region; -1 in the empty rows."""
    n, tall, w = pile.shape
    names = np.unique(pile, return_inverse=True)[1].reshape(pile.shape)
    names[:, -1] = -1  # a label may be -1 itself
    roots = component_roots(names.reshape(-1, w)).reshape(pile.shape)
    roots[:, -1] = -1
    return roots


def chain_rows(images: list[int], pictures: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of `region_chains` of images and the labels of their pixels."""
    parts = []
    for numbers, pile in piled(pictures):
        tall, w = pile.shape[1:]
        (left, right, xs, ys), longer = cut_sides(piled_roots(pile).reshape(-1, w))
        lefts, rights, closed, paths = zip(*longer, strict=True) if longer else ((), (), (), ())
        path = np.array([c for p in paths for c in p], np.int64).reshape(-1, 2)
        size = np.r_[np.full(len(left), 2), np.array([len(p) for p in paths], np.int64)]
        xs, ys = np.r_[xs.ravel(), path[:, 0]], np.r_[ys.ravel(), path[:, 1]]
        of = ys[np.cumsum(size) - size] // tall
        beside = [np.where(v < 0, -1, v - of * tall * w) for v in (np.r_[left, np.array(lefts, np.int64)], np.r_[right, np.array(rights, np.int64)])]
        order, chain = np.argsort(of, kind="stable"), np.zeros(len(of), np.int64)
        counts = np.bincount(of, minlength=len(numbers))
        chain[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        parts.append((np.array(images, np.int64)[numbers][of], chain, *beside, np.r_[np.zeros(len(left), bool), np.array(closed, bool)], size, xs, ys - np.repeat(of, size) * tall))
    ids, chain, left, right, closed, size, xs, ys = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 8
    offsets = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (xs, ys)]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(chain, pa.int32()), pa.array(left), pa.array(right), pa.array(closed.astype(bool)), *lists], ["image_id", "chain", "left", "right", "closed", "xs", "ys"])


#: Fits that a task remembers, and how many points their chains have together: the same ones come up again and again.
REMEMBERED, REMEMBERED_POINTS = 50_000, 4_000_000


def fitted_chains(found: DataFrame, fit: Fit = Fit(), digits: int = 2, points: bool = True) -> DataFrame:
    """`region_chains` with `path` (data without the first move), `back` (the other way round), the start and end,
    `segments`, `curves`, `off`, the largest distance from the pixel sides, and `shoe` (`shoelace`). A chain is a unit of work.

    `points` tells whether `xs` and `ys` are kept."""
    # a fixed number of tasks, as for `dense`: fitting is not in proportion to bytes. Equal chains of all images meet, and are fitted once
    spread = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("closed", "xs", "ys"))

    def fitted(closed, xs, ys):
        corners = np.stack([xs, ys], axis=1)
        start, segments, off = fit_within(corners, closed, fit)
        end, back = backwards(start, segments)
        return path_of(start, segments, digits, move=False), path_of(end, back, digits, move=False), *map(float, start), *map(float, end), len(segments), sum(s[0] == "C" for s in segments), off, shoelace(corners, closed)

    def run(batches):
        known, held = {}, 0
        for b in batches:
            out, own, at = [], {}, []  # equal fits are one row of `out`; `at` tells which a chain has
            x, y = b.column("xs"), b.column("ys")
            ends, xs, ys = x.offsets.to_numpy(), x.values.to_numpy(), y.values.to_numpy()
            shift = (y.offsets.to_numpy() - ends).tolist()
            for closed, i, j, d in zip(b.column("closed").to_numpy(zero_copy_only=False).tolist(), ends[:-1].tolist(), ends[1:].tolist(), shift, strict=False):
                px, py = xs[i:j], ys[i + d : j + d]
                key = closed, px.tobytes(), py.tobytes()
                if key not in own:
                    if key not in known:
                        if len(known) >= REMEMBERED or held >= REMEMBERED_POINTS:
                            known.clear()
                            held = 0
                        known[key] = fitted(closed, px, py)
                        held += j - i
                    own[key] = len(out)
                    out.append(known[key])
                at.append(own[key])
            kinds = [pa.string(), pa.string(), *[pa.float64()] * 4, pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 10
            names = ["path", "back", "x1", "y1", "x2", "y2", "segments", "curves", "off", "shoe"]
            kept = [c for c in b.schema.names if points or c not in ("xs", "ys")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(c, k).take(pa.array(at, pa.int32())) for c, k in zip(columns, kinds, strict=True)]], [*kept, *names])

    kinds = CHAINS if points else CHAINS.partition(", xs")[0]
    return spread.mapInArrow(run, kinds + ", path string, back string, x1 double, y1 double, x2 double, y2 double, segments int, curves int, off double, shoe double")


def shoelace(points: np.ndarray, closed: bool) -> float:
    """Twice the signed area that a chain adds to the loops it is part of: positive with the inside on the right."""
    a = points.astype(float)
    b = np.roll(a, -1, axis=0) if closed else a[1:]
    a = a if closed else a[:-1]
    return float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum())


#: A piece of a region's boundary, in the order in which pieces are sorted.
PIECE = ("y1", "x1", "y2", "x2", "path", "closed", "shoe", "other")


def loops_of(pieces: list[tuple], digits: int = 2) -> list[tuple[str, float, list[int]]]:
    """Closed loops (path, area, others) of the directed pieces around one region, which lies on their right. Pieces are
    tuples of what `PIECE` names, sorted.

    Where a region touches itself at a junction any way on is right: both ways draw the same area.
    """
    out, begins = [], {}
    for p in pieces:
        if p[5]:
            out.append([p])
        else:
            begins.setdefault((p[0], p[1]), []).append(p)
    while begins:
        first = next(iter(begins))
        loop, at = [], first
        while not loop or at != first:
            loop.append(begins[at].pop())
            if not begins[at]:
                del begins[at]
            at = loop[-1][2:4]
        out.append(loop)
    text = lambda loop: f"M{number(loop[0][1], digits)} {number(loop[0][0], digits)}" + "".join([p[4] for p in loop]) + "Z"
    return [(text(loop), sum(p[6] for p in loop) / 2, sorted({p[7] for p in loop})) for loop in out]


def region_loops(fitted: DataFrame) -> DataFrame:
    """(image_id, region, loops): of each region the closed loops around it, outer ones of positive area.

    A region gathers the chains of its own boundary, forwards or backwards: nothing is fitted again. Tasks sort the pieces,
    which may spill, and read a region's one after the other.
    """
    ahead = F.struct(F.col("right").alias("region"), *[F.col(c) for c in PIECE[:-1]], F.col("left").alias("other"))
    behind = F.struct(F.col("left").alias("region"), F.col("y2").alias("y1"), F.col("x2").alias("x1"), F.col("y1").alias("y2"), F.col("x1").alias("x2"), F.col("back").alias("path"), "closed", (-F.col("shoe")).alias("shoe"), F.col("right").alias("other"))
    each = fitted.select("image_id", F.explode(F.array(ahead, behind)).alias("p")).select("image_id", "p.*").where("region >= 0")
    # a fixed number of tasks, as for `dense`
    each = each.repartition(int(fitted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "image_id", "region").sortWithinPartitions("image_id", "region", *PIECE[:5])
    kind = "array<struct<path: string, area: double, others: array<long>>>"

    def lists(values: list[list], flat: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), flat)

    def rows(done: list[tuple[int, int, list]]) -> pa.RecordBatch:
        loops = [loop for *_, found in done for loop in found]
        others = [o for *_, o in loops]
        columns = [pa.array([v for v, *_ in loops], pa.string()), pa.array([a for _, a, _ in loops], pa.float64()), lists(others, pa.array([o for some in others for o in some], pa.int64()))]
        made = lists([found for *_, found in done], pa.StructArray.from_arrays(columns, ["path", "area", "others"]))
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), made], ["image_id", "region", "loops"])

    def run(batches):
        at, pieces, done = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            images, regions = (b.column(c).to_numpy() for c in ("image_id", "region"))
            starts = np.flatnonzero((images[1:] != images[:-1]) | (regions[1:] != regions[:-1])) + 1
            every = list(zip(*[b.column(c).to_numpy(zero_copy_only=False).tolist() for c in PIECE], strict=True))
            bounds = [0, *starts.tolist(), len(every)]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                here = int(images[i]), int(regions[i])
                if pieces and here != at:
                    done.append((*at, loops_of(pieces)))
                    pieces = []
                at = here
                pieces += every[i:j]
            if done:
                yield rows(done)
                done = []
        if pieces:
            yield rows([(*at, loops_of(pieces))])

    return each.mapInArrow(run, f"image_id long, region long, loops {kind}")


def draw(loops: DataFrame, paints: DataFrame, sizes: DataFrame, stacked: bool = True) -> DataFrame:
    """(image_id, n_paths, svg) of `region_loops`, with `paints` (image_id, region, colour; null: see-through) and
    `sizes` (image_id, width, height).

    Stacked, regions are drawn whole, the largest outline first, and smaller ones on top: no seams show. An
    image with see-through regions keeps its holes open, as one may lie in any of them, at any depth. Cut out,
    every hole stays open.
    """
    clear = paints.groupBy("image_id").agg(F.max(F.col("colour").isNull()).alias("_clear"))
    seen = loops.join(paints.where("colour is not null").hint("merge"), ["image_id", "region"]).join(clear.hint("merge"), "image_id")
    kept = F.filter("loops", lambda x: (x["area"] > 0) | F.col("_clear")) if stacked else F.col("loops")
    outer = F.aggregate(F.filter("loops", lambda x: x["area"] > 0), F.lit(0.0), lambda s, x: s + x["area"])
    data = F.array_join(F.transform(F.array_sort(F.transform(kept, lambda x: F.struct((-x["area"]).alias("a"), x["path"].alias("p")))), lambda x: x["p"]), "")
    path = F.concat(F.lit('<path fill="'), F.col("colour"), F.lit('" fill-rule="evenodd" d="'), data, F.lit('"/>'))
    each = seen.select("image_id", F.struct((-outer).alias("o"), F.col("region").alias("k"), path.alias("v")).alias("s"))
    drawn = each.groupBy("image_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    box = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 '), F.col("width").cast("string"), F.lit(" "), F.col("height").cast("string"), F.lit('">'))
    return drawn.join(sizes.hint("merge"), "image_id").select("image_id", F.size("s").cast("long").alias("n_paths"), F.concat(box, F.array_join(F.col("s.v"), ""), F.lit("</svg>")).alias("svg"))


def region_sums(images: DataFrame) -> DataFrame:
    """(image_id, width, labels, found) of rows of `gathered` with labels, r, g, b: `found` are an image's regions, their labels,
    how many pixels with colours they have and the sums of these."""

    def run(batches):
        for b in batches:
            columns = {c: list(b.column(c)) for c in "rgb"}
            out = [None] * b.num_rows
            for numbers, pile in piled(list(grids(b))):
                tall, w = pile.shape[1:]
                roots = piled_roots(pile)
                inside = np.flatnonzero(roots.ravel() >= 0)
                own, at = np.unique(roots.ravel()[inside], return_inverse=True)
                rgb = np.stack([np.concatenate([columns[c][n].values.to_numpy() for n in numbers]) for c in "rgb"])
                told = ~np.isnan(rgb).any(axis=0)
                sums = [np.bincount(at[told], minlength=len(own)), *[np.bincount(at[told], v[told], len(own)) for v in rgb]]
                of = own // (tall * w)
                columns_of = [own - of * tall * w, pile.ravel()[own], *sums]
                ends = np.cumsum(np.bincount(of, minlength=len(numbers)))[:-1]
                for n, *values in zip(numbers, *[np.split(v, ends) for v in columns_of], strict=True):
                    out[n] = values
            offsets = pa.array(np.cumsum([0, *[len(v[0]) for v in out]]), pa.int32())
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            fields = [pa.array(np.concatenate([v[k] for v in out]), kind) for k, kind in enumerate(kinds)]
            found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["region", "label", "n", "r", "g", "b"]))
            yield pa.RecordBatch.from_arrays([b.column("image_id"), b.column("width"), b.column("labels"), found], ["image_id", "width", "labels", "found"])

    return images.mapInArrow(run, "image_id long, width int, labels array<long>, found array<struct<region: long, label: long, n: long, r: double, g: double, b: double>>")


def traced(pixels: DataFrame, labels: DataFrame | None = None, fit: Fit = Fit(), stacked: bool = True) -> DataFrame:
    """(image_id, n_paths, svg) of images from their pixels and labels (image_id, x, y, label; -1: see-through), or from pixels
    that have a column `label`.

    Each region has the mean colour of its pixels. Pixels are gathered once, by images; from there on only regions and
    chains are moved.
    """
    both = pixels if labels is None else labels.select("image_id", "x", "y", "label").join(pixels.select("image_id", "x", "y", *"rgb").hint("merge"), ["image_id", "x", "y"], "left")
    images = save(region_sums(gathered(both.withColumnRenamed("label", "labels"), {"labels": "long", **dict.fromkeys("rgb", "double")})), "regions")

    def cut(batches):
        for b in batches:
            yield chain_rows(b.column("image_id").to_pylist(), list(grids(b)))

    fitted = fitted_chains(images.select("image_id", "width", "labels").mapInArrow(cut, CHAINS), fit, points=False)
    tints = images.select("image_id", F.explode("found").alias("p")).select("image_id", "p.*").where("n > 0")
    paints = tints.select("image_id", "region", F.when(F.col("label") >= 0, color.hex_colour(*[color.half_up(F.col(c) / F.col("n")) for c in "rgb"])).alias("colour"))
    sizes = images.select("image_id", "width", (F.size("labels") / F.col("width")).cast("int").alias("height"))
    return draw(region_loops(fitted), paints, sizes, stacked)
