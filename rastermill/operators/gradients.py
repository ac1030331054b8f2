"""Colour ramps inside regions: distance to the edge, linear and radial fits, colour profiles, stops.

Fits come from sums over pixels, so a region of any size shrinks to one row before anything is solved. Sums
of whole numbers stay whole: their order doesn't matter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")
STOPS = "array<struct<offset: double, r: double, g: double, b: double>>"


def edge_distance(labels: DataFrame, cap: int = 3, label: str = "region") -> DataFrame:
    """Pixels with `distance`: 1 where a side neighbour has another label, one more for each step (diagonals
    too) from there, `cap` at most. The image's own border is no edge.

    One exchange by image serves the windows over rows and over columns.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    differs = F.lit(False)
    for w in (row, column):
        for side in (F.lag, F.lead):
            differs = differs | F.coalesce(side(label).over(w) != F.col(label), F.lit(False))
    p = labels.repartition("image_id").withColumn("_edge", differs.cast("int"))
    near = [f"_near{k}" for k in range(cap - 1)]
    p = p.withColumns({c: F.max("_edge").over(row.rowsBetween(-k, k)) for k, c in enumerate(near)})
    p = p.withColumns({c: F.max(c).over(column.rowsBetween(-k, k)) for k, c in enumerate(near)})
    distance = F.coalesce(*[F.when(F.col(c) == 1, k + 1) for k, c in enumerate(near)], F.lit(cap))
    return p.withColumn("distance", distance.cast("int")).drop("_edge", *near)


def linear_ramps(pixels: DataFrame, margin: int = 1, label: str = "region") -> DataFrame:
    """One row for each region: `n` inner pixels, their centre, `rms` of a plane through all three channels,
    the direction (ux, uy) of the steepest change, slopes along it, and `ramp`, the change over four deviations.

    Pixels come with `distance`; those at most `margin` from an edge don't count. Colours are 0 to 1. Where
    the pixels don't span a plane the fit is flat.
    """
    return ramps_of(ramp_sums(pixels, margin, label), label)


#: Sums that a plane through three channels needs; they add up when regions merge.
SUMS = ("n", "sx", "sy", "sxx", "sxy", "syy", *(k for c in CHANNELS for k in (f"s{c}", f"sx{c}", f"sy{c}", f"s{c}{c}")))


def ramp_sums(pixels: DataFrame, margin: int = 1, label: str = "region") -> DataFrame:
    """`SUMS` over the inner pixels of each region."""
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    sums = {"sx": x, "sy": y, "sxx": x * x, "sxy": x * y, "syy": y * y}
    for c in CHANNELS:
        v = F.col(c).cast("long")
        sums |= {f"s{c}": v, f"sx{c}": v * x, f"sy{c}": v * y, f"s{c}{c}": v * v}
    return pixels.where(F.col("distance") > margin).groupBy("image_id", label).agg(F.count("*").alias("n"), *[F.sum(e).cast("double").alias(k) for k, e in sums.items()])


def ramps_of(s: DataFrame, label: str = "region") -> DataFrame:
    """The planes of `linear_ramps` from rows of `SUMS`."""

    def spread(both, one, other):
        return F.col(both) - F.col(one) * F.col(other) / F.col("n")

    s = s.withColumns({"cxx": spread("sxx", "sx", "sx"), "cxy": spread("sxy", "sx", "sy"), "cyy": spread("syy", "sy", "sy")})
    s = s.withColumns({k: e for c in CHANNELS for k, e in ((f"cx{c}", spread(f"sx{c}", "sx", f"s{c}")), (f"cy{c}", spread(f"sy{c}", "sy", f"s{c}")), (f"c{c}{c}", spread(f"s{c}{c}", f"s{c}", f"s{c}")))})
    det = F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")
    s = s.withColumn("det", F.when(det > 1e-9, det))
    for c in CHANNELS:
        a = (F.col(f"cx{c}") * F.col("cyy") - F.col(f"cy{c}") * F.col("cxy")) / F.col("det")
        b = (F.col(f"cy{c}") * F.col("cxx") - F.col(f"cx{c}") * F.col("cxy")) / F.col("det")
        s = s.withColumns({f"a{c}": F.coalesce(a, F.lit(0.0)), f"b{c}": F.coalesce(b, F.lit(0.0))})
        s = s.withColumn(f"e{c}", F.greatest(F.lit(0.0), F.col(f"c{c}{c}") - F.col(f"a{c}") * F.col(f"cx{c}") - F.col(f"b{c}") * F.col(f"cy{c}")))
    total = lambda f: f("r") + f("g") + f("b")
    gxx, gyy, gxy = (total(lambda c, p=p, q=q: F.col(f"{p}{c}") * F.col(f"{q}{c}")) for p, q in (("a", "a"), ("b", "b"), ("a", "b")))
    # a minus before zero turns a ramp around, and `atan2` here drops it
    below = (gxy == 0) & F.startswith(gxy.cast("string"), F.lit("-"))
    turn = F.when(below, -F.atan2(F.lit(0.0), gxx - gyy)).otherwise(F.atan2(2 * gxy, gxx - gyy)) / 2
    s = s.withColumn("turn", turn).withColumns({"ux": F.cos("turn"), "uy": F.sin("turn")})
    slopes = {f"slope_{c}": (F.col(f"a{c}") * F.col("ux") + F.col(f"b{c}") * F.col("uy")) / 255 for c in CHANNELS}
    s = s.withColumns(slopes | {"rms": F.sqrt(total(lambda c: F.col(f"e{c}")) / (3 * F.col("n"))) / 255, "cx": F.col("sx") / F.col("n"), "cy": F.col("sy") / F.col("n")})
    along = (F.col("cxx") * F.col("ux") * F.col("ux") + 2 * F.col("cxy") * F.col("ux") * F.col("uy") + F.col("cyy") * F.col("uy") * F.col("uy")) / F.col("n")
    steep = F.sqrt(total(lambda c: F.col(f"slope_{c}") * F.col(f"slope_{c}")))
    return s.withColumn("ramp", steep * 4 * F.sqrt(F.greatest(F.lit(0.0), along))).select("image_id", label, "n", "cx", "cy", "rms", "ramp", "ux", "uy", *slopes)


def plane(sums: np.ndarray) -> tuple[float, float]:
    """(rms, ramp) of one row of `SUMS`, as in `linear_ramps`."""
    n, sx, sy, sxx, sxy, syy = sums[:6]
    cxx, cxy, cyy = sxx - sx * sx / n, sxy - sx * sy / n, syy - sy * sy / n
    v, xv, yv, vv = sums[6:].reshape(3, 4).T
    cxv, cyv, cvv = xv - sx * v / n, yv - sy * v / n, vv - v * v / n
    det = cxx * cyy - cxy * cxy
    a, b = ((cxv * cyy - cyv * cxy) / det, (cyv * cxx - cxv * cxy) / det) if det > 1e-9 else (np.zeros(3), np.zeros(3))
    error = np.maximum(0, cvv - a * cxv - b * cyv).sum()
    turn = np.arctan2(2 * (a @ b), a @ a - b @ b) / 2
    ux, uy = np.cos(turn), np.sin(turn)
    along = max(0.0, (cxx * ux * ux + 2 * cxy * ux * uy + cyy * uy * uy) / n)
    return float(np.sqrt(error / (3 * n)) / 255), float(np.linalg.norm((a * ux + b * uy) / 255) * 4 * np.sqrt(along))


def merged(sums: np.ndarray, pairs, rms: float, grow: float = 1.6, slack: float = 0.006) -> list[int]:
    """For each region the first one of its group. `pairs` come longest border first; two groups become one if
    one plane fits both within `rms`, and within `grow` times the worse of their own planes plus `slack`."""
    of, total = list(range(len(sums))), sums.astype(float).copy()

    def first(i: int) -> int:
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for p, q in pairs:
        p, q = sorted((first(p), first(q)))
        both = total[p] + total[q]
        fit = round(plane(both)[0], 9)
        if p != q and fit <= rms and fit <= round(max(plane(total[p])[0], plane(total[q])[0]) * grow + slack, 9):
            of[q], total[p] = p, both
    return [first(i) for i in range(len(sums))]


def merged_ramps(sums: DataFrame, pairs: DataFrame, least: int = 16, ramp: float = 0.02, rms: float = 0.02, label: str = "region") -> DataFrame:
    """(image_id, region, grp, n): regions that have a ramp, and the smallest of those that share one with each.

    `sums` is `ramp_sums`, `pairs` (image_id, low, high, border). Regions are rows of sums, so an image's regions
    are one unit of work, not its pixels. Of equal borders the pair of the smaller regions merges first.
    """
    rows = sums.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col(label).cast("long").alias("id"), F.array(*[F.col(k).cast("double") for k in SUMS]).alias("s")))).alias("r"))
    met = pairs.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("border")).alias("o"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high")))).alias("p"))
    images = rows.join(met.hint("merge"), "image_id", "left").select(F.col("image_id").cast("long").alias("image_id"), F.col("r.id").alias("ids"), F.flatten("r.s").alias("s"), F.coalesce("p.low", F.array().cast("array<long>")).alias("low"), F.coalesce("p.high", F.array().cast("array<long>")).alias("high"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                ids, s, low, high = (b.column(k)[i].values.to_numpy() for k in ("ids", "s", "low", "high"))
                s = s.reshape(len(ids), -1)
                fits = [plane(row) for row in s]
                able = [k for k, (off, steep) in enumerate(fits) if s[k, 0] >= least and steep >= ramp and off <= rms]
                ids, s = ids[able], s[able]
                known = np.isin(low, ids) & np.isin(high, ids)
                group = merged(s, zip(np.searchsorted(ids, low[known]).tolist(), np.searchsorted(ids, high[known]).tolist(), strict=True), rms)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b.column("image_id")[i].as_py(), np.int64)), pa.array(ids), pa.array(ids[group]), pa.array(s[:, 0].astype(np.int64))], ["image_id", label, "grp", "n"])

    return images.mapInArrow(run, f"image_id long, {label} long, grp long, n long")


def has_ramp(least: int = 16, ramp: float = 0.02, rms: float = 0.02) -> Column:
    """Whether a row of `linear_ramps` is worth a gradient."""
    return (F.col("n") >= least) & (F.col("ramp") >= ramp) & (F.col("rms") <= rms)


def radial_ramps(pixels: DataFrame, linear: DataFrame, margin: int = 1, label: str = "region", least: int = 16) -> DataFrame:
    """Channels as straight lines of the distance from the centre of a region's inner pixels.

    `radius` is the largest distance of any pixel; `accepted` where the fit is close, closer than 0.7 of the
    plane's, and spans enough colour. Regions with fewer than `least` inner pixels, or whose pixels are all equally far, are left out.
    """
    centres = linear.select("image_id", label, "cx", "cy", F.col("rms").alias("linear_rms"))
    d = pixels.join(centres.hint("merge"), ["image_id", label]).withColumn("d", F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))))
    inner = F.col("distance") > margin
    own = lambda e: F.sum(F.when(inner, e))
    sums = [e for c in CHANNELS for e in (own(F.col(c) / 255.0).alias(f"s{c}"), own(F.col(c) / 255.0 * F.col("d")).alias(f"sd{c}"), own(F.col(c) / 255.0 * F.col(c) / 255.0).alias(f"s{c}{c}"))]
    s = d.groupBy("image_id", label, "cx", "cy", "linear_rms").agg(F.count_if(inner).alias("n"), F.max("d").alias("radius"), own(F.col("d")).alias("sd"), own(F.col("d") * F.col("d")).alias("sdd"), *sums)
    n = F.col("n")
    s = s.withColumn("_spread", n * F.col("sdd") - F.col("sd") * F.col("sd")).where((n >= least) & (F.col("_spread") > 1e-6))
    error = F.lit(0.0)
    for c in CHANNELS:
        s = s.withColumn(f"slope_{c}", (n * F.col(f"sd{c}") - F.col("sd") * F.col(f"s{c}")) / F.col("_spread"))
        s = s.withColumn(f"base_{c}", (F.col(f"s{c}") - F.col(f"slope_{c}") * F.col("sd")) / n)
        error = error + F.greatest(F.lit(0.0), F.col(f"s{c}{c}") - F.col(f"base_{c}") * F.col(f"s{c}") - F.col(f"slope_{c}") * F.col(f"sd{c}"))
    steep = F.sqrt(F.col("slope_r") * F.col("slope_r") + F.col("slope_g") * F.col("slope_g") + F.col("slope_b") * F.col("slope_b"))
    s = s.withColumns({"rms": F.round(F.sqrt(error / (3 * n)), 6), "ramp": F.round(steep * F.col("radius"), 6), "linear_rms": F.round("linear_rms", 6)})
    s = s.withColumn("accepted", (F.col("rms") <= 0.02) & (F.col("rms") < F.round(F.col("linear_rms") * 0.7, 6)) & (F.col("ramp") >= 0.08))
    return s.select("image_id", label, "n", "cx", "cy", "radius", *[f"{k}_{c}" for k in ("slope", "base") for c in CHANNELS], "rms", "ramp", "accepted")


def along_axis(pixels: DataFrame, linear: DataFrame, label: str = "region") -> DataFrame:
    """Pixels with `t`: where they lie, 0 to 1, between the ends of their region along its ramp."""
    s = pixels.join(linear.select("image_id", label, "ux", "uy").hint("merge"), ["image_id", label]).withColumn("t", F.col("x") * F.col("ux") + F.col("y") * F.col("uy"))
    ends = s.groupBy("image_id", label).agg(F.min("t").alias("_from"), F.max("t").alias("_to"))
    return s.join(ends.hint("merge"), ["image_id", label]).withColumn("t", F.round((F.col("t") - F.col("_from")) / F.greatest(F.lit(1e-9), F.col("_to") - F.col("_from")), 9)).withColumn("span", F.col("_to") - F.col("_from")).drop("_from", "_to")


def profile(placed: DataFrame, bins: int = 24, least: int = 4, margin: int = 1, label: str = "region") -> DataFrame:
    """Mean colours of inner pixels in equal bins of `t`; bins of fewer than `least` pixels are left out."""
    at = F.least(F.lit(bins - 1), F.floor(F.round(F.col("t") * bins, 7))).cast("int")
    p = placed.where(F.col("distance") > margin).groupBy("image_id", label, at.alias("bin")).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in CHANNELS], F.first("span").alias("span"))
    return p.where(F.col("n") >= least)


def simplified(stops: list, tolerance: float) -> list:
    """The fewest of the stops found by halving at the worst one, until all lie within the tolerance."""
    if len(stops) <= 2:
        return stops
    (a, *_), (b, *_) = stops[0], stops[-1]
    worst, at = tolerance, None
    for i, (o, *colour) in enumerate(stops[1:-1], 1):
        w = (o - a) / max(1e-9, b - a)
        off = max(abs(p + (q - p) * w - v) for p, q, v in zip(stops[0][1:], stops[-1][1:], colour, strict=True))
        if off > worst:
            worst, at = off, i
    if at is None:
        return [stops[0], stops[-1]]
    return simplified(stops[: at + 1], tolerance)[:-1] + simplified(stops[at:], tolerance)


def _fewest(stops: Column, tolerance: float) -> Column:
    @F.pandas_udf(STOPS)
    def few(lists: pd.Series) -> pd.Series:
        keys = ("offset", *CHANNELS)
        return lists.map(lambda stops: [dict(zip(keys, s, strict=True)) for s in simplified([tuple(s[k] for k in keys) for s in stops], tolerance)])

    return few(stops)


def linear_stops(profiles: DataFrame, linear: DataFrame, bins: int = 24, tolerance: float = 3.0, label: str = "region") -> DataFrame:
    """(image_id, label, stops): the profile, drawn on to both ends along the fitted slope, in few stops.

    A region has at most `bins` samples, so its list is bounded.
    """

    sample = F.struct(((F.col("bin") + 0.5) / bins).alias("offset"), *CHANNELS)
    s = profiles.groupBy("image_id", label).agg(F.array_sort(F.collect_list(sample)).alias("s"), F.first("span").alias("span")).join(linear.hint("merge"), ["image_id", label])

    def end(near: Column, offset: float) -> Column:
        channels = [F.greatest(F.lit(0.0), F.least(F.lit(255.0), near[c] + F.col(f"slope_{c}") * 255 * F.col("span") * (F.lit(offset) - near["offset"]))).alias(c) for c in CHANNELS]
        return F.array(F.struct(F.lit(offset).alias("offset"), *channels))

    whole = F.concat(end(F.element_at("s", 1), 0.0), F.col("s"), end(F.element_at("s", -1), 1.0))
    return s.select("image_id", label, _fewest(whole, tolerance).alias("stops"))


def around_centre(pixels: DataFrame, radial: DataFrame, label: str = "region") -> DataFrame:
    """Pixels with `t`: how far they are from the centre of their region, of the farthest one's distance."""
    s = pixels.join(radial.select("image_id", label, "cx", "cy", F.col("radius").alias("span")).hint("merge"), ["image_id", label])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return s.withColumn("t", F.round(F.sqrt(dx * dx + dy * dy) / F.greatest(F.lit(1e-9), F.col("span")), 9)).drop("cx", "cy")


def radial_stops(profiles: DataFrame, radial: DataFrame, bins: int = 24, tolerance: float = 3.0, label: str = "region") -> DataFrame:
    """(image_id, label, stops): the profile between the fitted colours of centre and rim, in few stops.

    A region without a bin full enough has those two alone.
    """
    sample = F.struct(((F.col("bin") + 0.5) / bins).alias("offset"), *CHANNELS)
    samples = profiles.groupBy("image_id", label).agg(F.array_sort(F.collect_list(sample)).alias("s"))
    s = radial.join(samples.hint("merge"), ["image_id", label], "left")

    def fitted(offset: float) -> Column:
        channels = [F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255 * (F.col(f"base_{c}") + F.col(f"slope_{c}") * F.col("radius") * offset))).alias(c) for c in CHANNELS]
        return F.array(F.struct(F.lit(offset).alias("offset"), *channels))

    return s.select("image_id", label, _fewest(F.when(F.col("s").isNull(), F.concat(fitted(0.0), fitted(1.0))).otherwise(F.concat(fitted(0.0), F.col("s"), fitted(1.0))), tolerance).alias("stops"))


def linear_ends(pixels: DataFrame, linear: DataFrame, label: str = "region") -> DataFrame:
    """(image_id, label, place): x1, y1, x2, y2 of the ramp's line through the centre, in units of pixels."""
    s = pixels.join(linear.select("image_id", label, "cx", "cy", "ux", "uy").hint("merge"), ["image_id", label])
    along = F.col("x") * F.col("ux") + F.col("y") * F.col("uy")
    s = s.groupBy("image_id", label, "cx", "cy", "ux", "uy").agg(F.min(along).alias("from"), F.max(along).alias("to"))
    middle = F.col("cx") * F.col("ux") + F.col("cy") * F.col("uy")
    return s.select("image_id", label, F.array(*[F.col(f"c{d}") + (F.col(end) - middle) * F.col(f"u{d}") + 0.5 for end in ("from", "to") for d in "xy"]).alias("place"))


def colour_at(stops: Column, t: Column, channel: str) -> Column:
    """The channel of a list of stops at `t`: straight between stops, constant beyond the ends."""
    low = F.coalesce(F.try_element_at(F.filter(stops, lambda s: s["offset"] <= t), F.lit(-1)), F.element_at(stops, 1))
    high = F.coalesce(F.try_element_at(F.filter(stops, lambda s: s["offset"] >= t), F.lit(1)), F.element_at(stops, -1))
    w = F.when(high["offset"] > low["offset"], (t - low["offset"]) / (high["offset"] - low["offset"])).otherwise(0.0)
    return low[channel] + (high[channel] - low[channel]) * w


def fill_errors(placed: DataFrame, stops: DataFrame, label: str = "region") -> DataFrame:
    """Squared error of each region drawn flat and drawn with its stops; `kept` where the gradient is no worse."""
    means = placed.groupBy("image_id", label).agg(*[F.avg(c).alias(f"_m{c}") for c in CHANNELS])
    p = placed.join(stops.hint("merge"), ["image_id", label]).join(means.hint("merge"), ["image_id", label])
    d = lambda c, to: (F.col(c) - to) * (F.col(c) - to)
    flat = sum((d(c, F.col(f"_m{c}")) for c in CHANNELS), F.lit(0.0))
    drawn = sum((d(c, colour_at(F.col("stops"), F.col("t"), c)) for c in CHANNELS), F.lit(0.0))
    e = p.groupBy("image_id", label).agg(F.sum(flat).alias("flat_error"), F.sum(drawn).alias("gradient_error"))
    return e.withColumn("kept", F.col("gradient_error") <= F.col("flat_error"))
