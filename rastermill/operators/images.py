"""Image statistics over a pixel relation (image_id, x, y, r, g, b, a). All windows are within one image."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import half_up, luma, oklab, quantised
from ..sources.shared import save


def _row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def _column():
    return Window.partitionBy("image_id", "x").orderBy("y")


def analyse(pixels: DataFrame, edge: float = 24, quiet: float = 4) -> DataFrame:
    """Shares of transparent, gray, edge and noisy samples and the number of colours of each image."""
    y = pixels.withColumn("luma", luma(F.col("r"), F.col("g"), F.col("b")))
    d = y.withColumn("d", F.col("luma") - F.lag("luma").over(_row()))
    sign = F.when(F.col("d") != 0, F.signum("d"))
    s = d.withColumn("before", F.last(sign, ignorenulls=True).over(_row().rowsBetween(Window.unboundedPreceding, -1)))
    flips = (F.abs("d") >= quiet) & (F.abs("d") <= edge) & (F.signum("d") * F.col("before") < 0)
    one = lambda p: F.sum(F.when(p, 1).otherwise(0))
    spread = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    return s.groupBy("image_id").agg(
        F.count("*").alias("n"), F.countDistinct(quantised(F.col("r"), F.col("g"), F.col("b"))).alias("colours"), one(F.col("a") < 250).alias("transparent"), one(spread <= 10).alias("gray"),
        F.count("d").alias("compared"), one(F.abs("d") > edge).alias("edges"), one(F.coalesce(flips, F.lit(False))).alias("noisy"),
    )


def sampled(pixels: DataFrame, most: int = 10_000) -> DataFrame:
    """Every k-th pixel of every k-th row of each image: k is the root of its pixels over `most`, rounded down, one at least.

    There are few different k, so pixels on nobody's grid go before any is moved to its image's k.
    """
    size = pixels.groupBy("image_id").agg(((F.max("x") + 1) * (F.max("y") + 1)).alias("_size"))
    stride = save(size.select("image_id", F.greatest(F.lit(1), F.floor(F.sqrt(F.col("_size") / most))).cast("int").alias("_stride")), "strides")
    for_some = [(F.col("x") % k == 0) & (F.col("y") % k == 0) for k in sorted(r[0] for r in stride.select("_stride").distinct().collect())]
    return pixels.where(reduce(lambda p, q: p | q, for_some, F.lit(False))).join(stride.hint("merge"), "image_id").where((F.col("x") % F.col("_stride") == 0) & (F.col("y") % F.col("_stride") == 0)).select(*pixels.columns)


def recommend(stats: DataFrame) -> DataFrame:
    """Complexity and the kind of picture, by the first rule that fits."""
    share = lambda c, n: F.coalesce(F.try_divide(F.col(c), F.col(n)), F.lit(0.0))
    s = stats.withColumns({"has_alpha": share("transparent", "n") >= 0.01, "edge_share": share("edges", "compared"), "is_gray": share("gray", "n") >= 0.97})
    s = s.withColumn("complexity", F.least(F.lit(1.0), 0.5 * F.least(F.lit(1.0), F.col("colours") / 64.0) + 0.5 * F.least(F.lit(1.0), F.col("edge_share") * 4)))
    kind = F.when(F.col("complexity") >= 0.6, "photo").when(F.col("colours") > 32, "illustration").when((F.col("colours") <= 16) & F.col("has_alpha"), "sticker").when((F.col("colours") <= 6) & (F.col("complexity") < 0.2), "icon").otherwise("logo")
    return s.withColumn("kind", kind)


def dominant(pixels: DataFrame, top: int = 5) -> DataFrame:
    """The most frequent quantised colours of each image; of equally frequent ones the first seen."""
    q = pixels.withColumn("colour", quantised(F.col("r"), F.col("g"), F.col("b"))).groupBy("image_id", "colour").agg(F.count("*").alias("n"), F.min(F.col("y") * 65536 + F.col("x")).alias("seen"))
    return q.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("n"), "seen"))).where(F.col("place") <= top).drop("seen")


def flat_fraction(pixels: DataFrame, levels: int = 3) -> DataFrame:
    """Share of pixels that differ by few levels from the right and the lower neighbour."""
    near = [F.abs(F.col(c) - F.lead(c).over(w())) <= levels for c in "rgb" for w in (_row, _column)]
    both = near[0]
    for p in near[1:]:
        both = both & p
    inner = F.lead("r").over(_row()).isNotNull() & F.lead("r").over(_column()).isNotNull()
    return pixels.withColumns({"flat": both, "_inner": inner}).where("_inner").groupBy("image_id").agg(F.count("*").alias("n"), F.sum(F.col("flat").cast("int")).alias("n_flat"))


def noise_sigma(pixels: DataFrame) -> DataFrame:
    """1.4826 / sqrt(20) times the upper median of absolute Laplacians of luma, rounded to six places."""
    y = pixels.withColumn("l", luma(F.col("r"), F.col("g"), F.col("b")))
    around = F.lag("l").over(_row()) + F.lead("l").over(_row()) + F.lag("l").over(_column()) + F.lead("l").over(_column())
    v = y.withColumn("v", F.abs(4 * F.col("l") - around)).where("v is not null")
    ranked = v.withColumns({"k": F.row_number().over(Window.partitionBy("image_id").orderBy("v")), "m": F.count("*").over(Window.partitionBy("image_id"))})
    return ranked.where("k = floor(m / 2) + 1").select("image_id", F.round(F.col("v") * 1.4826 / F.sqrt(F.lit(20.0)), 6).alias("sigma"))


def box_downscale(pixels: DataFrame, k: int = 2) -> DataFrame:
    """Means of k x k blocks: colours weighted by alpha, alpha plain; halves go up."""
    mean = lambda c: F.coalesce(half_up(F.try_divide(F.sum(F.col(c) * F.col("a")), F.sum("a"))), F.lit(0)).cast("int").alias(c)
    return pixels.groupBy("image_id", F.floor(F.col("x") / k).cast("int").alias("x"), F.floor(F.col("y") / k).cast("int").alias("y")).agg(mean("r"), mean("g"), mean("b"), half_up(F.avg("a")).cast("int").alias("a"))


def with_oklab(pixels: DataFrame) -> DataFrame:
    """Pixels with `l`, `m`, `n`: lightness and the two chroma axes."""
    return pixels.withColumns(dict(zip(("l", "m", "n"), oklab(F.col("r"), F.col("g"), F.col("b")), strict=True)))


def flat_mask(pixels: DataFrame, reach: float = 0.035, opaque: int = 128) -> DataFrame:
    """`flat`: opaque, with every neighbour that exists opaque and close in OKLab."""
    p = with_oklab(pixels)
    ok = F.col("a") >= opaque
    for w in (_row, _column):
        for shift in (F.lag, F.lead):
            d = sum(((F.col(c) - shift(c).over(w())) * (F.col(c) - shift(c).over(w())) for c in "lmn"), F.lit(0.0))
            ok = ok & F.coalesce((d <= reach * reach) & (shift("a").over(w()) >= opaque), F.lit(True))
    return p.withColumn("flat", ok)


def palette_support(flat: DataFrame, opaque: int = 128) -> DataFrame:
    """(image_id, n_opaque, n_flat, use_all) of `flat_mask`: whether flat pixels are too few, below 16 or a twentieth of
    the opaque ones, to tell an image's colours alone."""
    n = flat.groupBy("image_id").agg(F.count_if(F.col("a") >= opaque).alias("n_opaque"), F.count_if("flat").alias("n_flat"))
    return n.withColumn("use_all", F.col("n_flat") < F.greatest(F.lit(16.0), F.col("n_opaque") * 0.05))


def palette_pixels(pixels: DataFrame, opaque: int = 128) -> DataFrame:
    """The pixels that an image's palette is made of: flat ones, or where they are too few every opaque one."""
    flat = flat_mask(pixels, opaque=opaque)
    use = palette_support(flat, opaque).select("image_id", "use_all")
    return flat.join(use.hint("merge"), "image_id").where((F.col("a") >= opaque) & (F.col("use_all") | F.col("flat"))).select(*pixels.columns)


def palette_bins(pixels: DataFrame, size: float = 0.008, opaque: int = 128) -> DataFrame:
    """Opaque pixels by OKLab cell, with the sums that clusters are made of: additive, so bins can merge."""
    p = with_oklab(pixels.where(F.col("a") >= opaque))
    keys = [F.floor(F.col(c) / size).cast("long").alias(f"bin_{c}") for c in "lmn"]
    sums = [F.sum(c).alias(f"sum_{c}") for c in ("l", "m", "n", "r", "g", "b")]
    return p.groupBy("image_id", *keys).agg(F.count("*").alias("weight"), *sums, F.sum(F.col("l") * F.col("l") + F.col("m") * F.col("m") + F.col("n") * F.col("n")).alias("sum_sq"))


def nearest_colour(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """The label of the closest palette colour of the same image, for each pixel; ties: the lowest.

    A palette is a few dozen colours: it goes along as one array to its image's distinct colours, each of which is
    compared once; a colour's label goes back to its pixels with the one exchange by image and colour.
    """
    colours = with_oklab(pixels.select("image_id", "r", "g", "b").distinct())
    p = palette.groupBy("image_id").agg(F.collect_list(F.struct("l", "m", "n", "label")).alias("_palette"))

    def near(q):
        d = sum(((F.col(c) - q[c]) * (F.col(c) - q[c]) for c in "lmn"), F.lit(0.0))
        return F.struct(F.round(d, 9).alias("d"), q["label"].alias("label"))

    best = colours.join(p.hint("merge"), "image_id").select("image_id", "r", "g", "b", F.array_min(F.transform("_palette", near))["label"].alias("label"))
    return pixels.join(best.hint("merge"), ["image_id", "r", "g", "b"])


def palette_of_dominant(pixels: DataFrame, top: int = 5) -> DataFrame:
    """(image_id, label, weight, l, m, n): the dominant quantised colours as a palette."""
    d = dominant(pixels, top)
    back = d.select("image_id", (F.col("place") - 1).alias("label"), F.col("n").alias("weight"), *[F.least(F.lit(255), F.floor(F.col("colour") / k) % 256 * 8).cast("int").alias(c) for c, k in (("r", 65536), ("g", 256), ("b", 1))])
    return with_oklab(back)


def blend_colours(palette: DataFrame, residual: float = 0.03, lighter: int = 12) -> DataFrame:
    """Palette colours `lighter` times lighter in weight than two others, and close to the line between them."""
    c, p, q = (palette.select("image_id", *[F.col(x).alias(f"{k}_{x}") for x in ("label", "weight", "l", "m", "n")]) for k in "cpq")
    # only heavy enough partners meet: a third colour joins few pairs, not all
    heavier = lambda k: (F.col("c_weight") * lighter < F.col(f"{k}_weight")) & (F.col("c_label") != F.col(f"{k}_label"))
    pairs = c.join(p.hint("merge"), "image_id").where(heavier("p")).join(q.hint("merge"), "image_id").where(heavier("q") & (F.col("p_label") < F.col("q_label")))
    along = sum(((F.col(f"c_{x}") - F.col(f"p_{x}")) * (F.col(f"q_{x}") - F.col(f"p_{x}")) for x in "lmn"), F.lit(0.0))
    length = sum(((F.col(f"q_{x}") - F.col(f"p_{x}")) * (F.col(f"q_{x}") - F.col(f"p_{x}")) for x in "lmn"), F.lit(0.0))
    t = F.try_divide(along, length)
    off = sum(((F.col(f"c_{x}") - F.col(f"p_{x}") - t * (F.col(f"q_{x}") - F.col(f"p_{x}"))) * (F.col(f"c_{x}") - F.col(f"p_{x}") - t * (F.col(f"q_{x}") - F.col(f"p_{x}"))) for x in "lmn"), F.lit(0.0))
    return pairs.where((t > 0.08) & (t < 0.92) & (off < residual * residual)).select("image_id", F.col("c_label").alias("label")).distinct()


def neighbour_pairs(labels: DataFrame, label: str = "region") -> DataFrame:
    """(image_id, low, high, border): how many pixel sides two labels share."""
    sides = [labels.select("image_id", F.col(label).alias("p"), F.lead(label).over(w()).alias("q")) for w in (_row, _column)]
    met = sides[0].union(sides[1]).where("q is not null and p <> q")
    return met.groupBy("image_id", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high")).agg(F.count("*").alias("border"))


def region_sizes(labels: DataFrame, label: str = "region") -> DataFrame:
    """Area, boundary (sides to another label) and thickness (area over boundary) of each region."""
    pairs = neighbour_pairs(labels, label)
    both = pairs.select("image_id", F.col("low").alias(label), "border").union(pairs.select("image_id", F.col("high").alias(label), "border"))
    edge = both.groupBy("image_id", label).agg(F.sum("border").alias("boundary"))
    area = labels.groupBy("image_id", label).agg(F.count("*").alias("area"))
    return area.join(edge.hint("merge"), ["image_id", label], "left").withColumn("boundary", F.coalesce("boundary", F.lit(0))).withColumn("thickness", F.try_divide(F.col("area"), F.col("boundary")))


def cracks(labels: DataFrame, label: str = "region") -> DataFrame:
    """(image_id, x1, y1, x2, y2): unit sides between unequal labels, outside the image counting as another."""
    out = []
    for w, vertical in ((_row, True), (_column, False)):
        before = F.coalesce(F.lag(label).over(w()), F.lit(-1))
        last = F.lead(label).over(w()).isNull()
        p = labels.withColumns({"_before": before, "_last": last})
        x, y = F.col("x"), F.col("y")
        side = (x, y, x, y + 1) if vertical else (x, y, x + 1, y)
        far = (x + 1, y, x + 1, y + 1) if vertical else (x, y + 1, x + 1, y + 1)
        for rows, (a, b, c, d) in ((p.where(F.col(label) != F.col("_before")), side), (p.where("_last"), far)):
            out.append(rows.select("image_id", a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))
    return out[0].union(out[1]).union(out[2]).union(out[3])


def junctions(sides: DataFrame) -> DataFrame:
    """Corners where three or more sides meet."""
    ends = sides.select("image_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("image_id", "p.x", "p.y")
    return ends.groupBy("image_id", "x", "y").agg(F.count("*").alias("degree")).where("degree >= 3")


def linear_fits(labels: DataFrame, label: str = "region", value: str = "r") -> DataFrame:
    """Least-squares plane of a channel over each region, from additive sums; flat where none is determined."""
    x, y, v = F.col("x").cast("double"), F.col("y").cast("double"), F.col(value).cast("double")
    s = labels.groupBy("image_id", label).agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sx", x), ("sy", y), ("sxx", x * x), ("sxy", x * y), ("syy", y * y), ("sv", v), ("sxv", x * v), ("syv", y * v), ("svv", v * v))])
    n = F.col("n")
    cxx, cyy, cxy = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n, F.col("sxy") - F.col("sx") * F.col("sy") / n
    cxv, cyv, cvv = F.col("sxv") - F.col("sx") * F.col("sv") / n, F.col("syv") - F.col("sy") * F.col("sv") / n, F.col("svv") - F.col("sv") * F.col("sv") / n
    det = cxx * cyy - cxy * cxy
    sure = det > 1e-9
    a = F.when(sure, (cxv * cyy - cyv * cxy) / F.when(sure, det).otherwise(1.0)).otherwise(0.0)
    b = F.when(sure, (cyv * cxx - cxv * cxy) / F.when(sure, det).otherwise(1.0)).otherwise(0.0)
    fitted = s.withColumns({"slope_x": a, "slope_y": b, "flat_error": cvv, "_gain": F.when(sure, a * cxv + b * cyv).otherwise(0.0)})
    return fitted.withColumn("fit_error", F.greatest(F.lit(0.0), F.col("flat_error") - F.col("_gain"))).select("image_id", label, "n", "slope_x", "slope_y", "flat_error", "fit_error")


def diff_metrics(truth: DataFrame, traced: DataFrame) -> DataFrame:
    """Mean and bad share of OKLab distance, and alpha error, of each image against its truth."""
    names = ["l", "m", "n", "a"]
    p = with_oklab(truth).select("image_id", "x", "y", *names)
    q = with_oklab(traced).select("image_id", "x", "y", *[F.col(c).alias(f"t_{c}") for c in names])
    d = F.sqrt(sum(((F.col(c) - F.col(f"t_{c}")) * (F.col(c) - F.col(f"t_{c}")) for c in "lmn"), F.lit(0.0)))
    both = p.join(q.hint("merge"), ["image_id", "x", "y"]).withColumn("d", d)
    return both.groupBy("image_id").agg(F.count("*").alias("n"), F.avg("d").alias("mean_delta"), F.sum((F.col("d") > 0.1).cast("int")).alias("n_bad"), F.avg(F.abs(F.col("a") - F.col("t_a"))).alias("alpha_error"))


def upscale_mask(masks: DataFrame, factor: int) -> DataFrame:
    """(image_id, x, y, mask) on a grid `factor` times as fine.

    A fine pixel is set if all coarse ones are that bilinear upscaling blends into it. Each coarse pixel
    makes the fine ones that it is the upper left source of, so nothing is joined.
    """
    if factor <= 1:
        return masks.select("image_id", "x", "y", "mask")
    m = masks.withColumn("mask", F.col("mask") & F.coalesce(F.lead("mask").over(_row()), F.col("mask")))
    m = m.withColumn("mask", F.col("mask") & F.coalesce(F.lead("mask").over(_column()), F.col("mask")))
    m = m.withColumns({f"_{d}": F.max(d).over(Window.partitionBy("image_id")) for d in "xy"})
    for d in "xy":  # fine places run from the coarse one's middle to the next one's, at both borders to the end
        first = F.when(F.col(d) == 0, 0).otherwise(F.col(d) * factor + factor // 2)
        last = F.when(F.col(d) == F.col(f"_{d}"), (F.col(d) + 1) * factor - 1).otherwise((F.col(d) + 1) * factor + factor // 2 - 1)
        m = m.withColumn(d, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return m.select("image_id", "x", "y", "mask")


def purest(pixels: DataFrame, by, share: float = 0.4, label: str = "region") -> DataFrame:
    """Mean colour of the first `share` of each label's pixels in an order, one at least; places break ties."""
    own = Window.partitionBy("image_id", label)
    ranked = pixels.withColumns({"_k": F.row_number().over(own.orderBy(by, "y", "x")), "_n": F.count("*").over(own)})
    return ranked.where(F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * share))).groupBy("image_id", label).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "rgb"])


def label_candidates(labels: DataFrame, label: str = "region") -> DataFrame:
    """`candidates`: a pixel's own label and those of its side neighbours, each once, in this order."""
    beside = [side(label).over(w()) for w in (_row, _column) for side in (F.lag, F.lead)]
    return labels.withColumn("candidates", F.array_distinct(F.array_compact(F.array(F.col(label), *beside))))
