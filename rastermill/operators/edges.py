"""What happens at the borders of regions: slivers of blended colour, edges and gaps, junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .images import region_sizes, with_oklab


def composite_white(pixels: DataFrame) -> DataFrame:
    """Pixels as they look on white paper; alpha stays."""
    share = F.col("a") / 255.0
    return pixels.withColumns({c: F.floor(F.col(c) * share + 255 * (1 - share) + 0.5).cast("int") for c in "rgb"})


def flattened(pixels: DataFrame) -> DataFrame:
    """Pixels on white paper without any alpha, as files that have none hold them."""
    return composite_white(pixels).withColumn("a", F.lit(255))


def straight(pixels: DataFrame) -> DataFrame:
    """Pixels whose colours were multiplied by alpha, with the colours they had; full and no alpha leave them alone."""
    part = (F.col("a") > 0) & (F.col("a") < 255)
    return pixels.withColumns({c: F.when(part, F.least(F.lit(255), F.floor(F.col(c) * 255 / F.when(part, F.col("a")).otherwise(1) + 0.5))).otherwise(F.col(c)).cast("int") for c in "rgb"})


def edge_pixels(pixels: DataFrame, reach: float = 0.1) -> DataFrame:
    """(image_id, edges): pixels whose right or lower neighbour differs clearly in OKLab; last row and column don't count."""
    p = with_oklab(pixels.repartition("image_id"))
    right, down = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    far = [sum(((F.col(c) - F.lead(c).over(w)) * (F.col(c) - F.lead(c).over(w)) for c in "lmn"), F.lit(0.0)) > reach * reach for w in (right, down)]
    inside = F.lead("l").over(right).isNotNull() & F.lead("l").over(down).isNotNull()
    return p.select("image_id", (inside & (far[0] | far[1])).alias("edge")).groupBy("image_id").agg(F.count_if("edge").alias("edges"))


def gap_pixels(truth: DataFrame, traced: DataFrame, below: int = 200) -> DataFrame:
    """(image_id, opaque, gaps): see-through pixels in `traced` whose 5 x 5 surroundings are opaque in `truth`."""
    row, column = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-2, 2), Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-2, 2)
    t = truth.repartition("image_id").withColumns({"_low": F.min("a").over(row), "_n": F.count("a").over(row)})
    t = t.withColumns({"_low": F.min("_low").over(column), "_n": F.sum("_n").over(column)})
    both = t.join(traced.select("image_id", "x", "y", F.col("a").alias("_a")).hint("merge"), ["image_id", "x", "y"])
    return both.groupBy("image_id").agg(F.count_if(F.col("a") == 255).alias("opaque"), F.count_if((F.col("_low") == 255) & (F.col("_n") == 25) & (F.col("_a") < below)).alias("gaps"))


def slivers(labels: DataFrame, palette: DataFrame, half_thickness: float = 1.0) -> DataFrame:
    """(image_id, region, first, second): thin regions whose colour is a blend of their two longest neighbours.

    Pixels are (image_id, x, y, label, region), the palette (image_id, label, r, g, b). Of neighbour labels with
    equal borders the smaller counts as longer. Label -1, transparent, is nobody's neighbour.
    """
    thin = region_sizes(labels).where(F.col("thickness") < half_thickness).select("image_id", "region")
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    sides = [labels.select("image_id", "region", "label", side("region").over(w).alias("_r"), side("label").over(w).alias("other")) for w in (row, column) for side in (F.lag, F.lead)]
    met = sides[0].union(sides[1]).union(sides[2]).union(sides[3]).where("_r is not null and _r <> region and label <> -1 and other <> -1 and other <> label")
    borders = met.join(thin.hint("merge"), ["image_id", "region"]).groupBy("image_id", "region", "label", "other").agg(F.count("*").alias("border"))
    place = F.row_number().over(Window.partitionBy("image_id", "region").orderBy(F.desc("border"), "other"))
    two = borders.withColumn("place", place).groupBy("image_id", "region", "label").agg(F.max(F.when(F.col("place") == 1, F.col("other"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("other"))).alias("second")).where("second is not null")
    for key in ("label", "first", "second"):
        two = two.join(palette.select("image_id", F.col("label").alias(key), *[(F.col(c) / 255.0).alias(f"{key}_{c}") for c in "rgb"]).hint("merge"), ["image_id", key])
    step = {c: F.col(f"second_{c}") - F.col(f"first_{c}") for c in "rgb"}
    off = {c: F.col(f"label_{c}") - F.col(f"first_{c}") for c in "rgb"}
    length = sum((d * d for d in step.values()), F.lit(0.0))
    t = F.try_divide(sum((off[c] * step[c] for c in "rgb"), F.lit(0.0)), length)
    two = two.withColumn("t", F.round(t, 9))
    away = F.sqrt(sum(((off[c] - step[c] * t) * (off[c] - step[c] * t) for c in "rgb"), F.lit(0.0)))
    return two.where((F.col("t") >= 0.05) & (F.col("t") <= 0.95) & (F.round(away, 9) < 0.12)).select("image_id", "region", "first", "second")


def dissolve(labels: DataFrame, palette: DataFrame, half_thickness: float = 1.0) -> DataFrame:
    """Pixels (image_id, x, y, label): those of slivers go to the closer of the two neighbours in OKLab, the first on a tie.

    `labels` also holds `region` and r, g, b of each pixel.
    """
    found = slivers(labels, palette, half_thickness)
    tints = with_oklab(palette).select("image_id", "label", "l", "m", "n")
    for key in ("first", "second"):
        found = found.join(tints.select("image_id", F.col("label").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in "lmn"]).hint("merge"), ["image_id", key])
    p = with_oklab(labels).join(found.hint("merge"), ["image_id", "region"], "left")
    d = [F.round(sum(((F.col(c) - F.col(f"{k}_{c}")) * (F.col(c) - F.col(f"{k}_{c}")) for c in "lmn"), F.lit(0.0)), 9) for k in ("first", "second")]
    return p.select("image_id", "x", "y", F.when(F.col("first").isNull(), F.col("label")).when(d[0] <= d[1], F.col("first")).otherwise(F.col("second")).alias("label"))


def refine_junctions(ends: DataFrame, size: DataFrame, most: float = 1.0, pull: float = 0.02) -> DataFrame:
    """Each junction moved to where the lines that end in it nearly meet, at most `most` away.

    `ends` holds (image_id, jx, jy, dx, dy, cx, cy, support): unit direction and a point of each line, and how many
    points it rests on; `size` (image_id, width, height). Weights are square roots of support, and a weak pull keeps the
    junction where it was if the lines don't say. Junctions on the image's border stay on it.
    """
    nx, ny, w = -F.col("dy"), F.col("dx"), F.sqrt("support")
    away = nx * (F.col("cx") - F.col("jx")) + ny * (F.col("cy") - F.col("jy"))
    s = ends.groupBy("image_id", "jx", "jy").agg(F.sum(w * nx * nx).alias("a"), F.sum(w * nx * ny).alias("b"), F.sum(w * ny * ny).alias("c"), F.sum(w * nx * away).alias("d"), F.sum(w * ny * away).alias("e"))
    s = s.withColumns({"a": F.col("a") + pull, "c": F.col("c") + pull}).withColumn("det", F.col("a") * F.col("c") - F.col("b") * F.col("b"))
    s = s.withColumns({"ox": (F.col("c") * F.col("d") - F.col("b") * F.col("e")) / F.col("det"), "oy": (F.col("a") * F.col("e") - F.col("b") * F.col("d")) / F.col("det")})
    s = s.withColumn("scale", F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(most), F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy"))), F.lit(1.0)))).join(size.hint("merge"), "image_id")
    moved = lambda j, o, top: F.when((F.col(j) == 0) | (F.col(j) == F.col(top)), F.col(j).cast("double")).otherwise(F.col(j) + F.col(o) * F.col("scale"))
    return s.select("image_id", "jx", "jy", moved("jx", "ox", "width").alias("x"), moved("jy", "oy", "height").alias("y"))
