"""Thin regions that belong to a neighbouring gradient."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import save

PLACES = 9


def _sum(parts) -> Column:
    return reduce(lambda p, q: p + q, parts)


def to_segment(c, p, q) -> Column:
    """Distance of a colour from the straight way between two others; channels to 1."""
    way, off = {x: q[x] - p[x] for x in "rgb"}, {x: c[x] - p[x] for x in "rgb"}
    t = F.coalesce(F.try_divide(_sum(off[x] * way[x] for x in "rgb"), _sum(way[x] * way[x] for x in "rgb")), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.round(F.sqrt(_sum((off[x] - way[x] * t) * (off[x] - way[x] * t) for x in "rgb")), PLACES)


def absorb_slivers(regions: DataFrame, borders: DataFrame, paths: DataFrame, rounds: int = 4, thin: float = 0.25, on_path: float = 0.08, on_blend: float = 0.05) -> DataFrame:
    """(image_id, region, grp) of `regions`, where thin ones without a group have joined a neighbour's gradient.

    `regions` has (image_id, region, inner, area, r, g, b, grp, fixed): pixels off the edge and in all, the mean colour
    (channels to 1), the gradient group or null, and whether the region stays as it is; `borders` (image_id, low, high);
    `paths` (image_id, grp, stops), the colours along each group's gradient, an array of structs r, g, b.

    A thin region, at most `thin` of it off the edge, joins the group of its first neighbour by number whose gradient
    passes within `on_path` of its colour, or of which one colour mixes with another neighbour's, not of that group,
    to within `on_blend`. Slivers that touch the gradient only through others follow in the next round, after all of
    one round are decided; there are at most `rounds`, and none after one that moves nothing.
    """
    colour = F.struct(*[F.col(c).cast("double").alias(c) for c in "rgb"])
    now = save(regions.select("image_id", "region", colour.alias("c"), F.col("grp").cast("long").alias("grp"), (~F.col("fixed") & (F.col("inner") <= thin * F.col("area"))).alias("thin")), "regions")
    sides = borders.select("image_id", F.col("low").alias("region"), F.col("high").alias("beside")).unionByName(borders.select("image_id", F.col("high").alias("region"), F.col("low").alias("beside")))
    slim = now.where("thin and grp is null").select("image_id", "region", "c")
    sides = save(sides.distinct().join(slim.hint("merge"), ["image_id", "region"]), "sides-of-slivers")
    way = paths.select("image_id", F.col("grp").cast("long").alias("grp"), "stops")
    for _ in range(rounds):
        there = now.select("image_id", F.col("region").alias("beside"), F.col("grp").alias("b_grp"), F.col("c").alias("b_c"))
        open_ = now.where("thin and grp is null").select("image_id", "region")
        met = sides.join(open_.hint("merge"), ["image_id", "region"]).join(there.hint("merge"), ["image_id", "beside"])
        others = met.groupBy("image_id", "region").agg(F.collect_list(F.struct(F.col("b_grp").alias("grp"), F.col("b_c").alias("c"))).alias("others"))
        asked = met.where("b_grp is not null").withColumnRenamed("b_grp", "grp").join(others.hint("merge"), ["image_id", "region"]).join(way.hint("merge"), ["image_id", "grp"])
        me, stops = F.col("c"), F.col("stops")
        after = F.when(F.size(stops) > 1, F.slice(stops, 2, F.greatest(F.lit(1), F.size(stops) - 1))).otherwise(stops)
        before = F.when(F.size(stops) > 1, F.slice(stops, 1, F.greatest(F.lit(1), F.size(stops) - 1))).otherwise(stops)
        passes = F.exists(F.zip_with(before, after, lambda p, q: to_segment(me, p, q) < on_path), lambda x: x)
        foreign = F.filter("others", lambda o: ~F.coalesce(o["grp"] == F.col("grp"), F.lit(False)))
        mixes = F.exists(foreign, lambda o: F.exists(stops, lambda s: to_segment(me, s, o["c"]) < on_blend))
        moved = asked.where(passes | mixes).groupBy("image_id", "region").agg(F.min_by("grp", "beside").alias("_new"))
        moved = save(moved, "absorbed")
        if moved.isEmpty():
            break
        now = save(now.join(moved.hint("merge"), ["image_id", "region"], "left").select("image_id", "region", "c", F.coalesce("grp", "_new").alias("grp"), "thin"), "regions")
    return now.select("image_id", "region", "grp")
