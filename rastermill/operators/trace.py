"""A picture from its pixels to SVG text, with every step that the library has for it."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, presets
from ..sources.shared import save
from . import curves, details, gradients, images, labelling, markup, palette, regions
from .details import thin_places
from .pictures import Pictures


@dataclass(frozen=True)
class Options:
    """What a trace may be told; the names of older presets and modes become these by `functions.presets`.

    colours: of a palette at most; merge: OKLab distance below which colours are one; detail_pixels: of a colour that only
    details have, 0 for none such; thin_radius: in which thin features are weighed, 0 to leave them; min_area: of a region;
    most_regions, hard_regions: the budget; gradients: whether regions may be filled with ramps; stacked: whether
    shapes lie on each other or are cut out.
    """

    colours: int = 32
    merge: float = 0.045
    detail_pixels: int = 6
    thin_radius: int = 2
    min_area: int = 2
    most_regions: int = 6000
    hard_regions: int = 40000
    gradients: bool = False
    stacked: bool = True


def options_for(mode: str, preset: str | None = None) -> Options:
    """The options of a mode and an older preset's name, from the engine's defaults on."""
    o = presets.DEFAULTS | presets.MODES.get(mode, {}) | presets.PRESETS.get(preset or "", {})
    thin = o["thinFeatures"] == "true"
    return Options(int(o["maxColors"]), float(o["mergeDistance"]), 6 if thin else 0, 2 if thin else 0, max(2, int(o["speckleArea"])), int(o["maxRegions"]), int(o["maxRegionsHard"]), o["gradients"] == "true", o["mode"] == "stacked")


def colours_of(pixels: DataFrame, options: Options) -> DataFrame:
    """(image_id, label, weight, r, g, b, l, m, n): clustered colours without blends of heavier ones, and those of details."""
    found = save(palette.extract(images.palette_bins(images.palette_pixels(pixels)), most=options.colours, reach=options.merge), "clusters")
    blends = images.blend_colours(found)
    kept = save(found.join(blends.hint("merge"), ["image_id", "label"], "left_anti"), "palette")
    if not options.detail_pixels:
        return kept.select("image_id", F.col("label").cast("long").alias("label"), F.col("weight").cast("long").alias("weight"), *[F.col(c).cast("int").alias(c) for c in "rgb"], *"lmn")
    return save(details.with_details(pixels, kept, options.merge, options.detail_pixels, options.colours), "palette-with-details")


def labels_of(pixels: DataFrame | Pictures, tints: DataFrame, options: Options) -> DataFrame:
    """(image_id, width, labels), an image a row: pixels on edges on their side, thin features whole, small regions merged; -1: see-through."""
    pictures = replace(pixels, palette=tints) if isinstance(pixels, Pictures) else Pictures(pixels, tints)
    thin_radius = options.thin_radius

    def run(pile):
        found = thin_places(pile, thin_radius)
        for k, label in enumerate(found):
            if not np.isnan(pile.lab[k, ..., 0]).any():
                names = np.where(label < 0, -1, pile.names[k, label]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(pile.ids[k : k + 1]), pa.array([label.shape[1]], pa.int32()), pa.array([names], pa.list_(pa.int64()))], ["image_id", "width", "labels"])

    labels = pictures.map(run, "image_id long, width int, labels array<long>")
    if options.min_area > 1:
        labels = labelling.merged_rows(labels, tints, options.min_area, options.most_regions, options.hard_regions)
    return save(labels, "labels")


def ramps_of(pixels: DataFrame, parts: DataFrame, bins: int = 24) -> DataFrame:
    """(image_id, region, place, stops, shape, number): regions that a linear gradient draws better than one colour, numbered
    from 0 in an image by their first pixel. `parts` are (image_id, x, y, region) of what may be seen."""
    p = save(gradients.edge_distance(parts.join(pixels.select("image_id", "x", "y", *"rgb").hint("merge"), ["image_id", "x", "y"])), "distances")
    linear = save(gradients.linear_ramps(p).where(gradients.has_ramp()), "ramps")
    placed = gradients.along_axis(p, linear)
    stops = save(gradients.linear_stops(gradients.profile(placed, bins), linear, bins), "stops")
    better = gradients.fill_errors(placed, stops).where("kept").select("image_id", "region")
    fills = gradients.linear_ends(p, linear).join(stops.hint("merge"), ["image_id", "region"]).join(better.hint("merge"), ["image_id", "region"])
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("region")) - 1
    return fills.select("image_id", "region", "place", "stops", F.lit("linear").alias("shape"), number.alias("number"))


def trace(pixels: DataFrame | Pictures, options: Options = Options(), tints: DataFrame | None = None, fit: curves.Fit = curves.Fit()) -> DataFrame:
    """(image_id, n_paths, svg) of pixels (image_id, x, y, r, g, b, a), a path for each region in its palette colour or gradient.

    `tints` is a palette to use instead of the one found. Labels are written once, an image a row; images are independent,
    and regions and chains of one image spread over tasks too.
    """
    if tints is None or options.gradients:
        pixels = save(pixels.pixels if isinstance(pixels, Pictures) else pixels, "pixels")
    tints = colours_of(pixels, options) if tints is None else save(tints, "palette")
    labels = labels_of(pixels, tints, options)
    fitted = curves.fitted_chains(curves.chains_of(labels), fit, points=False)
    paint = tints.select("image_id", F.col("label").cast("long").alias("label"), color.hex_colour(F.col("r"), F.col("g"), F.col("b")).alias("colour"))
    paints = regions.named(labels).join(paint.hint("merge"), ["image_id", "label"], "left").select("image_id", "region", F.when(F.col("label") >= 0, F.col("colour")).alias("colour"))
    sizes = labels.select("image_id", "width", (F.size("labels") / F.col("width")).cast("int").alias("height"))
    if not options.gradients:
        return curves.draw(curves.region_loops(fitted), paints, sizes, options.stacked)
    parts = save(regions.components_of(labels).select("image_id", "x", "y", "label", F.col("root").alias("region")), "parts")
    fills = save(ramps_of(pixels, parts.where("label >= 0").select("image_id", "x", "y", "region")), "fills")
    url = F.concat(F.lit("url(#g"), F.col("number").cast("string"), F.lit(")"))
    paints = paints.join(fills.select("image_id", "region", url.alias("_fill")).hint("merge"), ["image_id", "region"], "left").select("image_id", "region", F.coalesce("_fill", "colour").alias("colour"))
    drawn = curves.draw(curves.region_loops(fitted), paints, sizes, options.stacked).join(markup.gradient_definitions(fills).hint("merge"), "image_id", "left")
    head = F.concat(F.substring_index("svg", ">", 1), F.lit(">"))
    body = F.substr(F.col("svg"), F.char_length(head) + 1)
    return drawn.select("image_id", "n_paths", F.when(F.col("defs").isNull(), F.col("svg")).otherwise(F.concat(head, "defs", body)).alias("svg"))
