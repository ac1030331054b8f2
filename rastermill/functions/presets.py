"""Which kind of trace an image calls for, what it will take, and with which options, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds of the trace presets, in the order of the ladder.
SKETCH_NOISE, QR_COLOURS, QR_EDGES, QR_ASPECT = 0.15, 4, 0.065, (0.85, 1.15)
BLUEPRINT_COLOURS, BLUEPRINT_ASPECT, STICKER_COLOURS, ICON_COLOURS, ICON_COMPLEXITY = 6, 1.2, 16, 6, 0.2
#: Pixels below which quality is low, complexities above which it falls, milliseconds of a trace and pixels for one more.
LOW_PIXELS, HIGH_COMPLEXITY, VERY_HIGH_COMPLEXITY, BASE_MS, PIXELS_A_MS = 64 * 64, 0.75, 0.85, 150, 4000
#: Engine options by mode, and what older preset names change in them.
MODES = {
    "quick": {"maxWorkingPixels": "4000000", "photoMaxWorkingPixels": "1200000", "maxUpscaledPixels": "1500000", "maxColors": "32"},
    "professional": {"maxWorkingPixels": "4000000", "photoMaxWorkingPixels": "1200000", "maxUpscaledPixels": "2000000", "maxColors": "64", "mergeDistance": "0.045", "gradients": "true"},
}
#: What the engine does unless it is told otherwise.
DEFAULTS = {
    "maxColors": "48",
    "mergeDistance": "0.05",
    "speckleArea": "0",
    "alphaMax": "1",
    "optTolerance": "0.2",
    "upscale": "0",
    "maxWorkingPixels": "2000000",
    "photoMaxWorkingPixels": "2000000",
    "upscaleFilter": "ridge",
    "upscaleBlur": "0.45",
    "ridgeThreshold": "32",
    "maxUpscaledPixels": "2000000",
    "denoise": "auto",
    "mode": "stacked",
    "underlay": "1",
    "paletteSeparation": "3",
    "precision": "-1",
    "thinFeatures": "true",
    "thinPeakScale": "1",
    "alphaThreshold": "128",
    "maxRegions": "6000",
    "maxRegionsHard": "40000",
    "snapCorners": "true",
    "gradients": "false",
    "sourceFormat": "unknown",
}
PRESETS = {
    "qrCode": {"maxColors": "2", "snapCorners": "true"},
    "signature": {"maxColors": "8"},
    "blueprint": {"maxColors": "8"},
    "sketch": {"denoise": "on", "speckleArea": "12"},
    "photo": {"maxColors": "64", "denoise": "on"},
    "illustration": {"maxColors": "48"},
}


def image_type(kind: Column) -> Column:
    """photo, illustration, or logo for every flat mark."""
    return F.when(kind.isin("photo", "illustration"), kind).otherwise("logo")


def trace_preset(kind: Column, gray: Column, transparent: Column, colours: Column, complexity: Column, edges: Column, noise: Column, aspect: Column) -> Column:
    """The first of nine presets that fits; `kind` is an `image_type`."""
    square = (aspect >= QR_ASPECT[0]) & (aspect <= QR_ASPECT[1])
    return (
        F.when(kind == "photo", "photo")
        .when(gray & (noise >= SKETCH_NOISE), "sketch")
        .when(kind == "illustration", "illustration")
        .when(gray & transparent, "signature")
        .when(gray & (colours <= QR_COLOURS) & (edges >= QR_EDGES) & square, "qrCode")
        .when((colours <= BLUEPRINT_COLOURS) & ((aspect >= BLUEPRINT_ASPECT) | (aspect <= 1 / BLUEPRINT_ASPECT)), "blueprint")
        .when(transparent & (colours <= STICKER_COLOURS), "sticker")
        .when((colours <= ICON_COLOURS) & (complexity < ICON_COMPLEXITY), "icon")
        .otherwise("logo")
    )


def estimated_quality(pixels: Column, complexity: Column, kind: Column) -> Column:
    photo = F.when(complexity >= VERY_HIGH_COMPLEXITY, "low").otherwise("medium")
    return F.when(pixels < LOW_PIXELS, "low").when(kind == "photo", photo).when(complexity >= HIGH_COMPLEXITY, "medium").otherwise("high")


def estimated_ms(pixels: Column) -> Column:
    """Milliseconds of a trace by the built-in engine; halves go up."""
    return F.floor(F.lit(BASE_MS) + pixels / PIXELS_A_MS + 0.5).cast("long")


def options_of(name: Column, sets: dict[str, dict[str, str]]) -> Column:
    """The map of options that belongs to a name; empty for other names and null."""
    as_map = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return reduce(lambda out, kv: F.when(name == kv[0], as_map(kv[1])).otherwise(out), sets.items(), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def merged(*maps: Column) -> Column:
    """One map of all keys; of equal keys the value of the last map that has it."""
    return reduce(lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x)), maps)
