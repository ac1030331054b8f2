"""What a trace of an image will be like, from its size and a few statistics, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels that upscaling aims at, share of flat pixels below which an image counts as a photo.
TARGET_PIXELS, PHOTO_FLAT = 2_000_000, 0.7
#: Why a job failed, and the sentence that its owner is told.
PUBLIC_ERRORS = [
    ("credits", "Not enough credits for this conversion."),
    ("too_large", "The image is too large to convert."),
    ("range", "The image is too complex to convert. Try a smaller or simpler image."),
    ("unsupported", "The image could not be read. It may be damaged or in an unsupported format."),
    ("validation", "The image could not be read. It may be damaged or in an unsupported format."),
]
FAILED = "The conversion failed. Any credits charged were refunded."


def pixel_cap(width: Column, height: Column, flat: Column, art: int = 4_000_000, photo: int = 1_200_000) -> Column:
    """Pixels to work on: fewer for photos; images that are small anyway are not told apart."""
    return F.when(width * height <= min(art, photo), art).when(flat < PHOTO_FLAT, photo).otherwise(art)


def shrink_factor(width: Column, height: Column, cap: Column) -> Column:
    """The smallest whole factor by which the image fits the cap. The root is at most two short of it."""
    root = F.greatest(F.lit(2), F.ceil(F.sqrt(width * height / cap)))
    fits = lambda k: F.ceil(width / k) * F.ceil(height / k) <= cap
    return F.when(width * height <= cap, 1).otherwise(F.element_at(F.filter(F.sequence(root, root + 8), fits), 1)).cast("int")


def grow_factor(width: Column, height: Column, cap: Column) -> Column:
    """The whole factor, 1 to 4, that comes closest to the target without passing the cap."""
    n = width * height
    want = F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.sqrt(F.lit(TARGET_PIXELS) / n))))
    return F.coalesce(*[F.when((want >= k) & (n * k * k <= cap), k) for k in (4, 3, 2)], F.lit(1)).cast("int")


def decimals(width: Column, height: Column) -> Column:
    """Decimal places of coordinates."""
    return F.greatest(F.lit(0), F.ceil(F.log10(F.lit(5000.0) / F.greatest(width, height)))).cast("int")


def speckle_area(width: Column, height: Column, lossy: Column) -> Column:
    """Regions below this many pixels are noise."""
    return F.greatest(F.lit(2.0), F.least(F.lit(40.0), width * height * 5e-6)) * F.when(lossy, 3).otherwise(1)


def denoise_range(sigma: Column, lossy: Column) -> Column:
    """Width in colour of the bilateral filter, or null where the image needs none."""
    return F.when(lossy | (sigma > 1.2), F.greatest(F.when(lossy, 22.0).otherwise(14.0), 3.5 * sigma))


def variant_label(size: Column, jpeg: Column, quality: Column, blur: Column) -> Column:
    """Name of a benchmark variant, such as 512jpgq40blur1.5; `original` for size 0."""
    text = F.concat(size.cast("string"), F.when(jpeg, "jpg").otherwise(""), F.coalesce(F.concat(F.lit("q"), quality.cast("string")), F.lit("")), F.when(blur > 0, F.concat(F.lit("blur"), short_number(blur, 1))).otherwise(""))
    return F.when(size == 0, "original").otherwise(text)


def short_number(v: Column, places: int) -> Column:
    """The shortest decimal text of a rounded number: no zeros at either end, no sign on zero."""
    text = F.regexp_replace(F.format_string(f"%.{places}f", v), r"\.?0+$", "") if places else F.format_string("%.0f", v)
    return F.when(text.isin("-0", "", "-"), "0").otherwise(text)


def path_number(v: Column, places: int) -> Column:
    """`short_number` as path data has it: nothing before the point."""
    return F.regexp_replace(short_number(v, places), r"^(-?)0\.", "$1.")


def public_error(kind: Column, message: Column) -> Column:
    """The sentence about a failed job that its owner may read; others' messages stay inside."""
    out = F.when(message.rlike("^Failed to decode "), dict(PUBLIC_ERRORS)["validation"]).otherwise(FAILED)
    for name, text in reversed(PUBLIC_ERRORS):
        out = F.when(kind == name, text).otherwise(out)
    return out
