"""Colour arithmetic as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Linear sRGB to cone response, and cube roots of that to OKLab (Ottosson 2020).
TO_LMS = [(0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)]
TO_LAB = [(0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660)]


def linear(c: Column) -> Column:
    """An 8-bit sRGB channel as linear light in 0..1."""
    s = c.cast("double") / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    light = [linear(c) for c in (r, g, b)]
    roots = [F.cbrt(_dot(row, light)) for row in TO_LMS]
    return tuple(_dot(row, roots) for row in TO_LAB)


def _dot(weights, columns) -> Column:
    return reduce(lambda x, y: x + y, [F.lit(w) * c for w, c in zip(weights, columns, strict=True)])


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.299) * r + F.lit(0.587) * g + F.lit(0.114) * b


#: How much of blue's and red's distance from luma the two chroma channels are.
CB, CR = 0.564, 0.713


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Luma, and how far blue and red are from it."""
    y = luma(r, g, b)
    return y, (b - y) * CB, (r - y) * CR


def from_ycbcr(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    r, b = y + cr / CR, y + cb / CB
    return r, (y - 0.299 * r - 0.114 * b) / 0.587, b


def half_up(c: Column) -> Column:
    """Rounds halves towards plus infinity, unlike `round`."""
    return F.floor(c + 0.5)


def quantised(r: Column, g: Column, b: Column, step: int = 8) -> Column:
    """One number for a colour whose channels are rounded to multiples of `step`."""
    q = [half_up(c / step).cast("long") for c in (r, g, b)]
    return q[0] * 65536 + q[1] * 256 + q[2]


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb, or #rgb where each pair of digits is equal."""
    r, g, b = (c.cast("long") for c in (r, g, b))
    full = F.lower(F.lpad(F.hex(r * 65536 + g * 256 + b), 6, "0"))
    short = F.concat(*[F.substring(full, i, 1) for i in (1, 3, 5)])
    return F.concat(F.lit("#"), F.when((r % 17 == 0) & (g % 17 == 0) & (b % 17 == 0), short).otherwise(full))
