"""Columns over 8-bit colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed luma weights of blue, green and red, in 15-bit fixed point.
LUMA = (3735, 19235, 9798)


def gray(b: Column, g: Column, r: Column) -> Column:
    """0.114 blue + 0.587 green + 0.299 red, rounded to an integer."""
    total = b * LUMA[0] + g * LUMA[1] + r * LUMA[2] + (1 << 14)
    return F.shiftright(total, 15)


def hsv(b: Column, g: Column, r: Column) -> Column:
    """Hue 0..179, saturation and value 0..255, rounded as in 12-bit fixed point."""
    high, low = F.greatest(b, g, r), F.least(b, g, r)
    span = high - low

    def scaled(amount: Column, full: int, by: Column) -> Column:
        factor = F.bround(F.lit(float(full << 12)) / by, 0).cast("long")
        return F.shiftright(amount.cast("long") * factor + (1 << 11), 12).cast("int")

    saturation = F.when(high > 0, scaled(span, 255, high)).otherwise(0)
    turn = (
        F.when(high == r, g - b)
        .when(high == g, b - r + 2 * span)
        .otherwise(r - g + 4 * span)
    )
    hue = F.when(span > 0, scaled(turn, 30, span)).otherwise(0)
    return F.struct(
        F.when(hue < 0, hue + 180).otherwise(hue).alias("h"), saturation.alias("s"), high.alias("v")
    )


def in_range(colour: Column, lower: tuple[int, int, int], upper: tuple[int, int, int]) -> Column:
    parts = [colour[n].between(lo, up) for n, lo, up in zip("hsv", lower, upper)]
    return parts[0] & parts[1] & parts[2]
