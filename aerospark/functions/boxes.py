"""Columns over bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: coordinates up to this size are fractions of the frame, not pixels.
NORMALISED_MAX = 1.5


def half_even(value: Column) -> Column:
    """Nearest integer, ties to the even one."""
    return F.bround(value, 0).cast("int")


def corners_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Corner box to ``x, y, w, h``: each rounded on its own, sizes not below zero."""
    zero = F.lit(0.0)
    return F.struct(
        half_even(x1).alias("x"), half_even(y1).alias("y"),
        half_even(F.greatest(zero, x2 - x1)).alias("w"),
        half_even(F.greatest(zero, y2 - y1)).alias("h"),
    )


def xywh_to_corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    x, y = x.cast("double"), y.cast("double")
    return F.struct(
        half_even(x).alias("x1"), half_even(y).alias("y1"),
        half_even(x + w).alias("x2"), half_even(y + h).alias("y2"),
    )


def scale_to_frame(
    x1: Column, y1: Column, x2: Column, y2: Column,
    off_x: Column, off_y: Column, width: Column, height: Column,
    input_size: tuple[int, int] | None, single: bool = True,
) -> Column:
    """Model-space corners to a frame-space ``x, y, w, h``.

    ``off_*``, ``width`` and ``height`` are the region the model saw.  Corners
    within 1.5 are fractions of that region; others are pixels of the model
    input.  Without an input size the corners are frame pixels already.
    ``single`` reads the corners at single precision, as the array path does.
    """
    raw = [c.cast("float").cast("double") if single else c.cast("double") for c in (x1, y1, x2, y2)]
    if input_size is not None:
        in_w, in_h = input_size
        fraction = F.greatest(*[F.abs(c) for c in raw]) <= NORMALISED_MAX
        scale_x = F.when(fraction, width.cast("double")).otherwise(width / F.lit(float(in_w)))
        scale_y = F.when(fraction, height.cast("double")).otherwise(height / F.lit(float(in_h)))
        raw = [
            off_x + raw[0] * scale_x, off_y + raw[1] * scale_y,
            off_x + raw[2] * scale_x, off_y + raw[3] * scale_y,
        ]
    left, top, right, bottom = [F.greatest(F.lit(0.0), c) for c in raw]
    return corners_to_xywh(
        F.least(left, right), F.least(top, bottom), F.greatest(left, right), F.greatest(top, bottom)
    )


def detection_from_box(box: Column, label: Column, score: Column) -> Column:
    """A full detection: centre, area, and defaults for a missing label or score."""
    x, y, w, h = box["x"], box["y"], box["w"], box["h"]
    return F.struct(
        F.coalesce(label, F.lit("object")).alias("label"),
        F.coalesce(score, F.lit(1.0)).alias("score"),
        x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"),
        (x + w / F.lit(2.0)).alias("cx"), (y + h / F.lit(2.0)).alias("cy"),
        (w.cast("double") * h.cast("double")).alias("area"),
    )


def iou(a: Column, b: Column) -> Column:
    """Overlap of two boxes with fields ``x, y, w, h``; 0 when there is no area."""
    width = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    height = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    shared = width.cast("long") * height
    union = a["w"].cast("long") * a["h"] + b["w"].cast("long") * b["h"] - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def project(matrix: Column, x: Column, y: Column) -> Column:
    """A point through a homography of nine row-major values."""
    m = [F.get(matrix, F.lit(i)) for i in range(9)]
    depth = m[6] * x + m[7] * y + m[8]
    # A point on the horizon maps to the origin.
    inverse = F.when(depth != 0, F.lit(1.0) / depth).otherwise(F.lit(0.0))
    return F.struct(
        ((m[0] * x + m[1] * y + m[2]) * inverse).alias("x"),
        ((m[3] * x + m[4] * y + m[5]) * inverse).alias("y"),
    )
