"""Columns over polygons given as arrays of ``[x, y]`` corners."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edges(polygon: Column) -> Column:
    """The sides of a polygon, the last corner joined to the first."""
    following = F.concat(F.slice(polygon, F.lit(2), F.size(polygon)), F.slice(polygon, 1, 1))
    return F.zip_with(
        polygon, following,
        lambda a, b: F.struct(
            a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")
        ),
    )


def contains(sides: Column, x: Column, y: Column) -> Column:
    """True for a point strictly inside, by the even-odd rule; the border is outside."""

    def crossed(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
        return spans & F.coalesce(x < at, F.lit(False))

    def touches(e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        between = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(
            F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
        )
        return (turn == 0) & between

    inside = F.aggregate(sides, F.lit(False), lambda odd, e: odd != crossed(e))
    return inside & ~F.exists(sides, touches)
