"""Detections in polygonal zones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospark.functions import polygons

CELL = 64.0


def _cells(low: str, high: str, cell: float):
    first, last = F.floor(F.col(low) / cell), F.floor(F.col(high) / cell)
    return F.sequence(first, last)


def detections_in_zones(
    detections: DataFrame, zones: DataFrame, scope: list[str] | None = None, cell: float = CELL
) -> DataFrame:
    """Each detection with each zone its centre lies strictly inside.

    Zones (``zone, polygon``) are cut into grid cells, and a centre has one cell,
    so the join is on the cell.  A small zone table is broadcast by Spark; a large
    one shuffles on the cell, where a crowded cell is split by the skew join.
    ``scope`` names columns, such as the video, that zones are tied to.
    """
    keys = [*(scope or []), "_cx", "_cy"]
    sides = zones.filter(F.size("polygon") >= 3).select(
        *(scope or []), "zone", polygons.edges(F.col("polygon")).alias("_sides"),
        *[f(F.transform("polygon", lambda p: p[i])).alias(n) for i, f, n in (
            (0, F.array_min, "_x1"), (1, F.array_min, "_y1"),
            (0, F.array_max, "_x2"), (1, F.array_max, "_y2"))],
    )
    spread = sides.withColumn("_cx", F.explode(_cells("_x1", "_x2", cell))).withColumn(
        "_cy", F.explode(_cells("_y1", "_y2", cell))
    )
    placed = detections.withColumn("_cx", F.floor(F.col("cx") / cell)).withColumn(
        "_cy", F.floor(F.col("cy") / cell)
    )
    near = F.col("cx").between(F.col("_x1"), F.col("_x2")) & F.col("cy").between(
        F.col("_y1"), F.col("_y2")
    )
    inside = polygons.contains(F.col("_sides"), F.col("cx"), F.col("cy"))
    return placed.join(spread, keys).filter(near).filter(inside).select(*detections.columns, "zone")


def zone_counts(
    frames: DataFrame, detections: DataFrame, zones: DataFrame,
    keys: list[str] | None = None,
) -> DataFrame:
    """Per frame: the count of every zone, empty ones with 0, and the total.

    Zones with a ``video_id`` belong to that video's frames alone; others to all frames.
    Hits are counted per frame and zone before the shuffle.  The zone names of a video,
    or of all, come as one array.
    """
    keys = keys or ["video_id", "frame_index"]
    scope = ["video_id"] if "video_id" in zones.columns else []
    slim = detections.select(*keys, "cx", "cy")
    hits = (
        detections_in_zones(slim, zones, scope)
        .groupBy(*keys, "zone")
        .agg(F.count(F.lit(1)).alias("detections"))
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_list(F.struct("zone", "detections"))).alias("_hits"))
    )
    listed = F.array_sort(F.collect_set("zone")).alias("_names")
    filled = frames.join(hits, keys, "left")
    if scope:
        filled = filled.join(zones.groupBy(*scope).agg(listed), scope, "left")
    else:
        filled = filled.withColumn("_names", zones.agg(listed).scalar())
    counted = filled.withColumn(
        "zones",
        F.transform(
            F.coalesce("_names", F.array().cast("array<string>")),
            lambda name: F.struct(
                name.alias("zone"),
                F.coalesce(F.try_element_at(F.col("_hits"), name), F.lit(0).cast("long")).alias("detections"),
            ),
        ),
    )
    total = F.aggregate("zones", F.lit(0).cast("long"), lambda sum_, z: sum_ + z["detections"])
    return counted.withColumn("total", total).drop("_hits", "_names")


def unique_objects(tracked: DataFrame, by: list[str]) -> DataFrame:
    """Distinct tracks per video, or per video and zone."""
    return tracked.groupBy(*by).agg(F.count_distinct("track_id").alias("objects"))
