"""Motion summaries over tracks and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospark.scale import broadcast_if_small, durable, fits, previous_in_order

# Rows of a key that one task puts in order.
KEY_ROWS = 10_000


def motion_summary(per_frame: DataFrame, keys: list[str]) -> DataFrame:
    """Frames processed, mean and largest motion ratio; 0.0 where there is none."""
    return per_frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_processed"),
        F.coalesce(F.avg("motion_ratio"), F.lit(0.0)).alias("mean_motion_ratio"),
        F.coalesce(F.max("motion_ratio"), F.lit(0.0)).alias("max_motion_ratio"),
    )


def exact_median(df: DataFrame, keys: list[str], value: str, width: float = 1.0) -> DataFrame:
    """``median`` per key without gathering a key's values.

    Values are counted, then counted per bucket of ``width``; only the buckets
    that hold the middle ranks are put in order.
    """
    counts = df.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("_bucket", F.floor(F.col("v") / width))
    running = Window.partitionBy(*keys).orderBy("_bucket")
    buckets = (
        counts.groupBy(*keys, "_bucket").agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    )
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    first = F.col("upto") - F.col("n")

    def holds(rank: Column) -> Column:
        return (first <= rank) & (rank < F.col("upto"))

    middle = buckets.filter(holds(low) | holds(high)).select(
        *keys, "_bucket", first.alias("before"), low.alias("low"), high.alias("high")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("v")
    placed = counts.join(middle, [*keys, "_bucket"]).withColumn(
        "upto", F.col("before") + F.sum("n").over(inside)
    )
    start = F.col("upto") - F.col("n")

    def at(rank: str) -> Column:
        return F.max(F.when((start <= F.col(rank)) & (F.col(rank) < F.col("upto")), F.col("v")))

    return placed.groupBy(*keys).agg(((at("low") + at("high")) / 2).alias("median"))


def flow_summary(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Magnitude and direction of motion from ``vx, vy`` rows per key.

    The dominant direction is the mean angle weighted by magnitude, in degrees
    from 0 to 360, averaged linearly; it is 0 when nothing moves.  A key of at most
    ``KEY_ROWS`` rows is put in order after a single shuffle; larger ones keep to ``exact_median``.
    """
    vx, vy = F.col("vx").cast("double"), F.col("vy").cast("double")
    angle = F.degrees(F.atan2(vy, vx))
    moved = vectors.select(
        *keys, F.sqrt(vx * vx + vy * vy).alias("m"),
        F.when(angle < 0, angle + 360.0).otherwise(angle).alias("a"),
    )
    many = durable(
        moved.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > KEY_ROWS).select(*keys)
    )
    if fits(many, 0):
        return _ordered_flow(moved, keys)
    many = broadcast_if_small(many)
    crowded = moved.join(many, keys, "left_semi")
    median = exact_median(crowded.filter("m IS NOT NULL"), keys, "m").withColumnRenamed("median", "median_magnitude")
    summary = crowded.groupBy(*keys).agg(*_flow_numbers()).join(median, keys, "left")
    return _ordered_flow(moved.join(many, keys, "left_anti"), keys).unionByName(summary)


def _flow_numbers() -> list[Column]:
    whole = F.sum("m")
    return [
        F.avg("m").alias("mean_magnitude"), F.max("m").alias("max_magnitude"),
        F.when(whole > 0, F.sum(F.col("a") * F.col("m")) / whole).otherwise(0.0).alias("dominant_direction_deg"),
    ]


def _ordered_flow(moved: DataFrame, keys: list[str]) -> DataFrame:
    """``flow_summary`` of ``m, a`` rows whose keys are each put in order by one task."""
    inside = Window.partitionBy(*keys)
    n = F.col("_n")
    placed = moved.withColumn("_place", F.row_number().over(inside.orderBy(F.col("m").asc_nulls_last()))).withColumn(
        "_n", F.count("m").over(inside)
    )
    low, high = (F.max(F.when(F.col("_place") == at, F.col("m"))) for at in (F.floor((n + 1) / 2), F.floor(n / 2) + 1))
    return placed.groupBy(*keys).agg(*_flow_numbers(), ((low + high) / 2).alias("median_magnitude"))


def track_displacement(tracks: DataFrame, detections: DataFrame) -> DataFrame:
    """``video_id, frame_index, track_id, vx, vy``: how far each object moved a frame since it was last seen.

    ``tracks`` is what the tracker gives, at most one box an object and frame.  Motion over
    frames in which an object was out of sight is spread evenly over them and counts in the
    frame of its return.  The first sight of an object, or one without a centre, gives no row.
    A long track is not sorted by one task.
    """
    box = ["video_id", "frame_index", "det_seq"]
    centres = tracks.join(detections.select(*box, F.col("cx").cast("double"), F.col("cy").cast("double")), box)
    seen = centres.filter(F.col("cx").isNotNull() & F.col("cy").isNotNull()).drop("det_seq")
    moved = previous_in_order(seen, ["video_id", "track_id"], "frame_index", ["cx", "cy"])
    frames = F.col("frame_index") - F.col("prev_frame_index")
    return moved.filter("prev_frame_index IS NOT NULL").select(
        "video_id", "frame_index", "track_id",
        *[((F.col(c) - F.col(f"prev_{c}")) / frames).alias(v) for c, v in (("cx", "vx"), ("cy", "vy"))],
    )


def circular_direction(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """The direction of the summed motion, an alternative without the jump at 0 degrees."""
    angle = F.degrees(F.atan2(F.sum("vy"), F.sum("vx")))
    return vectors.groupBy(*keys).agg(
        F.when(angle < 0, angle + 360.0).otherwise(angle).alias("direction_deg")
    )
