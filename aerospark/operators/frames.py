"""Frames in order: sampling, metadata, neighbours, representative frames, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerospark.scale import previous_in_order

# Fixed defaults of an analysis run.
FRAME_STEP = 30
MAX_FRAMES = 300
# Fixed length of the fallback list.
FALLBACK_FRAMES = 20


def sample_frames(
    frames: DataFrame, step: int = FRAME_STEP, max_frames: int | None = None
) -> DataFrame:
    """Every ``step``-th frame; with ``max_frames`` at most so many of a video.

    The step is a plain filter.  The cap is a rank limit that Spark applies in
    each task before the shuffle, so a long video sends only its first frames.
    """
    if step < 1:
        raise ValueError("step must be >= 1")
    sampled = frames.filter(F.col("frame_index") % step == 0)
    if max_frames is None:
        return sampled
    order = Window.partitionBy("video_id").orderBy("frame_index")
    return (
        sampled.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= max_frames)
        .drop("_rank")
    )


def video_metadata(frames: DataFrame) -> DataFrame:
    """Frame rate, frame count and size per video, from one partial aggregate."""
    seconds = F.max("timestamp") - F.min("timestamp")
    return frames.groupBy("video_id").agg(
        F.when(seconds > 0, (F.max("frame_index") - F.min("frame_index")) / seconds)
        .otherwise(F.lit(0.0)).alias("fps"),
        F.count(F.lit(1)).alias("frame_count"),
        F.max("width").alias("width"),
        F.max("height").alias("height"),
    )


def frame_pairs(sampled: DataFrame, values: list[str]) -> DataFrame:
    """Each sampled frame with the one sampled before it; the first frame has none."""
    paired = previous_in_order(sampled, ["video_id"], "frame_index", values)
    return paired.filter(F.col("prev_frame_index").isNotNull())


def contiguous_frames(stored: DataFrame) -> DataFrame:
    """Frames stored without a gap from frame 0, per video.

    The end of the first run is the least frame whose successor is missing: an
    anti-join on (video, frame), which spreads one long video over all tasks.
    """
    present = stored.select("video_id", "frame_index").distinct()
    following = present.select("video_id", (F.col("frame_index") - 1).alias("frame_index"))
    ends = (
        present.filter(F.col("frame_index") >= 0)
        .join(following, ["video_id", "frame_index"], "left_anti")
        .groupBy("video_id")
        .agg(F.min("frame_index").alias("run_end"))
    )
    starts = present.groupBy("video_id").agg(
        F.max((F.col("frame_index") == 0).cast("int")).alias("has_first")
    )
    return starts.join(ends, "video_id", "left").select(
        "video_id",
        F.when(F.col("has_first") == 1, F.col("run_end") + 1)
        .otherwise(F.lit(0)).cast("long").alias("frame_count"),
    )


def representative_frames(counts: DataFrame) -> DataFrame:
    """First, middle and last stored frame; the first twenty numbers when none is stored."""
    n = F.col("frame_count")
    known = F.array(F.lit(0).cast("long"), F.floor(n / 2), n - 1)
    unknown = F.sequence(F.lit(0).cast("long"), F.lit(FALLBACK_FRAMES - 1).cast("long"))
    return counts.select(
        "video_id",
        F.posexplode(F.when(n > 0, known).otherwise(unknown)).alias("choice", "frame_index"),
    )
