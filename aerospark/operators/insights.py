"""Segments of a video from the nested JSON a video indexer writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed shape of the part of the document that is read.
INSIGHTS = (
    "videos ARRAY<STRUCT<insights: STRUCT<shots: ARRAY<STRUCT<keyFrames: ARRAY<STRUCT<"
    "instances: ARRAY<STRUCT<start: STRING, end: STRING>>>>>>>>>"
)


def insight_segments(documents: DataFrame, column: str = "insights") -> DataFrame:
    """One row per key frame: its first instance, with the video, shot and frame positions."""
    keep = [name for name in documents.columns if name != column]
    videos = documents.select(
        *keep, F.posexplode(F.from_json(column, INSIGHTS)["videos"]).alias("video", "_v")
    )
    shots = videos.select(*keep, "video", F.posexplode("_v.insights.shots").alias("shot", "_s"))
    frames = shots.select(*keep, "video", "shot", F.posexplode("_s.keyFrames").alias("key_frame", "_k"))
    first = F.get("_k.instances", F.lit(0))
    return frames.select(
        *keep, "video", "shot", "key_frame", first["start"].alias("start"), first["end"].alias("end")
    )


def first_shot(segments: DataFrame) -> DataFrame:
    """The segments of the first shot of the first video of each document."""
    return segments.filter((F.col("video") == 0) & (F.col("shot") == 0))


def video_range(video: str = "video_id") -> Column:
    """A segment as the range a rendering project takes."""
    return F.struct(
        F.col(video).cast("string").alias("videoId"), F.struct("start", "end").alias("range")
    )
