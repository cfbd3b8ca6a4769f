"""Commentary events from routine results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.functions.events import (
    SCHEMA_VERSION, correlation_key, echo_completion, rollup_key, segment_end, segment_start,
    stable_id,
)

FRAME = ["video_id", "frame_index"]
# The wording of all phrases below is part of the event format.
# Fixed names of the metrics every routine's commentary shares.
DERIVED = ("count", "total_area", "mean_area", "mean_score", "max_score")
DETECTION_ROUTINES = ("color_detection", "threshold_detection")


def label_counts(detections: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    return detections.groupBy(*keys, F.coalesce("label", F.lit("object")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


def describe_frames(frames: DataFrame, detections: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Derived metrics and label counts for every frame, also for those without detections.

    Detections are reduced to one row per frame and label first; the lists built
    after that hold one entry per distinct label.
    """
    area = F.coalesce(F.col("area"), F.lit(0.0))
    score = F.coalesce(F.col("score"), F.lit(0.0))
    per_label = detections.groupBy(
        *keys, F.coalesce("label", F.lit("object")).alias("label")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"),
        F.sum(score).alias("score"), F.max(score).alias("best"),
    )
    per_frame = per_label.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("area").alias("area"), F.sum("score").alias("score"),
        F.max("best").alias("best"),
        F.array_sort(F.collect_list(F.struct("label", "n"))).alias("labels"),
    )
    n = F.col("n")

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    return frames.join(per_frame, keys, "left").select(
        *[frames[name] for name in frames.columns],
        or_zero(n.cast("double")).alias("count"),
        or_zero(F.col("area")).alias("total_area"),
        or_zero(F.col("area") / n).alias("mean_area"),
        or_zero(F.col("score") / n).alias("mean_score"),
        or_zero(F.col("best")).alias("max_score"),
        F.coalesce("labels", F.array()).alias("labels"),
    )


def labels_phrase(labels: Column, empty: str = "no objects") -> Column:
    """``2 car, 1 person``, by label."""
    parts = F.transform(labels, lambda e: F.concat(e["n"].cast("string"), F.lit(" "), e["label"]))
    return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit(empty))


def zone_phrase(zones: Column) -> Column:
    """``name=count`` pairs by zone name; ``zones`` is an array of (zone, detections)."""
    parts = F.transform(
        F.array_sort(zones), lambda e: F.concat(e["zone"], F.lit("="), e["detections"].cast("string"))
    )
    text = F.concat(F.lit("Zone occupancy — "), F.array_join(parts, ", "), F.lit("."))
    empty = F.lit("Zone counting produced no occupied zones.")
    return F.when(F.size(zones) > 0, text).otherwise(empty)


def parking_phrase(occupied: Column, total: Column) -> Column:
    return F.concat(
        F.lit("Parking occupancy: "), occupied.cast("string"), F.lit(" of "),
        total.cast("string"), F.lit(" spots occupied."),
    )


def commentary_text(columns: list[str]) -> Column:
    """The template of each routine; zone and parking templates need their own columns."""
    routine, frame = F.col("routine"), F.col("frame_index")
    where = F.when(
        frame.isNotNull(), F.concat(F.lit("frame "), frame.cast("string"))
    ).otherwise(F.lit("the frame"))
    text = F.when(
        F.col("error").isNotNull(),
        F.concat(F.lit("Routine '"), routine, F.lit("' failed: "), F.col("error")),
    ).when(
        routine.isin(*DETECTION_ROUTINES),
        F.concat(routine, F.lit(" detected "), labels_phrase(F.col("labels")), F.lit(" in "), where, F.lit(".")),
    )
    if "zones" in columns:
        text = text.when(routine == "zone_counting", zone_phrase(F.col("zones")))
    if "total_spots" in columns:
        text = text.when(
            routine == "parking_occupancy", parking_phrase(F.col("occupied"), F.col("total_spots"))
        )
    return text.otherwise(
        F.concat(
            F.lit("Routine '"), routine, F.lit("' produced "),
            F.col("count").cast("long").cast("string"), F.lit(" detection(s)."),
        )
    )


def fold_summary(summary: Column) -> Column:
    """Derived metrics plus the summary numbers whose names they do not use already."""
    derived = F.create_map(*[part for name in DERIVED for part in (F.lit(name), F.col(name))])
    extra = F.map_filter(
        F.coalesce(summary, F.create_map().cast("map<string,double>")),
        lambda name, value: ~name.isin(*DERIVED) & value.isNotNull(),
    )
    return F.map_concat(derived, extra)


def prompt_text() -> Column:
    """The lines a text model is asked to describe."""
    summary = F.col("summary")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Routine: "), F.col("routine")),
        F.concat(F.lit("Frame: "), F.coalesce(F.col("frame_index").cast("string"), F.lit("n/a"))),
        F.concat(F.lit("Detections by label: "), labels_phrase(F.col("labels"), "none")),
        F.concat(F.lit("Total detections: "), F.col("count").cast("long").cast("string")),
        F.when(F.size(summary) > 0, F.concat(F.lit("Summary: "), F.to_json(summary))),
    )


def _event(
    commentary: Column, attributes: Column, metrics: Column, metadata: Column, source: Column,
    key: Column, level: str, start: Column, end: Column, frame: Column,
) -> list[Column]:
    """The columns of a wide event, in schema order."""
    identity = (F.col("trace_id"), source, F.col("video_id"), frame, F.lit(level))
    return [
        stable_id(32, F.lit("event"), *identity).alias("event_id"),
        F.col("trace_id"),
        stable_id(16, F.lit("span"), *identity).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        key.alias("correlation_key"),
        F.localtimestamp().alias("timestamp"),
        source.alias("source"),
        F.col("video_id"),
        F.col("analysis_id"),
        frame.alias("frame_index"),
        start.alias("segment_start"),
        end.alias("segment_end"),
        commentary.alias("commentary"),
        attributes.alias("attributes"),
        metrics.alias("metrics"),
        metadata.alias("metadata"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    ]


def _json(**fields: Column) -> Column:
    return F.parse_json(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))


def frame_events(described: DataFrame, complete=None, generated_by: str = "echo") -> DataFrame:
    """One event per routine and frame.

    ``described`` comes from :func:`describe_frames` on results with ``routine,
    error, summary`` and the run's ``trace_id, analysis_id, fps, frame_step``.
    With ``complete`` a text model's answer replaces the template; where it is
    null, or where the routine failed, the template stays.
    """
    frame, fps, step = F.col("frame_index"), F.col("fps"), F.col("frame_step")
    failed = F.col("error").isNotNull()
    routine = F.col("routine")
    text = commentary_text(described.columns)
    answer = F.lit(None).cast("string") if complete is None else complete(F.when(~failed, prompt_text()))
    modelled = answer.isNotNull() & ~failed
    names = F.col("labels.label")
    model_attributes = _json(generated_by=F.lit(generated_by), labels=names)
    attributes = F.when(failed, _json(error=F.col("error"))).when(modelled, model_attributes)
    attributes = attributes.when(routine.isin(*DETECTION_ROUTINES), _json(labels=names))
    if "zones" in described.columns:
        attributes = attributes.when(
            routine == "zone_counting", _json(zones=F.map_from_entries("zones"))
        )
    if "total_spots" in described.columns:
        attributes = attributes.when(
            routine == "parking_occupancy",
            _json(occupied=F.col("occupied"), total_spots=F.col("total_spots")),
        )
    attributes = attributes.otherwise(F.parse_json(F.lit("{}")))
    derived_only = F.create_map(*[part for name in DERIVED for part in (F.lit(name), F.col(name))])
    metrics = (
        F.when(failed, F.create_map().cast("map<string,double>"))
        .when(modelled, derived_only)
        .otherwise(fold_summary(F.col("summary")))
    )
    metadata = F.when(
        modelled, _json(routine=routine, commentator=F.lit("vlm"))
    ).otherwise(_json(routine=routine))
    source = F.when(modelled, F.lit("agent:vlm")).otherwise(F.concat(F.lit("routine:"), routine))
    return described.select(
        *_event(
            F.when(modelled, answer).otherwise(text), attributes, metrics, metadata, source,
            correlation_key(F.col("video_id"), frame, F.col("trace_id")), "frame",
            segment_start(frame, fps), segment_end(frame, fps, step), frame,
        )
    )


def motion_events(motion: DataFrame) -> DataFrame:
    """Events of a video-level routine: one per frame with motion, one rollup per video.

    ``motion`` has a row per processed frame with ``moving``, the number of
    moving objects, next to ``routine`` and the run's columns.
    """
    frame, fps, step = F.col("frame_index"), F.col("fps"), F.col("frame_step")
    routine, moving = F.col("routine"), F.col("moving")
    source = F.concat(F.lit("routine:"), routine)
    active = motion.filter(moving > 0).select(
        *_event(
            F.concat(
                routine, F.lit(" observed "), moving.cast("string"),
                F.lit(" moving object(s) in frame "), frame.cast("string"), F.lit("."),
            ),
            _json(moving=moving),
            F.create_map(F.lit("count"), moving.cast("double")),
            _json(routine=routine, level=F.lit("video")),
            source, correlation_key(F.col("video_id"), frame, F.col("trace_id")), "video",
            segment_start(frame, fps), segment_end(frame, fps, step), frame,
        )
    )
    totals = moving_totals(motion)
    none = F.lit(None).cast("double")
    rollup = totals.select(
        *_event(
            F.concat(
                routine, F.lit(" processed "), F.col("frames_processed").cast("string"),
                F.lit(" frame(s); "), F.col("total_moving").cast("string"),
                F.lit(" total moving detection(s)."),
            ),
            _json(frames_processed=F.col("frames_processed")),
            F.create_map(
                F.lit("frames_processed"), F.col("frames_processed").cast("double"),
                F.lit("total_moving"), F.col("total_moving").cast("double"),
            ),
            _json(routine=routine, level=F.lit("video"), rollup=F.lit(True)),
            source, rollup_key(F.col("video_id"), routine), "rollup",
            none, none, F.lit(None).cast("long"),
        )
    )
    return active.unionByName(rollup)


def moving_totals(motion: DataFrame) -> DataFrame:
    """Processed frames and moving objects per routine and video."""
    return motion.groupBy("routine", "video_id", "trace_id", "analysis_id").agg(
        F.count(F.lit(1)).alias("frames_processed"), F.sum("moving").alias("total_moving")
    )


def objects_detected(detections: DataFrame, motion: DataFrame) -> DataFrame:
    """Objects per video: detections of its frames plus moving objects."""
    boxes = detections.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    moving = motion.groupBy("video_id").agg(F.sum("moving").alias("n"))
    return boxes.unionByName(moving).groupBy("video_id").agg(F.sum("n").alias("objects_detected"))


def echo_commentary(described: DataFrame) -> DataFrame:
    """Frame events worded by the deterministic stand-in for a text model."""
    return frame_events(described, complete=echo_completion)
