"""An analysis run: several routines over the same sampled frames, as one set of tables."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerospark.operators import clustering, homography, motion, occupancy, pixels, zones
from aerospark.operators.commentary import describe_frames, frame_events, motion_events
from aerospark.operators.frames import FRAME_STEP, sample_frames

FRAME = ["video_id", "frame_index"]
# Rows of frames, boxes and vectors for a task: the joins and groups of a run all follow the frame,
# so one task holds the sorted rows of several of them at once.
TASK_ROWS = 1_000_000
SUMMARY = "routine string, level string, video_id long, frame_index long, summary map<string,double>"
BOX_COLUMNS = ["label", "score", "x", "y", "w", "h", "cx", "cy", "area"]


@dataclass(frozen=True)
class Footage:
    """The tables a run may use; a routine names the ones it needs."""

    frames: DataFrame
    pixels: DataFrame | None = None
    detections: DataFrame | None = None
    zones: DataFrame | None = None
    spots: DataFrame | None = None
    pairs: DataFrame | None = None
    vectors: DataFrame | None = None

    def need(self, name: str) -> DataFrame:
        table = getattr(self, name)
        if table is None:
            raise ValueError(f"this routine needs {name}")
        return table


@dataclass(frozen=True)
class Outcome:
    """What a routine gives: numbers per frame or video, and boxes."""

    summary: DataFrame
    detections: DataFrame | None = None
    motion: DataFrame | None = None


@dataclass(frozen=True)
class Routine:
    name: str
    run: Callable[..., Outcome]
    level: str
    description: str
    needs: tuple[str, ...] = ()

    def _given(self) -> list[inspect.Parameter]:
        return list(inspect.signature(self.run).parameters.values())[1:]

    def takes_any(self) -> bool:
        return any(p.kind is inspect.Parameter.VAR_KEYWORD for p in self._given())

    def parameters(self) -> list[str]:
        return [p.name for p in self._given() if p.kind is not inspect.Parameter.VAR_KEYWORD]


def _numbers(**values: Column) -> Column:
    parts = [p for name, value in values.items() for p in (F.lit(name), value.cast("double"))]
    return F.create_map(*parts).alias("summary")


def _counted(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    n = boxes.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))
    return frames.select(*FRAME).join(n, FRAME, "left").select(
        *FRAME, _numbers(count=F.coalesce("n", F.lit(0)))
    )


def color_detection(footage: Footage, **params) -> Outcome:
    boxes = pixels.detect_by_colour(footage.need("pixels"), **params)
    return Outcome(_counted(footage.frames, boxes), boxes)


def threshold_detection(footage: Footage, **params) -> Outcome:
    boxes = pixels.detect_by_threshold(footage.need("pixels"), **params)
    return Outcome(_counted(footage.frames, boxes), boxes)


def sliced_detection(footage: Footage, **params) -> Outcome:
    boxes = pixels.sliced_detection(footage.need("pixels"), **params)
    return Outcome(_counted(footage.frames, boxes), boxes)


def _boxes(footage: Footage) -> DataFrame:
    """Detections that are given, or else found by colour."""
    if footage.detections is not None:
        return footage.detections
    return pixels.detect_by_colour(footage.need("pixels"))


def zone_counting(footage: Footage) -> Outcome:
    boxes = _boxes(footage)
    counted = zones.zone_counts(footage.frames.select(*FRAME), boxes, footage.need("zones"))
    entries = F.transform("zones", lambda z: F.struct(z["zone"].alias("key"), z["detections"].cast("double").alias("value")))
    total = F.array(F.struct(F.lit("total").alias("key"), F.col("total").cast("double").alias("value")))
    return Outcome(
        counted.select(*FRAME, F.map_from_entries(F.concat(entries, total)).alias("summary")),
        boxes.select(*FRAME, *BOX_COLUMNS),
    )


def spatial_clustering(footage: Footage, **params) -> Outcome:
    points = _boxes(footage).select(*FRAME, "det_seq", F.col("cx").alias("x"), F.col("cy").alias("y"))
    totals = clustering.cluster_totals(clustering.cluster_points(points, FRAME, **params), FRAME)
    filled = footage.frames.select(*FRAME).join(totals, FRAME, "left")
    numbers = {n: F.coalesce(n, F.lit(0)) for n in ("n_points", "n_clusters", "n_noise")}
    return Outcome(filled.select(*FRAME, _numbers(**numbers)))


def color_histogram(footage: Footage, **params) -> Outcome:
    made = pixels.channel_histograms(footage.need("pixels"), **params)
    means = made.groupBy(*FRAME).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat(F.lit("mean_"), F.col("channel")), F.col("mean")))
        ).alias("summary")
    )
    return Outcome(means)


def parking_occupancy(footage: Footage, edge_threshold: float = pixels.EDGE_THRESHOLD) -> Outcome:
    features = pixels.spot_features(footage.frames, footage.need("pixels"), footage.need("spots"))
    summary = occupancy.occupancy_summary(occupancy.classify_by_edges(features, edge_threshold), FRAME)
    names = ("total_spots", "occupied", "available", "occupancy_rate")
    return Outcome(summary.select(*FRAME, _numbers(**{n: F.col(n) for n in names})))


def homography_map(footage: Footage) -> Outcome:
    pairs = footage.need("pairs")
    fitted = homography.with_inliers(pairs, homography.fit_inliers(pairs))
    return Outcome(
        fitted.select(
            F.col("camera").alias("video_id"), F.lit(None).cast("long").alias("frame_index"),
            _numbers(inliers=F.col("inliers"), n_correspondences=F.col("pairs")),
        )
    )


def optical_flow(footage: Footage) -> Outcome:
    summary = motion.flow_summary(footage.need("vectors"), FRAME)
    names = ("mean_magnitude", "median_magnitude", "max_magnitude", "dominant_direction_deg")
    return Outcome(summary.select(*FRAME, _numbers(**{n: F.col(n) for n in names})))


def background_subtraction(footage: Footage, **params) -> Outcome:
    per_frame, objects = pixels.background_subtraction(footage.need("pixels"), **params)
    summary = motion.motion_summary(per_frame, ["video_id"])
    names = ("frames_processed", "mean_motion_ratio", "max_motion_ratio")
    return Outcome(
        summary.select(
            "video_id", F.lit(None).cast("long").alias("frame_index"),
            _numbers(**{n: F.col(n) for n in names}),
        ),
        objects, per_frame,
    )


#: Every routine of a run: its work, whether it speaks of frames, pairs of frames or videos,
#: and the tables it cannot do without.
ROUTINES = {r.name: r for r in (
    Routine("color_detection", color_detection, "frame", "Objects of one colour range.", ('pixels',)),
    Routine("threshold_detection", threshold_detection, "frame", "Objects darker or lighter than their surroundings.", ('pixels',)),
    Routine("sliced_detection", sliced_detection, "frame", "Colour detection tile by tile, merged.", ('pixels',)),
    Routine("zone_counting", zone_counting, "frame", "Detections per polygonal zone.", ('zones',)),
    Routine("spatial_clustering", spatial_clustering, "frame", "Density clusters of detection centres.", ()),
    Routine("color_histogram", color_histogram, "frame", "Channel means of each frame.", ('pixels',)),
    Routine("parking_occupancy", parking_occupancy, "frame", "Occupied spots by edge density.", ('pixels', 'spots')),
    Routine("homography_map", homography_map, "video", "Homography of each video from point pairs.", ('pairs',)),
    Routine("optical_flow", optical_flow, "frame_pair", "Magnitude and direction of motion between sampled frames.", ('vectors',)),
    Routine("background_subtraction", background_subtraction, "video", "Moving objects against the running background.", ('pixels',)),
)}


def routine_table(spark: SparkSession) -> DataFrame:
    """What can be run: name, level, description, tables needed and parameters, by name."""
    rows = [
        (r.name, r.level, r.description, list(r.needs), r.parameters()) for r in sorted(ROUTINES.values(), key=lambda r: r.name)
    ]
    return spark.createDataFrame(
        rows, "name string, level string, description string, needs array<string>, parameters array<string>"
    )


def check_run(footage: Footage, names: list[str], params: dict[str, dict]) -> None:
    """Everything that is wrong with a run, found before any of it starts."""
    problems = [f"no routine is called {name}" for name in [*names, *params] if name not in ROUTINES]
    if not names:
        problems.append("no routine is asked for")
    for routine in (ROUTINES[name] for name in names if name in ROUTINES):
        problems += [f"{routine.name} reads {t}, which are not given" for t in routine.needs if getattr(footage, t) is None]
        given = params.get(routine.name, {})
        if not routine.takes_any():
            problems += [f"{routine.name} has no parameter {p}" for p in given if p not in routine.parameters()]
    if problems:
        raise ValueError("; ".join(problems))


def dealt_by_frame(footage: Footage) -> Callable[[DataFrame], DataFrame]:
    """Deals a table out by frame, to as many tasks as the rows of the footage ask for.

    Left to itself Spark puts partitions together by their compressed size, whatever they take
    in memory.  Footage of few rows is left to it.
    """
    tables = [t for t in (footage.frames, footage.detections, footage.vectors) if t is not None]
    tasks = -(-sum(t.count() for t in tables) // TASK_ROWS)
    if tasks <= footage.frames.sparkSession.sparkContext.defaultParallelism:
        return lambda table: table
    return lambda table: table.repartition(tasks, *FRAME)


def run_routines(
    footage: Footage, names: list[str], params: dict[str, dict] | None = None,
    frame_step: int = FRAME_STEP, max_frames: int | None = None,
) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Run routines by name over sampled frames.

    A run that cannot work is refused before any of it starts.  Every table with frame
    numbers is cut to the sampled frames once.  Returns the summaries, the boxes
    and the motion rows of all routines, each as one table with ``routine``.
    """
    check_run(footage, names, params or {})
    dealt = dealt_by_frame(footage)
    frames = sample_frames(footage.frames, frame_step, max_frames)
    chosen = frames.select(*FRAME)
    cut = {
        name: dealt(getattr(footage, name).join(chosen, FRAME, "left_semi"))
        for name in ("pixels", "detections", "vectors")
        if getattr(footage, name) is not None
    }
    sampled = replace(footage, frames=dealt(frames), **cut)
    summaries, boxes, moved = [], [], []
    for name in names:
        routine = ROUTINES[name]
        outcome = routine.run(sampled, **(params or {}).get(name, {}))
        tag = [F.lit(name).alias("routine"), F.lit(routine.level).alias("level")]
        summary = outcome.summary
        if routine.level == "frame_pair":
            first = chosen.groupBy("video_id").agg(F.min("frame_index").alias("frame_index"))
            summary = summary.join(first, FRAME, "left_anti")
        summaries.append(summary.select(*tag, *FRAME, "summary"))
        if outcome.detections is not None:
            boxes.append(outcome.detections.select(tag[0], *FRAME, *BOX_COLUMNS))
        if outcome.motion is not None:
            moved.append(outcome.motion.select(tag[0], *FRAME, "moving"))

    def union(tables: list[DataFrame]) -> DataFrame | None:
        return reduce(DataFrame.unionByName, tables) if tables else None

    return union(summaries), union(boxes), union(moved)


def run_events(
    summaries: DataFrame, boxes: DataFrame | None, moved: DataFrame | None, run: DataFrame
) -> DataFrame:
    """Commentary events of a run.

    ``run`` has ``video_id, trace_id, analysis_id, fps, frame_step`` per video.
    """
    keys = ["routine", *FRAME]
    framed = summaries.filter(F.col("level") != "video").withColumn("error", F.lit(None).cast("string"))
    if boxes is None:
        boxes = summaries.sparkSession.createDataFrame(
            [], "routine string, video_id long, frame_index long, label string, score double, area double"
        )
    events = frame_events(describe_frames(framed.join(run, "video_id"), boxes, keys))
    if moved is None:
        return events
    return events.unionByName(motion_events(moved.join(run, "video_id")))
