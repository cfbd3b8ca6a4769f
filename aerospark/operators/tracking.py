"""Object tracks from frame-by-frame detections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerospark.functions.track_lanes import advance_lanes, ends_of_lane, same_objects, unpacked
from aerospark.functions.track_step import MAX_DISAPPEARED, MAX_DISTANCE, Tracks
from aerospark.scale import broadcast_if_small, durable, fits, work_path

# Frames of a chunk, the unit in which a video is cut, and rows where frames are crowded.
CHUNK_FRAMES = 20_000
CHUNK_ROWS = 400_000
# Frames between two cuts of the work that finds the stretches.
SPAN = 4096

# Frames of a stretch that a task goes through between two writes, a batch of rows at a time.
LEG_FRAMES = 240_000
# Up to this many stretches each get a task of their own.
LANES = 256

# Videos of more frames are gone through in lanes side by side, of so many frames or rows, after some frames
# in which the objects of a lane come to be those that live there.
LANES_FROM = 40_000
LANE_FRAMES = 2048
LANE_ROWS = 200_000
WARM_FRAMES = 320
# Rows that a task is dealt, and those beyond which it leaves its largest lanes to the legs.
TASK_ROWS = 1_000_000
TASK_LIMIT = 6_000_000
# First objects of lanes and their lanes that may be broadcast.
CARRIED = 4_000_000
# Rounds in which lanes that began with other objects are repeated.
REPEATS = 6

# Rows of a written leg: ids of detections, and, where ``missed`` is not null, the live objects at
# its end (the id as ``det_seq``) with the next free id behind them, without a place.  They are flat,
# since Spark measures list columns from the start for every row it hands to Python.
OUTPUT = (
    "video_id long, start long, frame_index long, det_seq long, track_id long, cx double, cy double, missed int"
)
ARROW_OUTPUT = pa.schema([
    *[(name, pa.int64()) for name in ("video_id", "start", "frame_index", "det_seq", "track_id")],
    ("cx", pa.float64()), ("cy", pa.float64()), ("missed", pa.int32()),
])


def _advance(max_distance: float, max_disappeared: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of one task: its stretches one after another, each from the objects carried to it.

    Rows come by stretch and in it in order, carried ones first.  A task holds a batch, the rows of
    one frame and the live objects of one stretch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracks, stretch, frame = Tracks(), None, None
        seqs: list[int] = []
        xs: list[float] = []
        ys: list[float] = []
        made: list[list] = [[] for _ in ARROW_OUTPUT.names]

        def add(frame, seqs, ids, xs, ys, missed) -> None:
            """Rows of the stretch; what is given once stands for all of them."""
            for values, some in zip(made, (*stretch, frame, seqs, ids, xs, ys, missed)):
                values += some if isinstance(some, list) else [some] * len(seqs)

        def end_frame() -> None:
            nonlocal frame
            if frame is not None:
                add(frame, seqs, tracks.advance(xs, ys, max_distance, max_disappeared), None, None, None)
                frame = None
                for values in (seqs, xs, ys):
                    values.clear()

        def end_stretch() -> None:
            end_frame()
            if stretch is not None:
                add(None, tracks.ids, None, tracks.xs, tracks.ys, tracks.missed)
                add(None, [tracks.next_id], None, None, None, 0)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(values, field.type) for values, field in zip(made, ARROW_OUTPUT)], schema=ARROW_OUTPUT
            )
            for values in made:
                values.clear()
            return batch

        for batch in batches:
            columns = [
                batch.column(name).to_numpy(zero_copy_only=False).tolist()
                for name in ("video_id", "start", "carried", "frame_index", "det_seq", "present", "cx", "cy", "missed")
            ]
            for video, start, carried, index, seq, present, x, y, missed in zip(*columns):
                if stretch != (video, start):
                    end_stretch()
                    stretch, tracks = (video, start), Tracks()
                if carried:
                    if present:
                        for values, value in zip((tracks.ids, tracks.xs, tracks.ys, tracks.missed), (seq, x, y, missed)):
                            values.append(value)
                    else:
                        tracks.next_id = seq
                    continue
                if index != frame:
                    end_frame()
                    frame = index
                if present:
                    seqs.append(seq)
                    xs.append(x)
                    ys.append(y)
            yield flush()
        end_stretch()
        yield flush()

    return run


# Rows of written lanes: ids of detections, carried ones as -1 - place among the first objects and born ones
# from 0, and, without a frame, a row per lane with its first and last objects (``Lane.packed``).
LANE_OUTPUT = "video_id long, lane long, frame_index long, det_seq long, track_id long, ends binary"
CHAIN_OUTPUT = "video_id long, lane long, round int, offset long, ids array<long>, state binary, whole boolean"


def _advance_lanes(
    max_distance: float, max_disappeared: int, task_limit: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The work of one task: all its lanes together, a frame of each in a step.

    Rows come in no order; ``lane`` is twice the lane's number, and one more for its own frames.  While
    there are more than ``task_limit`` rows the largest lane is given up: its row has no objects, and
    its video is left to the legs.
    """
    names = ("video_id", "lane", "frame_index", "det_seq", "present", "cx", "cy")
    schema = pa.schema([
        *[(name, pa.int64()) for name in ("video_id", "lane", "frame_index", "det_seq", "track_id")], ("ends", pa.binary()),
    ])

    def table(**columns) -> pa.RecordBatch:
        n = len(columns["video_id"])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    def advance(parts: list[list[np.ndarray]], states: dict[tuple[int, int], bytes]) -> Iterator[pa.RecordBatch]:
        rows = {}
        for name in reversed(names):
            rows[name] = np.concatenate([part.pop() for part in parts])
        own = rows["lane"] % 2 == 1
        order = np.lexsort((rows["det_seq"], rows["frame_index"], rows["lane"] // 2, rows["video_id"]))
        video, lane, frame, seq, present = (rows[name][order] for name in names[:5])
        lane, home, keep = lane // 2, own[order], present
        xs, ys = rows["cx"][order][keep], rows["cy"][order][keep]
        del rows, order
        starts = np.r_[True, (video[1:] != video[:-1]) | (lane[1:] != lane[:-1])]
        opens = np.flatnonzero(starts | np.r_[True, frame[1:] != frame[:-1]])
        begins = np.r_[0, np.cumsum(present)]
        counts = np.diff(begins[np.r_[opens, len(video)]])
        lane_begins = np.r_[np.flatnonzero(starts[opens]), len(opens)]
        warm = np.bincount((np.cumsum(starts[opens]) - 1)[~home[opens]], minlength=len(lane_begins) - 1)
        keys = list(zip(video[opens[lane_begins[:-1]]].tolist(), lane[opens[lane_begins[:-1]]].tolist()))
        begun = {i: states[key] for i, key in enumerate(keys) if key in states}
        with np.errstate(all="ignore"):
            given, ends = advance_lanes(
                lane_begins, warm, begins[opens], counts, xs, ys, max_distance, max_disappeared, begun
            )
        mine = home & present
        yield table(
            video_id=video[mine], lane=lane[mine], frame_index=frame[mine], det_seq=seq[mine], track_id=given[home[present]]
        )
        # a lane without frames of its own lies behind the video's end
        some = np.flatnonzero(np.diff(lane_begins) > warm).tolist()
        if some:
            videos, lanes = zip(*[keys[i] for i in some])
            yield table(video_id=videos, lane=lanes, ends=[ends[i].packed() for i in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        states: dict[tuple[int, int], bytes] = {}
        given_up: set[tuple[int, int]] = set()
        held = 0

        def without(part: list[np.ndarray]) -> list[np.ndarray]:
            gone = np.zeros(len(part[0]), dtype=bool)
            for video, lane in given_up:
                gone |= (part[0] == video) & (part[1] // 2 == lane)
            return [values[~gone] for values in part] if gone.any() else part

        for batch in batches:
            seq = batch.column("det_seq")
            part = [batch.column(name).to_numpy(zero_copy_only=False) for name in names[:3]]
            part += [seq.fill_null(0).to_numpy(zero_copy_only=False), seq.is_valid().to_numpy(zero_copy_only=False)]
            part += [batch.column(name).to_numpy(zero_copy_only=False) for name in names[5:]]
            if "state" in batch.schema.names:
                begun = batch.column("state")
                carried = begun.is_valid().to_numpy(zero_copy_only=False)
                for row in np.flatnonzero(carried).tolist():
                    states[int(part[0][row]), int(part[1][row]) // 2] = begun[row].as_py()
                part = [values[~carried] for values in part]
            if given_up:
                part = without(part)
            parts.append(part)
            held += len(part[0])
            while held > task_limit:
                sizes: dict[tuple[int, int], int] = {}
                for video, lane, *_ in parts:
                    pairs, n = np.unique(np.stack([video, lane // 2]), axis=1, return_counts=True)
                    for pair, rows in zip(zip(*pairs.tolist()), n.tolist()):
                        sizes[pair] = sizes.get(pair, 0) + rows
                given_up.add(max(sizes, key=sizes.get))
                parts = [without(part) for part in parts]
                held = sum(len(part[0]) for part in parts)
        if given_up:
            videos, lanes = zip(*sorted(given_up))
            yield table(video_id=videos, lane=lanes, ends=[b""] * len(videos))
        if held:
            yield from advance(parts, states)

    return run


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lanes of whole videos in order: whether each began with the objects that the one before left.

    ``offset`` is to be added to the ids of born objects, ``ids`` are those of the first ones.  A lane
    that began with other objects is not ``whole``; ``state`` is what it should have begun with, or
    null if its video is left to the legs.
    """
    schema = pa.schema([
        ("video_id", pa.int64()), ("lane", pa.int64()), ("round", pa.int32()), ("offset", pa.int64()),
        ("ids", pa.list_(pa.int64())), ("state", pa.binary()), ("whole", pa.bool_()),
    ])
    video, last, ids, next_id = None, None, None, 0
    nothing = np.zeros((3, 0), dtype=np.int64).tobytes()
    for batch in batches:
        made = []
        for row in batch.to_pylist():
            if row["video_id"] != video:
                video, last, ids, next_id = row["video_id"], nothing, np.zeros(0, dtype=np.int64), 0
            if not row["ends"]:
                made.append((video, row["lane"], row["round"], 0, [], None, False))
                last = None
                continue
            first, ending, ends, born, tied = ends_of_lane(row["ends"])
            place = None if last is None else same_objects(unpacked(last), first, tied)
            offset, state = next_id, None
            whole = place is not None
            if not whole:
                state, place = last, np.zeros(first.shape[1], dtype=np.int64)
            mine = ids[place] if whole else place
            made.append((video, row["lane"], row["round"], offset, mine, state, whole))
            known = len(mine)
            ids = np.where(ends < known, np.append(mine, 0)[np.minimum(ends, known)], ends - known + offset)
            # first objects may have stood in another order than in the whole video
            oldest = np.argsort(ids, kind="stable")
            ids, last, next_id = ids[oldest], ending[:, oldest].tobytes(), next_id + born
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, field.type) for values, field in zip(zip(*made), schema)]
            if made else [pa.nulls(0, field.type) for field in schema], schema=schema,
        )


def marked_rows(rows: DataFrame, *more: str) -> DataFrame:
    """Rows without nulls in ``det_seq``: pandas would turn such a column to floats."""
    return rows.select(
        "video_id", "frame_index", *more, F.coalesce("det_seq", F.lit(-1)).alias("det_seq"),
        F.col("det_seq").isNotNull().alias("present"), "cx", "cy",
    )


def weighed_frames(frames: DataFrame, boxes: DataFrame, chunk_frames: int, chunk_rows: int) -> DataFrame:
    """``video_id, frame_index, n, weight``: detections and share of a chunk of every frame.

    A frame weighs one, or more if it is crowded: ``chunk_rows`` detections weigh a chunk, and so
    do more of them in one frame, which no cut can part.
    """
    keys = ["video_id", "frame_index"]
    weight = F.least(F.lit(chunk_frames), F.greatest(F.lit(1), F.ceil(F.sum("n") * chunk_frames / chunk_rows)))
    every = frames.select(*keys, F.lit(0).alias("n")).unionByName(boxes.select(*keys, F.lit(1).alias("n")))
    return every.groupBy(*keys).agg(F.sum("n").alias("n"), weight.cast("bigint").alias("weight"))


def in_stretches(weighed: DataFrame, max_disappeared: int, chunk_frames: int) -> DataFrame:
    """``video_id, frame_index, start, part`` for every weighed frame: its stretch and chunk of that.

    After more than ``max_disappeared`` frames without detections no object lives, so the next
    detection may begin a stretch that needs nothing from before.  ``start`` names a stretch
    by its first frame.  Of the possible cuts only the first in each half chunk is used, so
    there are few stretches and most fit in a chunk; ``part`` counts the chunks by weight.
    A long video is cut into spans, so no task orders more than a span of frames, or one row
    per span or half chunk.
    """
    keys = ["video_id", "frame_index"]
    inside = Window.partitionBy("video_id", "span").orderBy("frame_index")
    ranged = weighed.withColumn("span", F.floor(F.col("frame_index") / SPAN))
    placed = durable(ranged.withColumn("place", F.row_number().over(inside)).withColumn(
        "before", F.sum("weight").over(inside) - F.col("weight")
    ).withColumn(
        "last", F.max(F.when(F.col("n") > 0, F.col("place"))).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ))
    earlier = Window.partitionBy("video_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = placed.groupBy("video_id", "span").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("places"),
        F.max(F.when(F.col("n") > 0, F.col("place"))).alias("last"),
    ).withColumn("places_before", F.coalesce(F.sum("places").over(earlier), F.lit(0))).select(
        "video_id", "span", "places_before",
        F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("weight_before"),
        F.max(F.col("places_before") + F.col("last")).over(earlier).alias("last_before"),
    )
    gap = F.col("place") + F.col("places_before") - F.coalesce(
        F.col("last") + F.col("places_before"), F.col("last_before"), F.lit(0)
    ) - 1
    flat = placed.join(broadcast_if_small(spans), ["video_id", "span"]).select(
        *keys, (F.col("before") + F.col("weight_before")).alias("before"),
        ((F.col("n") > 0) & (gap > max_disappeared)).alias("cut"),
    ).withColumn("bucket", F.floor(F.col("before") / max(1, chunk_frames // 2)))
    # a bucket's own cut, or the last one before it, or the video's first frame
    to_here = Window.partitionBy("video_id").orderBy("bucket")
    first = F.struct(F.col("frame_index").alias("start"), F.col("before").alias("base"))
    buckets = flat.groupBy("video_id", "bucket").agg(
        F.min(F.when(F.col("cut"), first)).alias("own"), F.min(first).alias("head")
    ).select(
        "video_id", "bucket", "own",
        F.coalesce(
            F.last("own", ignorenulls=True).over(to_here.rowsBetween(Window.unboundedPreceding, -1)),
            F.first("head").over(to_here),
        ).alias("kept"),
    )
    chosen = F.when(F.col("frame_index") >= F.col("own.start"), F.col("own")).otherwise(F.col("kept"))
    return flat.join(broadcast_if_small(buckets), ["video_id", "bucket"]).withColumn("chosen", chosen).select(
        *keys, F.col("chosen.start").alias("start"),
        F.floor((F.col("before") - F.col("chosen.base")) / chunk_frames).alias("part"),
    )


def footage(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """``video_id, low, high, frames, rows`` for every video: its first and last frame and its rows."""
    every = frames.select("video_id", "frame_index", F.lit(1).alias("n")).unionByName(
        boxes.select("video_id", "frame_index", F.lit(0).alias("n"))
    )
    seen = every.groupBy("video_id").agg(
        F.min("frame_index").alias("low"), F.max("frame_index").alias("high"), F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("rows"),
    )
    return seen.select("video_id", "low", "high", F.greatest(F.lit(1), "n").alias("frames"), "rows")


def in_lanes(
    frames: DataFrame, boxes: DataFrame, videos: DataFrame, max_disappeared: int, lane_frames: int, warm_frames: int
) -> DataFrame:
    """Rows of frames and detections with their lane; those just before a lane come for it as well.

    ``lane`` is twice the lane's number, and one more for the lane's own frames.
    A lane is a range of frame numbers, wide enough for ``lane_frames`` frames where they are dealt out evenly,
    fewer if they are crowded.
    """
    stride = F.ceil((F.col("high") - F.col("low") + 1) / F.col("frames"))
    warm = max(warm_frames, 8 * (max_disappeared + 1))
    a_lane = F.greatest(F.lit(warm), F.least(F.lit(lane_frames), F.floor(F.lit(LANE_ROWS) * F.col("frames") / F.col("rows"))))
    wide = videos.select(
        "video_id", "low", (stride * a_lane).cast("long").alias("_span"), (stride * warm).cast("long").alias("_warm")
    )
    number = F.lit(None).cast("double")
    rows = frames.select(
        "video_id", F.col("frame_index").cast("long"), F.lit(None).cast("long").alias("det_seq"), number.alias("cx"),
        number.alias("cy"),
    ).unionByName(boxes.select(
        "video_id", *[F.col(name).cast("long") for name in ("frame_index", "det_seq")],
        *[F.col(name).cast("double") for name in ("cx", "cy")],
    )).join(broadcast_if_small(wide), "video_id")
    place = F.col("frame_index") - F.col("low")
    own = F.expr("(frame_index - low) div _span") * 2 + 1
    both = place % F.col("_span") >= F.col("_span") - F.col("_warm")
    return rows.select(
        F.col("video_id").cast("long"), F.explode(F.when(both, F.array(own, own + 1)).otherwise(F.array(own))).alias("lane"),
        "frame_index", "det_seq", "cx", "cy",
    )


def tracks_in_lanes(
    frames: DataFrame, boxes: DataFrame, videos: DataFrame, max_distance: float, max_disappeared: int,
    chunk_frames: int, chunk_rows: int, leg_frames: int, lane_frames: int, warm_frames: int,
) -> DataFrame:
    """Tracks of long videos, all of a video's lanes side by side.

    What lives at a frame comes from the few frames before it, so a lane begins some frames early,
    without objects, and by its own first frame has those that live there; its first objects are held
    against the last ones of the lane before.  Where they differ, the lane is repeated from those, and
    what then ends otherwise is found in the next round.  A video with lanes that still differ after
    ``REPEATS`` rounds goes through the legs.  Objects are held against each other by place and age;
    their order counts as well where it settled a claim.  So all ids are those of the whole video
    gone through in order, since equal objects and equal frames make equal ones.
    """
    spark = frames.sparkSession
    one = ["video_id", "lane"]
    there = F.col("video_id").isNotNull() & F.col("frame_index").isNotNull()
    frames, boxes = frames.filter(there).select("video_id", "frame_index"), boxes.filter(there)
    rows = in_lanes(frames, boxes, videos, max_disappeared, lane_frames, warm_frames)
    work = _advance_lanes(max_distance, max_disappeared, TASK_LIMIT)
    made = work_path(spark, "lanes")
    total = videos.agg(F.sum("rows")).first()[0]

    def advance(now: DataFrame, number: int, tasks: int) -> None:
        dealt = now.repartition(tasks, F.col("video_id"), F.shiftright("lane", 1))
        dealt.mapInArrow(work, LANE_OUTPUT).write.parquet(f"{made}/round={number}")

    tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    advance(rows, 0, tasks)
    for number in range(REPEATS + 1):
        done = None
        for past in range(number + 1):
            some = spark.read.schema(LANE_OUTPUT).parquet(f"{made}/round={past}").withColumn("round", F.lit(past))
            done = some if done is None else done.unionByName(some)
        ends = done.filter(F.col("frame_index").isNull()).select(*one, "round", "ends")
        latest = ends if number == 0 else ends.join(
            ends.groupBy(*one).agg(F.max("round").alias("round")), [*one, "round"]
        )
        chain = durable(
            latest.select(*one, "round", "ends").repartition("video_id").sortWithinPartitions(*one).mapInArrow(_chain, CHAIN_OUTPUT)
        )
        apart = chain.filter(~F.col("whole"))
        lost = apart.filter(F.col("state").isNull()).select("video_id").distinct()
        again = apart.join(broadcast_if_small(lost), "video_id", "left_anti").select(*one, "state")
        repeated = again.count() if number < REPEATS else 0
        if not repeated:
            break
        begun = again.select(
            "video_id", (F.col("lane") * 2 + 1).alias("lane"), F.lit(0).cast("long").alias("frame_index"), "state"
        )
        held = rows.filter("lane % 2 = 1").join(broadcast_if_small(begun.select(*one)), one, "left_semi")
        advance(held.unionByName(begun, allowMissingColumns=True), number + 1, min(repeated, tasks))
    lost = durable(apart.select("video_id").distinct())
    ready = chain.join(broadcast_if_small(lost), "video_id", "left_anti").select(*one, "round", "offset", "ids")
    if (ready.agg(F.sum(F.size("ids") + 8)).first()[0] or 0) <= CARRIED:
        ready = F.broadcast(ready)
    known = F.get("ids", (-1 - F.col("track_id")).cast("int"))
    tracks = done.filter(F.col("frame_index").isNotNull()).join(
        ready, [*one, "round"]
    ).select(
        "video_id", "frame_index", "det_seq",
        F.when(F.col("track_id") < 0, known).otherwise(F.col("track_id") + F.col("offset")).alias("track_id"),
    )
    if lost.isEmpty():
        return tracks
    left = broadcast_if_small(lost)
    return tracks.unionByName(tracks_in_legs(
        frames.join(left, "video_id", "left_semi"), boxes.join(left, "video_id", "left_semi"), max_distance,
        max_disappeared, chunk_frames, chunk_rows, leg_frames,
    ))


def track_objects(
    frames: DataFrame, detections: DataFrame, max_distance: float = MAX_DISTANCE,
    max_disappeared: int = MAX_DISAPPEARED, chunk_frames: int = CHUNK_FRAMES, chunk_rows: int = CHUNK_ROWS,
    leg_frames: int = LEG_FRAMES, lanes_from: int = LANES_FROM, lane_frames: int = LANE_FRAMES,
    warm_frames: int = WARM_FRAMES,
) -> DataFrame:
    """``video_id, frame_index, det_seq, track_id`` for every detection.

    ``frames`` lists the frames in view, so that one without detections ages the
    tracks; a frame that only has detections counts as well.  Where a video has more than
    ``lanes_from`` frames all are gone through in lanes (``tracks_in_lanes``), else in legs.
    """
    boxes = detections.select("video_id", "frame_index", "det_seq", "cx", "cy")
    videos = durable(footage(frames, boxes))
    if (videos.agg(F.max("frames")).first()[0] or 0) > lanes_from:
        return tracks_in_lanes(
            frames, boxes, videos, max_distance, max_disappeared, chunk_frames, chunk_rows, leg_frames, lane_frames, warm_frames
        )
    return tracks_in_legs(frames, boxes, max_distance, max_disappeared, chunk_frames, chunk_rows, leg_frames)


def tracks_in_legs(
    frames: DataFrame, detections: DataFrame, max_distance: float = MAX_DISTANCE,
    max_disappeared: int = MAX_DISAPPEARED, chunk_frames: int = CHUNK_FRAMES, chunk_rows: int = CHUNK_ROWS,
    leg_frames: int = LEG_FRAMES,
) -> DataFrame:
    """``video_id, frame_index, det_seq, track_id`` for every detection.

    ``frames`` lists the frames in view, so that one without detections ages the
    tracks; a frame that only has detections counts as well.  A video falls apart where no
    object lives (``in_stretches``).  Its stretches run side by side, each numbering its own
    objects; the objects born in the stretches before, added up, make the ids whole.  Within
    a stretch ids depend on all earlier frames, so its frames go in order; but it is cut into
    legs, whole chunks of about ``leg_frames`` frames, fewer where they are crowded.  A task goes
    through a leg from the live objects carried from the leg before, a batch of rows at a time, so
    the number of jobs hangs on the legs and not on the chunks.  Legs with the same number run side
    by side.  They are staged by round, so a round reads its own legs alone, and each round is
    written down: a lost executor repeats one leg, not a video.
    """
    keys = ["video_id", "frame_index"]
    one = ["video_id", "start"]
    boxes = detections.select(*keys, "det_seq", "cx", "cy")
    weighed = durable(weighed_frames(frames, boxes, chunk_frames, chunk_rows))
    work = _advance(max_distance, max_disappeared)
    spark = frames.sparkSession
    wanted = [*keys, "start", "det_seq", "present", "cx", "cy"]

    def tracked(now: DataFrame, streams: DataFrame, state: DataFrame | None = None) -> DataFrame:
        rows = now.select(*wanted, F.lit(0).alias("missed"), F.lit(False).alias("carried"))
        if state is not None:
            rows = rows.unionByName(state.select(
                *one, F.lit(0).alias("frame_index"), "det_seq", F.col("cx").isNotNull().alias("present"),
                "cx", "cy", "missed", F.lit(True).alias("carried"),
            ))
        if fits(streams, LANES):
            # hashes of a few stretches meet, and then one task goes through two of them
            lanes = streams.withColumn("lane", F.row_number().over(Window.orderBy(*one)) - 1)
            dealt = rows.join(F.broadcast(lanes), one).repartitionById(max(1, streams.count()), F.col("lane")).drop("lane")
        else:
            dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *one)
        return dealt.sortWithinPartitions(*one, F.desc("carried"), "frame_index", "det_seq").mapInArrow(work, OUTPUT)

    longest = weighed.groupBy("video_id").agg(F.sum("weight").alias("weight")).agg(F.max("weight")).first()[0]
    if (longest or 0) <= chunk_frames:
        # every video is one chunk
        whole = marked_rows(weighed.select(*keys, F.lit(0).cast("bigint").alias("start")).join(boxes, keys, "left"), "start")
        streams = weighed.select("video_id", F.lit(0).cast("bigint").alias("start")).distinct()
        return tracked(whole, streams).filter(F.col("missed").isNull()).select(*keys, "det_seq", "track_id")
    seen = in_stretches(weighed, max_disappeared, chunk_frames)
    leg = F.floor(F.col("part") / max(1, leg_frames // chunk_frames)).cast("int")
    rows = marked_rows(seen.withColumn("_round", leg).join(boxes, keys, "left"), "start", "_round")
    staged, made = work_path(spark, "legs"), work_path(spark, "tracks")
    rows.write.partitionBy("_round").parquet(staged)
    legs = spark.read.schema(rows.schema).parquet(staged)
    streams = durable(legs.groupBy(*one).agg(F.max("_round").alias("last")))
    rounds = streams.agg(F.max("last")).first()[0] + 1
    state = None
    for number in range(rounds):
        live = streams.filter(F.col("last") >= number).select(*one)
        tracked(legs.filter(F.col("_round") == number), live, state).write.parquet(f"{made}/round={number}")
        # A stretch that ended passes no state on.
        done = spark.read.schema(OUTPUT).parquet(f"{made}/round={number}")
        state = done.filter(F.col("missed").isNotNull()).join(
            streams.filter(F.col("last") > number).select(*one), one, "left_semi"
        )
    every = spark.read.schema(OUTPUT).parquet(*[f"{made}/round={number}" for number in range(rounds)])
    found = every.filter(F.col("missed").isNull())
    earlier = Window.partitionBy("video_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    born = found.groupBy(*one).agg((F.max("track_id") + 1).alias("n")).select(
        *one, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")
    )
    return found.join(broadcast_if_small(born), one).select(
        *keys, "det_seq", (F.col("track_id") + F.col("_before")).alias("track_id")
    )
