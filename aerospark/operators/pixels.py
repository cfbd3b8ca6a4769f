"""Jobs over pixel tables ``(video_id, frame_index, x, y, b, g, r)``.

Each replaces a routine that looks at one decoded image at a time.  Where a
result cannot equal the image library's, the docstring says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerospark.functions.colours import gray, hsv, in_range
from aerospark.operators.blobs import cleaned, find_blobs, frame_sizes, opened
from aerospark.operators.suppression import AGNOSTIC_IOU, suppress
from aerospark.operators.tiles import tile_steps, to_frame
from aerospark.scale import broadcast_if_small, durable, fits

FRAME = ["video_id", "frame_index"]
# Fixed defaults of the routines.
RED_LOWER, RED_UPPER = (0, 70, 50), (10, 255, 255)
KERNEL = 5
MIN_AREA = 100.0
TILE_MIN_AREA = 30.0
MOTION_MIN_AREA = 200.0
HISTORY = 200
VAR_THRESHOLD = 16.0
VAR_FLOOR = 4.0
EDGE_GRADIENT = 50
EDGE_THRESHOLD = 0.08
#: A colour centre that moves by less than this, squared, has settled.
SETTLED = 1e-12
#: Distinct colours of a frame that one task takes at once.
FRAME_COLOURS = 65_536


def with_gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", gray(F.col("b"), F.col("g"), F.col("r")))


def channel_histograms(pixels: DataFrame, bins: int = 32, keys: list[str] = FRAME) -> DataFrame:
    """Per frame and channel: a histogram that sums to 1, and the mean.

    Pixels are counted per frame, channel and bin before anything is gathered.
    """
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in "bgr"])
    long = pixels.select(*keys, F.explode(channels).alias("p")).select(*keys, "p.channel", "p.v")
    counted = long.groupBy(
        *keys, "channel", F.floor(F.col("v") * bins / 256).cast("int").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    framed = counted.groupBy(*keys, "channel").agg(
        F.sum("n").alias("pixels"), F.sum("total").alias("total"),
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"),
    )
    share = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda i: F.coalesce(F.try_element_at(F.col("counts"), i), F.lit(0)) / F.col("pixels"),
    )
    return framed.select(*keys, "channel", share.alias("histogram"), (F.col("total") / F.col("pixels")).alias("mean"))


def _sized(marked: DataFrame, pixels: DataFrame, keys: list[str]) -> DataFrame:
    return marked.join(frame_sizes(pixels, keys), keys)


def _as_detections(blobs: DataFrame, label: str) -> DataFrame:
    return blobs.select("*", F.lit(label).alias("label"), F.lit(1.0).alias("score"))


def colour_mask(
    pixels: DataFrame, lower=RED_LOWER, upper=RED_UPPER, keys: list[str] = FRAME
) -> DataFrame:
    """Pixels whose colour lies in the range: dropped at the scan, before any shuffle."""
    colour = hsv(F.col("b"), F.col("g"), F.col("r"))
    return pixels.filter(in_range(colour, lower, upper)).select(*keys, "x", "y")


def detect_by_colour(
    pixels: DataFrame, lower=RED_LOWER, upper=RED_UPPER, min_area: float = MIN_AREA,
    kernel: int = KERNEL, label: str = "object",
) -> DataFrame:
    """Blobs of one colour range after opening and closing.

    The area is the pixel count rather than that of a contour polygon, and a
    blob inside the hole of another is kept.
    """
    mask = _sized(colour_mask(pixels, lower, upper), pixels, FRAME)
    if kernel > 0:
        mask = cleaned(mask, FRAME, kernel)
    return _as_detections(find_blobs(mask, FRAME, min_area), label)


def _sliding(sums: dict[str, Column], order: WindowSpec, first: int, last: int) -> dict[str, Column]:
    """Sums of whole numbers from ``first`` to ``last`` places around a row.

    Each is the difference of two sums from the start, which take the same work for every
    row however wide the range is.
    """
    start = Window.unboundedPreceding
    upto, before = order.rangeBetween(start, last), order.rangeBetween(start, first - 1)
    return {
        name: F.coalesce(value.over(upto), F.lit(0)) - F.coalesce(value.over(before), F.lit(0))
        for name, value in sums.items()
    }


def detect_by_threshold(
    pixels: DataFrame, min_area: float = MIN_AREA, block: int = 35, c: float = 5.0,
    invert: bool = True, label: str = "object",
) -> DataFrame:
    """Blobs darker (or lighter) than the mean of their surroundings.

    The surroundings are a plain box mean over the pixels that exist, without
    Gaussian weights and without a blur before.
    """
    radius = (block if block % 2 else block + 1) // 2
    shaded = with_gray(pixels).select(*FRAME, "x", "y", F.col("gray").cast("long").alias("gray"))
    across = Window.partitionBy(*FRAME, "y").orderBy("x")
    rows = shaded.withColumns(_sliding({"s": F.sum("gray"), "n": F.count("gray")}, across, -radius, radius))
    down = Window.partitionBy(*FRAME, "x").orderBy("y")
    boxes = rows.withColumns(_sliding({"all_s": F.sum("s"), "all_n": F.sum("n")}, down, -radius, radius))
    local = boxes.withColumn("limit", F.col("all_s") / F.col("all_n") - c)
    dark = F.col("gray") <= F.col("limit")
    marked = local.filter(dark if invert else ~dark).select(*FRAME, "x", "y")
    return _as_detections(find_blobs(_sized(marked, pixels, FRAME), FRAME, min_area), label)


def foreground(
    pixels: DataFrame, span: int = HISTORY, threshold: float = VAR_THRESHOLD
) -> DataFrame:
    """Pixels that left the running mean of their last ``span`` frame numbers.

    One running Gaussian per pixel in place of a mixture, and no shadow class.
    The history of a pixel is cut into stretches of ``span`` frames; a stretch
    also sees the one before, so no task holds a whole video of a pixel.
    """
    shaded = with_gray(pixels).select(*FRAME, "x", "y", "gray")
    own = F.floor(F.col("frame_index") / span)
    copies = F.array(
        F.struct(own.alias("part"), F.lit(True).alias("own")),
        F.struct((own + 1).alias("part"), F.lit(False).alias("own")),
    )
    parted = shaded.select("*", F.explode(copies).alias("c")).select(*FRAME, "x", "y", "gray", "c.*")
    order = Window.partitionBy("video_id", "x", "y", "part").orderBy("frame_index")
    value = F.col("gray").cast("long")
    sums = {"n": F.count("gray"), "s": F.sum(value), "ss": F.sum(value * value)}
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    known = parted.withColumns(_sliding(sums, order, -span, -1)).filter(F.col("own") & (n > 0)).withColumns(
        {"mean": s / n, "var": (n * ss - s * s) / (n * n)}
    )
    off = (F.col("gray") - F.col("mean")) * (F.col("gray") - F.col("mean"))
    return known.filter(off > threshold * F.greatest(F.col("var"), F.lit(VAR_FLOOR))).select(*FRAME, "x", "y")


def background_subtraction(
    pixels: DataFrame, min_area: float = MOTION_MIN_AREA, span: int = HISTORY,
    threshold: float = VAR_THRESHOLD, kernel: int = KERNEL,
) -> tuple[DataFrame, DataFrame]:
    """Motion per frame and the moving objects.

    Returns ``video_id, frame_index, motion_ratio, moving`` for every frame, and
    the objects.  Frames keep their own numbers.
    """
    sizes = pixels.groupBy(*FRAME).agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.count(F.lit(1)).alias("pixels")
    )
    mask = foreground(pixels, span, threshold).join(sizes.drop("pixels"), FRAME)
    if kernel > 0:
        mask = opened(mask, FRAME, kernel)
    mask = durable(mask.distinct())
    objects = _as_detections(find_blobs(mask, FRAME, min_area), "motion")
    marked = mask.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("marked"))
    counted = objects.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("moving"))
    per_frame = sizes.join(marked, FRAME, "left").join(counted, FRAME, "left").select(
        *FRAME, (F.coalesce("marked", F.lit(0)) / F.col("pixels")).alias("motion_ratio"),
        F.coalesce("moving", F.lit(0).cast("long")).alias("moving"),
    )
    return per_frame, objects


def _tile_origins(axis: str, size: str, tile: int, step: int):
    """Origins of the clamped tiles that hold a pixel, from its coordinate alone."""
    room = F.greatest(F.lit(0), F.col(size) - tile)
    last = F.ceil(room / step).cast("int")
    low = F.greatest(F.lit(0), F.floor((F.col(axis) - tile) / step).cast("int"))
    high = F.least(last, F.floor(F.col(axis) / step).cast("int"))
    numbers = F.array_union(F.sequence(F.least(low, high), high), F.array(last))
    origins = F.array_distinct(F.transform(numbers, lambda i: F.least(i * step, room)))
    return F.filter(origins, lambda o: (o <= F.col(axis)) & (F.col(axis) < o + tile))


def sliced_detection(
    pixels: DataFrame, tile: tuple[int, int] = (640, 640), overlap: float = 0.2,
    iou_threshold: float = AGNOSTIC_IOU, lower=RED_LOWER, upper=RED_UPPER,
    min_area: float = TILE_MIN_AREA, kernel: int = KERNEL, label: str = "object",
) -> DataFrame:
    """Colour blobs found tile by tile and merged by suppression.

    Only pixels in the colour range are copied to the tiles that hold them.
    """
    step_x, step_y = tile_steps(tile, overlap)
    mask = _sized(colour_mask(pixels, lower, upper), pixels, FRAME)
    placed = (
        mask.withColumn("tile_x", F.explode(_tile_origins("x", "width", tile[0], step_x)))
        .withColumn("tile_y", F.explode(_tile_origins("y", "height", tile[1], step_y)))
    )
    keys = [*FRAME, "tile_x", "tile_y"]
    local = placed.select(
        *keys, (F.col("x") - F.col("tile_x")).alias("x"), (F.col("y") - F.col("tile_y")).alias("y"),
        F.least(F.lit(tile[0]), F.col("width")).alias("width"),
        F.least(F.lit(tile[1]), F.col("height")).alias("height"),
    )
    if kernel > 0:
        local = cleaned(local, keys, kernel)
    blobs = find_blobs(local, keys, min_area)
    ordered = F.struct("tile_y", "tile_x", (-F.col("area")).alias("rank"), "y", "x")
    found = _as_detections(blobs.withColumn("det_seq", ordered), label)
    return suppress(to_frame(found), iou_threshold).drop("det_seq", "tile_x", "tile_y")


def spot_pixels(pixels: DataFrame, spots: DataFrame, cell: int = 32) -> DataFrame:
    """``video_id, frame_index, spot, x, y, gray`` of the pixels inside each spot.

    Spots meet pixels in grid cells.  Spots with a ``video_id`` belong to that video's frames
    alone; others to all frames.
    """
    scope = ["video_id"] if "video_id" in spots.columns else []

    def cells(low: str, extent: str):
        first = F.floor(F.col(low) / cell)
        return F.explode(F.sequence(first, F.greatest(first, F.floor((F.col(low) + F.col(extent) - 1) / cell))))

    areas = spots.select(*scope, "spot", *[F.col(c).alias(f"s{c}") for c in "xywh"])
    placed = areas.withColumn("i", cells("sx", "sw")).withColumn("j", cells("sy", "sh"))
    shaded = with_gray(pixels).select(
        *FRAME, "x", "y", "gray", F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")
    )
    return shaded.join(placed, [*scope, "i", "j"]).filter(
        (F.col("x") >= F.col("sx")) & (F.col("x") < F.col("sx") + F.col("sw"))
        & (F.col("y") >= F.col("sy")) & (F.col("y") < F.col("sy") + F.col("sh"))
    ).select(*FRAME, "spot", "x", "y", "gray")


def for_every_spot(frames: DataFrame, spots: DataFrame, measured: DataFrame) -> DataFrame:
    """``edge_density, mean, std`` for each spot of each frame; zeros where nothing was measured."""
    scope = ["video_id"] if "video_id" in spots.columns else []
    listed = F.collect_set("spot").alias("spots")
    if scope:
        every = frames.select(*FRAME).join(spots.groupBy(*scope).agg(listed), scope)
    else:
        every = frames.select(*FRAME).withColumn("spots", spots.agg(listed).scalar())
    every = every.select(*FRAME, F.explode("spots").alias("spot"))
    zero = F.lit(0.0)
    return every.join(measured, [*FRAME, "spot"], "left").select(
        *FRAME, "spot", *[F.coalesce(n, zero).alias(n) for n in ("edge_density", "mean", "std")]
    )


def spot_features(
    frames: DataFrame, pixels: DataFrame, spots: DataFrame, gradient: int = EDGE_GRADIENT,
    cell: int = 32,
) -> DataFrame:
    """``edge_density, mean, std`` of the gray values inside each spot of each frame.

    A pixel counts as an edge when its gray difference across plus down, inside
    the spot, reaches ``gradient``; ``edges.hysteresis_features`` thins and follows
    edges instead.  A spot without pixels has zeros.
    """
    inside = spot_pixels(pixels, spots, cell)
    across = Window.partitionBy(*FRAME, "spot", "y").orderBy("x")
    down = Window.partitionBy(*FRAME, "spot", "x").orderBy("y")

    def change(order) -> F.Column:
        here = F.col("gray")
        return F.abs(F.coalesce(F.lead("gray").over(order), here) - F.coalesce(F.lag("gray").over(order), here))

    sharp = inside.withColumn("dx", change(across)).withColumn("dy", change(down))
    measured = sharp.groupBy(*FRAME, "spot").agg(
        F.avg((F.col("dx") + F.col("dy") >= gradient).cast("double")).alias("edge_density"),
        F.avg("gray").alias("mean"), F.stddev_pop("gray").alias("std"),
    )
    return for_every_spot(frames, spots, measured)


def _settled(colours: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The centres of one frame and the centre of each of its colours, which come in order."""

    def gaps(centres: np.ndarray) -> np.ndarray:
        apart = colours[:, None, :] - centres
        apart *= apart
        return apart[..., 0] + apart[..., 1] + apart[..., 2]

    centres = colours[np.flatnonzero(n == n.max())[-1:]]
    for _ in range(k - 1):
        far = gaps(centres).min(axis=1) * n
        centres = np.concatenate([centres, colours[np.flatnonzero(far == far.max())[-1:]]])
    while True:
        at = gaps(centres).argmin(axis=1)
        held = np.bincount(at, n, k)
        moved = centres.copy()
        for c in range(3):
            moved[held > 0, c] = (np.bincount(at, colours[:, c] * n, k) / np.maximum(held, 1))[held > 0]
        off = moved - centres
        off *= off
        centres = moved
        if (off[:, 0] + off[:, 1] + off[:, 2] <= SETTLED).all():
            return centres, gaps(centres).argmin(axis=1)


def _frame_colours(colours: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """``dominant_colours`` of frames that each fit in an array, a frame after another, after one shuffle."""
    types = dict(colours.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", rank int, b int, g int, r int, fraction double"
    names = [*keys, "rank", "b", "g", "r", "fraction"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(table: pa.Table, starts: list[int]) -> pa.RecordBatch:
            whole = np.stack([table[c].to_numpy() for c in "bgr"], axis=1)
            n = table["n"].to_numpy().astype(float)
            first, parts = [], []
            for a, b in zip(starts[:-1], starts[1:]):
                centres, at = _settled(whole[a:b], n[a:b], k)
                held = np.bincount(at, n[a:b], k)
                order = np.argsort(-held, kind="stable")
                order = order[held[order] > 0]
                first += [a] * len(order)
                parts.append(np.column_stack([np.arange(1, len(order) + 1), np.rint(centres[order]), held[order] / n[a:b].sum()]))
            made = np.concatenate(parts)
            own = table.select(keys).take(pa.array(first, pa.int64())).combine_chunks()
            return pa.RecordBatch.from_arrays([
                *[own[c].combine_chunks() if own[c].num_chunks != 1 else own[c].chunk(0) for c in keys],
                *[pa.array(made[:, c].astype(np.int32)) for c in range(4)], pa.array(made[:, 4]),
            ], names=names)

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            starts = _starts(held, keys)
            if len(starts) > 1:  # the last frame may go on
                yield solved(held.slice(0, starts[-1]), starts)
                held = pa.concat_tables([held.slice(starts[-1])]).combine_chunks()
        if held is not None:
            yield solved(held, [0, held.num_rows])

    dealt = colours.repartition(*keys).sortWithinPartitions(*keys, "b", "g", "r")
    return dealt.select(*keys, "b", "g", "r", "n").mapInArrow(run, schema)


def _starts(table: pa.Table, keys: list[str]) -> list[int]:
    """The first row of every run of equal keys."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in keys:
        code = table[c].combine_chunks().dictionary_encode("encode")
        code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new).tolist()


def dominant_colours(
    pixels: DataFrame, k: int = 3, keys: list[str] = FRAME
) -> DataFrame:
    """The ``k`` main colours of each frame with the share of pixels nearest to them.

    k-means per frame on its distinct colours, weighted by how often they occur:
    all pixels take part, yet a frame is reduced before its first shuffle.  Starts
    from the commonest colour and those farthest from the ones chosen, so that a
    repeated run gives the same centres; they need not equal another library's.  Rounds
    go on until no centre moves, over the frames that have not settled; equal colours
    always go to the same centre, so every frame settles.

    A frame of at most ``FRAME_COLOURS`` distinct colours is settled in one bounded array;
    larger ones, and those with a missing colour, in rounds of joins.
    """
    colours = durable(
        pixels.groupBy(*keys, *[F.col(c).cast("double").alias(c) for c in "bgr"])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    gone = F.col("b").isNull() | F.col("g").isNull() | F.col("r").isNull()
    odd = durable(
        colours.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(gone).alias("gone"))
        .filter((F.col("n") > FRAME_COLOURS) | F.col("gone")).select(*keys)
    )
    if fits(odd, 0):
        return _frame_colours(colours, k, keys)
    odd = broadcast_if_small(odd)
    ordinary = _frame_colours(colours.join(odd, keys, "left_anti"), k, keys)
    return ordinary.unionByName(_joined_colours(durable(colours.join(odd, keys, "left_semi")), k, keys))


def _joined_colours(colours: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """``dominant_colours`` of frames of any size, in rounds of joins."""
    colour = F.struct("b", "g", "r")

    def gap(a, b):
        return sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "bgr"), F.lit(0.0))

    first = F.max_by(colour, F.struct("n", colour)).alias("first")
    centres = colours.groupBy(*keys).agg(first).select(*keys, F.array("first").alias("centres"))
    for _ in range(k - 1):
        apart = colours.join(centres, keys).withColumn(
            "gap", F.array_min(F.transform("centres", lambda m: gap(m, F.struct("b", "g", "r"))))
        )
        farthest = F.max_by(colour, F.struct(F.col("gap") * F.col("n"), colour)).alias("next")
        centres = (
            apart.groupBy(*keys).agg(F.first("centres").alias("centres"), farthest)
            .select(*keys, F.concat("centres", F.array("next")).alias("centres"))
        )

    def nearest(joined: DataFrame) -> DataFrame:
        gaps = F.transform("centres", lambda m: gap(m, F.struct("b", "g", "r")))
        return joined.withColumn("gaps", gaps).withColumn(
            "at", (F.array_position("gaps", F.array_min("gaps")) - 1).cast("int")
        )

    centres = durable(centres)
    settled = None
    while True:
        assigned = nearest(colours.join(centres, keys))
        means = assigned.groupBy(*keys, "at").agg(
            F.struct(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in "bgr"]).alias("mean")
        )
        gathered = means.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("at", "mean"))).alias("means")
        )
        moved = centres.join(gathered, keys).select(
            *keys, F.col("centres").alias("old"),
            F.transform("centres", lambda m, i: F.coalesce(F.try_element_at("means", i), m)).alias("centres"),
        )
        moved = durable(moved)
        moves = F.zip_with("old", "centres", gap)
        still = F.forall(moves, lambda g: g <= SETTLED)
        done, centres = moved.filter(still).drop("old"), moved.filter(~still).drop("old")
        settled = done if settled is None else settled.unionByName(done)
        if fits(centres, 0):
            break
    centres = settled
    final = nearest(colours.join(centres, keys))
    counts = final.groupBy(*keys, "at").agg(
        F.sum("n").alias("n"), F.first(F.get("centres", F.col("at"))).alias("centre")
    )
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    rank = Window.partitionBy(*keys).orderBy(F.desc("n"), "at")
    return counts.join(totals, keys).select(
        *keys, F.row_number().over(rank).alias("rank"),
        *[F.bround(F.col("centre")[c], 0).cast("int").alias(c) for c in "bgr"],
        (F.col("n") / F.col("total")).alias("fraction"),
    )
