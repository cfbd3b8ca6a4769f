"""Edges of gray values: gradient, thinning across the edge, and hysteresis."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from aerospark.operators.blobs import label_runs
from aerospark.operators.pixels import FRAME, _starts, for_every_spot, spot_pixels
from aerospark.scale import broadcast_if_small, durable, fits

#: Fixed thresholds of the routine: a followed edge, and one that starts an edge.
LOW, HIGH = 50, 150
#: Gradients closer than 22.5 degrees to an axis are compared along it, the others along a diagonal.
NEAR_AXIS = math.sqrt(2) - 1
#: Pixels of an image that one task takes at once, and how much larger their frame may be.
IMAGE_PIXELS = 65_536
SPREAD = 16
#: Pixels that a task gets in all.
TASK_PIXELS = 1_000_000


def _beside(value: str, order: WindowSpec, place: str) -> tuple[Column, Column]:
    """``value`` of the neighbours before and after; null where there is no pixel."""
    back, on = F.lag(F.struct(place, value)).over(order), F.lead(F.struct(place, value)).over(order)
    here = F.col(place)
    return F.when(back[place] == here - 1, back[value]), F.when(on[place] == here + 1, on[value])


def thin_edges(shaded: DataFrame, keys: list[str], low: float = LOW, high: float = HIGH) -> DataFrame:
    """``keys, x, y, strong``: pixels at which the gradient is above ``low`` and a crest.

    ``shaded`` has the keys, ``x, y, gray`` and one row a pixel; a group of the keys is one image
    or a part of one.  The gradient is the 3 by 3 Sobel pair, measured as the sum of its two
    sizes.  At a border the border value goes on, and beyond it there is no gradient.  A crest
    is larger than the neighbour before it and, along an axis, at least as large as the one after,
    on a diagonal larger than it too.  ``strong`` tells gradients above ``high``.  A pixel without
    a gray value, or next to one, is no edge.

    One shuffle by image; the windows along lines and columns only sort inside it.
    """
    across, down = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    one = shaded.select(*keys, "x", "y", F.struct(F.col("gray").cast("int").alias("g")).alias("cell"))

    left, right = _beside("cell", across, "x")
    here = F.col("cell")["g"]
    # The cell tells a missing neighbour (border) from one without a value.
    before = F.when(left.isNull(), here).otherwise(left["g"])
    after = F.when(right.isNull(), here).otherwise(right["g"])
    lines = one.repartition(*keys).select(
        *keys, "x", "y",
        F.struct(F.when(here.isNotNull(), after - before).alias("change"), (before + 2 * here + after).alias("level")).alias("line"),
    )
    up, under = _beside("line", down, "y")
    up, under = F.coalesce(up, F.col("line")), F.coalesce(under, F.col("line"))
    sloped = lines.select(
        *keys, "x", "y", (up["change"] + 2 * F.col("line")["change"] + under["change"]).alias("dx"),
        (under["level"] - up["level"]).alias("dy"),
    ).withColumn("m", F.abs("dx") + F.abs("dy"))
    above, below = _beside("m", down, "y")
    columns = sloped.withColumn(
        "column", F.struct(above.alias("above"), F.col("m").alias("level"), below.alias("below"))
    )
    left, right = _beside("column", across, "x")
    beside = columns.select(
        *keys, "x", "y", "dx", "dy", "m", "column", left.alias("left"), right.alias("right")
    )

    def larger(other: Column) -> Column:
        return F.col("m") > F.coalesce(other, F.lit(0))

    def least(other: Column) -> Column:
        return F.col("m") >= F.coalesce(other, F.lit(0))

    flat = F.abs("dy") < F.abs("dx") * NEAR_AXIS
    steep = F.abs("dx") < F.abs("dy") * NEAR_AXIS
    falling = (F.col("dx") < 0) == (F.col("dy") < 0)
    crest = (
        F.when(flat, larger(F.col("left")["level"]) & least(F.col("right")["level"]))
        .when(steep, larger(F.col("column")["above"]) & least(F.col("column")["below"]))
        .when(falling, larger(F.col("left")["above"]) & larger(F.col("right")["below"]))
        .otherwise(larger(F.col("right")["above"]) & larger(F.col("left")["below"]))
    )
    return beside.filter((F.col("m") > low) & crest).select(*keys, "x", "y", (F.col("m") > high).alias("strong"))


def followed_runs(thin: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, y, a, b``: the thin edges that touch, over any number of pixels, a strong one.

    Pixels are reduced to runs of a line; images without a strong pixel go before runs are connected.
    """
    order, image = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys)
    runs = (
        thin.withColumn("_island", F.col("x") - F.row_number().over(order))
        .groupBy(*keys, "y", "_island")
        .agg(F.min("x").alias("a"), F.max("x").alias("b"), F.max("strong").alias("strong"))
        .withColumn("_any", F.max("strong").over(image)).filter("_any")
        .select(*keys, "y", "a", "b", "strong")
    )
    labelled = label_runs(durable(runs), keys)
    kept = labelled.groupBy("component").agg(F.max("strong").alias("_kept")).filter("_kept")
    return labelled.join(kept, "component", "left_semi").select(*keys, "y", "a", "b")


def _count_edges(image: np.ndarray, x: np.ndarray, y: np.ndarray, gray: np.ndarray, known: np.ndarray, low: float, high: float) -> np.ndarray:
    """How many pixels of each image ``thin_edges`` and ``followed_runs`` leave.

    ``image`` numbers the images from 0 and rises.  All lie behind one another in one flat array, each
    with a border of a cell; ``across`` and ``down`` lead from a pixel's cell to its neighbours'.
    """
    first = np.flatnonzero(np.diff(image, prepend=-1))
    x, y = x - np.minimum.reduceat(x, first)[image], y - np.minimum.reduceat(y, first)[image]
    width, height = np.maximum.reduceat(x, first) + 3, np.maximum.reduceat(y, first) + 3
    ends = np.cumsum(width * height)
    across, down = 1, width[image]
    at = (ends - width * height)[image] + (y + 1) * down + x + 1
    there = np.zeros(ends[-1], bool)
    there[at] = True

    def spread(values: np.ndarray) -> np.ndarray:
        cells = np.zeros(len(there), values.dtype)
        cells[at] = values
        return cells

    def beside(values: np.ndarray, step: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``values`` of the neighbours before and after; the own one where there is no pixel."""
        cells = spread(values)
        return tuple(np.where(there[n], cells[n], values) for n in (at - step, at + step))

    before, after = beside(gray, across)
    sure = known & np.logical_and(*beside(known, across))
    change, level = after - before, before + 2 * gray + after
    (up, under), (over, below) = beside(change, down), beside(level, down)
    dx, dy = up + 2 * change + under, below - over
    m = np.where(sure & np.logical_and(*beside(sure, down)), np.abs(dx) + np.abs(dy), 0)

    cells = spread(m)
    above, below = cells[at - down], cells[at + down]
    uppers, lowers = spread(above), spread(below)
    flat = np.abs(dy) < np.abs(dx) * NEAR_AXIS
    steep = np.abs(dx) < np.abs(dy) * NEAR_AXIS
    falling = (dx < 0) == (dy < 0)
    crest = np.select(
        [flat, steep, falling],
        [
            (m > cells[at - 1]) & (m >= cells[at + 1]), (m > above) & (m >= below),
            (m > uppers[at - 1]) & (m > lowers[at + 1]),
        ],
        (m > uppers[at + 1]) & (m > lowers[at - 1]),
    )
    thin = crest & (m > low) & (m > 0)

    # from the strong ones to thin neighbours that were not seen, until there are none
    left, owner = spread(thin), spread(image)
    reached = at[thin & (m > high)]
    counts = np.zeros(len(first), np.int64)
    left[reached] = False
    while len(reached):
        held = owner[reached]
        counts += np.bincount(held, minlength=len(first))
        line = width[held]
        near = np.concatenate([reached + i + j * line for i in (-1, 0, 1) for j in (-1, 0, 1)])
        reached = np.unique(near[left[near]])
        left[reached] = False
    return counts


def _image_edges(shaded: DataFrame, keys: list[str], low: float, high: float, tasks: int) -> DataFrame:
    """``keys, edges``: pixels of followed edges of images that each fit in an array, after one shuffle."""
    types = dict(shaded.dtypes)
    names = [*keys, "edges"]

    def solved(table: pa.Table, starts: list[int]) -> pa.RecordBatch:
        image = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        gray = table["gray"]
        columns = [c.to_numpy().astype(np.int64) for c in (table["x"], table["y"], gray.fill_null(0))]
        counts = _count_edges(image, *columns, gray.is_valid().to_numpy(), low, high)
        own = table.select(keys).take(pa.array(starts[:-1], pa.int64())).combine_chunks()
        return pa.RecordBatch.from_arrays([*[own[c].chunk(0) for c in keys], pa.array(counts)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            starts = _starts(held, keys)
            if len(starts) > 1:  # the last image may go on
                yield solved(held.slice(0, starts[-1]), starts)
                held = pa.concat_tables([held.slice(starts[-1])]).combine_chunks()
        if held is not None:
            yield solved(held, [0, held.num_rows])

    dealt = shaded.select(*keys, "x", "y", F.col("gray").cast("int").alias("gray"))
    dealt = dealt.repartition(tasks, *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", edges long")


def hysteresis_features(
    frames: DataFrame, pixels: DataFrame, spots: DataFrame, low: float = LOW, high: float = HIGH, cell: int = 32,
) -> DataFrame:
    """``edge_density, mean, std`` of the gray values inside each spot of each frame.

    Like ``pixels.spot_features``, but edges are thinned and followed with hysteresis inside the
    spot, which is cut off at the frame's border.  A spot without pixels has zeros.

    Spots of a frame of at most ``IMAGE_PIXELS`` pixels are followed in one bounded array, about
    ``TASK_PIXELS`` pixels a task; larger ones, and those that are mostly gaps, by runs that are connected.
    """
    keys = [*FRAME, "spot"]
    inside = spot_pixels(pixels, spots, cell)
    area = (F.max("x") - F.min("x") + F.lit(3).cast("long")) * (F.max("y") - F.min("y") + F.lit(3).cast("long"))
    shades = durable(inside.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("gray").alias("mean"), F.stddev_pop("gray").alias("std"), area.alias("area")
    ))
    total = shades.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(inside.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_PIXELS))
    odd = shades.filter((F.col("n") > IMAGE_PIXELS) | (F.col("area") > SPREAD * F.col("n"))).select(*keys)
    # images without a key meet no frame
    ordinary = inside.dropna(subset=keys)
    if fits(odd, 0):
        edges = _image_edges(ordinary, keys, low, high, tasks)
    else:
        odd = broadcast_if_small(odd)
        edges = _image_edges(ordinary.join(odd, keys, "left_anti"), keys, low, high, tasks)
        runs = followed_runs(thin_edges(inside.join(odd, keys, "left_semi"), keys, low, high), keys)
        edges = edges.unionByName(runs.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a") + 1).alias("edges")))
    measured = shades.join(edges, keys, "left").select(
        *keys, (F.coalesce("edges", F.lit(0)) / F.col("n")).alias("edge_density"), "mean", "std"
    )
    return for_every_spot(frames, spots, measured)
