"""Blobs of marked pixels: clean-up, connected components, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospark.operators.components import connected_components
from aerospark.scale import durable

BUCKET = 16


def frame_sizes(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys).agg(
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height")
    )


def _runs(mask: DataFrame, keys: list[str], line: str, run: str) -> DataFrame:
    """Unbroken runs ``a..b`` along one axis; a pixel may be listed more than once."""
    order = Window.partitionBy(*keys, line).orderBy(run)
    island = mask.withColumn("_island", F.col(run) - F.dense_rank().over(order))
    return island.groupBy(*keys, "width", "height", line, "_island").agg(
        F.min(run).alias("a"), F.max(run).alias("b")
    )


def _pass(mask: DataFrame, keys: list[str], line: str, run: str, grow: int) -> DataFrame:
    """Runs along one axis grown (or, below zero, shrunk) at both ends.

    Outside of the frame nothing is known, so an end at the frame edge stays.
    """
    last = F.col("width" if run == "x" else "height") - 1
    runs = _runs(mask, keys, line, run)
    if grow >= 0:
        a, b = F.greatest(F.lit(0), F.col("a") - grow), F.least(last, F.col("b") + grow)
    else:
        a = F.when(F.col("a") == 0, F.col("a")).otherwise(F.col("a") - grow)
        b = F.when(F.col("b") == last, F.col("b")).otherwise(F.col("b") + grow)
    grown = runs.withColumns({"a": a, "b": b}).filter(F.col("a") <= F.col("b"))
    return grown.select(*keys, "width", "height", line, F.explode(F.sequence("a", "b")).alias(run))


def _across(mask: DataFrame, keys: list[str], grow: int) -> DataFrame:
    return _pass(mask, keys, "y", "x", grow)


def _down(mask: DataFrame, keys: list[str], grow: int) -> DataFrame:
    return _pass(mask, keys, "x", "y", grow)


def opened(mask: DataFrame, keys: list[str], kernel: int) -> DataFrame:
    """Erosion, then dilation, with a square kernel.

    Only marked pixels are carried; every pass works on runs, which are cut by
    frame and line, so a large frame spreads over many tasks.  Passes along the
    same axis follow each other and share a shuffle.
    """
    radius = kernel // 2
    eroded = _across(_down(mask, keys, -radius), keys, -radius)
    return _down(_across(eroded, keys, radius), keys, radius)


def closed(mask: DataFrame, keys: list[str], kernel: int) -> DataFrame:
    radius = kernel // 2
    grown = _across(_down(mask, keys, radius), keys, radius)
    return _down(_across(grown, keys, -radius), keys, -radius)


def cleaned(mask: DataFrame, keys: list[str], kernel: int) -> DataFrame:
    """Opening, then closing.

    The two dilations in the middle are one of twice the reach.  The passes are
    ordered so that the whole takes four shuffles, the last of which also serves
    the runs that blobs are made of.
    """
    radius = kernel // 2
    eroded = _across(_down(mask, keys, -radius), keys, -radius)
    grown = _down(_across(eroded, keys, 2 * radius), keys, 2 * radius)
    return _across(_down(grown, keys, -radius), keys, -radius)


def label_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``runs`` with the ``component`` (8 neighbours) that each belongs to.

    ``runs`` has the keys and the unbroken pixels ``a..b`` of lines ``y``; it is read several
    times.  Runs of neighbouring lines meet in buckets of a few columns, so no run is compared
    with a whole line.
    """
    node = F.struct(*keys, "y", "a")

    def spread(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / BUCKET), F.floor(last / BUCKET)))

    above = runs.select(
        *keys, (F.col("y") + 1).alias("y"), F.col("a").alias("a0"), F.col("b").alias("b0"),
        spread(F.col("a") - 1, F.col("b") + 1).alias("bucket"),
    )
    below = runs.select(*keys, "y", "a", "b", spread(F.col("a"), F.col("b")).alias("bucket"))
    touching = above.join(below, [*keys, "y", "bucket"]).filter(
        (F.col("a0") <= F.col("b") + 1) & (F.col("a") <= F.col("b0") + 1)
    )
    links = touching.select(
        F.struct(*keys, (F.col("y") - 1).alias("y"), F.col("a0").alias("a")).alias("a"),
        node.alias("b"),
    )
    joined = connected_components(runs.select(node.alias("node")), links)
    return runs.withColumn("node", node).join(joined, "node")


def find_blobs(mask: DataFrame, keys: list[str], min_area: float) -> DataFrame:
    """Connected (8-neighbour) blobs of at least ``min_area`` pixels.

    ``mask`` has the keys, ``x, y, width, height``.  Pixels are reduced to runs
    first, and runs are connected.  The area is the number of pixels.
    """
    sized = label_runs(durable(_runs(mask, keys, "y", "x").select(*keys, "y", "a", "b")), keys)
    n = F.col("b") - F.col("a") + 1
    blobs = sized.groupBy(*keys, "component").agg(
        F.sum(n).cast("double").alias("area"),
        F.min("a").alias("x"), F.min("y").alias("y"),
        F.max("b").alias("x2"), F.max("y").alias("y2"),
        (F.sum(n * (F.col("a") + F.col("b")) / 2.0)).alias("sx"), F.sum(n * F.col("y")).alias("sy"),
    )
    return blobs.filter(F.col("area") >= min_area).select(
        *keys, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"),
        (F.col("x2") - F.col("x") + 1).cast("int").alias("w"),
        (F.col("y2") - F.col("y") + 1).cast("int").alias("h"),
        (F.col("sx") / F.col("area")).alias("cx"), (F.col("sy") / F.col("area")).alias("cy"), "area",
    )
