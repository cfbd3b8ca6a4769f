"""Tile grids over frames, and detections moved between tile and frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_steps(tile: tuple[int, int], overlap: float) -> tuple[int, int]:
    """How far apart tiles begin that share ``overlap`` of their width and height."""
    if overlap < 0 or overlap >= 1:
        raise ValueError(f"tiles share a part of them from 0 up to but not including 1, not {overlap}")
    return max(1, int(tile[0] * (1 - overlap))), max(1, int(tile[1] * (1 - overlap)))


def _cross(xs: Column, ys: Column) -> Column:
    """All origins of one frame, row by row."""
    return F.flatten(
        F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y"))))
    )


def _tiles(frames: DataFrame, xs: Column, ys: Column, tile: tuple[int, int]) -> DataFrame:
    origins = frames.select("*", F.posexplode(_cross(xs, ys)).alias("tile_seq", "origin"))
    x, y = F.col("origin.x"), F.col("origin.y")
    return origins.select(
        *frames.columns, "tile_seq", x.alias("tile_x"), y.alias("tile_y"),
        (F.least(x + tile[0], F.col("width")) - x).alias("tile_w"),
        (F.least(y + tile[1], F.col("height")) - y).alias("tile_h"),
    )


def clamped_tiles(
    frames: DataFrame, tile: tuple[int, int] = (640, 640), overlap: float = 0.2
) -> DataFrame:
    """Overlapping tiles whose last row and column are moved back inside the frame."""

    def origins(size: str, extent: int, step: int) -> Column:
        room = F.greatest(F.lit(0), F.col(size) - extent)
        last = F.ceil(room / step).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.least(i * step, room))

    step_x, step_y = tile_steps(tile, overlap)
    return _tiles(
        frames, origins("width", tile[0], step_x), origins("height", tile[1], step_y), tile
    )


def ragged_tiles(
    frames: DataFrame, tile: tuple[int, int] = (640, 640), overlap: float = 0.2
) -> DataFrame:
    """Overlapping tiles on a fixed step; the last ones are cut off at the frame edge."""

    def origins(size: str, step: int) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.lit(1), F.col(size) - 1) - 1, F.lit(step))

    step_x, step_y = tile_steps(tile, overlap)
    return _tiles(frames, origins("width", step_x), origins("height", step_y), tile)


def to_frame(detections: DataFrame) -> DataFrame:
    """Tile-local boxes and centres moved by their tile's origin."""
    moved = {
        "x": F.col("x") + F.col("tile_x"), "y": F.col("y") + F.col("tile_y"),
        "cx": F.col("cx") + F.col("tile_x"), "cy": F.col("cy") + F.col("tile_y"),
    }
    return detections.withColumns(moved)
