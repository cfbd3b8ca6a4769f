"""Ranking the models of a catalog for many requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.scale import broadcast_if_small

# Fixed weights and the size above which a frame counts as large.
W_CLASSES = 3.0
W_TASK = 1.5
W_ALTITUDE = 1.0
W_RESOLUTION = 1.0
W_SMALL_UNTILED = 0.25
LARGE_FRAME = 1920
#: Scored models, over all distinct requests, that may be broadcast.
BROADCAST_ENTRIES = 1_000_000


def _score(model: Column) -> Column:
    """Coverage of the classes asked for, then task, altitude and resolution."""
    asked = F.col("_want.classes")
    covered = F.size(F.array_intersect(asked, model["capabilities"]))
    coverage = F.when(F.size(asked) > 0, F.lit(W_CLASSES) * (covered / F.size(asked)))
    task = F.when(model["task"] == F.col("_want.task"), F.lit(W_TASK))
    altitude = F.when(model["altitude"].isin(F.col("_want.altitude"), F.lit("any")), F.lit(W_ALTITUDE))
    altitude = F.when(F.col("_want.altitude") != "", altitude)
    large, tiled = F.col("_want.large"), model["tiled"]
    resolution = F.when(large & tiled, F.lit(W_RESOLUTION)).when(
        ~large & ~tiled, F.lit(W_SMALL_UNTILED * W_RESOLUTION)
    )
    zero = F.lit(0.0)
    return (
        F.coalesce(coverage, zero) + F.coalesce(task, zero)
        + F.coalesce(altitude, zero) + F.coalesce(resolution, zero)
    )


def _ranked(requests: DataFrame, catalog: DataFrame, top: int | None = None) -> DataFrame:
    """Each request with the scored catalog as one sorted array.

    Requests that want the same are scored once: their distinct wants are ranked
    and joined back, by a broadcast as long as requests times models stay few.  The
    catalog travels as a single array value.
    """
    models = catalog.agg(
        F.collect_list(
            F.struct(
                "id", F.transform("capabilities", F.lower).alias("capabilities"),
                "task", "altitude", "tiled",
            )
        )
    ).scalar()
    want = F.struct(
        F.array_sort(F.array_distinct(F.transform("classes", F.lower))).alias("classes"),
        F.lower("task").alias("task"), F.lower("altitude").alias("altitude"),
        (F.greatest("width", "height") > LARGE_FRAME).alias("large"),
    )
    wanting = requests.withColumn("_want", want).withColumn("_key", F.to_json("_want"))
    scored = F.transform(
        F.col("_models"), lambda m: F.struct((-_score(m)).alias("cost"), m["id"].alias("id"))
    )
    distinct = wanting.groupBy("_key").agg(F.first("_want").alias("_want"))
    listed = F.array_sort(scored)
    ranked = distinct.withColumn("_models", models).select(
        "_key", (listed if top is None else F.slice(listed, 1, top)).alias("_ranked")
    )
    entries = min(top or catalog.count(), catalog.count())
    few = broadcast_if_small(ranked, max(1, BROADCAST_ENTRIES // max(1, entries)))
    return wanting.drop("_want").join(few, "_key").drop("_key")


def rank_models(requests: DataFrame, catalog: DataFrame, top: int | None = None) -> DataFrame:
    """The ``top`` models, or all, for every request: best score first, equal scores by id.

    Requests have ``classes, task, altitude, width, height``, any of them null.
    """
    keep = requests.columns
    listed = _ranked(requests, catalog, top).select(*keep, F.posexplode("_ranked").alias("rank", "_m"))
    return listed.select(
        *keep, (F.col("rank") + 1).alias("rank"), F.col("_m.id").alias("model_id"),
        (-F.col("_m.cost")).alias("score"),
    )


def select_model(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """The best model for each request; an empty catalog is an error."""
    best = F.get("_ranked", F.lit(0))
    empty = F.raise_error(F.lit("the catalog is empty")).cast("string")
    return _ranked(requests, catalog, 1).select(
        *requests.columns,
        F.when(F.size("_ranked") > 0, best["id"]).otherwise(empty).alias("model_id"),
        (-best["cost"]).alias("score"),
    )
