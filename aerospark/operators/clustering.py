"""Density clustering of points (DBSCAN) as joins on a grid."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospark.operators.components import connected_components
from aerospark.scale import broadcast_if_small, durable, fits

# Fixed defaults.
EPS = 50.0
MIN_SAMPLES = 5
# A group up to this many points is clustered as one array.
FOLD_POINTS = 256
REACH = range(-2, 3)
# One of each pair of opposite offsets.
FORWARD = [(dx, dy) for dx in REACH for dy in REACH if (dx, dy) > (0, 0)]


def _offsets(pairs) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in pairs])


def _close(ax: Column, ay: Column, bx: Column, by: Column, eps: float) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by) <= eps * eps


def _around(points: DataFrame, keep: list[str]) -> DataFrame:
    """Points repeated for every cell their neighbours may lie in."""
    every = _offsets([(a, b) for a in REACH for b in REACH])
    return points.select(*keep, F.explode(every).alias("o")).withColumns(
        {"i": F.col("i") + F.col("o.dx"), "j": F.col("j") + F.col("o.dy")}
    ).drop("o")


def neighbour_counts(
    points: DataFrame, keys: list[str], eps: float, of: DataFrame | None = None, fold_points: int = FOLD_POINTS,
) -> DataFrame:
    """How many points lie within ``eps`` of each place in ``of``, or of all, itself included.

    ``points`` has ``i, j`` cells, ``x, y`` and ``weight``, one row a place.  The result is one
    row per place.  Where all places are asked for, groups of ordinary size are counted in one
    bounded array.  Larger ones are joined on the grid: pairs exist only between the join and
    its partial aggregate.
    """
    if of is None:
        crowded = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        crowded = crowded.filter(F.col("n") > fold_points).select(*keys)
        if fits(crowded, 0):
            return _folded_counts(points, keys, eps)
        marked = broadcast_if_small(crowded)
        return _folded_counts(points.join(marked, keys, "left_anti"), keys, eps).unionByName(
            _grid_counts(points.join(marked, keys, "left_semi"), keys, eps)
        )
    return _grid_counts(points, keys, eps, of)


def _folded_counts(points: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """Neighbour counts of groups that fit in an array.  Places that are no numbers have none and no row."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "x", "y")])
    gathered = points.filter(known).groupBy(*keys).agg(F.collect_list(F.struct("x", "y", "weight")).alias("all"))

    def near(p: Column) -> Column:
        return F.aggregate(
            "all", F.lit(0).cast("long"),
            lambda n, q: n + F.when(_close(p["x"], p["y"], q["x"], q["y"], eps), q["weight"]).otherwise(0),
        )

    counted = F.transform("all", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), near(p).alias("neighbours")))
    return gathered.select(*keys, F.inline(counted)).filter(F.col("neighbours") > 0)


def _grid_counts(points: DataFrame, keys: list[str], eps: float, of: DataFrame | None = None) -> DataFrame:
    places = points if of is None else of
    near = _around(places.select(*keys, "i", "j", "x", "y"), [*keys, "i", "j", "x", "y"])
    other = points.select(
        *keys, "i", "j", F.col("x").alias("ox"), F.col("y").alias("oy"), "weight"
    )
    return (
        near.join(other, [*keys, "i", "j"])
        .filter(_close(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), eps))
        .groupBy(*keys, "x", "y")
        .agg(F.sum("weight").alias("neighbours"))
    )


def _linked_cells(core: DataFrame, keys: list[str], eps: float) -> DataFrame:
    """Pairs of core cells with two core points within ``eps``.

    First the outermost points of both cells are compared, which settles nearly
    all pairs.  For the rest only facing points matter: the highest per column of
    the lower cell with the lowest per column of the upper one, or likewise per
    row for cells side by side.
    """
    at = F.struct("x", "y")
    cells = core.groupBy(*keys, "i", "j").agg(
        F.array(
            F.max_by(at, F.struct("y", "x")), F.min_by(at, F.struct("y", "x")),
            F.max_by(at, F.struct("x", "y")), F.min_by(at, F.struct("x", "y")),
        ).alias("outer"),
        F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"),
    )
    cells = durable(cells)
    other = cells.select(
        *keys, F.col("i").alias("oi"), F.col("j").alias("oj"),
        *[F.col(c).alias(f"o_{c}") for c in ("outer", "x1", "x2", "y1", "y2")],
    )
    ahead = (
        cells.withColumn("o", F.explode(_offsets(FORWARD)))
        .withColumns({"oi": F.col("i") + F.col("o.dx"), "oj": F.col("j") + F.col("o.dy")})
    )
    paired = ahead.join(other, [*keys, "oi", "oj"])
    gap_x = F.greatest(F.lit(0.0), F.col("o_x1") - F.col("x2"), F.col("x1") - F.col("o_x2"))
    gap_y = F.greatest(F.lit(0.0), F.col("o_y1") - F.col("y2"), F.col("y1") - F.col("o_y2"))
    reachable = paired.filter(gap_x * gap_x + gap_y * gap_y <= eps * eps)
    settled = F.exists(
        "outer",
        lambda a: F.exists("o_outer", lambda b: _close(a["x"], a["y"], b["x"], b["y"], eps)),
    )
    tested = durable(reachable.select(*keys, "i", "j", "oi", "oj", settled.alias("settled")))
    certain = tested.filter("settled").drop("settled")
    open_pairs = tested.filter("NOT settled").drop("settled").withColumn(
        "across", F.col("j") == F.col("oj")
    )

    def facing(across: bool, upper: bool) -> Column:
        """Which end of a line of points faces the other cell."""
        return F.lit("high" if not upper else "low") if across else F.when(
            (F.col("oj") > F.col("j")) != F.lit(upper), "high"
        ).otherwise("low")

    found = []
    for across, line, run in ((False, "x", "y"), (True, "y", "x")):
        ends = core.groupBy(*keys, "i", "j", line).agg(F.max(run).alias("hi"), F.min(run).alias("lo"))
        half = open_pairs.filter(F.col("across") == across)

        def side(i: str, j: str, upper: bool, prefix: str) -> DataFrame:
            end = F.when(facing(across, upper) == "high", F.col("hi")).otherwise(F.col("lo"))
            lines = ends.withColumnsRenamed({"i": i, "j": j})
            joined = half.join(lines, [*keys, i, j])
            return joined.select(
                *keys, "i", "j", "oi", "oj", F.col(line).alias(f"{prefix}{line}"), end.alias(f"{prefix}{run}")
            )

        mine, theirs = side("i", "j", False, "a"), side("oi", "oj", True, "b")
        met = mine.join(theirs, [*keys, "i", "j", "oi", "oj"]).filter(
            _close(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), eps)
        )
        found.append(met.select(*keys, "i", "j", "oi", "oj").distinct())
    return certain.unionByName(found[0]).unionByName(found[1])


def cluster_points(
    points: DataFrame, keys: list[str], ident: str = "det_seq",
    eps: float = EPS, min_samples: int = MIN_SAMPLES, fold_points: int = FOLD_POINTS,
) -> DataFrame:
    """``points`` with ``cluster``: 0, 1, ... inside each key group, -1 for noise.

    Columns ``x, y`` place a point and ``ident`` names it inside its group.  A
    point with at least ``min_samples`` points within ``eps``, itself included,
    is a core point; clusters are chains of core points; any other point within
    ``eps`` of a core point joins the lowest such cluster.  Clusters are numbered
    by their first core point in ``ident`` order.

    Groups of ordinary size, such as frames, are clustered in one bounded array
    after a single shuffle.  Larger ones are solved by joins on a grid.
    """
    crowded = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    crowded = crowded.filter(F.col("n") > fold_points).select(*keys)
    if fits(crowded, 0):
        return _fold_clusters(points, keys, ident, eps, min_samples)
    marked = broadcast_if_small(crowded)
    ordinary = points.join(marked, keys, "left_anti").select(*points.columns)
    large = points.join(marked, keys, "left_semi").select(*points.columns)
    return _fold_clusters(ordinary, keys, ident, eps, min_samples).unionByName(
        _grid_clusters(large, keys, ident, eps, min_samples)
    )


def _fold_clusters(
    points: DataFrame, keys: list[str], ident: str, eps: float, min_samples: int
) -> DataFrame:
    """Clusters of small groups: core points are added one by one to the clusters they touch."""
    rest = [name for name in points.columns if name not in keys]
    ordered = [ident, *[name for name in rest if name != ident]]
    gathered = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("all"))

    def near(a: Column, b: Column) -> Column:
        return _close(a["x"], a["y"], b["x"], b["y"], eps)

    cored = gathered.withColumn(
        "core",
        F.filter("all", lambda p: F.size(F.filter("all", lambda q: near(p, q))) >= min_samples),
    )

    def touches(cluster: Column, point: Column) -> Column:
        return F.exists(cluster, lambda member: near(member, point))

    def add(clusters: Column, point: Column) -> Column:
        apart = F.filter(clusters, lambda c: ~touches(c, point))
        joined = F.flatten(F.filter(clusters, lambda c: touches(c, point)))
        return F.concat(apart, F.array(F.concat(joined, F.array(point))))

    none = F.slice(F.array(F.col("core")), 1, 0)
    formed = cored.withColumn("clusters", F.aggregate("core", none, add))
    # Members compare by ident first, so a cluster's least member leads it.
    numbered = formed.withColumn(
        "clusters",
        F.array_sort(F.transform("clusters", lambda c: F.array_sort(c))),
    )

    def label(point: Column) -> Column:
        hits = F.transform("clusters", lambda c: touches(c, point))
        return (F.array_position(hits, True) - 1).cast("int")

    labelled = numbered.select(
        *keys, F.explode(F.transform("all", lambda p: F.struct(p.alias("p"), label(p).alias("cluster")))).alias("r")
    )
    return labelled.select(*keys, "r.p.*", "r.cluster").select(*points.columns, "cluster")


def _grid_clusters(
    points: DataFrame, keys: list[str], ident: str, eps: float, min_samples: int
) -> DataFrame:
    """Clusters of large groups.

    Points at the same place count as one place with a weight.  Grid cells are
    so small that all points of a cell are neighbours: a cell with
    ``min_samples`` points needs no distances, and components are those of cells.
    """
    side = eps / (math.sqrt(2.0) * (1 + 1e-9))
    places = durable(
        points.groupBy(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("weight"), F.min(ident).alias("first"))
        .withColumns({"i": F.floor(F.col("x") / side), "j": F.floor(F.col("y") / side)})
    )
    filled = places.groupBy(*keys, "i", "j").agg(F.sum("weight").alias("filled"))
    sized = places.join(filled, [*keys, "i", "j"])
    thin = sized.filter(F.col("filled") < min_samples)
    counts = neighbour_counts(places, keys, eps, thin)
    marked = durable(
        sized.join(counts, [*keys, "x", "y"], "left").withColumn(
            "core", (F.col("filled") >= min_samples) | (F.coalesce("neighbours", F.lit(0)) >= min_samples)
        ).drop("filled", "neighbours")
    )
    core = marked.filter("core")
    node = F.struct(*keys, "i", "j")
    links = _linked_cells(core, keys, eps).select(
        node.alias("a"),
        F.struct(*keys, F.col("oi").alias("i"), F.col("oj").alias("j")).alias("b"),
    )
    cells = core.groupBy(*keys, "i", "j").agg(F.min("first").alias("first")).select(
        node.alias("node"), "first"
    )
    joined = connected_components(cells.select("node"), links).join(cells, "node")
    leaders = joined.groupBy("component").agg(F.min("first").alias("leader"))
    numbered = Window.partitionBy(*[f"component.{k}" for k in keys]).orderBy("leader")
    labels = leaders.withColumn("cluster", F.row_number().over(numbered) - 1)
    by_cell = joined.join(labels, "component").select("node.*", "cluster")
    labelled = core.join(by_cell, [*keys, "i", "j"])
    loose = marked.filter("NOT core")
    near = _around(loose, [*keys, "i", "j", "x", "y"])
    anchors = labelled.select(
        *keys, "i", "j", F.col("x").alias("ox"), F.col("y").alias("oy"), "cluster"
    )
    border = (
        near.join(anchors, [*keys, "i", "j"])
        .filter(_close(F.col("x"), F.col("y"), F.col("ox"), F.col("oy"), eps))
        .groupBy(*keys, "x", "y")
        .agg(F.min("cluster").alias("cluster"))
    )
    placed = labelled.select(*keys, "x", "y", "cluster").unionByName(border)
    located = points.withColumns({"_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")})
    found = located.join(placed.withColumnsRenamed({"x": "_x", "y": "_y"}), [*keys, "_x", "_y"], "left")
    return found.select(*points.columns, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def cluster_summary(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Size and mean centre of each cluster; noise left out."""
    return clustered.filter(F.col("cluster") >= 0).groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("size"), F.avg("x").alias("cx"), F.avg("y").alias("cy")
    )


def cluster_totals(clustered: DataFrame, keys: list[str]) -> DataFrame:
    """Points, clusters and noise points per group."""
    return clustered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        (F.max("cluster") + 1).alias("n_clusters"),
        F.count_if(F.col("cluster") == -1).alias("n_noise"),
    )
