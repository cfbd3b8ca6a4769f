"""Connected components of large edge sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospark.scale import durable


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")
    ).first()
    return row["n"], row["h"]


def connected_components(
    nodes: DataFrame, edges: DataFrame, cut: Callable[[DataFrame], DataFrame] = durable
) -> DataFrame:
    """``node, component`` for every node; the component is its least node.

    ``nodes`` has ``node``, ``edges`` has ``a, b``; nodes may be of any ordered
    type, structs too.  Alternates the large-star and small-star steps: each
    joins edges with one minimum per node, so a hub is split by the skew join and
    is never gathered, and the number of rounds is logarithmic in practice.  Each
    round ends in a checkpoint, which cuts lineage and survives lost executors;
    ``cut`` is another way to cut it, such as a written table.
    """
    current = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    seen = _fingerprint(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.filter(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(lowest, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        linked = small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        current = cut(linked)
        now = _fingerprint(current)
        if now == seen:
            break
        seen = now
    return nodes.join(current, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("v", "node").alias("component")
    )
