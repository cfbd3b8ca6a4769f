"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors form a class and go on as one.  Each table gives a class the signs of
its products with the table's hyperplanes; classes with equal signs meet in a bucket.
A bucket is cut into blocks by hash and each pair of blocks is one group, so a bucket
of any size is compared whole and no group is large.  Within a group the cosines are
one product of matrices, in double precision.  A pair is counted in the first table
that brings it together, and only the links that span a group go on to the components.

The number of hyperplanes grows with the number of vectors, so buckets stay small;
the number of tables follows, so that a pair at the threshold is missed with a chance
of at most ``MISS``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerospark.llm.base import cut, lists
from aerospark.llm.minhash import spanning
from aerospark.operators.components import connected_components
from aerospark.scale import broadcast_if_small

THRESHOLD = 0.95
MISS = 1e-6
#: Vectors that a bucket holds on average.
BUCKET = 384
#: Vectors of a bucket that one group takes from each of its two blocks.
BLOCK = 1024


def shape(vectors: int, threshold: float) -> tuple[int, int]:
    """Hyperplanes of a table and number of tables for so many vectors."""
    planes = min(24, max(4, math.ceil(math.log2(max(2, vectors / BUCKET)))))
    same = 1 - math.acos(threshold) / math.pi
    return planes, math.ceil(math.log(MISS) / math.log(1 - same**planes))


def _classes(table: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Ids of all rows and whether their vectors are usable, and classes of equal vectors."""
    rows = table.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(F.col(vector), lambda x: x + F.lit(0)).alias("vector")
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall("vector", lambda x: x == 0)
    rows = rows.withColumn(
        "vector", F.when(bad | zero | F.col("vec_id").isNull(), F.lit(None)).otherwise(F.col("vector"))
    )
    # a hash stands for the vector from here on; ids may repeat, so a class is not named by one
    rows = rows.withColumn("class", F.xxhash64("vector", F.size("vector")))
    usable = rows.filter(F.col("vector").isNotNull())
    classes = usable.groupBy("class").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector")
    )
    return rows.select("vec_id", "class", F.col("vector").isNotNull().alias("usable")), classes


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def _units(points: np.ndarray) -> np.ndarray:
    points = points / np.abs(points).max(axis=1, keepdims=True)
    return points / np.sqrt((points * points).sum(axis=1, keepdims=True))


def _signs(classes: DataFrame, planes: int, tables: int, seed: int = 3) -> DataFrame:
    """``class, copies, vector, keys``: the signs of a vector in every table."""

    @F.arrow_udf("array<int>")
    def keys_of(column: pa.Array) -> pa.Array:
        sizes = np.array([len(v) for v in column])
        keys: list = [None] * len(sizes)
        for size in np.unique(sizes):
            place = np.flatnonzero(sizes == size)
            unit = _units(_matrix(column.take(pa.array(place)), float))
            normal = np.random.default_rng([seed, int(size)]).standard_normal((int(size), planes * tables))
            bits = (unit @ normal >= 0).reshape(len(unit), tables, planes)
            for at, key in zip(place, (bits @ (1 << np.arange(planes))).astype(np.int32)):
                keys[at] = key
        return lists(keys, pa.int32())

    return classes.select("class", "copies", "vector", keys_of("vector").alias("keys"))


def _bucket_links(signed: DataFrame, threshold: float) -> DataFrame:
    """``class, n_links, other``: links found in a group, and a link that spans it (null: none)."""
    rows = signed.select("class", "copies", "vector", "keys", F.posexplode("keys").alias("table", "key")).withColumn(
        "key", F.col("key") + F.shiftleft(F.size("vector").cast("bigint"), 32)
    )
    sized = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sized.filter(F.col("n") > BLOCK).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).drop("n"))
    placed = rows.join(broadcast_if_small(large), ["table", "key"], "left").fillna(1, ["blocks"])
    spread = placed.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks"))).withColumn(
        "with", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    ).withColumn("i", F.least("mine", "with")).withColumn("j", F.greatest("mine", "with"))
    schema = pa.schema([("class", pa.int64()), ("n_links", pa.int64()), ("other", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("class")
        ids, copies = group["class"].to_numpy(), group["copies"].to_numpy()
        table, mine = group["table"][0].as_py(), group["mine"].to_numpy()
        points, keys = _units(_matrix(group["vector"], float)), _matrix(group["keys"], np.int32)
        linked = points @ points.T >= threshold
        np.fill_diagonal(linked, False)
        if group["i"][0].as_py() != group["j"][0].as_py():
            linked &= mine[:, None] != mine[None, :]
        a, b = np.nonzero(linked)
        # the first table that has the pair together counts it
        first = np.ones(len(a), bool)
        for t in range(table):
            first &= keys[a, t] != keys[b, t]
        n_links = np.bincount(a[first], copies[b[first]], len(ids)).astype(np.int64)
        linked[a[~first], b[~first]] = False
        other = {child: root for root, child in spanning(linked, ids)}
        keep = np.flatnonzero(n_links > 0)
        return pa.Table.from_arrays([
            pa.array(ids[keep]), pa.array(n_links[keep]), pa.array([other.get(c) for c in ids[keep].tolist()], pa.int64()),
        ], schema=schema)

    return spread.select("class", "copies", "vector", "keys", "table", "key", "mine", "i", "j").groupBy(
        "table", "key", "i", "j"
    ).applyInArrow(compare, "class bigint, n_links bigint, other bigint")


def near_vectors(
    table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``table``.

    Vectors with a cosine of at least ``threshold``, in double precision, are linked;
    ``n_links`` counts the other rows linked directly, equal vectors too.  ``component_id`` is
    the least id reachable, and ``kept`` tells whether it is the row's own.  A vector that is
    null, empty, zero, or holds a null or non-finite component links with nothing, and so does
    a row with a null id, whose component is null and which is kept.  Vectors of different
    lengths are not compared.  Rows that repeat an id are rows of their own, each with the links
    of its own vector, so every row of ``table`` gives one row.
    """
    rows, classes = _classes(table, vec_id, vector)
    classes = cut(classes)
    planes, tables = shape(classes.count(), threshold)
    signed = cut(_signs(classes, planes, tables))
    found = cut(_bucket_links(signed, threshold))
    counted = found.groupBy("class").agg(F.sum("n_links").alias("n_links"))
    edges = found.filter(F.col("other").isNotNull()).select(F.col("other").alias("a"), F.col("class").alias("b"))
    grouped = connected_components(classes.select(F.col("class").alias("node")), edges, cut)
    named = cut(grouped.select(F.col("node").alias("class"), "component").join(classes, "class").select(
        "class", "component", "least", "copies"
    ))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    about = named.join(counted, "class", "left").join(least, "component").select(
        "class", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    # a vector that a third of the rows share meets one row of its class here
    out = rows.join(about, "class", "left")
    n_links = F.when(F.col("usable"), F.col("n_links")).otherwise(F.lit(0)).cast("bigint")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
