"""An inverted file over frame vectors: rows stored by cell, queries look into the nearest cells.

The cells are the centres that Spark's k-means finds on a bounded sample of directions.
Every row is stored under its nearest centre, so a search reads the folders of the cells it
looks into and no others.  The exact search stays in ``search``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from aerospark.operators.search import MAX_BROADCAST_QUERIES, TOP_K, best_of, normed, search_frames
from aerospark.scale import broadcast_if_small, durable

# Rows that the cells are fitted on, and the most cells that are made of them.
SAMPLE_ROWS = 20_000
MAX_CELLS = 512
# Rows of the sample that the number of cells to look into is measured with, and the share of
# their nearest rows that it has to find there.
TRIALS = 256
RECALL = 0.95
# The cell of rows that have no direction or another length; every query looks into it.
APART = -1


@dataclass(frozen=True)
class VectorIndex:
    """Where the rows are stored by cell, their schema as JSON, the centres, one a row, and how
    many cells a query has to look into."""

    path: str
    schema: str
    centres: np.ndarray
    probes: int

    def rows(self, spark: SparkSession) -> DataFrame:
        schema = StructType.fromJson(json.loads(self.schema))
        return spark.read.schema(schema).parquet(f"{self.path}/rows")


def nearest_cells(vector: Column, centres: np.ndarray, n: int) -> Column:
    """The ``n`` cells nearest to a vector by angle, nearest first; ``[APART]`` if it has no place."""

    @F.arrow_udf("array<int>")
    def nearest(column: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        right = np.flatnonzero(sizes == (centres.shape[1] if len(centres) else -1))
        flat = column.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        points = flat.reshape(len(right), -1) if len(right) else np.zeros((0, 1))
        norms = np.sqrt((points * points).sum(axis=1))
        usable = np.isfinite(norms) & (norms > 0)
        found: list[list[int]] = [[APART]] * len(sizes)
        if usable.any():
            near = (points[usable] / norms[usable, None]) @ centres.T
            for at, cells in zip(right[usable], np.argsort(-near, axis=1, kind="stable")[:, :n]):
                found[at] = cells.tolist()
        return pa.array(found, pa.list_(pa.int32()))

    return nearest(vector)


def draw_sample(documents: DataFrame, scope: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``scope, features``: unit vectors of the rows of least hash, so repeated runs take the same.

    Only vectors of the commonest length with a direction are taken.
    """
    vector = F.transform("vector", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))
    usable = documents.select("id", F.col(scope).alias("scope"), vector.alias("vector"), norm.alias("norm")).filter(
        (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    )
    length = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    drawn = usable.filter(F.size("vector") == (length["size"] if length else 0))
    return durable(drawn.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select(
        "scope", F.transform("vector", lambda x: x / F.col("norm")).alias("vector")
    ))


def fit_cells(sample: DataFrame, cells: int | None = None, seed: int = 1) -> np.ndarray:
    """Unit centres of ``cells`` cells (the root of the sample's rows if not given).

    Fewer than two cells are none: every row is then apart.
    """
    if cells is None:
        cells = min(MAX_CELLS, round(sample.count() ** 0.5))
    if cells < 2:
        return np.zeros((0, 0))
    features = sample.select(array_to_vector("vector").alias("features"))
    found = np.array(KMeans(k=cells, seed=seed, maxIter=15).fit(features).clusterCenters())
    norms = np.sqrt((found * found).sum(axis=1, keepdims=True))
    return found / np.where(norms > 0, norms, 1)


def measured_probes(sample: DataFrame, centres: np.ndarray, k: int, recall: float, trials: int = TRIALS) -> int:
    """Cells that hold ``recall`` of the ``k`` rows nearest to some rows of the sample, in their scope.

    Rows equal to a trial row are not counted.  The sample is thinner than the table, so its
    nearest rows lie further off and the number errs on the side of too many cells.
    """
    drawn = sample.orderBy(F.xxhash64("vector", F.lit(7))).limit(trials).collect()
    if not drawn or not len(centres):
        return 1
    asked = np.array([r.vector for r in drawn])
    scopes = np.array([str(r.scope) for r in drawn])
    # the place of every cell in the order of every trial row
    places = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)

    def nearest(batches):
        for batch in batches:
            points = np.array(batch["vector"].to_pylist())
            if not len(points):
                continue
            own = np.array([str(v) for v in batch["scope"].to_pylist()])
            near = asked @ points.T
            near[(near > 1 - 1e-9) | (scopes[:, None] != own[None, :])] = -2
            cells = np.argmax(points @ centres.T, axis=1)
            best = np.argsort(-near, axis=1, kind="stable")[:, :k]
            trial = np.repeat(np.arange(len(asked)), best.shape[1])
            best = best.ravel()
            some = near[trial, best] > -2
            trial, best = trial[some], best[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(trial), pa.array(near[trial, best]), pa.array(places[trial, cells[best]])],
                names=["trial", "score", "place"],
            )

    order = Window.partitionBy("trial").orderBy(F.desc("score"), "place")
    counts = sample.mapInArrow(nearest, "trial long, score double, place long").withColumn(
        "rank", F.row_number().over(order)
    ).filter(F.col("rank") <= k).groupBy("place").count().orderBy("place").collect()
    wanted = recall * sum(r["count"] for r in counts)
    found = 0
    for r in counts:
        found += r["count"]
        if found >= wanted:
            return r.place + 1
    return len(centres)


def build_index(
    documents: DataFrame, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS,
    scope: str = "account_id", k: int = TOP_K, recall: float = RECALL,
) -> VectorIndex:
    """Store every row of ``documents`` (``id, vector`` and others) under its cell in ``path``.

    The cells are fitted on a sample of ``sample_rows``, on which is also measured how many cells
    a search for ``k`` rows needs for ``recall``.  Rows of a cell are brought together by a rebalancing shuffle, in which Spark splits a cell
    that holds too much for one task.
    """
    spark = documents.sparkSession
    sample = draw_sample(documents, scope, sample_rows)
    centres = fit_cells(sample, cells)
    probes = measured_probes(sample, centres, k, recall)
    placed = documents.withColumn("cell", F.element_at(nearest_cells(F.col("vector"), centres, 1), 1))
    together = spark.sql("SELECT /*+ REBALANCE(cell) */ * FROM {placed}", placed=placed)
    together.write.partitionBy("cell").parquet(f"{path}/rows")
    about = [(placed.schema.json(), centres.tolist(), probes)]
    spark.createDataFrame(about, "schema string, centres array<array<double>>, probes int").coalesce(1).write.parquet(f"{path}/about")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """An index that was stored before."""
    about = spark.read.parquet(f"{path}/about").first()
    centres = np.array(about.centres) if about.centres else np.zeros((0, 0))
    return VectorIndex(path, about.schema, centres, about.probes)


def indexed_pairs(
    index: VectorIndex, queries: DataFrame, probes: int | None = None, scope: str = "account_id"
) -> DataFrame:
    """Stored rows beside the queries of their scope that look into their cell.

    A checked, small query set is broadcast.  Only the folders of the cells that some query looks
    into are read; their numbers, of which there are few, are part of the plan.
    """
    probes = probes or index.probes
    looks = F.array_union(nearest_cells(F.col("vector"), index.centres, probes), F.array(F.lit(APART)))
    asked = durable(normed(queries.withColumn("cell", F.explode(looks)), "query_id", scope, "cell", name="_query"))
    cells = [r.cell for r in asked.select("cell").distinct().collect()]
    stored = index.rows(queries.sparkSession).filter(F.col("cell").isin(cells))
    near = normed(stored, "id", scope, "cell", name="_doc")
    return near.join(broadcast_if_small(asked, MAX_BROADCAST_QUERIES * (probes + 1)), [scope, "cell"])


def search_index(
    index: VectorIndex, queries: DataFrame, k: int = TOP_K, probes: int | None = None, scope: str = "account_id"
) -> DataFrame:
    """``query_id, id, score, rank`` as ``search_frames`` gives them, from the nearest cells.

    ``queries`` has ``query_id``, one row each, ``vector`` and the scope column.  ``probes`` cells
    are looked into, or as many as the index measured.  Scores are exact; a near document in a cell not looked into is missed.  A query without a direction, or
    one that finds fewer than ``k`` documents in its cells, is answered by the exact search, so no
    query gets less than its account has.
    """
    has_place = F.element_at(nearest_cells(F.col("vector"), index.centres, 1), 1) != APART
    found = durable(best_of(indexed_pairs(index, queries.filter(has_place), probes, scope), k))
    whole = found.filter(F.col("rank") == k).select("query_id")
    short = durable(queries.join(whole, "query_id", "left_anti"))
    if short.isEmpty():
        return found
    rest = search_frames(index.rows(queries.sparkSession), short, k, scope)
    return found.join(short.select("query_id"), "query_id", "left_anti").unionByName(rest)
