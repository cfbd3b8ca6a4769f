"""Similarity search over frame documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospark.scale import broadcast_if_small

TOP_K = 3
MAX_BROADCAST_QUERIES = 2_000


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def normed(rows: DataFrame, *keys: str, name: str) -> DataFrame:
    """``keys``, the vector as ``name`` and its norm."""
    vector = F.col("vector")
    return rows.select(*keys, vector.alias(name), F.sqrt(_dot(vector, vector)).alias(f"{name}_norm"))


def best_of(pairs: DataFrame, k: int) -> DataFrame:
    """``query_id, id, score, rank``: the ``k`` nearest of the documents beside each query."""
    norm = F.col("_doc_norm") * F.col("_query_norm")
    scored = pairs.select(
        "query_id", "id",
        F.when(norm > 0, _dot(F.col("_doc"), F.col("_query")) / norm).otherwise(0.0).alias("score"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search_frames(
    documents: DataFrame, queries: DataFrame, k: int = TOP_K, scope: str = "account_id"
) -> DataFrame:
    """The ``k`` documents nearest to each query by cosine, inside the query's account.

    ``queries`` has ``query_id``, ``vector`` and the scope column.  A checked,
    small query set is broadcast and documents stay where they are; a larger one
    is joined on the scope, where Spark splits a hot account.  Either way each
    task keeps its own best ``k`` per query before anything is shuffled.
    """
    asked = broadcast_if_small(normed(queries, "query_id", scope, name="_query"), MAX_BROADCAST_QUERIES)
    return best_of(normed(documents, "id", scope, name="_doc").join(asked, scope), k)
