"""The inverted file against the exact search."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospark.operators.search import search_frames
from aerospark.operators.vector_index import APART, build_index, indexed_pairs, nearest_cells, open_index, search_index
from aerospark.scale import work_path

DOC = "id string, account_id string, vector array<float>"
ASK = "query_id long, account_id string, vector array<float>"


def groups(n, dims=16, seed=5):
    """Directions around forty centres, dealt over two accounts, one with a third of the other's rows."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, dims))
    points = centres[rng.integers(0, 40, n)] + 0.4 * rng.standard_normal((n, dims))
    return [(f"d{i:05d}", "b" if i % 4 == 0 else "a", p.tolist()) for i, p in enumerate(points)]


@pytest.fixture(scope="module")
def stored(spark):
    docs = spark.createDataFrame(groups(4000), DOC)
    return docs, build_index(docs, work_path(spark, "index"), k=10)


def test_recall_and_exact_scores(spark, stored):
    docs, index = stored
    asked = docs.filter("substr(id, 2) % 50 = 0").selectExpr("cast(substr(id, 2) AS long) AS query_id", "account_id", "vector")
    exact = {(r.query_id, r.id): r.score for r in search_frames(docs, asked, 10).collect()}
    found = {(r.query_id, r.id): r.score for r in search_index(index, asked, 10).collect()}
    assert len(found) == len(exact) == 800
    shared = exact.keys() & found.keys()
    assert len(shared) >= 0.9 * len(exact) and 1 < index.probes < len(index.centres) / 2
    assert all(found[key] == exact[key] for key in shared)
    every = {(r.query_id, r.id, r.rank) for r in search_index(index, asked, 10, probes=len(index.centres)).collect()}
    assert every == {(r.query_id, r.id, r.rank) for r in search_frames(docs, asked, 10).collect()}


def test_every_row_is_stored_and_a_search_reads_few_cells(spark, stored):
    docs, index = stored
    assert index.rows(spark).select("id").distinct().count() == docs.count() == index.rows(spark).count()
    reopened = open_index(spark, index.path)
    assert np.array_equal(reopened.centres, index.centres) and reopened.probes == index.probes and len(index.centres) > 40
    one = docs.limit(1).select(F.lit(1).alias("query_id"), "account_id", "vector")
    pairs = indexed_pairs(reopened, one, probes=2)
    assert pairs.select("cell").distinct().count() <= 2
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(", plan)


def test_odd_vectors_and_small_accounts(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", "a", [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [
        ("zero", "a", [0.0] * 4), ("none", "a", None), ("short", "a", [1.0]), ("empty", "a", []), ("nan", "a", [float("nan")] * 4),
        ("hole", "a", [1.0, None, 0.0, 0.0]), ("same", "b", [1.0, 0.0, 0.0, 0.0]), ("same", "b", [1.0, 0.0, 0.0, 0.0]),
    ]
    docs = spark.createDataFrame(rows, DOC)
    index = build_index(docs, work_path(spark, "index"), cells=6, sample_rows=50)
    cells = {r.id: r.cell for r in docs.select("id", F.element_at(nearest_cells(F.col("vector"), index.centres, 1), 1).alias("cell")).collect()}
    assert {i for i, c in cells.items() if c == APART} == {"zero", "none", "short", "empty", "nan", "hole"}
    assert index.rows(spark).count() == len(rows)
    # a query with no direction, one with a null, and one in an account of two rows get what the exact search gives
    asked = spark.createDataFrame(
        [(1, "a", [0.0] * 4), (2, "a", None), (3, "b", [1.0, 1.0, 0.0, 0.0]), (4, "c", [1.0, 0.0, 0.0, 0.0])], ASK
    )
    key = lambda rows: sorted((r.query_id, r.id, r.rank, str(r.score)) for r in rows)
    assert key(search_index(index, asked, probes=1).collect()) == key(search_frames(docs, asked).collect())


def test_nothing_to_index(spark):
    docs = spark.createDataFrame([], DOC)
    index = build_index(docs, work_path(spark, "index"))
    assert len(index.centres) == 0 and index.rows(spark).isEmpty()
    assert search_index(index, spark.createDataFrame([(1, "a", [1.0])], ASK)).isEmpty()
