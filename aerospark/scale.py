"""Helpers that keep jobs bounded: size-checked broadcasts, durable cuts, skew-safe order.

Nothing here moves a table through the driver.  The only values that come back
are counts, and those are cut off by a limit inside the job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000


def fits(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has at most ``rows`` rows; the count stops just past the limit."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only for a side whose row count was checked.

    A larger side is returned unhinted, so the join shuffles on its key.
    """
    return F.broadcast(df) if fits(df, rows) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting gets a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    made = tempfile.mkdtemp(prefix="aerospark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a checkpoint that survives the loss of executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table or a streaming checkpoint."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Cut lineage as ``durable`` does, by compressed columns: a third of a checkpoint's disk for wide rows.

    Columns without a type of their own are read back as text; they hold nulls only.
    """
    spark = df.sparkSession
    path = work_path(spark, "staged")
    typed = df.select(*[df[f"`{name}`"].cast("string").alias(name) if kind == "void" else df[f"`{name}`"] for name, kind in df.dtypes])
    typed.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(typed.schema).parquet(path)


@contextmanager
def shuffles_given_back(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes its shuffle files at its end, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def previous_in_order(
    df: DataFrame, keys: list[str], order: str, values: list[str], span: int = 4096
) -> DataFrame:
    """``lag`` that does not sort a whole key in one task.

    ``order`` is an integer column, unique per key.  It is cut into ranges of
    ``span``; lag runs inside a range, and the first row of a range takes the
    last row of the nearest earlier non-empty one from a table that holds one
    row per range.  Adds ``prev_<order>`` and ``prev_<value>``.  Without further columns the
    ranges are dealt out once for both.
    """
    wanted = [order, *values]
    cut = F.floor(F.col(order) / span)
    ranged = df.withColumn("_range", cut)
    if set(df.columns) == {*keys, *wanted}:
        ranged = ranged.repartition(*keys, "_range")
    within = Window.partitionBy(*keys, "_range").orderBy(order)
    lagged = ranged.withColumn("_inside", F.lag(F.struct(*wanted)).over(within))
    tails = ranged.groupBy(*keys, "_range").agg(F.max(F.struct(*wanted)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_range")
    carried = tails.select(*keys, "_range", F.lag("_tail").over(across).alias("_carried"))
    joined = lagged.join(carried, [*keys, "_range"], "left")
    previous = F.coalesce("_inside", "_carried")
    return joined.select(
        *df.columns, *[previous[name].alias(f"prev_{name}") for name in wanted]
    )


def chunk_of(column: Column, rows: int, size: int) -> Column:
    """A stable chunk number for grouping ``rows`` rows into chunks of about ``size``."""
    return F.pmod(F.xxhash64(column), F.lit(max(1, -(-rows // size))))
