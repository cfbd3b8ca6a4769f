"""Frame documents: built from descriptions, stored by session, counted by facet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerospark.functions import text
from aerospark.functions.events import echo_completion

# Fixed defaults of a document.
DEFAULT_BOX = "0,0,1280,720"
DIMENSIONS = 1536
FACETS = ("account_id", "user", "session", "labels", "tags")


def _or(columns: list[str], name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in columns else default


def build_documents(frames: DataFrame) -> DataFrame:
    """Documents from ``account_id, frame_number, vector, description, path``.

    Every other field of a document is taken when the table has it.
    """
    columns, blank = frames.columns, F.lit("")
    none = F.array().cast("array<string>")
    return frames.select(
        F.format_string("%s-%04d", F.col("account_id").cast("string"), "frame_number").alias("id"),
        F.col("account_id").cast("string").alias("account_id"),
        F.col("frame_number").cast("long").alias("frame_number"),
        "vector",
        text.caption(_or(columns, "caption", blank), F.col("description")).alias("caption"),
        "description",
        _or(columns, "labels", none).alias("labels"),
        _or(columns, "tags", none).alias("tags"),
        _or(columns, "objects", blank).alias("objects"),
        _or(columns, "boundingbox", F.lit(DEFAULT_BOX)).alias("boundingbox"),
        _or(columns, "geotags", blank).alias("geotags"),
        "path",
        _or(columns, "user", blank).cast("string").alias("user"),
        _or(columns, "session", blank).cast("string").alias("session"),
        F.localtimestamp().alias("created"),
    )


def index_frames(frames: DataFrame, dims: int = DIMENSIONS, complete=echo_completion) -> DataFrame:
    """Describe, annotate and embed frames in one plan without a shuffle.

    ``frames`` has ``session, user, frame_id, description, path``.  A frame
    without a description cannot be indexed and is left out.
    """
    described = frames.filter(F.col("description").isNotNull())
    prompt = F.concat(F.lit("Caption this aerial drone frame: "), F.col("description"))
    fallback = F.substring(F.concat(F.lit("aerial frame: "), F.col("description")), 1, text.CAPTION_CHARS)
    annotated = described.withColumn("caption", F.coalesce(complete(prompt), fallback)).withColumn(
        "tags", text.tags(F.col("description"))
    )
    words = F.concat(F.col("caption"), F.lit(" "), F.col("description"))
    return annotated.select(
        F.concat(text.slug(F.col("session")), F.lit("-"), F.col("frame_id").cast("string")).alias("id"),
        text.embedding(words, dims).alias("vector"),
        "caption", text.labels(F.col("tags")).alias("labels"), "tags",
        F.col("user").cast("string").alias("user"), F.col("session").cast("string").alias("session"),
        text.blob_path(F.col("session"), F.col("path")).alias("path"),
        F.localtimestamp().alias("created"),
    )


def index_counts(frames: DataFrame) -> DataFrame:
    """Frames offered and frames indexed, per session."""
    return frames.groupBy("session").agg(
        F.count(F.lit(1)).alias("frames"), F.count("description").alias("indexed")
    )


def store_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Write documents in one folder per session, from where each task has them."""
    documents.write.mode(mode).partitionBy("session").parquet(path)


def session_documents(spark: SparkSession, path: str, session: str, user: str | None = None) -> DataFrame:
    """The documents of one session: a partition filter, other sessions are not read."""
    found = spark.read.parquet(path).filter(F.col("session") == session)
    return found if user is None else found.filter(F.col("user") == user)


def facet_counts(documents: DataFrame, facets: tuple[str, ...] = FACETS) -> DataFrame:
    """Documents per value of each facet, lists counted by element."""
    present = [name for name in facets if name in documents.columns]

    def pairs_of(name: str) -> Column:
        listed = documents.schema[name].dataType.typeName() == "array"
        values = F.col(name) if listed else F.array(F.col(name).cast("string"))
        return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    values = [pairs_of(name) for name in present]
    pairs = documents.select(F.explode(F.concat(*values)).alias("_pair"))
    return pairs.groupBy("_pair.facet", "_pair.value").agg(F.count(F.lit(1)).alias("documents"))
