"""Reading and writing the frame, track, feature and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aerospark.schemas import TRACK_ITEMS

FRAME_KEYS = ["video_id", "frame_index"]


def read_files(
    spark: SparkSession, path: str, fmt: str = "json", schema: str | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Files of one format; JSON may hold one document per file or one per line.

    A schema spares the pass over all files that inferring one takes.
    """
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if fmt == "json":
        reader = reader.option("multiLine", str(multiline).lower())
    return reader.load(path)


def ingest(
    spark: SparkSession, path: str, table: str, fmt: str = "json", mode: str = "append",
    multiline: bool = True, schema: str | None = None, table_format: str = "parquet",
    incremental: bool = False, checkpoint_location: str | None = None,
    location: str | None = None,
) -> DataFrame | StreamingQuery:
    """Files into a table: at once, or as a stream that picks up new files.

    The stream needs a checkpoint and, like every file stream, a schema.
    ``location`` places the table's files in a folder of its own.
    """
    placed = {"path": location} if location else {}
    if incremental:
        from aerospark.streaming.inference import file_stream

        if not checkpoint_location:
            raise ValueError("incremental ingest needs a checkpoint_location")
        stream = file_stream(spark, path, schema, fmt, multiline=multiline)
        return (
            stream.writeStream.format(table_format).options(**placed)
            .option("checkpointLocation", checkpoint_location)
            .trigger(availableNow=True)
            .toTable(table)
        )
    source = read_files(spark, path, fmt, schema, multiline)
    source.write.format(table_format).mode(mode).options(**placed).saveAsTable(table)
    return source


def prepare_context(
    spark: SparkSession, table: str, where: str | None = None, limit: int | None = None
) -> DataFrame:
    """Rows of a context table, by predicate and row cap."""
    rows = spark.read.table(table)
    if where:
        rows = rows.filter(where)
    return rows if limit is None else rows.limit(int(limit))


def write_results(
    results: DataFrame, table: str | None = None, path: str | None = None,
    mode: str = "append", fmt: str = "parquet",
) -> None:
    """Results to a path or a table; with both given the path is used."""
    writer = results.write.format(fmt).mode(mode)
    if path:
        writer.save(path)
    elif table:
        writer.saveAsTable(table)


def join_frame_tables(
    frames: DataFrame, tracks: DataFrame, features: DataFrame, keys: list[str] = FRAME_KEYS
) -> DataFrame:
    """Frames with their tracks and features.

    All three are joined on the same keys, so one shuffle of each serves both joins.
    """
    return frames.join(tracks, keys, "left").join(features, keys, "left")


def explode_tracks(tracks: DataFrame) -> DataFrame:
    """One row per track of a ``tracks`` column, JSON text or a native list."""
    items = F.col("tracks")
    if dict(tracks.dtypes)["tracks"] == "string":
        items = F.from_json("tracks", TRACK_ITEMS)
    rows = tracks.select(*FRAME_KEYS, F.explode(items).alias("t"))
    return rows.select(
        *FRAME_KEYS, F.col("t.id").alias("id"), F.col("t.label").alias("label"),
        *[F.col("t.bbox")[i].alias(n) for i, n in enumerate("xywh")],
        F.col("t.velocity")[0].alias("vx"), F.col("t.velocity")[1].alias("vy"),
    )


def precompute_features(tracks: DataFrame, keys: list[str] = FRAME_KEYS) -> DataFrame:
    """Mean speed and number of objects per frame, from one row per track.

    The rounding to two decimals follows the sample rows of the feature table.
    """
    speed = F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))
    return tracks.groupBy(*keys).agg(
        F.round(F.avg(speed), 2).alias("mean_speed"), F.count(F.lit(1)).alias("object_count")
    )
