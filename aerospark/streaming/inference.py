"""File streams, streaming inference and streaming event storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from aerospark.operators.inference import run_inference
from aerospark.sources.sinks import EventTableSink


def file_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "json",
    max_files_per_trigger: int | None = None, multiline: bool = True, glob: str | None = None,
) -> DataFrame:
    """New files of a folder as a stream; a cap on files per batch holds it back."""
    if not schema:
        raise ValueError("a file stream needs a schema")
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "json":
        reader = reader.option("multiLine", str(multiline).lower())
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str,
           available_now: bool, await_termination: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    query = writer.start()
    if await_termination:
        query.awaitTermination()
    return query


def stream_inference(
    rows: DataFrame, model: str, make_client: Callable[[], object], checkpoint_location: str,
    output_path: str, include_frames: bool = True, available_now: bool = False,
    await_termination: bool = False,
) -> StreamingQuery:
    """Run a model over a stream of context rows and append its results.

    Every micro-batch takes the batch path.  It writes its own folder
    ``batch_id=N`` and replaces it when the batch is run again after a failure,
    so a repeated batch leaves no duplicates.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        results = run_inference(batch, model, make_client, include_frames)
        results.write.mode("overwrite").parquet(f"{output_path}/batch_id={batch_id}")

    return _start(rows, work, checkpoint_location, available_now, await_termination)


def stream_events(
    events: DataFrame, path: str, checkpoint_location: str, delay: str | None = None,
    available_now: bool = False, await_termination: bool = False,
) -> StreamingQuery:
    """Store a stream of events, each id once.

    Ids are compared with the stored table in every batch.  When copies arrive
    within a known delay, that bound lets the stream drop them from its own state.
    """
    if delay:
        events = events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["event_id"])
    sink = EventTableSink(path)

    def work(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sink.emit_many(batch)

    return _start(events, work, checkpoint_location, available_now, await_termination)
