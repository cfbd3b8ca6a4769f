"""Events as OpenTelemetry records, and as request payloads of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.functions import otlp
from aerospark.scale import chunk_of

SIGNALS = ("logs", "metrics", "traces")
METRIC_PREFIX = "commentary."
SERVICE_NAME = "aerospark"
SCOPE_NAME = "aerospark.events"
CHUNK_EVENTS = 200
#: Events whose requests a task builds, far fewer than would make it sort on disk.
TASK_EVENTS = 65_536
#: Columns that requests are made of.
EVENT_COLUMNS = (
    "event_id", "trace_id", "span_id", "parent_span_id", "correlation_key", "timestamp", "source", "video_id", "analysis_id",
    "frame_index", "segment_start", "segment_end", "commentary", "attributes", "metadata", "metrics",
)
#: Holds the attributes that all signals share, as JSON text.
SHARED = "_signal_attributes"
#: Stands for them in a record, and in its text; quotes within a value are escaped, so no value looks like it.
MARK = "@"
MARKED = f'"attributes":"{MARK}"'


def with_shared_attributes(events: DataFrame) -> DataFrame:
    """Events with the text of the list every signal needs instead of what only the list is made of, so
    that several signals build it once."""
    shared = F.to_json(otlp.signal_attributes())
    return events.withColumn(SHARED, shared).drop("attributes", "metadata", "correlation_key")


def flat_log_records(events: DataFrame) -> DataFrame:
    return events.select("event_id", otlp.flat_log_record().alias("record"))


def log_records(events: DataFrame) -> DataFrame:
    return events.select("event_id", otlp.log_record().alias("record"))


def spans(events: DataFrame) -> DataFrame:
    return events.select("event_id", otlp.span().alias("record"))


def _points(events: DataFrame, prefix: str, attributes: Column, *more: str) -> DataFrame:
    shared = events.select(
        "event_id", "metrics", *more, otlp.unix_nanos().alias("nanos"), attributes.alias("shared"),
    )
    points = shared.select("*", F.explode("metrics").alias("metric", "value"))
    return points.filter(F.col("value").isNotNull()).select(
        "event_id", F.concat(F.lit(prefix), F.col("metric")).alias("name"),
        otlp.data_point(F.col("value"), F.col("nanos"), F.col("shared")).alias("record"), *more,
    )


def gauge_points(events: DataFrame, prefix: str = METRIC_PREFIX) -> DataFrame:
    """One raw point per event and metric, named ``<prefix><metric>``.

    The attribute list is built once per event, below the explode.
    """
    return _points(events, prefix, otlp.signal_attributes())


def _resource(service: str) -> Column:
    value = F.struct(F.lit(service).alias("stringValue"))
    entry = F.struct(F.lit("service.name").alias("key"), value.alias("value"))
    return F.struct(F.array(entry).alias("attributes"))


def _open(text: Column) -> Column:
    """The text of an object that goes on."""
    return F.regexp_replace(text, r"\}$", "")


def _request(outer: str, scoped: str, inner: str, service: str, scope: str) -> Column:
    """The request around the JSON texts of its records."""
    head = F.to_json(F.struct(_resource(service).alias("resource")))
    body = F.to_json(F.struct(F.struct(F.lit(scope).alias("name")).alias("scope")))
    return F.concat(
        F.lit(f'{{"{outer}":['), _open(head), F.lit(f',"{scoped}":['), _open(body), F.lit(f',"{inner}":['),
        F.array_join("records", ","), F.lit("]}]}]}"),
    )


def request_payloads(
    events: DataFrame, signal: str, rows: int, chunk: int = CHUNK_EVENTS,
    service: str = SERVICE_NAME, scope: str = SCOPE_NAME, prefix: str = METRIC_PREFIX,
) -> DataFrame:
    """Export requests of about ``chunk`` events each; ``rows`` is the number of events.

    Which chunk an event joins follows from its id, so a repeated task builds the
    same requests, and no source, trace or metric name gathers in one of them.
    Records are dealt out as JSON texts, and gathered only behind the shuffle, in tasks of
    about ``TASK_EVENTS`` events: what a task gathers before it would be sorted on its disk.
    Points of a metric are merged under one definition inside their request.
    """
    if signal not in SIGNALS:
        raise ValueError(f"unknown signal {signal!r}; one of {SIGNALS}")
    if SHARED not in events.columns:
        events = with_shared_attributes(events)
    number = chunk_of(F.col("event_id"), rows, chunk).alias("chunk")
    text = F.replace(F.to_json("record"), F.lit(MARKED), F.concat(F.lit('"attributes":'), F.col(SHARED)))
    tasks = max(min(events.sparkSession.sparkContext.defaultParallelism, -(-rows // chunk)), -(-rows // TASK_EVENTS), 1)
    if signal == "metrics":
        points = _points(events, prefix, F.lit(MARK), SHARED).select(number, "name", text.alias("record"))
        definition = F.to_json(F.struct("name", F.lit("1").alias("unit")))
        gathered = (
            points.repartition(tasks, "chunk").groupBy("chunk", "name").agg(F.collect_list("record").alias("points"))
            .select("chunk", F.concat(
                _open(definition), F.lit(',"gauge":{"dataPoints":['), F.array_join("points", ","), F.lit("]}}")
            ).alias("record"))
            .groupBy("chunk").agg(F.collect_list("record").alias("records"))
        )
    else:
        record = otlp.log_record(F.lit(MARK)) if signal == "logs" else otlp.span(F.lit(MARK))
        texts = events.select("event_id", SHARED, record.alias("record")).select(number, text.alias("record"))
        gathered = texts.repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list("record").alias("records"))
    names = {
        "logs": ("resourceLogs", "scopeLogs", "logRecords"),
        "metrics": ("resourceMetrics", "scopeMetrics", "metrics"),
        "traces": ("resourceSpans", "scopeSpans", "spans"),
    }[signal]
    return gathered.select("chunk", _request(*names, service, scope).alias("value"))
