"""Queries that move data: ingest, inference, sinks and streams over the given tables.

Each works in fresh folders under the session's shared folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from aerospark.operators.inference import run_inference, run_inference_batch, text_model
from aerospark.scale import work_path
from aerospark.sources import sinks, tables
from aerospark.sources.clients import InClusterClient, RemoteClient
from aerospark.streaming.inference import file_stream, stream_events, stream_inference
from aerospark.streaming.tracking import stream_tracks
from workload import views
from workload.geometry_queries import TRACKS
from workload.registry import query
from workload.views import with_views

EVENT_FILE = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
# One context row per event: a track of its own id, and the event type as the query.
CONTEXT = [
    "user_id AS video_id", "event_id AS frame_index",
    "concat('[{\"id\":', event_id, ',\"label\":\"', event_type, '\"}]') AS tracks",
    "event_type AS query",
]


def echo_tracks(context: dict, model: str) -> dict:
    """A stand-in model: its detections are the tracks; an error event fails."""
    if context.get("query") == "error":
        raise ValueError("boom")
    return {"detections": context["tracks"], "model": model}


def client():
    return InClusterClient(echo_tracks)


RESULTS_SQL = """
    SELECT user_id AS video_id, event_id AS frame_index, 'echo' AS model_name,
           CASE WHEN event_type = 'error' THEN '{}' ELSE
             '{"detections":[{"id":' || event_id || ',"label":"' || event_type || '"}],"model":"echo"}' END AS result_json,
           CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS num_detections,
           CASE WHEN event_type = 'error' THEN 'boom' END AS error FROM events"""


@query("u1_batch_inference", RESULTS_SQL)
def batch_inference(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").selectExpr(*CONTEXT)
    return run_inference(rows, "echo", client)


def echo_all(contexts: list[dict], model: str) -> list[dict]:
    """The stand-in model for many contexts; one bad context fails the call."""
    return [echo_tracks(context, model) for context in contexts]


@query("u1_batched_calls", RESULTS_SQL)
def batched_calls(spark, sf_dir):
    """Eight contexts a call, of which some fail as a whole and are asked again one by one."""
    rows = views.table(spark, sf_dir, "events").selectExpr(*CONTEXT)
    return run_inference(rows, "echo", lambda: InClusterClient(echo_tracks, echo_all), batch_size=8)


@query("a18_failure_isolation", """
    SELECT event_type, count(*) AS rows, count_if(event_type = 'error')::BIGINT AS errors FROM events GROUP BY 1""")
def failure_isolation(spark, sf_dir):
    kinds = views.table(spark, sf_dir, "events").selectExpr("event_id AS frame_index", "event_type")
    rows = views.table(spark, sf_dir, "events").selectExpr(*CONTEXT)
    joined = run_inference(rows, "echo", client).join(kinds, "frame_index")
    return joined.groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )


@query("s4_write_results", RESULTS_SQL)
def stored_results(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").selectExpr(*CONTEXT)
    return run_inference_batch(rows, "echo", client, path=work_path(spark, "results"))


def staged_events(spark, sf_dir):
    """The events as JSON lines."""
    path = work_path(spark, "event-files")
    views.table(spark, sf_dir, "events").write.json(path)
    return path


EVENTS_SQL = "SELECT event_id, user_id, event_type, value, props FROM events"
EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "props"]


@query("s1_batch_ingest", EVENTS_SQL)
def batch_ingest(spark, sf_dir):
    name = f"ingested_{uuid.uuid4().hex}"
    tables.ingest(
        spark, staged_events(spark, sf_dir), name, multiline=False, schema=EVENT_FILE,
        location=work_path(spark, name),
    )
    return spark.read.table(name).select(*EVENT_COLUMNS)


@query("s2_incremental_ingest", EVENTS_SQL)
def incremental_ingest(spark, sf_dir):
    name = f"streamed_{uuid.uuid4().hex}"
    running = tables.ingest(
        spark, staged_events(spark, sf_dir), name, multiline=False, schema=EVENT_FILE,
        incremental=True, checkpoint_location=work_path(spark, "checkpoint"),
        location=work_path(spark, name),
    )
    running.awaitTermination()
    return spark.read.table(name).select(*EVENT_COLUMNS)


@query("s3_prepare_context", "SELECT event_id, user_id, event_type, value, props FROM events WHERE event_type = 'view' AND value > 10")
def prepared_context(spark, sf_dir):
    name = f"context_{uuid.uuid4().hex}"
    views.table(spark, sf_dir, "events").write.option("path", work_path(spark, name)).saveAsTable(name)
    return tables.prepare_context(spark, name, "event_type = 'view' AND value > 10").select(*EVENT_COLUMNS)


@query("p7_event_defaults", """
    SELECT event_id, 'external' AS source, '1.0' AS schema_version, event_type AS commentary,
           32 AS trace_width, 16 AS span_width, 1 AS metric_count, value FROM events""")
def event_defaults(spark, sf_dir):
    from aerospark.operators.injection import make_events

    given = views.table(spark, sf_dir, "events").selectExpr(
        "cast(event_id AS string) AS event_id", "event_type AS commentary",
        "concat('{\"value\":', value, ',\"flag\":true,\"name\":\"x\"}') AS metrics",
        "cast(null AS string) AS source", "props AS unknown_field",
    )
    made = make_events(given)
    return made.select(
        F.col("event_id").cast("bigint").alias("event_id"), "source", "schema_version", "commentary",
        F.length("trace_id").alias("trace_width"), F.length("span_id").alias("span_width"),
        F.size("metrics").alias("metric_count"), F.col("metrics")["value"].alias("value"),
    )


@query("p7_text_metrics", """
    SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS metric_count,
           CASE WHEN event_id % 3 = 2 THEN value END AS value FROM events""")
def text_metrics(spark, sf_dir):
    """Metrics that are text or a list are no numbers."""
    from aerospark.operators.injection import make_events

    given = views.table(spark, sf_dir, "events").selectExpr(
        "cast(event_id AS string) AS event_id",
        "CASE event_id % 3 WHEN 0 THEN '\"12\"' WHEN 1 THEN '[1,2]' ELSE concat('{\"value\":', value, '}') END AS metrics",
    )
    return make_events(given).select(
        F.col("event_id").cast("bigint").alias("event_id"), F.size("metrics").alias("metric_count"),
        F.col("metrics")["value"].alias("value"),
    )


def twice(events):
    """Every event two times, the copy a minute later."""
    later = F.transform(F.array(F.lit(0), F.lit(1)), lambda n: n)
    copies = events.select("*", F.explode(later).alias("_copy"))
    return copies.withColumn(
        "timestamp", F.expr("timestampadd(MINUTE, _copy, timestamp)")
    ).drop("_copy")


STORED_SQL = with_views("commentary_events", """
    SELECT event_id, source, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at FROM commentary_events""")


def stored(spark, path):
    return spark.read.parquet(path).select(
        "event_id", "source", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at")
    )


@query("s5_event_table_sink", STORED_SQL)
def event_table_sink(spark, sf_dir):
    path = work_path(spark, "events")
    sink = sinks.EventTableSink(path)
    events = views.commentary_events(spark, sf_dir)
    sink.emit_many(events.filter("source IN ('routine:click', 'routine:view')"))
    sink.emit_many(twice(events))
    return stored(spark, path)


@query("o4_insert_if_absent", with_views("commentary_events", """
    SELECT event_id, source FROM commentary_events WHERE source <> 'routine:click'"""))
def insert_if_absent(spark, sf_dir):
    events = views.commentary_events(spark, sf_dir)
    clicks = events.filter("source = 'routine:click'")
    return sinks.not_stored(events.select("event_id", "source"), clicks)


@query("s6_memory_sink", with_views("commentary_events", "SELECT event_id, source FROM commentary_events"))
def memory_sink(spark, sf_dir):
    sink = sinks.MemorySink(f"emitted_{uuid.uuid4().hex}")
    sink.emit_many(views.commentary_events(spark, sf_dir))
    return spark.table(sink.view).select("event_id", "source")


@query("s7_tee_sink", with_views("commentary_events", "SELECT event_id, source, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at FROM commentary_events"))
def tee_sink(spark, sf_dir):
    path = work_path(spark, "tee")
    sinks.open_sink(["table", "null", "memory"], path).emit_many(views.commentary_events(spark, sf_dir))
    return stored(spark, f"{path}/events")


@query("s8_otlp_export", with_views("commentary_events", """
    SELECT 'logs' AS signal, span_id FROM commentary_events
    UNION ALL SELECT 'traces', span_id FROM commentary_events"""))
def otlp_export(spark, sf_dir):
    path = work_path(spark, "otlp")
    status = sinks.OtlpSink(path, ["logs", "traces"]).export(views.commentary_events(spark, sf_dir))
    if set(status.values()) != {"ok"}:
        raise RuntimeError(status)
    shapes = {
        "logs": "resourceLogs ARRAY<STRUCT<scopeLogs: ARRAY<STRUCT<logRecords: ARRAY<STRUCT<spanId: STRING>>>>>>",
        "traces": "resourceSpans ARRAY<STRUCT<scopeSpans: ARRAY<STRUCT<spans: ARRAY<STRUCT<spanId: STRING>>>>>>",
    }
    spans = {
        "logs": "resourceLogs.scopeLogs[0].logRecords[0]", "traces": "resourceSpans.scopeSpans[0].spans[0]",
    }
    read = [
        spark.read.schema(shape).json(f"{path}/{signal}").select(
            F.lit(signal).alias("signal"), F.explode(F.expr(spans[signal])).alias("s")
        ).select("signal", "s.spanId")
        for signal, shape in shapes.items()
    ]
    return read[0].unionByName(read[1]).withColumnRenamed("spanId", "span_id")


@query("u2_text_model_with_fallback", with_views("commentary_events", """
    SELECT event_id, CASE WHEN kind = 'error' THEN commentary ELSE upper(commentary) END AS answer
    FROM commentary_events"""))
def text_model_with_fallback(spark, sf_dir):
    def shout(prompt: str) -> str:
        if prompt.startswith("error"):
            raise ValueError("model is down")
        return prompt.upper()

    events = views.commentary_events(spark, sf_dir)
    answer = text_model(shout)(F.col("commentary"))
    return events.select("event_id", F.coalesce(answer, F.col("commentary")).alias("answer"))


@query("t1_stream_inference", RESULTS_SQL)
def streamed_inference(spark, sf_dir):
    out = work_path(spark, "stream-results")
    rows = file_stream(spark, sf_dir, EVENT_FILE, "parquet", glob="events.parquet").selectExpr(*CONTEXT)
    stream_inference(
        rows, "echo", client, work_path(spark, "checkpoint"), out,
        available_now=True, await_termination=True,
    )
    return spark.read.parquet(out).drop("batch_id")


@query("t3_restarted_stream", RESULTS_SQL)
def restarted_stream(spark, sf_dir):
    """The same stream started twice from one checkpoint: each file is used once."""
    out, checkpoint = work_path(spark, "stream-results"), work_path(spark, "checkpoint")
    for _ in range(2):
        rows = file_stream(spark, sf_dir, EVENT_FILE, "parquet", 1, glob="events.parquet")
        stream_inference(
            rows.selectExpr(*CONTEXT), "echo", client, checkpoint, out,
            available_now=True, await_termination=True,
        )
    return spark.read.parquet(out).drop("batch_id")


@query("t2_capped_file_stream", EVENTS_SQL)
def capped_file_stream(spark, sf_dir):
    """JSON lines in several files, one file per micro-batch."""
    source, out = work_path(spark, "event-files"), work_path(spark, "stream-rows")
    views.table(spark, sf_dir, "events").repartition(4).write.json(source)
    stream = file_stream(spark, source, EVENT_FILE, "json", 1, multiline=False)
    stream.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", work_path(spark, "checkpoint")
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(*EVENT_COLUMNS)


def flaky_endpoint():
    """A remote client whose endpoint, a function, fails each context's first try."""
    tried: set[str] = set()

    def transport(url, payload, headers, timeout):
        context = payload["context"]
        seen = json.dumps(context)
        if seen not in tried:
            tried.add(seen)
            return 503, ""
        if context["query"] == "error":
            return 404, ""
        return 200, json.dumps({"detections": context["tracks"], "model": payload["model_name"]})

    return RemoteClient("http://endpoint", transport=transport, sleep=lambda seconds: None)


@query("u3_remote_inference_with_retries", RESULTS_SQL.replace("THEN 'boom' END", "THEN 'inference refused: HTTP status 404' END"))
def remote_inference(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").selectExpr(*CONTEXT)
    return run_inference(rows, "echo", flaky_endpoint)


INSIGHTS = (
    "concat('{\"videos\":[{\"insights\":{\"shots\":[{\"keyFrames\":[',"
    "'{\"instances\":[{\"start\":\"', user_id, '\",\"end\":\"', event_id, '\"},{\"start\":\"x\",\"end\":\"y\"}]},',"
    "'{\"instances\":[{\"start\":\"0\",\"end\":\"', user_id, '\"}]}]},{\"keyFrames\":[',"
    "'{\"instances\":[{\"start\":\"', event_type, '\",\"end\":\"z\"}]}]}]}}]}')"
)


@query("g3_insight_segments", """
    SELECT event_id AS video_id, 0 AS shot, 0 AS key_frame, user_id::VARCHAR AS starts, event_id::VARCHAR AS ends FROM events
    UNION ALL SELECT event_id, 0, 1, '0', user_id::VARCHAR FROM events
    UNION ALL SELECT event_id, 1, 0, event_type, 'z' FROM events""")
def segments_of_insights(spark, sf_dir):
    from aerospark.operators.insights import insight_segments

    raw = views.table(spark, sf_dir, "events").selectExpr("event_id AS video_id", f"{INSIGHTS} AS insights")
    return insight_segments(raw).select(
        "video_id", "shot", "key_frame", F.col("start").alias("starts"), F.col("end").alias("ends")
    )


@query("g3_first_shot_ranges", """
    SELECT event_id AS video_id, '{"videoId":"' || event_id || '","range":{"start":"' || user_id || '","end":"' || event_id || '"}}' AS range FROM events
    UNION ALL SELECT event_id, '{"videoId":"' || event_id || '","range":{"start":"0","end":"' || user_id || '"}}' FROM events""")
def ranges_of_first_shot(spark, sf_dir):
    from aerospark.operators.insights import first_shot, insight_segments, video_range

    raw = views.table(spark, sf_dir, "events").selectExpr("event_id AS video_id", f"{INSIGHTS} AS insights")
    return first_shot(insight_segments(raw)).select("video_id", F.to_json(video_range()).alias("range"))


@query("t4_stream_deduplication", STORED_SQL)
def stream_deduplication(spark, sf_dir):
    path = work_path(spark, "stream-events")
    source = work_path(spark, "event-table")
    twice(views.commentary_events(spark, sf_dir)).write.parquet(source)
    schema = spark.read.parquet(source).schema
    events = file_stream(spark, source, schema, "parquet", 1)
    stream_events(
        events, path, work_path(spark, "checkpoint"), available_now=True, await_termination=True
    )
    return stored(spark, path)


@query(
    "t5_stream_tracks",
    with_views("frames detections", f"{TRACKS} SELECT video_id, frame_index, det_seq, track_id, false AS rejected FROM tracked"),
)
def streamed_tracks(spark, sf_dir):
    """Frames in three deliveries; the stream is restarted for each of them."""
    keys = ["video_id", "frame_index"]
    frames = views.frames(spark, sf_dir).select(*keys)
    boxes = views.detections(spark, sf_dir).select(*keys, "det_seq", "cx", "cy")
    rows = frames.join(boxes, keys, "left")
    last = frames.agg(F.max("frame_index")).first()[0]
    source, out, checkpoint = (work_path(spark, n) for n in ("frames", "tracks", "checkpoint"))
    for part in range(3):
        inside = F.floor(F.col("frame_index") * 3 / (last + 1)) == part
        rows.filter(inside).write.mode("append").parquet(source)
        stream = file_stream(spark, source, rows.schema, "parquet")
        stream_tracks(stream).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query(
    "t5_split_frames",
    with_views("frames detections", f"{TRACKS} SELECT video_id, frame_index, det_seq, track_id, false AS rejected FROM tracked"),
)
def tracks_of_split_frames(spark, sf_dir):
    """Frames in three deliveries, where the rows of a frame at a border come in two of them."""
    keys = ["video_id", "frame_index"]
    frames = views.frames(spark, sf_dir).select(*keys)
    boxes = views.detections(spark, sf_dir).select(*keys, "det_seq", "cx", "cy")
    rows = frames.join(boxes, keys, "left")
    last = frames.agg(F.max("frame_index")).first()[0]
    end = frames.groupBy("video_id").agg((F.max("frame_index") + 1).alias("frame_index")).join(
        boxes.limit(0), keys, "left"
    )
    # later detections of a frame count as half a frame later
    place = F.col("frame_index") + F.when(F.col("det_seq") > 1, F.lit(0.5)).otherwise(0.0)
    source, out, checkpoint = (work_path(spark, n) for n in ("frames", "tracks", "checkpoint"))
    cuts = [-1.0, last // 3 + 0.25, 2 * (last // 3) + 0.25, last + 1.0]
    for low, high in zip(cuts[:-1], cuts[1:]):
        part = rows.filter((place > low) & (place <= high))
        part = part.unionByName(end) if high > last else part
        part.write.mode("append").parquet(source)
        stream = file_stream(spark, source, rows.schema, "parquet")
        stream_tracks(stream, hold_last=True).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
