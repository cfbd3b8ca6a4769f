"""Queries that shape events as telemetry and read JSON cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospark.functions import json_cells, otlp
from aerospark.operators import telemetry
from workload import views
from workload.registry import query
from workload.views import with_views


@query(
    "p14_attribute_encoding",
    with_views("commentary_events", """
        SELECT event_id,
               '[{"key":"kind","value":{"stringValue":"' || kind || '"}},'
               || '{"key":"payload","value":{"kvlistValue":{"values":[{"key":"k","value":{"intValue":"'
               || CAST(k AS BIGINT) || '"}}]}}},'
               || '{"key":"source","value":{"stringValue":"' || source || '"}},'
               || '{"key":"correlation_key","value":{"stringValue":"' || correlation_key || '"}},'
               || '{"key":"video_id","value":{"intValue":"' || video_id || '"}},'
               || '{"key":"analysis_id","value":{"intValue":"' || analysis_id || '"}},'
               || '{"key":"frame_index","value":{"intValue":"' || frame_index || '"}},'
               || '{"key":"meta.routine","value":{"stringValue":"' || kind || '"}}]' AS attributes
        FROM commentary_events"""),
)
def attribute_encoding(spark, sf_dir):
    return views.commentary_events(spark, sf_dir).select(
        "event_id", F.to_json(otlp.signal_attributes()).alias("attributes")
    )


@query(
    "p14_deep_attributes",
    with_views("commentary_events", """
        SELECT event_id,
               '{"kvlistValue":{"values":[{"key":"b","value":{"arrayValue":{"values":[{"kvlistValue":{"values":'
               || '[{"key":"c","value":{"kvlistValue":{"values":[{"key":"d","value":{"arrayValue":{"values":[{"intValue":"'
               || CAST(k AS BIGINT) || '"},{"kvlistValue":{"values":[{"key":"e","value":{"stringValue":"' || kind
               || '"}}]}}]}}}]}}}]}}]}}}]}}' AS value
        FROM commentary_events"""),
)
def deep_attributes(spark, sf_dir):
    """Lists and objects seven levels deep."""
    k = F.col("metrics")["k"].cast("bigint").cast("string")
    kind = F.regexp_replace("source", "^routine:", "")
    text = F.concat(F.lit('{"a":{"b":[{"c":{"d":['), k, F.lit(',{"e":"'), kind, F.lit('"}]}}]}}'))
    events = views.commentary_events(spark, sf_dir).withColumn("attributes", F.parse_json(text))
    found = events.select("event_id", F.filter(otlp.signal_attributes(), lambda e: e["key"] == "a").alias("own"))
    return found.select("event_id", F.to_json(F.get("own", F.lit(0))["value"]).alias("value"))


@query(
    "p15_flat_log_records",
    with_views("commentary_events", """
        SELECT event_id, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS at,
               trace_id, span_id, commentary AS body, kind AS meta_routine, k AS metric_k,
               value AS metric_value, video_id, correlation_key FROM commentary_events"""),
)
def flat_records(spark, sf_dir):
    made = telemetry.flat_log_records(views.commentary_events(spark, sf_dir))
    attribute = F.col("record.Attributes")

    def read(name, kind):
        return F.try_variant_get(attribute[name], "$", kind)

    return made.select(
        "event_id", F.col("record.Timestamp").alias("at"), F.col("record.TraceId").alias("trace_id"),
        F.col("record.SpanId").alias("span_id"), F.col("record.Body").alias("body"),
        read("meta.routine", "string").alias("meta_routine"),
        read("metric.k", "double").alias("metric_k"), read("metric.value", "double").alias("metric_value"),
        read("video_id", "bigint").alias("video_id"),
        read("correlation_key", "string").alias("correlation_key"),
    )


@query(
    "p15_otlp_log_records",
    with_views("commentary_events", """
        SELECT event_id, CAST(epoch_us(timestamp) * 1000 AS VARCHAR) AS time_unix_nano,
               9 AS severity_number, commentary AS body, trace_id, span_id,
               8::INT AS attribute_count FROM commentary_events"""),
)
def log_records(spark, sf_dir):
    made = telemetry.log_records(views.commentary_events(spark, sf_dir))
    return made.select(
        "event_id", F.col("record.timeUnixNano").alias("time_unix_nano"),
        F.col("record.severityNumber").alias("severity_number"),
        F.col("record.body.stringValue").alias("body"), F.col("record.traceId").alias("trace_id"),
        F.col("record.spanId").alias("span_id"), F.size("record.attributes").alias("attribute_count"),
    )


@query(
    "p16_gauge_points",
    with_views("commentary_events", """
        SELECT event_id, 'commentary.k' AS name, k AS as_double,
               CAST(epoch_us(timestamp) * 1000 AS VARCHAR) AS time_unix_nano FROM commentary_events
        UNION ALL
        SELECT event_id, 'commentary.value', value, CAST(epoch_us(timestamp) * 1000 AS VARCHAR)
        FROM commentary_events"""),
)
def gauge_points(spark, sf_dir):
    made = telemetry.gauge_points(views.commentary_events(spark, sf_dir))
    return made.select(
        "event_id", "name", F.col("record.asDouble").alias("as_double"),
        F.col("record.timeUnixNano").alias("time_unix_nano"),
    )


@query(
    "p17_spans",
    with_views("commentary_events", """
        SELECT event_id, trace_id, span_id, parent_span_id, source AS name, 1 AS kind,
               CAST(epoch_us(timestamp) * 1000 AS VARCHAR) AS starts,
               CAST(epoch_us(timestamp) * 1000 + CAST(floor((segment_end - segment_start) * 1000000000) AS BIGINT)
                    AS VARCHAR) AS ends FROM commentary_events"""),
)
def spans(spark, sf_dir):
    made = telemetry.spans(views.commentary_events(spark, sf_dir))
    return made.select(
        "event_id", F.col("record.traceId").alias("trace_id"), F.col("record.spanId").alias("span_id"),
        F.col("record.parentSpanId").alias("parent_span_id"), F.col("record.name").alias("name"),
        F.col("record.kind").alias("kind"), F.col("record.startTimeUnixNano").alias("starts"),
        F.col("record.endTimeUnixNano").alias("ends"),
    )


CELLS = """
    , cells AS (
        SELECT doc_id, source, n_chars,
               CASE CAST(n_chars % 6 AS INT)
                    WHEN 0 THEN '  ' WHEN 1 THEN '{"id":' || doc_id || '}'
                    WHEN 2 THEN '[{"id":' || doc_id || '},{"id":1}]' WHEN 3 THEN '{"id": oops'
                    WHEN 4 THEN '[]' END AS cell FROM documents)"""


def json_cell_table(spark, sf_dir):
    """A text cell of every shape a stored context may have."""
    cell = """CASE cast(n_chars % 6 AS int)
        WHEN 0 THEN '  ' WHEN 1 THEN concat('{"id":', doc_id, '}')
        WHEN 2 THEN concat('[{"id":', doc_id, '},{"id":1}]') WHEN 3 THEN '{"id": oops'
        WHEN 4 THEN '[]' END"""
    return views.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "source", "n_chars", f"{cell} AS cell"
    )


def cells_sql(body: str) -> str:
    return "WITH " + CELLS.strip().lstrip(",").strip() + body


@query(
    "p1_json_cells",
    cells_sql("""
        SELECT doc_id, CASE WHEN trim(cell) = '' THEN NULL ELSE cell END AS as_text,
               CASE n_chars % 6 WHEN 1 THEN 'OBJECT' WHEN 2 THEN 'ARRAY' WHEN 3 THEN 'STRING'
                    WHEN 4 THEN 'ARRAY' END AS kind FROM cells"""),
)
def json_text_cells(spark, sf_dir):
    cells = json_cell_table(spark, sf_dir)
    value = json_cells.coerce_json(F.col("cell"), cells.schema["cell"].dataType)
    return cells.select(
        "doc_id", F.try_variant_get(value, "$", "string").alias("as_text"),
        F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).alias("kind"),
    )


@query(
    "p2_row_to_context",
    cells_sql("""
        SELECT doc_id, CASE CAST(n_chars % 6 AS INT)
                 WHEN 1 THEN '{"tracks":[' || cell || '],"query":"' || source || '"}'
                 WHEN 2 THEN '{"tracks":' || cell || ',"query":"' || source || '"}'
                 WHEN 3 THEN '{"tracks":["{\\"id\\": oops"],"query":"' || source || '"}'
                 ELSE '{"query":"' || source || '"}' END AS context FROM cells"""),
)
def contexts(spark, sf_dir):
    rows = json_cell_table(spark, sf_dir).selectExpr(
        "doc_id", "cell AS tracks", "cell AS frames", "source AS query"
    )
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select("doc_id", json_cells.row_to_context(kinds, include_frames=False).alias("context"))


PAYLOAD = """CASE cast({n} % 6 AS int)
    WHEN 0 THEN '{{"detections":[1,2],"tracks":[1]}}' WHEN 1 THEN '{{"tracks":[1],"results":[1,2,3]}}'
    WHEN 2 THEN '{{"detections":[],"tracks":[1]}}' WHEN 3 THEN concat('{{"summary":{{"count":', {n}, '.75}}}}')
    WHEN 4 THEN '{{"detections":5,"summary":{{"count":"x"}}}}' ELSE '{{}}' END"""


@query(
    "p4_payload_counts",
    """SELECT doc_id, CASE CAST(n_chars % 6 AS INT) WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0
              WHEN 3 THEN CAST(n_chars AS INT) ELSE 0 END AS detections FROM documents""",
)
def payload_counts(spark, sf_dir):
    payload = F.parse_json(F.expr(PAYLOAD.format(n="n_chars")))
    return views.table(spark, sf_dir, "documents").select(
        "doc_id", json_cells.count_detections(payload).alias("detections")
    )


@query(
    "p3_result_rows",
    """SELECT doc_id, CASE WHEN lang = 'en' THEN doc_id END AS video_id, n_chars AS frame_index,
              source AS model_name,
              CASE WHEN lang = 'de' THEN '{}' ELSE '{"detections":[' || doc_id || ',2]}' END AS result_json,
              CASE WHEN lang = 'de' THEN 0 ELSE 2 END AS num_detections,
              CASE WHEN lang = 'de' THEN 'boom' END AS error FROM documents""",
)
def result_rows(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents")
    video = F.when(F.col("lang") == "en", F.col("doc_id").cast("string")).otherwise(
        F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.lit("x12"))
    )
    payload = F.parse_json(F.concat(F.lit('{"detections":['), F.col("doc_id").cast("string"), F.lit(",2]}")))
    error = F.when(F.col("lang") == "de", F.lit("boom"))
    return docs.select(
        "doc_id",
        *json_cells.result_row(video, F.col("n_chars").cast("string"), F.col("source"), payload, error),
    )
