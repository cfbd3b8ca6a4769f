"""Schemas of the tables the operators read and write."""

from __future__ import annotations

RAW_FRAMES = (
    "video_id LONG, frame_index LONG, timestamp DOUBLE, width INT, height INT, "
    "thumbnail_b64 STRING, sensor_meta STRING, ingested_at TIMESTAMP"
)
TRACKS = "video_id LONG, frame_index LONG, tracks STRING, sensor_meta STRING, query STRING"
FEATURES = "video_id LONG, frame_index LONG, precomputed_features STRING"
INFERENCE_RESULTS = (
    "video_id LONG, frame_index LONG, model_name STRING, "
    "result_json STRING, num_detections INT, error STRING"
)
DETECTIONS = (
    "video_id LONG, frame_index LONG, det_seq LONG, label STRING, score DOUBLE, "
    "x INT, y INT, w INT, h INT, cx DOUBLE, cy DOUBLE, area DOUBLE, track_id LONG"
)
COMMENTARY_EVENTS = (
    "event_id STRING, trace_id STRING, span_id STRING, parent_span_id STRING, "
    "correlation_key STRING, timestamp TIMESTAMP_NTZ, source STRING, video_id LONG, "
    "analysis_id LONG, frame_index LONG, segment_start DOUBLE, segment_end DOUBLE, "
    "commentary STRING, attributes VARIANT, metrics MAP<STRING,DOUBLE>, "
    "metadata VARIANT, schema_version STRING"
)
FRAME_DOCUMENTS = (
    "id STRING, account_id STRING, frame_number LONG, vector ARRAY<FLOAT>, "
    "caption STRING, description STRING, labels ARRAY<STRING>, tags ARRAY<STRING>, "
    "objects STRING, boundingbox STRING, geotags STRING, path STRING, user STRING, "
    "session STRING, created TIMESTAMP_NTZ"
)
TRACK_ITEMS = (
    "ARRAY<STRUCT<id: LONG, bbox: ARRAY<DOUBLE>, velocity: ARRAY<DOUBLE>, "
    "timestamp: DOUBLE, label: STRING>>"
)
ROUTINE_RESULTS = (
    "routine STRING, level STRING, video_id LONG, frame_index LONG, "
    "summary MAP<STRING,STRING>, detections ARRAY<STRUCT<label: STRING, score: DOUBLE, "
    "x: INT, y: INT, w: INT, h: INT, cx: DOUBLE, cy: DOUBLE, area: DOUBLE>>, error STRING"
)
