"""The given tables seen as frames, detections, events and documents.

Every view exists twice: as a DataFrame for Spark and as a SQL text for the
check in DuckDB.  The mappings are plain projections, so that filters and
column pruning still reach the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: ten videos of consecutive frames at 30 per second."""
    return table(spark, sf_dir, "orders").select(
        F.expr("o_orderkey % 10").alias("video_id"),
        F.expr("o_orderkey div 10").alias("frame_index"),
        (F.expr("o_orderkey div 10") / F.lit(30.0)).alias("timestamp"),
        F.expr("cast(640 + 320 * (o_orderkey % 10 % 3) as int)").alias("width"),
        F.expr("cast(480 + 240 * (o_orderkey % 10 % 3) as int)").alias("height"),
        F.expr("concat('cam-', o_orderpriority)").alias("camera"),
        F.col("o_totalprice").alias("altitude"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item; ``det_seq`` orders the boxes of a frame and is unique in it."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 10 AS video_id",
        "l_orderkey div 10 AS frame_index",
        "((l_linenumber * 1000000000L + l_partkey) * 10000000L + l_suppkey) * 100 "
        "+ cast(floor(l_quantity) AS bigint) AS det_seq",
        "CASE l_returnflag WHEN 'A' THEN 'car' WHEN 'N' THEN 'person' ELSE 'truck' END AS label",
        "round(1 - l_discount, 2) AS score",
        "cast((l_partkey * 7) % 200 AS int) AS x",
        "cast((l_suppkey * 13) % 200 AS int) AS y",
        "cast(20 + floor(l_quantity) AS int) AS w",
        "cast(20 + floor(l_quantity / 2) AS int) AS h",
        "cast(round(l_tax * 100) AS int) - 4 AS vx",
        "cast(round(l_discount * 100) AS int) - 5 AS vy",
    ).selectExpr(
        "*", "x + w / 2.0D AS cx", "y + h / 2.0D AS cy", "cast(w * h AS double) AS area"
    )


def commentary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide event per row of the event stream; a user is a video, a minute a frame."""
    minute = (
        "timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))"
    )
    return (
        table(spark, sf_dir, "events")
        .withColumn("frame_index", F.expr(minute))
        .selectExpr(
            "cast(event_id AS string) AS event_id",
            "md5(cast(user_id AS string)) AS trace_id",
            "substr(md5(cast(event_id AS string)), 1, 16) AS span_id",
            "CASE WHEN event_id % 7 <> 0 "
            "THEN substr(md5(cast(event_id - event_id % 7 AS string)), 1, 16) END AS parent_span_id",
            "concat('video:', user_id, '|frame:', frame_index) AS correlation_key",
            "cast(ts AS timestamp_ntz) AS timestamp",
            "concat('routine:', event_type) AS source",
            "user_id AS video_id",
            "user_id * 10 AS analysis_id",
            "frame_index",
            "frame_index / 30.0D AS segment_start",
            "(frame_index + 30) / 30.0D AS segment_end",
            "concat(event_type, ' seen by ', user_id) AS commentary",
            "parse_json(concat('{\"kind\":\"', event_type, '\",\"payload\":', props, '}')) AS attributes",
            "map('k', cast(get_json_object(props, '$.k') AS double), 'value', value) AS metrics",
            "parse_json(concat('{\"routine\":\"', event_type, '\"}')) AS metadata",
            "'1.0' AS schema_version",
        )
    )


def inference_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scored frame per order; the count of its line items is its detection count."""
    orders = table(spark, sf_dir, "orders")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("n"))
    )
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").selectExpr(
        "o_custkey AS video_id",
        "o_orderkey AS frame_index",
        "o_orderpriority AS model_name",
        "concat('{\"summary\":{\"count\":', coalesce(n, 0), '}}') AS result_json",
        "cast(coalesce(n, 0) AS int) AS num_detections",
        "CASE WHEN o_orderstatus = 'P' THEN 'boom' END AS error",
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One triangle per nation."""
    x0 = "cast(n_nationkey % 5 * 40 AS double)"
    y0 = "cast(n_nationkey div 5 * 40 AS double)"
    return table(spark, sf_dir, "nation").selectExpr(
        "n_name AS zone",
        f"array(array({x0}, {y0}), array({x0} + 60, {y0}), array({x0} + 30, {y0} + 55)) AS polygon",
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame documents' keys and vectors."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "format_string('%s-%04d', cast(label AS string), vec_id) AS id",
        "cast(label AS string) AS account_id",
        "vec_id AS frame_number",
        "embedding AS vector",
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 64-value vector is an 8 by 8 patch; blue and red read the vector further on.

    The values leave one generator, so no later expression repeats their making.
    """
    level = "cast(floor((cast({} AS double) + 0.6D) * 200) AS int)"
    return table(spark, sf_dir, "embeddings").selectExpr(
        "cast(label AS bigint) AS video_id",
        "vec_id AS frame_index",
        "inline(transform(embedding, (el, pos) -> named_struct("
        "'x', pos % 8, 'y', cast(pos div 8 AS int), "
        f"'b', {level.format('embedding[(pos + 21) % 64]')}, 'g', {level.format('el')}, "
        f"'r', {level.format('embedding[(pos + 42) % 64]')})))",
    )


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle per region on the patch grid."""
    return table(spark, sf_dir, "region").selectExpr(
        "r_name AS spot", "r_regionkey AS x", "r_regionkey AS y", "3 AS w", "3 AS h"
    )


SQL = {
    "frames": """
        SELECT o_orderkey % 10 AS video_id, o_orderkey // 10 AS frame_index,
               (o_orderkey // 10) / 30.0 AS timestamp,
               CAST(640 + 320 * (o_orderkey % 10 % 3) AS INT) AS width,
               CAST(480 + 240 * (o_orderkey % 10 % 3) AS INT) AS height,
               'cam-' || o_orderpriority AS camera, o_totalprice AS altitude
        FROM orders""",
    "boxes": """
        SELECT l_orderkey % 10 AS video_id, l_orderkey // 10 AS frame_index,
               ((l_linenumber * 1000000000::BIGINT + l_partkey) * 10000000 + l_suppkey) * 100
                   + CAST(floor(l_quantity) AS BIGINT) AS det_seq,
               CASE l_returnflag WHEN 'A' THEN 'car' WHEN 'N' THEN 'person' ELSE 'truck' END AS label,
               round(1 - l_discount, 2) AS score,
               CAST((l_partkey * 7) % 200 AS INT) AS x, CAST((l_suppkey * 13) % 200 AS INT) AS y,
               CAST(20 + floor(l_quantity) AS INT) AS w, CAST(20 + floor(l_quantity / 2) AS INT) AS h,
               CAST(round(l_tax * 100) AS INT) - 4 AS vx,
               CAST(round(l_discount * 100) AS INT) - 5 AS vy
        FROM lineitem""",
    "detections": """
        SELECT *, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy,
               CAST(w * h AS DOUBLE) AS area FROM boxes""",
    "timed": """
        SELECT *, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000) AS BIGINT)
               AS frame_index FROM events""",
    "commentary_events": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, md5(CAST(user_id AS VARCHAR)) AS trace_id,
               substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS span_id,
               CASE WHEN event_id % 7 <> 0
                    THEN substr(md5(CAST(event_id - event_id % 7 AS VARCHAR)), 1, 16) END AS parent_span_id,
               'video:' || user_id || '|frame:' || frame_index AS correlation_key,
               ts AS timestamp, 'routine:' || event_type AS source, user_id AS video_id,
               user_id * 10 AS analysis_id, frame_index, frame_index / 30.0 AS segment_start,
               (frame_index + 30) / 30.0 AS segment_end,
               event_type || ' seen by ' || user_id AS commentary, event_type AS kind,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value, props
        FROM timed""",
    "line_counts": "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1",
    "inference_results": """
        SELECT o_custkey AS video_id, o_orderkey AS frame_index, o_orderpriority AS model_name,
               '{"summary":{"count":' || coalesce(n, 0) || '}}' AS result_json,
               CAST(coalesce(n, 0) AS INT) AS num_detections,
               CASE WHEN o_orderstatus = 'P' THEN 'boom' END AS error
        FROM orders LEFT JOIN line_counts ON o_orderkey = l_orderkey""",
    "zones": """
        SELECT n_name AS zone, CAST(n_nationkey % 5 * 40 AS DOUBLE) AS x0,
               CAST(n_nationkey // 5 * 40 AS DOUBLE) AS y0 FROM nation""",
    "docs": """
        SELECT CAST(label AS VARCHAR) || '-' || lpad(CAST(vec_id AS VARCHAR),
                   greatest(4, length(CAST(vec_id AS VARCHAR)))::INT, '0') AS id,
               CAST(label AS VARCHAR) AS account_id, vec_id AS frame_number, embedding AS vector
        FROM embeddings""",
    "cells": """
        SELECT label, vec_id, embedding, unnest(range(len(embedding))) AS pos FROM embeddings""",
    "pixels": """
        SELECT CAST(label AS BIGINT) AS video_id, vec_id AS frame_index,
               CAST(pos % 8 AS INT) AS x, CAST(pos // 8 AS INT) AS y,
               CAST(floor((CAST(embedding[(pos + 21) % 64 + 1] AS DOUBLE) + 0.6) * 200) AS INT) AS b,
               CAST(floor((CAST(embedding[pos + 1] AS DOUBLE) + 0.6) * 200) AS INT) AS g,
               CAST(floor((CAST(embedding[(pos + 42) % 64 + 1] AS DOUBLE) + 0.6) * 200) AS INT) AS r
        FROM cells""",
    "spots": """
        SELECT r_name AS spot, r_regionkey AS x, r_regionkey AS y, 3 AS w, 3 AS h FROM region""",
}
NEEDS = {
    "detections": ["boxes"],
    "commentary_events": ["timed"],
    "inference_results": ["line_counts"],
    "pixels": ["cells"],
}


def with_views(names: str, body: str) -> str:
    """``body`` behind the common table expressions named in ``names`` and what they need."""
    order: list[str] = []
    for name in names.split():
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in order:
                order.append(needed)
    ctes = ",\n".join(f"{name} AS ({SQL[name].strip()})" for name in order)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
