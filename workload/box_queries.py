"""Queries over boxes: conversions, scaling, model outputs, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospark.functions import boxes
from aerospark.sources import model_outputs
from workload import views
from workload.registry import query
from workload.views import with_views


def corners(spark, sf_dir):
    """Corners in quarter pixels; half of the videos hold fractions of 512 instead."""
    scale = "CASE WHEN video_id % 2 = 0 THEN 512.0D ELSE 1.0D END"
    return views.detections(spark, sf_dir).selectExpr(
        "video_id", "frame_index", "det_seq", "label", "score",
        f"(x + vx * 0.25D) / {scale} AS x1", f"(y + vy * 0.25D) / {scale} AS y1",
        f"(x + w * 0.5D) / {scale} AS x2", f"(y + h * 0.5D) / {scale} AS y2",
        "cast(frame_index % 3 AS int) * 100 AS off_x", "cast(frame_index % 2 AS int) * 50 AS off_y",
        "1280 AS region_w", "720 AS region_h",
    )


CORNERS = """
    corners AS (
        SELECT video_id, frame_index, det_seq, label, score,
               (x + vx * 0.25::DOUBLE) / CASE WHEN video_id % 2 = 0 THEN 512.0 ELSE 1.0 END AS x1,
               (y + vy * 0.25::DOUBLE) / CASE WHEN video_id % 2 = 0 THEN 512.0 ELSE 1.0 END AS y1,
               (x + w * 0.5::DOUBLE) / CASE WHEN video_id % 2 = 0 THEN 512.0 ELSE 1.0 END AS x2,
               (y + h * 0.5::DOUBLE) / CASE WHEN video_id % 2 = 0 THEN 512.0 ELSE 1.0 END AS y2,
               frame_index % 3 * 100 AS off_x, frame_index % 2 * 50 AS off_y
        FROM detections)"""
KEYS = ("video_id", "frame_index", "det_seq")


@query(
    "p10_corners_to_boxes",
    with_views("detections", f"""WITH {CORNERS}
        SELECT video_id, frame_index, det_seq, round_even(x1, 0)::INT AS x, round_even(y1, 0)::INT AS y,
               round_even(greatest(0, x2 - x1), 0)::INT AS w, round_even(greatest(0, y2 - y1), 0)::INT AS h
        FROM corners"""),
)
def corners_to_boxes(spark, sf_dir):
    made = boxes.corners_to_xywh(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    return corners(spark, sf_dir).withColumn("b", made).select(*KEYS, "b.*")


@query(
    "p10_boxes_to_corners",
    with_views("detections", """
        SELECT video_id, frame_index, det_seq, round_even(cx, 0)::INT AS x1, round_even(cy, 0)::INT AS y1,
               round_even(cx + w, 0)::INT AS x2, round_even(cy + h, 0)::INT AS y2 FROM detections"""),
)
def boxes_to_corners(spark, sf_dir):
    made = boxes.xywh_to_corners(*[F.col(c) for c in ("cx", "cy", "w", "h")])
    return views.detections(spark, sf_dir).withColumn("b", made).select(*KEYS, "b.*")


@query(
    "p11_boxes_to_frame",
    with_views("detections", f"""WITH {CORNERS},
        scales AS (
            SELECT *, CASE WHEN greatest(abs(x1), abs(y1), abs(x2), abs(y2)) <= 1.5 THEN 1280.0 ELSE 1280 / 640.0 END AS sx,
                   CASE WHEN greatest(abs(x1), abs(y1), abs(x2), abs(y2)) <= 1.5 THEN 720.0 ELSE 720 / 512.0 END AS sy
            FROM corners),
        moved AS (
            SELECT video_id, frame_index, det_seq, greatest(0, off_x + x1 * sx) AS l, greatest(0, off_y + y1 * sy) AS t,
                   greatest(0, off_x + x2 * sx) AS r, greatest(0, off_y + y2 * sy) AS b FROM scales)
        SELECT video_id, frame_index, det_seq, round_even(least(l, r), 0)::INT AS x,
               round_even(least(t, b), 0)::INT AS y, round_even(abs(r - l), 0)::INT AS w,
               round_even(abs(b - t), 0)::INT AS h FROM moved"""),
)
def boxes_to_frame(spark, sf_dir):
    made = boxes.scale_to_frame(
        *[F.col(c) for c in ("x1", "y1", "x2", "y2", "off_x", "off_y", "region_w", "region_h")],
        input_size=(640, 512),
    )
    return corners(spark, sf_dir).withColumn("b", made).select(*KEYS, "b.*")


@query(
    "p12_score_threshold",
    with_views("detections", "SELECT video_id, frame_index, det_seq, score FROM detections WHERE score >= 0.95"),
)
def threshold(spark, sf_dir):
    return model_outputs.above_threshold(views.detections(spark, sf_dir), 0.95).select(*KEYS, "score")


@query(
    "p13_detection_from_box",
    with_views("detections", """
        SELECT video_id, frame_index, det_seq, CASE WHEN label = 'car' THEN 'car' ELSE 'object' END AS label,
               CASE WHEN label = 'car' THEN score ELSE 1.0 END AS score, x, y, w, h, cx, cy, area FROM detections"""),
)
def from_box(spark, sf_dir):
    car = F.col("label") == "car"
    made = boxes.detection_from_box(
        F.struct("x", "y", "w", "h"), F.when(car, F.col("label")), F.when(car, F.col("score"))
    )
    return views.detections(spark, sf_dir).select(*KEYS, made.alias("d")).select(*KEYS, "d.*")


OUTPUT_SQL = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(i AS INT) AS box_seq,
           CAST(l_partkey % 200 + 10 * i AS DOUBLE) AS x1, CAST(l_suppkey % 200 AS DOUBLE) AS y1,
           l_partkey % 200 + 10 * i + l_quantity AS x2, l_suppkey % 200 + l_quantity / 2 AS y2,
           CASE i WHEN 0 THEN 1 - l_discount ELSE l_tax END + 0.0 AS score,
           CASE i WHEN 0 THEN l_linenumber ELSE 2 END::BIGINT AS class_id
    FROM lineitem, range(2) t(i)"""


def raw_outputs(spark, sf_dir, layout):
    """Two boxes per line item in one of the layouts models write."""
    rows = (
        "array(array(cast(l_partkey % 200 AS double), cast(l_suppkey % 200 AS double), "
        "l_partkey % 200 + l_quantity, l_suppkey % 200 + l_quantity / 2, 1 - l_discount, "
        "cast(l_linenumber AS double)), "
        "array(l_partkey % 200 + 10D, cast(l_suppkey % 200 AS double), "
        "l_partkey % 200 + 10 + l_quantity, l_suppkey % 200 + l_quantity / 2, l_tax + 0.0D, 2.5D))"
    )
    keyed = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", f"{rows} AS outputs"
    )
    arrays = [
        "transform(outputs, r -> slice(r, 1, 4)) AS {}", "transform(outputs, r -> r[4]) AS {}",
        "transform(outputs, r -> r[5]) AS {}",
    ]
    ids = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    if layout == "arrays":
        names = ("detection_boxes", "detection_scores", "detection_classes")
        return keyed.selectExpr(*ids, *[a.format(n) for a, n in zip(arrays, names)])
    if layout == "images":
        parts = ", ".join(
            f"'{n}', {a.format('x').rsplit(' AS ', 1)[0]}" for a, n in zip(arrays, ("boxes", "scores", "labels"))
        )
        return keyed.selectExpr(*ids, f"array(named_struct({parts})) AS images")
    return keyed


@query("s11_combined_array_output", OUTPUT_SQL)
def combined_output(spark, sf_dir):
    return model_outputs.explode_model_outputs(raw_outputs(spark, sf_dir, "combined"))


@query("s11_three_array_output", OUTPUT_SQL)
def three_arrays(spark, sf_dir):
    return model_outputs.explode_model_outputs(raw_outputs(spark, sf_dir, "arrays"))


@query("s11_image_list_output", OUTPUT_SQL)
def image_list(spark, sf_dir):
    return model_outputs.explode_model_outputs(raw_outputs(spark, sf_dir, "images")).drop("image_seq")


@query(
    "j3_lenient_labels",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
              coalesce(r_name, CAST(l_linenumber AS VARCHAR)) AS label
       FROM lineitem LEFT JOIN region ON r_regionkey = l_linenumber""",
)
def lenient_labels(spark, sf_dir):
    found = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cast(l_linenumber AS bigint) AS class_id"
    )
    names = views.table(spark, sf_dir, "region").selectExpr("r_regionkey AS class_id", "r_name AS label")
    return model_outputs.with_labels(found, names).drop("class_id")


@query(
    "j3_strict_labels",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, n_name AS label
       FROM lineitem JOIN nation ON n_nationkey = l_linenumber""",
)
def strict_labels(spark, sf_dir):
    found = views.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cast(l_linenumber AS bigint) AS class_id"
    )
    names = views.table(spark, sf_dir, "nation").selectExpr("n_nationkey AS class_id", "n_name AS label")
    return model_outputs.with_labels(found, names, strict=True).drop("class_id")
