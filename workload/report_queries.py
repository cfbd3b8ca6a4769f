"""Queries over inference results, and the joins and lists around videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospark.operators import catalog, reports
from workload import views
from workload.registry import query
from workload.views import with_views


@query(
    "a14_detections_per_model",
    with_views("inference_results", """
        SELECT model_name, count(*) AS frames_scored, CAST(sum(num_detections) AS BIGINT) AS total_detections,
               round(avg(num_detections), 6) AS avg_detections_per_frame,
               count_if(error IS NOT NULL)::BIGINT AS errors
        FROM inference_results GROUP BY model_name"""),
)
def per_model(spark, sf_dir):
    made = reports.detections_per_model(views.inference_results(spark, sf_dir))
    return made.withColumn("avg_detections_per_frame", F.round("avg_detections_per_frame", 6))


@query(
    "a15_sum_by_model",
    with_views("inference_results", """
        SELECT model_name, CAST(sum(num_detections) AS BIGINT) AS total
        FROM inference_results GROUP BY model_name"""),
)
def by_model(spark, sf_dir):
    return reports.detections_by_model(views.inference_results(spark, sf_dir))


@query(
    "a13_run_metrics",
    with_views("inference_results", """
        SELECT count(*)::DOUBLE AS rows, ceil(count(*) / 64.0)::DOUBLE AS batches,
               count_if(error IS NOT NULL)::DOUBLE AS errors, sum(num_detections)::DOUBLE AS detections
        FROM inference_results"""),
)
def run_metrics(spark, sf_dir):
    return reports.run_metrics(views.inference_results(spark, sf_dir))


@query(
    "w8_detection_timeline",
    with_views("inference_results", """
        SELECT video_id, frame_index, num_detections FROM inference_results WHERE error IS NULL"""),
)
def timeline(spark, sf_dir):
    return reports.detection_timeline(views.inference_results(spark, sf_dir))


@query(
    "w9_hotspot_frames",
    with_views("inference_results", """
        SELECT video_id, frame_index, num_detections, model_name FROM inference_results
        WHERE error IS NULL ORDER BY num_detections DESC, video_id, frame_index, model_name LIMIT 20"""),
)
def hotspots(spark, sf_dir):
    return reports.hotspot_frames(views.inference_results(spark, sf_dir))


@query(
    "p37_payload_field",
    with_views("inference_results", """
        SELECT video_id, frame_index, json_extract_string(result_json, '$.summary.count') AS summary_count
        FROM inference_results WHERE error IS NULL"""),
)
def payload_field(spark, sf_dir):
    return reports.payload_field(
        views.inference_results(spark, sf_dir), "$.summary.count", "summary_count"
    )


@query(
    "w12_latest_per_video",
    """SELECT o_custkey AS video_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS frame_index,
              arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1""",
)
def latest(spark, sf_dir):
    runs = views.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS video_id", "o_orderkey AS frame_index", "o_orderstatus AS status", "o_orderdate AS at"
    )
    return reports.latest_per_key(runs, ["video_id"], ["at", "frame_index"]).drop("at")


@query(
    "j6_analysis_with_video_title",
    """SELECT o_orderkey AS analysis_id, c_name AS video_title, o_orderstatus AS status
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def with_title(spark, sf_dir):
    runs = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS analysis_id", "o_custkey AS video_id", "o_orderstatus AS status"
    )
    videos = views.table(spark, sf_dir, "customer").selectExpr("c_custkey AS video_id", "c_name AS video_title")
    return runs.join(videos, "video_id").drop("video_id")


@query(
    "p36_owner_scope",
    """SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en'""",
)
def owner_scope(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return reports.owned_by(docs, source="src3", lang="en")


@query(
    "j4_frames_tracks_features",
    with_views("frames detections", """
        SELECT f.video_id, f.frame_index, f.width, t.n_tracks, e.max_area
        FROM frames f
        LEFT JOIN (SELECT video_id, frame_index, count(*) AS n_tracks FROM detections GROUP BY ALL) t
               USING (video_id, frame_index)
        LEFT JOIN (SELECT video_id, frame_index, max(area) AS max_area FROM detections
                   WHERE label = 'car' GROUP BY ALL) e USING (video_id, frame_index)"""),
)
def medallion(spark, sf_dir):
    from aerospark.sources.tables import join_frame_tables

    boxes = views.detections(spark, sf_dir)
    tracks = boxes.groupBy("video_id", "frame_index").agg(F.count("*").alias("n_tracks"))
    features = (
        boxes.filter("label = 'car'").groupBy("video_id", "frame_index").agg(F.max("area").alias("max_area"))
    )
    frames = views.frames(spark, sf_dir).select("video_id", "frame_index", "width")
    return join_frame_tables(frames, tracks, features)


MODELS = """
    models AS (
        SELECT n_name AS id,
               list_filter([CASE WHEN n_nationkey & 1 > 0 THEN 'automobile' END,
                            CASE WHEN n_nationkey & 2 > 0 THEN 'building' END,
                            CASE WHEN n_nationkey & 4 > 0 THEN 'furniture' END,
                            CASE WHEN n_nationkey & 8 > 0 THEN 'household' END,
                            CASE WHEN n_nationkey & 16 > 0 THEN 'machinery' END], lambda x: x IS NOT NULL) AS capabilities,
               CASE WHEN n_nationkey % 3 = 0 THEN 'segmentation' ELSE 'detection' END AS task,
               CASE n_nationkey % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS altitude,
               n_regionkey % 2 = 0 AS tiled
        FROM nation),
    requests AS (
        SELECT c_custkey AS request_id, lower(c_mktsegment) AS a,
               CASE c_custkey % 3 WHEN 0 THEN 'building' WHEN 1 THEN 'machinery' ELSE lower(c_mktsegment) END AS b,
               CASE WHEN c_acctbal > 0 THEN 'detection' ELSE 'segmentation' END AS task,
               CASE WHEN c_nationkey % 2 = 0 THEN 'high' ELSE 'low' END AS altitude,
               CASE WHEN c_acctbal > 5000 THEN 3840 ELSE 1280 END AS width
        FROM customer),
    scored AS (
        SELECT request_id, id AS model_id,
               3.0::DOUBLE * (len(list_filter(list_distinct([a, b]), lambda x: list_contains(capabilities, x)))
                   / len(list_distinct([a, b])))
               + CASE WHEN m.task = q.task THEN 1.5 ELSE 0 END
               + CASE WHEN m.altitude IN (q.altitude, 'any') THEN 1.0 ELSE 0 END
               + CASE WHEN width > 1920 AND tiled THEN 1.0 WHEN width <= 1920 AND NOT tiled THEN 0.25 ELSE 0 END AS score
        FROM requests q, models m),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(score, 9) DESC, model_id) AS rank
        FROM scored)"""


def catalog_of_nations(spark, sf_dir):
    """A fixed-size catalog: one model per nation."""
    bits = {1: "automobile", 2: "building", 4: "furniture", 8: "household", 16: "machinery"}
    capable = ", ".join(f"CASE WHEN n_nationkey & {b} > 0 THEN '{n}' END" for b, n in bits.items())
    return views.table(spark, sf_dir, "nation").selectExpr(
        "n_name AS id", f"array_compact(array({capable})) AS capabilities",
        "CASE WHEN n_nationkey % 3 = 0 THEN 'segmentation' ELSE 'detection' END AS task",
        "CASE n_nationkey % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS altitude",
        "n_regionkey % 2 = 0 AS tiled",
    )


def requests_of_customers(spark, sf_dir):
    return views.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS request_id",
        "array(c_mktsegment, CASE c_custkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'Machinery' "
        "ELSE c_mktsegment END) AS classes",
        "CASE WHEN c_acctbal > 0 THEN 'Detection' ELSE 'segmentation' END AS task",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'HIGH' ELSE 'low' END AS altitude",
        "CASE WHEN c_acctbal > 5000 THEN 3840 ELSE 1280 END AS width", "720 AS height",
    )


@query(
    "j8_rank_models",
    f"WITH {MODELS} SELECT request_id, CAST(rank AS INT) AS rank, model_id, round(score, 6) AS score FROM ranked",
)
def rank_models(spark, sf_dir):
    ranked = catalog.rank_models(requests_of_customers(spark, sf_dir), catalog_of_nations(spark, sf_dir))
    return ranked.select("request_id", "rank", "model_id", F.round("score", 6).alias("score"))


@query(
    "j8_select_model",
    f"WITH {MODELS} SELECT request_id, model_id, round(score, 6) AS score FROM ranked WHERE rank = 1",
)
def select_model(spark, sf_dir):
    chosen = catalog.select_model(requests_of_customers(spark, sf_dir), catalog_of_nations(spark, sf_dir))
    return chosen.select("request_id", "model_id", F.round("score", 6).alias("score"))


@query(
    "o3_capability_overlap",
    f"""WITH {MODELS}
        SELECT request_id, len(list_filter(list_distinct([a, b]), lambda x: x IN ('building', 'machinery')))::INT AS overlap
        FROM requests""",
)
def overlap(spark, sf_dir):
    wanted = F.array(F.lit("building"), F.lit("machinery"))
    asked = F.array_distinct(F.transform("classes", F.lower))
    return requests_of_customers(spark, sf_dir).select(
        "request_id", F.size(F.array_intersect(asked, wanted)).alias("overlap")
    )
