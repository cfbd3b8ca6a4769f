"""Whole analysis runs, and the crowded forms of suppression and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospark.operators import clustering, suppression
from aerospark.plans.analysis import Footage, run_events, run_routines
from workload import views
from workload.geometry_queries import BY_FRAME, INSIDE, density_sql
from workload.registry import query
from workload.views import with_views

FRAME = ["video_id", "frame_index"]


def footage(spark, sf_dir):
    boxes = views.detections(spark, sf_dir)
    return Footage(
        frames=views.frames(spark, sf_dir), detections=boxes, zones=views.zones(spark, sf_dir),
        vectors=boxes.select(*FRAME, "vx", "vy"),
    )


SAMPLED = """
    sampled AS (
        SELECT video_id, frame_index, rn FROM (
            SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS rn
            FROM frames WHERE frame_index % 3 = 0))"""


@query(
    "u5_run_routines",
    density_sql(BY_FRAME, 60.0, 3, f""", frames AS ({views.SQL["frames"]}), zones AS ({views.SQL["zones"]}), {SAMPLED}, {INSIDE},
        counted AS (SELECT video_id, frame_index, zone, count(*) AS n FROM hits GROUP BY ALL),
        zoned AS (
            SELECT s.video_id, s.frame_index, z.zone AS name, coalesce(c.n, 0) AS value FROM sampled s CROSS JOIN zones z
            LEFT JOIN counted c ON c.video_id = s.video_id AND c.frame_index = s.frame_index AND c.zone = z.zone),
        groups AS (
            SELECT video_id, frame_index, count(*) AS n_points, max(cluster) + 1 AS n_clusters, count_if(cluster = -1) AS n_noise
            FROM clustered GROUP BY ALL),
        grouped AS (
            SELECT s.video_id, s.frame_index, coalesce(n_points, 0) AS n_points, coalesce(n_clusters, 0) AS n_clusters,
                   coalesce(n_noise, 0) AS n_noise FROM sampled s LEFT JOIN groups USING (video_id, frame_index)),
        moved AS (
            SELECT d.video_id, d.frame_index, sqrt(vx * vx + vy * vy) AS m,
                   CASE WHEN degrees(atan2(vy, vx)) < 0 THEN degrees(atan2(vy, vx)) + 360 ELSE degrees(atan2(vy, vx)) END AS a
            FROM detections d JOIN sampled s USING (video_id, frame_index) WHERE s.rn > 1),
        flow AS (
            SELECT video_id, frame_index, avg(m) AS mean_magnitude, median(m) AS median_magnitude, max(m) AS max_magnitude,
                   CASE WHEN sum(m) > 0 THEN sum(a * m) / sum(m) ELSE 0 END AS dominant_direction_deg FROM moved GROUP BY ALL)
        SELECT 'zone_counting' AS routine, 'frame' AS level, video_id, frame_index, name, value::DOUBLE AS value FROM zoned
        UNION ALL SELECT 'zone_counting', 'frame', video_id, frame_index, 'total', sum(value)::DOUBLE FROM zoned GROUP BY ALL
        UNION ALL SELECT 'spatial_clustering', 'frame', video_id, frame_index, name, value::DOUBLE FROM (
            UNPIVOT grouped ON n_points, n_clusters, n_noise INTO NAME name VALUE value)
        UNION ALL SELECT 'optical_flow', 'frame_pair', video_id, frame_index, name, round(value, 6) FROM (
            UNPIVOT flow ON mean_magnitude, median_magnitude, max_magnitude, dominant_direction_deg INTO NAME name VALUE value)
        """),
)
def run_by_name(spark, sf_dir):
    names = ["zone_counting", "spatial_clustering", "optical_flow"]
    params = {"spatial_clustering": {"eps": 60.0, "min_samples": 3}}
    summaries, _, _ = run_routines(footage(spark, sf_dir), names, params, frame_step=3)
    return summaries.select(
        "routine", "level", *FRAME, F.explode("summary").alias("name", "value")
    ).withColumn("value", F.round("value", 6))


@query(
    "u5_zone_events_of_run",
    with_views("frames detections", """
        WITH sampled AS (
            SELECT video_id, frame_index FROM (
                SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS rn
                FROM frames WHERE frame_index % 3 = 0))
        SELECT 'routine:zone_counting' AS source, s.video_id, s.frame_index,
               'video:' || s.video_id || '|frame:' || s.frame_index AS correlation_key,
               count(d.det_seq)::DOUBLE AS n, coalesce(sum(d.area), 0) AS total_area,
               round((s.frame_index + 3) / 30.0, 6) AS segment_end
        FROM sampled s LEFT JOIN detections d USING (video_id, frame_index) GROUP BY ALL"""),
)
def zone_events(spark, sf_dir):
    tables = run_routines(footage(spark, sf_dir), ["zone_counting"], frame_step=3)
    run = views.frames(spark, sf_dir).select("video_id").distinct().selectExpr(
        "video_id", "md5(cast(video_id AS string)) AS trace_id", "video_id + 100 AS analysis_id",
        "30.0D AS fps", "3 AS frame_step",
    )
    events = run_events(*tables, run)
    return events.select(
        "source", *FRAME, "correlation_key", F.col("metrics")["count"].alias("n"),
        F.col("metrics")["total_area"].alias("total_area"), F.round("segment_end", 6).alias("segment_end"),
    )


@query("w2_suppress_crowded_video")
def suppress_crowded(spark, sf_dir):
    """All boxes of a video as one crowded picture: solved in rounds over grid cells."""
    boxes = views.detections(spark, sf_dir).withColumn("det_seq", F.struct("frame_index", "det_seq"))
    kept = suppression.suppress(boxes, keys=["video_id"])
    return kept.select("video_id", "frame_index", F.col("det_seq.det_seq").alias("det_seq"))


@query(
    "m3_density_clusters_per_video",
    density_sql("""
        SELECT video_id AS grp, row_number() OVER (PARTITION BY video_id ORDER BY frame_index, det_seq) AS id,
               cx AS x, cy AS y, video_id, frame_index, det_seq FROM detections""",
        3.0, 8, "SELECT video_id, frame_index, det_seq, cluster FROM clustered"),
)
def clusters_per_video(spark, sf_dir):
    """All centres of a video as one crowded picture: solved by joins on a grid."""
    points = views.detections(spark, sf_dir).select(
        "video_id", F.struct("frame_index", "det_seq").alias("point"),
        F.col("cx").alias("x"), F.col("cy").alias("y"),
    )
    found = clustering.cluster_points(points, ["video_id"], "point", eps=3.0, min_samples=8)
    return found.select("video_id", "point.*", "cluster")
