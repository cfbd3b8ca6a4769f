"""Queries over frames, tiles and the commentary made from routine results."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospark.operators import commentary, frames as frame_ops, reports, tiles
from workload import views
from workload.registry import query
from workload.views import with_views

FPS = 30.0


def described(spark, sf_dir, routine="color_detection"):
    """Routine results for every frame: failed where the order is pending."""
    orders = views.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey % 10 AS video_id", "o_orderkey div 10 AS frame_index",
        f"'{routine}' AS routine",
        "CASE WHEN o_orderstatus = 'P' THEN 'boom' END AS error",
        "map('altitude', o_totalprice, 'count', -1.0D) AS summary",
        "md5(cast(o_orderkey % 10 AS string)) AS trace_id", "o_orderkey % 10 + 100 AS analysis_id",
        f"{FPS}D AS fps", "30 AS frame_step",
    )
    return commentary.describe_frames(orders, views.detections(spark, sf_dir))


def motion(spark, sf_dir):
    """Cars of a frame stand for its moving objects."""
    base = views.frames(spark, sf_dir).select("video_id", "frame_index")
    cars = (
        views.detections(spark, sf_dir).filter("label = 'car'")
        .groupBy("video_id", "frame_index").agg(F.count("*").alias("n"))
    )
    return base.join(cars, ["video_id", "frame_index"], "left").selectExpr(
        "'background_subtraction' AS routine", "video_id", "frame_index",
        "coalesce(n, 0L) AS moving", "md5(cast(video_id AS string)) AS trace_id",
        "video_id + 100 AS analysis_id", f"{FPS}D AS fps", "30 AS frame_step",
    )


DESCRIBED = """
    , per_label AS (
        SELECT video_id, frame_index, label, count(*) AS n, sum(area) AS area,
               sum(score) AS score, max(score) AS best FROM detections GROUP BY ALL),
    per_frame AS (
        SELECT video_id, frame_index, sum(n)::BIGINT AS n, sum(area) AS area, sum(score) AS score,
               max(best) AS best, string_agg(n || ' ' || label, ', ' ORDER BY label) AS phrase,
               string_agg(label, ',' ORDER BY label) AS labels
        FROM per_label GROUP BY ALL),
    described AS (
        SELECT o_orderkey % 10 AS video_id, o_orderkey // 10 AS frame_index,
               CASE WHEN o_orderstatus = 'P' THEN 'boom' END AS error, o_totalprice AS altitude,
               coalesce(n, 0) AS n, coalesce(area, 0) AS area, coalesce(score, 0) AS score,
               coalesce(best, 0) AS best, coalesce(phrase, 'no objects') AS phrase,
               coalesce(labels, '') AS labels, phrase AS raw_phrase
        FROM orders LEFT JOIN per_frame f
          ON f.video_id = o_orderkey % 10 AND f.frame_index = o_orderkey // 10),
    motion AS (
        SELECT o_orderkey % 10 AS video_id, o_orderkey // 10 AS frame_index,
               coalesce((SELECT sum(n) FROM per_label l WHERE l.label = 'car'
                   AND l.video_id = o_orderkey % 10 AND l.frame_index = o_orderkey // 10), 0)::BIGINT AS moving
        FROM orders)"""


def described_sql(body: str) -> str:
    return with_views("detections", "SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + DESCRIBED + body


@query(
    "s9_sample_frames",
    with_views("frames", """
        SELECT video_id, frame_index FROM (
            SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS rn
            FROM frames WHERE frame_index % 3 = 0) WHERE rn <= 300"""),
)
def sampled(spark, sf_dir):
    kept = frame_ops.sample_frames(views.frames(spark, sf_dir), step=3, max_frames=300)
    return kept.select("video_id", "frame_index")


@query(
    "s10_video_metadata",
    with_views("frames", """
        SELECT video_id, round((max(frame_index) - min(frame_index)) / (max(timestamp) - min(timestamp)), 6) AS fps,
               count(*) AS frame_count, max(width) AS width, max(height) AS height
        FROM frames GROUP BY video_id"""),
)
def metadata(spark, sf_dir):
    return frame_ops.video_metadata(views.frames(spark, sf_dir)).withColumn("fps", F.round("fps", 6))


@query(
    "j9_previous_sampled_frame",
    with_views("frames", """
        SELECT * FROM (
            SELECT video_id, frame_index, altitude,
                   lag(frame_index) OVER w AS prev_frame_index, lag(altitude) OVER w AS prev_altitude
            FROM frames WHERE frame_index % 7 = 0
            WINDOW w AS (PARTITION BY video_id ORDER BY frame_index))
        WHERE prev_frame_index IS NOT NULL"""),
)
def previous(spark, sf_dir):
    kept = frame_ops.sample_frames(views.frames(spark, sf_dir), step=7, max_frames=None)
    return frame_ops.frame_pairs(kept.select("video_id", "frame_index", "altitude"), ["altitude"])


@query(
    "w1_previous_event_of_video",
    with_views("commentary_events", """
        SELECT video_id, event_id, lag(event_id) OVER w AS prev_event_id
        FROM (SELECT video_id, CAST(event_id AS BIGINT) AS event_id FROM commentary_events)
        WINDOW w AS (PARTITION BY video_id ORDER BY event_id)"""),
)
def previous_event(spark, sf_dir):
    from aerospark.scale import previous_in_order

    events = views.commentary_events(spark, sf_dir).selectExpr(
        "video_id", "cast(event_id AS bigint) AS event_id"
    )
    return previous_in_order(events, ["video_id"], "event_id", [])


CONTIGUOUS = """
    stored AS (SELECT DISTINCT video_id, frame_index FROM detections),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) - 1 AS rn FROM stored),
    contiguous AS (SELECT video_id, CAST(count_if(rn = frame_index) AS BIGINT) AS frame_count
                   FROM ranked GROUP BY video_id)"""


@query(
    "w11_contiguous_frames",
    with_views("detections", f"WITH {CONTIGUOUS} SELECT video_id, frame_count FROM contiguous"),
)
def contiguous(spark, sf_dir):
    return frame_ops.contiguous_frames(views.detections(spark, sf_dir))


@query(
    "w10_representative_frames",
    with_views("detections", f"""WITH {CONTIGUOUS}
        SELECT video_id, 0 AS choice, 0::BIGINT AS frame_index FROM contiguous WHERE frame_count > 0
        UNION ALL SELECT video_id, 1, frame_count // 2 FROM contiguous WHERE frame_count > 0
        UNION ALL SELECT video_id, 2, frame_count - 1 FROM contiguous WHERE frame_count > 0
        UNION ALL SELECT video_id, i::INT, i FROM contiguous, range(20) t(i) WHERE frame_count = 0"""),
)
def representative(spark, sf_dir):
    return frame_ops.representative_frames(
        frame_ops.contiguous_frames(views.detections(spark, sf_dir))
    )


@query(
    "g1_clamped_tiles",
    with_views("frames", """
        WITH rows_ AS (
            SELECT *, least(j * 512, greatest(0, height - 640)) AS tile_y
            FROM frames, range(20) t(j) WHERE j <= ceil(greatest(0, height - 640) / 512.0)),
        both_ AS (
            SELECT *, least(i * 512, greatest(0, width - 640)) AS tile_x
            FROM rows_, range(20) s(i) WHERE i <= ceil(greatest(0, width - 640) / 512.0))
        SELECT video_id, frame_index, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y,
               CAST(least(tile_x + 640, width) - tile_x AS INT) AS tile_w,
               CAST(least(tile_y + 640, height) - tile_y AS INT) AS tile_h FROM both_"""),
)
def clamped(spark, sf_dir):
    grid = tiles.clamped_tiles(views.frames(spark, sf_dir).select("video_id", "frame_index", "width", "height"))
    return grid.select("video_id", "frame_index", "tile_x", "tile_y", "tile_w", "tile_h")


@query(
    "g2_ragged_tiles",
    with_views("frames", """
        SELECT video_id, frame_index, CAST(i AS INT) AS tile_x, CAST(j AS INT) AS tile_y,
               CAST(least(i + 640, width) - i AS INT) AS tile_w,
               CAST(least(j + 480, height) - j AS INT) AS tile_h
        FROM frames, range(0, 2000, 512) s(i), range(0, 2000, 384) t(j)
        WHERE i < greatest(1, width - 1) AND j < greatest(1, height - 1)"""),
)
def ragged(spark, sf_dir):
    grid = tiles.ragged_tiles(
        views.frames(spark, sf_dir).select("video_id", "frame_index", "width", "height"), (640, 480)
    )
    return grid.select("video_id", "frame_index", "tile_x", "tile_y", "tile_w", "tile_h")


@query(
    "p33_tile_to_frame",
    with_views("detections", """
        SELECT video_id, frame_index, det_seq, x + CAST(frame_index % 3 AS INT) * 100 AS x,
               y + CAST(frame_index % 2 AS INT) * 50 AS y, cx + frame_index % 3 * 100 AS cx,
               cy + frame_index % 2 * 50 AS cy FROM detections"""),
)
def tile_offset(spark, sf_dir):
    local = views.detections(spark, sf_dir).selectExpr(
        "*", "cast(frame_index % 3 AS int) * 100 AS tile_x", "cast(frame_index % 2 AS int) * 50 AS tile_y"
    )
    return tiles.to_frame(local).select("video_id", "frame_index", "det_seq", "x", "y", "cx", "cy")


@query(
    "a2_derived_metrics",
    described_sql("""
        SELECT video_id, frame_index, n::DOUBLE AS n, area AS total_area,
               round(CASE WHEN n > 0 THEN area / n ELSE 0 END, 6) AS mean_area,
               round(CASE WHEN n > 0 THEN score / n ELSE 0 END, 6) AS mean_score, best AS max_score
        FROM described"""),
)
def derived_metrics(spark, sf_dir):
    return described(spark, sf_dir).select(
        "video_id", "frame_index", F.col("count").alias("n"), "total_area",
        F.round("mean_area", 6).alias("mean_area"), F.round("mean_score", 6).alias("mean_score"),
        "max_score",
    )


@query(
    "a3_labels_per_frame",
    described_sql("SELECT video_id, frame_index, labels, phrase FROM described"),
)
def labels_per_frame(spark, sf_dir):
    return described(spark, sf_dir).select(
        "video_id", "frame_index", F.array_join("labels.label", ",").alias("labels"),
        commentary.labels_phrase(F.col("labels")).alias("phrase"),
    )


@query(
    "a3_label_counts",
    with_views("detections", """
        SELECT video_id, frame_index, label, count(*) AS n FROM detections GROUP BY ALL"""),
)
def label_counts(spark, sf_dir):
    return commentary.label_counts(views.detections(spark, sf_dir))


EVENTS_SQL = """
    SELECT 'routine:color_detection' AS source, video_id, frame_index,
           'video:' || video_id || '|frame:' || frame_index AS correlation_key,
           round(frame_index / 30.0, 6) AS segment_start,
           round((frame_index + 30) / 30.0, 6) AS segment_end,
           CASE WHEN error IS NOT NULL THEN 'Routine ''color_detection'' failed: boom'
                ELSE 'color_detection detected ' || phrase || ' in frame ' || frame_index || '.' END AS commentary,
           CASE WHEN error IS NULL THEN n::DOUBLE END AS n,
           CASE WHEN error IS NULL THEN round(area, 4) END AS total_area,
           CASE WHEN error IS NULL THEN altitude END AS altitude
    FROM described
    UNION ALL
    SELECT 'routine:background_subtraction', video_id, frame_index,
           'video:' || video_id || '|frame:' || frame_index, round(frame_index / 30.0, 6),
           round((frame_index + 30) / 30.0, 6),
           'background_subtraction observed ' || moving || ' moving object(s) in frame ' || frame_index || '.',
           moving::DOUBLE, NULL, NULL
    FROM motion WHERE moving > 0
    UNION ALL
    SELECT 'routine:background_subtraction', video_id, NULL,
           'video:' || video_id || '|routine:background_subtraction', NULL, NULL,
           'background_subtraction processed ' || count(*) || ' frame(s); ' || sum(moving)
               || ' total moving detection(s).', NULL, NULL, NULL
    FROM motion GROUP BY video_id"""


@query("g4_events_from_results", described_sql(EVENTS_SQL))
def events_from_results(spark, sf_dir):
    made = commentary.frame_events(described(spark, sf_dir)).unionByName(
        commentary.motion_events(motion(spark, sf_dir))
    )
    metric = F.col("metrics")
    return made.select(
        "source", "video_id", "frame_index", "correlation_key",
        F.round("segment_start", 6).alias("segment_start"),
        F.round("segment_end", 6).alias("segment_end"), "commentary",
        metric["count"].alias("n"), F.round(metric["total_area"], 4).alias("total_area"),
        metric["altitude"].alias("altitude"),
    )


@query(
    "o1_union_of_event_kinds",
    described_sql(f"""
        SELECT source, count(*) AS events, count(frame_index) AS with_frame
        FROM ({EVENTS_SQL}) GROUP BY source"""),
)
def union_of_kinds(spark, sf_dir):
    made = commentary.frame_events(described(spark, sf_dir)).unionByName(
        commentary.motion_events(motion(spark, sf_dir))
    )
    return made.groupBy("source").agg(
        F.count("*").alias("events"), F.count("frame_index").alias("with_frame")
    )


@query(
    "p18_commentary_default_routine",
    described_sql("""
        SELECT video_id, frame_index,
               CASE WHEN error IS NOT NULL THEN 'Routine ''custom'' failed: boom'
                    ELSE 'Routine ''custom'' produced ' || n || ' detection(s).' END AS commentary
        FROM described"""),
)
def default_commentary(spark, sf_dir):
    results = described(spark, sf_dir, "custom")
    return results.select(
        "video_id", "frame_index", commentary.commentary_text(results.columns).alias("commentary")
    )


@query(
    "p19_summary_in_metrics",
    described_sql("""
        SELECT video_id, frame_index, n::DOUBLE AS n, altitude FROM described"""),
)
def folded_summary(spark, sf_dir):
    folded = described(spark, sf_dir).withColumn("m", commentary.fold_summary(F.col("summary")))
    return folded.select(
        "video_id", "frame_index", F.col("m.count").alias("n"), F.col("m.altitude").alias("altitude")
    )


@query(
    "p20_model_prompt",
    described_sql("""
        SELECT video_id, frame_index, 'Routine: color_detection' || chr(10) || 'Frame: ' || frame_index
               || chr(10) || 'Detections by label: ' || coalesce(raw_phrase, 'none') || chr(10)
               || 'Total detections: ' || n AS prompt FROM described"""),
)
def model_prompt(spark, sf_dir):
    plain = described(spark, sf_dir).withColumn("summary", F.create_map().cast("map<string,double>"))
    return plain.select("video_id", "frame_index", commentary.prompt_text().alias("prompt"))


@query(
    "u2_echo_commentary",
    described_sql("""
        SELECT video_id, frame_index,
               CASE WHEN error IS NULL THEN 'agent:vlm' ELSE 'routine:color_detection' END AS source,
               CASE WHEN error IS NULL THEN '[echo] Routine: color_detection'
                    ELSE 'Routine ''color_detection'' failed: boom' END AS commentary,
               round((frame_index + 30) / 30.0, 6) AS segment_end FROM described"""),
)
def echo_commentary(spark, sf_dir):
    made = commentary.echo_commentary(described(spark, sf_dir))
    return made.select(
        "video_id", "frame_index", "source", "commentary",
        F.round("segment_end", 6).alias("segment_end"),
    )


@query(
    "a4_objects_detected",
    described_sql("""
        SELECT video_id, CAST(sum(n) AS BIGINT) AS objects_detected FROM (
            SELECT video_id, count(*) AS n FROM detections GROUP BY 1
            UNION ALL SELECT video_id, sum(moving) FROM motion GROUP BY 1) GROUP BY 1"""),
)
def objects_detected(spark, sf_dir):
    return commentary.objects_detected(views.detections(spark, sf_dir), motion(spark, sf_dir))


@query(
    "a11_moving_totals",
    described_sql("""
        SELECT video_id, count(*) AS frames_processed, CAST(sum(moving) AS BIGINT) AS total_moving
        FROM motion GROUP BY 1"""),
)
def moving_totals(spark, sf_dir):
    totals = commentary.moving_totals(motion(spark, sf_dir))
    return totals.select("video_id", "frames_processed", "total_moving")


@query(
    "p8_correlation_keys",
    with_views("commentary_events", """
        SELECT event_id, 'video:' || video_id || '|frame:' || frame_index AS both_parts,
               'frame:' || frame_index AS frame_only, trace_id AS neither,
               'video:' || video_id || '|routine:' || kind AS rollup,
               'video:' || video_id || '|scope:video' AS summary,
               'trace:' || trace_id || '|scope:trace' AS trace_summary
        FROM commentary_events"""),
)
def correlation_keys(spark, sf_dir):
    from aerospark.functions.events import correlation_key, rollup_key, summary_key

    none = F.lit(None).cast("long")
    video, frame, trace = F.col("video_id"), F.col("frame_index"), F.col("trace_id")
    return views.commentary_events(spark, sf_dir).select(
        "event_id", correlation_key(video, frame, trace).alias("both_parts"),
        correlation_key(none, frame, trace).alias("frame_only"),
        correlation_key(none, none, trace).alias("neither"),
        rollup_key(video, F.substring("source", 9, 40)).alias("rollup"),
        summary_key(video, trace, "video").alias("summary"),
        summary_key(none, trace, "trace").alias("trace_summary"),
    )


@query(
    "p9_temporal_segments",
    with_views("frames", """
        SELECT video_id, frame_index, round(frame_index / 24.0, 6) AS starts,
               round((frame_index + 8) / 24.0, 6) AS ends, round((frame_index + 1) / 24.0, 6) AS single,
               NULL::DOUBLE AS unknown FROM frames"""),
)
def temporal_segments(spark, sf_dir):
    from aerospark.functions.events import segment_end, segment_start

    frame, fps = F.col("frame_index"), F.lit(24)
    return views.frames(spark, sf_dir).select(
        "video_id", "frame_index", F.round(segment_start(frame, fps), 6).alias("starts"),
        F.round(segment_end(frame, fps, F.lit(8)), 6).alias("ends"),
        F.round(segment_end(frame, fps, F.lit(None).cast("int")), 6).alias("single"),
        segment_start(frame, F.lit(0)).alias("unknown"),
    )


@query(
    "j5_detections_with_commentary",
    described_sql("""
        SELECT d.video_id, d.frame_index, d.det_seq, d.label,
               CASE WHEN error IS NOT NULL THEN 'Routine ''color_detection'' failed: boom'
                    ELSE 'color_detection detected ' || phrase || ' in frame ' || frame_index || '.' END AS commentary
        FROM detections d JOIN described USING (video_id, frame_index)"""),
)
def detections_with_commentary(spark, sf_dir):
    from aerospark.functions.events import correlation_key
    from aerospark.operators.digest import correlate

    boxes = views.detections(spark, sf_dir).select(
        "video_id", "frame_index", "det_seq", "label",
        correlation_key(F.col("video_id"), F.col("frame_index"), F.lit(None)).alias("correlation_key"),
    )
    events = commentary.frame_events(described(spark, sf_dir)).select("correlation_key", "commentary")
    return correlate(boxes, events).drop("correlation_key")


@query(
    "w4_detections_by_area",
    with_views("detections", "SELECT video_id, frame_index, det_seq, area FROM detections"),
)
def by_area(spark, sf_dir):
    return reports.by_area(views.detections(spark, sf_dir)).select(
        "video_id", "frame_index", "det_seq", "area"
    )


@query(
    "p34_detection_search",
    with_views("detections", """
        SELECT video_id, frame_index, det_seq, score FROM detections
        WHERE label = 'car' AND frame_index / 30.0 >= 10 AND score >= 0.95
          AND cx BETWEEN 50 AND 150 AND cy BETWEEN 40 AND 160"""),
)
def detection_search(spark, sf_dir):
    timed = views.detections(spark, sf_dir).withColumn("timestamp", F.col("frame_index") / F.lit(30.0))
    found = reports.search_detections(timed, "car", 10.0, 0.95, (50.0, 40.0, 150.0, 160.0))
    return found.select("video_id", "frame_index", "det_seq", "score")


@query(
    "p35_observation_sentences",
    with_views("detections", """
        SELECT video_id, frame_index, det_seq, 'At ' || frame_index || ', detected ' || label
               || ' (confidence ' || printf('%.2f', score) || ') at [' || x || ', ' || y || ', '
               || w || ', ' || h || ']' AS sentence FROM detections"""),
)
def observations(spark, sf_dir):
    timed = views.detections(spark, sf_dir).withColumn("timestamp", F.col("frame_index"))
    return timed.select(
        "video_id", "frame_index", "det_seq", reports.observation_sentence().alias("sentence")
    )
