"""Queries over zones, suppression, clusters, tracks, motion and homographies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from aerospark.operators import clustering, homography, motion, suppression, tracking, zones
from aerospark.scale import durable
from workload import views
from workload.registry import query
from workload.views import with_views

FRAME = ["video_id", "frame_index"]

INSIDE = """
    hits AS (
        SELECT d.video_id, d.frame_index, d.det_seq, z.zone FROM detections d JOIN zones z
          ON cx > x0 AND cx < x0 + 60 AND cy > y0 AND cy < y0 + 55
         AND 30 * (cy - y0) - 55 * (cx - x0) < 0
         AND -30 * (cy - y0) - 55 * (cx - x0 - 60) > 0)"""


@query(
    "j1_detections_in_zones",
    with_views("detections zones", f"WITH {INSIDE} SELECT video_id, frame_index, det_seq, zone FROM hits"),
)
def in_zones(spark, sf_dir):
    found = zones.detections_in_zones(views.detections(spark, sf_dir), views.zones(spark, sf_dir))
    return found.select(*FRAME, "det_seq", "zone")


@query(
    "a7_zone_counts",
    with_views("frames detections zones", f"""WITH {INSIDE},
        counted AS (SELECT video_id, frame_index, zone, count(*) AS n FROM hits GROUP BY ALL),
        every AS (
            SELECT f.video_id, f.frame_index, z.zone, coalesce(n, 0) AS n
            FROM frames f CROSS JOIN zones z LEFT JOIN counted c
              ON c.video_id = f.video_id AND c.frame_index = f.frame_index AND c.zone = z.zone)
        SELECT video_id, frame_index, CAST(sum(n) AS BIGINT) AS total,
               'Zone occupancy — ' || string_agg(zone || '=' || n, ', ' ORDER BY zone) || '.' AS phrase
        FROM every GROUP BY ALL"""),
)
def zone_counts(spark, sf_dir):
    from aerospark.operators.commentary import zone_phrase

    frames = views.frames(spark, sf_dir).select(*FRAME)
    counted = zones.zone_counts(frames, views.detections(spark, sf_dir), views.zones(spark, sf_dir))
    return counted.select(*FRAME, "total", zone_phrase(F.col("zones")).alias("phrase"))


@query(
    "a7_zone_counts_per_video",
    with_views("frames detections zones", f"""WITH {INSIDE},
        numbered AS (SELECT zone, CAST((row_number() OVER (ORDER BY zone) - 1) % 10 AS BIGINT) AS video_id FROM zones),
        counted AS (SELECT video_id, frame_index, zone, count(*) AS n FROM hits GROUP BY ALL)
        SELECT f.video_id, f.frame_index, CAST(sum(coalesce(n, 0)) AS BIGINT) AS total, count(*) AS zones
        FROM frames f JOIN numbered z USING (video_id) LEFT JOIN counted c
          ON c.video_id = f.video_id AND c.frame_index = f.frame_index AND c.zone = z.zone GROUP BY ALL"""),
)
def zone_counts_per_video(spark, sf_dir):
    """Every video has zones of its own."""
    own = views.zones(spark, sf_dir).withColumn(
        "video_id", ((F.row_number().over(Window.orderBy("zone")) - 1) % 10).cast("bigint")
    )
    frames = views.frames(spark, sf_dir).select(*FRAME)
    counted = zones.zone_counts(frames, views.detections(spark, sf_dir), own)
    return counted.select(*FRAME, "total", F.size("zones").cast("bigint").alias("zones"))


def nms_sql(threshold: float, group: str, body: str) -> str:
    """Greedy suppression as a recursion over the rank of a box in its group."""
    overlap = (
        "greatest(0, least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x))"
        " * greatest(0, least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y))"
    )
    covered = (
        f"len(list_filter(n.kept, lambda k: ({overlap}) / "
        f"(k.w * k.h + r.w * r.h - ({overlap}))::DOUBLE >= {threshold})) > 0"
    )
    using = " AND ".join(f"r.{c.strip()} = n.{c.strip()}" for c in group.split(","))
    cols = ", ".join(f"r.{c.strip()}" for c in group.split(","))
    box = "{'x': r.x, 'y': r.y, 'w': r.w, 'h': r.h, 'seq': r.det_seq, 'score': r.score}"
    return with_views("detections", f"""WITH RECURSIVE ranked AS (
            SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY score DESC, det_seq) AS rn FROM detections),
        nms AS (
            SELECT {cols}, rn, det_seq, true AS keep, [{box}] AS kept FROM ranked r WHERE rn = 1
            UNION ALL
            SELECT {cols}, r.rn, r.det_seq, NOT ({covered}),
                   CASE WHEN {covered} THEN n.kept ELSE list_append(n.kept, {box}) END
            FROM nms n JOIN ranked r ON {using} AND r.rn = n.rn + 1)
        {body}""")


@query(
    "w2_suppress_any_label",
    nms_sql(0.2, "video_id, frame_index", "SELECT video_id, frame_index, det_seq FROM nms WHERE keep"),
)
def suppress_any(spark, sf_dir):
    return suppression.suppress(views.detections(spark, sf_dir), 0.2).select(*FRAME, "det_seq")


@query(
    "w3_suppress_per_label",
    nms_sql(0.2, "video_id, frame_index, label", "SELECT video_id, frame_index, label, det_seq FROM nms WHERE keep"),
)
def suppress_per_label(spark, sf_dir):
    kept = suppression.suppress(views.detections(spark, sf_dir), 0.2, per_label=True)
    return kept.select(*FRAME, "label", "det_seq")


@query(
    "o2_merged_tile_detections",
    nms_sql(0.45, "video_id, frame_index", "SELECT video_id, frame_index, count(*) AS kept FROM nms WHERE keep GROUP BY ALL"),
)
def merged_tiles(spark, sf_dir):
    """Boxes cut into tile-local coordinates, moved back, and merged."""
    from aerospark.operators.tiles import to_frame

    local = views.detections(spark, sf_dir).selectExpr(
        "* EXCEPT (x, y, cx, cy)", "x - x div 100 * 100 AS x", "y - y div 100 * 100 AS y",
        "cx - x div 100 * 100 AS cx", "cy - y div 100 * 100 AS cy",
        "x div 100 * 100 AS tile_x", "y div 100 * 100 AS tile_y",
    ).withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int"),
                   "tile_x": F.col("tile_x").cast("int"), "tile_y": F.col("tile_y").cast("int")})
    merged = suppression.suppress(to_frame(local))
    return merged.groupBy(*FRAME).agg(F.count("*").alias("kept"))


@query(
    "j2_suppressed_with_suppressor",
    nms_sql(0.2, "video_id, frame_index", """
        , pairs AS (
            SELECT d.video_id, d.frame_index, d.det_seq, k.score, k.det_seq AS by_seq,
                   greatest(0, least(k.x + k.w, d.x + d.w) - greatest(k.x, d.x))
                     * greatest(0, least(k.y + k.h, d.y + d.h) - greatest(k.y, d.y)) AS shared,
                   k.w * k.h + d.w * d.h AS areas, d.rn AS rn, k.rn AS krn
            FROM ranked d JOIN nms n ON n.video_id = d.video_id AND n.frame_index = d.frame_index
                 AND n.det_seq = d.det_seq AND NOT n.keep
            JOIN ranked k ON k.video_id = d.video_id AND k.frame_index = d.frame_index
            JOIN nms nk ON nk.video_id = k.video_id AND nk.frame_index = k.frame_index
                 AND nk.det_seq = k.det_seq AND nk.keep),
        first_ AS (
            SELECT *, row_number() OVER (PARTITION BY video_id, frame_index, det_seq ORDER BY krn) AS pick
            FROM pairs WHERE krn < rn AND shared / (areas - shared)::DOUBLE >= 0.2)
        SELECT video_id, frame_index, det_seq, by_seq AS suppressed_by,
               round(shared / (areas - shared)::DOUBLE, 6) AS iou FROM first_ WHERE pick = 1"""),
)
def suppressed_with_suppressor(spark, sf_dir):
    boxes = views.detections(spark, sf_dir)
    kept = suppression.suppress(boxes, 0.2)
    return suppression.suppressors(boxes, kept, 0.2).withColumn("iou", F.round("iou", 6))


EPS, MIN_SAMPLES = 60.0, 3

def density_sql(points: str, eps: float, minimum: int, body: str) -> str:
    """Clusters by definition over ``points(grp, id, x, y)``: pairs, core points, reach."""
    return with_views("detections", f"""WITH RECURSIVE points AS ({points}),
    near AS (
        SELECT a.grp, a.id AS a, b.id AS b FROM points a JOIN points b ON a.grp = b.grp
         AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps} * {eps}),
    counts AS (SELECT grp, a, count(*) AS n FROM near GROUP BY ALL),
    core AS (SELECT grp, a FROM counts WHERE n >= {minimum}),
    links AS (
        SELECT n.* FROM near n JOIN core c ON c.grp = n.grp AND c.a = n.a
        JOIN core d ON d.grp = n.grp AND d.a = n.b),
    reach AS (
        SELECT grp, a, a AS root FROM core
        UNION
        SELECT l.grp, l.b, r.root FROM reach r JOIN links l ON l.grp = r.grp AND l.a = r.a),
    rooted AS (SELECT grp, a, min(root) AS root FROM reach GROUP BY ALL),
    numbered AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY root) - 1 AS cluster FROM rooted),
    member AS (
        SELECT n.grp, n.a, min(c.cluster) AS cluster FROM near n JOIN numbered c ON c.grp = n.grp AND c.a = n.b
        GROUP BY ALL),
    clustered AS (
        SELECT p.*, CAST(coalesce(own.cluster, m.cluster, -1) AS INT) AS cluster FROM points p
        LEFT JOIN numbered own ON own.grp = p.grp AND own.a = p.id
        LEFT JOIN member m ON m.grp = p.grp AND m.a = p.id)
    {body}""")


BY_FRAME = """
    SELECT video_id * 100000000 + frame_index AS grp, det_seq AS id, cx AS x, cy AS y,
           video_id, frame_index, det_seq FROM detections"""


def frame_density(body: str) -> str:
    return density_sql(BY_FRAME, EPS, MIN_SAMPLES, body)


def centres(spark, sf_dir):
    return views.detections(spark, sf_dir).selectExpr(*FRAME, "det_seq", "cx AS x", "cy AS y")


@query(
    "j10_neighbour_counts",
    frame_density("""
        SELECT DISTINCT p.video_id, p.frame_index, p.x, p.y, c.n AS neighbours
        FROM counts c JOIN points p ON p.grp = c.grp AND p.id = c.a"""),
)
def neighbours(spark, sf_dir):
    side = EPS / 2
    placed = centres(spark, sf_dir).groupBy(*FRAME, "x", "y").agg(F.count("*").alias("weight")).withColumns(
        {"i": F.floor(F.col("x") / side), "j": F.floor(F.col("y") / side)}
    )
    return clustering.neighbour_counts(placed, FRAME, EPS)


@query(
    "m3_density_clusters",
    frame_density("SELECT video_id, frame_index, det_seq, cluster FROM clustered"),
)
def density_clusters(spark, sf_dir):
    found = clustering.cluster_points(centres(spark, sf_dir), FRAME, "det_seq", EPS, MIN_SAMPLES)
    return found.select(*FRAME, "det_seq", "cluster")


@query(
    "a9_cluster_summary",
    frame_density("""
        SELECT video_id, frame_index, cluster, count(*) AS size, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy
        FROM clustered WHERE cluster >= 0 GROUP BY ALL"""),
)
def cluster_summary(spark, sf_dir):
    found = clustering.cluster_points(centres(spark, sf_dir), FRAME, "det_seq", EPS, MIN_SAMPLES)
    summary = clustering.cluster_summary(found, FRAME)
    return summary.withColumns({"cx": F.round("cx", 6), "cy": F.round("cy", 6)})


@query(
    "a9_cluster_totals",
    frame_density("""
        SELECT video_id, frame_index, count(*) AS n_points, max(cluster) + 1 AS n_clusters,
               count_if(cluster = -1)::BIGINT AS n_noise FROM clustered GROUP BY ALL"""),
)
def cluster_totals(spark, sf_dir):
    found = clustering.cluster_points(centres(spark, sf_dir), FRAME, "det_seq", EPS, MIN_SAMPLES)
    return clustering.cluster_totals(found, FRAME)


@query(
    "m4_connected_components",
    with_views("commentary_events", """WITH RECURSIVE links AS (
            SELECT c.event_id::BIGINT AS a, p.event_id::BIGINT AS b
            FROM commentary_events c JOIN commentary_events p ON c.parent_span_id = p.span_id),
        both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (
            SELECT event_id::BIGINT AS node, event_id::BIGINT AS root FROM commentary_events
            UNION SELECT b.b, r.root FROM reach r JOIN both_ b ON b.a = r.node)
        SELECT node, min(root) AS component FROM reach GROUP BY node"""),
)
def components(spark, sf_dir):
    """Trees of events linked by parent spans."""
    from aerospark.operators.components import connected_components
    from aerospark.operators.digest import child_events

    number = F.col("event_id").cast("bigint")
    # seven events in a row, the first of them the parent, are a trace here
    events = views.commentary_events(spark, sf_dir).withColumn("trace_id", F.md5((number - number % 7).cast("string")))
    links = child_events(events).selectExpr(
        "cast(event_id AS bigint) AS a", "cast(parent_event_id AS bigint) AS b"
    )
    return connected_components(events.selectExpr("cast(event_id AS bigint) AS node"), links)


TRACKS = """WITH RECURSIVE inputs AS (
        SELECT f.video_id, f.frame_index, row_number() OVER (PARTITION BY f.video_id ORDER BY f.frame_index) AS step,
               coalesce(p.pts, []) AS pts
        FROM frames f LEFT JOIN (
            SELECT video_id, frame_index, list({'seq': det_seq, 'x': cx, 'y': cy} ORDER BY det_seq) AS pts
            FROM detections GROUP BY ALL) p USING (video_id, frame_index)),
    run AS (
        SELECT DISTINCT video_id, 0::BIGINT AS step, 0::BIGINT AS next_id,
               CAST([] AS STRUCT(id BIGINT, x DOUBLE, y DOUBLE, missed BIGINT)[]) AS objs,
               CAST([] AS BIGINT[]) AS given FROM frames
        UNION ALL
        SELECT video_id, step, next_id + len(list_filter(won, lambda w: w IS NULL)),
               list_concat(
                   list_filter(list_transform(objs, lambda o, k: {
                       'id': o.id,
                       'x': CASE WHEN list_contains(won, k) THEN pts[list_position(won, k)].x ELSE o.x END,
                       'y': CASE WHEN list_contains(won, k) THEN pts[list_position(won, k)].y ELSE o.y END,
                       'missed': CASE WHEN list_contains(won, k) THEN 0::BIGINT ELSE o.missed + 1 END}),
                       lambda o: o.missed <= 10),
                   list_filter(list_transform(pts, lambda p, j: {
                       'id': CASE WHEN won[j] IS NULL THEN next_id + len(list_filter(won[1:j], lambda w: w IS NULL)) - 1 END,
                       'x': p.x, 'y': p.y, 'missed': 0::BIGINT}), lambda o: o.id IS NOT NULL)),
               list_transform(won, lambda w, j: CASE WHEN w IS NULL
                   THEN next_id + len(list_filter(won[1:j], lambda v: v IS NULL)) - 1 ELSE objs[w].id END)
        FROM (
            SELECT c.*, list_transform(pts, lambda p, j: list_min(list_filter(claims, lambda q: q.best = j AND q.gap <= 50)).k) AS won
            FROM (
                SELECT r.video_id, i.step, r.next_id, r.objs, i.pts,
                       list_transform(r.objs, lambda o, k: {
                           'gap': list_min(list_transform(i.pts, lambda p: sqrt((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y)))),
                           'k': k,
                           'best': list_position(
                               list_transform(i.pts, lambda p: sqrt((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y))),
                               list_min(list_transform(i.pts, lambda p: sqrt((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y)))))
                       }) AS claims
                FROM run r JOIN inputs i ON i.video_id = r.video_id AND i.step = r.step + 1) c)),
    tracked AS (
        SELECT r.video_id, i.frame_index, unnest(list_transform(i.pts, lambda p: p.seq)) AS det_seq, unnest(r.given) AS track_id
        FROM run r JOIN inputs i ON i.video_id = r.video_id AND i.step = r.step)"""


def tracked(spark, sf_dir):
    return tracking.track_objects(views.frames(spark, sf_dir), views.detections(spark, sf_dir))


@query(
    "m1_centroid_tracks",
    with_views("frames detections", f"{TRACKS} SELECT video_id, frame_index, det_seq, track_id FROM tracked"),
)
def centroid_tracks(spark, sf_dir):
    return tracked(spark, sf_dir)


@query(
    "m1_tracks_in_chunks",
    with_views("frames detections", f"{TRACKS} SELECT video_id, frame_index, det_seq, track_id FROM tracked"),
)
def tracks_in_chunks(spark, sf_dir):
    """The same tracks, a few hundred frames of a video at a time."""
    return tracking.track_objects(views.frames(spark, sf_dir), views.detections(spark, sf_dir), chunk_frames=600)


SURE_CARS = "label = 'car' AND score >= 0.99"


@query(
    "m1_tracks_in_stretches",
    with_views(
        "frames detections",
        TRACKS.replace("FROM detections", f"FROM detections WHERE {SURE_CARS}")
        + " SELECT video_id, frame_index, det_seq, track_id FROM tracked",
    ),
)
def tracks_in_stretches(spark, sf_dir):
    """Tracks of cars that the model is sure of: rare ones, so the videos fall apart between them."""
    cars = views.detections(spark, sf_dir).filter(SURE_CARS)
    return tracking.track_objects(views.frames(spark, sf_dir), cars, chunk_frames=600)


@query(
    "m2_unique_objects_per_video",
    with_views("frames detections", f"{TRACKS} SELECT video_id, count(DISTINCT track_id) AS objects FROM tracked GROUP BY 1"),
)
def unique_per_video(spark, sf_dir):
    return zones.unique_objects(tracked(spark, sf_dir), ["video_id"])


@query(
    "m2_unique_objects_per_zone",
    with_views("frames detections zones", f"""{TRACKS}, {INSIDE}
        SELECT video_id, zone, count(DISTINCT track_id) AS objects
        FROM hits JOIN tracked USING (video_id, frame_index, det_seq) GROUP BY ALL"""),
)
def unique_per_zone(spark, sf_dir):
    hits = zones.detections_in_zones(views.detections(spark, sf_dir), views.zones(spark, sf_dir))
    located = hits.select(*FRAME, "det_seq", "zone").join(tracked(spark, sf_dir), [*FRAME, "det_seq"])
    return zones.unique_objects(located, ["video_id", "zone"])


def flow_sql(vectors):
    return f"""moved AS (
            SELECT video_id, frame_index, sqrt(vx * vx + vy * vy) AS m,
                   CASE WHEN degrees(atan2(vy, vx)) < 0 THEN degrees(atan2(vy, vx)) + 360 ELSE degrees(atan2(vy, vx)) END AS a
            FROM {vectors})
        SELECT video_id, frame_index, round(avg(m), 6) AS mean_magnitude, round(max(m), 6) AS max_magnitude,
               round(median(m), 6) AS median_magnitude,
               round(CASE WHEN sum(m) > 0 THEN sum(a * m) / sum(m) ELSE 0 END, 6) AS dominant_direction_deg
        FROM moved GROUP BY ALL"""


def rounded_flow(vectors):
    names = ("mean_magnitude", "max_magnitude", "median_magnitude", "dominant_direction_deg")
    return motion.flow_summary(vectors, FRAME).select(*FRAME, *[F.round(n, 6).alias(n) for n in names])


@query("a12_flow_summary", with_views("detections", f"WITH {flow_sql('detections')}"))
def flow_summary(spark, sf_dir):
    return rounded_flow(views.detections(spark, sf_dir))


DISPLACED = """
    ordered AS (
        SELECT d.video_id, frame_index, track_id, cx, cy, lag(frame_index) OVER w AS f0, lag(cx) OVER w AS x0, lag(cy) OVER w AS y0
        FROM tracked t JOIN detections d USING (video_id, frame_index, det_seq)
        WINDOW w AS (PARTITION BY d.video_id, track_id ORDER BY frame_index)),
    displaced AS (
        SELECT video_id, frame_index, (cx - x0) / (frame_index - f0) AS vx, (cy - y0) / (frame_index - f0) AS vy
        FROM ordered WHERE f0 IS NOT NULL)"""


@query(
    "a12_displacement_flow",
    with_views("frames detections", f"{TRACKS}, {DISPLACED}, {flow_sql('displaced')}"),
)
def displacement_flow(spark, sf_dir):
    """Flow from how far the tracked objects moved since they were last seen."""
    return rounded_flow(durable(motion.track_displacement(tracked(spark, sf_dir), views.detections(spark, sf_dir))))


@query(
    "a16_precomputed_features",
    with_views("detections", """
        SELECT video_id, frame_index, round(avg(sqrt(vx * vx + vy * vy)), 2) AS mean_speed, count(*) AS object_count
        FROM detections GROUP BY ALL"""),
)
def features(spark, sf_dir):
    from aerospark.sources.tables import precompute_features

    return precompute_features(views.detections(spark, sf_dir))


def correspondences(spark, sf_dir):
    """Box corners seen by ten cameras; one pair in twenty is off by 40 pixels."""
    shift = "CASE WHEN (frame_index + det_seq) % 20 = 0 THEN 40.0D ELSE 0.0D END"
    return views.detections(spark, sf_dir).selectExpr(
        "video_id AS camera", "cast(x AS double) AS sx", "cast(y AS double) AS sy",
        f"2.0D * x + 0.5D * y + video_id + {shift} AS dx", f"0.25D * x + 1.5D * y - 3.0D + {shift} AS dy",
    )


@query(
    "m8_fit_homographies",
    with_views("detections", """
        SELECT video_id AS camera, count(*) AS pairs, count_if((frame_index + det_seq) % 20 <> 0)::BIGINT AS inliers,
               2.0::DOUBLE AS h0, 0.5::DOUBLE AS h1, video_id::DOUBLE AS h2, 0.25::DOUBLE AS h3, 1.5::DOUBLE AS h4,
               -3.0::DOUBLE AS h5, 0.0::DOUBLE AS h6, 0.0::DOUBLE AS h7, 1.0::DOUBLE AS h8
        FROM detections GROUP BY ALL"""),
)
def fit_homographies(spark, sf_dir):
    """The pairs that are off do not bend the fit."""
    pairs = correspondences(spark, sf_dir)
    fitted = homography.with_inliers(pairs, homography.fit_inliers(pairs))
    return fitted.select(
        "camera", "pairs", "inliers", *[(F.round(F.col("homography")[i], 4) + 0.0).alias(f"h{i}") for i in range(9)]
    )


WRONG = "(frame_index + det_seq) % 5 > 1"


@query(
    "m8_consensus_homographies",
    with_views("detections", f"""
        SELECT video_id AS camera, count(*) AS pairs, count_if(NOT ({WRONG}))::BIGINT AS inliers,
               2.0::DOUBLE AS h0, 0.5::DOUBLE AS h1, video_id::DOUBLE AS h2, 0.25::DOUBLE AS h3, 1.5::DOUBLE AS h4,
               -3.0::DOUBLE AS h5, 0.0::DOUBLE AS h6, 0.0::DOUBLE AS h7, 1.0::DOUBLE AS h8
        FROM detections GROUP BY ALL"""),
)
def consensus_homographies(spark, sf_dir):
    """Three pairs in five are off, each by another distance."""
    off = f"CASE WHEN {WRONG} THEN 60 + det_seq % 907 ELSE 0 END"
    down = f"CASE WHEN {WRONG} THEN det_seq % 701 ELSE 0 END"
    pairs = views.detections(spark, sf_dir).selectExpr(
        "video_id AS camera", "cast(x AS double) AS sx", "cast(y AS double) AS sy",
        f"2.0D * x + 0.5D * y + video_id + {off} AS dx", f"0.25D * x + 1.5D * y - 3.0D - {down} AS dy",
    )
    fitted = homography.consensus_homographies(pairs)
    return fitted.select(
        "camera", "pairs", "inliers", *[(F.round(F.col("homography")[i], 4) + 0.0).alias(f"h{i}") for i in range(9)]
    )


@query(
    "m8_exact_homographies",
    with_views("detections", """
        SELECT video_id AS camera, count(*) AS pairs, count(*) AS inliers, 2.0::DOUBLE AS h0, 0.5::DOUBLE AS h1,
               video_id::DOUBLE AS h2, 0.25::DOUBLE AS h3, 1.5::DOUBLE AS h4, -3.0::DOUBLE AS h5
        FROM detections GROUP BY ALL"""),
)
def exact_homographies(spark, sf_dir):
    pairs = views.detections(spark, sf_dir).selectExpr(
        "video_id AS camera", "cast(x AS double) AS sx", "cast(y AS double) AS sy",
        "2.0D * x + 0.5D * y + video_id AS dx", "0.25D * x + 1.5D * y - 3.0D AS dy",
    )
    fitted = homography.with_inliers(pairs, homography.fit_homographies(pairs))
    values = [(F.round(F.col("homography")[i], 4) + 0.0).alias(f"h{i}") for i in range(6)]
    return fitted.select("camera", "pairs", "inliers", *values)


@query(
    "p32_map_points",
    with_views("detections", """
        SELECT video_id, frame_index, det_seq, round((2 * cx + 0.5 * cy + video_id) / (0.001 * cx + 0.002 * cy + 1), 6) AS mx,
               round((0.25 * cx + 1.5 * cy - 3) / (0.001 * cx + 0.002 * cy + 1), 6) AS my FROM detections"""),
)
def map_points(spark, sf_dir):
    matrices = views.detections(spark, sf_dir).groupBy(F.col("video_id").alias("camera")).agg(F.lit(1)).selectExpr(
        "camera", "array(2.0D, 0.5D, cast(camera AS double), 0.25D, 1.5D, -3.0D, 0.001D, 0.002D, 1.0D) AS homography"
    )
    points = views.detections(spark, sf_dir).selectExpr(
        *FRAME, "det_seq", "video_id AS camera", "cx AS px", "cy AS py"
    )
    mapped = homography.map_points(points, matrices)
    return mapped.select(*FRAME, "det_seq", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"))


@query(
    "p32_map_corners",
    with_views("frames", """
        SELECT video_id, frame_index, CAST(i AS INT) AS corner,
               2.0::DOUBLE * CASE WHEN i IN (1, 2) THEN width ELSE 0 END + 5 AS mx,
               2.0::DOUBLE * CASE WHEN i IN (2, 3) THEN height ELSE 0 END + 7 AS my FROM frames, range(4) t(i)"""),
)
def map_corners(spark, sf_dir):
    frames = views.frames(spark, sf_dir).selectExpr(*FRAME, "video_id AS camera", "width", "height")
    matrices = frames.select("camera").distinct().selectExpr(
        "camera", "array(2.0D, 0.0D, 5.0D, 0.0D, 2.0D, 7.0D, 0.0D, 0.0D, 1.0D) AS homography"
    )
    return homography.map_corners(frames, matrices).select(*FRAME, "corner", "mx", "my")
