"""Queries over the pixel table: histograms, blobs, motion, spots, main colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospark.functions.colours import hsv
from aerospark.operators import edges, motion, occupancy, pixels
from workload import views
from workload.registry import query
from workload.views import with_views

FRAME = ["video_id", "frame_index"]
# The patches are 8 by 8, so areas and kernels are small.
LOWER, UPPER = (0, 40, 60), (60, 255, 255)

GRAY = "((b * 3735 + g * 19235 + r * 9798 + 16384) >> 15)"
HSV = """
    spans AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM pixels),
    hues AS (
        SELECT *, CASE WHEN v > 0 THEN (d::BIGINT * round_even(255 * 4096 / v::DOUBLE, 0)::BIGINT + 2048) >> 12 ELSE 0 END AS s,
               CASE WHEN d = 0 THEN 0 ELSE
                 floor((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END
                   * round_even(30 * 4096 / d::DOUBLE, 0) + 2048) / 4096) END AS h0
        FROM spans),
    hsv AS (SELECT *, CAST(CASE WHEN h0 < 0 THEN h0 + 180 ELSE h0 END AS INT) AS h FROM hues)"""


@query(
    "x7_gray",
    with_views("pixels", f"SELECT video_id, frame_index, x, y, CAST({GRAY} AS INT) AS gray FROM pixels"),
)
def to_gray(spark, sf_dir):
    return pixels.with_gray(views.pixels(spark, sf_dir)).select(*FRAME, "x", "y", "gray")


@query(
    "x2_hsv",
    with_views("pixels", f"WITH {HSV} SELECT video_id, frame_index, x, y, h, CAST(s AS INT) AS s, v FROM hsv"),
)
def to_hsv(spark, sf_dir):
    colour = hsv(F.col("b"), F.col("g"), F.col("r"))
    return views.pixels(spark, sf_dir).withColumn("c", colour).select(*FRAME, "x", "y", "c.*")


@query(
    "x1_channel_histograms",
    with_views("pixels", """WITH long AS (
            SELECT video_id, frame_index, 'b' AS channel, b AS v FROM pixels
            UNION ALL SELECT video_id, frame_index, 'g', g FROM pixels
            UNION ALL SELECT video_id, frame_index, 'r', r FROM pixels),
        counted AS (
            SELECT video_id, frame_index, channel, count(*) AS pixels, avg(v) AS mean FROM long GROUP BY ALL),
        bins AS (
            SELECT video_id, frame_index, channel, CAST(floor(v * 32 / 256.0) AS INT) AS bin, count(*) AS n
            FROM long GROUP BY ALL)
        SELECT c.video_id, c.frame_index, c.channel, CAST(i AS INT) AS bin,
               round(coalesce(n, 0) / pixels, 6) AS share, round(mean, 6) AS mean
        FROM counted c CROSS JOIN range(32) t(i) LEFT JOIN bins b
          ON b.video_id = c.video_id AND b.frame_index = c.frame_index AND b.channel = c.channel AND b.bin = i"""),
)
def histograms(spark, sf_dir):
    made = pixels.channel_histograms(views.pixels(spark, sf_dir))
    return made.select(*FRAME, "channel", "mean", F.posexplode("histogram").alias("bin", "share")).withColumns(
        {"mean": F.round("mean", 6), "share": F.round("share", 6)}
    )


def blob_sql(mask: str, min_area: int) -> str:
    """8-neighbour components of ``mask`` pixels by recursion, then their boxes."""
    return f"""
    {mask},
    reach AS (
        SELECT video_id, frame_index, x, y, y * 100 + x AS root FROM mask
        UNION
        SELECT m.video_id, m.frame_index, m.x, m.y, r.root FROM reach r JOIN mask m
          ON m.video_id = r.video_id AND m.frame_index = r.frame_index
         AND m.x BETWEEN r.x - 1 AND r.x + 1 AND m.y BETWEEN r.y - 1 AND r.y + 1),
    rooted AS (SELECT video_id, frame_index, x, y, min(root) AS root FROM reach GROUP BY ALL),
    blobs AS (
        SELECT video_id, frame_index, min(x) AS x, min(y) AS y, CAST(max(x) - min(x) + 1 AS INT) AS w,
               CAST(max(y) - min(y) + 1 AS INT) AS h, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy,
               count(*)::DOUBLE AS area FROM rooted GROUP BY video_id, frame_index, root
        HAVING count(*) >= {min_area})"""


def _neighbourhood(source: str, name: str, radius: int, erode: bool) -> str:
    """One erosion or dilation over an 8 by 8 grid, by counting marked neighbours."""
    inside = (
        f"(least(7, g.x + {radius}) - greatest(0, g.x - {radius}) + 1)"
        f" * (least(7, g.y + {radius}) - greatest(0, g.y - {radius}) + 1)"
    )
    return f"""{name} AS (
        SELECT g.video_id, g.frame_index, g.x, g.y FROM pixels g JOIN {source} m
          ON m.video_id = g.video_id AND m.frame_index = g.frame_index
         AND m.x BETWEEN g.x - {radius} AND g.x + {radius} AND m.y BETWEEN g.y - {radius} AND g.y + {radius}
        GROUP BY ALL HAVING count(*) {'=' if erode else '>='} {inside if erode else '1'})"""


IN_RANGE = f"""colours AS (
        SELECT video_id, frame_index, x, y FROM hsv
        WHERE h BETWEEN {LOWER[0]} AND {UPPER[0]} AND s BETWEEN {LOWER[1]} AND {UPPER[1]}
          AND v BETWEEN {LOWER[2]} AND {UPPER[2]})"""
OPEN_CLOSE = ", ".join([
    _neighbourhood("colours", "e1", 1, True), _neighbourhood("e1", "d1", 1, False),
    _neighbourhood("d1", "d2", 1, False), _neighbourhood("d2", "mask", 1, True),
])
BLOB_COLUMNS = "SELECT video_id, frame_index, x, y, w, h, cx, cy, area FROM blobs"


def rounded(found):
    return found.select(
        *FRAME, "x", "y", "w", "h", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"), "area"
    )


@query(
    "x2_colour_blobs",
    with_views("pixels", f"WITH RECURSIVE {HSV}, {IN_RANGE}, {blob_sql(OPEN_CLOSE, 2)} {BLOB_COLUMNS}"),
)
def colour_blobs(spark, sf_dir):
    return rounded(pixels.detect_by_colour(views.pixels(spark, sf_dir), LOWER, UPPER, 2, kernel=3))


@query(
    "x3_threshold_blobs",
    with_views("pixels", f"""WITH RECURSIVE grays AS (
            SELECT video_id, frame_index, x, y, {GRAY} AS gray FROM pixels),
        local AS (
            SELECT a.video_id, a.frame_index, a.x, a.y, a.gray, avg(b.gray) - 5 AS threshold
            FROM grays a JOIN grays b ON a.video_id = b.video_id AND a.frame_index = b.frame_index
             AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY ALL),
        {blob_sql("mask AS (SELECT video_id, frame_index, x, y FROM local WHERE gray <= threshold)", 3)} {BLOB_COLUMNS}"""),
)
def threshold_blobs(spark, sf_dir):
    return rounded(pixels.detect_by_threshold(views.pixels(spark, sf_dir), 3, block=5))


MOTION = f"""
    grays AS (SELECT video_id, frame_index, x, y, {GRAY} AS gray FROM pixels),
    known AS (
        SELECT *, avg(gray) OVER w AS mean, var_pop(gray) OVER w AS var FROM grays
        WINDOW w AS (PARTITION BY video_id, x, y ORDER BY frame_index RANGE BETWEEN 100 PRECEDING AND 1 PRECEDING)),
    moved AS (
        SELECT video_id, frame_index, x, y FROM known
        WHERE (gray - mean) * (gray - mean) > 4 * greatest(var, 4))"""


@query(
    "x4_foreground",
    with_views("pixels", f"WITH {MOTION} SELECT video_id, frame_index, x, y FROM moved"),
)
def foreground(spark, sf_dir):
    return pixels.foreground(views.pixels(spark, sf_dir), span=100, threshold=4.0)


MOTION_MASK = ", ".join([_neighbourhood("moved", "me", 0, True), "mask AS (SELECT * FROM me)"])


def motion_run(spark, sf_dir):
    return pixels.background_subtraction(
        views.pixels(spark, sf_dir), min_area=2, span=100, threshold=4.0, kernel=1
    )


@query(
    "x4_moving_objects",
    with_views("pixels", f"WITH RECURSIVE {MOTION}, {blob_sql(MOTION_MASK, 2)} {BLOB_COLUMNS}"),
)
def moving_objects(spark, sf_dir):
    return rounded(motion_run(spark, sf_dir)[1])


@query(
    "a10_motion_summary",
    with_views("pixels", f"""WITH {MOTION},
        ratios AS (
            SELECT p.video_id, p.frame_index, count(m.x) / count(*) AS motion_ratio
            FROM pixels p LEFT JOIN moved m USING (video_id, frame_index, x, y) GROUP BY ALL)
        SELECT video_id, count(*) AS frames_processed, round(avg(motion_ratio), 6) AS mean_motion_ratio,
               round(max(motion_ratio), 6) AS max_motion_ratio FROM ratios GROUP BY video_id"""),
)
def motion_summary(spark, sf_dir):
    made = motion.motion_summary(motion_run(spark, sf_dir)[0], ["video_id"])
    names = ("mean_motion_ratio", "max_motion_ratio")
    return made.withColumns({n: F.round(n, 6) for n in names})


SPOTS = f"""
    inside AS (
        SELECT p.video_id, p.frame_index, s.spot, p.x, p.y, {GRAY} AS gray FROM pixels p JOIN spots s
          ON p.x >= s.x AND p.x < s.x + s.w AND p.y >= s.y AND p.y < s.y + s.h),
    sharp AS (
        SELECT *, abs(coalesce(lead(gray) OVER a, gray) - coalesce(lag(gray) OVER a, gray))
                + abs(coalesce(lead(gray) OVER d, gray) - coalesce(lag(gray) OVER d, gray)) AS change FROM inside
        WINDOW a AS (PARTITION BY video_id, frame_index, spot, y ORDER BY x),
               d AS (PARTITION BY video_id, frame_index, spot, x ORDER BY y)),
    features AS (
        SELECT video_id, frame_index, spot, avg(CASE WHEN change >= 50 THEN 1.0 ELSE 0.0 END) AS edge_density,
               avg(gray) AS mean, stddev_pop(gray) AS std FROM sharp GROUP BY ALL)"""


def features(spark, sf_dir):
    grid = views.pixels(spark, sf_dir)
    frames = views.table(spark, sf_dir, "embeddings").selectExpr(
        "cast(label AS bigint) AS video_id", "vec_id AS frame_index"
    )
    return pixels.spot_features(frames, grid, views.spots(spark, sf_dir))


@query(
    "x5_spot_features",
    with_views("pixels spots", f"""WITH {SPOTS}
        SELECT video_id, frame_index, spot, round(edge_density, 6) AS edge_density, round(mean, 6) AS mean,
               round(std, 6) AS std FROM features"""),
)
def spot_features(spark, sf_dir):
    return features(spark, sf_dir).withColumns(
        {n: F.round(n, 6) for n in ("edge_density", "mean", "std")}
    )


@query(
    "x5_spot_features_per_video",
    with_views("pixels spots", f"""WITH {SPOTS},
        own AS (SELECT r_name AS spot, CAST(r_regionkey AS BIGINT) AS video_id FROM region)
        SELECT video_id, frame_index, spot, round(edge_density, 6) AS edge_density, round(mean, 6) AS mean,
               round(std, 6) AS std FROM features JOIN own USING (video_id, spot)"""),
)
def spot_features_per_video(spark, sf_dir):
    """The first videos have one spot each."""
    own = views.table(spark, sf_dir, "region").selectExpr("r_name AS spot", "cast(r_regionkey AS bigint) AS video_id")
    frames = views.table(spark, sf_dir, "embeddings").selectExpr("cast(label AS bigint) AS video_id", "vec_id AS frame_index")
    found = pixels.spot_features(frames, views.pixels(spark, sf_dir), views.spots(spark, sf_dir).join(own, "spot"))
    return found.withColumns({n: F.round(n, 6) for n in ("edge_density", "mean", "std")})


# Spots of 6 by 6 pixels, since an edge of 3 by 3 has no room for neighbours.
EDGE_LOW, EDGE_HIGH = 80, 160
WIDE = ["r_name AS spot", "r_regionkey % 3 AS x", "r_regionkey % 2 AS y", "6 AS w", "6 AS h"]
NEIGHBOUR = "coalesce(max(CASE WHEN n.x = t.x + {} AND n.y = t.y + {} THEN n.m END), 0) AS {}"
NEIGHBOURS = ", ".join(
    NEIGHBOUR.format(i, j, name) for i, j, name in (
        (-1, 0, "w"), (1, 0, "e"), (0, -1, "n"), (0, 1, "s"), (-1, -1, "nw"), (1, 1, "se"), (1, -1, "ne"), (-1, 1, "sw"))
)
EDGES = f"""
    wide AS (SELECT {', '.join(WIDE)} FROM region),
    inside AS (
        SELECT p.video_id, p.frame_index, s.spot, p.x, p.y, CAST({GRAY} AS INT) AS g,
               greatest(s.x, 0) AS x0, least(s.x + s.w, 8) - 1 AS x1, greatest(s.y, 0) AS y0, least(s.y + s.h, 8) - 1 AS y1
        FROM pixels p JOIN wide s ON p.x >= s.x AND p.x < s.x + s.w AND p.y >= s.y AND p.y < s.y + s.h),
    offsets AS (SELECT i, j FROM (VALUES (-1), (0), (1)) a(i), (VALUES (-1), (0), (1)) b(j)),
    sloped AS (
        SELECT t.video_id, t.frame_index, t.spot, t.x, t.y,
               CAST(sum(o.i * (2 - abs(o.j)) * n.g) AS INT) AS dx, CAST(sum(o.j * (2 - abs(o.i)) * n.g) AS INT) AS dy
        FROM inside t CROSS JOIN offsets o JOIN inside n
          ON n.video_id = t.video_id AND n.frame_index = t.frame_index AND n.spot = t.spot
         AND n.x = least(greatest(t.x + o.i, t.x0), t.x1) AND n.y = least(greatest(t.y + o.j, t.y0), t.y1)
        GROUP BY ALL),
    sized AS (SELECT *, abs(dx) + abs(dy) AS m FROM sloped),
    around AS (
        SELECT t.video_id, t.frame_index, t.spot, t.x, t.y, t.dx, t.dy, t.m, {NEIGHBOURS}
        FROM sized t JOIN sized n ON n.video_id = t.video_id AND n.frame_index = t.frame_index AND n.spot = t.spot
         AND abs(n.x - t.x) <= 1 AND abs(n.y - t.y) <= 1
        GROUP BY ALL),
    thin AS (
        SELECT video_id, frame_index, spot, x, y, m FROM around
        WHERE m > {EDGE_LOW} AND CASE
            WHEN abs(dy) < abs(dx) * (sqrt(2) - 1) THEN m > w AND m >= e
            WHEN abs(dx) < abs(dy) * (sqrt(2) - 1) THEN m > n AND m >= s
            WHEN (dx < 0) = (dy < 0) THEN m > nw AND m > se
            ELSE m > ne AND m > sw END),
    followed AS (
        SELECT video_id, frame_index, spot, x, y FROM thin WHERE m > {EDGE_HIGH}
        UNION
        SELECT t.video_id, t.frame_index, t.spot, t.x, t.y FROM followed f JOIN thin t
          ON t.video_id = f.video_id AND t.frame_index = f.frame_index AND t.spot = f.spot
         AND abs(t.x - f.x) <= 1 AND abs(t.y - f.y) <= 1),
    followed_count AS (SELECT video_id, frame_index, spot, count(*) AS edges FROM followed GROUP BY ALL),
    shades AS (
        SELECT video_id, frame_index, spot, count(*) AS pixels, avg(g) AS mean, stddev_pop(g) AS std
        FROM inside GROUP BY ALL)"""


@query(
    "x5_hysteresis_edges",
    with_views("pixels", f"""WITH RECURSIVE {EDGES}
        SELECT video_id, frame_index, spot, round(coalesce(edges, 0) / pixels, 6) AS edge_density,
               round(mean, 6) AS mean, round(std, 6) AS std
        FROM shades LEFT JOIN followed_count USING (video_id, frame_index, spot)"""),
)
def hysteresis_edges(spark, sf_dir):
    """Edges that are thinned, and followed from strong pixels through weaker ones."""
    frames = views.table(spark, sf_dir, "embeddings").selectExpr("cast(label AS bigint) AS video_id", "vec_id AS frame_index")
    wide = views.table(spark, sf_dir, "region").selectExpr(*WIDE)
    found = edges.hysteresis_features(frames, views.pixels(spark, sf_dir), wide, EDGE_LOW, EDGE_HIGH)
    return found.withColumns({n: F.round(n, 6) for n in ("edge_density", "mean", "std")})


@query(
    "m7_occupied_by_edges",
    with_views("pixels spots", f"""WITH {SPOTS}
        SELECT video_id, frame_index, spot, edge_density >= 0.3 AS occupied, round(edge_density, 6) AS score
        FROM features"""),
)
def occupied_by_edges(spark, sf_dir):
    made = occupancy.classify_by_edges(features(spark, sf_dir), 0.3)
    return made.select(*FRAME, "spot", "occupied", F.round("score", 6).alias("score"))


@query(
    "a8_occupancy_summary",
    with_views("pixels spots", f"""WITH {SPOTS}
        SELECT video_id, frame_index, count(*) AS total_spots, count_if(edge_density >= 0.3)::BIGINT AS occupied,
               (count(*) - count_if(edge_density >= 0.3))::BIGINT AS available,
               round_even(count_if(edge_density >= 0.3) / count(*), 4) AS occupancy_rate
        FROM features GROUP BY ALL"""),
)
def occupancy_per_frame(spark, sf_dir):
    return occupancy.occupancy_summary(occupancy.classify_by_edges(features(spark, sf_dir), 0.3), FRAME)


@query("x6_sliced_detection")
def sliced(spark, sf_dir):
    found = pixels.sliced_detection(
        views.pixels(spark, sf_dir), tile=(5, 5), overlap=0.2, lower=LOWER, upper=UPPER, min_area=2, kernel=0
    )
    return rounded(found)


@query("m5_dominant_colours")
def dominant(spark, sf_dir):
    return pixels.dominant_colours(views.pixels(spark, sf_dir))


@query("m6_occupancy_classifier")
def classifier(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "cast(n_chars AS double) AS n_chars",
        "cast(length(text) - length(replace(text, ' ', '')) AS double) AS n_blanks",
    )
    labels = views.table(spark, sf_dir, "labels").selectExpr("doc_id", "cast(quality AS double) AS label")
    names = ["n_chars", "n_blanks"]
    model = occupancy.train_classifier(docs.join(labels, "doc_id"), names)
    return occupancy.classify(docs, model).select("doc_id", "occupied", F.round("score", 6).alias("score"))
