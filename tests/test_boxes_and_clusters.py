"""Suppression, clustering, components, medians and order against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospark.operators import clustering
from aerospark.operators.clustering import cluster_points
from aerospark.operators.components import connected_components
from aerospark.operators.homography import fit_homographies, map_points, with_inliers
from aerospark.operators import motion
from aerospark.operators.motion import exact_median, flow_summary
from aerospark.operators.suppression import suppress, suppressors
from aerospark.operators.tiles import clamped_tiles, ragged_tiles
from aerospark.operators.zones import detections_in_zones, zone_counts
from aerospark.scale import previous_in_order

BOX = "video_id long, frame_index long, det_seq long, label string, score double, x int, y int, w int, h int"


def overlap(a, b):
    w = max(0, min(a[5] + a[7], b[5] + b[7]) - max(a[5], b[5]))
    h = max(0, min(a[6] + a[8], b[6] + b[8]) - max(a[6], b[6]))
    union = a[7] * a[8] + b[7] * b[8] - w * h
    return w * h / union if union > 0 else 0.0


def greedy(rows, threshold, per_label):
    kept = []
    for row in sorted(rows, key=lambda r: (-r[4], r[2])):
        rivals = [k for k in kept if k[:2] == row[:2] and (not per_label or k[3] == row[3])]
        if all(overlap(row, k) < threshold for k in rivals):
            kept.append(row)
    return {(r[1], r[2]) for r in kept}


def random_boxes(n, seed, size=60, frames=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all boxes are copies of one box in frame 0.
        hot = i % 3 == 0
        rows.append((
            1, 0 if hot else rng.randrange(frames), i, rng.choice("ab"), round(rng.random(), 1),
            10 if hot else rng.randrange(size), 10 if hot else rng.randrange(size),
            20 if hot else rng.randrange(0, 30), 20 if hot else rng.randrange(1, 30),
        ))
    return rows


@pytest.mark.parametrize("per_label", [False, True])
@pytest.mark.parametrize("threshold", [0.2, 0.45, 1.0])
def test_crowded_and_folded_suppression_equal_the_greedy_loop(spark, per_label, threshold):
    rows = random_boxes(240, 5)
    boxes = spark.createDataFrame(rows, BOX)
    wanted = greedy(rows, threshold, per_label)
    for fold in (1000, 0):
        kept = suppress(boxes, threshold, per_label, fold_boxes=fold)
        assert {(r.frame_index, r.det_seq) for r in kept.collect()} == wanted


def test_small_cells_give_the_same_survivors(spark):
    from aerospark.operators import suppression

    rows = random_boxes(150, 8, size=200)
    boxes = spark.createDataFrame(rows, BOX)
    group = ["video_id", "frame_index"]
    many = suppression.COARSE_BOXES
    suppression.COARSE_BOXES = 1
    try:
        kept = suppression._rounds(boxes, 0.3, group, cell=8)
    finally:
        suppression.COARSE_BOXES = many
    assert {(r.frame_index, r.det_seq) for r in kept.collect()} == greedy(rows, 0.3, False)


def test_edge_thresholds(spark):
    boxes = spark.createDataFrame(random_boxes(60, 2), BOX)
    assert suppress(boxes, 1.5).count() == 60
    assert suppress(boxes, 0.0).count() == 3


def test_best_of_two_overlapping_boxes_stays(spark):
    rows = [(1, 0, 0, "o", 0.9, 0, 0, 100, 100), (1, 0, 1, "o", 0.5, 5, 5, 100, 100)]
    boxes = spark.createDataFrame(rows, BOX)
    kept = suppress(boxes, 0.4)
    assert [r.score for r in kept.collect()] == [0.9]
    link = suppressors(boxes, kept, 0.4).first()
    assert (link.det_seq, link.suppressed_by) == (1, 0) and link.iou > 0.8


def dbscan(points, eps, minimum):
    """Labels by definition: clusters in order of their first core point."""
    pts = np.array([p[-2:] for p in points], dtype=float)
    near = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= minimum
    label = [-1] * len(pts)
    current = 0
    for i in range(len(pts)):
        if label[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            p = stack.pop()
            if label[p] != -1:
                continue
            label[p] = current
            if core[p]:
                stack += [q for q in np.flatnonzero(near[p]) if label[q] == -1]
        current += 1
    return label


@pytest.mark.parametrize("integer", [True, False])
@pytest.mark.parametrize("eps,minimum", [(3.0, 4), (6.0, 5), (2.0, 1)])
def test_clusters_equal_the_definition(spark, integer, eps, minimum):
    rng = random.Random(11)
    points = []
    for i in range(260):
        hot = i % 3 == 0
        cx, cy = rng.choice([(10, 10), (30, 12), (50, 50)])
        x = 20 if hot else rng.gauss(cx, 5)
        y = 40 if hot else rng.gauss(cy, 5)
        points.append((7, i, float(round(x) if integer else x), float(round(y) if integer else y)))
    df = spark.createDataFrame(points, "frame long, det_seq long, x double, y double")
    wanted = dbscan(points, eps, minimum)
    for fold in (1000, 0):
        found = cluster_points(df, ["frame"], "det_seq", eps, minimum, fold_points=fold)
        labels = {r.det_seq: r.cluster for r in found.collect()}
        assert [labels[i] for i in range(len(points))] == wanted


def test_facing_points_link_cells_that_the_outer_points_do_not(spark):
    # Two long rows of points whose outermost points are far apart.
    points = [(0, i, x, 0.0) for i, x in enumerate([0.0, 0.9, 1.8])]
    points += [(0, 10 + i, x, 2.95) for i, x in enumerate([0.95, 1.5])]
    df = spark.createDataFrame(points, "frame long, det_seq long, x double, y double")
    wanted = dbscan(points, 3.0, 2)
    found = cluster_points(df, ["frame"], "det_seq", 3.0, 2, fold_points=0)
    labels = {r.det_seq: r.cluster for r in found.collect()}
    assert [labels[p[1]] for p in points] == wanted


def test_no_points_no_clusters(spark):
    df = spark.createDataFrame([], "frame long, det_seq long, x double, y double")
    assert cluster_points(df, ["frame"]).count() == 0
    assert cluster_points(df, ["frame"], fold_points=0).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)]
    edges += [(100, 100 + i) for i in range(1, 60)]
    edges += [(200 + i, 200 + (i + 1) % 15) for i in range(15)]
    edges += [(300 + rng.randrange(30), 300 + rng.randrange(30)) for _ in range(25)]
    nodes = sorted({n for e in edges for n in e} | {999})
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    found = connected_components(
        spark.createDataFrame([(n,) for n in nodes], "node long"),
        spark.createDataFrame(edges, "a long, b long"),
    )
    assert {r.node: r.component for r in found.collect()} == {n: find(n) for n in nodes}


def test_median_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(0 if i % 3 == 0 else rng.randrange(1, 4), rng.choice([rng.random() * 9, 2.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        assert got[k] == pytest.approx(np.median([r[1] for r in rows if r[0] == k]))


def test_flow_of_still_frames_is_zero(spark):
    still = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 0.0)], "k long, vx double, vy double")
    row = flow_summary(still, ["k"]).first()
    assert (row.mean_magnitude, row.dominant_direction_deg) == (0.0, 0.0)


def test_flow_of_ordinary_keys_needs_no_buckets(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randrange(5) if i % 2 else 7, rng.randrange(-4, 5), rng.randrange(-4, 5)) for i in range(300)]
    df = spark.createDataFrame([*rows, (8, 1, None), (8, 3, 4), (9, None, None)], "k long, vx int, vy int")

    def flow():
        return {r.k: [None if v is None else round(v, 9) for v in r[1:4]] + [r.median_magnitude] for r in flow_summary(df, ["k"]).collect()}

    with monkeypatch.context() as patch:
        patch.setattr(motion, "exact_median", None)
        got = flow()
    for k in {r[0] for r in rows}:
        assert got[k][3] == np.median([np.sqrt(float(x * x + y * y)) for key, x, y in rows if key == k])
    assert got[8][3] == 5.0 and got[9] == [None, None, 0.0, None]
    monkeypatch.setattr(motion, "KEY_ROWS", 100)
    assert flow() == got
    monkeypatch.setattr(motion, "KEY_ROWS", 0)
    assert flow() == got


def test_previous_row_across_ranges(spark):
    rng = random.Random(6)
    rows = sorted({(rng.randrange(2), rng.randrange(5000)) for _ in range(300)})
    df = spark.createDataFrame([(k, i, float(i)) for k, i in rows], "k long, i long, v double")
    got = previous_in_order(df, ["k"], "i", ["v"], span=64)
    for r in got.collect():
        earlier = [i for k, i in rows if k == r.k and i < r.i]
        assert r.prev_i == (max(earlier) if earlier else None)
        assert r.prev_v == (float(max(earlier)) if earlier else None)


def test_border_points_are_outside_a_zone(spark):
    zone = [("left", [[0.0, 0.0], [50.0, 0.0], [50.0, 50.0], [0.0, 50.0]]),
            ("right", [[50.0, 0.0], [100.0, 0.0], [100.0, 50.0], [50.0, 50.0]]),
            ("far", [[500.0, 500.0], [600.0, 500.0], [550.0, 600.0]])]
    zones = spark.createDataFrame(zone, "zone string, polygon array<array<double>>")
    points = [(1, 0, 0, 25.0, 25.0), (1, 0, 1, 75.0, 25.0), (1, 0, 2, 50.0, 25.0), (1, 0, 3, 0.0, 0.0)]
    boxes = spark.createDataFrame(points, "video_id long, frame_index long, det_seq long, cx double, cy double")
    found = detections_in_zones(boxes, zones, cell=16.0)
    assert {(r.det_seq, r.zone) for r in found.collect()} == {(0, "left"), (1, "right")}
    frames = spark.createDataFrame([(1, 0), (1, 1)], "video_id long, frame_index long")
    rows = {r.frame_index: r for r in zone_counts(frames, boxes, zones).collect()}
    assert {z.zone: z.detections for z in rows[0].zones} == {"left": 1, "right": 1, "far": 0}
    assert rows[0].total == 2 and rows[1].total == 0


def test_concave_zone(spark):
    zone = [("u", [[0.0, 0.0], [30.0, 0.0], [30.0, 30.0], [20.0, 30.0], [20.0, 10.0], [10.0, 10.0], [10.0, 30.0], [0.0, 30.0]])]
    zones = spark.createDataFrame(zone, "zone string, polygon array<array<double>>")
    points = [(0, 5.0, 20.0), (1, 15.0, 20.0), (2, 25.0, 20.0), (3, 15.0, 5.0), (4, 10.0, 20.0)]
    boxes = spark.createDataFrame(points, "det_seq long, cx double, cy double")
    assert {r.det_seq for r in detections_in_zones(boxes, zones).collect()} == {0, 2, 3}


def test_tiles_stay_inside_and_bad_overlap_is_refused(spark):
    frames = spark.createDataFrame([(1, 0, 1000, 1000), (1, 1, 300, 200)], "video_id long, frame_index long, width int, height int")
    tiles = clamped_tiles(frames, (400, 400), 0.2).collect()
    big = [(t.tile_x, t.tile_y) for t in tiles if t.frame_index == 0]
    assert len(big) == 9 and all(0 <= x <= 600 and 0 <= y <= 600 for x, y in big)
    assert [(t.tile_w, t.tile_h) for t in tiles if t.frame_index == 1] == [(300, 200)]
    with pytest.raises(ValueError):
        clamped_tiles(frames, (400, 400), 1.0)
    last = max(ragged_tiles(frames, (400, 400), 0.2).collect(), key=lambda t: (t.tile_x, t.tile_y))
    assert (last.tile_x, last.tile_w) == (960, 40)


def test_homography_of_a_doubling(spark):
    corners = [(0, 0), (100, 0), (100, 100), (0, 100)]
    rows = [(1, float(x), float(y), 2.0 * x, 2.0 * y) for x, y in corners]
    # A perspective map for the second camera.
    for x, y in [*corners, (40, 70), (13, 55)]:
        d = 0.001 * x + 0.002 * y + 1
        rows.append((2, float(x), float(y), (x + 5) / d, (3 * y - 2) / d))
    pairs = spark.createDataFrame(rows, "camera long, sx double, sy double, dx double, dy double")
    fitted = with_inliers(pairs, fit_homographies(pairs))
    assert {r.camera: (r.pairs, r.inliers) for r in fitted.collect()} == {1: (4, 4), 2: (6, 6)}
    points = spark.createDataFrame([(1, 50.0, 50.0), (2, 60.0, 20.0)], "camera long, px double, py double")
    got = {r.camera: (r.mx, r.my) for r in map_points(points, fitted).collect()}
    assert got[1] == pytest.approx((100.0, 100.0))
    assert got[2] == pytest.approx((65 / 1.1, 58 / 1.1))


def test_too_few_or_degenerate_pairs_are_errors(spark):
    shape = "camera long, sx double, sy double, dx double, dy double"
    few = spark.createDataFrame([(1, float(i), 0.0, float(i), 1.0) for i in range(3)], shape)
    with pytest.raises(Exception, match="at least 4"):
        fit_homographies(few).collect()
    line = spark.createDataFrame([(1, float(i), float(i), 2.0 * i, 2.0 * i) for i in range(6)], shape)
    with pytest.raises(Exception, match="degenerate"):
        fit_homographies(line).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_ordinary_groups_need_no_grid(spark):
    rng = random.Random(11)
    rows = [(g, float(rng.randrange(60)), float(rng.randrange(60)), rng.randint(1, 3)) for g in (1, 2, 3) for _ in range(9 * g * g)]
    rows += [(4, None, 1.0, 1), (4, float("nan"), 1.0, 1), (4, 5.0, 5.0, 2), (None, 5.0, 5.0, 2)]
    places = {(g, x, y): w for g, x, y, w in rows if x == x}
    rows = [(*k, w) for k, w in places.items()] + [(4, float("nan"), 1.0, 1)]
    points = spark.createDataFrame(rows, "g int, x double, y double, weight long").selectExpr(
        "*", "floor(x / 5) AS i", "floor(y / 5) AS j"
    )
    want = {
        (g, x, y): sum(w for (h, a, b), w in places.items() if h == g and a is not None and (a - x) ** 2 + (b - y) ** 2 <= 100)
        for g, x, y in places if g is not None and x is not None
    }
    for fold in (256, 20, 0):
        found = clustering.neighbour_counts(points, ["g"], 10.0, fold_points=fold)
        got = [((r.g, r.x, r.y), r.neighbours) for r in found.collect()]
        assert len(got) == len(want) and dict(got) == want
        assert ("Join" in plan_of(found)) == (fold < 256)


def test_suppressors_of_ordinary_frames_need_no_grid(spark):
    rng = random.Random(12)
    rows = [
        (1, f, i, rng.randrange(100) / 100, rng.randrange(90), rng.randrange(90), rng.choice((0, 20, 40)), 30)
        for f, n in ((0, 30), (1, 8), (2, 1)) for i in range(n)
    ]
    boxes = spark.createDataFrame(
        rows, "video_id long, frame_index long, det_seq long, score double, x int, y int, w int, h int"
    )
    kept = suppress(boxes, 0.2)
    found = [
        sorted(map(tuple, suppressors(boxes, kept, 0.2, fold_boxes=fold).collect())) for fold in (512, 20, 0)
    ]
    assert found[0] and found[0] == found[1] == found[2]
    assert "explode" not in plan_of(suppressors(boxes, kept, 0.2))


def test_runs_deal_out_footage_of_many_rows(spark, small, monkeypatch):
    from aerospark.plans import analysis
    from workload.run_queries import footage

    def run():
        names = ["zone_counting", "spatial_clustering", "optical_flow"]
        summaries, boxes, _ = analysis.run_routines(footage(spark, small), names, {}, frame_step=3)
        rows = [(r.routine, r.video_id, r.frame_index, sorted((k, round(v, 9)) for k, v in r.summary.items())) for r in summaries.collect()]
        return sorted(rows), boxes.count(), boxes.rdd.getNumPartitions()

    plain, boxes, _ = run()
    monkeypatch.setattr(analysis, "TASK_ROWS", 600)
    dealt, again, tasks = run()
    assert (dealt, again) == (plain, boxes) and tasks == 23
