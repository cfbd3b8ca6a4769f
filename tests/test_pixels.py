"""Pixel jobs on small drawn frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospark.functions.colours import hsv
from aerospark.operators import blobs, occupancy, pixels
from aerospark.plans.analysis import Footage, routine_table, run_routines

PIXEL = "video_id long, frame_index long, x int, y int, b int, g int, r int"


def drawn(spark, images):
    """Pixel rows of (video, frame, array of height x width x 3)."""
    rows = [
        (v, f, x, y, *map(int, image[y, x]))
        for v, f, image in images for y in range(image.shape[0]) for x in range(image.shape[1])
    ]
    return spark.createDataFrame(rows, PIXEL)


def squares(places, size=8, shape=(40, 48)):
    image = np.zeros((*shape, 3), dtype=int)
    for x, y in places:
        image[y:y + size, x:x + size] = (0, 0, 255)
    return image


def test_red_squares_are_found(spark):
    # Closing fills the rim between a blob and a frame edge nearer than the kernel.
    places = [(4, 3), (20, 10), (36, 28)]
    found = pixels.detect_by_colour(drawn(spark, [(1, 0, squares(places))]), min_area=20).collect()
    assert sorted((b.x, b.y, b.w, b.h) for b in found) == sorted((x, y, 8, 8) for x, y in places)
    assert all(b.area == 64.0 and b.cx == b.x + 3.5 and b.label == "object" for b in found)


def test_sliced_detection_merges_what_tiles_share(spark):
    places = [(2, 3), (14, 10), (36, 28)]
    frame = drawn(spark, [(1, 0, squares(places))])
    found = pixels.sliced_detection(frame, tile=(24, 24), overlap=0.5, min_area=20, kernel=0).collect()
    boxes = {(b.x, b.y, b.w, b.h) for b in found}
    assert {(x, y, 8, 8) for x, y in places} <= boxes
    for a in found:
        assert any(x <= a.x and a.x + a.w <= x + 8 and y <= a.y and a.y + a.h <= y + 8 for x, y in places)


def flood(mask):
    """Blobs of an image by flood fill: (area, x, y, w, h)."""
    seen, found = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, members = [(y, x)], []
        seen[y, x] = True
        while stack:
            py, px = stack.pop()
            members.append((py, px))
            for ny in range(max(0, py - 1), min(mask.shape[0], py + 2)):
                for nx in range(max(0, px - 1), min(mask.shape[1], px + 2)):
                    if mask[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        stack.append((ny, nx))
        ys, xs = zip(*members)
        found.append((len(members), min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return sorted(found)


def shifted(mask, radius, erode):
    out = np.zeros_like(mask)
    for y in range(mask.shape[0]):
        for x in range(mask.shape[1]):
            part = mask[max(0, y - radius):y + radius + 1, max(0, x - radius):x + radius + 1]
            out[y, x] = part.all() if erode else part.any()
    return out


def test_morphology_and_blobs_equal_an_image_loop(spark):
    rng = np.random.default_rng(5)
    masks = [rng.random((23, 37)) < share for share in (0.35, 0.6, 0.85)]
    rows = [(1, f, int(x), int(y), 37, 23) for f, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    marked = spark.createDataFrame(rows, "video_id long, frame_index long, x int, y int, width int, height int")
    keys = ["video_id", "frame_index"]
    raw = blobs.find_blobs(marked, keys, 1).collect()
    stepwise = blobs.closed(blobs.opened(marked, keys, 3), keys, 3).select(*keys, "x", "y").distinct().collect()
    neat = blobs.cleaned(marked, keys, 3).select(*keys, "x", "y").distinct().collect()
    assert set(neat) == set(stepwise)
    for f, mask in enumerate(masks):
        got = sorted((int(b.area), b.x, b.y, b.w, b.h) for b in raw if b.frame_index == f)
        assert got == flood(mask)
        want = shifted(shifted(shifted(shifted(mask, 1, True), 1, False), 1, False), 1, True)
        assert {(p.x, p.y) for p in neat if p.frame_index == f} == {(x, y) for y, x in zip(*np.nonzero(want))}


def test_histograms_sum_to_one(spark):
    frame = drawn(spark, [(1, 0, squares([(0, 0)]))])
    rows = pixels.channel_histograms(frame).collect()
    assert {r.channel for r in rows} == {"b", "g", "r"}
    for r in rows:
        assert len(r.histogram) == 32 and sum(r.histogram) == pytest.approx(1.0)
    assert [r.mean for r in rows if r.channel == "r"] == [pytest.approx(255 * 64 / (40 * 48))]


def test_hsv_of_pure_colours(spark):
    rows = [(0, 0, 255), (0, 255, 0), (255, 0, 0), (0, 255, 255), (128, 128, 128), (0, 0, 0), (255, 0, 255)]
    df = spark.createDataFrame(rows, "b int, g int, r int")
    got = [tuple(r[0]) for r in df.select(hsv(F.col("b"), F.col("g"), F.col("r"))).collect()]
    assert got == [(0, 255, 255), (60, 255, 255), (120, 255, 255), (30, 255, 255), (0, 0, 128), (0, 0, 0), (150, 255, 255)]


def test_moving_square_is_motion(spark):
    images = [(1, f, squares([(4 + 10 * (f == 6), 6)])) for f in range(7)]
    per_frame, objects = pixels.background_subtraction(drawn(spark, images), min_area=30, span=10, kernel=3)
    ratios = {r.frame_index: (r.motion_ratio, r.moving) for r in per_frame.collect()}
    assert all(ratios[f] == (0.0, 0) for f in range(6))
    assert ratios[6] == (pytest.approx(128 / (40 * 48)), 2)
    assert sorted(b.x for b in objects.collect()) == [4, 14]


def test_main_colours(spark):
    image = np.zeros((20, 20, 3), dtype=int)
    image[:, 12:] = (250, 10, 10)
    image[:, 18:] = (10, 240, 10)
    got = pixels.dominant_colours(drawn(spark, [(1, 0, image)])).orderBy("rank").collect()
    assert [(r.b, r.g, r.r, r.fraction) for r in got] == [(0, 0, 0, 0.6), (250, 10, 10, 0.3), (10, 240, 10, 0.1)]


def test_main_colours_of_ordinary_frames_need_no_joins(spark, monkeypatch):
    rng = np.random.default_rng(8)
    images = [(v, f, rng.integers(0, 4 + 60 * f, (5, 6, 3))) for v in range(2) for f in range(4)]
    images.append((2, 0, np.full((2, 2, 3), 7)))
    rows = drawn(spark, images)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # frames go on in the next batch
    try:
        with monkeypatch.context() as patch:
            patch.setattr(pixels, "_joined_colours", None)
            got = sorted(pixels.dominant_colours(rows).collect())
        # the crowded frames in joins, the others at once
        monkeypatch.setattr(pixels, "FRAME_COLOURS", 28)
        mixed = sorted(pixels.dominant_colours(rows).collect())
        monkeypatch.setattr(pixels, "FRAME_COLOURS", 0)
        assert got == mixed == sorted(pixels.dominant_colours(rows).collect()) and len(got) == 25
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_main_colours_settle_on_their_means(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (12, 12, 3))
    rows = pixels.dominant_colours(drawn(spark, [(1, 0, image)])).orderBy("rank").collect()
    flat = image.reshape(-1, 3).astype(float)
    centres = np.array([[r.b, r.g, r.r] for r in rows], dtype=float)
    nearest = ((flat[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    for i, r in enumerate(rows):
        assert abs((nearest == i).mean() - r.fraction) < 0.05
        assert np.abs(flat[nearest == i].mean(axis=0) - centres[i]).max() < 6


def test_spots(spark):
    rng = np.random.default_rng(1)
    image = np.full((20, 20, 3), 90)
    image[0:6, 0:6] = rng.integers(0, 2, (6, 6, 1)) * 255
    frame = drawn(spark, [(1, 0, image)])
    spots = spark.createDataFrame([("busy", 0, 0, 6, 6), ("calm", 10, 10, 5, 5), ("away", 90, 90, 3, 3), ("cut", -2, -2, 4, 4)],
                                  "spot string, x int, y int, w int, h int")
    frames = spark.createDataFrame([(1, 0)], "video_id long, frame_index long")
    features = pixels.spot_features(frames, frame, spots, cell=4)
    got = {r.spot: r for r in occupancy.classify_by_edges(features).collect()}
    assert got["busy"].occupied and not got["calm"].occupied and not got["away"].occupied
    gray = image[0:6, 0:6, 0]
    assert got["busy"].mean == pytest.approx(gray.mean()) and got["busy"].std == pytest.approx(gray.std())
    assert got["cut"].mean == pytest.approx(image[0:2, 0:2, 0].mean())
    assert (got["away"].mean, got["calm"].std) == (0.0, 0.0)
    total = occupancy.occupancy_summary(occupancy.classify_by_edges(features), ["video_id", "frame_index"]).first()
    assert total.total_spots == 4 and total.available == 4 - total.occupied
    assert total.occupancy_rate == round(total.occupied / 4, 4)


def test_trained_classifier_separates(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0.3 if y else 0.02, 0.02), 100.0 + rng.random(), 20.0, float(y)) for y in (0, 1) for _ in range(30)]
    df = spark.createDataFrame(rows, "edge_density double, mean double, std double, label double")
    scored = occupancy.classify(df, occupancy.train_classifier(df)).collect()
    assert all(r.occupied == (r.label == 1.0) and 0 <= r.score <= 1 for r in scored)


def test_routines_by_name(spark):
    listed = [r.name for r in routine_table(spark).collect()]
    assert listed == sorted(listed) and {"color_detection", "optical_flow", "zone_counting"} <= set(listed)
    frame = drawn(spark, [(1, 0, squares([(2, 3)])), (1, 30, squares([])), (1, 31, squares([(2, 3)]))])
    footage = Footage(frames=frame.select("video_id", "frame_index").distinct(), pixels=frame)
    for names, params, found in (
        (["color_detection", "nope"], {}, "nope"), ([], {}, "asked"), (["zone_counting"], {}, "zones"),
        (["color_detection", "parking_occupancy"], {}, "spots"), (["homography_map"], {"homography_map": {"x": 1}}, "parameter x"),
    ):
        with pytest.raises(ValueError, match=found):
            run_routines(footage, names, params)
    summaries, boxes, moved = run_routines(footage, ["color_detection", "color_histogram"], {"color_detection": {"min_area": 20}})
    counts = {r.frame_index: r.summary["count"] for r in summaries.filter("routine = 'color_detection'").collect()}
    assert counts == {0: 1.0, 30: 0.0} and boxes.count() == 1 and moved is None
