"""Thinned and followed edges against a plain loop over pixels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospark.operators import edges

SHADED = "image long, x int, y int, gray int"


def gradients(image):
    wide = np.pad(image.astype(int), 1, mode="edge")
    smooth = wide[:-2] + 2 * wide[1:-1] + wide[2:]
    dx = smooth[:, 2:] - smooth[:, :-2]
    smooth = wide[:, :-2] + 2 * wide[:, 1:-1] + wide[:, 2:]
    return dx, smooth[2:] - smooth[:-2]


def plain(image, low, high):
    """Crests above ``low`` and those of them that hang together with one above ``high``."""
    dx, dy = gradients(image)
    size = np.pad(abs(dx) + abs(dy), 1)
    thin = {}
    for y, x in np.ndindex(image.shape):
        m, h, v = size[y + 1, x + 1], dx[y, x], dy[y, x]
        angle = math.degrees(math.atan2(abs(v), abs(h)))
        if angle < 22.5:
            crest = m > size[y + 1, x] and m >= size[y + 1, x + 2]
        elif angle > 67.5:
            crest = m > size[y, x + 1] and m >= size[y + 2, x + 1]
        else:
            side = -1 if (h < 0) != (v < 0) else 1
            crest = m > size[y, x + 1 - side] and m > size[y + 2, x + 1 + side]
        if m > low and crest:
            thin[x, y] = bool(m > high)
    reached = [p for p, strong in thin.items() if strong]
    seen = set(reached)
    while reached:
        x, y = reached.pop()
        for p in ((x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
            if p in thin and p not in seen:
                seen.add(p)
                reached.append(p)
    return thin, seen


def shaded(spark, images):
    rows = [(k, x, y, int(v)) for k, image in enumerate(images) for (y, x), v in np.ndenumerate(image)]
    return spark.createDataFrame(rows, SHADED)


@pytest.mark.parametrize("low, high", [(50, 150), (120, 400), (0, 10_000)])
def test_edges_equal_a_plain_loop(spark, low, high):
    rng = np.random.default_rng(3)
    step = np.zeros((18, 25), int)
    step[:, 12:] = np.linspace(5, 120, 18).astype(int)[:, None]  # weak above, strong below, one edge
    bars = np.zeros((12, 12), int)
    bars[:, 3], bars[8:, 8:], bars[0, 11] = 30, 255, 20
    images = [step, step.T, bars, rng.integers(0, 256, (9, 21)), rng.integers(90, 110, (14, 14)), np.full((1, 1), 7),
              rng.integers(0, 3, (16, 16)) * 40]
    thin = edges.thin_edges(shaded(spark, images), ["image"], low, high)
    marked = {k: {} for k in range(len(images))}
    for r in thin.collect():
        marked[r.image][r.x, r.y] = r.strong
    followed = {k: set() for k in range(len(images))}
    for r in edges.followed_runs(thin, ["image"]).collect():
        followed[r.image] |= {(x, r.y) for x in range(r.a, r.b + 1)}
    for k, image in enumerate(images):
        assert (marked[k], followed[k]) == plain(image, low, high)
    if low == 50:
        assert any(not marked[0][p] for p in followed[0]) and set(marked[2]) - followed[2]


def test_missing_values_and_pixels(spark):
    image = np.zeros((7, 7), int)
    image[:, 4:] = 200
    whole = shaded(spark, [image])
    assert edges.thin_edges(whole.limit(0), ["image"]).count() == 0
    assert edges.followed_runs(edges.thin_edges(whole.limit(0), ["image"]), ["image"]).count() == 0
    hidden = whole.withColumn("gray", F.when((F.col("x") != 3) | (F.col("y") != 3), F.col("gray")))
    found = {(r.x, r.y) for r in edges.thin_edges(hidden, ["image"]).collect()}
    assert found and not any(abs(x - 3) < 2 and abs(y - 3) < 2 for x, y in found)
    apart = whole.filter("x <> 3")  # a gap is a border, so nothing changes on either side
    assert edges.thin_edges(apart, ["image"]).count() == 0


def test_spots(spark):
    image = np.full((20, 20), 90)
    image[2:6, 2:6] = 250
    frame = shaded(spark, [image]).selectExpr(
        "7L AS video_id", "image AS frame_index", "x", "y", "gray AS b", "gray AS g", "gray AS r"
    )
    spots = spark.createDataFrame(
        [("busy", 0, 0, 9, 9), ("calm", 10, 10, 5, 5), ("away", 90, 90, 3, 3), ("cut", -2, -2, 7, 7)],
        "spot string, x int, y int, w int, h int",
    )
    frames = frame.select("video_id", "frame_index").distinct()
    got = {r.spot: r for r in edges.hysteresis_features(frames, frame, spots, cell=4).collect()}
    for name, part in (("busy", image[0:9, 0:9]), ("calm", image[10:15, 10:15]), ("cut", image[0:5, 0:5])):
        assert got[name].edge_density == pytest.approx(len(plain(part, edges.LOW, edges.HIGH)[1]) / part.size)
        assert got[name].mean == pytest.approx(part.mean()) and got[name].std == pytest.approx(part.std())
    assert got["busy"].edge_density > 0 == got["calm"].edge_density
    assert (got["away"].edge_density, got["away"].mean, got["away"].std) == (0, 0, 0)


def test_ordinary_spots_settle_in_arrays(spark, monkeypatch):
    rng = np.random.default_rng(5)
    images = [rng.integers(0, 256, (12, 17)) * (rng.random((12, 17)) < 0.4) for _ in range(40)]
    images += [rng.integers(90, 140, (12, 17)) for _ in range(5)] + [np.full((12, 17), 8)]
    frame = shaded(spark, images).filter("image <> 3 OR x <> 5 AND y <> 2").selectExpr(
        "image % 3 AS video_id", "image AS frame_index", "x", "y",
        *[f"CASE WHEN image <> 7 OR x <> 4 THEN gray END AS {c}" for c in "bgr"],
    ).localCheckpoint()
    spots = spark.createDataFrame(
        [("whole", 0, 0, 17, 12), ("part", 2, 3, 6, 5), ("cut", 14, -2, 9, 9), ("line", 0, 4, 17, 1), ("dot", 3, 3, 1, 1)],
        "spot string, x int, y int, w int, h int",
    )
    frames = frame.select("video_id", "frame_index").distinct()

    def found():
        made = edges.hysteresis_features(frames, frame, spots, 50, 400, cell=4)
        return {(r.frame_index, r.spot): (r.edge_density, round(r.mean, 9), round(r.std, 9)) for r in made.collect()}

    monkeypatch.setattr(edges, "IMAGE_PIXELS", 0)
    joined = found()
    monkeypatch.setattr(edges, "IMAGE_PIXELS", 50)
    mixed = found()
    monkeypatch.setattr(edges, "IMAGE_PIXELS", 65_536)
    monkeypatch.setattr(edges, "label_runs", None)  # not needed for ordinary spots
    assert found() == mixed == joined and len(joined) == 46 * 5
    assert joined[0, "whole"][0] == pytest.approx(len(plain(images[0], 50, 400)[1]) / images[0].size) != 0


def test_tasks_of_edges_follow_the_pixels(spark, monkeypatch):
    seen = []
    inner = edges._image_edges
    monkeypatch.setattr(edges, "_image_edges", lambda *given: seen.append(given[-1]) or inner(*given))
    monkeypatch.setattr(edges, "TASK_PIXELS", 10)
    image = np.full((20, 20), 90)
    frame = shaded(spark, [image]).selectExpr("7L AS video_id", "image AS frame_index", "x", "y", "gray AS b", "gray AS g", "gray AS r")
    spots = spark.createDataFrame([("all", 0, 0, 20, 20)], "spot string, x int, y int, w int, h int")
    frames = frame.select("video_id", "frame_index").distinct()
    assert edges.hysteresis_features(frames, frame, spots).first().edge_density == 0
    assert seen == [40]
