"""Nothing is dropped past an old bound, at a tie, at an odd cell or outside a video."""

import pytest
from pyspark.sql import functions as F

from aerospark.functions import json_cells
from aerospark.functions.events import event_field, numeric_only
from aerospark.operators.catalog import rank_models
from aerospark.operators.digest import child_events, earliest, summarize_scenes
from aerospark.operators.frames import contiguous_frames, representative_frames, sample_frames
from aerospark.operators.pixels import spot_features
from aerospark.operators.reports import page_before
from aerospark.operators.tracking import track_objects
from aerospark.operators.zones import zone_counts
from aerospark.sources.model_outputs import explode_model_outputs


def test_long_runs_of_frames(spark):
    stored = spark.range(20_000).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_index"))
    counts = contiguous_frames(stored)
    assert counts.first().frame_count == 20_000
    assert [r.frame_index for r in representative_frames(counts).orderBy("choice").collect()] == [0, 10_000, 19_999]
    assert sample_frames(stored, 1).count() == 20_000 and sample_frames(stored, 1, 300).count() == 300


@pytest.mark.parametrize("size", [1, 2, 3])
def test_pages_keep_tied_rows(spark, size):
    rows = [("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 0), ("f", 2), ("g", 2)]
    table = spark.createDataFrame(rows, "event_id string, created int")
    seen, cursor, after = [], None, None
    while found := page_before(table, "created", cursor, size, after=after).collect():
        seen += [r.event_id for r in found]
        cursor, after = F.lit(found[-1].created), F.lit(found[-1].event_id)
    assert seen == ["f", "g", "a", "b", "c", "d", "e"]


def test_open_cells_that_are_no_objects(spark):
    df = spark.createDataFrame([('"text"',), ("[1]",), ('{"k":"v","n":2}',), ("7",), (None,)], "t string").select(
        F.parse_json("t").alias("attributes")
    )
    assert [r[0] for r in df.select(event_field("attributes.k", df.columns)).collect()] == [None, None, "v", None, None]
    assert [r[0] for r in df.select(numeric_only(F.col("attributes"))).collect()] == [{}, {}, {"n": 2.0}, {}, {}]


def test_texts_that_look_empty_are_not(spark):
    texts = ['"[]"', '"{}"', '"false"', '""', "[]", "{}", "false", "0", "null", "[0]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(json_cells.is_empty(F.parse_json("t"))).collect()]
    assert got == [False, False, False, True, True, True, True, True, True, False]


def test_uneven_model_arrays_are_refused(spark):
    rows = spark.createDataFrame(
        [([[0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0]], [0.5], [0.0, 1.0])],
        "boxes array<array<double>>, scores array<double>, classes array<double>",
    )
    with pytest.raises(Exception, match="as many"):
        explode_model_outputs(rows).collect()


def test_zones_and_spots_of_one_video(spark):
    square = [[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]]
    zones = spark.createDataFrame([(1, "a", square), (2, "b", square), (2, "c", square)], "video_id long, zone string, polygon array<array<double>>")
    frames = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "video_id long, frame_index long")
    boxes = spark.createDataFrame([(v, 0, 0, 5.0, 5.0) for v in (1, 2, 3)], "video_id long, frame_index long, det_seq long, cx double, cy double")
    got = {r.video_id: ([z.zone for z in r.zones], r.total) for r in zone_counts(frames, boxes, zones).collect()}
    assert got == {1: (["a"], 1), 2: (["b", "c"], 2), 3: ([], 0)}
    grid = spark.createDataFrame([(v, 0, x, y, 9, 9, 9) for v in (1, 2) for x in range(4) for y in range(4)],
                                 "video_id long, frame_index long, x int, y int, b int, g int, r int")
    spots = spark.createDataFrame([(1, "p", 0, 0, 2, 2), (2, "q", 1, 1, 2, 2)], "video_id long, spot string, x int, y int, w int, h int")
    assert {(r.video_id, r.spot, r["mean"]) for r in spot_features(frames, grid, spots).collect()} == {(1, "p", 9.0), (2, "q", 9.0)}


def test_many_zones(spark):
    zones = spark.range(10_050).selectExpr(
        "concat('z', id) AS zone", "array(array(id * 1.0D, 0D), array(id + 0.9D, 0D), array(id + 0.9D, 9D), array(id * 1.0D, 9D)) AS polygon"
    )
    frames = spark.createDataFrame([(1, 0)], "video_id long, frame_index long")
    boxes = spark.createDataFrame([(1, 0, 0, 10_049.5, 5.0)], "video_id long, frame_index long, det_seq long, cx double, cy double")
    row = zone_counts(frames, boxes, zones).first()
    assert row.total == 1 and len(row.zones) == 10_050


def test_detections_of_unlisted_frames_are_tracked(spark):
    frames = spark.createDataFrame([(1, 0)], "video_id long, frame_index long")
    boxes = spark.createDataFrame([(1, 0, 0, 5.0, 5.0), (1, 1, 0, 6.0, 5.0), (2, 4, 0, 1.0, 1.0)],
                                  "video_id long, frame_index long, det_seq long, cx double, cy double")
    for chunk in (1, 100):
        got = {(r.video_id, r.frame_index, r.track_id) for r in track_objects(frames, boxes, chunk_frames=chunk).collect()}
        assert got == {(1, 0, 0), (1, 1, 0), (2, 4, 0)}


def test_first_models_only(spark):
    catalog = spark.createDataFrame([(f"m{k}", ["car"], "detect", "low", False) for k in range(5)],
                                    "id string, capabilities array<string>, task string, altitude string, tiled boolean")
    asked = spark.createDataFrame([(1, ["car"], "detect", "low", 100, 100)],
                                  "n int, classes array<string>, task string, altitude string, width int, height int")
    assert [r.model_id for r in rank_models(asked, catalog, top=2).orderBy("rank").collect()] == ["m0", "m1"]
    assert rank_models(asked, catalog).count() == 5


def scene_events(spark, n):
    return spark.range(n).selectExpr(
        "concat('e', id) AS event_id", "'t' AS trace_id", "concat('s', id) AS span_id", "cast(null AS string) AS parent_span_id",
        "timestampadd(SECOND, cast(id AS int), TIMESTAMP_NTZ'2026-01-01 00:00:00') AS timestamp", "'routine:x' AS source",
        "1L AS video_id", "id AS frame_index", "map('n', 1.0D) AS metrics",
    )


def test_hot_scenes_are_cut_before_the_shuffle_of_their_key(spark):
    events = scene_events(spark, 9_000)
    plan = earliest(events, ["video_id"], 5_000)._jdf.queryExecution().optimizedPlan().toString()
    inner, outer = plan.rfind("_place"), plan.find("rank")
    assert 0 <= outer < inner and "_slice" in plan
    assert summarize_scenes(events, ["video_id"]).first().metrics["events_summarized"] == 9_000
    limited = summarize_scenes(events, ["video_id"], limit=5_000).first()
    assert limited.metrics["events_summarized"] == 5_000 and limited.metrics["frames_covered"] == 5_000


def test_parents_are_sought_in_the_same_trace(spark):
    rows = [("a", "t1", "s1", None, "x"), ("b", "t2", "s1", None, "x"), ("c", "t1", "s2", "s1", "x")]
    events = spark.createDataFrame(rows, "event_id string, trace_id string, span_id string, parent_span_id string, source string")
    assert [(r.event_id, r.parent_event_id) for r in child_events(events).collect()] == [("c", "a")]
