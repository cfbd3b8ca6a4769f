"""The tracker against a plain loop, in batch, in chunks and as a stream."""

import glob
import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from aerospark.functions import ordered_rows, track_lanes, track_step
from aerospark.operators import tracking
from aerospark.operators.motion import track_displacement
from aerospark.operators.tracking import in_stretches, track_objects, weighed_frames
from aerospark.scale import work_path
from aerospark.streaming.inference import file_stream
from aerospark.streaming.tracking import ROW, _pack, _records, stream_tracks
from aerospark.streaming.tracking import _advance as stream_step

# Ids beyond the whole numbers a float can hold.
BIG = 10**17
BOX = "video_id long, frame_index long, det_seq long, cx double, cy double"


def plain_tracker(frames, max_distance, max_disappeared):
    """Ids by the written rules, one object at a time."""
    objects, next_id, out = {}, 0, {}
    for frame, points in frames:
        claims = []
        for oid, (x, y, _) in objects.items():
            if points:
                gaps = [math.sqrt((x - px) ** 2 + (y - py) ** 2) for _, px, py in points]
                best = min(range(len(points)), key=lambda i: (gaps[i], i))
                claims.append((gaps[best], oid, best))
        taken, matched = {}, set()
        for gap, oid, i in sorted(claims, key=lambda c: (c[0], c[1])):
            if i not in taken and gap <= max_distance:
                taken[i] = oid
                matched.add(oid)
        for oid in list(objects):
            if oid in matched:
                continue
            x, y, missed = objects[oid]
            if missed + 1 > max_disappeared:
                del objects[oid]
            else:
                objects[oid] = (x, y, missed + 1)
        for i, (seq, px, py) in enumerate(points):
            if i not in taken:
                taken[i] = next_id
                next_id += 1
            objects[taken[i]] = (px, py, 0)
            out[(frame, seq)] = taken[i]
    return out


def scene(seed):
    rng = random.Random(seed)
    walkers = [[rng.uniform(0, 200), rng.uniform(0, 200)] for _ in range(6)]
    frames = []
    for frame in range(0, 120, 2):
        points = []
        for i, walker in enumerate(walkers):
            walker[0] += rng.gauss(0, 6)
            walker[1] += rng.gauss(0, 6)
            if rng.random() < 0.8 and frame not in (40, 42, 44, 46, 48):
                points.append((BIG + i, walker[0], walker[1]))
        frames.append((frame, points))
    return frames


def as_tables(spark, scenes):
    frames = [(v, f) for v, s in scenes.items() for f, _ in s]
    boxes = [(v, f, *p) for v, s in scenes.items() for f, points in s for p in points]
    return spark.createDataFrame(frames, "video_id long, frame_index long"), spark.createDataFrame(boxes, BOX)


def wanted(scenes, **rules):
    return {(v, *key): oid for v, s in scenes.items() for key, oid in plain_tracker(s, **rules).items()}


def test_whole_and_chunked_tracks_equal_the_loop(spark):
    scenes = {1: scene(1), 2: scene(2), 3: scene(3)[:20]}
    frames, boxes = as_tables(spark, scenes)
    rules = {"max_distance": 20.0, "max_disappeared": 3}
    for chunk in (1000, 15):
        found = track_objects(frames, boxes, 20.0, 3, chunk_frames=chunk)
        got = {(r.video_id, r.frame_index, r.det_seq): r.track_id for r in found.collect()}
        assert got == wanted(scenes, **rules)


def sparse(seed, frames=400):
    """Bursts of detections with empty frames between them, up to just past the limit of 3."""
    rng = random.Random(seed)
    out, left, quiet = [], 0, 0
    for frame in range(seed, seed + frames):
        if not left and not quiet:
            left, quiet = rng.randint(1, 9), rng.randint(0, 6)
        points = []
        if left:
            left -= 1
            points = [(i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(rng.randint(1, 4))]
        else:
            quiet -= 1
        out.append((frame, points))
    return out


def test_stretches_equal_the_loop(spark):
    scenes = {1: sparse(1), 2: sparse(2), 3: [(f, []) for f in range(9)] + sparse(9, 40), 4: [(5, [])]}
    frames, boxes = as_tables(spark, scenes)
    for chunk, rows in ((1000, 4000), (30, 400_000), (30, 20), (2, 400_000)):
        found = track_objects(frames, boxes, 20.0, 3, chunk_frames=chunk, chunk_rows=rows)
        got = [((r.video_id, r.frame_index, r.det_seq), r.track_id) for r in found.collect()]
        assert len(got) == boxes.count()
        assert dict(got) == wanted(scenes, max_distance=20.0, max_disappeared=3)


def test_stretches_need_no_second_round(spark):
    """A long video with gaps is many stretches, each whole in the first round."""
    scenes = {1: sparse(1, 6000), 2: sparse(5000, 3000)}
    frames, boxes = as_tables(spark, scenes)
    # a gap of four empty frames comes often, so half a chunk of 200 frames always has one
    found = in_stretches(weighed_frames(frames, boxes, 200, 400_000), 3, 200).cache()
    assert found.count() == frames.count()
    tasks = found.groupBy("video_id", "start").agg(F.count("*").alias("n"), F.max("part").alias("part")).collect()
    assert len(tasks) > 80 and {t.part for t in tasks} == {0} and max(t.n for t in tasks) <= 200
    assert found.filter("start > frame_index").isEmpty()
    # a crowded video is cut by its rows
    crowd = spark.createDataFrame([(1, f, i, 0.0, 0.0) for f in range(40) for i in range(10)], BOX)
    parts = in_stretches(weighed_frames(crowd.select("video_id", "frame_index"), crowd, 100, 100), 3, 100).groupBy("part").count()
    assert {r["count"] for r in parts.collect()} == {10}
    found.unpersist()


def test_rounds_hang_on_legs_and_not_on_chunks(spark, monkeypatch):
    """A video without a gap is gone through in a few jobs, however small its chunks are."""
    scenes = {v: [(f, [(BIG + f, float(f % 7), 1.0)] * (f % 50 != 0)) for f in range(900)] for v in (1, 2, 3)}
    frames, boxes = as_tables(spark, scenes)
    made = []
    monkeypatch.setattr(tracking, "work_path", lambda spark, name: made.append(work_path(spark, name)) or made[-1])
    for legs, rounds in (({}, 1), ({"leg_frames": 300}, 3)):
        made.clear()
        found = track_objects(frames, boxes, 20.0, 3, chunk_frames=10, **legs)
        assert [len(glob.glob(f"{path}/round=*")) for path in made if "/tracks-" in path] == [rounds]
        got = {(r.video_id, r.frame_index, r.det_seq): r.track_id for r in found.collect()}
        assert got == wanted(scenes, max_distance=20.0, max_disappeared=3)


def test_legs_equal_the_loop(spark):
    scenes = {1: scene(1), 2: sparse(2), 3: scene(3)[:20], 4: [(5, [])]}
    frames, boxes = as_tables(spark, scenes)
    for chunk, leg in ((2, 4), (15, 15), (10, 40)):
        found = track_objects(frames, boxes, 20.0, 3, chunk_frames=chunk, leg_frames=leg)
        got = [((r.video_id, r.frame_index, r.det_seq), r.track_id) for r in found.collect()]
        assert len(got) == boxes.count() and dict(got) == wanted(scenes, max_distance=20.0, max_disappeared=3)


def test_steps_by_loops_and_by_arrays_agree(monkeypatch):
    rng, nan = random.Random(5), float("nan")
    frames = [
        rng.choice([[], [(rng.randrange(40) / 2, rng.randrange(40) / 2) for _ in range(rng.randint(1, 9))], [(nan, 1.0), (3.0, 4.0)]])
        for _ in range(300)
    ]
    given = []
    for few in (10**9, 0):
        monkeypatch.setattr(track_step, "FEW_PAIRS", few)
        tracks = track_step.Tracks()
        given.append([tracks.advance([x for x, _ in points], [y for _, y in points], 6.0, 4) for points in frames])
        given[-1].append((tracks.ids, tracks.missed))
    assert given[0] == given[1]


def test_tracks_of_nothing(spark):
    frames, boxes = spark.createDataFrame([], "video_id long, frame_index long"), spark.createDataFrame([], BOX)
    assert track_objects(frames, boxes).isEmpty()


def test_ids_stay_with_two_moving_objects(spark):
    scenes = {1: [(0, [(0, 10.0, 10.0), (1, 100.0, 100.0)]), (1, [(0, 12.0, 11.0), (1, 98.0, 102.0)])]}
    frames, boxes = as_tables(spark, scenes)
    found = track_objects(frames, boxes, 30.0)
    assert {(r.frame_index, r.det_seq): r.track_id for r in found.collect()} == {
        (0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 1,
    }


def test_a_frame_split_over_two_deliveries_is_held(spark):
    scenes = {1: scene(6), 2: scene(7)}
    frames, boxes = as_tables(spark, scenes)
    rows = frames.join(boxes, ["video_id", "frame_index"], "left")
    source, out, checkpoint = (work_path(spark, n) for n in ("frames", "tracks", "checkpoint"))
    # the detections of frame 40 come in two parts, and an empty frame ends each video
    early = (F.col("frame_index") < 40) | ((F.col("frame_index") == 40) & (F.coalesce("det_seq", F.lit(0)) % 2 == 0))
    end = rows.groupBy("video_id").agg((F.max("frame_index") + 1).alias("frame_index"))
    for part in (rows.filter(early), rows.filter(~early), end.selectExpr(
        "video_id", "frame_index", "cast(null AS long) AS det_seq", "cast(null AS double) AS cx", "cast(null AS double) AS cy"
    )):
        part.select(rows.columns).write.mode("append").parquet(source)
        stream = file_stream(spark, source, rows.schema, "parquet")
        stream_tracks(stream, 20.0, 3, hold_last=True).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(out)
    got = {(r.video_id, r.frame_index, r.det_seq): r.track_id for r in found.collect()}
    assert got == wanted(scenes, max_distance=20.0, max_disappeared=3) and not found.filter("rejected").count()


def test_stream_equals_batch_and_rejects_late_frames(spark):
    scenes = {1: scene(4), 2: scene(5)}
    frames, boxes = as_tables(spark, scenes)
    rows = frames.join(boxes, ["video_id", "frame_index"], "left")
    source, out, checkpoint = (work_path(spark, n) for n in ("frames", "tracks", "checkpoint"))

    def deliver(part):
        part.write.mode("append").parquet(source)
        stream = file_stream(spark, source, rows.schema, "parquet")
        stream_tracks(stream, 20.0, 3).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", checkpoint
        ).trigger(availableNow=True).start().awaitTermination()

    deliver(rows.filter("frame_index < 50"))
    deliver(rows.filter("frame_index >= 50"))
    deliver(spark.createDataFrame([(1, 10, 77, 1.0, 1.0)], BOX))
    found = spark.read.parquet(out)
    got = {
        (r.video_id, r.frame_index, r.det_seq): r.track_id for r in found.filter("NOT rejected").collect()
    }
    assert got == wanted(scenes, max_distance=20.0, max_disappeared=3)
    late = found.filter("rejected").collect()
    assert [(r.det_seq, r.track_id) for r in late] == [(77, None)]
    assert found.filter(F.col("rejected")).count() == 1


class OneState:
    """A group's state, kept in the test."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_delivery_costs_its_rows(monkeypatch):
    """A video's rows are gone through once, not once a frame."""
    n = 40_000
    rows = pd.DataFrame({
        "video_id": 1, "frame_index": np.arange(n) // 2, "det_seq": np.arange(n) % 2, "present": True,
        "cx": 1.0, "cy": 100.0 * (np.arange(n) % 2),
    }).sample(frac=1.0, random_state=3)
    seen, flatnonzero = [], np.flatnonzero
    monkeypatch.setattr(np, "flatnonzero", lambda values: seen.append(len(values)) or flatnonzero(values))
    state = OneState()
    (found,) = stream_step(50.0, 10, True)((1,), iter([rows]), state)
    assert sum(seen) <= 3 * n
    assert len(found) == n - 2 and state.get[6] == n // 2 - 1 and state.get[7] == [0, 1]
    assert (found["track_id"] == found["det_seq"]).all() and not found["rejected"].any()


def test_rows_beyond_those_held_go_through_the_disk(monkeypatch):
    """Records come in order in blocks, a first key never in two of them, whatever the runs hold."""
    kind = np.dtype([("a", "i8"), ("b", "i8")])
    rng = np.random.default_rng(4)
    monkeypatch.setattr(ordered_rows, "LEAST_READ", 3)
    for n, keys, held in ((0, 5, 10), (7, 5, 10), (10, 5, 10), (1000, 400, 64), (1000, 3, 64), (1000, 1, 10), (5000, 2500, 16)):
        rows = np.empty(n, dtype=kind)
        rows["a"], rows["b"] = rng.integers(0, keys, n), rng.permutation(n)
        given = iter([rows[i : i + 9] for i in range(0, n, 9)])
        blocks = list(ordered_rows.in_order(given, ("a", "b"), held))
        assert all(len(block) for block in blocks)
        whole = np.concatenate([*blocks, rows[:0]])
        assert np.array_equal(whole, rows[np.lexsort((rows["b"], rows["a"]))])
        assert all(left["a"][-1] < right["a"][0] for left, right in zip(blocks[:-1], blocks[1:]))
        assert keys < 400 or n <= held or max(map(len, blocks)) <= max(4 * held, n // 2)


def test_a_delivery_is_not_held_whole(monkeypatch):
    """However many rows a video has in a delivery, a task holds a bounded number of them."""
    monkeypatch.setattr(ordered_rows, "HELD_ROWS", 10_000)
    monkeypatch.setattr(ordered_rows, "LEAST_READ", 64)
    n = 400_000
    places = np.random.default_rng(2).permutation(n)
    batches = (
        pd.DataFrame({
            "video_id": 1, "frame_index": part // 2, "det_seq": part % 2, "present": True, "cx": 1.0, "cy": 100.0 * (part % 2),
        })
        for part in np.split(places, 80)
    )
    state, count, last = OneState(), 0, -1
    tracemalloc.start()
    for found in stream_step(50.0, 10, False)((1,), batches, state):
        assert found["frame_index"].iloc[0] > last and found["frame_index"].is_monotonic_increasing
        assert (found["track_id"] == found["det_seq"]).all() and not found["rejected"].any()
        count, last = count + len(found), found["frame_index"].iloc[-1]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == n and state.get[1] == n // 2 - 1
    assert most < n * 33 // 2


def test_deliveries_in_blocks_equal_the_loop(monkeypatch):
    """Late, split and empty frames, where every delivery goes through many blocks."""
    monkeypatch.setattr(ordered_rows, "LEAST_READ", 4)
    monkeypatch.setattr(ordered_rows, "HELD_ROWS", 24)
    frames = scene(9)
    rows = pd.DataFrame(
        [(1, f, seq, True, x, y) for f, points in frames for seq, x, y in points]
        + [(1, f, -1, False, np.nan, np.nan) for f, points in frames if not points],
        columns=["video_id", "frame_index", "det_seq", "present", "cx", "cy"],
    )
    end = frames[-1][0]
    step, state, parts = stream_step(20.0, 3, True), OneState(), []
    # frame 40 comes in two deliveries, and the second has a row of a frame that is done
    early = (rows["frame_index"] < 40) | ((rows["frame_index"] == 40) & (rows["det_seq"] % 2 == 0))
    late = pd.DataFrame([(1, 10, 77, True, 1.0, 1.0)], columns=rows.columns)
    closing = pd.DataFrame([(1, end + 1, -1, False, np.nan, np.nan)], columns=rows.columns)
    for part in (rows[early], pd.concat([rows[~early], late]), closing):
        shuffled = part.sample(frac=1.0, random_state=5)
        parts += list(step((1,), iter([shuffled[i : i + 7] for i in range(0, len(shuffled), 7)]), state))
    assert len(parts) > 6
    found = pd.concat(parts)
    rejected = found["rejected"]
    assert found[rejected][["frame_index", "det_seq"]].values.tolist() == [[10, 77]] and found[rejected]["track_id"].isna().all()
    got = {(r.frame_index, r.det_seq): r.track_id for r in found[~rejected].itertuples()}
    assert got == plain_tracker(frames, 20.0, 3)
    assert state.get[6] == end + 1 and list(state.get[7]) == []


def test_packets_hold_their_rows():
    """Rows of several videos and of none, big ids, places that are no numbers, and packets of one row."""
    rng = np.random.default_rng(8)
    for n in (1, 700, 5000):
        video = pa.array(rng.integers(0, 3, n), mask=rng.random(n) < 0.1)
        present = rng.random(n) < 0.9
        rows = {
            "frame_index": rng.integers(-5, BIG, n), "det_seq": np.where(present, rng.integers(0, BIG, n), -1), "present": present,
            "cx": np.where(present, rng.random(n), np.nan), "cy": np.where(present, rng.choice([0.5, -0.0, np.inf], n), np.nan),
        }
        whole = pa.RecordBatch.from_pydict({"video_id": video, **{k: pa.array(v, from_pandas=k in ("cx", "cy")) for k, v in rows.items()}})
        packets = pa.Table.from_batches(list(_pack(iter([whole[:300], whole[300:]])))).to_pandas()
        assert packets["n"].between(1, 256).all() and packets["n"].sum() == n
        for key in (0.0, 1.0, 2.0, None):
            mine = packets[packets["video_id"].isna() if key is None else packets["video_id"] == key]
            want = np.array([v is None if key is None else v == key for v in video.to_pylist()])
            got = np.concatenate([np.empty(0, dtype=ROW), *_records(iter([mine]))])
            got = got[np.lexsort((got["det_seq"], got["frame_index"]))]
            order = np.lexsort((rows["det_seq"][want], rows["frame_index"][want]))
            assert all(np.array_equal(got[k], v[want][order], equal_nan=k in ("cx", "cy")) for k, v in rows.items())


def test_packets_are_small():
    """Spark gathers all rows of a video and delivery; packed they take less than half of what they take as columns."""
    n = 100_000
    rng = np.random.default_rng(3)
    frames = np.arange(n) // 4
    whole = pa.RecordBatch.from_pydict({
        "video_id": np.full(n, 7), "frame_index": frames, "det_seq": frames * 10 + np.arange(n) % 4, "present": np.ones(n, dtype=bool),
        "cx": rng.integers(0, 4000, n) / 2.0, "cy": rng.integers(0, 4000, n) / 2.0,
    })
    packed = sum(len(p) for batch in _pack(iter([whole])) for p in batch.column("packet").to_pylist())
    assert packed < whole.nbytes / 2


def test_displacement_a_frame(spark):
    tracks = spark.createDataFrame(
        [(1, 0, 7, 0), (1, 1, 7, 0), (1, 4, 9, 0), (1, 4, 8, 1), (1, 9000, 1, 0), (2, 5, 1, 0), (1, 2, 3, 2), (1, 3, 3, 2)],
        "video_id long, frame_index long, det_seq long, track_id long",
    )
    boxes = spark.createDataFrame(
        [(1, 0, 7, 1.0, 1.0), (1, 1, 7, 4.0, 0.0), (1, 4, 9, 10.0, 6.0), (1, 4, 8, 50.0, 50.0), (1, 9000, 1, 10.0, 6.0),
         (2, 5, 1, 3.0, 3.0), (1, 2, 3, None, 4.0), (1, 3, 3, 5.0, 5.0), (1, 3, 4, 9.0, 9.0)],
        "video_id long, frame_index long, det_seq long, cx double, cy double",
    )
    got = sorted(map(tuple, track_displacement(tracks, boxes).collect()))
    assert got == [(1, 1, 0, 3.0, -1.0), (1, 4, 0, 2.0, 2.0), (1, 9000, 0, 0.0, 0.0)]
    assert track_displacement(tracks.limit(0), boxes).count() == 0


def lane_rounds(monkeypatch):
    """The folders of the rounds of lanes, and of the legs, that calls from now on write."""
    made = []
    monkeypatch.setattr(tracking, "work_path", lambda spark, name: made.append(work_path(spark, name)) or made[-1])
    return lambda name: [len(glob.glob(f"{path}/round=*")) for path in made if f"/{name}-" in path]


def test_lanes_equal_the_loop(spark, monkeypatch):
    rng = random.Random(4)
    crowd = [(f, [(BIG + i, rng.randrange(60) / 2, rng.randrange(60) / 2) for i in range(3)]) for f in range(0, 1200, 3)]
    # a hole in the frame numbers, longer than a lane
    hole = [(f, [(0, 100.0, 100.0), (1, 10.0, 10.0)][: 1 + (f > 7)]) for f in [*range(300), *range(5000, 5300)]]
    scenes = {1: scene(1), 2: sparse(2, 900), 3: scene(3)[:20], 4: [(5, [])], 5: crowd, 6: hole}
    frames, boxes = as_tables(spark, scenes)
    rounds = lane_rounds(monkeypatch)
    for limit, repeats, warm in ((10**6, 6, 40), (900, 6, 0), (10**6, 0, 0)):
        monkeypatch.setattr(tracking, "TASK_LIMIT", limit)
        monkeypatch.setattr(tracking, "REPEATS", repeats)
        found = track_objects(frames, boxes, 20.0, 3, chunk_frames=20, lanes_from=10, lane_frames=40, warm_frames=warm)
        got = [((r.video_id, r.frame_index, r.det_seq), r.track_id) for r in found.collect()]
        assert len(got) == boxes.count() and dict(got) == wanted(scenes, max_distance=20.0, max_disappeared=3)
    # the hole is mended by repeating lanes; the videos of lanes that are given up go through the legs
    first, given_up, unmended = rounds("lanes")
    assert 1 < first <= 7 and unmended == 1 and given_up >= 1 and len(rounds("tracks")) >= 1


def test_a_long_video_is_one_round(spark, monkeypatch):
    """Objects come and go in a video without a gap, and still no lane waits for another."""
    rng = random.Random(8)
    scenes = {v: [(f, [(i, rng.uniform(0, 200), rng.uniform(0, 200)) for i in range(rng.randint(1, 5))]) for f in range(2500)] for v in (1, 2)}
    frames, boxes = as_tables(spark, scenes)
    rounds = lane_rounds(monkeypatch)
    found = track_objects(frames, boxes, 50.0, 10, lanes_from=2000, lane_frames=600)
    got = {(r.video_id, r.frame_index, r.det_seq): r.track_id for r in found.collect()}
    assert got == wanted(scenes, max_distance=50.0, max_disappeared=10)
    assert rounds("lanes") == [1] and rounds("tracks") == []


def test_a_tie_between_first_objects_goes_by_their_age(spark, monkeypatch):
    """A lane sees the younger object first; a centre midway between both belongs to the older one."""
    shown = [(0, 10.0, 10.0), (1, 40.0, 10.0)]
    both = [(f, shown[1:] if f < 5 else shown) for f in range(400)]
    scenes = {1: both[:250] + [(250, [(0, 25.0, 10.0)])] + both[251:], 2: both}
    frames, boxes = as_tables(spark, scenes)
    rounds = lane_rounds(monkeypatch)
    found = track_objects(frames, boxes, 20.0, 3, lanes_from=10, lane_frames=60, warm_frames=40)
    got = {(r.video_id, r.frame_index, r.det_seq): r.track_id for r in found.collect()}
    assert got == wanted(scenes, max_distance=20.0, max_disappeared=3) and got[1, 250, 0] == 0
    assert rounds("lanes")[0] > 1 and rounds("tracks") == []


def test_lanes_and_single_steps_agree():
    rng = np.random.default_rng(3)
    for mean, grid, reach, limit in ((4, 400, 50.0, 10), (2, 40, 6.0, 3), (20, 200, 10.0, 4), (0, 10, 5.0, 2)):
        lengths = rng.integers(1, 120, 12)
        warm = np.array([min(int(rng.integers(0, 50)), n - 1) for n in lengths])
        lane_begins, counts = np.r_[0, np.cumsum(lengths)], rng.poisson(mean, lengths.sum())
        begins = np.cumsum(counts) - counts
        xs, ys = (rng.integers(0, grid, counts.sum()) / 2.0 for _ in range(2))
        if mean == 2:
            xs[::50], ys[::77] = math.nan, math.inf
        with np.errstate(all="ignore"):
            given, lanes = track_lanes.advance_lanes(lane_begins, warm, begins, counts, xs, ys, reach, limit)
        for i, lane in enumerate(lanes):
            tracks, first = track_step.Tracks(), 0
            for at in range(lane_begins[i], lane_begins[i + 1]):
                if at - lane_begins[i] == warm[i]:
                    first = tracks.next_id = len(tracks.ids)
                    tracks.ids = list(range(first))
                mine = slice(begins[at], begins[at] + counts[at])
                ids = tracks.advance(xs[mine].tolist(), ys[mine].tolist(), reach, limit)
                if at - lane_begins[i] >= warm[i]:
                    assert given[mine].tolist() == [n - first if n >= first else -1 - n for n in ids]
            assert lane.last.ids.tolist() == tracks.ids and lane.last.missed.tolist() == tracks.missed
            assert np.array_equal(lane.last.xs, tracks.xs, equal_nan=True) and lane.born == tracks.next_id - first
