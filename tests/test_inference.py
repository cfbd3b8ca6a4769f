"""Contexts, result rows, clients and model outputs."""

import json

import pytest
from pyspark.sql import functions as F

from aerospark.functions import boxes as box_functions
from aerospark.functions import json_cells, text
from aerospark.operators.catalog import rank_models, select_model
from aerospark.operators.inference import run_inference
from aerospark.operators.reports import run_metrics
from aerospark.scale import work_path
from aerospark.sources.clients import InClusterClient, RemoteClient
from aerospark.sources.model_outputs import explode_model_outputs, with_labels
from aerospark.sources.tables import explode_tracks, ingest, precompute_features, read_files, write_results


def context_of(spark, row, schema, **options):
    df = spark.createDataFrame([row], schema)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return json.loads(df.select(json_cells.row_to_context(kinds, **options)).first()[0])


def test_contexts_from_text_and_native_cells(spark):
    got = context_of(
        spark, ('[{"id":1}]', {"altitude": 120}, '{"mean_speed":0.5}', "count", None),
        "tracks string, sensor_meta map<string,int>, precomputed_features string, query string, frames string",
    )
    assert got == {"tracks": [{"id": 1}], "sensor_meta": {"altitude": 120}, "precomputed_features": {"mean_speed": 0.5}, "query": "count"}


def test_odd_context_cells(spark):
    shape = "tracks string, query string, frames string"
    assert context_of(spark, (None, None, "  "), shape) == {}
    assert context_of(spark, ('{"id":1}', "{oops", "[]"), shape) == {"tracks": [{"id": 1}], "query": "{oops"}
    heavy = (None, "q", '[{"frame_index":0}]')
    assert context_of(spark, heavy, shape) == {"query": "q", "frames": [{"frame_index": 0}]}
    assert context_of(spark, heavy, shape, include_frames=False) == {"query": "q"}


def test_payload_counts(spark):
    cases = {
        '{"results":[{"a":[1]},null,"x"]}': 3, '{"tracks":[[],[]],"detections":[]}': 0, '{"tracks":{"id":4}}': 0,
        '{"summary":{"count":true}}': 1, '{"summary":{"count":7.0}}': 7, '{"detections":[[1,2],[3,4],[5]]}': 3,
        '{"summary":{"count":2.9}}': 2, '{"detections":"x","results":[1,2,3]}': 3, '{"other":[1,2]}': 0,
    }
    df = spark.createDataFrame([(p,) for p in cases], "p string")
    got = {r.p: r.n for r in df.select("p", json_cells.count_detections(F.parse_json("p")).alias("n")).collect()}
    assert got == cases


ROWS = [("1", None, '[{"id":1},{"id":2}]'), ("x", "5", '[{"id":3}]'), ("2", "6", "[]")]


def test_batch_inference_keeps_failures_apart(spark):
    def infer(context, model):
        if "tracks" not in context:
            raise ValueError("nothing to see")
        return {"detections": context["tracks"]}

    rows = spark.createDataFrame(ROWS, "video_id string, frame_index string, tracks string")
    got = run_inference(rows, "m", lambda: InClusterClient(infer))
    by = {(r.video_id, r.frame_index): r for r in got.collect()}
    assert by[(1, None)].num_detections == 2 and by[(None, 5)].num_detections == 1
    failed = by[(2, 6)]
    assert (failed.error, failed.result_json, failed.num_detections) == ("nothing to see", "{}", 0)
    assert run_metrics(got, 2).first().asDict() == {"rows": 3.0, "batches": 2.0, "errors": 1.0, "detections": 3.0}


def test_batched_calls_and_their_fall_back(spark, tmp_path):
    log = str(tmp_path / "calls")

    def note(text):
        with open(log, "a") as file:
            file.write(text + "\n")

    def one(context, model):
        note("one")
        if context["query"] == "bad":
            raise ValueError("bad row")
        return {"detections": [context["query"]]}

    def many(contexts, model):
        note(f"many {len(contexts)}")
        return [{"detections": [c["query"]]} for c in contexts if c["query"] != "short"] if all(
            c["query"] != "bad" for c in contexts) else 1 / 0

    rows = [(str(k), "0", q) for k, q in enumerate(["a", "b", "c", "bad", "d", "short", "e"])]
    table = spark.createDataFrame(rows, "video_id string, frame_index string, query string").coalesce(1)
    got = run_inference(table, "m", lambda: InClusterClient(one, many), batch_size=2).collect()
    by = {r.video_id: (r.num_detections, r.error) for r in got}
    assert by == {k: (0, "bad row") if k == 3 else (1, None) for k in range(7)}
    with open(log) as file:
        assert file.read().split("\n")[:-1] == ["many 2", "many 2", "one", "one", "many 2", "one", "one", "one"]
    with pytest.raises(ValueError):
        run_inference(table, "m", lambda: InClusterClient(one), batch_size=0)


def test_clients_without_or_with_a_wrong_function():
    with pytest.raises(RuntimeError):
        InClusterClient().infer({}, "m")
    with pytest.raises(TypeError):
        InClusterClient(lambda c, m: [1]).infer({}, "m")


def remote(answers, **options):
    calls, pauses = [], []

    def transport(url, payload, headers, timeout):
        calls.append((payload, headers))
        answer = answers[len(calls) - 1]
        if isinstance(answer, Exception):
            raise answer
        return answer

    return RemoteClient("http://model", transport=transport, sleep=pauses.append, **options), calls, pauses


def test_remote_client_retries_with_doubling_pauses():
    client, calls, pauses = remote([(503, ""), TimeoutError("slow"), (200, '{"ok":1}')], api_key="k", backoff=0.5)
    assert client.infer({"query": "q"}, "m") == {"ok": 1}
    assert calls[0][0] == {"model_name": "m", "context": {"query": "q"}}
    assert calls[0][1]["Authorization"] == "Bearer k" and pauses == [0.5, 1.0]


def test_remote_client_gives_up():
    client, calls, _ = remote([(500, "")] * 3, max_retries=2)
    with pytest.raises(RuntimeError, match="3 tries"):
        client.infer({}, "m")
    client, calls, _ = remote([(404, "")], max_retries=2)
    with pytest.raises(RuntimeError, match="404"):
        client.infer({}, "m")
    assert len(calls) == 1


def test_model_output_layouts(spark):
    three = spark.createDataFrame([(1, [[0.0, 0.0, 1.0, 1.0]], [0.9], [1.0])], "id long, dets array<array<double>>, scores array<double>, classes array<double>")
    one = spark.createDataFrame([(1, [[0.0, 0.0, 1.0, 1.0, 0.9, 1.0]])], "id long, outputs array<array<double>>")
    assert explode_model_outputs(three).collect() == explode_model_outputs(one).collect()
    with pytest.raises(ValueError):
        explode_model_outputs(spark.createDataFrame([(1, "x")], "id long, blob string"))
    short = spark.createDataFrame([(1, [[0.0, 0.0, 1.0]])], "id long, outputs array<array<double>>")
    with pytest.raises(Exception, match="six numbers"):
        explode_model_outputs(short).collect()


def test_labels(spark):
    found = spark.createDataFrame([(0,), (7,)], "class_id long")
    names = spark.createDataFrame([("0", "person")], "class_id string, label string")
    assert {r.class_id: r.label for r in with_labels(found, names).collect()} == {0: "person", 7: "7"}
    assert {r.label for r in with_labels(found, None).collect()} == {"0", "7"}
    with pytest.raises(Exception, match="absent"):
        with_labels(found, names, strict=True).collect()


def test_half_even_rounding_and_scaling(spark):
    rows = [(0.5, 1.5, 3.0, 4.5), (0.25, 0.5, 0.75, 1.0), (300.0, 200.0, 100.0, -5.0)]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    plain = [tuple(r[0]) for r in df.select(box_functions.corners_to_xywh(*corners)).collect()]
    assert plain[0] == (0, 2, 2, 3) and plain[2] == (300, 200, 0, 0)
    region = [F.lit(v) for v in (100, 50, 640, 320)]
    scaled = [tuple(r[0]) for r in df.select(box_functions.scale_to_frame(*corners, *region, input_size=(320, 320))).collect()]
    assert scaled[1] == (260, 210, 320, 160)
    assert scaled[2] == (300, 45, 400, 205)
    kept = [tuple(r[0]) for r in df.select(box_functions.scale_to_frame(*corners, *region, input_size=None)).collect()]
    assert kept[2] == (100, 0, 200, 200)


CATALOG = [("small-coco", ["person", "Car"], "detection", "low", False),
           ("big-aerial", ["plane", "ship"], "detection", "high", True),
           ("visdrone", ["person", "vehicle", "bicycle"], "detection", "any", True)]


def test_catalog_ranking(spark):
    catalog = spark.createDataFrame(CATALOG, "id string, capabilities array<string>, task string, altitude string, tiled boolean")
    shape = "request_id int, classes array<string>, task string, altitude string, width int, height int"
    requests = spark.createDataFrame(
        [(1, ["Vehicle", "person", "person"], "Detection", "HIGH", 3840, 2160), (2, None, None, None, None, None), (3, ["car"], None, "low", 640, 480)], shape)
    ranked = {(r.request_id, r["rank"]): (r.model_id, r.score) for r in rank_models(requests, catalog).collect()}
    assert ranked[(1, 1)] == ("visdrone", 6.5) and ranked[(1, 2)] == ("big-aerial", 3.5)
    assert ranked[(1, 3)] == ("small-coco", 3.0)
    assert [ranked[(2, i)] for i in (1, 2, 3)] == [("big-aerial", 0.0), ("small-coco", 0.0), ("visdrone", 0.0)]
    best = {r.request_id: (r.model_id, r.score) for r in select_model(requests, catalog).collect()}
    assert best[3] == ("small-coco", 4.25)
    with pytest.raises(Exception, match="empty"):
        select_model(requests, catalog.filter("false")).collect()


def test_formats_sizes_and_names(spark):
    one = spark.range(1)

    def of(column):
        return one.select(column).first()[0]

    assert of(text.model_format(F.lit("/m/yolov8.onnx"))) == "yolo"
    assert of(text.model_format(F.lit("a.PT"))) == "torch"
    with pytest.raises(Exception, match="unrecognised"):
        of(text.model_format(F.lit("a.bin")))
    assert of(text.parse_size(F.lit("640X480"))) == [640, 480] and of(text.parse_size(F.lit(None).cast("string"))) is None
    with pytest.raises(Exception, match="two components"):
        of(text.parse_size(F.lit("640")))
    assert of(text.slug(F.lit(" User 1! "))) == "user-1" and of(text.slug(F.lit("--"))) == "session"
    assert of(text.index_name("frames", F.lit("sess-abc"), "index")) == "frames-s-sess-abc"
    assert of(text.blob_prefix(F.lit("User 1!"))) == "sessions/user-1/"
    assert of(text.trim_file_name(F.lit("n" * 300 + ".mp4"))) == "n" * 251 + ".mp4"
    assert of(text.trim_file_name(F.lit(".bashrc"), 5)) == ".bash"
    assert of(text.box_in_text(F.lit("none"))) is None


def test_embedding_is_repeatable_and_within_bounds(spark):
    import hashlib
    import struct

    digest = [hashlib.sha256(f"héllo:{i}".encode()).digest() for i in range(2)]
    wanted = [struct.unpack("<I", d[i:i + 4])[0] / 0xFFFFFFFF for d in digest for i in range(0, 32, 4)][:11]
    assert spark.range(1).select(text.embedding(F.lit("héllo"), 11)).first()[0] == wanted


SAMPLE = [
    {"video_id": 1, "frame_index": 0, "tracks": [{"id": 1, "bbox": [120, 80, 40, 30], "velocity": [1.2, 0.0], "label": "vehicle"},
                                                 {"id": 2, "bbox": [300, 210, 18, 44], "velocity": [0.0, -0.5], "label": "person"}]},
    {"video_id": 1, "frame_index": 5, "tracks": [{"id": 1, "bbox": [126, 80, 40, 30], "velocity": [1.3, 0.0], "label": "vehicle"}]},
    {"video_id": 2, "frame_index": 0, "tracks": [{"id": 10, "bbox": [50, 50, 60, 60], "velocity": [0.0, 0.0], "label": "vehicle"},
                                                 {"id": 11, "bbox": [420, 300, 22, 50], "velocity": [0.3, 0.1], "label": "person"},
                                                 {"id": 12, "bbox": [600, 120, 30, 24], "velocity": [-0.8, 0.0], "label": "bicycle"}]},
]


def test_features_of_the_sample_rows_as_text_and_native(spark):
    wanted = {(1, 0): (0.85, 2), (1, 5): (1.3, 1), (2, 0): (0.37, 3)}
    rows = [(r["video_id"], r["frame_index"], json.dumps(r["tracks"])) for r in SAMPLE]
    as_text = spark.createDataFrame(rows, "video_id long, frame_index long, tracks string")
    made = precompute_features(explode_tracks(as_text))
    assert {(r.video_id, r.frame_index): (r.mean_speed, r.object_count) for r in made.collect()} == wanted


@pytest.mark.parametrize("multiline", [True, False])
def test_ingest_of_documents_and_of_lines(spark, tmp_path, multiline):
    if multiline:
        (tmp_path / "a.json").write_text(json.dumps(SAMPLE, indent=1))
    else:
        (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in SAMPLE))
    read = read_files(spark, str(tmp_path), multiline=multiline)
    features = precompute_features(explode_tracks(read))
    assert features.count() == 3
    with pytest.raises(ValueError):
        ingest(spark, str(tmp_path), "t", incremental=True)


def test_results_go_to_the_path_when_both_are_given(spark):
    path = work_path(spark, "results")
    write_results(spark.range(3).toDF("video_id"), table="never_made", path=path)
    assert spark.read.parquet(path).count() == 3 and not spark.catalog.tableExists("never_made")
