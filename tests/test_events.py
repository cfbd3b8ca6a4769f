"""Events, digests, telemetry and sinks on small tables with known answers."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from aerospark.functions import otlp
from aerospark.functions.events import echo_completion, event_field, general_number, numeric_only
from aerospark.operators import telemetry
from aerospark.operators.aggregate import aggregate_events, api_filters, filter_events, total_events
from aerospark.operators.commentary import describe_frames, frame_events, motion_events, parking_phrase, zone_phrase
from aerospark.operators.digest import digest_events, summarize_scenes
from aerospark.operators.inference import text_model
from aerospark.operators.injection import make_events
from aerospark.scale import work_path
from aerospark.sources import sinks

AT = datetime.datetime(2026, 6, 13)


def events(spark, rows):
    """Whole events from (id, source, frame, metrics) rows."""
    given = spark.createDataFrame(
        [(i, s, f, m, AT + datetime.timedelta(seconds=n)) for n, (i, s, f, m) in enumerate(rows)],
        "event_id string, source string, frame_index long, metrics map<string,double>, timestamp timestamp_ntz",
    )
    named = given.selectExpr(
        "*", "7L AS video_id", "3L AS analysis_id", "concat('t', source) AS trace_id",
        "concat('s', event_id) AS span_id", "concat('video:7|frame:', frame_index) AS correlation_key",
        "'{\"labels\":[\"car\"],\"kind\":null}' AS attributes", "'{\"routine\":\"color_detection\"}' AS metadata",
        "1.0D AS segment_start", "2.0D AS segment_end", "'2 car detected' AS commentary",
    )
    return make_events(named)


def color_events(spark):
    return events(spark, [("a", "routine:color_detection", 0, {"count": 2.0}), ("b", "routine:color_detection", 30, {"count": 1.0})])


def test_aggregation_numbers(spark):
    found = color_events(spark)
    row = aggregate_events(found, "source", ["count", "sum:count", "avg:count"]).first()
    assert (row["events"], row["count"], row["sum:count"], row["avg:count"]) == (2, 2.0, 3.0, 1.5)
    assert total_events(found).first()[0] == 2


def test_reducers_over_nothing_are_zero_and_missing_groups_are_named(spark):
    found = color_events(spark)
    specs = ["avg:none", "min:none", "max:none", "none", "count:none"]
    row = aggregate_events(found, "metadata.absent", specs).first()
    assert row["group_value"] == "null"
    assert [row[s] for s in specs] == [0.0, 0.0, 0.0, 0.0, 2.0]
    assert aggregate_events(found).first()["group_value"] == "all"


def test_group_by_list_is_its_text_and_bad_op_is_refused(spark):
    found = color_events(spark)
    assert aggregate_events(found, "attributes.labels").first()["group_value"] == '["car"]'
    with pytest.raises(ValueError):
        aggregate_events(found, metrics=["median:count"])


def test_filters(spark):
    found = color_events(spark)
    assert filter_events(found, {"frame_index": 30, "metadata.routine": "color_detection"}).count() == 1
    assert filter_events(found, {"parent_span_id": None}).count() == 2
    assert api_filters({"source": "x", "limit": 3}) == {"source": "x"}
    path = event_field("metrics.count", found.columns)
    assert [r[0] for r in found.select(path).collect()] == [2.0, 1.0]


def test_digest_and_summary(spark):
    rows = [("1", "routine:a", 0, {"count": 1.0}), ("2", "routine:a", 30, {"count": 2.0}), ("3", "routine:b", 30, {"count": 3.0})]
    digest = digest_events(events(spark, rows), ["video_id"]).first()
    assert (digest.event_count, digest.frames_covered, digest.frame_min, digest.frame_max) == (3, 2, 0, 30)
    assert [(t.metric, t.total) for t in digest.metric_totals] == [("count", 6.0)]
    made = summarize_scenes(events(spark, rows), ["video_id"]).first()
    assert made.correlation_key == "video:7|scope:video" and made.source == "agent:semantic"
    assert made.commentary == (
        "[echo] Events: 3 across 2 frame(s) [0..30]. Sources: routine:a=2, routine:b=1. Totals: count=6."
    )
    assert made.metrics == {"events_summarized": 3.0, "frames_covered": 2.0, "total_count": 6.0}
    assert json.loads(str(made.attributes.toJson()))["derived_from_spans"] == ["s1", "s2", "s3"]
    assert summarize_scenes(events(spark, rows).filter("false"), ["video_id"]).count() == 0


def test_summary_takes_the_earliest_events_only_and_never_itself(spark):
    rows = [(str(i), "routine:a", i, {"count": 1.0}) for i in range(9)] + [("s", "agent:semantic", 0, {"count": 99.0})]
    made = summarize_scenes(events(spark, rows), ["video_id"], limit=4).first()
    assert made.metrics["events_summarized"] == 4.0 and made.metrics["total_count"] == 4.0


def test_summary_falls_back_to_the_digest(spark):
    def down(prompt: str) -> str:
        raise RuntimeError("no model")

    made = summarize_scenes(color_events(spark), ["trace_id"], "trace", complete=text_model(down)).first()
    assert made.commentary.startswith("Scene summary — Events: 2")
    assert made.correlation_key == "trace:troutine:color_detection|scope:trace"


def test_general_number_equals_printf(spark):
    values = [0.0, 6.0, 2.5, 123456.0, 1234567.0, 0.0001, 0.00001234, -3.125, 99999.5, 1e21, 1 / 3]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(general_number(F.col("v"))).collect()] == ["%g" % v for v in values]


def test_echo_takes_the_first_line_that_is_not_blank(spark):
    df = spark.createDataFrame([("\n  \n  hello  \nworld",), (None,), ("x" * 400,)], "p string")
    got = [r[0] for r in df.select(echo_completion(F.col("p"))).collect()]
    assert got[:2] == ["[echo] hello", "[echo] "] and len(got[2]) == 280


def test_injected_events_are_made_whole(spark):
    given = spark.createDataFrame(
        [("clear to land", '{"verdict":"safe"}', '{"a":1,"b":true,"c":"x","d":2.5}', "bogus")],
        "commentary string, attributes string, metrics string, other string",
    )
    made = make_events(given).first()
    assert made.source == "external" and made.schema_version == "1.0"
    assert len(made.trace_id) == 32 and len(made.span_id) == 16 and len(made.event_id) == 32
    assert made.metrics == {"a": 1.0, "d": 2.5}
    again = make_events(given, stable=["commentary"])
    assert again.first().event_id == again.first().event_id


def test_booleans_are_no_numbers(spark):
    df = spark.sql("SELECT parse_json('{\"t\":true,\"n\":null,\"i\":3,\"f\":1e3}') AS v")
    assert df.select(numeric_only(F.col("v"))).first()[0] == {"i": 3.0, "f": 1000.0}


def test_any_value_encoding(spark):
    text = '{"b":true,"i":5,"d":2.5,"s":"x","a":[1,"y",false],"m":{"k":{"z":null}}}'
    df = spark.createDataFrame([(text,)], "t string").select(F.parse_json("t").alias("v"))
    entry = otlp.typed(F.lit(""), F.col("v"))
    got = json.loads(df.select(F.to_json(otlp.any_value(entry))).first()[0])
    by_key = {e["key"]: e["value"] for e in got["kvlistValue"]["values"]}
    assert by_key["b"] == {"boolValue": True} and by_key["i"] == {"intValue": "5"}
    assert by_key["d"] == {"doubleValue": 2.5} and by_key["s"] == {"stringValue": "x"}
    assert by_key["a"]["arrayValue"]["values"] == [{"intValue": "1"}, {"stringValue": "y"}, {"boolValue": False}]
    assert by_key["m"]["kvlistValue"]["values"][0]["value"]["kvlistValue"]["values"] == [
        {"key": "z", "value": {"stringValue": "None"}}
    ]


def test_signals(spark):
    found = color_events(spark)
    span = telemetry.spans(found).select("record.*").first()
    assert int(span.endTimeUnixNano) - int(span.startTimeUnixNano) == 1_000_000_000
    assert span.name == "routine:color_detection" and span.parentSpanId is None
    assert span.startTimeUnixNano == str(int(AT.replace(tzinfo=datetime.timezone.utc).timestamp()) * 10**9)
    keys = [a.key for a in telemetry.log_records(found).first().record.attributes]
    assert "kind" not in keys and {"labels", "source", "meta.routine"} <= set(keys)
    points = telemetry.gauge_points(found).collect()
    assert {p.name for p in points} == {"commentary.count"} and sorted(p.record.asDouble for p in points) == [1.0, 2.0]
    flat = telemetry.flat_log_records(found).first().record
    assert flat.Body == "2 car detected" and flat.Attributes["metric.count"].toPython() == 2.0
    body = telemetry.request_payloads(found, "metrics", 2).collect()
    metrics = [m for r in body for m in json.loads(r.value)["resourceMetrics"][0]["scopeMetrics"][0]["metrics"]]
    assert sum(len(m["gauge"]["dataPoints"]) for m in metrics) == 2
    with pytest.raises(ValueError):
        telemetry.request_payloads(found, "profiles", 2)


RUN = "routine string, video_id long, frame_index long, error string, summary map<string,double>, trace_id string, analysis_id long, fps double, frame_step int"


def test_events_of_a_mixed_run(spark):
    results = spark.createDataFrame(
        [("color_detection", 7, 0, None, {"count": 2.0, "extra": 4.0}, "t", 3, 30.0, None),
         ("color_detection", 7, 30, None, {}, "t", 3, 30.0, None),
         ("color_detection", 7, 60, "boom", {}, "t", 3, None, None)], RUN)
    boxes = spark.createDataFrame(
        [(7, 0, "car", 0.8, 100.0), (7, 0, "car", 0.4, 300.0)],
        "video_id long, frame_index long, label string, score double, area double")
    made = {r.frame_index: r for r in frame_events(describe_frames(results, boxes)).collect()}
    first = made[0]
    assert first.commentary == "color_detection detected 2 car in frame 0."
    assert first.metrics["count"] == 2.0 and first.metrics["total_area"] == 400.0
    assert first.metrics["mean_score"] == pytest.approx(0.6) and first.metrics["max_score"] == 0.8
    assert first.metrics["extra"] == 4.0
    assert made[30].commentary == "color_detection detected no objects in frame 30."
    assert (made[30].segment_start, made[30].correlation_key) == (1.0, "video:7|frame:30")
    assert made[60].commentary == "Routine 'color_detection' failed: boom" and made[60].metrics == {}
    assert made[60].segment_start is None
    motion = spark.createDataFrame(
        [("background_subtraction", 7, 0, 2, "t", 3, 30.0, 1), ("background_subtraction", 7, 1, 0, "t", 3, 30.0, 1)],
        "routine string, video_id long, frame_index long, moving long, trace_id string, analysis_id long, fps double, frame_step int")
    moved = motion_events(motion).collect()
    assert len(moved) == 2
    rollup = [r for r in moved if r.frame_index is None][0]
    assert rollup.commentary == "background_subtraction processed 2 frame(s); 2 total moving detection(s)."
    assert rollup.correlation_key == "video:7|routine:background_subtraction"


def test_phrases(spark):
    df = spark.sql("SELECT array(named_struct('zone','b','detections',2L), named_struct('zone','a','detections',0L)) AS z, array_remove(array(named_struct('zone','b','detections',2L)), named_struct('zone','b','detections',2L)) AS e")
    row = df.select(zone_phrase(F.col("z")), zone_phrase(F.col("e")), parking_phrase(F.lit(1), F.lit(3))).first()
    assert list(row) == ["Zone occupancy — a=0, b=2.", "Zone counting produced no occupied zones.", "Parking occupancy: 1 of 3 spots occupied."]


def test_table_sink_ignores_known_ids(spark):
    path = work_path(spark, "events")
    sink = sinks.open_sink(["table"], path)
    sink.emit_many(color_events(spark))
    sink.emit_many(color_events(spark).unionByName(events(spark, [("c", "x", 1, {})])))
    assert sorted(r.event_id for r in spark.read.parquet(f"{path}/events").collect()) == ["a", "b", "c"]


def test_sink_names(spark):
    assert isinstance(sinks.open_sink(["null"]), sinks.NullSink)
    assert isinstance(sinks.open_sink(["null", "memory"]), sinks.TeeSink)
    for kinds, folder in ((["nope"], "/unused"), (["table", "nope"], "/unused"), ([], "/unused"), (["table"], None)):
        with pytest.raises(ValueError):
            sinks.open_sink(kinds, folder)
    memory = sinks.open_sink(["memory"], options={"memory": {"view": "kept"}})
    memory.emit_many(color_events(spark))
    memory.emit_many(events(spark, [("c", "x", 1, {})]))
    assert spark.table(memory.view).count() == 3


def test_export_reports_failures_and_never_raises(spark):
    def post(signal):
        def send(body: str) -> int:
            if signal == "traces":
                raise OSError("collector is away")
            return 200

        return send

    sink = sinks.OtlpSink(post=post)
    assert sink.export(color_events(spark)) == {"logs": "200", "metrics": "200", "traces": "error: collector is away"}
    assert sink.export(color_events(spark).filter("false")) == {}
    with pytest.raises(ValueError):
        sinks.OtlpSink("/unused", ["profiles"])


def read_back(shaped):
    """The value that a wire form stands for; it has exactly one field."""
    (field, inner), = shaped.items()
    if field == "arrayValue":
        return list(map(read_back, inner["values"]))
    if field == "kvlistValue":
        return {entry["key"]: read_back(entry["value"]) for entry in inner["values"]}
    assert field == {bool: "boolValue", float: "doubleValue"}.get(type(inner), field) and field.endswith("Value")
    return int(inner) if field == "intValue" else inner


def test_nested_values_of_any_depth(spark):
    deep = "end"
    for k in range(60):
        deep = [deep, k] if k % 2 else {"inner": deep, "k,\"x\":[": None}
    values = [
        [], {}, [[]], [{}], {"a": {}}, {"a": []}, [[], [], {}], deep, ["", "a,b", "a\":{[", "back\\slash\\", "\"", "\n\té東🙂"],
        {"": 1, ":": ",", ",": ":", "{": "}", "a\"b": "c"}, [1, -2, 10**20, 1.5, -0.25, 1e30, 2.5e-7, True, False, None],
        {"x": [1, {"y": [{"z": True}, "s"]}, None], "w": "v"}, ["x" * 50_000, "\\\"" * 20_000], [str(k) for k in range(3000)],
    ]
    rows = [(k, json.dumps(v)) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("v", F.parse_json("t"))
    entry = otlp.typed(F.lit(""), F.col("v"))
    shaped = df.select("id", F.to_json(otlp.any_value(entry)).alias("wire"))
    for row in shaped.collect():
        want = json.dumps(values[row["id"]], sort_keys=True).replace("null", '"None"')
        assert json.dumps(read_back(json.loads(row["wire"])), sort_keys=True) == want
    plan = shaped._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_signals_share_their_attributes(spark, monkeypatch):
    """A sink of several signals builds the attribute list once, and sends what each alone would."""
    from workload import views

    built, build = [], otlp.signal_attributes
    monkeypatch.setattr(otlp, "signal_attributes", lambda: built.append(1) or build())
    events = views.commentary_events(spark, "/root/testdata/sf0.001").limit(50)
    together, alone = work_path(spark, "otlp"), work_path(spark, "otlp")
    assert set(sinks.OtlpSink(together).export(events).values()) == {"ok"} and len(built) == 1
    for signal in telemetry.SIGNALS:
        sinks.OtlpSink(alone, [signal]).export(events)
        sent = [sorted(r.value for r in spark.read.text(f"{path}/{signal}").collect()) for path in (together, alone)]
        assert sent[0] and [sorted(v) for v in sent[0]] == [sorted(v) for v in sent[1]]


def odd_events(spark):
    """Events with nulls, quotes and what stands for the attributes in their texts, and a column without a type."""
    from workload import views

    number = F.col("event_id").cast("int")
    text = '"attributes":"@"'
    open_map = json.dumps({"x": text, "attributes": "@", "y": [1, {"z": None}], "meta.routine": 3})
    return views.commentary_events(spark, "/root/testdata/sf0.001").filter(number < 500).withColumns({
        "commentary": F.when(number % 5 == 0, F.lit(text + "\\ \n\té}")).when(number % 7 != 0, F.col("commentary")),
        "attributes": F.when(number % 4 == 1, F.parse_json(F.lit(open_map))).when(number % 4 != 0, F.col("attributes")),
        "metadata": F.when(number % 6 != 0, F.col("metadata")),
        "metrics": F.when(number % 9 == 1, F.create_map(F.lit('q"'), F.lit(-0.0), F.lit("n"), F.lit(float("nan")), F.lit("i"), F.lit(None).cast("double")))
        .when(number % 9 != 0, F.col("metrics")),
        "correlation_key": F.when(number % 8 == 1, F.lit("")).when(number % 8 != 0, F.col("correlation_key")),
        "parent_span_id": F.lit(None),
    })


def test_requests_hold_the_json_of_whole_records(spark):
    """Attributes that are put into the text of a record give the text of the record with them."""
    events = odd_events(spark)
    path = work_path(spark, "otlp")
    assert set(sinks.OtlpSink(path, chunk=60).export(events).values()) == {"ok"}
    made = {"logs": telemetry.log_records(events), "traces": telemetry.spans(events), "metrics": telemetry.gauge_points(events)}
    names = {
        "logs": ("resourceLogs", "scopeLogs", "logRecords"), "traces": ("resourceSpans", "scopeSpans", "spans"),
        "metrics": ("resourceMetrics", "scopeMetrics", "metrics"),
    }
    for signal, (outer, scoped, inner) in names.items():
        got = []
        requests = [json.loads(r.value) for r in spark.read.text(f"{path}/{signal}").collect()]
        assert len(requests) > 5
        for request in requests:
            (resource,) = request[outer]
            (scope,) = resource[scoped]
            assert resource["resource"]["attributes"][0]["value"] == {"stringValue": "aerospark"}
            assert scope["scope"] == {"name": "aerospark.events"}
            if signal == "metrics":
                got += [(m["name"], json.dumps(p)) for m in scope[inner] for p in m["gauge"]["dataPoints"]]
                assert all(m["unit"] == "1" for m in scope[inner])
            else:
                got += [json.dumps(record) for record in scope[inner]]
        name = ["name"] if signal == "metrics" else []
        want = [(*r[:-1], json.dumps(json.loads(r[-1]))) for r in made[signal].select(*name, F.to_json("record")).collect()]
        assert sorted(got) == sorted(want if name else [text for (text,) in want])


def test_an_export_takes_a_fraction_of_its_text(spark):
    """What an export leaves, with all it staged, is far less than the requests' text."""
    from aerospark.scale import shared_dir
    from workload import views

    def held():
        return sum(os.path.getsize(os.path.join(d, name)) for d, _, names in os.walk(shared_dir(spark)) for name in names)

    given_back = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    events, path = views.commentary_events(spark, "/root/testdata/sf0.01"), work_path(spark, "otlp")
    before, setting = held(), spark.conf.get(given_back)
    assert sinks.OtlpSink(path, ["logs", "traces"]).export(events) == {"logs": "ok", "traces": "ok"}
    grown = held() - before
    text = sum(spark.read.text(f"{path}/{s}").agg(F.sum(F.length("value"))).first()[0] for s in ("logs", "traces"))
    assert grown < text / 3
    assert spark.conf.get(given_back) == setting


def test_events_are_dealt_out_before_they_are_gathered(spark):
    """A task gathers only what the shuffle gave it; before the shuffle it would sort its events on its disk."""
    from workload import views

    events = views.commentary_events(spark, "/root/testdata/sf0.001")
    for signal in telemetry.SIGNALS:
        plan = telemetry.request_payloads(events, signal, 1000)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange ") == 1 and "collect_list" not in plan[plan.index("Exchange ") :]
