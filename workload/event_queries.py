"""Queries over commentary events: aggregation, filters, digests, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from aerospark.operators.aggregate import aggregate_events, filter_events, total_events
from workload import views
from workload.registry import query
from workload.views import with_views


@query(
    "a1_aggregate_by_source",
    with_views("commentary_events", """
        SELECT source AS group_value, count(*) AS events, count(*)::DOUBLE AS n,
               round(sum(value), 6) AS sum_value, round(avg(value), 6) AS avg_value,
               min(k) AS min_k, max(k) AS max_k, 0.0::DOUBLE AS sum_absent
        FROM commentary_events GROUP BY source"""),
)
def aggregate_by_source(spark, sf_dir):
    specs = ["count", "sum:value", "avg:value", "min:k", "max:k", "absent"]
    groups = aggregate_events(views.commentary_events(spark, sf_dir), "source", specs)
    return groups.select(
        "group_value", "events", F.col("count").alias("n"),
        F.round("`sum:value`", 6).alias("sum_value"), F.round("`avg:value`", 6).alias("avg_value"),
        F.col("`min:k`").alias("min_k"), F.col("`max:k`").alias("max_k"),
        F.col("absent").alias("sum_absent"),
    )


@query(
    "a1_aggregate_mixed_attributes",
    with_views("commentary_events", """
        SELECT CASE WHEN CAST(event_id AS BIGINT) % 3 = 2 THEN kind ELSE 'null' END AS group_value, count(*) AS events,
               round(sum(value), 6) AS total
        FROM commentary_events GROUP BY 1"""),
)
def aggregate_mixed(spark, sf_dir):
    """Cells of the open map that are text or lists have no fields."""
    number = F.col("event_id").cast("bigint") % 3
    odd = F.when(number == 0, F.parse_json(F.lit('"some text"'))).when(number == 1, F.parse_json(F.lit("[1,2]")))
    events = views.commentary_events(spark, sf_dir).withColumn("attributes", F.coalesce(odd, F.col("attributes")))
    groups = aggregate_events(events, "attributes.kind", ["sum:value"])
    return groups.select("group_value", "events", F.round("`sum:value`", 6).alias("total"))


@query(
    "a1_aggregate_by_metadata_filtered",
    with_views("commentary_events", """
        SELECT kind AS group_value, count(*) AS events, round(sum(value), 6) AS total
        FROM commentary_events WHERE video_id = 7 GROUP BY kind"""),
)
def aggregate_by_metadata(spark, sf_dir):
    groups = aggregate_events(
        views.commentary_events(spark, sf_dir), "metadata.routine", ["value"], {"video_id": 7}
    )
    return groups.select("group_value", "events", F.round("value", 6).alias("total"))


@query(
    "a1_aggregate_by_missing_field",
    with_views("commentary_events", """
        SELECT 'null' AS group_value, count(*) AS events, count(*)::DOUBLE AS n
        FROM commentary_events"""),
)
def aggregate_by_missing(spark, sf_dir):
    groups = aggregate_events(
        views.commentary_events(spark, sf_dir), "attributes.absent", ["count:value"]
    )
    return groups.select("group_value", "events", F.col("`count:value`").alias("n"))


@query(
    "a1_total_events",
    with_views("commentary_events", "SELECT count(*) AS total_events FROM commentary_events"),
)
def count_all(spark, sf_dir):
    return total_events(views.commentary_events(spark, sf_dir))


@query(
    "p5_field_paths",
    with_views("commentary_events", """
        SELECT event_id, kind, props AS payload, value AS metric, NULL::VARCHAR AS nested
        FROM commentary_events"""),
)
def field_paths(spark, sf_dir):
    from aerospark.functions.events import event_field

    events = views.commentary_events(spark, sf_dir)
    payload = event_field("attributes.payload", events.columns)
    return events.select(
        "event_id",
        event_field("attributes.kind", events.columns).alias("kind"),
        F.concat(F.lit('{"k": '), F.get_json_object(payload, "$.k"), F.lit("}")).alias("payload"),
        event_field("metrics.value", events.columns).alias("metric"),
        event_field("source.kind", events.columns).alias("nested"),
    )


@query(
    "p6_exact_match_filters",
    with_views("commentary_events", """
        SELECT event_id, source, video_id, frame_index FROM commentary_events
        WHERE source = 'routine:click' AND video_id = 3"""),
)
def exact_match(spark, sf_dir):
    from aerospark.operators.aggregate import api_filters

    wanted = api_filters({"source": "routine:click", "video_id": 3, "page": 2})
    found = filter_events(views.commentary_events(spark, sf_dir), wanted)
    return found.select("event_id", "source", "video_id", "frame_index")


DIGEST_SQL = """
    , per_source AS (
        SELECT video_id, source, count(*) AS n FROM commentary_events GROUP BY ALL),
    sourced AS (
        SELECT video_id, string_agg(source || '=' || n, ', ' ORDER BY source) AS sources
        FROM per_source GROUP BY video_id),
    totals AS (
        SELECT video_id, count(*) AS event_count, count(DISTINCT frame_index) AS frames_covered,
               min(frame_index) AS frame_min, max(frame_index) AS frame_max,
               sum(k) AS total_k, sum(value) AS total_value
        FROM commentary_events GROUP BY video_id)"""


def _digest_sql(body: str) -> str:
    return with_views("commentary_events", "SELECT 1").rsplit("SELECT 1", 1)[0].rstrip() + DIGEST_SQL + body


@query(
    "a5_digest_per_video",
    _digest_sql("""
        SELECT video_id, event_count, frames_covered, frame_min, frame_max, sources,
               round(total_k, 4) AS total_k, round(total_value, 4) AS total_value
        FROM totals JOIN sourced USING (video_id)"""),
)
def digest_per_video(spark, sf_dir):
    from aerospark.operators.digest import digest_events

    digests = digest_events(views.commentary_events(spark, sf_dir), ["video_id"])
    total = F.map_from_entries("metric_totals")
    shown = F.transform("sources", lambda e: F.concat(e["source"], F.lit("="), e["n"].cast("string")))
    return digests.select(
        "video_id", "event_count", "frames_covered", "frame_min", "frame_max",
        F.array_join(shown, ", ").alias("sources"),
        F.round(total["k"], 4).alias("total_k"), F.round(total["value"], 4).alias("total_value"),
    )


@query(
    "a6_scene_summaries",
    _digest_sql("""
        , spans AS (
            SELECT video_id, string_agg(span_id, ',' ORDER BY rn) AS child_spans
            FROM (SELECT video_id, span_id, row_number() OVER (
                      PARTITION BY video_id ORDER BY timestamp, event_id) AS rn
                  FROM commentary_events) WHERE rn <= 64 GROUP BY video_id)
        SELECT video_id, md5(CAST(video_id AS VARCHAR)) AS trace_id,
               'video:' || video_id || '|scope:video' AS correlation_key,
               'agent:semantic' AS source,
               substr('[echo] Events: ' || event_count || ' across ' || frames_covered
                   || ' frame(s) [' || frame_min || '..' || frame_max || ']. Sources: ' || sources
                   || '. Totals: k=' || printf('%g', total_k) || ', value='
                   || printf('%g', total_value) || '.', 1, 280) AS commentary,
               child_spans, event_count::DOUBLE AS events_summarized,
               frames_covered::DOUBLE AS frames_covered, round(total_k, 4) AS total_k
        FROM totals JOIN sourced USING (video_id) JOIN spans USING (video_id)"""),
)
def scene_summaries(spark, sf_dir):
    from aerospark.operators.digest import summarize_scenes

    made = summarize_scenes(views.commentary_events(spark, sf_dir), ["video_id"])
    spans = F.try_variant_get("attributes", "$.derived_from_spans", "array<string>")
    return made.select(
        "video_id", "trace_id", "correlation_key", "source", "commentary",
        F.array_join(spans, ",").alias("child_spans"),
        F.col("metrics.events_summarized").alias("events_summarized"),
        F.col("metrics.frames_covered").alias("frames_covered"),
        F.round("metrics.total_k", 4).alias("total_k"),
    )


@query(
    "j7_parent_spans",
    with_views("commentary_events", """
        SELECT c.event_id, c.source, c.parent_span_id, p.event_id AS parent_event_id,
               p.source AS parent_source
        FROM commentary_events c JOIN commentary_events p ON c.parent_span_id = p.span_id"""),
)
def parent_spans(spark, sf_dir):
    """Seven events in a row, the first of them the parent, are a trace here."""
    from aerospark.operators.digest import child_events

    number = F.col("event_id").cast("bigint")
    events = views.commentary_events(spark, sf_dir)
    return child_events(events.withColumn("trace_id", F.md5((number - number % 7).cast("string"))))


@query(
    "j7_parent_spans_within_traces",
    with_views("commentary_events", """
        SELECT c.event_id, c.source, c.parent_span_id, p.event_id AS parent_event_id,
               p.source AS parent_source
        FROM commentary_events c JOIN commentary_events p
          ON c.parent_span_id = p.span_id AND c.trace_id = p.trace_id"""),
)
def parent_spans_within_traces(spark, sf_dir):
    from aerospark.operators.digest import child_events

    return child_events(views.commentary_events(spark, sf_dir))


@query(
    "a6_limited_summaries",
    with_views("commentary_events", """
        WITH early AS (
            SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, event_id) AS rn FROM commentary_events),
        spans AS (SELECT video_id, string_agg(span_id, ',' ORDER BY rn) AS child_spans FROM early WHERE rn <= 25 GROUP BY 1)
        SELECT video_id, count(*)::DOUBLE AS events_summarized, count(DISTINCT frame_index)::DOUBLE AS frames_covered,
               round(sum(k), 4) AS total_k, any_value(child_spans) AS child_spans
        FROM early JOIN spans USING (video_id) WHERE rn <= 25 GROUP BY video_id"""),
)
def limited_summaries(spark, sf_dir):
    """Only the earliest 25 events of a video, of which most videos have more."""
    from aerospark.operators.digest import summarize_scenes

    made = summarize_scenes(views.commentary_events(spark, sf_dir), ["video_id"], limit=25)
    spans = F.try_variant_get("attributes", "$.derived_from_spans", "array<string>")
    return made.select(
        "video_id", F.col("metrics.events_summarized").alias("events_summarized"),
        F.col("metrics.frames_covered").alias("frames_covered"), F.round("metrics.total_k", 4).alias("total_k"),
        F.array_join(spans, ",").alias("child_spans"),
    )


@query(
    "j7_summary_lineage",
    with_views("commentary_events", """
        SELECT video_id, event_id, source FROM (
            SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY timestamp, event_id) AS rn
            FROM commentary_events) WHERE rn <= 64"""),
)
def lineage_of_summaries(spark, sf_dir):
    from aerospark.operators.digest import summarize_scenes, summary_lineage

    events = views.commentary_events(spark, sf_dir)
    made = summarize_scenes(events, ["video_id"])
    linked = summary_lineage(made, events)
    return linked.join(
        made.select(F.col("event_id").alias("summary_id"), "video_id"), "summary_id"
    ).select("video_id", "event_id", "source")


@query(
    "j11_without_summaries",
    with_views("commentary_events", """
        SELECT source, count(*) AS events FROM commentary_events GROUP BY source"""),
)
def no_summaries(spark, sf_dir):
    from aerospark.operators.digest import summarize_scenes, without_summaries

    events = views.commentary_events(spark, sf_dir)
    both = events.unionByName(summarize_scenes(events, ["video_id"]))
    return without_summaries(both).groupBy("source").agg(F.count("*").alias("events"))


@query(
    "w5_newest_first",
    with_views("commentary_events", """
        SELECT event_id, source, video_id, strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS at
        FROM commentary_events"""),
)
def newest_first(spark, sf_dir):
    from aerospark.operators.reports import newest_events

    return newest_events(views.commentary_events(spark, sf_dir)).select(
        "event_id", "source", "video_id",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


@query(
    "w6_page_of_events",
    with_views("commentary_events", """
        SELECT event_id, source FROM commentary_events
        ORDER BY timestamp DESC, event_id LIMIT 20 OFFSET 40"""),
)
def page_of_events(spark, sf_dir):
    from aerospark.operators.reports import newest_events, page

    return page(newest_events(views.commentary_events(spark, sf_dir)), 3).select("event_id", "source")


@query(
    "w6_keyset_page",
    with_views("commentary_events", """
        SELECT event_id, source FROM commentary_events
        WHERE timestamp < TIMESTAMP '2024-01-20 00:00:00'
        ORDER BY timestamp DESC, event_id LIMIT 50"""),
)
def keyset_page(spark, sf_dir):
    from aerospark.operators.reports import page_before

    cursor = F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    events = views.commentary_events(spark, sf_dir)
    return page_before(events, "timestamp", cursor).select("event_id", "source")


@query(
    "w6_tied_keyset_pages",
    with_views("commentary_events", """
        SELECT event_id, CAST((row_number() OVER (ORDER BY date_trunc('week', timestamp) DESC, event_id) - 1) // 20 AS INT) AS page
        FROM commentary_events WHERE video_id = 7"""),
)
def tied_pages(spark, sf_dir):
    """All pages of a video's events, whose times are cut to weeks so that many tie."""
    from functools import reduce

    from aerospark.operators.reports import page_before

    week = F.date_trunc("week", F.col("timestamp")).cast("timestamp_ntz")
    events = views.commentary_events(spark, sf_dir).filter("video_id = 7").withColumn("week", week)
    pages, cursor, after = [], None, None
    while True:
        found = page_before(events, "week", cursor, 20, after=after)
        rows = found.select("week", "event_id").collect()  # one page
        if not rows and pages:
            break
        pages.append(found.select("event_id", F.lit(len(pages)).alias("page")))
        if len(rows) < 20:
            break
        cursor, after = F.lit(rows[-1]["week"]).cast("timestamp_ntz"), F.lit(rows[-1]["event_id"])
    return reduce(lambda a, b: a.unionByName(b), pages)


@query(
    "w7_text_search",
    with_views("commentary_events", """
        SELECT event_id, commentary FROM commentary_events WHERE commentary ILIKE '%CLICK%'"""),
)
def text_search(spark, sf_dir):
    from aerospark.operators.reports import search_text

    events = views.commentary_events(spark, sf_dir)
    return search_text(events, ["commentary", "source"], "CLICK").select("event_id", "commentary")
