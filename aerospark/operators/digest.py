"""Digests and scene summaries of many events, and the links between events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospark.functions.events import (
    SCHEMA_VERSION, echo_completion, general_number, stable_id, summary_key,
)

# Fixed values of the summary event.
SUMMARY_SOURCE = "agent:semantic"
MAX_CHILD_SPANS = 64
#: Slices in which the events of a key are ranked first.
SLICES = 64


def _items() -> Column:
    """What a digest counts in an event: its source, its frame, its metrics."""

    def item(kind: str, name: Column, value: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), name.cast("string").alias("name"), value.cast("double").alias("value")
        )

    frame = F.col("frame_index")
    metrics = F.transform(
        F.filter(F.map_entries("metrics"), lambda e: e["value"].isNotNull()),
        lambda e: item("metric", e["key"], e["value"]),
    )
    own = [item("source", F.col("source"), F.lit(1)), F.when(frame.isNotNull(), item("frame", frame, frame))]
    return F.concat(F.array_compact(F.array(*own)), F.coalesce(metrics, F.array()))


def digest_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """One digest per key: event count, sources, frames covered, and metric totals.

    One pass: items are reduced by (key, kind, name), then by key.

    Both steps combine before their shuffle; the lists hold one entry per
    distinct name and the frames are only counted.
    """
    per_item = (
        events.select(*keys, F.explode(_items()).alias("item"))
        .groupBy(*keys, "item.kind", "item.name")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("item.value").alias("total"),
            F.min("item.value").alias("value"),
        )
    )

    def only(kind: str, value: Column) -> Column:
        return F.when(F.col("kind") == kind, value)

    source = F.struct(F.col("name").alias("source"), "n")
    metric = F.struct(F.col("name").alias("metric"), "total")
    frame = only("frame", F.col("value"))
    return per_item.groupBy(*keys).agg(
        F.sum(only("source", F.col("n"))).alias("event_count"),
        F.count(frame).alias("frames_covered"),
        F.min(frame).cast("long").alias("frame_min"), F.max(frame).cast("long").alias("frame_max"),
        F.array_sort(F.collect_list(only("source", source))).alias("sources"),
        F.array_sort(F.collect_list(only("metric", metric))).alias("metric_totals"),
    )


def digest_text(digests: DataFrame) -> Column:
    """The digest in one line, as prompt and as fallback text."""

    def listed(items: str, name: str, shown) -> Column:
        parts = F.transform(
            F.coalesce(F.col(items), F.array()),
            lambda e: F.concat(e[name], F.lit("="), shown(e)),
        )
        return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit("none"))

    def bound(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    return F.concat(
        F.lit("Events: "), F.col("event_count").cast("string"), F.lit(" across "),
        F.col("frames_covered").cast("string"), F.lit(" frame(s) ["), bound("frame_min"),
        F.lit(".."), bound("frame_max"), F.lit("]. Sources: "),
        listed("sources", "source", lambda e: e["n"].cast("string")), F.lit(". Totals: "),
        listed("metric_totals", "metric", lambda e: general_number(e["total"])), F.lit("."),
    )


def without_summaries(events: DataFrame) -> DataFrame:
    """Events that are not themselves scene summaries."""
    return events.filter(F.col("source") != SUMMARY_SOURCE)


def earliest(events: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first ``limit`` events of each key, with their ``rank``.

    Events are ranked within slices of a key first, and only those that lead their slice
    are ranked over the key, so a key with most of the events is sorted by many tasks.
    """
    order = ["timestamp", "event_id"]
    sliced = events.withColumn("_slice", F.pmod(F.xxhash64("event_id"), F.lit(SLICES)))
    own = Window.partitionBy(*keys, "_slice").orderBy(*order)
    leading = sliced.withColumn("_place", F.row_number().over(own)).filter(F.col("_place") <= limit)
    return (
        leading.drop("_slice", "_place")
        .withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        .filter(F.col("rank") <= limit)
    )


def _with_spans(digests: DataFrame, events: DataFrame, keys: list[str], child: Column) -> DataFrame:
    """Digests with the spans of the first events of their key."""
    listed = earliest(events, keys, MAX_CHILD_SPANS).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("rank"), child.alias("span_id")))).alias("spans")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return digests.join(listed, same).drop(*[f"_{k}" for k in keys])


def summarize_scenes(
    events: DataFrame,
    keys: list[str],
    scope: str = "video",
    limit: int | None = None,
    complete=echo_completion,
    generated_by: str = "echo",
) -> DataFrame:
    """One summary event per key, from all of its events or its earliest ``limit``.

    ``keys`` is ``["video_id"]`` or ``["trace_id"]``.  Without a limit nothing is ranked
    but the few events whose spans are listed.  ``complete`` turns the digest line into
    text; a null text falls back to the digest line itself.
    """
    chosen = without_summaries(events)
    if limit is not None:
        chosen = earliest(chosen, keys, limit).drop("rank")
    # A span travels with its trace; the widths of both ids are fixed by no rule here.
    child = F.concat_ws("|", F.col("span_id"), F.col("trace_id"))
    digests = _with_spans(digest_events(chosen, keys), chosen, keys, child).withColumns(
        {
            "derived_from_spans": F.transform("spans", lambda e: F.split_part(e["span_id"], F.lit("|"), F.lit(1))),
            "first_trace": F.regexp_extract(F.get("spans.span_id", F.lit(0)), r"^[^|]*\|(.*)$", 1),
        }
    )
    line = digest_text(digests)
    video = F.col("video_id") if "video_id" in keys else F.lit(None).cast("long")
    trace = F.col("trace_id") if "trace_id" in keys else F.col("first_trace")
    totals = F.transform(
        F.coalesce("metric_totals", F.array()),
        lambda e: F.struct(F.concat(F.lit("total_"), e["metric"]).alias("key"), e["total"].alias("value")),
    )
    counted = F.array(
        F.struct(F.lit("events_summarized").alias("key"), F.col("event_count").cast("double").alias("value")),
        F.struct(F.lit("frames_covered").alias("key"), F.col("frames_covered").cast("double").alias("value")),
    )
    attributes = F.struct(
        F.lit(scope).alias("scope"),
        F.map_from_entries("sources").alias("sources"),
        F.col("event_count").alias("derived_from"),
        F.col("derived_from_spans"),
        F.lit(generated_by).alias("generated_by"),
    )
    return digests.select(
        stable_id(32, F.lit("summary"), video, trace, F.lit(scope), F.col("event_count")).alias("event_id"),
        trace.alias("trace_id"),
        stable_id(16, F.lit("span"), video, trace, F.lit(scope), F.col("event_count")).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        summary_key(video, trace, scope).alias("correlation_key"),
        F.localtimestamp().alias("timestamp"),
        F.lit(SUMMARY_SOURCE).alias("source"),
        video.alias("video_id"),
        F.lit(None).cast("long").alias("analysis_id"),
        F.lit(None).cast("long").alias("frame_index"),
        F.lit(None).cast("double").alias("segment_start"),
        F.lit(None).cast("double").alias("segment_end"),
        F.coalesce(complete(line), F.concat(F.lit("Scene summary — "), line)).alias("commentary"),
        F.parse_json(F.to_json(attributes)).alias("attributes"),
        F.map_from_entries(F.concat(counted, totals)).alias("metrics"),
        F.parse_json(F.lit('{"agent":"semantic","level":"scene","rollup":true}')).alias("metadata"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
    )


def child_events(events: DataFrame) -> DataFrame:
    """Each event beside the event of its trace whose span is its parent."""
    parents = events.select(
        "trace_id", F.col("span_id").alias("parent_span_id"),
        F.col("event_id").alias("parent_event_id"),
        F.col("source").alias("parent_source"),
    )
    linked = events.filter(F.col("parent_span_id").isNotNull())
    return linked.join(parents, ["trace_id", "parent_span_id"]).select(
        "event_id", "source", "parent_span_id", "parent_event_id", "parent_source"
    )


def summary_lineage(summaries: DataFrame, events: DataFrame) -> DataFrame:
    """Each summary beside the source events whose spans it lists.

    Spans are those of the summary's own video or, where it has none, of its trace.
    """
    spans = F.try_variant_get("attributes", "$.derived_from_spans", "array<string>")
    subject = F.coalesce(F.concat(F.lit("video:"), F.col("video_id").cast("string")), F.col("trace_id"))
    links = summaries.select(
        F.col("event_id").alias("summary_id"), F.explode(spans).alias("span_id"), subject.alias("_subject")
    )
    own = events.select("span_id", "event_id", "source", "video_id", "trace_id").withColumn(
        "_subject", F.explode(F.array(F.concat(F.lit("video:"), F.col("video_id").cast("string")), F.col("trace_id")))
    )
    return links.join(own.drop("video_id", "trace_id"), ["span_id", "_subject"]).drop("_subject")


def correlate(left: DataFrame, right: DataFrame, on: str = "correlation_key") -> DataFrame:
    """Events about the same moment: an equi-join on the correlation key or the trace."""
    return left.join(right, on)
