"""Query-time aggregation over raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.functions.events import FILTERABLE, event_field

REDUCERS = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def metric_column(spec: str) -> Column:
    """``count``, ``op:metric``, or a bare metric name, which is summed.

    A reducer over no values is 0.0, not null; ``count:metric`` counts events
    and ignores the metric.
    """
    op, colon, name = spec.partition(":")
    if spec == "count":
        op = "count"
    elif not colon:
        op, name = "sum", spec
    if op == "count":
        return F.count(F.lit(1)).cast("double").alias(spec)
    if op not in REDUCERS:
        raise ValueError(f"unknown aggregation {op!r} in {spec!r}")
    value = F.try_element_at("metrics", F.lit(name))
    return F.coalesce(REDUCERS[op](value), F.lit(0.0)).alias(spec)


def api_filters(params: dict[str, object]) -> dict[str, object]:
    """The request parameters that may filter events; the others are ignored."""
    return {key: value for key, value in params.items() if key in FILTERABLE}


def filter_events(events: DataFrame, filters: dict[str, object] | None) -> DataFrame:
    """Events that match every filter exactly; a null filter matches a null field."""
    for path, wanted in (filters or {}).items():
        events = events.filter(event_field(path, events.columns).eqNullSafe(F.lit(wanted)))
    return events


def aggregate_events(
    events: DataFrame,
    group_by: str | None = None,
    metrics: list[str] | None = None,
    filters: dict[str, object] | None = None,
) -> DataFrame:
    """One row per group: ``group_value``, ``events`` and a column per metric spec.

    The spec becomes plain aggregates, so Spark combines them before the one
    shuffle and a source that holds most events costs no more than the others.
    """
    group = (
        F.lit("all")
        if group_by is None
        else F.coalesce(event_field(group_by, events.columns).cast("string"), F.lit("null"))
    )
    return (
        filter_events(events, filters)
        .groupBy(group.alias("group_value"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            *[metric_column(spec) for spec in metrics or ["count"]],
        )
    )


def total_events(events: DataFrame, filters: dict[str, object] | None = None) -> DataFrame:
    return filter_events(events, filters).agg(F.count(F.lit(1)).alias("total_events"))
