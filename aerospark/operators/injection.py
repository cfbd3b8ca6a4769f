"""Events injected from outside: partial rows made whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.functions.events import SCHEMA_VERSION, numeric_only, stable_id
from aerospark.functions.json_cells import coerce_json
from aerospark.schemas import COMMENTARY_EVENTS

DEFAULT_SOURCE = "external"


def make_events(given: DataFrame, stable: list[str] | None = None) -> DataFrame:
    """Whole events from any subset of the event columns.

    Unknown columns are dropped, nulls take the defaults, and only numbers are
    kept as metrics.  Missing ids are random; with ``stable`` they follow from
    those columns instead, so a repeated task gives the same ids.  Store the
    result before using it twice.
    """
    kinds = {f.name: f.dataType for f in given.schema.fields}

    def field(name: str, kind: str, default: Column | None = None) -> Column:
        value = F.col(name).cast(kind) if name in kinds else F.lit(None).cast(kind)
        return (value if default is None else F.coalesce(value, default)).alias(name)

    def new_id(width: int, role: str) -> Column:
        if stable:
            return stable_id(width, F.lit(role), *[F.col(name) for name in stable])
        return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, width)

    def open_map(name: str) -> Column:
        value = coerce_json(F.col(name), kinds[name]) if name in kinds else F.lit(None).cast("variant")
        return F.coalesce(value, F.parse_json(F.lit("{}"))).alias(name)

    none = F.create_map().cast("map<string,double>")
    metrics = none
    if "metrics" in kinds:
        metrics = F.coalesce(numeric_only(coerce_json(F.col("metrics"), kinds["metrics"])), none)
    made = {
        "event_id": field("event_id", "string", new_id(32, "event")),
        "trace_id": field("trace_id", "string", new_id(32, "trace")),
        "span_id": field("span_id", "string", new_id(16, "span")),
        "parent_span_id": field("parent_span_id", "string"),
        "correlation_key": field("correlation_key", "string", F.lit("")),
        "timestamp": field("timestamp", "timestamp_ntz", F.localtimestamp()),
        "source": field("source", "string", F.lit(DEFAULT_SOURCE)),
        "video_id": field("video_id", "long"),
        "analysis_id": field("analysis_id", "long"),
        "frame_index": field("frame_index", "long"),
        "segment_start": field("segment_start", "double"),
        "segment_end": field("segment_end", "double"),
        "commentary": field("commentary", "string", F.lit("")),
        "attributes": open_map("attributes"),
        "metrics": metrics.alias("metrics"),
        "metadata": open_map("metadata"),
        "schema_version": field("schema_version", "string", F.lit(SCHEMA_VERSION)),
    }
    order = [part.strip().split(" ")[0] for part in COMMENTARY_EVENTS.split(", ")]
    return given.select(*[made[name] for name in order])
