"""Reports over scored frames, and the list views: ordering, pages, search, latest row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed page sizes: (default, largest).
STANDARD_PAGE = (20, 100)
LARGE_PAGE = (100, 1000)
KEYSET_PAGE = (50, 500)


def detections_per_model(results: DataFrame) -> DataFrame:
    return (
        results.groupBy("model_name")
        .agg(
            F.count(F.lit(1)).alias("frames_scored"),
            F.sum("num_detections").alias("total_detections"),
            F.avg("num_detections").alias("avg_detections_per_frame"),
            F.count_if(F.col("error").isNotNull()).alias("errors"),
        )
        .orderBy(F.desc("total_detections"), "model_name")
    )


def detections_by_model(results: DataFrame) -> DataFrame:
    return results.groupBy("model_name").agg(F.sum("num_detections").alias("total"))


def detection_timeline(results: DataFrame) -> DataFrame:
    """Detections per scored frame in video order, failures left out."""
    return (
        results.filter(F.col("error").isNull())
        .select("video_id", "frame_index", "num_detections")
        .orderBy("video_id", "frame_index")
    )


def hotspot_frames(results: DataFrame, n: int = 20) -> DataFrame:
    """The frames with most detections; each task keeps only its own first ``n``."""
    return (
        results.filter(F.col("error").isNull())
        .select("video_id", "frame_index", "num_detections", "model_name")
        .orderBy(F.desc("num_detections"), "video_id", "frame_index", "model_name")
        .limit(n)
    )


def payload_field(results: DataFrame, path: str, name: str) -> DataFrame:
    """One value of the result payload per scored frame."""
    return results.filter(F.col("error").isNull()).select(
        "video_id", "frame_index", F.get_json_object("result_json", path).alias(name)
    )


def run_metrics(results: DataFrame, batch_size: int = 64) -> DataFrame:
    """Rows, batches, failures and detections of an inference run."""
    rows = F.count(F.lit(1))
    return results.agg(
        rows.cast("double").alias("rows"),
        F.ceil(rows / batch_size).cast("double").alias("batches"),
        F.count_if(F.col("error").isNotNull()).cast("double").alias("errors"),
        F.coalesce(F.sum("num_detections"), F.lit(0)).cast("double").alias("detections"),
    )


def newest_events(events: DataFrame) -> DataFrame:
    return events.orderBy(F.desc("timestamp"), "event_id")


def trace_events(events: DataFrame) -> DataFrame:
    return events.orderBy("timestamp", "event_id")


def page(ordered: DataFrame, number: int, size: int | None = None, sizes=STANDARD_PAGE) -> DataFrame:
    """Page ``number`` (from 1) of an ordered list; the size is held to the largest allowed."""
    rows = min(size or sizes[0], sizes[1])
    return ordered.offset((number - 1) * rows).limit(rows)


def page_before(
    df: DataFrame, created: str, cursor: Column | None, size: int | None = None,
    tiebreak: str = "event_id", after: Column | None = None,
) -> DataFrame:
    """The newest rows older than the cursor: no row before the page is read twice.

    The cursor is the time of the last row seen and, in ``after``, its id: rows of the same
    time with a larger id follow.  Without ``after`` all rows of that time are skipped.
    """
    older = df
    if cursor is not None:
        tied = F.lit(False) if after is None else (F.col(created) == cursor) & (F.col(tiebreak) > after)
        older = df.filter((F.col(created) < cursor) | tied)
    rows = min(size or KEYSET_PAGE[0], KEYSET_PAGE[1])
    return older.orderBy(F.desc(created), tiebreak).limit(rows)


def search_text(df: DataFrame, fields: list[str], text: str) -> DataFrame:
    """Rows with ``text`` in any of the fields, in any case."""
    wanted = F.lit(text.lower())
    found = F.lit(False)
    for field in fields:
        found = found | F.contains(F.lower(field), wanted)
    return df.filter(found)


def ordered_by(df: DataFrame, fields: list[str]) -> DataFrame:
    """Order by field names, a leading ``-`` for descending."""
    return df.orderBy(*[F.desc(f[1:]) if f.startswith("-") else F.asc(f) for f in fields])


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key.

    ``max_by`` on a struct keeps one row per key and task before the shuffle.
    """
    rest = [name for name in df.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def owned_by(df: DataFrame, **owner: object) -> DataFrame:
    """Rows of one owner, account or session; an owner that is not known has no rows."""
    for column, value in owner.items():
        df = df.filter(F.lit(False) if value is None else F.col(column) == F.lit(value))
    return df


def by_area(detections: DataFrame) -> DataFrame:
    """Detections frame by frame, largest first.

    A total sort: its ranges are cut by area too, so they split a crowded frame.
    """
    return detections.orderBy("video_id", "frame_index", F.desc("area"), "det_seq")


def search_detections(
    detections: DataFrame, label: str | None = None, since: float | None = None,
    min_score: float | None = None, box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Detections by label, time, score and region, every test a pushed-down filter."""
    if label is not None:
        detections = detections.filter(F.col("label") == label)
    if since is not None:
        detections = detections.filter(F.col("timestamp") >= since)
    if min_score is not None:
        detections = detections.filter(F.col("score") >= min_score)
    if box is not None:
        left, top, right, bottom = box
        detections = detections.filter(
            F.col("cx").between(left, right) & F.col("cy").between(top, bottom)
        )
    return detections


def observation_sentence() -> Column:
    """One sentence per detection, for text retrieval."""
    corners = F.concat(
        F.lit("["), F.concat_ws(", ", *[F.col(c).cast("string") for c in "xywh"]), F.lit("]")
    )
    return F.concat(
        F.lit("At "), F.col("timestamp").cast("string"), F.lit(", detected "), F.col("label"),
        F.lit(" (confidence "), F.format_string("%.2f", "score"), F.lit(") at "), corners,
    )
