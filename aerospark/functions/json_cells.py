"""Columns that read cells which may be native values or JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed names of the context sections and of the result lists, in order of preference.
LIST_SECTIONS = ("frames", "tracks")
OBJECT_SECTIONS = ("sensor_meta", "precomputed_features")
RESULT_LISTS = ("detections", "tracks", "results")


def coerce_json(cell: Column, kind: T.DataType) -> Column:
    """Any cell as a variant.

    Text is parsed; blank text is null; text that is no JSON stays a text value.
    Structs, arrays and maps are taken as they are.
    """
    if isinstance(kind, T.VariantType):
        return cell
    if isinstance(kind, T.StringType):
        blank = F.trim(cell) == ""
        return F.when(~blank, F.coalesce(F.try_parse_json(cell), cell.cast("variant")))
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.parse_json(F.to_json(cell))
    return cell.cast("variant")


def is_empty(value: Column) -> Column:
    """Null, false, zero, blank text, an empty list or an empty object."""
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")
    return (
        value.isNull()
        | (kind == "VOID")
        | ((kind == "STRING") & (text == ""))
        | ((kind == "BOOLEAN") & (text == "false"))
        | (kind.startswith("ARRAY") & (text == "[]"))
        | (kind.startswith("OBJECT") & (text == "{}"))
        | (kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & (number == 0))
    )


def is_list(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def row_to_context(kinds: dict[str, T.DataType], include_frames: bool = True) -> Column:
    """The inference context of a row as JSON text: its non-empty sections only.

    A single frame or track is wrapped in a list.  The query is copied as it is.
    """
    sections = []
    for name in LIST_SECTIONS:
        if name not in kinds or (name == "frames" and not include_frames):
            continue
        value = coerce_json(F.col(name), kinds[name])
        listed = F.when(is_list(value), F.try_variant_get(value, "$", "array<variant>"))
        sections.append(
            F.when(~is_empty(value), listed.otherwise(F.array(value))).alias(name)
        )
    for name in OBJECT_SECTIONS:
        if name in kinds:
            value = coerce_json(F.col(name), kinds[name])
            sections.append(F.when(~is_empty(value), value).alias(name))
    if "query" in kinds:
        sections.append(F.when(F.col("query") != "", F.col("query")).alias("query"))
    if not sections:
        return F.lit("{}")
    return F.to_json(F.struct(*sections))


def count_detections(result: Column) -> Column:
    """Detections in a result payload (a variant).

    The first of the known lists that is a list counts, even an empty one; then
    the whole part of a numeric ``summary.count``; else 0.
    """
    counted = []
    for name in RESULT_LISTS:
        value = F.try_variant_get(result, f"$.{name}", "variant")
        counted.append(
            F.when(is_list(value), F.size(F.try_variant_get(value, "$", "array<variant>")))
        )
    summary = F.try_variant_get(result, "$.summary.count", "variant")
    numeric = F.schema_of_variant(summary).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    number = F.try_variant_get(summary, "$", "double")
    # A boolean counts as the number it equals.
    flag = F.when(
        F.schema_of_variant(summary) == "BOOLEAN",
        F.try_variant_get(summary, "$", "boolean").cast("int"),
    )
    whole = F.when(numeric, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
    return F.coalesce(*counted, whole.cast("int"), flag, F.lit(0))


def as_long(value: Column) -> Column:
    """An id as a long; what is no whole number is null."""
    return F.try_cast(value, "bigint") if hasattr(F, "try_cast") else value.try_cast("bigint")


def result_row(
    video: Column, frame: Column, model: Column, result: Column, error: Column
) -> list[Column]:
    """One row of the result table; a failed row carries an empty payload."""
    payload = F.when(error.isNull(), result)
    return [
        as_long(video).alias("video_id"),
        as_long(frame).alias("frame_index"),
        model.alias("model_name"),
        F.coalesce(F.to_json(payload), F.lit("{}")).alias("result_json"),
        F.when(error.isNull(), count_detections(result)).otherwise(0).alias("num_detections"),
        error.alias("error"),
    ]
