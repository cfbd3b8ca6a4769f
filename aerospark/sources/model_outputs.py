"""Raw model outputs as a source: one row per box, whatever layout the model wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerospark.scale import broadcast_if_small

# Fixed names a model may give its arrays, in order of preference.
BOX_NAMES = ("boxes", "detection_boxes", "dets")
SCORE_NAMES = ("scores", "detection_scores")
CLASS_NAMES = ("labels", "classes", "detection_classes")
COMBINED = "outputs"
IMAGES = "images"


def _present(columns: list[str], names: tuple[str, ...]) -> list[Column]:
    return [F.col(name) for name in names if name in columns]


def _box_rows(df: DataFrame, keep: list[str], zipped: Column) -> DataFrame:
    rows = df.select(*keep, F.posexplode(zipped).alias("box_seq", "_item"))
    box = F.col("_item.box")
    checked = F.when(F.size(box) == 4, box).otherwise(
        F.raise_error(F.lit("a box must have four numbers")).cast("array<double>")
    )
    return rows.select(
        *keep, "box_seq", *[checked[i].cast("double").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.col("_item.score").cast("double").alias("score"),
        F.bround(F.col("_item.cls").cast("double"), 0).cast("long").alias("class_id"),
    )


def _zip(boxes: Column, scores: Column, classes: Column) -> Column:
    equal = (F.size(boxes) == F.size(scores)) & (F.size(boxes) == F.size(classes))
    uneven = F.raise_error(F.lit("boxes, scores and classes must be as many")).cast("array<array<double>>")
    return F.transform(
        F.when(F.coalesce(equal, F.lit(True)), boxes.cast("array<array<double>>")).otherwise(uneven),
        lambda box, i: F.struct(
            box.alias("box"), F.get(scores, i).alias("score"), F.get(classes, i).alias("cls")
        ),
    )


def explode_model_outputs(df: DataFrame) -> DataFrame:
    """One row per box with ``x1, y1, x2, y2, score, class_id`` and the other columns kept.

    Known layouts: three arrays under any of their usual names; one array
    ``outputs`` of ``[x1, y1, x2, y2, score, class, ...]`` rows; a list
    ``images`` of structs holding the three arrays.  Any other layout is an error.
    """
    columns = df.columns
    boxes, scores, classes = (
        _present(columns, names) for names in (BOX_NAMES, SCORE_NAMES, CLASS_NAMES)
    )
    special = {*BOX_NAMES, *SCORE_NAMES, *CLASS_NAMES, COMBINED, IMAGES}
    keep = [name for name in columns if name not in special]
    if boxes and scores and classes:
        return _box_rows(
            df, keep, _zip(F.coalesce(*boxes), F.coalesce(*scores), F.coalesce(*classes))
        )
    if COMBINED in columns:
        wide = F.transform(
            COMBINED,
            lambda row: F.when(
                F.size(row) >= 6,
                F.struct(F.slice(row, 1, 4).alias("box"), row[4].alias("score"), row[5].alias("cls")),
            ).otherwise(
                F.raise_error(F.lit("an output row must have six numbers")).cast(
                    "struct<box:array<double>,score:double,cls:double>"
                )
            ),
        )
        return _box_rows(df, keep, wide)
    if IMAGES in columns:
        image = df.schema[IMAGES].dataType
        if isinstance(image, T.ArrayType) and isinstance(image.elementType, T.StructType):
            per_image = df.select(*keep, F.posexplode(IMAGES).alias("image_seq", "_image"))
            return explode_model_outputs(per_image.select(*keep, "image_seq", "_image.*"))
    raise ValueError(f"unknown model output layout: columns {columns}")


def with_labels(
    boxes: DataFrame, label_map: DataFrame | None, strict: bool = False
) -> DataFrame:
    """Class ids as labels from a map with columns ``class_id, label``.

    Lenient: an id the map lacks becomes its own text.  Strict: it is an error.
    """
    as_text = F.col("class_id").cast("string")
    if label_map is None:
        return boxes.withColumn("label", as_text)
    names = broadcast_if_small(
        label_map.select(F.col("class_id").cast("long"), F.col("label").alias("_label"))
    )
    missing = (
        F.raise_error(F.concat(F.lit("class id absent from the label map: "), as_text)).cast("string")
        if strict
        else as_text
    )
    return (
        boxes.join(names, "class_id", "left")
        .withColumn("label", F.when(F.col("_label").isNotNull(), F.col("_label")).otherwise(missing))
        .drop("_label")
    )


def above_threshold(boxes: DataFrame, score: float = 0.0) -> DataFrame:
    return boxes.filter(F.col("score") >= score)
