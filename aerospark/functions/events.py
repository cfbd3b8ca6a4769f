"""Columns over wide commentary events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerospark.functions.text import BLANKS, CAPTION_CHARS

# Fixed values of the event API.
SCHEMA_VERSION = "1.0"
FILTERABLE = (
    "trace_id", "correlation_key", "source", "video_id", "analysis_id",
    "frame_index", "schema_version",
)
JSON_MAPS = ("attributes", "metadata")
LINE_BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def event_field(path: str, columns: list[str]) -> Column:
    """A top-level field, or one key of an open map written ``map.key``.

    Everything after the first dot is one literal key.  A head that is not a
    map, or a field the table lacks, is null.  Open values come back as text,
    a nested value as its JSON.
    """
    head, dotted, tail = path.partition(".")
    if head not in columns:
        return F.lit(None).cast("string")
    if not dotted:
        return F.col(head)
    if head == "metrics":
        return F.try_element_at("metrics", F.lit(tail))
    if head in JSON_MAPS:
        entries = F.try_variant_get(F.col(head), "$", "map<string,variant>")
        return F.try_variant_get(F.try_element_at(entries, F.lit(tail)), "$", "string")
    return F.lit(None).cast("string")


def correlation_key(video: Column, frame: Column, trace: Column) -> Column:
    """``video:V|frame:F`` without the null parts; the trace when both are null."""
    parts = F.concat_ws(
        "|", F.concat(F.lit("video:"), video.cast("string")),
        F.concat(F.lit("frame:"), frame.cast("string")),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), trace)


def rollup_key(video: Column, routine: Column) -> Column:
    return F.concat(
        F.lit("video:"), F.coalesce(video.cast("string"), F.lit("None")), F.lit("|routine:"), routine
    )


def summary_key(video: Column, trace: Column, scope: str) -> Column:
    """Key of a scene summary: by video when there is one, else by trace."""
    subject = F.when(
        video.isNotNull(), F.concat(F.lit("video:"), video.cast("string"))
    ).otherwise(F.concat(F.lit("trace:"), trace))
    return F.concat(subject, F.lit(f"|scope:{scope}"))


def segment_start(frame: Column, fps: Column) -> Column:
    """Seconds at which the frame starts; null without a frame rate."""
    return F.when(fps != 0, frame / fps.cast("double"))


def segment_end(frame: Column, fps: Column, step: Column) -> Column:
    """Seconds at which the sampled frame's segment ends; a missing step counts as one."""
    span = F.when(step > 0, step).otherwise(1)
    return F.when(fps != 0, (frame + span) / fps.cast("double"))


def stable_id(width: int, *parts: Column) -> Column:
    """A hexadecimal id that a repeated task computes again, unlike a random one."""
    text = F.concat_ws("|", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts])
    return F.substring(F.sha2(text, 256), 1, width)


def numeric_only(values: Column) -> Column:
    """The numbers of a JSON object as a map; booleans, text and nulls are left out.

    A value that is no object has no numbers.
    """
    given = F.try_variant_get(values, "$", "map<string,variant>")
    entries = F.map_entries(F.coalesce(given, F.create_map().cast("map<string,variant>")))
    kinds = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("key"),
            F.schema_of_variant(e["value"]).alias("kind"),
            F.try_variant_get(e["value"], "$", "double").alias("value"),
        ),
    )
    numbers = F.filter(kinds, lambda e: e["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))
    return F.map_from_entries(F.transform(numbers, lambda e: F.struct(e["key"], e["value"])))


def general_number(value: Column) -> Column:
    """A number with six significant digits as C's ``%g`` writes it.

    A number whose shortest form ends in a seventh digit 5 is rounded up.
    """
    scientific = F.format_string("%.5e", F.abs(value))
    digits = F.replace(F.split(scientific, "e")[0], F.lit("."), F.lit(""))
    power = F.split(scientific, "e")[1].cast("int")

    def trimmed(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    wide = F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    exponent = F.concat(
        F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0")
    )
    mantissa = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2)))
    plain = F.when(power >= 0, trimmed(wide)).otherwise(trimmed(small))
    text = F.when(
        (power < -4) | (power >= 6), F.concat(trimmed(mantissa), F.lit("e"), exponent)
    ).otherwise(plain)
    return F.when(value == 0, "0").otherwise(F.concat(F.when(value < 0, "-").otherwise(""), text))


def echo_completion(prompt: Column) -> Column:
    """The deterministic stand-in for a text model: the first line that is not blank.

    What follows the leading blanks is that line, so the rest is not looked at.
    """
    line = F.regexp_extract(F.coalesce(prompt, F.lit("")), f"^[{BLANKS}]*([^{LINE_BREAKS}]*)", 1)
    first = F.regexp_replace(line, f"[{BLANKS}]+$", "")
    return F.substring(F.concat(F.lit("[echo] "), first), 1, CAPTION_CHARS)
