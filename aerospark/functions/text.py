"""Columns over descriptions, URLs, names and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns and limits.
BLANKS = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
URL_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
BRACE_BOX = r"\{x:\s*(\d+),\s*y:\s*(\d+),\s*w:\s*(\d+),\s*h:\s*(\d+)\}"
PAREN_BOX = r"\(x:\s*(\d+),\s*y:\s*(\d+),\s*width:\s*(\d+),\s*height:\s*(\d+)\)"
CAPTION_CHARS = 280
TAG_COUNT = 8
LABEL_COUNT = 5
SLUG_CHARS = 40
FILE_NAME_CHARS = 255
FORMATS = {".onnx": "onnx", ".pt": "torch", ".pth": "torch", ".torchscript": "torch", ".engine": "onnx"}


def tags(description: Column) -> Column:
    """The first eight words of a description, commas taken as blanks.

    One match ends after the eighth word; only that piece is split.
    """
    gap, word = f"[{BLANKS},]", f"[^{BLANKS},]"
    start = F.regexp_extract(description, f"^{gap}*((?:{word}+{gap}*){{0,{TAG_COUNT}}})", 1)
    return F.filter(F.split(start, f"{gap}+"), lambda w: w != "")


def labels(tag_list: Column) -> Column:
    return F.slice(tag_list, 1, LABEL_COUNT)


def caption(text: Column, description: Column) -> Column:
    """The caption given, or the start of the description."""
    start = F.substring(description, 1, CAPTION_CHARS)
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(start)


def embedding(text: Column, dims: int) -> Column:
    """A repeatable vector: SHA-256 of ``text:i``, read as little-endian 32-bit fractions.

    Each digest is bound to a lambda variable, so a text is hashed once per block.
    """
    blocks = F.sequence(F.lit(0), F.lit((dims + 7) // 8 - 1))
    digests = F.transform(blocks, lambda i: F.sha2(F.concat(text, F.lit(":"), i.cast("string")), 256))

    def fraction(part: Column) -> Column:
        pairs = [F.substring(part, at, 2) for at in (7, 5, 3, 1)]
        return F.conv(F.concat(*pairs), 16, 10).cast("double") / F.lit(4294967295.0)

    def fractions(digest: Column) -> Column:
        words = F.sequence(F.lit(0), F.lit(7))
        return F.transform(
            F.transform(words, lambda j: F.substr(digest, j * 8 + 1, F.lit(8))), fraction
        )

    return F.slice(F.flatten(F.transform(digests, fractions)), 1, dims)


def fit_vector(vector: Column, dims: int) -> Column:
    """Zeros added, or the end cut off, to reach ``dims`` values."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), dims)), 1, dims)


def box_in_text(text: Column) -> Column:
    """The first box written in a text, the brace form before the other; null without one."""

    def found(pattern: str) -> Column:
        parts = [F.regexp_extract(text, pattern, i) for i in range(1, 5)]
        numbers = [F.try_to_number(p, F.lit("9" * 18)).cast("long") for p in parts]
        return F.when(parts[0] != "", F.struct(*[n.alias(k) for n, k in zip(numbers, "xywh")]))

    return F.coalesce(found(BRACE_BOX), found(PAREN_BOX))


def _url(url: Column, part: int) -> Column:
    return F.regexp_extract(url, URL_PARTS, part)


def file_name(url: Column) -> Column:
    """The last step of a URL's path."""
    return F.when(url != "", F.element_at(F.split(_url(url, 3), "/"), -1))


def frame_url(
    video_url: Column, frame: Column, folder: str = "images", prefix: str = "frame",
    include_name: bool = False, video_id: Column | None = None,
) -> Column:
    """Where a frame of a video is stored: beside the video, the query string kept."""
    steps = F.split(_url(video_url, 3), "/")
    name = F.get(F.split(F.element_at(steps, -1), r"\."), F.lit(0))
    container = F.coalesce(F.get(steps, F.lit(1)), F.lit(""))
    between = F.size(steps) - 3
    folders = F.array_join(F.slice(steps, F.lit(3), F.greatest(between, F.lit(0))), "/")
    place = F.when(folders == "", "output").otherwise(folders)
    parts = [_url(video_url, 1), F.lit("://"), _url(video_url, 2), F.lit("/"), container, F.lit("/"),
             place, F.lit(f"/{folder}")]
    if video_id is not None:
        text = video_id.cast("string")
        parts.append(F.when(text != "", F.concat(F.lit("/"), text)).otherwise(F.lit("")))
    parts.append(F.lit(f"/{prefix}"))
    if include_name:
        parts.append(name)
    parts += [frame.cast("string"), F.lit(".jpg")]
    query = _url(video_url, 4)
    parts.append(F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.concat(*parts)


def frame_from_template(template: Column, frame: Column) -> Column:
    return F.replace(template, F.lit("frame(number)"), F.concat(F.lit("frame"), frame.cast("string")))


def indexed_url(url: Column) -> Column:
    """The URL with ``_indexed`` after the video's name, wherever the name occurs."""
    name = F.get(F.split(F.element_at(F.split(_url(url, 3), "/"), -1), r"\."), F.lit(0))
    return F.when(name == "", url).otherwise(F.replace(url, name, F.concat(name, F.lit("_indexed"))))


def trim_file_name(name: Column, longest: int = FILE_NAME_CHARS) -> Column:
    """A file name cut to a length; its extension stays whole."""
    extension = F.regexp_extract(name, r"[^./][^/]*?(\.[^./]*)$", 1)
    base = F.substr(name, F.lit(1), F.length(name) - F.length(extension))
    return F.concat(F.substr(base, F.lit(1), F.lit(longest) - F.length(extension)), extension)


def slug(session: Column) -> Column:
    """A session id as lower-case words joined by dashes, at most forty characters."""
    dashed = F.regexp_replace(F.lower(session.cast("string")), r"[^a-z0-9]+", "-")
    bare = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.substring(F.coalesce(F.nullif(bare, F.lit("")), F.lit("session")), 1, SLUG_CHARS)


def index_name(base: str, session: Column, isolation: str) -> Column:
    """The shared index under filter isolation, else one index per session."""
    return F.lit(base) if isolation == "filter" else F.concat(F.lit(f"{base}-s-"), slug(session))


def blob_prefix(session: Column) -> Column:
    return F.concat(F.lit("sessions/"), slug(session), F.lit("/"))


def blob_path(session: Column, name: Column) -> Column:
    return F.concat(blob_prefix(session), F.regexp_replace(name, "^/+", ""))


def model_format(path: Column) -> Column:
    """The runtime format of a model file; an unknown extension is an error."""
    base = F.element_at(F.split(path, "/"), -1)
    extension = F.lower(F.regexp_extract(base, r"[^./][^/]*?(\.[^./]*)$", 1))
    stem = F.lower(F.substr(base, F.lit(1), F.length(base) - F.length(extension)))
    known = F.lit(None).cast("string")
    for name, runtime in FORMATS.items():
        known = F.when(extension == name, runtime).otherwise(known)
    message = F.concat(F.lit("unrecognised model extension: "), path)
    return F.when(known.isNull(), F.raise_error(message)).when(
        stem.contains("yolo"), "yolo"
    ).otherwise(known)


def parse_size(text: Column) -> Column:
    """``WxH`` as a pair of integers; null stays null."""
    parts = F.split(F.lower(text), "x")
    good = F.size(parts) == 2
    wrong = F.raise_error(F.concat(F.lit("size must have two components: "), text)).cast("array<int>")
    pair = F.transform(parts, lambda p: F.trim(p).cast("int"))
    return F.when(text.isNotNull(), F.when(good, pair).otherwise(wrong))
