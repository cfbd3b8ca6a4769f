"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a host when the pages of that host that hold it, divided
by all pages of that host, exceed ``RATIO``, and at least ``MIN_PAGES`` hold it.

Lines are known by a 64-bit hash of their trimmed bytes.  They are counted once a
page, summed in each task before the shuffle, so a host with a third of all pages
sends one number a line and task.  A host has at most (distinct lines a page) /
``RATIO`` boilerplate lines, so the list that is joined back to its pages is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.llm.base import cut, fresh_name
from aerospark.scale import fits

RATIO = 0.02
MIN_PAGES = 5
#: Boilerplate lines of all hosts that may be broadcast (8 bytes each); beyond, hosts are joined by a shuffle.
BROADCAST_LINES = 500_000


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _keys(text: str) -> Column:
    """Hashes of the distinct lines of a text that are not blank."""
    return F.array_distinct(
        F.transform(F.filter(_lines(text), lambda x: _trimmed(x) != ""), lambda x: F.xxhash64(_trimmed(x)))
    )


def boilerplate_lines(
    pages: DataFrame, *, host: str = "source", text: str = "text",
    ratio: float = RATIO, min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``host, line, pages``: hash and page count of every boilerplate line of every host."""
    site = F.coalesce(F.col(host), F.lit("")).alias("host")
    totals = pages.groupBy(site).agg(F.count(F.lit(1)).alias("total"))
    counted = (
        pages.select(site, F.explode(_keys(text)).alias("line"))
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
        .filter(F.col("pages") >= min_pages)
    )
    return counted.join(totals, "host").filter(F.col("pages") / F.col("total") > ratio).select(
        "host", "line", "pages"
    )


def drop_boilerplate(
    pages: DataFrame, *, host: str = "source", text: str = "text",
    ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False,
) -> DataFrame:
    """``pages`` with the boilerplate lines of their host taken out of ``text``.

    The other lines keep their bytes, order and line ends.  A null text stays null,
    and a text of which all lines go becomes empty.  Blank lines are no boilerplate.
    A null host is the empty host.  Every row is a page, repeated rows too.  Columns
    of any name pass through.  ``counts`` adds ``n_lines`` and ``n_dropped``.
    """
    found = cut(boilerplate_lines(pages, host=host, text=text, ratio=ratio, min_pages=min_pages))
    site, rules = fresh_name(pages, "_site"), fresh_name(pages, "_rules")
    here, lines = fresh_name(pages, "_here"), fresh_name(pages, "_lines")
    by_host = found.groupBy(F.col("host").alias(site)).agg(F.collect_set("line").alias(rules))
    if fits(found, BROADCAST_LINES):
        by_host = F.broadcast(by_host)
    marked = (
        pages.withColumn(site, F.coalesce(F.col(host), F.lit(""))).join(by_host, site, "left")
        .withColumn(here, F.array_intersect(_keys(text), F.coalesce(F.col(rules), F.array().cast("array<bigint>"))))
    )
    kept = F.filter(_lines(text), lambda x: ~F.array_contains(F.col(here), F.xxhash64(_trimmed(x))))
    some = F.size(here) > 0
    out = marked.withColumn(lines, F.when(some, kept))
    cleaned = F.when(some, F.array_join(lines, "\n")).otherwise(F.col(text))
    wanted = [(cleaned if c == text else F.col(f"`{c}`")).alias(c) for c in pages.columns]
    if counts:
        n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(_lines(text)))
        wanted += [n.alias("n_lines"), F.when(some, n - F.size(lines)).otherwise(F.lit(0)).alias("n_dropped")]
    return out.select(*wanted)
