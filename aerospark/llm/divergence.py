"""How the words of a language's sources diverge, over terms found by iceberg prefix refinement.

A term is kept for a language if at least ``LEAST`` of its documents hold it.  The kept terms
are found without counting all terms: byte prefixes are extended level by level, doubling in
length, and a prefix that too few documents hold is dropped with all that begins with it.  At
each level the terms that end there are complete, and those that enough documents hold are kept.

Texts are read once.  A task counts, for bounded runs of documents, in how many of them each
prefix of each level occurs, and how often each term occurs in each source; a document's terms
lie in order, so equal prefixes are neighbours.  These partial counts lie in runs of one level, so a
level reads its own pages, joins them with the prefixes that the level before kept, and sums them.
No document crosses a shuffle, and a frequent term or a large source is one number a run.

Shares of terms are whole numbers in billionths.  Sources are compared over all kept terms of
their language, though only counts above zero are joined: what a pair of sources adds where one
or both have none follows from the numbers of terms by count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aerospark.llm.base import batch, cut, released, slices
from aerospark.scale import broadcast_if_small

LEAST = 3
#: Bytes of the prefixes of the first level; each level doubles them.
FIRST = 2
#: Terms and distinct terms of documents that are counted together, at most, but for the last document.
RUN, DISTINCT = 1 << 22, 400_000
BILLION = 1_000_000_000
TOP = 200

#: Fixed value: the bytes that make up terms, of lowered texts.
TERMS = re.compile(rb"[a-z\x80-\xff]+")

_PARTIAL = (
    "level int, open boolean, lang string, parent binary, item binary, n bigint, "
    "by_source array<struct<source:string,n:bigint>>"
)
_BY_SOURCE = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
_SCHEMA = pa.schema([
    ("level", pa.int32()), ("open", pa.bool_()), ("lang", pa.string()), ("parent", pa.binary()), ("item", pa.binary()),
    ("n", pa.int64()), ("by_source", _BY_SOURCE),
])


def _level_of(size: np.ndarray) -> np.ndarray:
    """The level at which a term of so many bytes is complete."""
    return np.ceil(np.log2(np.maximum(size, FIRST) / FIRST)).astype(np.int64)


class _Numbers(dict):
    """Numbers of terms in the order in which they are first met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


class Run:
    """Documents that are counted together, as numbers of their terms."""

    def __init__(self):
        self.rows: list[tuple[str, str]] = []
        self.place = _Numbers()
        self.terms: list[np.ndarray] = []
        self.held = 0

    def add(self, lang: str, source: str, terms: list[bytes]) -> None:
        self.rows.append((lang, source))
        self.terms.append(np.fromiter(map(self.place.__getitem__, terms), np.int32, len(terms)))
        self.held += len(terms)

    def full(self) -> bool:
        return self.held > RUN or len(self.place) > DISTINCT

    def counts(self) -> Iterator[pa.RecordBatch]:
        """Documents of each prefix by level; complete terms also with their occurrences by source."""
        names = pa.array(list(self.place), pa.binary())
        order = pc.array_sort_indices(names)
        names, width = names.take(order), max(1, len(names))
        rank = np.empty(width, np.int64)
        rank[order.to_numpy()] = np.arange(len(names))
        langs, lang = np.unique(np.array([r[0] for r in self.rows], object), return_inverse=True)
        sources, source = np.unique(np.array([r[1] for r in self.rows], object), return_inverse=True)
        row = np.repeat(np.arange(len(self.rows)), [len(t) for t in self.terms])
        # a document's terms lie in the order of their bytes
        pair, times = np.unique(row * width + rank[np.concatenate(self.terms)], return_counts=True)
        row, term = pair // width, pair % width
        if not len(row):
            return
        ends = _level_of(pc.binary_length(names).to_numpy(zero_copy_only=False))
        yield from self._complete(names, ends, langs, sources, lang[row] * width + term, source[row], times)
        level = 0
        while (here := ends[term] > level).any():
            row, term, length = row[here], term[here], FIRST << level
            alive = np.flatnonzero(ends > level)
            heads = pc.binary_slice(names.take(pa.array(alive)), 0, length)
            fresh = np.ones(len(alive), bool)
            fresh[1:] = pc.not_equal(heads[1:], heads[:-1]).to_numpy(zero_copy_only=False)
            head = np.zeros(width, np.int64)
            head[alive] = np.cumsum(fresh) - 1
            at = head[term]
            once = np.ones(len(at), bool)
            once[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
            key, n = np.unique(lang[row[once]] * width + at[once], return_counts=True)
            items = heads.take(pa.array(np.flatnonzero(fresh)[key % width]))
            yield self._batch(level, True, langs[key // width], items, n, None)
            level += 1

    def _complete(self, names, ends, langs, sources, key, source, times) -> Iterator[pa.RecordBatch]:
        width, kinds = max(1, len(names)), len(sources)
        documents, n = np.unique(key, return_counts=True)
        by_source, which = np.unique(key * kinds + source, return_inverse=True)
        occurrences = np.bincount(which, times, len(by_source)).astype(np.int64)
        first = np.searchsorted(by_source // kinds, documents)
        count = np.append(first[1:], len(by_source)) - first
        levels = ends[documents % width]
        for level in np.unique(levels).tolist():
            some = np.flatnonzero(levels == level)
            stop = np.cumsum(count[some])
            flat = np.repeat(first[some] - (stop - count[some]), count[some]) + np.arange(stop[-1])
            own = pa.StructArray.from_arrays(
                [pa.array(sources[by_source[flat] % kinds], pa.string()), pa.array(occurrences[flat])], ["source", "n"]
            )
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), own)
            items = names.take(pa.array(documents[some] % width))
            yield self._batch(level, False, langs[documents[some] // width], items, n[some], lists)

    @staticmethod
    def _batch(level: int, is_open: bool, langs, items: pa.Array, n: np.ndarray, by_source) -> pa.RecordBatch:
        size = len(items)
        parents = pc.binary_slice(items, 0, (FIRST << level) // 2 if level else 0)
        return batch(
            _SCHEMA, np.full(size, level, np.int32), np.full(size, is_open), pa.array(langs, pa.string()), parents, items,
            n, pa.nulls(size, _BY_SOURCE) if by_source is None else by_source,
        )


def partial_counts(docs: DataFrame, *, text: str, lang: str, source: str) -> DataFrame:
    """``level, open, lang, parent, item, n, by_source``: what each run of documents holds."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Run()
        for part in batches:
            for a, b, data, offsets in slices(part.column(2)):
                raw = data.tobytes().lower()
                langs, sources = (part.column(k).slice(a, b - a).to_pylist() for k in (0, 1))
                for x, y, begin, end in zip(langs, sources, offsets[:-1].tolist(), offsets[1:].tolist()):
                    held.add(x, y, TERMS.findall(raw, begin, end))
                    if held.full():
                        yield from held.counts()
                        held = Run()
        if held.rows:
            yield from held.counts()

    return docs.select(*named).mapInArrow(released(run), _PARTIAL)


def kept_terms(partials: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, term``: terms that at least ``least`` documents of the language hold.

    Goes from level to level while prefixes are left; each level sums only the partial counts
    whose shorter prefix enough documents hold.
    """
    parts, level = [], 0
    survivors: DataFrame | None = None
    while True:
        here = partials.filter(F.col("level") == level).select("open", "lang", "parent", "item", "n")
        if survivors is not None:
            prefixes = survivors.filter("open").select("lang", F.col("item").alias("parent"))
            if not prefixes.head(1):
                break
            here = here.join(broadcast_if_small(prefixes), ["lang", "parent"], "left_semi")
        summed = here.groupBy("open", "lang", "item").agg(F.sum("n").alias("n"))
        survivors = cut(summed.filter(F.col("n") >= least).select("open", "lang", "item"))
        parts.append(survivors.filter("NOT open").select("lang", F.col("item").alias("term")))
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / (total + terms)), exactly."""
    top, bottom = _whole(F.lit(BILLION)) * _whole(count + 1), _whole(total + terms)
    return (F.lit(1) + F.call_function("div", top.cast("decimal(38,0)"), bottom)).cast("bigint")


def _surprise(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) for shares of up to a billion and one."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs in ``docs``.

    Terms are maximal runs of letters A-Z, lowered, and of all characters beyond ASCII.  Kept
    are, for each language, the V terms that at least ``least`` of its rows hold.  A group gives
    a term with ``count`` occurrences the share p = 1 + floor(10^9 (count + 1) / (N + V)), N being
    its occurrences of all kept terms.  Part ``pair`` compares a source with each other source of
    its language: the sum of floor((p - q)^2 / q) over all kept terms, q the other's share.  Part
    ``term`` gives the first ``top`` terms that the source has and whose p is above the share q
    of its whole language.  Ranks begin with 1 at the largest value; ties go by the item's bytes.

    Null texts, languages and sources are empty ones.  Every row is a document, repeated rows
    too.  A language without kept terms compares all its pairs as 0; a language with one source
    has no pairs.  An empty table gives no rows.
    """
    partials = cut(partial_counts(docs, text=text, lang=lang, source=source))
    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    kept = cut(kept_terms(partials, least))
    occurring = partials.filter("NOT open").select("lang", F.col("item").alias("term"), "by_source")
    counts = cut(
        occurring.join(broadcast_if_small(kept), ["lang", "term"], "left_semi")
        .select("lang", "term", F.inline("by_source"))
        .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))
    )
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = cut(
        docs.select(*group).distinct().join(totals, ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
        .withColumn("none", F.when(F.col("terms") > 0, _share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"))))
    )
    small = broadcast_if_small(groups)
    shares = cut(
        counts.join(small, ["lang", "source"])
        .select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "none")
    )
    ranked = _pairs(groups, shares).unionByName(_terms(groups, shares, top))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _exact_sum(name: str) -> list[Column]:
    """Sums of the halves of whole numbers, which stay small where the sum of the numbers may not."""
    return [
        F.sum(F.shiftright(name, 32)).alias(f"{name}_high"),
        F.sum(F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_low"),
    ]


def _joined(name: str) -> Column:
    return (_whole(F.col(f"{name}_high")) * _whole(F.lit(1 << 32)) + _whole(F.col(f"{name}_low"))).cast("decimal(38,0)")


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Part ``pair``: the sum over all kept terms, from terms that both have, one has, and neither has."""
    mine = groups.select("lang", "source", F.col("none").alias("p0"), "terms")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("q0"))
    pairs = mine.join(theirs, "lang").filter(F.col("source") != F.col("item"))
    by_share = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("k"))
    both_none = _surprise(F.col("p0"), F.col("q0"))
    # as if no term occurred in either
    base = pairs.select("lang", "source", "item", (_whole(both_none) * F.col("terms")).cast("decimal(38,0)").alias("d"))
    # what changes with the terms of one side
    of_mine = pairs.join(by_share, ["lang", "source"]).select(
        "lang", "source", "item", (_whole(_surprise(F.col("p"), F.col("q0")) - both_none) * F.col("k")).cast("decimal(38,0)").alias("d")
    )
    of_theirs = pairs.join(by_share.toDF("lang", "item", "q", "k"), ["lang", "item"]).select(
        "lang", "source", "item", (_whole(_surprise(F.col("p0"), F.col("q")) - both_none) * F.col("k")).cast("decimal(38,0)").alias("d")
    )
    # and what changes once more where both have the term; each two sources meet once
    left = shares.select("lang", "term", "source", "p", F.col("none").alias("p0"))
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("none").alias("q0"))

    def change(p: Column, p0: Column, q: Column, q0: Column) -> Column:
        return _surprise(p, q) - _surprise(p, q0) - _surprise(p0, q) + _surprise(p0, q0)

    forth = change(F.col("p"), F.col("p0"), F.col("q"), F.col("q0"))
    back = change(F.col("q"), F.col("q0"), F.col("p"), F.col("p0"))
    half = cut(
        left.join(right, ["lang", "term"]).filter(F.col("source") < F.col("item"))
        .select("lang", "source", "item", forth.alias("forth"), back.alias("back"))
        .groupBy("lang", "source", "item").agg(*_exact_sum("forth"), *_exact_sum("back"))
    )
    of_both = half.select("lang", "source", "item", _joined("forth").alias("d")).unionByName(
        half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), _joined("back").alias("d"))
    )
    summed = (
        base.unionByName(of_mine).unionByName(of_theirs).unionByName(of_both)
        .groupBy("lang", "source", "item").agg(F.coalesce(F.sum("d"), F.lit(0)).cast("bigint").alias("value"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))


def _terms(groups: DataFrame, shares: DataFrame, top: int) -> DataFrame:
    """Part ``term``: the terms by which a source stands out from its language."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.max("terms").alias("terms"))
    terms = shares.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"))
    language = terms.join(broadcast_if_small(whole), "lang").select(
        "lang", "term", _share(F.col("in_lang"), F.col("all"), F.col("terms")).alias("q")
    )
    found = shares.join(language, ["lang", "term"]).filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").cast("string").alias("item"), _surprise(F.col("p"), F.col("q")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
