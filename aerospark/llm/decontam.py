"""Benchmark decontamination by winnowing.

A benchmark item is known by its windows of ``WINDOW`` words; an item with fewer
words is one window.  The minimum of the hashes of the ``GRAM``-word grams inside a
window is its fingerprint, the same for documents and items, so every shared span of
``WINDOW`` words shares a fingerprint.  Fingerprints of documents change only every
few words and are joined to those of the items; a hit is extended to all windows of
its stretch, which are compared by a hash of all their words.

The items are a stated query set, matched against all documents in blocks of bounded
size, all in one scan of the documents.  Documents are not shuffled, and a passage
that many of them share costs each of them its own words only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.llm.base import PLAIN, fresh_name, runs, slices, words_of

WINDOW = 13
GRAM = 5
#: Bytes of benchmark text in a block that is broadcast; its tables take about three times as much.
BLOCK_BYTES = 8 << 20

FOUND = "n_words bigint, spans array<struct<start:int,stop:int>>, items array<string>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


class Items(NamedTuple):
    """The windows of a block of items, by length, and the fingerprints of the full ones."""

    fingerprints: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> sorted codes, item of each
    ids: list[str]


def fingerprints(code: np.ndarray) -> np.ndarray:
    """The least gram hash of every window that begins at a word; windows run over any rows."""
    least = runs(code, GRAM)
    width, reach = WINDOW - GRAM + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        if len(least) <= step:
            return least[:0]
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


def index_items(ids: list[str], texts: list[str]) -> Items:
    prints, windows = [np.empty(0, np.uint64)], {}
    for at, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        code = words_of(data, np.array([0, len(data)]), PLAIN).code
        length = min(len(code), WINDOW)
        if length:
            own = np.unique(runs(code, length))
            codes, items = windows.setdefault(length, ([], []))
            codes.append(own)
            items.append(np.full(len(own), at, np.int32))
        if length == WINDOW:
            prints.append(fingerprints(code))
    joined = {}
    for length, (codes, items) in windows.items():
        code, item = np.concatenate(codes), np.concatenate(items)
        order = np.argsort(code, kind="stable")
        joined[length] = code[order], item[order]
    return Items(np.unique(np.concatenate(prints)), joined, ids)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    place = np.searchsorted(ordered, values)
    return ordered[np.minimum(place, len(ordered) - 1)] == values


def _full_windows(code: np.ndarray, row: np.ndarray, items: Items) -> np.ndarray:
    """Begins of the windows whose fingerprint is one of the items'."""
    least = fingerprints(code)
    n = len(least)
    if not n or not len(items.fingerprints):
        return np.empty(0, np.int64)
    whole = row[:n] == row[WINDOW - 1: WINDOW - 1 + n]
    fresh = np.ones(n, bool)
    fresh[1:] = least[1:] != least[:-1]
    begins = np.flatnonzero(fresh)
    hit = np.flatnonzero(_among(least[begins], items.fingerprints))
    ends = np.append(begins[1:], n)
    if not len(hit):
        return hit
    stretched = np.concatenate([np.arange(begins[k], ends[k]) for k in hit])
    return stretched[whole[stretched]]


def matches(code: np.ndarray, row: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """``begins, length, place`` of the windows in a slice that are windows of an item."""
    for length, (codes, _) in items.windows.items():
        if length == WINDOW:
            begins = _full_windows(code, row, items)
            value = np.array([runs(code[b: b + WINDOW], WINDOW)[0] for b in begins], np.uint64)
        else:
            value = runs(code, length)
            begins = np.flatnonzero(row[: len(value)] == row[length - 1: length - 1 + len(value)])
            value = value[begins]
        found = _among(value, codes)
        yield begins[found], length, value[found]


def find_spans(data: np.ndarray, offsets: np.ndarray, items: Items) -> list[dict]:
    """Per row of a slice: number of words, merged spans of hit words, sorted ids of the items hit."""
    words, rows = words_of(data, offsets, PLAIN), len(offsets) - 1
    first = np.searchsorted(words.row, np.arange(rows + 1))
    change = np.zeros(len(words.row) + 1, np.int64)
    hit: dict[int, set[int]] = {}
    for begins, length, value in matches(words.code, words.row, items):
        np.add.at(change, begins, 1)
        np.add.at(change, begins + length, -1)
        codes, owners = items.windows[length]
        lo, hi = np.searchsorted(codes, value), np.searchsorted(codes, value, side="right")
        for r, a, b in zip(words.row[begins].tolist(), lo.tolist(), hi.tolist()):
            hit.setdefault(r, set()).update(owners[a:b].tolist())
    out = [{"n_words": int(n), "spans": [], "items": []} for n in np.diff(first)]
    if hit:
        covered = np.cumsum(change[:-1]) > 0
        for r, owners in hit.items():
            own = np.diff(np.concatenate([[0], covered[first[r]: first[r + 1]].astype(np.int8), [0]]))
            out[r]["spans"] = [
                {"start": a, "stop": b}
                for a, b in zip(np.flatnonzero(own == 1).tolist(), np.flatnonzero(own == -1).tolist())
            ]
            out[r]["items"] = sorted({items.ids[k] for k in owners})
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[str], list[str]]]:
    rows = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")
    )
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k)
        found = part.orderBy("id", "t").collect()  # bounded by BLOCK_BYTES, on average
        yield [r["id"] for r in found], [r["t"] for r in found]


def _matcher(docs: DataFrame, ids: list[str], texts: list[str]):
    shared = docs.sparkSession.sparkContext.broadcast(index_items(ids, texts))

    @F.arrow_udf(FOUND)
    def find(column: pa.Array) -> pa.Array:
        found = [x for _, _, data, offsets in slices(column) for x in find_spans(data, offsets, shared.value)]
        kind = pa.struct([("n_words", pa.int64()), ("spans", _SPAN), ("items", pa.list_(pa.string()))])
        return pa.array(found, kind)

    return find


def _merged(spans: Column) -> Column:
    """Overlapping and touching spans of an array put together."""
    kind = "array<struct<start:int,stop:int>>"

    def add(done: Column, span: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], span["stop"]).alias("stop"))
        return F.when(
            last.isNotNull() & (span["start"] <= last["stop"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined)),
        ).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.sort_array(spans), F.array().cast(kind), add)


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    out: str = "hits",
) -> DataFrame:
    """``docs`` with a struct ``out``: ``n_words``, ``spans`` of hit words and ids of the ``items`` that hit.

    Words are maximal runs of digits, letters (A-Z lowered) and characters beyond ASCII.
    A word is hit when it lies inside any occurrence of a window of an item.  Spans count
    words from 0, are merged and in order; ids are sorted as strings and distinct.  A null
    text has no words, as has an empty one; a null item id is the text ``null``, and an
    item without words or an empty benchmark hits nothing.
    """
    work, parts = docs, []
    for k, (ids, texts) in enumerate(_blocks(benchmark, item_id, item_text)):
        name = fresh_name(work, f"_block_{k}")
        work = work.withColumn(name, _matcher(docs, ids, texts)(F.coalesce(docs[text], F.lit(""))))
        parts.append(F.col(name))
    if len(parts) == 1:
        found = parts[0]
    else:
        found = F.struct(
            parts[0]["n_words"].alias("n_words"), _merged(F.flatten(F.array(*[p["spans"] for p in parts]))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.array(*[p["items"] for p in parts])))).alias("items"),
        )
    return work.select(*[docs[f"`{c}`"] for c in docs.columns if c != out], found.alias(out))


def hit_words(hits: str = "hits") -> Column:
    return F.aggregate(
        F.col(f"{hits}.spans"), F.lit(0).cast("bigint"), lambda n, s: n + (s["stop"] - s["start"]).cast("bigint")
    )


def contaminated(hits: str = "hits") -> Column:
    """At least one word in twenty is hit."""
    return (hit_words(hits) > 0) & (20 * hit_words(hits) >= F.col(f"{hits}.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **names: str) -> DataFrame:
    """``docs`` without the contaminated ones; all columns stay."""
    out = fresh_name(docs, "_hits")
    return mark_contamination(docs, benchmark, text=text, out=out, **names).filter(~contaminated(out)).drop(out)
