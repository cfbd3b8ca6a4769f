"""Language ID by nearest centroid over TF-IDF vectors of hashed character n-grams.

A text becomes the counts of its byte 1- to 3-grams over letters (A-Z lowered, any
other stretch is one blank), hashed into ``DIMS``, damped, weighted by inverse document
frequency and normalised.  Each language has several centroids, found by clustering
its training texts on the sphere.  A text gets the language of the centroid with the
largest cosine, and is rejected when it is farther from that centroid than its limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.llm.base import LOWER, cut, released, slices
from aerospark.scale import broadcast_if_small

DIMS = 4096
CENTROIDS = 4
ROUNDS = 12
#: About so many distinct training texts of each language are fitted on.
TRAIN_ROWS = 500
#: Languages whose centroids are held at a time.
BLOCK = 64
#: The share of a centroid's training texts that lie within its limit.
WITHIN = 0.999

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True

PREDICTED = "lang string, cosine double, rejected boolean"


class Centroids(NamedTuple):
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # least cosine that is not rejected, of each centroid


class Model(NamedTuple):
    weights: np.ndarray  # inverse document frequencies
    blocks: list[Broadcast]  # of ``Centroids``, in the order of the languages


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of a slice by hashed n-gram: how often each occurs."""
    rows = len(offsets) - 1
    low = LOWER[data]
    low = np.where(_LETTER[low], low, np.uint8(32))
    of_byte = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    blank = np.zeros(len(low), bool)
    blank[1:] = (low[1:] == 32) & (low[:-1] == 32) & (of_byte[1:] == of_byte[:-1])
    low, of_byte = low[~blank], of_byte[~blank]
    out = np.zeros(rows * DIMS, np.int64)
    for length in (1, 2, 3):
        n = len(low) - length + 1
        if n <= 0:
            break
        code = np.full(n, length, np.uint32)
        for k in range(length):
            code = (code ^ low[k: k + n]) * np.uint32(0x01000193)
        code ^= code >> np.uint32(15)
        code = (code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 12)
        same = of_byte[:n] == of_byte[length - 1:]
        if length == 1:
            same &= low != 32
        out += np.bincount(of_byte[:n][same] * DIMS + code[same], minlength=rows * DIMS)
    return out.reshape(rows, DIMS)


def vectors(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.log1p(found, dtype=np.float32) * weights
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-12)


def cluster(points: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart first centres; centres and the centre of each point."""
    centres = [points[0]]
    near = points @ points[0]
    while len(centres) < min(k, len(points)):
        centres.append(points[int(np.argmin(near))])
        near = np.maximum(near, points @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        for j in range(len(centres)):
            if (own == j).any():
                mean = points[own == j].mean(axis=0)
                centres[j] = mean / max(1e-12, float(np.sqrt((mean * mean).sum())))
    return centres, (points @ centres.T).argmax(axis=1)


def fit_language(points: np.ndarray) -> Centroids:
    """The centroids of one language, of the vectors of its texts."""
    centroids, limits = [], []
    points = points[(points != 0).any(axis=1)]
    if len(points):
        centres, place = cluster(points, CENTROIDS)
        for j, centre in enumerate(centres):
            if (place == j).any():
                centroids.append(centre)
                limits.append(float(np.quantile(points[place == j] @ centre, 1 - WITHIN)))
    return Centroids([], np.array(centroids, np.float32).reshape(-1, DIMS), np.array(limits))


def _counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """First row, last row + 1 and counts, a few rows at a time."""
    for a, b, data, offsets in slices(column, 1 << 19):
        for at in range(0, b - a, 256):
            to = min(at + 256, b - a)
            yield a + at, a + to, counts(data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at])


def _weights(usable: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all rows of ``usable``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(DIMS + 1, np.int64)  # rows with each n-gram, and all rows
        for part in batches:
            for a, b, found in _counted(part.column(0)):
                held[:DIMS] += (found > 0).sum(axis=0)
                held[DIMS] += b - a
        if held[DIMS]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(held)], names=["gram", "n"])

    df = np.zeros(DIMS + 1, np.int64)
    found = usable.select("_text").mapInArrow(released(run), "gram bigint, n bigint")
    for row in found.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        df[row["gram"]] = row["n"]
    return (np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1).astype(np.float32)


def _sample(usable: DataFrame, rows: int) -> DataFrame:
    """``_lang, _key, _found``: the counts of about ``rows`` distinct texts of each language."""
    keyed = usable.withColumn("_key", F.xxhash64("_text"))
    langs = cut(keyed.select("_lang", "_key").distinct().groupBy("_lang").agg(F.count(F.lit(1)).alias("_n")))
    share = F.pmod(F.col("_key"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    chosen = keyed.join(broadcast_if_small(langs), "_lang").filter(share * F.col("_n") < rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for part in batches:
            own = [*zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            fresh = []
            for k, key in enumerate(own):
                if key not in seen:
                    seen.add(key)
                    fresh.append(k)
            for a, b, found in _counted(part.column(2).take(pa.array(fresh, pa.int64()))):
                yield pa.RecordBatch.from_arrays([
                    pa.array([own[k][0] for k in fresh[a:b]], pa.string()), pa.array([own[k][1] for k in fresh[a:b]], pa.int64()),
                    pa.array([row.tobytes() for row in found.astype(np.float32)], pa.binary()),
                ], names=["_lang", "_key", "_found"])

    found = chosen.select("_lang", "_key", "_text").mapInArrow(released(run), "_lang string, _key bigint, _found binary")
    return found.dropDuplicates(["_lang", "_key"])


def fit(
    docs: DataFrame, train: Column, *, text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS,
) -> Model:
    """Fit on about ``rows`` distinct whole texts of each language, chosen by a hash of the text.

    ``train`` is a condition over ``docs``; rows with a null language, or a text that is null
    or has no letter, are left out.  The frequencies of n-grams are those of all other rows.
    Each language is fitted in a task of its own, and none is left out.
    """
    usable = docs.filter(train & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).cast("string").alias("_lang"), F.col(text).alias("_text")
    )
    weights = _weights(usable)

    def train_one(group: pa.Table) -> pa.Table:
        group = group.sort_by("_key")
        found = np.stack([np.frombuffer(value.as_buffer(), np.float32) for value in group["_found"]])
        own = fit_language(vectors(found, weights))
        return pa.table({
            "lang": group["_lang"][:1], "centroids": pa.array([own.centroids.tobytes()], pa.binary()),
            "limits": pa.array([own.limits], pa.list_(pa.float64())),
        })

    made = "lang string, centroids binary, limits array<double>"
    fitted = cut(_sample(usable, rows).groupBy("_lang").applyInArrow(train_one, made))
    blocks, held, context = [], [], docs.sparkSession.sparkContext

    def done() -> None:
        own = [np.frombuffer(row["centroids"], np.float32).reshape(-1, DIMS) for row in held]
        langs = [row["lang"] for row, part in zip(held, own) for _ in part]
        if langs:
            limits = np.concatenate([np.array(row["limits"], float) for row in held])
            blocks.append(context.broadcast(Centroids(langs, np.concatenate(own), limits)))
        held.clear()

    for row in fitted.orderBy("lang").toLocalIterator():  # a block of languages is held at a time
        held.append(row)
        if len(held) == BLOCK:
            done()
    done()
    return Model(weights, blocks)


def predict(docs: DataFrame, model: Model, out: str = "language", *, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``out``: nearest ``lang``, its ``cosine``, and whether it is ``rejected``.

    ``lang`` is null, the cosine 0 and the text rejected if the text is null or has no letter, or
    nothing was learned.  Equally near centroids go to the first language in order.  A rejected
    text still carries its nearest language.  Columns of any name pass through.
    """
    weights, blocks = model

    @F.arrow_udf(PREDICTED)
    def nearest(column: pa.Array) -> pa.Array:
        langs, cosines, rejected = [], [], []
        for a, b, found in _counted(column):
            points = vectors(found, weights)
            best, limit, name = np.full(b - a, -np.inf, np.float32), np.full(b - a, np.inf), np.full(b - a, None, object)
            for shared in blocks:
                own = shared.value
                cosine = points @ own.centroids.T
                place = cosine.argmax(axis=1)
                highest = cosine[np.arange(b - a), place]
                nearer = np.flatnonzero(highest > best)
                best[nearer], limit[nearer] = highest[nearer], own.limits[place[nearer]]
                name[nearer] = [own.langs[p] for p in place[nearer]]
                if len(blocks) > 1 and getattr(shared, "_path", None):
                    vars(shared).pop("_value", None)  # a worker holds one block, and reads it again from its disk
            best = np.clip(best, 0, 1).astype(np.float64)
            langs += name.tolist()
            cosines += best.tolist()
            rejected += (best < limit).tolist()
        kind = pa.struct([("lang", pa.string()), ("cosine", pa.float64()), ("rejected", pa.bool_())])
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(cosines, pa.float64()), pa.array(rejected, pa.bool_())],
            fields=list(kind),
        )

    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    guess = nearest(F.when(has_letter, F.col(text)).otherwise(F.lit("")))
    nothing = F.struct(
        F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("cosine"), F.lit(True).alias("rejected")
    )
    return docs.withColumn(out, guess).withColumn(out, F.when(has_letter, F.col(out)).otherwise(nothing))
