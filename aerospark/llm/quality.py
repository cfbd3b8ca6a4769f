"""Quality classifier: averaged vectors of hashed word and character n-grams with a softmax.

The features of a text are its words, its pairs of neighbouring words and its byte
2- to 4-grams, hashed into ``BUCKETS``.  Each bucket has a learned vector; a document
is the average of the vectors of all its features, and a softmax over the labels
follows.  The vectors are trained by stochastic gradient descent in numpy.

Since the average and the layer after it are linear, a trained model is folded into
one number a bucket (the margin its vector adds), and a text is scored by their mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.llm.base import SPACED, batch, mix, released, slices, words_of

#: Bound of the training sample: rows of each label.
TRAIN_ROWS = 1000
BITS = 17
DIM = 12
EPOCHS = 4
RATE = 0.4
CHAR_GRAMS = (2, 3, 4)

FITTED = "margins array<float>"
_FITTED = pa.schema([("margins", pa.list_(pa.float32()))])


class Bags(NamedTuple):
    """Feature buckets of a slice, one array a kind of feature, with the row of each feature."""

    bucket: list[np.ndarray]
    row: list[np.ndarray]


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    n = len(data) - length + 1
    code = np.full(n, length * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(length):
        code = (code ^ data[k: k + n]) * np.uint32(0x01000193)
    code ^= code >> np.uint32(15)
    return ((code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> Bags:
    """Buckets of the words, word pairs and byte n-grams of a slice; none spans two rows."""
    buckets, rows = [], []
    of_byte = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for length in CHAR_GRAMS:
        if len(data) >= length:
            same = of_byte[: len(data) - length + 1] == of_byte[length - 1:]
            buckets.append(_grams(data, length)[same])
            rows.append(of_byte[: len(data) - length + 1][same])
    words = words_of(data, offsets, SPACED)
    top = np.uint64(64 - BITS)
    buckets.append((words.code >> top).astype(np.int32))
    rows.append(words.row.astype(np.int32))
    if len(words.code) > 1:
        first, second = words.code[:-1], words.code[1:]
        # a word that repeats its neighbour is one pair, whatever the word
        pair = np.where(first == second, np.uint64(7), first * np.uint64(3) + second)
        same = words.row[:-1] == words.row[1:]
        buckets.append((mix(pair[same]) >> top).astype(np.int32))
        rows.append(words.row[:-1][same].astype(np.int32))
    return Bags(buckets, rows)


def bag_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and the share of its features in each."""
    data = np.frombuffer(text, np.uint8)
    found = features(data, np.array([0, len(data)]))
    bucket, count = np.unique(np.concatenate(found.bucket), return_counts=True)
    return bucket, (count / max(1, count.sum())).astype(np.float32)


def fit_margins(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 11) -> np.ndarray:
    """Stochastic gradient descent over the given bags; the last entry of the result is the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = EPOCHS * max(1, len(bags)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(bags)):
            bucket, share = bags[k]
            own = vectors[bucket]
            hidden = share @ own
            score = hidden @ layer + bias
            wrong = np.exp(score - score.max())
            wrong /= wrong.sum()
            wrong[int(labels[k])] -= 1
            rate = np.float32(RATE * (1 - done / steps))
            back = layer @ wrong
            layer -= rate * np.outer(hidden, wrong)
            bias -= rate * np.float32(0.1) * wrong
            # the share is small in long texts, so the step is taken relative to its largest
            vectors[bucket] = own - rate * np.outer(share / max(share.max(), 1e-9), back)
            done += 1
    return np.append(vectors @ (layer[:, 1] - layer[:, 0]), bias[1] - bias[0]).astype(np.float32)


def training_rows(labels: DataFrame, label: str, train: Column, doc_id: str, rows: int) -> DataFrame:
    """``_id, _label`` of at most ``rows`` training rows of each label, chosen by a hash of the id."""
    usable = labels.filter(train).filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    picked = None
    for value in (0, 1):
        some = (
            usable.filter(F.col(label) == value)
            .select(F.col(doc_id).alias("_id"), F.lit(value).alias("_label")).distinct()
            .orderBy(F.xxhash64("_id"), "_id").limit(rows)
        )
        picked = some if picked is None else picked.unionByName(some)
    # an id labelled both ways tells nothing
    return picked.groupBy("_id").agg(F.min("_label").alias("_label"), F.max("_label").alias("_other")).filter(
        F.col("_label") == F.col("_other")
    ).drop("_other")


def texts_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_id, _label, _text`` of the wanted ids, one row each; of repeated ids the least text."""
    own = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return own.join(F.broadcast(wanted), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def fit(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, *,
    doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS,
) -> list[float]:
    """Train on at most ``rows`` whole texts of each label; one task sees that bounded sample.

    ``train`` is a condition over ``labels``.  Null labels and other values are left out.
    Without two labels the margins are zero but for the bias of the one there is.
    """
    sample = texts_of(docs, training_rows(labels, label, train, doc_id, rows), doc_id, text)  # at most 2 * rows

    def train_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for part in batches:
            binary = part.column(1).cast(pa.large_binary())
            for key, value, mark in zip(part.column(0).to_pylist(), binary, part.column(2).to_pylist()):
                seen.append((key, bag_of(value.as_py()), mark))  # arrays in place of the text
        seen.sort(key=lambda own: own[0])
        marks = np.array([mark for _, _, mark in seen], np.int64)
        margins = np.zeros((1 << BITS) + 1, np.float32)
        if len(set(marks.tolist())) == 2:
            margins = fit_margins([bag for _, bag, _ in seen], marks)
        elif len(marks):
            margins[-1] = 4.0 if marks[0] else -4.0
        yield batch(_FITTED, pa.array([margins], pa.list_(pa.float32())))

    row = sample.select("_id", "_text", "_label").repartition(1).mapInArrow(released(train_all), FITTED).first()
    return row["margins"] if row else [0.0] * ((1 << BITS) + 1)


def score(docs: DataFrame, margins: list[float], out: str, *, text: str = "text") -> DataFrame:
    """``docs`` with the probability of label 1 of every whole text in column ``out``.

    A null or empty text has no features and gets the probability that the bias alone gives.
    Columns of any name pass through; a column called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(np.asarray(margins, np.float32))  # 2 ** BITS + 1

    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        model = shared.value
        result = np.full(len(column), model[-1], np.float64)
        for a, b, data, offsets in slices(column):
            found = features(data, offsets)
            total, count = np.zeros(b - a), np.zeros(b - a)
            for bucket, row in zip(found.bucket, found.row):
                total += np.bincount(row, model[bucket], b - a)
                count += np.bincount(row, minlength=b - a)
            result[a:b] += total / np.maximum(count, 1)
        return pa.array(1 / (1 + np.exp(-np.clip(result, -500, 500))))

    return docs.withColumn(out, probability(F.coalesce(F.col(text), F.lit(""))))
