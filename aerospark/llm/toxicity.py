"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The features are densities of lexicon words and lexicon stems, their nearness to words
of the second person, capitals, punctuation and marks of obfuscation.  The lexicon is
a short list of insults and what one third of the training texts teaches: words and
word beginnings that are far more frequent in toxic ones.  Trees are boosted on the second third and calibrated on
the last, so no step judges texts that the one before has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.llm.base import LOWER, PLAIN, Words, released, slices, words_of
from aerospark.llm.quality import texts_of, training_rows

#: Bound of the training sample: rows of each label.
TRAIN_ROWS = 4000
STEMS = (4, 5, 6)
#: A lexicon entry occurs in so many toxic texts of its part at least, in this share of them,
#: and so many times as often as in others.
LEAST_TEXTS = 3
LEAST_SHARE = 0.01
LEAST_RATIO = 12.0
NEAR = 5
TREES, DEPTH, BINS, RATE, LEAF = 60, 3, 32, 0.2, 4

#: Words of the second person in the languages of the corpus.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie "
    "tu te toi ton ta tes vous votre vos tú ti tus vosotros usted ustedes vuestro"
).split()

#: Common insults, in the lexicon whatever the training texts hold.
INSULTS = (
    "idiot idiots stupid moron morons loser losers trash garbage pathetic worthless scum disgusting clown dumb fool "
    "jerk imbecile vermin filth freak coward creep"
).split()

FEATURES = (
    "word_density", "word_hits", "stem_density", "stem_hits", "near_second_person", "second_person", "capitals",
    "shouted_words", "marks", "repeated_marks", "hidden_hits", "mixed_words", "long_runs", "words",
)

#: What stands for a letter in disguised words.
_DISGUISE = np.arange(256, dtype=np.uint8)
for _there, _letter in zip(b"013457@$", b"oieastas"):
    _DISGUISE[_there] = _letter


class Lexicon(NamedTuple):
    words: np.ndarray  # sorted codes
    stems: dict[int, np.ndarray]


class Trees(NamedTuple):
    """Complete trees in level order: feature and threshold of inner nodes, value of leaves."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    start: float


class Model(NamedTuple):
    lexicon: Lexicon
    trees: Trees
    steps: np.ndarray  # margins and the calibrated scores at them
    scores: np.ndarray


def _member(codes: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered) or not len(codes):
        return np.zeros(len(codes), bool)
    coarse = np.zeros(1 << 16, bool)
    coarse[(ordered >> np.uint64(48)).astype(np.int64)] = True
    out = coarse[(codes >> np.uint64(48)).astype(np.int64)]
    place = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(ordered, codes[place]), len(ordered) - 1)
    out[place] = ordered[at] == codes[place]
    return out


def _codes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    found = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]), PLAIN)
    return np.unique(found.code)


def _hits(words: Words, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    by_stem = np.zeros(len(words.code), bool)
    for length, codes in lexicon.stems.items():
        by_stem |= _member(words.prefix[length], codes) & (words.stop - words.start >= length)
    return _member(words.code, lexicon.words), by_stem


def _undisguised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with disguises replaced and longer runs of a letter made one, and the new offsets."""
    data = LOWER[_DISGUISE[data]]
    if len(data) < 3:
        return data, offsets
    of_byte = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    equal = (data[1:] == data[:-1]) & (of_byte[1:] == of_byte[:-1])
    drop = np.zeros(len(data), bool)
    drop[1:] = equal
    run = np.zeros(len(data), bool)
    run[2:] = equal[1:] & equal[:-1]
    run[1:-1] |= equal[1:] & equal[:-1]
    drop &= run & PLAIN[data]
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return data[~drop], kept[offsets]


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, second: np.ndarray) -> np.ndarray:
    """Rows of a slice by ``FEATURES``."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(FEATURES)), np.float64)
    if not len(data):
        return out
    words = words_of(data, offsets, PLAIN, STEMS)
    word, stem = _hits(words, lexicon)
    total = np.bincount(words.row, minlength=rows)
    per_word, per_byte = np.maximum(total, 1), np.maximum(np.diff(offsets), 1)

    def of_words(flag: np.ndarray) -> np.ndarray:
        return np.bincount(words.row[flag], minlength=rows)

    def of_bytes(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    you = _member(words.code, second)
    places = np.flatnonzero(you)
    near = np.zeros(len(words.code), bool)
    hit = np.flatnonzero(word | stem)
    if len(places) and len(hit):
        at = np.searchsorted(places, hit)
        for side in (np.minimum(at, len(places) - 1), np.maximum(at - 1, 0)):
            other = places[side]
            near[hit] |= (np.abs(other - hit) <= NEAR) & (words.row[other] == words.row[hit])
    capital = (data >= 65) & (data <= 90)
    letter = (LOWER[data] >= 97) & (LOWER[data] <= 122)
    mark = (data == 33) | (data == 63)
    # whether a byte and those before it lie in one row
    of_byte = np.repeat(np.arange(rows), np.diff(offsets))
    joined = of_byte[1:] == of_byte[:-1]
    twice = np.zeros(len(data), bool)
    twice[1:] = mark[1:] & mark[:-1] & joined
    digit = (data >= 48) & (data <= 57)
    other = (data == 42) | (data == 64) | (data == 36)
    inner = np.zeros(len(data), bool)
    inner[1:-1] = (digit | other)[1:-1] & letter[:-2] & letter[2:] & joined[1:] & joined[:-1]
    runs = np.zeros(len(data), bool)
    runs[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & joined[1:] & joined[:-1]
    caps = np.concatenate([[0], np.cumsum(capital)])
    shouted = (caps[words.stop] - caps[words.start] == words.stop - words.start) & (words.stop - words.start > 1)
    plain, places_of = _undisguised(data, offsets)
    shown = words_of(plain, places_of, PLAIN, STEMS)
    hidden = np.bincount(shown.row[np.logical_or(*_hits(shown, lexicon))], minlength=rows)
    hidden = np.maximum(0, hidden - of_words(word | stem))
    for k, column in enumerate((
        of_words(word) / per_word, np.log1p(of_words(word)), of_words(stem) / per_word, np.log1p(of_words(stem)),
        of_words(near) / per_word, of_words(you) / per_word, of_bytes(capital) / np.maximum(of_bytes(letter), 1),
        of_words(shouted) / per_word, of_bytes(mark) / per_byte, of_bytes(twice) / per_byte, hidden / per_word,
        of_bytes(inner) / per_word, of_bytes(runs) / per_word, np.log1p(total),
    )):
        out[:, k] = column
    return out


def _frequent(codes: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Codes that many toxic texts hold and few others do."""
    each = np.concatenate([np.unique(c) for c in codes]) if codes else np.empty(0, np.uint64)
    mark = np.repeat(toxic, [len(np.unique(c)) for c in codes]) if codes else np.empty(0, bool)
    values, place = np.unique(each, return_inverse=True)
    bad, good = np.bincount(place[mark], minlength=len(values)), np.bincount(place[~mark], minlength=len(values))
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    least = max(LEAST_TEXTS, LEAST_SHARE * n_bad)
    return values[(bad >= least) & (bad / n_bad >= LEAST_RATIO * (good + 0.5) / n_good)]


def learn_lexicon(texts: list[bytes], toxic: np.ndarray) -> Lexicon:
    found = [words_of(np.frombuffer(t, np.uint8), np.array([0, len(t)]), PLAIN, STEMS) for t in texts]
    return Lexicon(
        np.union1d(_frequent([w.code for w in found], toxic), _codes(INSULTS)),
        {k: _frequent([w.prefix[k][w.stop - w.start >= k] for w in found], toxic) for k in STEMS},
    )


def boost(points: np.ndarray, labels: np.ndarray) -> Trees:
    """Logistic boosting of complete trees over binned features, by sums of gradients in each bin."""
    n, width = points.shape
    cuts = [np.unique(np.quantile(points[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(width)]
    binned = np.stack([np.searchsorted(cuts[k], points[:, k], side="left") for k in range(width)], axis=1)
    share = np.clip(labels.mean(), 1e-4, 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    margin, feature, limit, value = np.full(n, start), [], [], []
    for _ in range(TREES):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = labels - chance, np.maximum(chance * (1 - chance), 1e-6)
        node = np.zeros(n, np.int64)
        tree_feature, tree_limit = [], []
        for depth in range(DEPTH):
            nodes = 1 << depth
            best = np.full(nodes, -np.inf)
            own_feature, own_bin = np.zeros(nodes, np.int64), np.full(nodes, BINS)
            for k in range(width):
                cell = node * (BINS + 1) + binned[:, k]
                g = np.bincount(cell, slope, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                h = np.bincount(cell, bend, nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                count = np.bincount(cell, minlength=nodes * (BINS + 1)).reshape(nodes, -1).cumsum(axis=1)
                all_g, all_h, all_n = g[:, -1:], h[:, -1:], count[:, -1:]
                gain = g**2 / (h + 1) + (all_g - g) ** 2 / (all_h - h + 1) - all_g**2 / (all_h + 1)
                gain[(count < LEAF) | (all_n - count < LEAF)] = -np.inf
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = top > best + 1e-12
                best[better], own_feature[better], own_bin[better] = top[better], k, at[better]
            tree_feature.append(own_feature)
            limits = [cuts[f][b] if b < len(cuts[f]) else np.inf for f, b in zip(own_feature, own_bin)]
            tree_limit.append(np.array(limits))
            # values equal to a cut lie at or below it
            node = 2 * node + (points[np.arange(n), own_feature[node]] > tree_limit[-1][node])
        leaves = 1 << DEPTH
        step = np.bincount(node, slope, leaves) / (np.bincount(node, bend, leaves) + 1)
        margin += RATE * step[node]
        feature.append(np.concatenate(tree_feature))
        limit.append(np.concatenate(tree_limit))
        value.append(RATE * step)
    return Trees(np.array(feature), np.array(limit), np.array(value), start)


def margins(points: np.ndarray, trees: Trees) -> np.ndarray:
    out, each = np.full(len(points), trees.start), np.arange(len(points))
    for feature, limit, value in zip(trees.feature, trees.limit, trees.value):
        node = np.zeros(len(points), np.int64)
        for depth in range(DEPTH):
            inner = node + (1 << depth) - 1
            node = 2 * node + (points[each, feature[inner]] > limit[inner])
        out += value[node]
    return out


def isotonic(margin: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins in order and the non-decreasing scores at them that fit the labels best."""
    order = np.argsort(margin, kind="stable")
    at, first = np.unique(margin[order], return_index=True)
    weight = np.diff(np.append(first, len(order))).astype(float)
    mean = np.add.reduceat(labels[order].astype(float), first) / weight
    blocks: list[list[float]] = []
    for k in range(len(at)):
        blocks.append([mean[k], weight[k], 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, n = blocks.pop()
            a, b, c = blocks.pop()
            blocks.append([(a * b + m * w) / (b + w), b + w, c + n])
    return at, np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit_model(texts: list[bytes], labels: np.ndarray, part: np.ndarray) -> Model:
    """``part`` (0, 1, 2) tells which texts teach the lexicon, the trees and the calibration."""
    lexicon = learn_lexicon([t for t, p in zip(texts, part) if p == 0], labels[part == 0] == 1)
    second = _codes(SECOND_PERSON)
    points = np.concatenate([
        features(np.frombuffer(t, np.uint8), np.array([0, len(t)]), lexicon, second) for t in texts
    ])
    trees = boost(points[part == 1], labels[part == 1].astype(float))
    steps, scores = isotonic(margins(points[part == 2], trees), labels[part == 2])
    return Model(lexicon, trees, steps, scores)


def calibrated(margin: np.ndarray, model: Model) -> np.ndarray:
    return np.interp(margin, model.steps, model.scores) if len(model.steps) else np.full(len(margin), 0.5)


_MADE = (
    "words array<bigint>, stems array<array<bigint>>, feature array<bigint>, edge array<double>, "
    "value array<double>, begin double, steps array<double>, scores array<double>"
)


def fit(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, *,
    doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS,
) -> Model | None:
    """Train on at most ``rows`` whole texts of each label; one task sees that bounded sample.

    ``train`` is a condition over ``labels``.  None if a part of the sample lacks a label.
    """
    wanted = training_rows(labels, label, train, doc_id, rows)  # at most 2 * rows ids
    sample = texts_of(docs, wanted, doc_id, text).withColumn("_part", F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(3)))

    def train_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for part in batches:
            texts = [v.as_py() for v in part.column(1).cast(pa.large_binary())]
            seen += zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist(), part.column(3).to_pylist())
        seen.sort()
        marks, parts = np.array([s[2] for s in seen], np.int64), np.array([s[3] for s in seen], np.int64)
        if any(len(set(marks[parts == p].tolist())) < 2 for p in range(3)):
            return
        own = fit_model([s[1] for s in seen], marks, parts)
        codes = lambda c: c.view(np.int64).tolist()
        yield pa.RecordBatch.from_pylist([{
            "words": codes(own.lexicon.words), "stems": [codes(own.lexicon.stems[k]) for k in STEMS],
            "feature": own.trees.feature.ravel().tolist(), "edge": own.trees.limit.ravel().tolist(),
            "value": own.trees.value.ravel().tolist(), "begin": own.trees.start,
            "steps": own.steps.tolist(), "scores": own.scores.tolist(),
        }], schema=pa.schema([
            ("words", pa.list_(pa.int64())), ("stems", pa.list_(pa.list_(pa.int64()))), ("feature", pa.list_(pa.int64())),
            *[(k, pa.list_(pa.float64())) for k in ("edge", "value")], ("begin", pa.float64()),
            *[(k, pa.list_(pa.float64())) for k in ("steps", "scores")],
        ]))

    row = sample.select("_id", "_text", "_label", "_part").repartition(1).mapInArrow(released(train_all), _MADE).first()
    if row is None:
        return None
    codes = lambda c: np.array(c, np.int64).view(np.uint64)
    return Model(
        Lexicon(codes(row["words"]), {k: codes(c) for k, c in zip(STEMS, row["stems"])}),
        Trees(
            np.array(row["feature"]).reshape(TREES, -1), np.array(row["edge"]).reshape(TREES, -1),
            np.array(row["value"]).reshape(TREES, -1), row["begin"],
        ),
        np.array(row["steps"]), np.array(row["scores"]),
    )


def score(docs: DataFrame, model: Model | None, out: str, *, text: str = "text") -> DataFrame:
    """``docs`` with the calibrated probability that a whole text is toxic in column ``out``.

    A null text is scored as an empty one; without a model every score is 0.  Columns of any
    name pass through; a column called ``out`` is replaced.
    """
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicon and trees of a bounded sample

    @F.arrow_udf("double")
    def probability(column: pa.Array) -> pa.Array:
        own, second = shared.value, _codes(SECOND_PERSON)
        parts = [
            calibrated(margins(features(data, offsets, own.lexicon, second), own.trees), own)
            for _, _, data, offsets in slices(column)
        ]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return docs.withColumn(out, probability(F.coalesce(F.col(text), F.lit(""))))
