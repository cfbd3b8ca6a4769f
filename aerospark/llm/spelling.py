"""Spelling variants: words one edit apart, found by pivotal grams.

A word's bigrams are ordered by how many words hold them, rarest first.  Its prefix are its
three first bigrams, with all that tie with the third: one edit touches two bigrams at most.
Its pivots are two disjoint bigrams of the prefix, those that the fewest words hold together,
chosen by dynamic programming along the word.  One edit leaves one of them whole, so of two
near words, that whose prefix ends earlier in the order has a pivot in the prefix of the other.

Position limits: an edit lies before or after the pivot that it leaves.  Before it, the pivot
lies equally far from both words' ends, and after it, from both words' beginnings, and on that
side the words do not differ at all.  So pivots and prefixes meet only where the letters up to
that end are equal and lengths differ by at most one, and each candidate is verified.

Bigrams are counted in one row each; letters from a closed alphabet bound their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerospark.llm.base import batch, cut, released

SHORTEST = 7
OCCURRENCES = 2
#: A form occurs so many times as often as its variant, at least.
RATIO = 10
#: One run in so many loses a letter.
DAMAGE = 31
#: Fixed value: runs of letters.
RUNS = "[A-Za-z\\u00C0-\\u00FF]+"
#: Letters of lowered runs: a to z and 64 others, so at most 90 * 90 bigrams.
ALPHABET = 90

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", damage: int | None = DAMAGE) -> DataFrame:
    """``word, n``: distinct words of all texts that are long and frequent enough.

    With ``damage``, a run whose crc32, with its document's id, is a multiple of it loses the
    letter that the crc32 names.
    """
    runs = docs.select(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(RUNS), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= SHORTEST)
    word: Column = F.translate("run", UPPER, LOWER)
    if damage:
        lowered = runs.select("id", word.alias("run"))
        code = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        place = (F.col("code") % F.length("run")).cast("int")
        runs = lowered.withColumn("code", code)
        without = F.concat(F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run")))
        word = F.when(F.col("code") % damage == 0, without).otherwise(F.col("run"))
    return (
        runs.select(word.alias("word")).filter(F.length("word") >= SHORTEST)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OCCURRENCES)
    )


def gram_counts(words: DataFrame) -> dict[str, int]:
    """How many words hold each bigram; at most ``ALPHABET`` squared."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.col("word").substr(k, F.lit(2)))
    counted = words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r["gram"]: r["n"] for r in counted.collect()}


def letters_of(word: str) -> int:
    """A bit for each of 63 classes of letters that occurs an odd number of times."""
    bits = 0
    for letter in word:
        bits ^= 1 << ord(letter) % 63
    return bits


def prefix_of(ranks: np.ndarray) -> np.ndarray:
    """Places of the three bigrams of least rank and of those that tie with the third."""
    return np.flatnonzero(ranks <= np.partition(ranks, 2)[2])


def pivots_of(places: np.ndarray, cost: np.ndarray) -> tuple[int, int]:
    """Two of the places, in order, at least two apart, with the least sum of costs.

    ``best`` is the cheapest single choice among the places that may go with the next one.
    """
    best, chosen, total = -1, (int(places[0]), int(places[-1])), None
    reach = 0
    for k in range(1, len(places)):
        while places[reach] <= places[k] - 2:
            if best < 0 or cost[reach] < cost[best]:
                best = reach
            reach += 1
        if best >= 0 and (total is None or cost[best] + cost[k] < total):
            total, chosen = cost[best] + cost[k], (int(places[best]), int(places[k]))
    return chosen


def _keys(words: DataFrame, counts: dict[str, int]) -> DataFrame:
    """``word, pivot, last, letters, key``: where a word's pivots and prefix may meet others.

    ``last`` is the rank at which the prefix ends; a key stands for the letters from a bigram
    to the word's beginning or end, and for the length of one of the two words.
    """
    order = sorted(counts, key=lambda g: (counts[g], g))
    shared = words.sparkSession.sparkContext.broadcast(({g: k for k, g in enumerate(order)}, counts))
    schema = pa.schema([
        ("word", pa.string()), ("size", pa.int32()), ("pivot", pa.bool_()), ("last", pa.int32()), ("letters", pa.int64()),
        ("side", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, many = shared.value
        for part in batches:
            out: list[tuple] = []
            for word in part.column(0).to_pylist():
                grams = [word[k: k + 2] for k in range(len(word) - 1)]
                ranks = np.array([rank[g] for g in grams])
                places = prefix_of(ranks)
                last = int(ranks[places].max())
                chosen = pivots_of(places, np.array([many[grams[k]] for k in places.tolist()]))
                letters = letters_of(word)
                for k in places.tolist():
                    sides = (f"<{word[: k + 2]}", f">{word[k:]}")
                    out += [(word, len(word), False, last, letters, side) for side in sides]
                    if k in chosen:
                        out += [(word, len(word), True, last, letters, side) for side in sides]
            if out:
                yield batch(schema, *zip(*out))

    found = words.select("word").mapInArrow(
        released(run), "word string, size int, pivot boolean, last int, letters bigint, side string"
    )
    # a pivot looks for words of its own length and one more or less
    sizes = F.when(F.col("pivot"), F.sequence(F.col("size") - 1, F.col("size") + 1)).otherwise(F.array("size"))
    return found.withColumn("of", F.explode(sizes)).select(
        "word", "pivot", "last", "letters", F.xxhash64("side", "of").alias("key")
    )


def near_words(words: DataFrame) -> DataFrame:
    """``a, b``: all pairs of distinct words that one inserted, deleted or replaced letter tells apart, both ways."""
    keys = cut(_keys(words, gram_counts(words)))
    pivots = keys.filter("pivot").select(F.col("word").alias("a"), F.col("last").alias("last_a"), F.col("letters").alias("letters_a"), "key")
    others = keys.filter("NOT pivot").select(F.col("word").alias("b"), F.col("last").alias("last_b"), F.col("letters").alias("letters_b"), "key")
    # one edit changes which letters occur an odd number of times by two at most
    changed = F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b")))
    met = pivots.join(others, "key").filter(
        (F.col("last_a") <= F.col("last_b")) & (changed <= 2) & (F.col("a") != F.col("b"))
        & (F.levenshtein("a", "b", 1) == 1)
    )
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` from ``word, form``: the last form that a word leads to.

    Each form occurs ``RATIO`` times as often as its word, so a chain has at most as many
    steps as a count has digits; steps are doubled until none is left.
    """
    current = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(current.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"))
        if not step.filter(F.col("next").isNotNull()).head(1):
            return step.select("word", "root")
        current = step.select("word", "root")


def variants(words: DataFrame, *, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``words`` (``word, n``, distinct, 7 letters or more).

    Near words differ by exactly one inserted, deleted or replaced code point; ``n_near`` counts
    them.  ``form`` is the near word of largest n, ties going to the smaller in code-point order,
    if its n is at least ``ratio`` times the word's; else null, as is ``form_n``.  ``root``
    follows forms to the last one and is the word itself where it has none.
    """
    words = cut(words.select("word", F.col("n").cast("bigint").alias("n")))
    near = near_words(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("n_b")), "b")
    best = F.min(F.struct((-F.col("n_b")).alias("rank"), F.col("b").alias("word")))
    found = near.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    count = -F.col("best.rank")
    strong = count >= F.lit(ratio) * F.col("n")
    joined = cut(words.join(found, "word", "left").select(
        "word", F.when(strong, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, count).alias("form_n"),
    ))
    rooted = roots(joined.filter(F.col("form").isNotNull()).select("word", "form"))
    return joined.join(rooted, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def group_variants(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", damage: int | None = DAMAGE, ratio: int = RATIO,
) -> DataFrame:
    """``variants`` of the words of all texts of ``docs``.

    A null or empty text has no words; a null id counts as the text ``null``; repeated rows
    count again.  Texts and words may be of any length.  A table without words gives no rows.
    """
    return variants(words_of_texts(docs, doc_id=doc_id, text=text, damage=damage), ratio=ratio)
