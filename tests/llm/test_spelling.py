"""Near words, forms and roots against brute force; pivots and prefixes; odd texts."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerospark.llm import spelling
from aerospark.llm.queries import QUERIES


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(rows):
    words = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 2}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def brute(words, near):
    out = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, n, len(near[w]), words[form] if form else None]
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def near_by_pairs(words):
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    return near


def near_by_edits(words):
    """Near words by making each word's deletions, for more words than pairs allow."""
    by_gap = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            by_gap[w[:k], w[k + 1:]].add(w)
    near = {w: set() for w in words}
    for (head, tail), some in by_gap.items():
        for w in some:
            near[w] |= some - {w}
            if head + tail in words:
                near[w].add(head + tail)
                near[head + tail].add(w)
    return near


def rows_of(found):
    rows = [tuple(r[k] for k in ("word", "form", "root", "n", "n_near", "form_n")) for r in found.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_query_against_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    words = counted(docs)
    near = near_by_edits(words)
    some = dict(random.Random(1).sample(sorted(words.items()), 400))
    assert {w: set(x) for w, x in near_by_pairs(some).items()} == {w: near[w] & set(some) for w in some}
    want = brute(words, near)
    assert len(want) > 500 and any(r[1] for r in want)
    assert rows_of(QUERIES["op12_spelling_variants"](spark, small)) == want


@pytest.mark.parametrize("letters", ["ab", "abcdef", "abcdefghijklmnopqrstuvwxyzàéîõü÷×ÿ"])
def test_near_words_of_few_letters(spark, letters):
    """Few letters make bigrams repeat and tie, so prefixes grow and pivots lie close."""
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randint(7, 10))): rng.randint(1, 3000) for _ in range(250)}
    for w in list(words):
        k = rng.randrange(len(w))
        words[w[:k] + rng.choice(letters) + w[k + rng.randint(0, 1):]] = rng.randint(1, 3000)
        words[w[:k] + w[k + 1:] + w[-1] * (len(w) == 7)] = rng.randint(1, 50)
    words["a" * 7], words["a" * 8], words["a" * 9] = 1, 10, 1000
    words["ab" * 200], words["ab" * 199 + "a"] = 5, 500
    frame = spark.createDataFrame(sorted(words.items()), "word string, n bigint")
    assert rows_of(spelling.variants(frame)) == brute(words, near_by_pairs(words))


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = np.random.default_rng(3)
    for _ in range(500):
        ranks = rng.integers(0, 6, rng.integers(6, 14))
        places = spelling.prefix_of(ranks)
        assert len(places) >= 3 and set(np.argsort(ranks, kind="stable")[:3]) <= set(places.tolist())
        cost = rng.integers(1, 50, len(places))
        own = dict(zip(places.tolist(), cost.tolist()))
        a, b = spelling.pivots_of(places, cost)
        least = min(own[x] + own[y] for x in own for y in own if y - x >= 2)
        assert b - a >= 2 and own[a] + own[b] == least


def test_odd_texts(spark):
    rows = [
        (1, "Government government GOVERNMENT governmnet goverment goverment"), (2, "government " * 60), (None, None),
        (None, "government strasse straße Straße ÀÉÎÕÜÿ× ÀÉÎÕÜÿ×"), (3, ""), (3, "short words only"), (4, "x" * 5000 + " " + "x" * 5000),
        (4, "x" * 4999 + " y" + "x" * 4999), (5, "x" * 4999), (2, "government " * 60), (6, "naı̈veté naïvetés naïvetés"), (7, "東京governments東京governments"),
    ]
    docs = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    words = counted(rows)
    assert rows_of(spelling.group_variants(docs)) == brute(words, near_by_pairs(words))
    assert spelling.group_variants(docs.filter("doc_id = 3")).count() == 0
    assert spelling.group_variants(docs.limit(0)).count() == 0


def test_roots_follow_chains(spark):
    chain = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "f"), ("p", "q")]
    found = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert found == {**{w: "f" for w in "abcdex"}, "p": "q"}
    none = spark.createDataFrame([], "word string, form string")
    assert spelling.roots(none).withColumn("x", F.lit(1)).count() == 0
