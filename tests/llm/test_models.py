"""Classifiers, the language model and vectors: known answers, held-out accuracy, brute force, odd rows."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aerospark.llm import langid, maxent, near_vectors, quality, toxicity
from aerospark.llm.base import held_out
from aerospark.llm.queries import QUERIES


def every():
    return F.lit(True)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(f"word{k}" for k in rng.integers(0, 60, 40)) for _ in range(80)]
    bad = [" ".join(f"JUNK{k}!!" for k in rng.integers(0, 60, 40)) for _ in range(80)]
    rows = [(k, t, 1, 0, 7) for k, t in enumerate([*good, *bad, None, "", " "])]
    docs = spark.createDataFrame([*rows, (None, "word1 word2", 1, 0, 7), rows[3]],
                                 "doc_id bigint, text string, _id int, _label int, score int")
    marks = [(k, int(k < 80), int(k >= 80)) for k in range(150)]
    labels = spark.createDataFrame([*marks, (None, 1, 0), (3, 1, 0), (160, None, None), (161, 5, 9)],
                                   "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_quality(spark, labelled):
    docs, labels = labelled
    margins = quality.fit(docs, labels, "quality", F.col("doc_id") % 2 == 0, rows=30)
    rows = quality.score(docs, margins, "score").collect()
    assert len(rows) == 165 and len(rows[0]) == 5
    for r in rows:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 160:
            assert (r["score"] > 0.5) == (r["doc_id"] < 80)
    empty = {r["score"] for r in rows if not r["text"]}
    assert len(empty) == 1
    assert quality.score(docs.limit(0), margins, "score").count() == 0


def test_quality_with_one_label_or_none(spark, labelled):
    docs, labels = labelled
    only = quality.fit(docs, labels.filter("quality = 1"), "quality", every())
    assert {r["score"] > 0.9 for r in quality.score(docs, only, "s").collect()} == {True}
    none = quality.fit(docs.limit(0), labels, "quality", every())
    assert {r["s"] for r in quality.score(docs, none, "s").collect()} == {0.5}


def test_repeated_ids_are_one_training_row(spark):
    rows = [(k, f"{('good', 'bad')[k % 2]} word{k}") for k in range(40)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    some, more = (spark.createDataFrame(own, "doc_id bigint, text string") for own in (rows, rows + [(3, f"z{j}") for j in range(30)]))
    assert quality.fit(some, marks, "quality", every()) == quality.fit(more, marks, "quality", every())
    assert quality.TRAIN_ROWS == 1000


def test_folded_margins_equal_the_mean_of_the_bag():
    rng = np.random.default_rng(1)
    texts = [b"ab cd ab", b"", b"x", "é ü é".encode(), b"a" * 50, b"a a a b"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    found, model = quality.features(data, offsets), rng.normal(size=(1 << quality.BITS) + 1)
    for k, text in enumerate(texts):
        bucket, share = quality.bag_of(text)
        own = np.concatenate([b[r == k] for b, r in zip(found.bucket, found.row)])
        assert math.isclose(float(share @ model[bucket]) if len(own) else 0, model[own].mean() if len(own) else 0, rel_tol=1e-4, abs_tol=1e-6)


@pytest.mark.parametrize("name, label", [("op2_quality_classifier", "quality"), ("op7_toxicity", "toxic")])
def test_classifier_queries_on_held_out_rows(spark, small, name, label):
    folder = small.replace("sf0.001", "sf0.01")
    rows = QUERIES[name](spark, folder)
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    found = rows.join(marks, "doc_id").collect()
    assert rows.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    limit = {"quality": 0.5, "toxic": 0.7}[label]
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert r["predicted"] == int(r["score"] >= limit)
    unseen = [r for r in found if r["held_out"]]
    assert sum(r["predicted"] == r[label] for r in unseen) >= 0.9 * len(unseen)


def test_labels_of_held_out_rows_do_not_matter(spark, small, tmp_path):
    folder = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    other = labels.withColumn("quality", F.when(held_out("doc_id", 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    train = ~held_out("doc_id", 3, 1)
    assert quality.fit(docs, labels, "quality", train, rows=30) == quality.fit(docs, other, "quality", train, rows=30)


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    def text(k):
        words = [f"word{j}" for j in rng.integers(0, 60, 30)]
        if k % 2:
            for j in rng.integers(0, 30, 4):
                words[j] = rng.choice(["grobling", "groblist", "Zzurk", "you moron"])
        return " ".join(words)
    rows = [(k, text(k), 1) for k in range(400)] + [(400, None, 1), (401, "", 1), (402, "zZurk groblers you", 1), (403, "word1 word2", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _part int")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, "toxic", F.col("doc_id") < 300)
    got = {r["doc_id"]: r["s"] for r in toxicity.score(docs, model, "s").collect()}
    assert len(got) == 404 and all(0 <= s <= 1 for s in got.values())
    unseen = [k for k in range(300, 400)]
    assert sum((got[k] >= 0.7) == (k % 2 == 1) for k in unseen) >= 95
    assert got[402] >= 0.7 and got[403] < 0.3 and got[400] == got[401] < 0.5
    assert toxicity.fit(docs, labels.filter("toxic = 0"), "toxic", every()) is None
    assert {r["s"] for r in toxicity.score(docs, None, "s").collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model, "s").count() == 0


def test_toxic_features_do_not_depend_on_the_slice():
    lexicon = toxicity.Lexicon(toxicity._codes(["bad", "worse"]), {k: toxicity._codes(["grob", "groblin"][: k == 4]) if k == 4 else np.empty(0, np.uint64) for k in toxicity.STEMS})
    second = toxicity._codes(toxicity.SECOND_PERSON)
    texts = [b"you are B4D bad grobling", b"", b"bad", b"soooo baaaad !! you", b"x" * 9, b"aaa", b"aab", "tú worse".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    together = toxicity.features(data, offsets, lexicon, second)
    for k, text in enumerate(texts):
        own = toxicity.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lexicon, second)
        assert np.allclose(together[k], own[0]), text
    names = dict(zip(toxicity.FEATURES, together[0]))
    assert math.isclose(names["word_density"], 1 / 5) and math.isclose(names["stem_density"], 1 / 5)
    assert math.isclose(names["hidden_hits"], 1 / 5) and names["near_second_person"] > 0


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(5)
    margin, labels = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60)
    at, score = toxicity.isotonic(margin, labels)
    assert (np.diff(score) >= 0).all()
    def loss(values):
        return sum((labels[margin == a] - v) @ (labels[margin == a] - v) for a, v in zip(at, values))
    best = loss(score)
    for _ in range(500):
        other = np.sort(np.clip(score + rng.normal(0, 0.1, len(score)), 0, 1))
        assert loss(other) >= best - 1e-9


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(2000, 3))
    labels = ((points[:, 0] > 0) & (points[:, 1] > 0.3)).astype(float)
    trees = toxicity.boost(points[:1500], labels[:1500])
    assert ((toxicity.margins(points[1500:], trees) > 0) == (labels[1500:] == 1)).mean() > 0.97


# language ID


def test_language_id(spark):
    rng = np.random.default_rng(7)
    letters = {"aa": "abcde", "bb": "xyzuv", "cc": "éüñßç"}
    def text(lang):
        return " ".join("".join(rng.choice(list(letters[lang]), 4)) for _ in range(12))
    rows = [(k, text(lang), lang) for k, lang in enumerate(list(letters) * 40)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !!", "bb"), (903, "日本語", None), (904, "abcde edcba", None)]
    docs = spark.createDataFrame([*rows, *odd], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.col("doc_id") % 4 > 0)
    got = {r["doc_id"]: r["language"] for r in langid.predict(docs.withColumn("language", F.lit(1)), model).collect()}
    assert all(got[k]["lang"] == lang for k, _, lang in rows) and got[904]["lang"] == "aa"
    assert all(got[k] == (None, 0.0, True) for k in (900, 901, 902))
    assert got[903]["lang"] in letters and got[903]["rejected"] and 0 <= got[903]["cosine"] < 0.2
    nothing = langid.fit(docs.limit(0), every())
    assert {r["language"]["lang"] for r in langid.predict(docs, nothing).collect()} == {None}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 50, raising=False)
    rng = np.random.default_rng(8)
    own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 30)) for _ in range(203)]
    rows = [(k * 3 + j, f"{own[k]} {own[k][j:]}", f"l{k:03d}") for k in range(203) for j in range(3 if k < 200 else 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.predict(docs, langid.fit(docs, every())).collect()
    assert len(got) == len(rows) and all(r["language"]["lang"] == r["lang"] for r in got)


def test_language_frequencies_and_copies(spark):
    texts = ["abc abd"] * 60 + [f"abc {chr(97 + k)}zz" for k in range(20)]
    docs = spark.createDataFrame([(k, t, "aa") for k, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, every(), rows=5)
    found = np.concatenate([langid.counts(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for t in texts])
    assert np.allclose(model.weights, np.log(81 / (1 + (found > 0).sum(axis=0))) + 1)
    usable = docs.repartition(4).select(F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    assert langid._sample(usable, 100).count() == 21


def test_language_counts_against_a_plain_loop():
    texts = [b"Ab 12 cd", b"", b"..", b"a", "é é".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    together = langid.counts(data, offsets)
    for k, text in enumerate(texts):
        own = langid.counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert (own[0] == together[k]).all()
    assert together[0].sum() == 4 + 4 + 3  # letters, pairs and triples of "ab cd"
    assert together[1].sum() == together[2].sum() == 0


def test_language_query_on_held_out_rows(spark, small):
    rows = QUERIES["op6_language_id"](spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text")
    found = rows.join(docs, "doc_id").collect()
    assert len(found) == docs.count()
    unseen = [r for r in found if r["held_out"]]
    assert unseen and sum(r["lang_pred"] == r["lang"] for r in unseen) >= 0.95 * len(unseen)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)


# language model


def expected_counts(texts, train):
    words = {k: (t or "").encode().lower().split() + [b""] for k, t in texts.items()}
    count = collections.Counter(w for k, own in words.items() if train(k) for w in own)
    return words, count


def check_scores(rows, texts, train):
    words, count = expected_counts(texts, train)
    total, types = sum(count.values()), len(count)
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        own = words[r["doc_id"]]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(count[w] > 0 for w in own), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(maxent, "BLOCK_BYTES", 400)
    texts = {k: " ".join(f"W{j % 7}" for j in range(k % 9)) for k in range(60)}
    texts |= {100: None, 101: "", 102: "\t\n", 103: "never seen words", 104: "long " * 500, 105: "naïve Été 東京"}
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()], "doc_id bigint, text string, train int, words string")
    rows = maxent.score_texts(docs.repartition(3), (F.col("doc_id") % 2 == 0)).collect()
    check_scores(rows, texts, lambda k: k % 2 == 0)
    assert maxent.score_texts(docs.limit(0), every()).count() == 0
    untaught = maxent.score_texts(docs, F.lit(False)).collect()
    assert {r["train_tokens"] for r in untaught} == {0} and len(untaught) == len(texts)


def test_language_model_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op1_lm_scoring"](spark, small).collect()
    check_scores(rows, texts, lambda k: zlib.crc32(str(k).encode()) % 5 != 1)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_rare_words_tell_the_next(spark):
    rng = np.random.default_rng(10)
    # sixty rare words, each followed by a word of its own out of two; frequent ones around them
    after = {f"r{k}": ("left", "right")[int(rng.integers(2))] for k in range(60)}
    def text(own):
        return " ".join(" ".join(["a"] * 12 + [w, after[w]]) for w in own)
    train = [text(rng.permutation(list(after))[:20]) for _ in range(600)]
    words = [*after][:40]
    right, wrong = ([f"{w} {after[w] if k else {'left': 'right', 'right': 'left'}[after[w]]}" for w in words] for k in (1, 0))
    rows = [(k, t) for k, t in enumerate([*right, *wrong, *train])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    score = {r["doc_id"]: r["score"] for r in maxent.score_texts(docs, F.col("doc_id") >= 80).collect()}
    assert sum(score[k] > score[40 + k] for k in range(40)) >= 36


def test_weights_grow_with_the_vocabulary():
    classes = maxent.Classes(np.zeros(15, int), np.zeros((16, 15), np.int64), np.ones(256), np.ones(256), 1 << 30, 1 << 26)
    weights = maxent.start_weights(classes)
    assert len(weights.band) == len(weights.group) == maxent.KINDS * (1 << 16)
    rows = maxent.context_rows(np.arange(1 << 16, dtype=np.uint64), np.arange(1 << 16) % 256, np.array([0]), 1 << 16)
    assert len(np.unique(rows[0])) > 0.6 * (1 << 16)


def test_words_that_share_four_bytes_are_told_apart():
    data = np.frombuffer(b"interest internal inte", np.uint8)
    heads = maxent.heads_of(data, np.array([0, 9, 18]), np.array([8, 17, 22]))
    assert heads[2] < heads[0] < heads[1] and maxent.BATCH == 8192


def test_packed_tokens_come_back_and_take_half_the_room():
    tokens = np.minimum(np.random.default_rng(5).zipf(1.3, 50_000), 1 << 20).astype(np.uint32)
    data = maxent.packed(tokens)
    assert len(data) < 2 * len(tokens)
    assert (maxent.unpacked(pa.py_buffer(data), len(tokens)) == tokens).all()


def test_model_probabilities_add_up_to_one():
    rng = np.random.default_rng(8)
    n = maxent.BANDS * maxent.GROUPS
    classes = maxent.Classes(
        np.zeros(maxent.BANDS - 1, int), np.zeros((maxent.BANDS, maxent.GROUPS - 1), np.int64),
        rng.integers(1, 50, n).astype(float), np.ones(n), 100, n,
    )
    weights = maxent.start_weights(classes)
    weights = weights._replace(
        band=rng.normal(size=weights.band.shape).astype(np.float32), group=rng.normal(size=weights.group.shape).astype(np.float32)
    )
    rows = maxent.context_rows(np.arange(6, dtype=np.uint64), np.arange(6), np.array([0, 2]))
    total = 0.0
    for band in range(maxent.BANDS):
        of_band, of_group = maxent.probabilities(rows, np.full(6, band), weights)
        total = total + of_band[:, band] * of_group.sum(axis=1)
    assert np.allclose(total, 1, atol=1e-5)


def test_gradient_steps_follow_the_slope_of_the_loss():
    rng = np.random.default_rng(9)
    n = 400
    leaf = rng.integers(0, 256, n)
    leaf[1::2] = (leaf[0::2] + 17) % 256  # the word before tells the next
    classes = maxent.Classes(np.zeros(15, int), np.zeros((16, 15), np.int64), np.ones(256), np.ones(256), 256, 256)
    weights = maxent.start_weights(classes)
    rows = maxent.context_rows(leaf.astype(np.uint64), leaf, np.arange(0, n, 2))
    def loss():
        of_band, of_group = maxent.probabilities(rows, leaf // 16, weights)
        every = np.arange(n)
        return -(np.log(of_band[every, leaf // 16]) + np.log(of_group[every, leaf % 16])).mean()
    before, spent = loss(), [np.zeros(maxent.KINDS * maxent.ROWS, np.float32) for _ in range(2)]
    for _ in range(20):
        maxent.descend(rows, leaf, weights, spent)
    assert loss() < 0.8 * before


# vectors


def vector_links(rows, threshold):
    usable = [(k, np.array(v, float)) for k, v in rows if k is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)]
    near = collections.defaultdict(set)
    for i, (_, a) in enumerate(usable):
        for j, (_, b) in enumerate(usable[:i]):
            if len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                near[i].add(j)
                near[j].add(i)
    out = []
    for i, (k, _) in enumerate(usable):
        seen, front = {i}, [i]
        while front:
            front = [x for y in front for x in near[y] if x not in seen and not seen.add(x)]
        out.append((k, len(near[i]), min(usable[x][0] for x in seen)))
    return out


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(10)
    centre = rng.normal(size=(6, 16))
    rows = [(k, [float(np.float32(x)) for x in centre[k % 6] + rng.normal(size=16) * 0.12]) for k in range(240)]
    rows += [(300 + k, rows[k][1]) for k in range(5)] + [(310, [2 * x for x in rows[0][1]]), (311, [-0.0] + [1.0] * 15), (312, [0.0] + [1.0] * 15)]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None] + [0.0] * 14), (404, [float("nan")] * 16),
           (405, [float("inf")] + [0.0] * 15), (406, [1.0] * 3), (407, [1.0] * 3), (408, [1e-30] * 16), (409, [1e30] * 16), (None, [1.0] * 16)]
    table = spark.createDataFrame([(k, v, 1) for k, v in rows + odd], "vec_id bigint, embedding array<float>, n_links int")
    wanted = vector_links([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows + odd], 0.95)
    wanted = {k: (n, c) for k, n, c in wanted}
    for block in (near_vectors.BLOCK, 20):
        monkeypatch.setattr(near_vectors, "BLOCK", block)
        got = near_vectors.near_vectors(table).collect()
        assert len(got) == len(rows) + len(odd)
        for r in got:
            k = r["vec_id"]
            assert (r["n_links"], r["component_id"]) == wanted.get(k, (0, k)), r
            assert r["kept"] == (k is None or k == r["component_id"])
    assert near_vectors.near_vectors(table.limit(0)).count() == 0


def test_vectors_whose_ids_repeat(spark):
    one, near, other, far = [1.0, 0.0, 0.0], [1.0, 0.1, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, one), (1, other), (2, other), (3, far), (4, near), (1, one), (5, None), (5, far), (None, one)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = near_vectors.near_vectors(table).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=key) == [
        (1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 2, 1, False),
        (5, 0, 5, True), (5, 1, 3, False), (None, 0, None, True),
    ]


def test_vector_query(spark, small):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    wanted = {k: (n, c) for k, n, c in vector_links(rows, 0.95)}
    got = QUERIES["op5_embedding_near_dedup"](spark, small).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {**{k: (0, k) for k, _ in rows}, **wanted}


def test_tables_reach_the_wanted_recall():
    for n in (100, 10_000, 10_000_000, 10_000_000_000):
        planes, tables = near_vectors.shape(n, 0.95)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** planes) ** tables <= near_vectors.MISS
