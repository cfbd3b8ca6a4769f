"""Codes of words: no pattern of letters makes them meet, and where they meet the bytes decide."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerospark.llm import decontam, maxent, minhash, packing, token_files, word_ids
from aerospark.llm.base import PLAIN, SPACED, chunks, codes_of, same_bytes, words_of

TURN = str.maketrans("ab", "ba")
ONE = "a"
while len(ONE) < 1024:
    ONE += ONE.translate(TURN)
#: Two words whose polynomials of 64 bits are equal for every base.
OTHER = ONE.translate(TURN)
ENCODERS = [
    (packing.Encoder, public_tokenizers.path("byte_bpe_50k.json")),
    (token_files.Encoder, public_tokenizers.path("word_bpe_49k.json")),
]


def sliced(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def test_codes_follow_the_bytes():
    words = ["a", "a\x00", "b", "12345678", "123456789", "1234567800000000", ONE, OTHER, ONE + "a", "ü" * 9, "x" * 100_000]
    data, offsets = sliced(words + words[::-1])
    code = codes_of(chunks(data), offsets[:-1], offsets[1:])
    assert (code[: len(words)] == code[len(words):][::-1]).all() and len(set(code.tolist())) == len(words)
    short = words_of(data, offsets, SPACED, (3,)).prefix[3]
    assert [short[k] == short[j] for k, j in ((3, 4), (0, 1), (6, 8), (6, 7))] == [True, False, True, False]
    a, b = offsets[:-1], offsets[1:]
    eight = chunks(data)
    n = len(words)
    assert same_bytes(eight, a, b, eight, a[::-1], b[::-1]).all()
    assert not same_bytes(eight, a[:n], b[:n], eight, np.roll(a[:n], 1), np.roll(b[:n], 1)).any()


@pytest.mark.parametrize("kind, path", ENCODERS)
@pytest.mark.parametrize("collide", [False, True])
def test_ids_do_not_hang_on_codes(kind, path, collide, monkeypatch):
    if collide:
        monkeypatch.setattr(word_ids, "codes_of", lambda eight, a, b: (b - a).astype(np.uint64) % np.uint64(3))
        monkeypatch.setattr(
            token_files, "words_of", lambda *a: (w := words_of(*a))._replace(code=((w.stop - w.start) % 3).astype(np.uint64))
        )
    library = Tokenizer.from_file(path)
    encoder = kind(library.to_str())
    batches = [
        [f"{ONE} {OTHER} {ONE}", "", "some words more words", OTHER],
        ["words some other thing " + OTHER, "don't Stop, it's 12 o'clock\n\nüber", ONE],
    ]
    for texts in batches * 2:
        got = encoder.encode(*sliced(texts))
        want = library.encode_batch(texts, add_special_tokens=False)
        width = getattr(encoder, "kind", np.dtype("<u4"))
        assert [np.frombuffer(g, width).tolist() for g in got] == [w.ids for w in want]


def test_remembered_words_are_forgotten_in_time():
    pool = word_ids.WordIds(4)
    learnt = []

    def learn(words):
        learnt.extend(words)
        return [np.array([len(w)], "<u4").tobytes() for w in words]

    for text in ["a bb ccc dddd eeeee ffffff", "a bb", "a bb"]:
        data, offsets = sliced([text])
        words = words_of(data, offsets, SPACED)
        ids, count = pool.ids_of(data, words.start, words.stop, learn)
        assert ids.tolist() == [len(w) for w in text.split()] and (count == 1).all()
    assert learnt.count(b"a") == 2


def test_known_words_items_and_shingles_tell_such_words_apart(spark):
    rows = [(2, f"{ONE} plain words"), (4, f"{OTHER} plain words"), (9, f"{ONE} plain words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    scored = {r["doc_id"]: r["n_known"] for r in maxent.score_texts(docs, F.col("doc_id") != 4).collect()}
    assert scored[2] == scored[4] + 1
    benchmark = spark.createDataFrame([("i", ONE)], "item_id string, text string")
    marked = decontam.mark_contamination(docs, benchmark).collect()
    assert {r["doc_id"]: list(r["hits"]["items"]) for r in marked} == {2: ["i"], 4: [], 9: ["i"]}
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, length=1, threshold=0.85).collect()}
    assert near == {2: 2, 4: 4, 9: 2}
    assert set(words_of(*sliced([ONE]), PLAIN).code.tolist()) != set(words_of(*sliced([OTHER]), PLAIN).code.tolist())


def test_words_put_behind_one_another_keep_their_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(open(path, encoding="utf-8").read())
    parts = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "it's", "'s", "''ll", "é", "ÿz", "12", "a1!", "<|endoftext|", "Ġ", "Ċ", "-- "]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(parts, size)) for size in rng.integers(0, 40, 1500)] + ["", " ", "\n", "a", " a", "\na "]
    for lot in (texts[:700], texts[700:]):
        got = encoder.encode(*sliced(lot))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
            e.ids for e in plain.encode_batch(lot, add_special_tokens=False)
        ]


def test_words_that_hold_a_special_token_together_are_encoded_alone():
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.add_tokens(["b c"])
    encoder = packing.Encoder(plain.to_str())
    texts = ["a b", " c d", "x b", "b c", "\nb e"]
    got = encoder.encode(*sliced(texts))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [
        e.ids for e in plain.encode_batch(texts, add_special_tokens=False)
    ]
