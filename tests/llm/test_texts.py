"""Line dedup, decontamination, packing and MinHash against brute force, with odd rows."""

import collections
import hashlib
import json
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from aerospark.llm import decontam, line_dedup, minhash, packing
from aerospark.llm.base import PLAIN, SPACED, words_of
from aerospark.llm.queries import ORACLES, QUERIES
from tools.compare import connect, differences

ODD = [
    None, "", " \n\t ", "one", "One two", "one  two\x0bthree", "a b c d e f g h", "A B C D E F G H",
    "a b c d e f g h", "naïve Straße 東京 東京 東京", "x " * 3000, "tail\r\n\r\n", "\x00 nul", "🙂 🙂 🙂",
]
SCHEMA = "doc_id bigint, text string, source string, component_id string, _lines int, hits string, n string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None if k % 3 else f"s{k % 2}", "c", 1, "h", "n") for k, t in enumerate(ODD)]
    rows += [(3, "one", "s1", "c", 1, "h", "n"), (None, "a b c d e f g h", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("inside, cut", [(SPACED, spaced), (PLAIN, plain)])
def test_words_of_rows_side_by_side(inside, cut):
    texts = [t or "" for t in ODD]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    found = words_of(np.frombuffer(data, np.uint8), offsets, inside)
    got = collections.defaultdict(list)
    for a, b, row in zip(found.start, found.stop, found.row):
        got[int(row)].append(data[a:b].lower().decode())
    assert [got[k] for k in range(len(texts))] == [cut(t) for t in texts]
    by_word = collections.defaultdict(set)
    for a, b, code in zip(found.start, found.stop, found.code):
        by_word[data[a:b].lower()].add(int(code))
    assert all(len(c) == 1 for c in by_word.values())
    assert len({min(c) for c in by_word.values()}) == len(by_word)


# line dedup


def dropped(rows, ratio, least):
    total, seen = collections.Counter(), collections.defaultdict(int)
    for host, text in rows:
        total[host or ""] += 1
        for line in {x.strip(" \t\r") for x in (text or "").split("\n")} - {""}:
            seen[host or "", line] += 1
    out = []
    for host, text in rows:
        if text is None:
            out.append(None)
            continue
        kept = []
        for line in text.split("\n"):
            n = seen.get((host or "", line.strip(" \t\r")), 0)
            if not (n >= least and n / total[host or ""] > ratio):
                kept.append(line)
        out.append("\n".join(kept))
    return out


def test_line_dedup(spark):
    rows = [("a", f"head\n body {k} \n\n foot\r\nx"[: 40 - k % 3]) for k in range(20)]
    rows += [("b", "head\nonly here"), (None, "head"), (None, None), ("a", ""), ("a", "head\nhead"), ("a", "head\n foot")]
    docs = spark.createDataFrame([(h, t, 1, 2) for h, t in rows], "source string, text string, _site int, _here int")
    got = line_dedup.drop_boilerplate(docs.coalesce(1), ratio=0.3, min_pages=2).collect()
    assert [r["text"] for r in got] == dropped(rows, 0.3, 2)
    assert got[0]["_site"] == 1 and len(got[0]) == 4
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0


def test_line_dedup_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(f"h{k % 3}", f"menu {k % 3}\npage {k}") for k in range(60)]
    docs = spark.createDataFrame(rows, "source string, text string")
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 1)
    got = line_dedup.drop_boilerplate(docs, counts=True).collect()
    assert sorted(r["text"] for r in got) == sorted(f"page {k}" for k in range(60))
    assert {(r["n_lines"], r["n_dropped"]) for r in got} == {(2, 1)}


# decontamination


def contamination(text, items):
    windows = collections.defaultdict(set)
    for key, item in items:
        words = plain(item)
        n = min(13, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[k: k + n])].add("null" if key is None else str(key))
    words, hit, ids = plain(text), set(), set()
    for n in {len(w) for w in windows}:
        for k in range(len(words) - n + 1):
            own = windows.get(tuple(words[k: k + n]))
            if own:
                ids |= own
                hit.update(range(k, k + n))
    return len(words), len(hit), sorted(ids)


ITEMS = [
    (1, " ".join(f"w{k}" for k in range(30))), (2, "a b c"), (10, "A, b! c?"), (3, ""), (4, None), (5, "one"),
    (None, "东京 x y z"), (6, "the " * 20), (7, " ".join(f"w{k}" for k in range(13))), (7, "p q"),
]


def test_decontamination(spark):
    texts = [t for t in ODD] + [
        "w" + " w".join(str(k) for k in range(30)), "pre " + ITEMS[0][1] + " post", " ".join(f"w{k}" for k in range(12)),
        "the " * 40, "x a b c x a b c", "W3 " + " ".join(f"w{k}" for k in range(5, 25)) + " p q", "the " * 12,
    ]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id int, text string, hits int")
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    for bound in (decontam.BLOCK_BYTES, 60):
        before, decontam.BLOCK_BYTES = decontam.BLOCK_BYTES, bound
        marked = decontam.mark_contamination(docs, bench, out="found")
        decontam.BLOCK_BYTES = before
        rows = marked.select("doc_id", "found", "hits", decontam.hit_words("found").alias("n")).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert (r["found"]["n_words"], r["n"], r["found"]["items"]) == contamination(texts[r["doc_id"]], ITEMS), r
    kept = {r["doc_id"] for r in decontam.drop_contaminated(docs, bench).collect()}
    for k, text in enumerate(texts):
        n, hit, _ = contamination(text, ITEMS)
        assert (k in kept) == (not (hit and 20 * hit >= n))
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontam.drop_contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_query(spark, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op4_benchmark_decontamination"](spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, ids = contamination(texts[r["doc_id"]], items)
        digest = hashlib.sha256(",".join(ids).encode()).hexdigest()
        assert tuple(r)[1:] == (n, hit, len(ids), digest, hit > 0 and 20 * hit >= n)


# packing


def whole_documents(pieces, texts, window):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = collections.Counter(
        (key, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for key, t in texts
    )
    ends, padding, parts = collections.defaultdict(list), 0, collections.defaultdict(dict)
    for r in pieces:
        ids = struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])
        ends[r["sequence_id"]].append((r["offset"], len(ids)))
        parts[r["doc_id"], r["doc_tokens"]].setdefault(r["start"], []).append(ids)
    for own in ends.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return wanted, parts, padding


def test_packing(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    pieces = packing.pack(odd.coalesce(1), path, window=64).collect()
    wanted, parts, padding = whole_documents(pieces, texts, 64)
    assert padding < 64
    for (key, ids), copies in wanted.items():
        own, at = parts[key, len(ids)], 0
        while at < len(ids):
            match = [p for p in own[at] if p == ids[at: at + len(p)]]
            assert match
            at += len(match[0])
    assert sum(len(p) for own in parts.values() for v in own.values() for p in v) == sum(
        len(ids) * n for (_, ids), n in wanted.items()
    )
    assert packing.pack(odd.limit(0), path).count() == 0


def test_packing_query(spark, small):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for k, t in texts.items()}
    seen = collections.defaultdict(list)
    for r in QUERIES["op9_packing"](spark, small).collect():
        own = ids[r["doc_id"]][r["start"]: r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own)) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]].append((r["start"], r["length"]))
    for key, own in seen.items():
        assert sum(n for _, n in own) == len(ids[key]) and [s for s, _ in sorted(own)] == list(
            np.cumsum([0] + [n for _, n in sorted(own)])[:-1]
        )
    assert set(seen) == set(texts)


def test_special_tokens_and_rare_characters_go_to_the_tokenizer_whole():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    rng = np.random.default_rng(4)
    mixed = ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "b'", "s", "1", "é", "\xa0", "!?", "'ll", "\r\n"], 9)) for _ in range(900)]
    texts = [*mixed, "a <|endoftext|> b", "it's  \n\n we'll  go on", "東京 x", "", "don't  '' 12ab!? ", "ǅungla ªº½"]
    wanted = [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(t) for t in raw])
    for _ in range(2):  # seen the second time
        found = encoder.encode(data, offsets)
        assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in found] == wanted


def test_best_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    for _ in range(300):
        window = int(rng.integers(2, 12))
        levels = rng.integers(0, 4, window + 1)
        levels[0] = levels[window] = 0
        size = int(rng.integers(1, window + 1))

        def after(level):
            new = levels.copy()
            if level:
                new[level] -= 1
            if level + size < window:
                new[level + size] += 1
            return int((new**2).sum())

        options = [h for h in range(window - size + 1) if h == 0 or levels[h]]
        best = min(after(h) for h in options)
        assert packing.best_level(levels, size) == max(h for h in options if after(h) == best)


# near-duplicates


def components(sets, percent):
    """Least id reachable by links between sets given as (id, set); equal ids hang together."""
    root = {k: k for k, _ in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in root}


def shingle_set(text, length):
    words = spaced(text)
    if len(words) < length:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k: k + length]) for k in range(len(words) - length + 1))


def near_copies(rng, n, length, edits):
    base = [f"w{k}" for k in rng.integers(0, 50, length)]
    out = []
    for _ in range(n):
        words = list(base)
        for k in rng.integers(0, length, rng.integers(0, edits)):
            words[k] = f"v{rng.integers(0, 1000)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates(spark, odd):
    rng = np.random.default_rng(1)
    texts = [t for t in ODD] + near_copies(rng, 30, 60, 4) + near_copies(rng, 8, 25, 3) + ["p q r s"] * 3
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "p q r s", 1, "x"), (None, None, 1, "x")],
                                 "doc_id bigint, text string, kept int, codes string")
    sets = [(k, shingle_set(t, 3)) for k, t in enumerate(texts)]
    wanted = components(sets, 85)
    for paired in (minhash.PAIRED, 2):  # also with all buckets as families
        before, minhash.PAIRED, minhash.BLOCK = minhash.PAIRED, paired, 16
        got = minhash.near_duplicates(docs, length=3, threshold=0.85).collect()
        minhash.PAIRED, minhash.BLOCK = before, 256
        assert len(got) == len(texts) + 2
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
                continue
            assert r["component_id"] == wanted[r["doc_id"]], r
            assert r["n_shingles"] == len(sets[r["doc_id"]][1]) and r["kept"] == (r["doc_id"] == r["component_id"])
    kept = minhash.keep_one_of_each(docs, length=3, threshold=0.85).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(k for k, c in wanted.items() if k == c)
    assert len(kept[0]) == 4
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_hang_together(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "u v w x y z"), (7, "u v w x y z"), (5, "a b c d e f"), (9, "")],
                                 "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs, length=3).collect())
    assert got == [(5, 5), (5, 5), (5, 5), (7, 5), (9, 9)]
    kept = minhash.keep_one_of_each(docs, length=3).collect()
    assert sorted(r["doc_id"] for r in kept) == [5, 5, 5, 9]


@pytest.mark.parametrize("paired", [minhash.PAIRED, 1])
def test_one_row_a_row_where_ids_repeat(spark, paired, monkeypatch):
    """Two classes may have one least id; the links of both count, each checked on its own set."""
    monkeypatch.setattr(minhash, "PAIRED", paired)
    a, b, c = ("a b c d e f g h i j k l m n o p q r s t", "u v w x y z aa bb cc dd ee ff gg hh ii jj kk ll mm nn", "lone words only here")
    rows = [(1, a), (1, b), (2, b), (3, c), (4, a + " u"), (5, b + " a"), (1, a), (6, ""), (6, c + " too"), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = minhash.near_duplicates(docs, length=3, threshold=0.85).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["component_id"], r["n_shingles"], r["kept"]) for r in got), key=key) == [
        (1, 1, 18, True), (1, 1, 18, True), (1, 1, 18, True), (2, 1, 18, False), (3, 3, 2, True), (4, 1, 19, False),
        (5, 1, 19, False), (6, 6, 0, True), (6, 6, 3, True), (None, None, 18, True),
    ]


def test_near_duplicates_query(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    sets = [(k, shingle_set(t, 3)) for k, t in sorted(texts.items())]
    wanted = components(sets, 85)
    got = QUERIES["op10_minhash_near_dedup"](spark, small).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(wanted.items())


def test_signature_is_the_minimum_over_shifts():
    codes = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 40).astype(np.uint64))
    order = np.random.default_rng(5).permutation(1 << minhash.BITS)
    place = [(int(c) * 0xD6E8FEB86659FD93 % (1 << 64)) >> (64 - minhash.BITS) for c in codes]
    wanted = [min(int(order[(p + k) % len(order)]) for p in place) for k in range(minhash.COORDINATES)]
    assert minhash.signature(codes).tolist() == wanted


def test_links_of_blocks():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(5, 35))) for _ in range(30)]
    got = minhash.links_of_blocks(sets[:17], sets[17:], 50, width=7)
    for i, a in enumerate(sets[:17]):
        for j, b in enumerate(sets[17:]):
            a_, b_ = set(a.tolist()), set(b.tolist())
            assert got[i, j] == (100 * len(a_ & b_) >= 50 * len(a_ | b_))


def test_json_of_the_tokenizer_is_what_the_pattern_expects():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        model = json.load(file)
    assert model["normalizer"] is None and model["pre_tokenizer"]["type"] == "ByteLevel"
    assert packing.PIECES.pattern == public_tokenizers.PATTERN


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_sql_give_the_same_rows(spark, small, name):
    assert differences(QUERIES[name](spark, small), connect(small).sql(ORACLES[name])) == []
