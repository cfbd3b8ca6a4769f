"""Token files: ids against the library, marks in crafted texts, random access, checksums, odd rows."""

import glob
import io
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerospark.llm import token_files
from aerospark.llm.queries import QUERIES
from aerospark.scale import work_path

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " \n\t ", "one", "One  TWO\x0bthree\x0c", "don't we'll 's 1234 5-6", "naïve Straße ΣΑΣ 東京 東京",
    "á éx ́z", "x\x1cy\x85z\xa0w　v", "<|endoftext|> mid <|startoftext|>", "🙂🙂 🙂", "\x00 nul",
    "word " * 70_000, "y" * 200_000, "İstanbul ﬁne", "a=\u0338b —,— ²x½ µm ǅ <|endof text|>", "''s're 'S it'S O'Reilly'll",
]


def expected(rows, model, end):
    """``doc_id -> list of (start, ids)`` by the library on whole texts."""
    library = Tokenizer.from_file(model)
    out, at = [], 0
    for key, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((key, at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    return out


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k * 3, t, "x", 1, b"v") for k, t in enumerate(ODD)]
    rows += [(None, "null id", None, None, None), (3, "one", "y", 2, b""), (3, "one", "y", 2, b""), (-5, "minus", "", 0, b"")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, hash string, place int, value binary")


@pytest.mark.parametrize("model", [WORDS, BYTES])
def test_files_hold_what_the_library_gives(spark, odd, model):
    path = work_path(spark, "tokens")
    token_files.write_tokens(odd, path, model, 2, frame_ids=50)
    got = [tuple(r) for r in token_files.read_tokens(spark, path).collect()]
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    # rows that share an id lie in the order of a hash
    hashed = {t: h for t, h in odd.select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    key = lambda r: r[1]
    assert [(a, b, bytes(c)) for a, b, c in sorted(got, key=key)] == expected(rows, model, 2)


def test_a_file_is_a_zstandard_stream_with_a_public_seek_table(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"))
    path = work_path(spark, "tokens")
    token_files.write_tokens(docs, path, WORDS, 2, frame_ids=300)
    name, = glob.glob(f"{path}/part-*")
    raw = open(name, "rb").read()
    reader = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    ids = np.frombuffer(reader.read(), "<u2")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ids.astype("<u4").tobytes() == b"".join(x[2] for x in expected(rows, WORDS, 2))
    footer = raw[-17:-8]
    n, flags, magic = struct.unpack("<IBI", footer)
    assert (flags, magic) == (0x80, 0x8F92EAB1) and n > 10
    table = np.frombuffer(raw[-17 - 12 * n: -17], "<u4").reshape(-1, 3)
    at = 0
    for packed, size, check in table.tolist():
        data = zstandard.ZstdDecompressor().stream_reader(raw[at: at + packed], read_across_frames=True).read()
        assert len(data) == size
        at += packed
    assert raw.count(token_files.MARK) == n + 1


def test_requested_documents_only(spark, monkeypatch):
    docs = spark.range(5000).select((F.col("id") * 2).alias("doc_id"), F.concat(F.lit("w "), F.col("id")).alias("text"))
    path = work_path(spark, "tokens")
    token_files.write_tokens(docs, path, WORDS, 2, frame_ids=200, file_bytes=8000)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    want = {key: (at, ids) for key, at, ids in expected(rows, WORDS, 2)}
    asked = [0, 2, 4000, 4001, 9998, 10_000]
    got = {r["doc_id"]: (r["start"], bytes(r["ids"])) for r in token_files.read_tokens(spark, path, asked).collect()}
    assert got == {k: want[k] for k in asked if k in want}
    assert token_files.read_tokens(spark, path, []).count() == 0
    assert token_files.read_tokens(spark, path, [-7]).count() == 0
    names = sorted(glob.glob(f"{path}/part-*"))
    assert len(names) > 3
    opened = [token_files.TokenFile(open(n, "rb")) for n in names]
    assert sum(f.total for f in opened) == sum(len(ids) // 4 for _, ids in want.values())
    decompressed = []
    real = token_files.documents_of
    monkeypatch.setattr(token_files, "documents_of", lambda row, w: decompressed.append(1) or real(row, w))
    found, before = {}, 0
    for f in sorted(opened, key=lambda f: f.part):
        found.update({k: (before + at, ids) for k, at, ids in f.documents(asked)})
        before += f.total
    assert found == {k: want[k] for k in asked if k in want}
    assert len(decompressed) <= 4 < sum(len(f.entries) for f in opened)


def test_the_mark_never_occurs_within_a_row():
    mark = token_files.MARK
    writer = token_files.Writer(0, np.dtype("<u2"), 8)
    crafted = np.frombuffer(mark, "<u2").astype("<u2").tobytes()
    docs = [(0x184D2A50, crafted), (5, crafted * 3), (None, crafted[:2] + crafted), (0x184D2A50 << 32, b"\x00\x00")]
    rows = [row for key, ids in docs for row in writer.add(key, ids)] + list(writer.close())
    assert not any(mark in row for row in rows)
    stream = io.BytesIO(b"".join(row + mark for row in rows))
    back = []
    for row in rows[:-1]:
        back += [(key, ids) for key, _, ids in token_files.documents_of(row)[2]]
    wide = [(key, np.frombuffer(ids, "<u2").astype("<u4").tobytes()) for key, ids in docs]
    assert back == wide
    got = [(k, i) for k, _, i in token_files.TokenFile(stream).documents([k for k, _ in docs])]
    assert sorted(got, key=str) == sorted(wide, key=str)


def test_a_damaged_frame_is_an_error():
    writer = token_files.Writer(0, np.dtype("<u2"), 4)
    rows = list(writer.add(1, b"\x01\x00" * 9)) + list(writer.close())
    at = rows[0].index(struct.pack("<I", 0xFD2FB528))
    for place in (at + 9, len(rows[0]) - 1):
        bad = bytearray(rows[0])
        bad[place] ^= 1
        with pytest.raises((ValueError, zstandard.ZstdError)):
            token_files.documents_of(bytes(bad))
    with pytest.raises(ValueError):
        token_files.TokenFile(io.BytesIO(b"\x00" * 64))


def test_a_file_without_its_directory_is_an_error(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    path = work_path(spark, "tokens")
    token_files.write_tokens(docs, path, WORDS, 2, frame_ids=10)
    lost = work_path(spark, "tokens")
    mark = token_files.MARK.decode("ascii")
    rows = spark.read.option("lineSep", mark).text(path).coalesce(1)
    rows.filter(F.substring(F.col("value").cast("binary"), 1, 1) != b"\x5d").write.option("lineSep", mark).text(lost)
    with pytest.raises(Exception, match="no directory"):
        token_files.read_tokens(spark, lost).collect()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    path = work_path(spark, "tokens")
    token_files.write_tokens(docs, path, WORDS, 2)
    assert token_files.read_tokens(spark, path).count() == 0


def test_query_against_the_library(spark, small):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op11_token_files"](spark, small).collect()}
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    want = expected([(r["doc_id"], r["text"]) for r in rows], WORDS, 2)
    assert got == {k: (at, len(ids) // 4, zlib.crc32(ids)) for k, at, ids in want}
