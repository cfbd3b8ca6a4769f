"""Token ids in files of independent zstandard frames with a trailing seek table.

A file is a run of rows, written and read by Spark's text source, so any store is reached
and a lost task leaves nothing behind.  Every row ends with ``MARK``, an empty skippable
frame, which the text source takes for its line end:

* a frame row: a skippable frame (``FRAME``) that tells the documents, then one zstandard
  frame with the ids of whole documents, which can be decompressed alone;
* the last row: a skippable frame (``DIRECTORY``) with the ranges of documents of all frames,
  then the seek table (``SEEK``) in the public layout: compressed size, size and checksum
  (low half of xxh64) of each frame, number of frames, a flag byte and a magic number.

So a file is a valid zstandard stream.  ``MARK`` must not occur within a row, not even in a
crafted text: bytes are XORed with a mask, 0 unless the row would hold it.  Ids take two bytes
where the vocabulary allows it.  Documents lie in ascending order of their ids, nulls first,
in files that are ranges of that order.
"""

from __future__ import annotations

import gc
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from tokenizers import Tokenizer

from aerospark.llm.base import LOWER, SPACED, batch, cut, released, slices, words_of
from aerospark.llm.word_ids import WordIds, per_row
from aerospark.scale import broadcast_if_small

#: The magic numbers of skippable frames and of the public seek table.
FRAME, DIRECTORY, SEEK, SEEKABLE = 0x184D2A5C, 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1
MARK = struct.pack("<II", 0x184D2A50, 0)
_CHECKED = 0x80

#: Ids of a frame; a longer document has a frame of its own.
FRAME_IDS = 1 << 15
#: Bytes of text that go to one file at most.
FILE_BYTES = 128 << 20
#: Words whose ids a worker remembers, about 50 bytes each, and pieces of words, about 250 bytes each.
REMEMBERED_WORDS, REMEMBERED_PIECES = 1_500_000, 150_000
LEVEL = 3

#: Fixed value: how the lower-case tokenizer divides a text.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters that any version of Unicode classes alike; a word with others is not cut into pieces.
_UNUSUAL = re.compile("[^!-~\xa1-\u012f\u0131-ɏ]")
#: The printable character that stands for each byte in a byte-level vocabulary: printable bytes
#: for themselves, the others in order from 256 on.
_PRINTABLE = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
_BYTES = {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(_PRINTABLE)))}

_DOC = np.dtype([("known", "u1"), ("doc_id", "<i8"), ("ids", "<i8")])
_RANGE = np.dtype([
    ("first_known", "u1"), ("first", "<i8"), ("last_known", "u1"), ("last", "<i8"), ("docs", "<i8"), ("ids", "<i8"),
])
_FRAME_HEAD, _FILE_HEAD = struct.Struct("<BBqIq"), struct.Struct("<BBqqI")
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


class Encoder:
    """Ids of texts by the tokenizers library.

    If the tokenizer lowers case, drops white space and divides the rest by ``PIECES``, no id
    reaches across an ASCII blank, so words and their pieces are encoded alone and remembered.
    Every other tokenizer, and a text that names a special token, goes whole.
    """

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.apart = _divides(json.loads(model))
        self.words = WordIds(REMEMBERED_WORDS)
        self.pieces: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn_pieces(self, pieces: Iterable[str]) -> None:
        """Ids of words, lowered and usual, that are one piece; they reach the model byte by byte."""
        held, flat, ends, one = [], [], [0], self.tokenizer.model.tokenize
        for piece in pieces:
            held.append(piece)
            if not piece.isascii():
                piece = piece.lower().encode().decode("latin-1").translate(_BYTES)
            flat += [t.id for t in one(piece)]
            ends.append(len(flat))
        raw = np.array(flat, "<u4").tobytes()
        self.pieces.update((p, raw[4 * a: 4 * b]) for p, a, b in zip(held, ends, ends[1:]))

    def _learn(self, raw: list[bytes]) -> list[bytes]:
        """Ids of lowered words without blanks."""
        words = [w.decode("utf-8", "replace") for w in raw]
        if len(self.pieces) > REMEMBERED_PIECES:
            self.pieces.clear()
        whole, single, divided = [], [], {}
        for word in words:
            if _UNUSUAL.search(word):
                whole.append(word)
            elif word.isalpha():
                single.append(word)
            else:
                divided[word] = PIECES.findall(word)
        self._learn_pieces(set(chain(single, *divided.values())).difference(self.pieces))
        out = dict(zip(whole, self._whole(whole)))
        look = self.pieces.__getitem__
        out.update((word, b"".join(map(look, own))) for word, own in divided.items())
        return [out[w] if w in out else look(w) for w in words]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text of a slice."""
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        out: list[bytes] = [b""] * len(texts)
        odd = [k for k, t in enumerate(texts) if not self.apart or any(s in t for s in self.special)]
        for k, ids in zip(odd, self._whole([texts[k].decode("utf-8", "replace") for k in odd])):
            out[k] = np.frombuffer(ids, "<u4").astype(self.kind).tobytes()
        rest = sorted(set(range(len(texts))).difference(odd))
        if odd:
            parts = [texts[k] for k in rest]
            data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])
        words = words_of(data, offsets, SPACED)
        ids, count = self.words.ids_of(LOWER[data], words.start, words.stop, self._learn, words.code)
        for k, own in zip(rest, per_row(ids, count, words.start, offsets, self.kind)):
            out[k] = own
        return out


def _divides(model: dict) -> bool:
    """Whether a tokenizer lowers case, drops white space and divides the rest by ``PIECES``."""
    parts = lambda name, inner: [dict(x) for x in (model.get(name) or {}).get(inner, [])]
    normal, divided = parts("normalizer", "normalizers"), parts("pre_tokenizer", "pretokenizers")
    return (
        [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
        and [x["type"] for x in divided] == ["Split", "ByteLevel"]
        and divided[0]["pattern"].get("Regex") == PIECES.pattern and divided[0]["invert"]
        and not divided[1]["add_prefix_space"] and not divided[1]["use_regex"]
    )


_ENCODERS: dict[int, Encoder] = {}


def _encoder(model: str) -> Encoder:
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def _masked(data: bytes, mask: int) -> bytes:
    return (np.frombuffer(data, np.uint8) ^ np.uint8(mask)).tobytes() if mask else data


def _skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class Writer:
    """The rows of one file: ``add`` gives frame rows, ``close`` the rest and the last row."""

    def __init__(self, part: int, kind: np.dtype, frame_ids: int = FRAME_IDS):
        self.part, self.kind, self.frame_ids = part, kind, frame_ids
        self.docs: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0
        self.ranges: list[tuple] = []
        self.table = b""
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[bytes]:
        n = len(ids) // self.kind.itemsize
        if self.docs and self.size + n > self.frame_ids:
            yield self._frame()
        self.docs.append((doc_id is not None, doc_id or 0, n))
        self.held.append(ids)
        self.size += n

    def _frame(self) -> bytes:
        docs, raw = np.array(self.docs, _DOC), b"".join(self.held)
        number = len(self.ranges)
        for mask in range(256):
            data = _masked(raw, mask)
            check = xxhash.xxh64(data).intdigest() & 0xFFFFFFFF
            head = _FRAME_HEAD.pack(mask, self.kind.itemsize, number, check, self.total)
            row = _skippable(FRAME, head + _masked(docs.tobytes(), mask)) + self.packer.compress(data)
            entry = struct.pack("<III", len(row) + len(MARK), len(data), check)
            if MARK not in row and MARK not in self.table[-12:] + entry:
                break
        else:
            raise ValueError("no mask keeps the mark out of a frame")
        first, last = docs[0], docs[-1]
        self.ranges.append((
            first["known"], first["doc_id"], last["known"], last["doc_id"], len(docs), self.total,
        ))
        self.table += entry
        self.total += self.size
        self.docs, self.held, self.size = [], [], 0
        return row

    def close(self) -> Iterator[bytes]:
        if self.docs:
            yield self._frame()
        if not self.ranges:
            return
        ranges, n = np.array(self.ranges, _RANGE).tobytes(), len(self.ranges)
        for mask in range(256):
            head = _FILE_HEAD.pack(mask, self.kind.itemsize, self.part, self.total, n) + _masked(ranges, mask)
            row = _skippable(DIRECTORY, head + struct.pack("<I", len(head) + 12))
            row += _skippable(SEEK, self.table + struct.pack("<IBI", n, _CHECKED, SEEKABLE))
            if MARK not in row:
                yield row
                return
        raise ValueError("no mask keeps the mark out of a directory")


def documents_of(row: bytes, wanted: set | None = None) -> tuple[int, int, list[tuple[int | None, int, bytes]]]:
    """Frame number, ids of the file before the frame, and ``doc_id, ids before it in the frame, its ids``
    (little-endian, 32 bits).  Nothing is decompressed where no document is ``wanted``.
    """
    magic, size = struct.unpack_from("<II", row)
    if magic != FRAME:
        raise ValueError("not a frame of token ids")
    mask, width, number, check, before = _FRAME_HEAD.unpack_from(row, 8)
    docs = np.frombuffer(_masked(row[8 + _FRAME_HEAD.size: 8 + size], mask), _DOC)
    keys = [d if k else None for k, d in zip(docs["known"].tolist(), docs["doc_id"].tolist())]
    if wanted is not None and not wanted.intersection(keys):
        return number, before, []
    data = zstandard.ZstdDecompressor().decompress(row[8 + size:])
    if xxhash.xxh64(data).intdigest() & 0xFFFFFFFF != check:
        raise ValueError(f"frame {number} does not match its checksum")
    ids = np.frombuffer(_masked(data, mask), f"<u{width}").astype("<u4")
    ends = np.cumsum(docs["ids"])
    if len(ids) != (ends[-1] if len(ends) else 0):
        raise ValueError(f"frame {number} does not hold the ids of its documents")
    return number, before, [
        (key, int(end - n), ids[end - n: end].tobytes())
        for key, end, n in zip(keys, ends.tolist(), docs["ids"].tolist()) if wanted is None or key in wanted
    ]


class TokenFile:
    """Random access to one file, any seekable stream: the seek table first, then only the frames asked for."""

    def __init__(self, stream: BinaryIO):
        self.stream = stream
        footer = 9 + len(MARK)
        end = stream.seek(0, 2)
        stream.seek(end - footer)
        n, flags, magic = struct.unpack_from("<IBI", stream.read(footer))
        if magic != SEEKABLE or not flags & _CHECKED:
            raise ValueError("no seek table at the end of the file")
        table = end - footer - 12 * n
        stream.seek(table)
        self.entries = np.frombuffer(stream.read(12 * n), "<u4").reshape(-1, 3).astype(np.int64)
        self.offsets = np.cumsum(self.entries[:, 0]) - self.entries[:, 0]
        stream.seek(table - 12)
        size = struct.unpack("<I", stream.read(4))[0]
        stream.seek(table - 8 - size + 8)
        self.part, self.total, self.ranges = _directory(stream.read(size - 12))

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int | None, int, bytes]]:
        """``doc_id, ids of the file before it, ids`` of the wanted documents; other frames are not read."""
        wanted = set(wanted)
        asked = np.sort(np.array([w for w in wanted if w is not None], np.int64))
        low = np.where(self.ranges["first_known"] > 0, self.ranges["first"], np.iinfo(np.int64).min)
        high = np.where(self.ranges["last_known"] > 0, self.ranges["last"], np.iinfo(np.int64).min)
        hit = np.searchsorted(asked, high, side="right") > np.searchsorted(asked, low, side="left")
        if None in wanted:
            hit |= self.ranges["first_known"] == 0
        for k in np.flatnonzero(hit):
            self.stream.seek(int(self.offsets[k]))
            row = self.stream.read(int(self.entries[k, 0]) - len(MARK))
            _, before, found = documents_of(row, wanted)
            for key, at, ids in found:
                yield key, before + at, ids


def _directory(head: bytes) -> tuple[int, int, np.ndarray]:
    mask, _, part, total, n = _FILE_HEAD.unpack_from(head)
    return part, total, np.frombuffer(_masked(head[_FILE_HEAD.size:], mask), _RANGE, n)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end: int, *, doc_id: str = "doc_id", text: str = "text",
    frame_ids: int = FRAME_IDS, file_bytes: int = FILE_BYTES,
) -> None:
    """Write the ids of all ``docs``, each followed by ``end``, to files in folder ``path``.

    ``tokenizer`` is the path of a tokenizers file, read on the driver; special tokens are not
    added.  A null text is empty, so it is ``end`` alone.  Documents lie in ascending order of
    ``doc_id``, nulls first; rows that share an id lie in the order of a hash of their texts,
    and every row is a document of its own, repeated rows too.  A text of any length is one
    document in one frame.  An empty table gives files without rows.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # the size of one vocabulary file
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    busy = 4 * docs.sparkSession.sparkContext.defaultParallelism
    files = max(-(-size // file_bytes), min(busy, -(-size // (4 << 20))), 1)
    # rows that are all alike still have different places, so they spread over files
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("place")]
    placed = rows.withColumn("hash", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    sorted_rows = placed.repartitionByRange(int(files), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.binary())])
        encoder = _encoder(shared.value)
        last = np.array([end], encoder.kind).tobytes()
        writer = Writer(TaskContext.get().partitionId(), encoder.kind, frame_ids)
        gc.disable()  # many small objects and no cycles; ``released`` collects at the end
        for part in batches:
            for a, b, data, offsets in slices(part.column(1)):
                keys = part.column(0).slice(a, b - a).to_pylist()
                for key, ids in zip(keys, encoder.encode(data, offsets)):
                    for row in writer.add(key, ids + last):
                        yield batch(schema, [row])
        gc.enable()
        for row in writer.close():
            yield batch(schema, [row])

    framed = sorted_rows.mapInArrow(released(run), "value binary")
    framed.select(F.col("value").cast("string")).write.option("lineSep", MARK.decode("ascii")).text(path)


def _rows(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", MARK.decode("ascii")).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")
    )


def _magic(number: int):
    return F.substring("value", 1, 4) == F.lit(struct.pack("<I", number))


def file_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``file, part, ids, before, first, last``: what the directory of every file tells.

    ``before`` counts the ids of all files that come before it; ``first`` is null where the
    file begins with documents without an id.
    """
    schema = pa.schema([
        ("file", pa.string()), ("part", pa.int64()), ("ids", pa.int64()), ("first", pa.int64()), ("last", pa.int64()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for file, row in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                size = struct.unpack_from("<I", row, 4)[0]
                number, total, ranges = _directory(row[8: 8 + size - 4])
                first = int(ranges["first"][0]) if ranges["first_known"][0] else None
                last = int(ranges["last"][-1]) if ranges["last_known"][-1] else None
                yield batch(schema, [file], [number], [total], [first], [last])

    found = _rows(spark, path).filter(_magic(DIRECTORY)).mapInArrow(
        run, "file string, part bigint, ids bigint, first bigint, last bigint"
    )
    # one row a file
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def read_tokens(spark: SparkSession, path: str, wanted: Iterable[int | None] | None = None) -> DataFrame:
    """``doc_id, start, ids`` of the documents in the files of folder ``path``.

    ``start`` counts the ids of all documents before it, ``ids`` are little-endian unsigned
    32-bit numbers with the end id.  With ``wanted``, a list of ids, only the files whose range
    may hold them are opened and only the frames that hold them are decompressed.  A frame that
    does not match its checksum, or a file without its directory, ends the job with an error.
    """
    files = cut(file_ranges(spark, path))
    only = None if wanted is None else set(wanted)
    source: str | list[str] = path
    if only is not None:
        known = [w for w in only if w is not None]
        held = F.lit(None in only) & F.col("first").isNull()
        inside = F.coalesce(F.col("first") <= F.lit(max(known, default=0)), F.lit(True)) & (
            F.col("last") >= F.lit(min(known, default=0)))
        files = files.filter(held | (inside & F.lit(bool(known))))
        source = [row["file"] for row in files.select("file").toLocalIterator()]
        if not source:
            return spark.createDataFrame([], "doc_id bigint, start bigint, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for base, row in zip(part.column(0).to_pylist(), part.column(1)):
                if base is None:
                    raise ValueError("a file of token ids has no directory at its end")
                _, before, found = documents_of(row.as_py(), only)
                if found:
                    keys, at, ids = zip(*found)
                    yield batch(_READ, keys, [base + before + k for k in at], ids)

    frames = _rows(spark, source).filter(~_magic(DIRECTORY))
    placed = frames.join(broadcast_if_small(files.select("file", "before")), "file", "left").select("before", "value")
    return placed.mapInArrow(released(run), "doc_id bigint, start bigint, ids binary")
