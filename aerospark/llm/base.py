"""What the operators share: texts as bytes, words and shingles as hashed numbers, shared cuts.

A task sees its rows as Arrow batches.  The bytes of the texts lie one after the
other, so words and n-grams are found and hashed for many documents at once, in
slices of about ``SLICE`` bytes.  A slice holds whole documents; a longer
document is a slice of its own.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerospark.scale import work_path

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15
SECOND = 0xD6E8FEB86659FD93
#: Masks of the first 0 to 8 bytes of a little-endian number.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to words, for the two ways of cutting words.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x80:] = True


class Words(NamedTuple):
    """Words of a slice: byte range, row within the slice, and a 64-bit hash of the bytes."""

    start: np.ndarray
    stop: np.ndarray
    row: np.ndarray
    code: np.ndarray
    prefix: dict[int, np.ndarray]  # length in bytes -> hash of so many first bytes (of all, if shorter)


def held_out(doc_id: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text leaves ``fold``; a null id counts as the text ``null``."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)) == fold


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; null is empty."""
    whole = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, places, data = whole.buffers()
    offsets = np.frombuffer(places, np.int64)[whole.offset: whole.offset + len(whole) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first row, last row + 1, bytes, offsets`` for runs of rows of at most ``most`` bytes or one row."""
    if not len(column):
        return
    data, offsets = text_bytes(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to, data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
        at = to


def mix(code: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit codes."""
    code = (code ^ (code >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    code = (code ^ (code >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return code ^ (code >> np.uint64(33))


def chunks(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of ``data`` on as a number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _rest(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words of over 8 bytes: which they are, and the word, number and bytes of each further chunk."""
    long = np.flatnonzero(size > 8)
    n = (size[long] - 1) >> 3
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(long)), n)
    place = np.arange(len(word)) - first[word] + 1
    return long, first, word, place


def codes_of(eight: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit code of each run of bytes, from the ``chunks`` of all.

    Every chunk is spread with its place, in two ways that are summed apart and folded, so no
    pattern of letters makes codes meet; two runs with one code have to be searched for.
    """
    size = stop - start
    value = eight[start] & _LOW[np.minimum(size, 8)]
    one, two = mix(value ^ np.uint64(BASE)), mix(value * np.uint64(SECOND) + np.uint64(BASE))
    if len(size) and size.max() > 8:
        long, first, word, place = _rest(size)
        left = size[long][word] - 8 * place
        value = eight[start[long][word] + 8 * place] & _LOW[np.minimum(left, 8)]
        key = mix(place.astype(np.uint64) * np.uint64(BASE))
        one[long] += np.add.reduceat(mix(value ^ key), first)
        two[long] += np.add.reduceat(mix(value * np.uint64(SECOND) + key), first)
    return mix(one + mix(two ^ size.astype(np.uint64)))


def same_bytes(
    eight: np.ndarray, start: np.ndarray, stop: np.ndarray,
    eight_b: np.ndarray, start_b: np.ndarray, stop_b: np.ndarray,
) -> np.ndarray:
    """Which runs of bytes equal those on the other side."""
    size = stop - start
    low = _LOW[np.minimum(size, 8)]
    same = (size == stop_b - start_b) & ((eight[start] ^ eight_b[start_b]) & low == 0)
    long, _, word, place = _rest(np.where(same, size, 0))
    if len(long):
        left = size[long][word] - 8 * place
        a, b = eight[start[long][word] + 8 * place], eight_b[start_b[long][word] + 8 * place]
        differ = (a ^ b) & _LOW[np.minimum(left, 8)] != 0
        same[long[word[differ]]] = False
    return same


def words_of(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, prefixes: tuple[int, ...] = ()
) -> Words:
    """The words of a slice, A-Z lowered.  ``inside`` tells which lowered bytes belong to words."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), {k: none.astype(np.uint64) for k in prefixes})
    low = LOWER[data]
    part = inside[low]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = part.copy(), part.copy()
    begins[1:] &= ~part[:-1] | edge[1:n]
    ends[:-1] &= ~part[1:] | edge[1:n]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    eight = chunks(low)
    code = codes_of(eight, start, stop)
    short = {k: codes_of(eight, start, np.minimum(start + k, stop)) for k in prefixes}
    return Words(start, stop, np.searchsorted(offsets, start, side="right") - 1, code, short)


def runs(code: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` codes in a row."""
    n = len(code) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = code[:n].copy()
    for k in range(1, length):
        out = out * np.uint64(BASE) + code[k: k + n]
    return mix(out + np.uint64(length))


def shingles(words: Words, rows: int, length: int) -> Iterator[np.ndarray]:
    """Per row of a slice the sorted distinct codes of its shingles.

    A row with fewer words has its whole sequence as the only one; a row without words has none.
    """
    every = runs(words.code, length)
    first = np.searchsorted(words.row, np.arange(rows + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= length:
            yield np.unique(every[a: b - length + 1])
        elif b > a:
            yield runs(words.code[a:b], b - a)
        else:
            yield every[:0]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays."""
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=ends[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows of whole texts come to Python few at a time, so long ones fit in a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def released(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``; what it has freed goes back to the system at the end of a task.

    Workers serve one task after the other, and would otherwise keep what their largest one took.
    """

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return inner


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts lineage in a way that survives lost executors, and what is joined next knows its size.
    """
    path = work_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
