"""Packing of tokenised documents into windows by the sum-of-squares rule.

A task packs the documents it reads, in order.  A document's full windows stand by
themselves; its rest goes to the fill level that minimises the sum of the squared
numbers of windows at each level, found in the array of those numbers.  When a task
ends, its open windows are put together: the emptiest are cut to fill up the fullest,
so one window a task stays partly filled.  Nothing is shuffled, and a lost task is
packed again as a whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aerospark.llm.base import batch, released, slices
from aerospark.llm.word_ids import WordIds, per_row

WINDOW = 2048
SEPARATOR = 1
#: Fixed value: how the byte-level tokenizer splits a text before its merges; ``Encoder`` rests on it.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Words whose ids a task remembers, about 50 bytes each.
REMEMBERED_WORDS = 1_500_000
#: New words that are encoded as one text.
JOINED = 256

#: Characters that any version of Unicode classes alike; a text with others goes to the tokenizer whole.
_UNUSUAL = re.compile("[^\t\n\r -~\xa1-ɏ]")
_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0A, 0x0D, 0x20]] = True
#: How byte-level vocabularies write the space and the line end.
_SPACE, _LINE_END = "\u0120", "\u010a"

PACKED = "doc_id bigint, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
_PACKED = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


class Encoder:
    """Ids of texts as little-endian 32-bit numbers; remembers the words of a task.

    For a byte-level tokenizer that splits texts by ``PIECES``.  Of blanks
    in a row that something follows, that pattern takes all but the last as one piece, and the
    last by itself or, if it is a space, with what follows.  So a text can be cut at these places,
    and the words between them are encoded apart; new words are put behind one another, where
    the token that holds a word's space tells where its ids begin.
    """

    def __init__(self, model: str):
        self.tokenizer = Tokenizer.from_str(model)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()
        vocabulary = self.tokenizer.get_vocab()
        self.line_end = vocabulary.get(_LINE_END)
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(_SPACE)]] = True
        if self.line_end is not None:
            self.begins[self.line_end] = True

    def forget(self) -> None:
        """Give back the memory of the words; a worker outlives its tasks and serves other stages."""
        self.words = WordIds(REMEMBERED_WORDS)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _of_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of new words: a space and what follows, or that alone, or only blanks."""
        spaced = [w[:1] == b" " for w in words]
        apart = [w[-1] in b"\t\n\r " or (self.line_end is None and not s) for w, s in zip(words, spaced)]
        told = [k for k, alone in enumerate(apart) if not alone]
        runs = [told[k: k + JOINED] for k in range(0, len(told), JOINED)]
        texts = [b"".join([words[k] if spaced[k] else b"\n" + words[k] for k in run]).decode() for run in runs]
        out: list[bytes] = [b""] * len(words)
        alone = [k for k, own in enumerate(apart) if own]
        for run, text, found in zip(runs, texts, self._whole(texts)):
            ids = np.frombuffer(found, "<u4")
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(run) or any(s in text for s in self.special):
                alone += run
                continue
            stop = (4 * np.append(first[1:], len(ids))).tolist()
            for k, a, b in zip(run, (4 * first).tolist(), stop):
                out[k] = found[a if spaced[k] else a + 4: b]
        for k, ids in zip(alone, self._whole([words[k].decode() for k in alone])):
            out[k] = ids
        return out

    def _by_words(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        n = len(data)
        blank = _BLANK[data]
        before, after = np.append(False, blank[:-1]), np.append(blank[1:], True)
        filled = np.diff(offsets) > 0
        begins = np.zeros(n, bool)
        after[offsets[1:][filled] - 1] = True  # the blanks that end a text stay together
        before[offsets[:-1][filled]] = False
        begins |= blank & (~before | ~after)
        begins |= ~blank & before & (np.append(np.uint8(0), data[:-1]) != 0x20)
        begins[offsets[:-1][filled]] = True
        start = np.flatnonzero(begins)
        stop = np.append(start[1:], n)

        ids, count = self.words.ids_of(data, start, stop, self._of_words)
        return per_row(ids, count, start, offsets, np.dtype("<u4"))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text of a slice."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        out: list[bytes] = [b""] * len(texts)
        odd = [k for k, t in enumerate(texts) if _UNUSUAL.search(t) or any(s in t for s in self.special)]
        for k, ids in zip(odd, self._whole([texts[k] for k in odd])):
            out[k] = ids
        rest = sorted(set(range(len(texts))).difference(odd))
        if odd:
            parts = [data[offsets[k]: offsets[k + 1]] for k in rest]
            data, offsets = np.concatenate([data[:0], *parts]), np.cumsum([0] + [len(p) for p in parts])
        if len(data):
            for k, ids in zip(rest, self._by_words(data, offsets)):
                out[k] = ids
        return out


def best_level(levels: np.ndarray, size: int) -> int:
    """The level (0: a new window) whose choice leaves the least sum of squares; ties go to the fullest.

    ``levels[h]`` counts open windows that hold ``h`` tokens; empty and full ones are not counted.
    """
    window = len(levels) - 1
    below, above = levels[: window - size + 1], levels[size:]
    change = 2 * (above - below) + 2
    change[-1] -= 1  # a full window leaves the sum
    change[1:][below[1:] == 0] = np.iinfo(np.int64).max
    change[0] = 2 * above[0] + 1 if size < window else 0
    return len(change) - 1 - int(np.argmin(change[::-1]))


class Packer:
    """Windows under way: for each, the pieces it holds; for each level, its windows."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.next = window, first_sequence
        self.levels = np.zeros(window + 1, np.int64)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _open(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        whole = total - total % self.window
        for start in range(0, whole, self.window):
            piece = ids[4 * start: 4 * (start + self.window)]
            self.done.append((doc_id, start, piece, total, self._open(), 0))
        if whole < total:
            self._place((doc_id, whole, ids[4 * whole:], total))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        level = best_level(self.levels, size)
        if level:
            sequence = self.at[level].pop()
            self.levels[level] -= 1
        else:
            sequence = self._open()
        held = self.held.setdefault(sequence, [])
        held.append((*piece, sequence, level))
        level += size
        if level == self.window:
            self.done += self.held.pop(sequence)
        else:
            self.levels[level] += 1
            self.at[level].append(sequence)

    def close(self) -> None:
        """Cut the pieces of the emptiest open windows to fill up the fullest."""
        left = [(level, s) for level in range(1, self.window) for s in self.at[level]]
        while len(left) > 1:
            fill, target = left.pop()
            taken = 0
            while fill < self.window and taken < len(left):
                level, source = left[taken]
                doc_id, start, ids, total, _, offset = self.held[source].pop()
                size = len(ids) // 4
                fits = min(size, self.window - fill)
                # the end of the piece goes, its beginning stays
                self.held[target].append((doc_id, start + size - fits, ids[4 * (size - fits):], total, target, fill))
                if fits < size:
                    self.held[source].append((doc_id, start, ids[: 4 * (size - fits)], total, source, offset))
                fill, level = fill + fits, level - fits
                left[taken] = (level, source)
                if not level:
                    self.held.pop(source)
                    taken += 1
            left = left[taken:]
        for pieces in self.held.values():
            self.done += pieces
        self.held.clear()

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


_ENCODERS: dict[int, Encoder] = {}


def _encoder(model: str) -> Encoder:
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


def pack(
    docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text",
    window: int = WINDOW, separator: int = SEPARATOR,
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, ids, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizers file, read on the driver.  A document is the
    ids of its whole text and then ``separator``; a null text is empty.  ``ids`` are
    little-endian unsigned 32-bit numbers; ``start`` is where they begin in the document and
    ``offset`` where in the sequence, which has no gaps.  Every id lies in exactly one piece.
    Repeated rows and null ids are documents like others.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # the size of one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(shared.value), np.array([separator], "<u4").tobytes()
        packer = Packer(window, TaskContext.get().partitionId() << 36)
        for part in batches:
            for a, b, data, offsets in slices(part.column(1)):
                for key, ids in zip(part.column(0).slice(a, b - a).to_pylist(), encoder.encode(data, offsets)):
                    packer.add(key, ids + end)
                if done := packer.take():
                    yield batch(_PACKED, *zip(*done))
        encoder.forget()
        packer.close()
        if done := packer.take():
            yield batch(_PACKED, *zip(*done))

    return docs.select(F.col(doc_id).cast("bigint"), F.coalesce(F.col(text), F.lit(""))).mapInArrow(released(run), PACKED)
