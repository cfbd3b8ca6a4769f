"""Ids of words that a tokenizer gives, remembered by the bytes of the words."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from aerospark.llm.base import chunks, codes_of, same_bytes


def _joined(pool: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    while used + len(more) > len(pool):
        pool = np.concatenate([pool, np.empty_like(pool)])
    pool[used: used + len(more)] = more
    return pool


class WordIds:
    """Words by 64-bit code, with their bytes and their ids, in arrays of about 50 bytes a word.

    A code finds a word and its bytes confirm it, so words that share a code keep their own ids.
    """

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.codes = np.empty(0, np.uint64)
        self.at = self.size = self.begin = self.count = np.empty(0, np.int64)
        self.text, self.text_used = np.empty(1 << 16, np.uint8), 0
        self.ids, self.ids_used = np.empty(1 << 16, np.uint32), 0

    def _add(self, codes: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        place = np.searchsorted(self.codes, codes)
        size = np.array([len(w) for w in words], np.int64)
        count = np.array([len(i) for i in ids], np.int64) // 4
        self.at = np.insert(self.at, place, self.text_used + np.cumsum(size) - size)
        self.size = np.insert(self.size, place, size)
        self.begin = np.insert(self.begin, place, self.ids_used + np.cumsum(count) - count)
        self.count = np.insert(self.count, place, count)
        self.codes = np.insert(self.codes, place, codes)
        self.text = _joined(self.text, self.text_used, np.frombuffer(b"".join(words), np.uint8))
        self.ids = _joined(self.ids, self.ids_used, np.frombuffer(b"".join(ids), "<u4"))
        self.text_used += int(size.sum())
        self.ids_used += int(count.sum())

    def ids_of(
        self, data: np.ndarray, start: np.ndarray, stop: np.ndarray,
        learn: Callable[[list[bytes]], list[bytes]], code: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words ``data[start:stop]``, one word after the other, and how many each has.

        ``learn`` gives the ids of words that are not remembered, as little-endian 32-bit numbers;
        ``code`` are the words' codes where they are known already.
        """
        if not len(start):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        eight = chunks(data)
        code = codes_of(eight, start, stop) if code is None else code
        codes, first, which = np.unique(code, return_index=True, return_inverse=True)
        other = ~same_bytes(eight, start, stop, eight, start[first][which], stop[first][which])
        if len(self.codes) > self.most:
            self._clear()
        known = np.zeros(len(codes), bool)
        if len(self.codes):
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            known = self.codes[place] == codes
            place, own = place[known], np.flatnonzero(known)
            begin = self.at[place]
            same = same_bytes(
                chunks(self.text[: self.text_used]), begin, begin + self.size[place], eight, start[first[own]], stop[first[own]]
            )
            if not same.all():
                other |= np.isin(which, own[~same])
        raw = data.tobytes()
        words_at = lambda some: [raw[a:b] for a, b in zip(start[some].tolist(), stop[some].tolist())]
        new = np.flatnonzero(~known)
        if len(new):
            words = words_at(first[new])
            self._add(codes[new], words, learn(words))
        place = np.searchsorted(self.codes, codes)
        begin, count, pool = self.begin[place][which], self.count[place][which], self.ids
        if other.any():
            alone = np.flatnonzero(other)
            found = learn(words_at(alone))
            count[alone] = [len(f) // 4 for f in found]
            begin[alone] = self.ids_used + np.cumsum(count[alone]) - count[alone]
            pool = np.concatenate([pool[: self.ids_used], np.frombuffer(b"".join(found), "<u4")])
        ends = np.cumsum(count)
        return pool[np.repeat(begin - (ends - count), count) + np.arange(ends[-1])], count


def per_row(ids: np.ndarray, count: np.ndarray, start: np.ndarray, offsets: np.ndarray, kind: np.dtype) -> list[bytes]:
    """The ids of each row as bytes; ``start`` is where words begin, ``offsets`` where rows do."""
    ends = np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, offsets)] * np.dtype(kind).itemsize
    raw = ids.astype(kind).tobytes()
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
