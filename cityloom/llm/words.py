"""Words of whole Arrow batches: runs of digits, letters and everything beyond ASCII, with A-Z lower-cased, as numpy positions.

In UTF-8 the bytes of such a word are the digits, the letters and all bytes from 0x80, so words can be told by bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The same words as a pattern, for texts whose A-Z are lower-cased already.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_FOLD = np.zeros(256, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _a, _b, _to in ((0x30, 0x3A, 0x30), (0x61, 0x7B, 0x61), (0x41, 0x5B, 0x61)):
    _FOLD[_a:_b] = np.arange(_to, _to + _b - _a)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 of all texts in a row, offsets); nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """``row, start, length`` of every word of a column, in order, and the folded bytes."""

    def __init__(self, column: pa.Array):
        raw, off = text_bytes(column)
        self.rows = len(column)
        self.folded = np.zeros(len(raw) + 8, np.uint8)
        np.take(_FOLD, raw, out=self.folded[: len(raw)])
        word = self.folded[: len(raw)] != 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edge = off[:-1][(off[:-1] < len(raw)) & (np.diff(off) > 0)]
        first[edge] = word[edge]
        before = edge[edge > 0] - 1
        last[before] = word[before]
        self.start = np.flatnonzero(first)
        self.length = np.flatnonzero(last) + 1 - self.start
        begins = np.searchsorted(self.start, off)
        self.counts = np.diff(begins)
        self.begins = begins[:-1]
        self.row = np.repeat(np.arange(self.rows), self.counts)


def _mix(h: np.ndarray, chunk: np.ndarray, seed: int) -> np.ndarray:
    h = (h ^ chunk) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)
    return h ^ (h >> np.uint64(29))


class Vocabulary:
    """Codes of given words. A hash of eight bytes at a time finds them, the bytes themselves decide."""

    def __init__(self, words: list[str]):
        self.words = sorted(set(words))
        raw = [w.encode() for w in self.words]
        self.lengths = np.array([len(w) for w in raw], np.int64)
        chunks = (self.lengths + 7) // 8
        self.at = np.concatenate([[0], np.cumsum(chunks)]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(w.ljust(8 * int(n), b"\0") for w, n in zip(raw, chunks)), "<u8").astype(np.uint64)
        self.longest = int(self.lengths.max(initial=0))
        for self.seed in range(64):
            h = self._hash(np.arange(len(raw)), self.lengths, lambda i, r: self.flat[self.at[i] + r])
            if len(np.unique(h)) == len(raw):
                break
        else:
            raise ValueError("no seed tells the words apart")
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def _hash(self, index: np.ndarray, lengths: np.ndarray, chunk) -> np.ndarray:
        h = lengths.astype(np.uint64)
        r, live = 0, np.arange(len(index))
        with np.errstate(over="ignore"):
            while len(live):
                h[live] = _mix(h[live], chunk(index[live], r), self.seed)
                r += 1
                live = live[lengths[live] > 8 * r]
        return h

    def codes(self, words: Words) -> np.ndarray:
        """The code of each word, its place in self.words; -1 for others."""
        out = np.full(len(words.start), -1, np.int32)
        if not self.words:
            return out
        view = np.ndarray((len(words.folded) - 7,), "<u8", words.folded, strides=(1,))
        load = lambda i, r: view[words.start[i] + 8 * r] & _KEEP[np.minimum(words.length[i] - 8 * r, 8)]
        pick = np.flatnonzero(words.length <= self.longest)
        h = self._hash(pick, words.length[pick], load)
        place = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        hit = self.sorted[place] == h
        pick, code = pick[hit], self.order[place[hit]]
        good = words.length[pick] == self.lengths[code]
        r, live = 0, np.flatnonzero(good)
        while len(live):
            good[live] &= load(pick[live], r) == self.flat[self.at[code[live]] + r]
            r += 1
            live = live[(words.length[pick[live]] > 8 * r) & good[live]]
        out[pick[good]] = code[good]
        return out
