"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces.

The pieces come from a vocabulary file (never trained here). A file of BPE kind has no log scores, only ranks; its pieces get
the log of Zipf's share of their rank, ``-ln(rank + 1) - ln(H)``. A space is the whitespace marker; a text gets one in front.
A character that no piece covers costs the lowest score less 10 and becomes its UTF-8 bytes, one byte piece each, so that any
text, markers written in it included, is decoded to exactly itself.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: What an uncovered character costs below the lowest score.
UNKNOWN_COST = 10.0
_CHUNK = re.compile(" +[^ ]*")


class DoubleArray:
    """Byte trie in two arrays: the child of state s by byte c is ``base[s] + c + 1`` if ``check`` there is s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values):
            at = 0
            for c in key:
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = len(children)
                    children.append({})
                    value.append(-1)
                    children[at][c] = nxt
                at = nxt
            value[at] = v
        room = 8 * len(children) + 4096
        base, check, out = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        taken = np.zeros(room, bool)
        taken[0] = True
        slot, low, window = {0: 0}, 1, np.arange(64)
        queue = [0]
        while queue:
            later = []
            for node in queue:
                kids = children[node]
                if not kids:
                    continue
                while taken[low]:
                    low += 1
                marks = np.fromiter(kids, np.int64, len(kids)) + 1
                start = max(0, low - int(marks.min()))
                while len(kids) > 1:
                    fits = ~taken[start + window[:, None] + marks].any(axis=1)
                    if fits.any():
                        start += int(fits.argmax())
                        break
                    start += len(window)
                if len(kids) > 1 and start > low and taken[low:start].mean() > 0.9:
                    low = start
                own = slot[node]
                base[own] = start
                for c, kid in kids.items():
                    at = start + c + 1
                    taken[at], check[at], out[at], slot[kid] = True, own, value[kid], at
                    later.append(kid)
            queue = later
        end = int(np.flatnonzero(taken)[-1]) + 1 + 258
        pad = max(0, end - len(base))
        self.base = np.append(base, np.zeros(pad, np.int32))[:end]
        self.check = np.append(check, np.full(pad, -1, np.int32))[:end]
        self.value = np.append(out, np.full(pad, -1, np.int32))[:end]
        # a state without children may have a base from which base + 256 leaves the array
        self.base = np.minimum(self.base, end - 258)


class UnigramModel:
    """Pieces with log scores, as arrays that workers share by broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], control_ids: set[int]):
        keys, ids = [], []
        byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.whole_words = True
        texts = []
        for i, piece in enumerate(pieces):
            if i in byte_of:
                texts.append(bytes([byte_of[i]]))
                continue
            if i in control_ids:
                texts.append(b"")
                continue
            self.whole_words &= not re.search(f"[^{MARKER}]{MARKER}", piece)
            texts.append(piece.replace(MARKER, " ").encode())
            keys.append(texts[-1])
            ids.append(i)
        self.trie = DoubleArray(keys, ids)
        self.scores = np.asarray(scores, np.float64)
        self.byte_ids = np.asarray(byte_ids, np.int32)
        self.unknown = float(self.scores[ids].min()) - UNKNOWN_COST
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[self.byte_ids] = True
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        self.text_at = np.concatenate([[0], np.cumsum([len(x) for x in texts])])

    @classmethod
    @functools.lru_cache(maxsize=4)
    def from_file(cls, path: str) -> UnigramModel:
        """From a SentencePiece file with byte pieces, on the driver."""
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        pieces = [p.id_to_piece(i) for i in range(n)]
        byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        control = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)}
        scores = np.array([p.get_score(i) for i in range(n)])
        apart = control | set(byte_ids)
        plain = [i for i in range(n) if i not in apart]
        if (scores[plain] == np.round(scores[plain])).all():  # ranks
            order = np.argsort(-scores[plain], kind="stable")
            rank = np.empty(len(plain))
            rank[order] = np.arange(1, len(plain) + 1)
            scores[plain] = -np.log(rank) - np.log((1 / np.arange(1, len(plain) + 1)).sum())
        return cls(pieces, scores.tolist(), byte_ids, control)

    def segment(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Best segmentation of each chunk: (ids of all in order, number of ids of each). Of equal ones, that whose last piece is longest."""
        n, trie = len(chunks), self.trie
        lens = np.fromiter(map(len, chunks), np.int64, n)
        data = np.frombuffer(b"".join(chunks), np.uint8)
        starts = np.cumsum(lens) - lens
        total = int(lens.sum())
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        owner = np.repeat(np.arange(n), lens)
        ends = (starts + lens)[owner[chars]]
        width = np.diff(np.append(chars, total))
        alive, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        found = []
        covered = np.zeros(len(chars), bool)
        depth = 0
        while alive.size:
            inside = chars[alive] + depth < ends[alive]
            alive, state = alive[inside], state[inside]
            to = trie.base[state] + data[chars[alive] + depth].astype(np.int64) + 1
            ok = trie.check[to] == state
            alive, state = alive[ok], to[ok]
            depth += 1
            value = trie.value[state]
            hit = value >= 0
            where = alive[hit]
            covered[where[width[where] == depth]] = True
            found.append((chars[where], np.full(len(where), depth), value[hit]))
        bare = np.flatnonzero(~covered)
        found.append((chars[bare], width[bare], np.full(len(bare), -1)))
        at, size, piece = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        cost = np.where(piece < 0, self.unknown, self.scores[piece])
        place = at - starts[owner[at]]
        order = np.argsort(place.astype(np.uint16) if place.max() < 65536 else place, kind="stable")
        at, size, piece, cost, place = at[order], size[order], piece[order], cost[order], place[order]
        source = at + owner[at]  # each chunk has a slot more than bytes
        target = source + size
        best = np.full(total + n, -np.inf)
        best[starts + np.arange(n)] = 0.0
        back = np.zeros(total + n, np.int64)
        cuts = np.flatnonzero(np.diff(place)) + 1
        for a, b in zip(np.append(0, cuts), np.append(cuts, len(place))):
            to = target[a:b]
            new = best[source[a:b]] + cost[a:b]
            better = new > best[to]
            best[to[better]] = new[better]
            back[to[better]] = np.arange(a, b)[better]
        slot, first = starts + lens + np.arange(n), starts + np.arange(n)
        live, steps = np.flatnonzero(slot > first), []
        while live.size:
            m = back[slot[live]]
            steps.append((live, m))
            slot[live] -= size[m]
            live = live[slot[live] > first[live]]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        chunk = np.concatenate([c for c, _ in steps])
        match = np.concatenate([m for _, m in steps])
        step = np.repeat(np.arange(len(steps)), [len(c) for c, _ in steps])
        order = np.lexsort((-step, chunk))
        chunk, match = chunk[order], match[order]
        each = np.where(piece[match] < 0, size[match], 1)
        ids = np.repeat(piece[match], each)
        byte = np.repeat(at[match], each) + np.arange(len(ids)) - np.repeat(np.cumsum(each) - each, each)
        ids = np.where(ids < 0, self.byte_ids[data[np.minimum(byte, total - 1)]], ids)
        return ids.astype(np.int32), np.bincount(np.repeat(chunk, each), minlength=n)

    def _segment_all(self, chunks: list[bytes], most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """segment() of runs of chunks of about most bytes at a time: the tables of matches stay small."""
        upto = np.cumsum([len(c) for c in chunks])
        cuts = np.append(np.flatnonzero(np.diff(upto // most)) + 1, len(chunks))
        parts = [self.segment(chunks[a:b]) for a, b in zip(np.append(0, cuts[:-1]), cuts)]
        return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])

    def encode(self, texts: list[str | None], most: int = 2 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, offsets) of texts; a null or empty text has no ids. Texts go in runs of about most characters, so that the words of a whole batch are never held at once."""
        upto = np.cumsum([len(t or "") for t in texts])
        cuts = np.append(np.flatnonzero(np.diff(upto // most)) + 1, len(texts))
        parts = [self._encode_run(texts[a:b]) for a, b in zip(np.append(0, cuts[:-1]), cuts)]
        ids = np.concatenate([p for p, _ in parts])
        before = np.cumsum([0] + [len(p) for p, _ in parts[:-1]])
        return ids, np.concatenate([[0], *[at[1:] + n for (_, at), n in zip(parts, before)]])

    def _encode_run(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """encode() of a run: each distinct word of it is segmented once."""
        cut = _CHUNK.findall if self.whole_words else (lambda x: [x])
        flat: list[str] = []
        many = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                words = cut(" " + text)
                many[k] = len(words)
                flat += words
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        code, words = pd.factorize(np.array(flat, dtype=object))
        ids, each = self._segment_all([w.encode() for w in words])
        begin = (np.cumsum(each) - each)[code]
        length = each[code]
        out = ids[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
        upto = np.concatenate([[0], np.cumsum(length)])
        return out, upto[np.concatenate([[0], np.cumsum(many)])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of id lists: pieces joined, byte pieces as bytes, markers as spaces, the leading one dropped."""
        width = (self.text_at[1:] - self.text_at[:-1])[ids]
        begin = self.text_at[ids]
        data = self.text[np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))].tobytes()
        upto = np.concatenate([[0], np.cumsum(width)])[offsets]
        out = []
        for a, b in zip(upto[:-1], upto[1:]):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text.startswith(" ") else text)
        return out


def encode(df: DataFrame, model_path: str = VOCABULARY, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """df with ids_col, the piece ids of text_col (null text: null; empty: no ids).

    Texts of any length are encoded whole; of segmentations with equal scores the one whose last piece is longest is taken, so repeated rows
    get equal ids. A column named ids_col is replaced; other columns stay. An empty table gives an empty result.
    """
    model = df.sparkSession.sparkContext.broadcast(UnigramModel.from_file(model_path))

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        flat, offsets = model.value.encode(text.to_pylist())
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=text.is_null() if text.null_count else None)

    return df.withColumn(ids_col, ids(F.col(text_col).cast("string")))


def decode(df: DataFrame, model_path: str = VOCABULARY, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col, the text of ids_col (null: null; ids out of range: nothing). A column named text_col is replaced."""
    model = df.sparkSession.sparkContext.broadcast(UnigramModel.from_file(model_path))

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        m = model.value
        offsets = np.asarray(ids.offsets)
        flat = np.asarray(ids.values.fill_null(-1))[offsets[0] : offsets[-1]].astype(np.int64)
        offsets = offsets - offsets[0]
        good = (flat >= 0) & (flat < len(m.text_at) - 1)
        if not good.all():
            offsets = np.concatenate([[0], np.cumsum(good)])[offsets]
            flat = flat[good]
        null = np.asarray(ids.is_null())
        return pa.array([None if gone else x for x, gone in zip(m.decode(flat, offsets), null)], pa.string())

    return df.withColumn(text_col, text(F.col(ids_col)))
