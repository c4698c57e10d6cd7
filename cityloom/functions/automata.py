"""Keyword search and phrase conversion over whole Arrow batches: a trie in arrays, walked by all texts in step."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that may be sent to all tasks; code points of a text that are walked one after the other.
MOST_WORDS, STRETCH = 1_000_000, 512
_LATIN = re.compile(r"[a-zA-Z0-9\s\-.]+")


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts in a row, offsets); nulls are empty."""
    texts = pc.fill_null(texts, "")
    lengths = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    return np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


class Trie:
    """Words in arrays: node 0 is the root, ``word`` is the number of the word that ends at a node or -1."""

    def __init__(self, words: list[str]):
        self.words = words
        self.alphabet = np.unique(np.array([ord(c) for w in words for c in w], np.uint32))
        code = {int(c): n for n, c in enumerate(self.alphabet)}
        edges: dict[tuple[int, int], int] = {}
        word, self.parent, self.by = [-1], [0], [0]
        for n, w in enumerate(words):
            at = 0
            for c in w:
                step = (at, code[ord(c)])
                at = edges.setdefault(step, len(word))
                if at == len(word):
                    word.append(-1)
                    self.parent.append(step[0])
                    self.by.append(step[1])
            if at:
                word[at] = n
        self.word = np.array(word, np.int64)
        keys = np.array([a * len(code) + c for a, c in edges], np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.array(list(edges.values()), np.int64)[order]
        self.longest = max(map(len, words), default=0)

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Place of each code point in the alphabet, -1 for others."""
        if not len(self.alphabet):
            return np.full(len(points), -1)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, -1)

    def follow(self, nodes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The node after each, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(nodes), -1)
        key = nodes * len(self.alphabet) + classes
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((classes >= 0) & (self.keys[at] == key), self.targets[at], -1)


class Keywords(Trie):
    """Aho-Corasick automaton: every keyword of a text in one pass, however many there are.

    Keywords of one character are skipped. Of those that begin first the longest counts, and the next is looked for behind it. A Latin keyword
    has to stand between word borders, if asked.
    """

    def __init__(self, words: list[str], borders: bool = True):
        super().__init__(sorted({w for w in words if len(w) > 1}))
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.bounded = np.array([borders and bool(_LATIN.fullmatch(w)) for w in self.words], bool)
        self.fail = np.zeros(len(self.word), np.int64)
        level = self.targets[self.keys < len(self.alphabet)] if len(self.keys) else np.zeros(0, np.int64)
        parent, by = np.array(self.parent), np.array(self.by)
        children = np.argsort(parent[1:], kind="stable") + 1
        first = np.searchsorted(parent[children], np.arange(len(self.word) + 1))
        while len(level):  # a level at a time: the longest suffix that is in the trie too
            level = np.concatenate([children[first[n] : first[n + 1]] for n in level.tolist()]) if len(level) else level
            if len(level):
                self.fail[level] = self._step(self.fail[parent[level]], by[level])
        self.report = np.where(self.word >= 0, np.arange(len(self.word)), 0)
        for n in self._by_depth(parent):
            if self.word[n] < 0:
                self.report[n] = self.report[self.fail[n]]

    def _by_depth(self, parent: np.ndarray) -> list[int]:
        depth = np.zeros(len(parent), np.int64)
        for n in range(1, len(parent)):
            depth[n] = depth[parent[n]] + 1
        return np.argsort(depth, kind="stable")[1:].tolist()

    def _step(self, state: np.ndarray, classes: np.ndarray) -> np.ndarray:
        state = state.copy()
        state[classes < 0] = 0
        live = np.flatnonzero(classes >= 0)
        while len(live):
            to = self.follow(state[live], classes[live])
            done = (to >= 0) | (state[live] == 0)
            state[live[done]] = np.maximum(to[done], 0)
            live = live[~done]
            state[live] = self.fail[state[live]]
        return state

    def occurrences(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the begin among all code points, keyword) of all occurrences, overlapping ones too.

        Long texts are cut into stretches that begin early enough for the keywords that end in them.
        """
        count = np.maximum((np.diff(off) + STRETCH - 1) // STRETCH, 1)
        text = np.repeat(np.arange(len(count)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        own = off[text] + nth * STRETCH
        begin, end = np.maximum(own - self.longest, off[text]), np.minimum(own + STRETCH, off[text + 1])
        classes, state = self.classes(points), np.zeros(len(text), np.int64)
        order = np.argsort(begin - end, kind="stable")
        text, own, begin, end = text[order], own[order], begin[order], end[order]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(int((end - begin).max(initial=0))):
            live = int(np.searchsorted(begin - end, -k))
            at = begin[:live] + k
            state = self._step(state[:live], classes[at])
            node = self.report[state]
            some = np.flatnonzero((node > 0) & (at >= own[:live]))
            while len(some):
                w = self.word[node[some]]
                found.append((text[some], at[some] + 1 - self.lengths[w], w))
                node[some] = self.report[self.fail[node[some]]]
                some = some[node[some] > 0]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c) for c in zip(*found))

    def hits(self, texts: pa.Array) -> pa.Array:
        """The keywords of each text from left to right."""
        points, off = code_points(texts)
        text, begin, word = self.occurrences(points, off)
        known, place = np.unique(points, return_inverse=True)
        wordy = np.array([chr(c).isalnum() or c == 95 for c in known.tolist()], bool)[place] if len(points) else np.zeros(0, bool)
        around = np.zeros(len(points) + 2, bool)
        around[1:-1] = wordy
        end = begin + self.lengths[word]
        before = around[begin] & (begin > off[text])
        after = around[np.minimum(end + 1, len(points) + 1)] & (end < off[text + 1])
        ok = ~self.bounded[word] | ((before != around[begin + 1]) & (after != around[end]))
        text, begin, word, end = text[ok], begin[ok], word[ok], end[ok]
        order = np.lexsort((-self.lengths[word], begin))
        out: list[list[str]] = [[] for _ in range(len(off) - 1)]
        last = -1
        for t, a, b, w in zip(*(x[order].tolist() for x in (text, begin, end, word))):
            if a >= last:
                out[t].append(self.words[w])
                last = b
        return pa.array(out, pa.list_(pa.string()))


class Phrases(Trie):
    """Conversion by the longest phrase at each place, single characters being phrases too; what is in none stays."""

    def __init__(self, table: dict[str, str]):
        super().__init__(sorted(k for k in table if k))
        self.to = [table[w] for w in self.words]

    def convert(self, texts: pa.Array) -> pa.Array:
        points, off = code_points(texts)
        text = np.repeat(np.arange(len(off) - 1), np.diff(off))
        classes = self.classes(points)
        start, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        best, size = np.full(len(points), -1), np.ones(len(points), np.int64)
        depth = 0
        while len(start):  # all places of all texts go down the trie together
            inside = start + depth < off[text[start] + 1]
            start, node = start[inside], node[inside]
            node = self.follow(node, classes[start + depth])
            start, node = start[node >= 0], node[node >= 0]
            depth += 1
            ends = self.word[node] >= 0
            best[start[ends]], size[start[ends]] = self.word[node[ends]], depth
        out, given, valid = [], texts.to_pylist(), texts.is_valid().to_pylist()
        hit = np.flatnonzero(best >= 0)
        bounds = np.searchsorted(hit, off)
        for n, raw in enumerate(given):
            if not valid[n] or bounds[n] == bounds[n + 1]:
                out.append(raw)
                continue
            pieces, at = [], 0
            for p in hit[bounds[n] : bounds[n + 1]].tolist():
                k = p - int(off[n])
                if k >= at:
                    pieces += (raw[at:k], self.to[best[p]])
                    at = k + int(size[p])
            out.append("".join((*pieces, raw[at:])))
        return pa.array(out, pa.string())


def _bounded(df: DataFrame, what: str) -> list:
    rows = df.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} {what}")
    return rows


def keywords_of(words: DataFrame, keyword: str = "keyword", borders: bool = True) -> Keywords:
    """The automaton of a keyword table of at most MOST_WORDS rows; null keywords are skipped."""
    return Keywords([r[0] for r in _bounded(words.where(F.col(keyword).isNotNull()).select(keyword).distinct(), "keywords")], borders)


def phrases_of(table: DataFrame, phrase: str = "phrase", to: str = "to") -> Phrases:
    """The converter of a phrase table of at most MOST_WORDS rows; of equal phrases the smallest conversion counts, null ones are skipped."""
    rows = _bounded(table.where(F.col(phrase).isNotNull() & F.col(to).isNotNull()).groupBy(phrase).agg(F.min(to).alias(to)), "phrases")
    return Phrases({r[0]: r[1] for r in rows})


def with_hits(df: DataFrame, text: Column, keywords: Keywords, out: str = "hits") -> DataFrame:
    """df with the keywords of a text (lower-case as the keywords are), from left to right; a null text has none. The automaton is sent to each worker once."""
    known = df.sparkSession.sparkContext.broadcast(keywords)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return known.value.hits(texts)

    return df.withColumn(out, run(text))


def converted(df: DataFrame, text: Column, phrases: Phrases, out: str) -> DataFrame:
    """df with a text converted phrase by phrase; null stays null."""
    known = df.sparkSession.sparkContext.broadcast(phrases)

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return known.value.convert(texts)

    return df.withColumn(out, run(text))
