"""License scans by template markup: optional and replaceable regions are compiled into one token automaton.

A template is a line of words. ``[...]`` is optional and may be nested, ``{name:2-8}`` stands for two to eight words whatever they are,
``{name:one|two words}`` for one of the wordings; everything else is mandatory, word for word. All templates are compiled into one
automaton over words, made deterministic as far as texts go into it. A text is read once: where two words follow each other with
which a template may begin, the automaton is run, and the template is accepted where it comes to an end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.llm.words import Vocabulary, Words

# The phrases every scan looks for, and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Wordings of public licenses and of the notices that name them, with what may be left out or differ.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this {what:1-8} to deal in the {what:1-4} without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {what:1-4}"),
    ("mit", "the mit license mit [copyright {holder:1-20} permission is hereby granted]"),
    ("isc", "permission to use copy modify and [or] distribute this software [and its documentation] for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of {holder:1-12} nor the names of {whose:its|any} contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2", "licensed under the apache license version 2 [0] [the license] you may not use this file except in compliance with the license"),
    ("gpl-2", "under the [terms of the] gnu general public license [as published by the free software foundation] [either] {v:version|v} 2"),
    ("gpl-3", "under the [terms of the] gnu general public license [as published by the free software foundation] [either] {v:version|v} 3"),
    ("lgpl", "under the [terms of the] gnu {kind:lesser|library} general public license"),
    ("agpl-3", "under the [terms of the] gnu affero general public license [as published by the free software foundation] [either] {v:version|v} 3"),
    ("mpl-2", "subject to the terms of the mozilla public license {v:v|version} 2 [0]"),
    ("cc-by", "creative commons attribution {version:2|3|4} {minor:0|5} [{where:international|unported|generic}] license"),
    ("cc-by", "licensed under [a] cc by {version:2|3|4} {minor:0|5}"),
    ("cc-by-nc", "creative commons attribution {nc:noncommercial|non commercial} [{version:2|3|4} {minor:0|5}]"),
    ("cc-by-nc-sa", "cc by nc sa [{version:2|3|4} {minor:0|5}]"),
    ("cc-by-nc-nd", "cc by nc nd [{version:2|3|4} {minor:0|5}]"),
    ("cc-by-sa", "cc by sa [{version:2|3|4} {minor:0|5}]"),
    ("cc-by-sa", "creative commons attribution {sa:sharealike|share alike} [{version:2|3|4} {minor:0|5}]"),
    ("cc0", "cc0 1 0 universal"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("bsl-1", "boost software license version 1 0"),
    ("epl-2", "eclipse public license {v:v|version} 2 [0]"),
)

_MARK = re.compile(r"\[|\]|\{[^{}]*\}|[^\s\[\]{}]+")


def parse(template: str) -> list:
    """Regions of a template: a word, ("optional", regions), ("any", least, most) or ("one", wordings)."""
    stack: list[list] = [[]]
    for mark in _MARK.findall(template):
        if mark == "[":
            stack.append([])
        elif mark == "]":
            region = stack.pop()
            if not stack:
                raise ValueError(f"nothing to close in {template!r}")
            stack[-1].append(("optional", region))
        elif mark[0] == "{":
            what = mark[1:-1].partition(":")[2]
            size = re.fullmatch(r"(\d+)-(\d+)", what)
            stack[-1].append(("any", int(size[1]), int(size[2])) if size else ("one", [w.split() for w in what.split("|")]))
        else:
            stack[-1].append(mark)
    if len(stack) != 1:
        raise ValueError(f"a region of {template!r} is left open")
    return stack[0]


def mandatory(template: str) -> int:
    """How many words no text may lack or change."""
    return sum(isinstance(r, str) for r in parse(template))


class Automaton:
    """All templates as one automaton over word codes; subsets of its states get numbers as they are met."""

    OTHER = -1

    def __init__(self, templates: list[str]):
        parsed = [parse(t) for t in templates]

        def words(regions) -> Iterator[str]:
            for r in regions:
                if isinstance(r, str):
                    yield r
                elif r[0] == "optional":
                    yield from words(r[1])
                elif r[0] == "one":
                    yield from (w for wording in r[1] for w in wording)

        self.vocabulary = Vocabulary([w for regions in parsed for w in words(regions)])
        self.code = {w: c for c, w in enumerate(self.vocabulary.words)}
        self.moves: list[list[tuple[int | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.ends: dict[int, int] = {}
        for n, regions in enumerate(parsed):
            self.ends[self._build(regions, self._branch())] = n
        self.sets: list[frozenset[int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.number: dict[frozenset[int], int] = {}
        self.next: dict[tuple[int, int], int] = {}
        self.dead, self.start = self._number(frozenset()), self._number(self._closed({0}))
        size = len(self.code)
        #: whether a template may begin with a pair of words; the last row and column are all other words
        self.begins = np.zeros((size + 1, size + 1), bool)
        for a in range(-1, size):
            one = self.step(self.start, a)
            if one != self.dead:
                self.begins[a] = True if self.accepts[one] else [self.step(one, b if b < size else -1) != self.dead for b in range(size + 1)]

    def _state(self) -> int:
        self.moves.append([])
        self.skips.append([])
        return len(self.moves) - 1

    def _branch(self) -> int:
        s = self._state()
        self.skips[0].append(s)
        return s

    def _move(self, at: int, code: int | None) -> int:
        to = self._state()
        self.moves[at].append((code, to))
        return to

    def _build(self, regions: list, at: int) -> int:
        for r in regions:
            if isinstance(r, str):
                at = self._move(at, self.code[r])
            elif r[0] == "optional":
                end = self._build(r[1], at)
                out = self._state()
                self.skips[at].append(out)
                self.skips[end].append(out)
                at = out
            elif r[0] == "any":
                out = self._state()
                for k in range(r[2]):
                    if k >= r[1]:
                        self.skips[at].append(out)
                    at = self._move(at, None)
                self.skips[at].append(out)
                at = out
            else:
                out = self._state()
                for wording in r[1]:
                    self.skips[self._build(wording, at)].append(out)
                at = out
        return at

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def _number(self, states: frozenset[int]) -> int:
        if states not in self.number:
            self.number[states] = len(self.sets)
            self.sets.append(states)
            self.accepts.append(tuple(sorted(self.ends[s] for s in states if s in self.ends)))
        return self.number[states]

    def step(self, at: int, code: int) -> int:
        to = self.next.get((at, code))
        if to is None:
            to = self.next[at, code] = self._number(self._closed({t for s in self.sets[at] for c, t in self.moves[s] if c is None or c == code}))
        return to

    def accepted(self, codes: list[int]) -> dict[int, int]:
        """Templates that begin with the first of the codes, and how many words of the text each takes at most."""
        at, out = self.start, {}
        for n, code in enumerate(codes, 1):
            at = self.step(at, code)
            if at == self.dead:
                break
            for t in self.accepts[at]:
                out[t] = n
        return out


def longest(regions: list) -> int:
    """How many words a text may take at most."""
    return sum(1 if isinstance(r, str) else longest(r[1]) if r[0] == "optional" else r[2] if r[0] == "any" else max(map(len, r[1])) for r in regions)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, base: tuple[tuple[str, str], ...] = BASE) -> DataFrame:
    """``doc_id, n_words, matches``: one row per row of df; matches are ``struct(label, base, start, words, strength)`` by start.

    start counts words from 0; words is the longest stretch that the template takes from there. strength grows with the number m of
    mandatory words, m / (m + 1). Texts of any length are read whole, a task at a time and a batch at once; a null or empty text has no words and no match; ties and
    repeated rows give a row each. An empty table gives an empty result. Other columns are not read, so their names may clash. Nothing
    is shuffled; the automaton is as large as the templates.
    """
    both = [*base, *templates]
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    most = max((longest(parse(t)) for _, t in both), default=0)
    strength = [mandatory(t) / (mandatory(t) + 1) for _, t in both]
    match = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("words", pa.int64()), ("strength", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([t for _, t in both])
        for batch in batches:
            words = Words(batch.column("text"))
            codes = automaton.vocabulary.codes(words)
            after = np.append(codes[1:], -1)[: len(codes)]
            ends = words.begins + words.counts
            after[ends[words.counts > 0] - 1] = -1
            found: list[list] = [[] for _ in range(words.rows)]
            for i in np.flatnonzero(automaton.begins[codes, after]).tolist():
                r = int(words.row[i])
                for t, n in automaton.accepted(codes[i : min(i + most, int(ends[r]))].tolist()).items():
                    found[r].append({"label": both[t][0], "base": t < len(base), "start": i - int(words.begins[r]), "words": n, "strength": strength[t]})
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_words": pa.array(words.counts, pa.int64()), "matches": pa.array(found, pa.list_(match))})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, matches array<struct<label:string,base:boolean,start:long,words:long,strength:double>>")


def labels_of(matches: Column) -> Column:
    """Distinct labels in order, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")


def pattern(template: str) -> str:
    """The template as a regular expression over words that are each preceded by one space and followed by one."""

    def of(regions) -> str:
        out = ""
        for r in regions:
            if isinstance(r, str):
                out += " " + re.escape(r)
            elif r[0] == "optional":
                out += f"(?:{of(r[1])})?"
            elif r[0] == "any":
                out += f"(?: [^ ]+){{{r[1]},{r[2]}}}"
            else:
                out += "(?:" + "|".join(of(w) for w in r[1]) + ")"
        return out

    return of(parse(template)) + " "
