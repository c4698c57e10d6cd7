"""Fill-in-middle, ranked search and license scans on small frames, against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cityloom.llm import infill, licenses, ranked
from cityloom.llm.words import Vocabulary, Words, text_bytes

DOCS = "doc_id long, text string, n long, form string, rank int, row long"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], DOCS)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def random_text(rng, size):
    return "".join(rng.choice(["ab", "Q", " ", "é", "漢", "𠀀", "9", ".", "\n", "zzzzzzz", "the mit license "]) for _ in range(size))


def test_words_and_codes_against_a_pattern():
    rng = random.Random(5)
    texts = [random_text(rng, n) for n in (0, 1, 3, 40, 400)] + [None, "", "a", "A" * 5000, "x" + "é" * 300, " ", "end word", "word end"]
    words = Words(pa.array(texts))
    want = [PATTERN.findall(fold(t)) for t in texts]
    assert words.counts.tolist() == [len(w) for w in want]
    spelled = [bytes(words.folded[s : s + n]).decode() for s, n in zip(words.start, words.length)]
    assert spelled == [w for ws in want for w in ws]
    known = sorted(set(rng.sample(sorted(set(spelled)), 12)) | {"a" * 5000, "x" + "é" * 300, "missing"})
    vocabulary = Vocabulary(known + known[:3])
    assert vocabulary.codes(words).tolist() == [vocabulary.words.index(w) if w in known else -1 for w in spelled]
    assert (Vocabulary([]).codes(words) == -1).all()


def brute_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_against_brute_force(spark):
    rng = random.Random(2)
    passage = random_text(rng, 900)
    rows = [(k, rng.choice(["", random_text(rng, 5), random_text(rng, 60)]) + rng.choice(["", passage, passage * 3]) + random_text(rng, 30)) for k in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "a<P>b"), (1003, "<" * 9), (1004, "a" * 100_000), (1005, "漢" * 50_000), (1006, "word " * 40_000), (1007, "< P>S><M"), (None, "no id at all"), (3, rows[3][1])]
    got = infill.fill_in_middle(frame(spark, rows).repartition(3)).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((k, *brute_infill(k, t), t or "") for k, t in rows), key=repr)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"]) for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(frame(spark, [])).count() == 0


def test_chunks_follow_the_content_and_are_computed_once():
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ijkl") for _ in range(20_000))
    texts = pa.array([passage, "another beginning. " + passage, passage + passage, "", "x" * 30_000, "漢" * 9000])
    data, off = text_bytes(texts)
    start = infill.chunk_starts(data, off)
    assert set(off[:-1][np.diff(off) > 0]) <= set(start.tolist()) and (np.diff(np.append(start, off[-1])) <= infill.MOST + 3).all()
    memo = infill.Memo()
    end = np.append(start[1:], off[-1])
    memo.summaries(data, start, end)
    once = memo.computed
    memo.summaries(data, start, end)
    assert memo.computed == once and once < 0.5 * (end <= off[3]).sum() + 12
    small = infill.Memo(most=1000)
    for _ in range(2):
        assert (small.summaries(data, start, end) == memo.summaries(data, start, end)).all()


def brute_search(docs, items, k):
    counted = [(d, Counter(PATTERN.findall(fold(t)))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(PATTERN.findall(fold(text))) if t in c)
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [7, 1 << 15])
def test_search_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ranked, "BLOCK_DOCS", block)
    rng = random.Random(3)
    word = [f"w{k}" for k in range(60)] + ["É", "漢字"]
    text = lambda n: " ".join(rng.choices(word, weights=[1 / (k + 1) for k in range(len(word))], k=n))
    docs = [(k, text(rng.choice([1, 5, 30]))) for k in range(150)]
    docs += [(200 + k, docs[0][1]) for k in range(25)] + [(5, docs[5][1]), (None, "w40 w41"), (None, docs[1][1]), (300, None), (301, ""), (302, "... !"), (303, "W3 " * 30_000)]
    items = [(k, text(rng.choice([1, 3, 12])).upper()) for k in range(12)] + [(90, docs[0][1]), (91, None), (92, "nowhere else"), (93, "w40 w41 w40"), (1, "w2 w3"), (None, "w5")]
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute_search(docs, items, 10)
    for some in (100_000, 20):
        got = ranked.search(frame(spark, docs).repartition(3), asked, block_terms=some)
        assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got.collect()), key=repr) == want
    assert ranked.search(frame(spark, []), asked).count() == 0
    assert ranked.search(frame(spark, docs), asked.limit(0)).count() == 0


def test_reading_stops_before_the_end_of_the_lists():
    """One document has all high impacts; the lists' tails stay unread, and the next block is not opened."""
    n = 50_000
    impacts = np.concatenate([[10_000], np.arange(n - 1, 0, -1) % 1000 + np.zeros(n - 1, np.int64)])
    impacts[1:] = np.sort(impacts[1:])[::-1]
    lists = [(np.arange(n), impacts, 1), (np.concatenate([[0], np.arange(n - 1, 0, -1)]), impacts, 1)]
    best = ranked.Best(1)
    assert ranked.read_lists(lists, n, list(range(n)), best) < n / 2
    assert best.rows == [(20_000, 0)]
    assert ranked.read_lists([(d, i.clip(max=900), w) for d, i, w in lists], n, list(range(n, 2 * n)), best) == 0 and best.rows == [(20_000, 0)]


def brute_scan(text):
    words = PATTERN.findall(fold(text))
    starts = [(i, name) for name, phrase in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined = f" {' '.join(words)} "
    more = {name for name, t in licenses.TEMPLATES if re.search(licenses.pattern(t), joined)}
    return len(words), sorted(starts), sorted(more | {name for _, name in starts})


TEXT_OF_MIT = """The MIT License (MIT)

Copyright (c) 2020 Somebody, Ltd.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""


def test_scan_against_patterns(spark):
    rng = random.Random(6)
    spelled = [t for _, t in (*licenses.BASE, *licenses.TEMPLATES)]
    rows = []
    for k in range(300):
        t = rng.choice(spelled)
        t = re.sub(r"\{\w+:(\d+)-(\d+)\}", lambda m: " ".join(["some"] * rng.randint(int(m[1]), int(m[2]) + rng.choice([0, 0, 1]))), t)
        t = re.sub(r"\{\w+:([^{}]*)\}", lambda m: rng.choice(m[1].split("|")), t)
        while "[" in t:
            t = re.sub(r"\[([^\[\]]*)\]", lambda m: rng.choice([m[1], ""]), t)
        words = t.split()
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "other"
        rows.append((k, f"{rng.choice(['', 'Under ', 'x ', 'under the '])}{'-'.join(words).title()}{rng.choice(['', ' z', ' 4.0', '. cc by nc cc BY nc under the MIT license'])}"))
    rows += [(900, None), (901, ""), (902, TEXT_OF_MIT), (903, TEXT_OF_MIT.replace("merge, ", "")), (904, "cc by nc " * 30_000), (905, "licençe cc byé nc"), (906, "under the mit"), (907, "under"), (None, "CC BY-NC"), (3, rows[3][1])]
    got = licenses.scan(frame(spark, rows).repartition(2)).collect()
    want = sorted(((k, *brute_scan(t)) for k, t in rows), key=repr)
    seen = sorted(((r["doc_id"], r["n_words"], sorted((m["start"], m["label"]) for m in r["matches"] if m["base"]), sorted({m["label"] for m in r["matches"]})) for r in got), key=repr)
    assert seen == want
    by_id = {r["doc_id"]: r for r in got}
    assert {m["label"] for m in by_id[902]["matches"]} == {"mit"} and max(m["words"] for m in by_id[902]["matches"]) == 49
    assert max((m["words"] for m in by_id[903]["matches"]), default=0) < 20
    assert licenses.scan(frame(spark, [])).count() == 0


def test_markup():
    a = licenses.Automaton(["one [two [three]] {x:0-2} end", "one {y:a b|c} stop"])
    take = lambda text: a.accepted([a.code.get(w, -1) for w in text.split()])
    assert take("one end") == {0: 2} and take("one two three q q end") == {0: 6} and take("one two two two end") == {0: 5} and take("one q q q end") == {}
    assert take("one a b stop") == {1: 4} and take("one c stop") == {1: 3} and take("one a stop") == {} and take("two end") == {}
    assert licenses.longest(licenses.parse("a [b {x:1-3}] {y:a b|c}")) == 7 and licenses.mandatory("a [b] {x:1-2} c") == 2
    for bad in ("a [b", "a] b"):
        with pytest.raises(ValueError):
            licenses.parse(bad)
