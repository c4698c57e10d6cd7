"""Keyword automaton against regular expressions, phrase conversion against a greedy loop."""

import random
import re

import pyarrow as pa
import pytest

from cityloom.functions import automata as au
from cityloom.sources import files


def by_regex(words, text, borders=True):
    parts = [rf"\b{re.escape(w)}\b" if borders and re.fullmatch(r"[a-zA-Z0-9\s\-.]+", w) else re.escape(w) for w in sorted((w for w in words if len(w) > 1), key=lambda w: (-len(w), w))]
    return re.findall("|".join(parts), text or "") if parts else []


@pytest.mark.parametrize("stretch", [4, 512])
@pytest.mark.parametrize("borders", [True, False])
def test_keywords_against_a_regular_expression(monkeypatch, stretch, borders):
    monkeypatch.setattr(au, "STRETCH", stretch)
    rng = random.Random(stretch)
    letters = ["a", "b", "c", " ", "-", ".", "_", "1", "厂", "楼", "é", "#", "𠀀"]
    word = lambda n: "".join(rng.choice(letters[:8] if rng.random() < 0.5 else letters) for _ in range(n))
    for size in (0, 1, 5, 60, 3000):
        words = [word(rng.randint(1, 5)) for _ in range(size)]
        texts = [None, "", "a"] + [word(rng.choice([3, 20, 200])) for _ in range(60)] + [" ".join(rng.choices(words, k=10)) if words else ""]
        got = au.Keywords(words, borders).hits(pa.array(texts, pa.string())).to_pylist()
        assert got == [by_regex(set(words), t, borders) for t in texts]


def greedy(table, text):
    if text is None:
        return None
    out, k, longest = "", 0, max(map(len, table), default=0)
    while k < len(text):
        n = next((n for n in range(longest, 0, -1) if text[k : k + n] in table and len(text[k : k + n]) == n), 0)
        out += table[text[k : k + n]] if n else text[k]
        k += n or 1
    return out


def test_phrases_against_a_greedy_loop(spark):
    rng = random.Random(1)
    letters = "ab乾隆後皇發头𠀀 "
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for size in (0, 3, 40, 400):
        table = {word(rng.randint(1, 4)): rng.choice(["", "X", "yy", word(2)]) for _ in range(size)}
        texts = [None, "", "a"] + [word(rng.choice([2, 30, 500])) for _ in range(50)]
        assert au.Phrases(table).convert(pa.array(texts, pa.string())).to_pylist() == [greedy(table, t) for t in texts]
    rows = spark.createDataFrame([("乾", "干"), ("乾隆", "乾隆"), ("後", "后"), ("皇后", "皇后"), ("頭髮", "头发"), ("發", "发"), (None, "x"), ("乾", "龘")], "phrase string, to string")
    df = spark.createDataFrame([(1, "乾隆皇后在後面乾"), (2, None), (3, "")], "k long, t string")
    got = {r["k"]: r["c"] for r in au.converted(df, df["t"], au.phrases_of(rows), "c").collect()}
    assert got == {1: "乾隆皇后在后面干", 2: None, 3: ""}


def test_tables_have_a_checked_size(spark, monkeypatch):
    monkeypatch.setattr(au, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        au.keywords_of(spark.range(5).selectExpr("cast(id as string) as keyword"))
    words = au.keywords_of(spark.createDataFrame([("ab",), (None,), ("ab",), ("c d",)], "keyword string"))
    df = spark.createDataFrame([(1, "x ab c d"), (2, None)], "k long, hits string")
    assert {r["k"]: r["h"] for r in au.with_hits(df, df["hits"], words, "h").collect()} == {1: ["ab", "c d"], 2: []}


def test_phrase_file(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# fixed\n乾隆\t乾隆\n乾\t干 乾\n\n後\t后\n", encoding="utf-8")
    rows = files.phrase_table(spark, str(tmp_path / "t.txt"))
    assert sorted(map(tuple, rows.collect())) == [("乾", "干"), ("乾隆", "乾隆"), ("後", "后")]
