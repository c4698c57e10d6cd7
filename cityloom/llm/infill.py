"""Fill-in-middle transformation with content-defined chunk memoization.

A text is cut into tokens (a run of ASCII letters, or one other code point) and rearranged as prefix, suffix and middle between
sentinels. Where the cuts lie follows from the number of tokens, and that is put together from chunks: a rolling hash over 32
bytes says where chunks end, so that equal passages of different documents give equal chunks. For each chunk a task remembers,
by its whole content, a boundary summary: tokens, code points, and whether it begins and ends with a letter. Counts of chunks
add up, less one wherever a run of letters goes on across a border; a cut is looked up in the running counts, and only the
chunk that it falls into is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.llm.words import text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A chunk ends where the low bits of the rolling hash are 0 (512 bytes on average), not within 64 bytes of another such place, and after 4096 bytes at the latest.
BITS, NEAR, MOST = 9, 64, 4096
#: Bytes of chunks that a task remembers; beyond it starts anew.
MEMO_BYTES = 32 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80
_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts begin: at each text, after each place that the rolling hash marks, and in overlong stretches."""
    h = _GEAR[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    hit = (h >> np.uint32(32 - BITS)) == 0
    begin, end = off[:-1], off[1:]
    for a, b in zip(begin.tolist(), end.tolist()):
        hit[a : min(a + 31, b)] = False
        if b > a:
            hit[b - 1] = False
    at = np.flatnonzero(hit) + 1
    at = at[_HEAD[data[at]]]
    text = np.searchsorted(end, at, side="right")
    at = at[(np.diff(at, prepend=0) > NEAR) | (np.diff(text, prepend=-1) > 0)]
    at = np.unique(np.concatenate([begin[end > begin], at]))
    gap = np.diff(at, append=off[-1])
    more = (gap - 1) // MOST
    if more.any():
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        extra = np.repeat(at, more) + nth * MOST
        for _ in range(3):
            extra -= ~_HEAD[data[extra]]
        at = np.unique(np.concatenate([at, extra]))
    return at


class Memo:
    """Boundary summaries of chunks by content: (tokens, code points, begins with a letter, ends with a letter)."""

    def __init__(self, most: int = MEMO_BYTES):
        self.most, self.held, self.known, self.computed = most, 0, {}, 0

    def summaries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        keys = [raw[a:b] for a, b in zip(start.tolist(), end.tolist())]
        if self.held > self.most:
            self.known, self.held = {}, 0
        new = [k for k in dict.fromkeys(keys) if k not in self.known]
        if new:
            lengths = np.array([len(k) for k in new])
            self.known.update(zip(new, _summarize(np.frombuffer(b"".join(new), np.uint8), lengths)))
            self.held += int(lengths.sum())
            self.computed += len(new)
        return np.array([self.known[k] for k in keys], np.int64).reshape(-1, 4)


def _summarize(data: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, bool, bool]]:
    at = np.cumsum(lengths) - lengths
    tokens = token_starts(data, at)
    return zip(*(x.tolist() for x in (np.add.reduceat(tokens, at, dtype=np.int64), np.add.reduceat(_HEAD[data], at, dtype=np.int64), _LETTER[data[at]], _LETTER[data[at + lengths - 1]])))


def token_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a token begins at each byte, if runs of letters begin anew at the places at."""
    letter = _LETTER[data]
    runs = letter.copy()
    runs[1:] &= ~letter[:-1]
    runs[at] = letter[at]
    return runs | (_HEAD[data] & ~letter)


def _arranged(texts: pa.Array, plain: np.ndarray, first: np.ndarray, second: np.ndarray, suffix_first: np.ndarray, memo: Memo) -> dict[str, pa.Array]:
    data, off = text_bytes(texts)
    rows = len(texts)
    start = chunk_starts(data, off) if len(data) else np.zeros(0, np.int64)
    end = np.append(start[1:], off[-1])[: len(start)]
    tokens, chars, opens, closes = memo.summaries(data, start, end).T
    row = np.searchsorted(off[1:], start, side="right")
    goes_on = np.zeros(len(start), bool)
    goes_on[1:] = (row[1:] == row[:-1]) & (opens[1:] > 0) & (closes[:-1] > 0)
    sums = np.concatenate([[0], np.cumsum(tokens - goes_on)])
    points = np.concatenate([[0], np.cumsum(chars)])
    bounds = np.searchsorted(start, off)
    n = np.diff(sums[bounds])
    one, two = first % (n + 1), second % (n + 1)
    raw = data.tobytes()

    def locate(r: int, k: int) -> tuple[int, int]:
        """(byte, code point within the text) at which token k of text r begins."""
        if k >= n[r]:
            return int(off[r + 1]), int(points[bounds[r + 1]] - points[bounds[r]])
        want = int(sums[bounds[r]]) + k
        c = int(np.searchsorted(sums, want, side="right")) - 1
        chunk = data[start[c] : end[c]]
        begins = token_starts(chunk, np.zeros(0, np.int64) if goes_on[c] else np.zeros(1, np.int64))
        begins[0] &= not goes_on[c]
        place = int(np.flatnonzero(begins)[want - sums[c]])
        return int(start[c]) + place, int(points[c] - points[bounds[r]] + _HEAD[chunk[:place]].sum())

    out, before, within = [], [], []
    for r in range(rows):
        a, b = int(off[r]), int(off[r + 1])
        if plain[r] or a == b:
            out.append(raw[a:b])
            before.append(None)
            within.append(None)
            continue
        (p, pc), (q, qc) = locate(r, int(min(one[r], two[r]))), locate(r, int(max(one[r], two[r])))
        prefix, middle, suffix = raw[a:p], raw[p:q], raw[q:b]
        parts = (SUFFIX.encode(), suffix, PREFIX.encode(), prefix) if suffix_first[r] else (PREFIX.encode(), prefix, SUFFIX.encode(), suffix)
        out.append(b"".join((*parts, MIDDLE.encode(), middle)))
        before.append(pc)
        within.append(qc - pc)
    return {
        "n": pa.array(n, pa.int64()),
        "prefix_chars": pa.array(before, pa.int64()),
        "middle_chars": pa.array(within, pa.int64()),
        "n_chunks": pa.array(np.diff(bounds), pa.int64()),
        "output": pa.array(out, pa.binary()).cast(pa.string()),
    }


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, suffix_first_below: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, n_chunks, output``: one row per row of df.

    The cuts and the form follow from the SHA-256 of the seed and the id, so reruns and repeated rows agree. Texts that are empty or
    hold a sentinel, and those of a hundredth from plain_from on, stay plain: their output is the text, and prefix_chars and
    middle_chars are null. A null text is empty, a null id reads as no digits. Texts of any length are cut whole, each within
    its task; what a task remembers of chunks is bounded. An empty table gives an empty result; other columns are not read, so
    their names may clash. Nothing is shuffled.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (group(3) % 100 >= plain_from), "plain").when(group(4) % 100 < suffix_first_below, "spm").otherwise("psm")
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), group(1).alias("first"), group(2).alias("second"), form.alias("form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            form = batch.column("form")
            is_form = lambda name: np.array([x == name for x in form.to_pylist()], bool)
            made = _arranged(batch.column("text"), is_form("plain"), np.asarray(batch.column("first")), np.asarray(batch.column("second")), is_form("spm"), memo)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "form": form, **made})

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, form string, n long, prefix_chars long, middle_chars long, n_chunks long, output string")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "n_chunks", "output")


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)

    def halves(second: str) -> tuple[Column, Column]:
        return F.substr(F.substring_index(head, second, 1), F.lit(4)), F.substring_index(head, second, -1)

    prefix, suffix = halves(SUFFIX)
    late, early = halves(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, middle, late)).otherwise(output)
