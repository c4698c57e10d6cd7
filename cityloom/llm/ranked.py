"""Ranked lexical search by the no-random-access algorithm over impact-sorted postings.

Documents are read twice. First each becomes its length and its counts of query terms, which also gives the statistics of the
corpus. Then every task builds inverted lists of a block of documents, sorted by impact, and answers all queries on it: lists are
read from the front only, a document's score lies between the sum of what was read of it and that sum with the last impact read of
every list it was not yet seen in, and reading goes on until no other document can enter the best k or tie with them unnoticed and
the scores of the best are exact. A task carries the best k of a query on to its next block, so that later blocks stop earlier. The
best of all tasks, at most k a query and task, are ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.llm.common import drop_table, write_table
from cityloom.llm.words import WORD, Vocabulary, Words

#: Postings and documents of a block; terms of a block of queries.
BLOCK_POSTINGS, BLOCK_DOCS, BLOCK_TERMS = 1 << 20, 1 << 15, 100_000
#: Entries of each list in the first turn; every turn reads twice as many as the one before.
FIRST_READ = 64


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    m = 10 + (90 * length * n_docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def term_counts(docs: DataFrame, doc_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, length, codes, counts`` of every document with a term: its terms with repeats, and how often it holds those of the vocabulary."""
    rows = docs.select(F.col(doc_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = known.value
        size = max(len(vocabulary.words), 1)
        for batch in batches:
            words = Words(batch.column("text"))
            codes = vocabulary.codes(words)
            hit = codes >= 0
            key, count = np.unique(words.row[hit] * size + codes[hit], return_counts=True)
            at = np.searchsorted(key // size, np.arange(words.rows + 1)).astype(np.int32)
            listed = lambda x, kind: pa.ListArray.from_arrays(pa.array(at), pa.array(x, kind))
            out = {"doc_id": batch.column("doc_id"), "length": pa.array(words.counts, pa.int64()), "codes": listed((key % size).astype(np.int32), pa.int32()), "counts": listed(count.astype(np.int32), pa.int32())}
            yield pa.RecordBatch.from_pydict(out).filter(pc.greater(pa.array(words.counts), 0))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, length long, codes array<int>, counts array<int>")


class Best:
    """The best k of a query so far, exact: (score, id), equal scores by id, null ids last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def add(self, rows: list[tuple[int, object]]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: (-r[0], r[1] is None, r[1]))[: self.k]


def read_lists(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, ids: list, best: Best) -> int:
    """Take the documents of a block into best. lists: (documents, impacts, weight), highest impact first; ids in order. Returns how many entries were read."""
    lower = np.zeros(n_docs, np.int64)
    seen = np.zeros((len(lists), n_docs), bool)
    bottom = np.array([w * int(i[0]) for _, i, w in lists], np.int64)
    floor = [s for s, _ in best.rows]
    depth, step, read = 0, FIRST_READ, 0
    while True:
        touched = seen.any(0) if depth else np.zeros(n_docs, bool)
        open_sum = int(bottom.sum())
        upper = lower + open_sum - bottom @ seen
        found = np.flatnonzero(touched & (lower > 0))
        if len(found) > best.k:
            least = np.partition(lower[found], len(found) - best.k)[len(found) - best.k]
            found = found[lower[found] >= least]
        found = found[np.argsort(-lower[found], kind="stable")][: best.k]
        merged = sorted([(-s, d is None, d, -1) for s, d in best.rows] + [(-int(lower[d]), ids[d] is None, ids[d], int(d)) for d in found])[: best.k]
        mine = [d for *_, d in merged if d >= 0]
        full = len(merged) == best.k
        last = -merged[-1][0] if full else 0
        if open_sum == 0 or (full and open_sum < last):
            rivals = touched & (upper >= max(last, 1)) if full else touched & (upper > lower)
            rivals[mine] = False
            ahead = bool((upper[rivals] > last).any()) if full else bool(rivals.any())
            if not ahead and full:
                tied = np.flatnonzero(rivals)
                ahead = any((ids[d] is None, ids[d]) < merged[-1][1:3] for d in tied.tolist()) if len(tied) else False
            if not ahead and (upper[mine] == lower[mine]).all():
                best.rows = [(-s, i) for s, _, i, _ in merged]
                return read
        for t, (docs, impacts, w) in enumerate(lists):
            part = slice(depth, depth + step)
            if depth < len(docs):
                lower[docs[part]] += w * impacts[part]
                seen[t, docs[part]] = True
                read += len(docs[part])
            bottom[t] = w * int(impacts[depth + step - 1]) if depth + step < len(docs) else 0
        depth, step = depth + step, 2 * step


def _answer(table: pa.Table, queries: list[tuple[np.ndarray, list]], weights: np.ndarray, n_docs: int, total: int, best: list[Best]) -> None:
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
    ids = table.column("doc_id").to_pylist()
    codes, counts = (table.column(c).combine_chunks() for c in ("codes", "counts"))
    codes, counts = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (codes, counts))
    per_doc = np.diff(np.asarray(codes.offsets))
    doc = np.repeat(np.arange(len(ids)), per_doc)
    length = np.asarray(table.column("length"))[doc]
    code, tf = np.asarray(codes.flatten()), np.asarray(counts.flatten()).astype(np.int64)
    score = impact(tf, length, n_docs, total)
    order = np.lexsort((doc, -score, code))
    code, doc, score = code[order], doc[order], score[order]
    at = np.searchsorted(code, np.arange(len(weights) + 1))
    for q, terms in enumerate(queries):
        lists = [(doc[at[t] : at[t + 1]], score[at[t] : at[t + 1]], int(weights[t])) for t in terms.tolist() if weights[t] > 0 and at[t + 1] > at[t]]
        if lists:
            read_lists(lists, len(ids), ids, best[q])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, postings = [], 0, 0
    for batch in batches:
        held.append(batch)
        docs, postings = docs + batch.num_rows, postings + len(batch.column("codes").flatten())
        if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held)
            held, docs, postings = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held)


def _search_block(docs: DataFrame, items: list, k: int, doc_col: str, text_col: str) -> DataFrame:
    """``query (place in items), doc_id, score``: the best k of every task, written to the shared folder."""
    spark = docs.sparkSession
    vocabulary = Vocabulary([t for i in items for t in i["terms"]])
    index = write_table(term_counts(docs, doc_col, text_col, vocabulary), "postings")
    n_docs, total = index.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    df = {r["code"]: r["df"] for r in index.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")).collect()}
    place = {w: c for c, w in enumerate(vocabulary.words)}
    shared = spark.sparkContext.broadcast(([np.array([place[t] for t in i["terms"]], np.int64) for i in items], np.array([weight(n_docs, df[c]) if c in df else 0 for c in range(len(place))], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        best = [Best(k) for _ in queries]
        kind = None
        for table in _blocks(batches):
            kind = table.schema.field("doc_id").type
            _answer(table, queries, weights, n_docs, total, best)
        rows = [(q, d, s) for q, b in enumerate(best) for s, d in b.rows]
        if rows:
            q, d, s = zip(*rows)
            yield pa.RecordBatch.from_pydict({"query": pa.array(q, pa.int32()), "doc_id": pa.array(d, kind), "score": pa.array(s, pa.int64())})

    kind = index.schema["doc_id"].dataType.simpleString()
    found = write_table(index.mapInArrow(run, f"query int, doc_id {kind}, score long"), "ranked")
    drop_table(index)
    return found


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of each row of items, those with a score above 0.

    All documents are read whole. Items are dealt into blocks of about block_terms terms, so that what is sent to all tasks is
    bounded; each block reads the documents once. Null texts have no terms; items without terms and items none of whose terms is in a
    document have no row. Every row of docs is a document and every row of items an item, repeated ids included; among equal
    scores the smaller id comes first, null ids last. An empty table gives an empty result; other columns are not read.
    """
    folded = F.translate(F.coalesce(F.col(item_text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select(F.col(item_col).alias("item_id"), F.array_sort(F.array_distinct(F.regexp_extract_all(folded, F.lit(WORD), F.lit(0)))).alias("terms"))
    asked = asked.where(F.size("terms") > 0)
    blocks = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms))
    out = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == b).collect() if blocks > 1 else asked.collect()
        part.sort(key=lambda r: (r["item_id"] is None, str(r["item_id"]), r["terms"]))
        found = _search_block(docs, part, k, doc_col, text_col)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        kind = asked.schema["item_id"].dataType.simpleString()
        names = docs.sparkSession.createDataFrame([(n, r["item_id"]) for n, r in enumerate(part)], f"query int, item_id {kind}")
        rows = top.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = rows if out is None else out.unionByName(rows)
    return out
