"""The corpus pipeline: toxic documents go, then exact copies, then near copies; sources are mixed; the rest becomes tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cityloom.llm import exact_dedup, mixing, ngram_join, pieces, toxicity
from cityloom.llm.common import bounded_batches, write_table
from cityloom.llm.queries import toxicity_model


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labelled documents at hand, does not call toxic.

    Each row is judged by its whole text, of any length; null and empty texts get the score of the empty text and stay. Repeated rows
    and rows that share an id are judged alike, each for itself. Columns of any other name go through. Without rows, or without
    labels, nothing is dropped.
    """
    bounded_batches(spark)
    text, score = fresh(docs, "judged"), fresh(docs, "score")
    scored = toxicity.score(docs.withColumn(text, F.col("text")), toxicity_model(spark, docs, sf_dir), text, score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written once, so that it stays the same; rows that share an id, or have none, are told apart by it."""
    number = fresh(docs, "row_number")
    return write_table(docs.withColumn(number, F.monotonically_increasing_id()), "numbered"), number


def _chosen(rows: DataFrame, number: str, classes: DataFrame, best: Column) -> DataFrame:
    """Of every class (n, class) of rows the one for which best, of doc_id and n, is least."""
    ids = rows.select(F.col(number).alias("n"), "doc_id")
    one = classes.join(ids, "n").groupBy("class").agg(F.min(best).alias("b")).select(F.col("b.n").alias(number))
    return rows.join(one, number, "left_semi").drop(number)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (but for the case of A-Z; null is empty) one: that of the largest id, null being the smallest.

    Decided on rows: of repeated rows one stays, and a row that shares its id with another text stands for itself. Texts of any
    length are compared whole; columns of any other name go through; an empty table stays empty.
    """
    bounded_batches(spark)
    rows, number = _numbered(docs)
    classes = exact_dedup.exact_dedup(rows, number).select(F.col("doc_id").alias("n"), F.col("keep_id").alias("class"))
    return _chosen(rows, number, classes, F.struct((-F.col("doc_id")).isNull().alias("none"), (-F.col("doc_id")).alias("id"), "n"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8, over any chain of links) the row with the smallest id, null being the largest.

    Decided on rows, repeated ones and those without an id included. Null, empty and blank texts link with nothing and stay. Texts of
    any length count whole; columns of any other name go through; an empty table stays empty.
    """
    bounded_batches(spark)
    rows, number = _numbered(docs)
    classes = ngram_join.ngram_join(rows, id_col=number).select(F.col("doc_id").alias("n"), F.col("component_id").alias("class"))
    return _chosen(rows, number, classes, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "n"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, or up to three times.

    Null texts have no words; a null source is one of its own, the last. Repeated rows share a place in the ranking and are taken
    together; ties of size go by a hash. Texts of any length count whole; columns of any other name go through; an empty table stays empty.
    """
    bounded_batches(spark)
    return mixing.repeated(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids, with the check that they decode to the text.

    One row for each row, repeated ones included. A null text has null ids and no tokens, an empty one no ids; both come back as they
    were. Texts of any length are encoded whole; other columns are not returned, so their names can't clash; an empty table stays empty.
    """
    bounded_batches(spark)
    both = pieces.decode(pieces.encode(docs.select("doc_id", "lang", "source", "text")))
    return both.select("doc_id", "lang", "source", "token_ids", F.coalesce(F.size("token_ids"), F.lit(0)).cast("long").alias("n_tokens"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]

#: Compression, MinHash and the tokenizer have no form in SQL; tests hold each stage against a brute-force version of its own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage{k}")
    return docs
