"""Exact dedup: static binary-fuse filters of immutable snapshots screen the digests of incoming batches.

A snapshot is a written table of the classes that were new in its batch, dealt into buckets by digest; each bucket has a filter
of 16 bits a digest. Neither is touched again. An incoming batch is first grouped by itself. Its digests then pass the filters of
all snapshots before it, bucket by bucket: negatives are new for certain and are appended as they are; positives join the exact
bucket on the full digest, and the texts of each pair are compared byte by byte. Equal ones become members of the class they met;
false positives and texts that merely share a digest are new classes, appended too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from cityloom.llm.common import drop_table, partitions, write_table

#: A class within a batch: its digest, and a second hash that tells texts apart which share one.
KEY = ["digest", "check"]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digests that one filter holds on average at most, so that a bucket fits a task easily.
BUCKET_DIGESTS = 65_536


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class BinaryFuse16:
    """Static three-way binary fuse filter of distinct 64-bit keys: no false negative, about 1 in 65,536 false positives."""

    def __init__(self, seed: int, segment: int, segments: int, table: np.ndarray):
        self.seed, self.segment, self.segments, self.table = seed, segment, segments, table

    @staticmethod
    def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
        """Three places of each key, in three consecutive segments."""
        first = ((h >> np.uint64(40)) * np.uint64(segments)) >> np.uint64(24)
        low = np.uint64(segment - 1)
        return np.stack([(first + np.uint64(k)) * np.uint64(segment) + ((h >> np.uint64(13 * k)) & low) for k in range(3)]).astype(np.int64)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        return (_mix(h, 3) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse16:
        keys = np.unique(np.asarray(keys).astype(np.uint64))
        n = len(keys)
        segment = 1 << min(12, max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        spare = 1.2 if n > 10_000 else 1.6 if n > 300 else 3.0
        for seed in range(1, 400):
            segments = max(1, int(np.ceil(n * spare * (1 + seed // 20 * 0.1) / segment)) - 2)
            h = _mix(keys, seed)
            at = cls._places(h, segment, segments)
            size = (segments + 2) * segment
            many = np.bincount(at.ravel(), minlength=size)
            who = np.zeros(size, np.int64)
            for k in range(3):
                np.bitwise_xor.at(who, at[k], np.arange(n))
            rounds, left = [], n
            while left:
                alone = np.flatnonzero(many == 1)
                if not len(alone):
                    break
                key, index = np.unique(who[alone], return_index=True)
                rounds.append((key, alone[index]))
                for k in range(3):
                    np.subtract.at(many, at[k][key], 1)
                    np.bitwise_xor.at(who, at[k][key], key)
                left -= len(key)
            if left:
                continue
            table, prints = np.zeros(size, np.uint16), cls._prints(h)
            for key, place in reversed(rounds):
                table[place] = 0
                table[place] = prints[key] ^ table[at[0][key]] ^ table[at[1][key]] ^ table[at[2][key]]
            return cls(seed, segment, segments, table)
        raise ValueError("no filter found")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(np.asarray(keys).astype(np.uint64), self.seed)
        a, b, c = self._places(h, self.segment, self.segments)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == self._prints(h)

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.segment, self.segments], np.int64).tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse16:
        return cls(*np.frombuffer(data[:24], np.int64).tolist(), np.frombuffer(data[24:], np.uint16))


@F.arrow_udf(StructType().add("digest", BinaryType()).add("check", LongType()))
def text_digest(text: pa.Array) -> pa.Array:
    """SHA-256, and a second hash, of texts with A-Z lower-cased, in UTF-8; null counts as empty."""
    low = [(t or "").encode().lower() for t in text.to_pylist()]
    digests = pa.array([hashlib.sha256(t).digest() for t in low], pa.binary())
    return pa.StructArray.from_arrays([digests, pa.array(np.array([xxhash.xxh64_intdigest(t) for t in low], np.uint64).view(np.int64))], ["digest", "check"])


def normalised(text):
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def _classes(rows: DataFrame, buckets: int) -> DataFrame:
    """Duplicates within a batch, grouped by digest and second hash (combined in each task before the shuffle)."""
    short = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    groups = rows.groupBy(*KEY).agg(F.max("id").alias("keep"), F.count("*").alias("size"))
    return groups.withColumn("short", short).withColumn("bucket", F.pmod(F.col("short"), F.lit(buckets)).cast("int"))


def snapshot_filters(snapshot: DataFrame) -> DataFrame:
    """``(bucket, filter)``: the static filter of each bucket of a written snapshot."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"bucket": [key[0]], "filter": [BinaryFuse16.build(rows["short"].to_numpy().view(np.uint64)).to_bytes()]})

    return snapshot.select("bucket", "short").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """batch with ``maybe``: whether a filter of its bucket, of any snapshot, holds the digest."""

    def ask(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        short, maybe = rows["short"].to_numpy().view(np.uint64), np.zeros(len(rows), bool)
        for f in held["filter"]:
            maybe |= BinaryFuse16.from_bytes(f).contains(short)
        return rows.assign(maybe=maybe)

    schema = "digest binary, check long, keep long, size long, bucket int, short long, maybe boolean"
    return batch.select(*KEY, "keep", "size", "bucket", "short").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(ask, schema)


def equal_bytes(pairs: DataFrame, docs: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """The pairs (digest, check, keep; snap_check, snap) whose two texts, fetched by the ids keep and snap, are equal byte for byte.

    Rows that share an id with another text are told apart by their hashes.
    """
    wanted = pairs.select(F.explode(F.array("keep", "snap")).alias("w")).distinct()
    # written, lest the hashes be taken of every text ahead of the join
    met = write_table(docs.join(wanted, F.col("id").eqNullSafe(F.col("w")), "left_semi").select("id", "text"), "met")
    texts = met.select("id", normalised(F.col("text")).alias("t"), hashed(F.col("text")).alias("h"))
    texts = texts.select("id", "t", "h.digest", "h.check").groupBy("id", *KEY).agg(F.min("t").alias("t"))
    a, b = (texts.select(*[F.col(c).alias(f"{side}_{c}") for c in texts.columns]) for side in "ab")
    own = F.col("keep").eqNullSafe(F.col("a_id")) & (F.col("digest") == F.col("a_digest")) & (F.col("check") == F.col("a_check"))
    other = F.col("snap").eqNullSafe(F.col("b_id")) & (F.col("digest") == F.col("b_digest")) & (F.col("snap_check") == F.col("b_check"))
    return pairs.join(a, own).join(b, other).where("a_t = b_t").select(*pairs.columns)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 2, hashed: Callable[[Column], Column] = text_digest) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of df.

    Rows are dealt into batches by a hash of their id; each batch is screened by the filters of the snapshots before it, and its
    new classes then become a snapshot themselves. Texts are equal when identical after lower-casing A-Z; null counts as empty. Of
    equal texts the largest id stays; rows that share that id too all stay. A null id is smaller than any other. Texts of any
    length are hashed and compared whole. An empty table gives an empty result; other columns are not read, so their names can't
    clash. hashed gives (digest, check) of a text; text_sha256 is the digest in hex.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = docs.select("id", hashed(F.col("text")).alias("h")).select("id", "h.digest", "h.check", F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"))
    rows = write_table(rows, "digests")
    buckets = max(4 * 128, -(-rows.count() // BUCKET_DIGESTS), 2 * partitions(spark))
    known, filters, members = [], [], []
    for b in range(batches):
        new = _classes(rows.where(F.col("batch") == b), buckets)
        if known:
            screened = write_table(screen(new, reduce(DataFrame.union, filters)), "screened")
            held = reduce(DataFrame.union, known).select("digest", F.col("check").alias("snap_check"), F.col("keep").alias("snap"), "born")
            met = write_table(equal_bytes(screened.where("maybe").join(held, "digest"), docs, hashed), "met")
            members.append(met.select(F.lit(b).alias("batch"), *KEY, "keep", "size", "born", F.col("snap_check").alias("root")))
            # negatives pass as they are; only positives are looked up among what was met
            new = screened.where("NOT maybe").drop("maybe").unionByName(screened.where("maybe").drop("maybe").join(met.select(*KEY), KEY, "left_anti"))
        snapshot = write_table(new.select(*KEY, "keep", "size", "short", "bucket", F.lit(b).alias("born")), "snapshot")
        members.append(snapshot.select(F.col("born").alias("batch"), *KEY, "keep", "size", "born", F.col("check").alias("root")))
        known.append(snapshot)
        if b < batches - 1:
            filters.append(write_table(snapshot_filters(snapshot), "filters"))
    all_members = reduce(DataFrame.unionByName, members)
    totals = all_members.groupBy("digest", "born", "root").agg(F.max("keep").alias("keep_id"), F.sum("size").alias("group_size"))
    classes = write_table(all_members.drop("keep", "size").join(totals, ["digest", "born", "root"]).select("batch", *KEY, "keep_id", "group_size"), "classes")
    for table in filters:
        drop_table(table)
    out = rows.join(classes, ["batch", *KEY])
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
