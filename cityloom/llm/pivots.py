"""Embedding near-dedup by a pivot-permutation index.

A vector is described by its nearest reference points (pivots), in order. Inverted lists hold, for each pivot, the vectors that
have it among their nearest; two vectors of a list that share enough pivots are verified by their cosine in double precision.
Pivots are a bounded sample of the vectors, thinned so that no two are near each other; every vector is indexed. Equal vectors are one entry with a weight. A pair is looked
at in the list of the smallest pivot that both have; a long list is split by the second smallest one, which loses nothing as two
are demanded. Lists are dealt into blocks, so that any list fits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.blocks import block_pairs, grouped, lists
from cityloom.llm.common import partitions, write_table
from cityloom.llm.components import connected_components, forest

NEAREST, SHARED, BLOCK = 10, 2, 1024
#: Vectors whose cosines with the rest of a block are taken at once.
TILE = 256
#: Blocks up to which a list is not split by a second pivot.
NARROW = 4
#: Pivots are 4 for each root of the number of vectors, within these bounds: that is all of the index that is broadcast.
PIVOTS = (16, 4096)
#: Cosine from which a vector is too near a chosen pivot to be one. A group of near copies so has one pivot at most, and its members
#: share that one and the others around the group; with many pivots inside it, the order of those would be noise.
NEAR = 0.7


def usable(vector):
    """Not null or zero, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(flat: np.ndarray, rows: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def thinned(x: np.ndarray, many: int, threshold: float, step: int = 256) -> np.ndarray:
    """Rows of x (unit vectors), in turn, that are not near an earlier one of them; at most many.

    Near is a cosine of NEAR. Where most vectors are nearer than that, it lies between their median cosine and the threshold, so
    that vectors in a narrow cone still have pivots; it is never above the threshold.
    """
    some = x[:512]
    middle = np.median((some @ some.T)[np.triu_indices(len(some), 1)]) if len(some) > 1 else 0.0
    near = min(threshold, max(NEAR, (middle + threshold) / 2 if middle > NEAR else NEAR))
    kept = np.empty((0, x.shape[1]))
    for at in range(0, len(x), step):
        part = x[at : at + step]
        part = part[(part @ kept.T < near).all(axis=1)]
        alike, own = part @ part.T >= near, []
        for i in range(len(part)):
            if not alike[i, own].any():
                own.append(i)
        kept = np.concatenate([kept, part[own]])
        if len(kept) >= many:
            break
    return kept[:many]


def choose_pivots(vectors: DataFrame, count: int, threshold: float) -> np.ndarray:
    """Thinned from twice as many vectors with the smallest hash: at most 2 x PIVOTS[1] of them reach the driver."""
    many = max(PIVOTS[0], min(PIVOTS[1], int(4 * math.sqrt(count))))
    rows = vectors.select(F.xxhash64("id", "v").alias("o"), "v").orderBy("o").limit(2 * many).toArrow().column("v").combine_chunks()
    rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
    return thinned(_unit(np.asarray(rows.flatten()), len(rows)), many, threshold)


def permutations(vectors: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """vectors (id, v) with ``order``: their nearest pivots, the closest first."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.arrow_udf("array<int>")
    def order(v: pa.Array) -> pa.Array:
        p = shared.value
        k = min(nearest, len(p))
        if not len(v):
            return pa.array([], pa.list_(pa.int32()))
        at = np.asarray(v.offsets)
        close = _unit(np.asarray(v.values)[at[0] : at[-1]], len(v)) @ p.T
        top = np.argpartition(-close, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(close, top, 1), axis=1, kind="stable"), 1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * k, pa.int32()), pa.array(top.ravel().astype(np.int32)))

    return vectors.withColumn("order", order("v"))


def _search(threshold: float, least: int):
    def work(rows: pa.Table) -> list[pa.RecordBatch]:
        pivot, second, i, j = (rows.column(k)[0].as_py() for k in ("pivot", "second", "i", "j"))
        ids, weight, side = (np.asarray(rows.column(k).combine_chunks()) for k in ("id", "weight", "side"))
        p = np.flatnonzero(side == 0)
        q = p if i == j else np.flatnonzero(side == 1)
        if not len(p) or not len(q) or i == j and len(p) < 2:
            return []
        flat, _ = lists(rows, "v")
        x = _unit(flat, len(ids))
        order, _ = lists(rows, "order")
        used, place = np.unique(order, return_inverse=True)
        has = np.zeros((len(ids), len(used)), np.float32)
        has[np.repeat(np.arange(len(ids)), len(order) // len(ids)), place] = 1
        demanded = min(least, len(order) // len(ids))
        # pairs that share a pivot before those of this list belong to another one
        before = np.flatnonzero((used < pivot) | (used != pivot) & (used < second))
        ahead = has[:, before]
        pairs = []
        for at in range(0, len(p), TILE):
            m = p[at : at + TILE]
            n = p[at:] if i == j else q
            alike = (has[m] @ has[n].T >= demanded) & (x[m] @ x[n].T >= threshold)
            if len(before):
                alike &= ahead[m] @ ahead[n].T == 0
            a, b = np.nonzero(np.triu(alike, 1) if i == j else alike)
            pairs.append((m[a], n[b]))
        a, b = (np.concatenate(side) for side in zip(*pairs))
        if not len(a):
            return []
        links = np.bincount(a, weight[b], len(ids)) + np.bincount(b, weight[a], len(ids))
        node, root = forest(ids[a], ids[b])
        hit = np.flatnonzero(links)
        found = np.concatenate([links[hit], np.zeros(len(node))]).astype(np.int64)
        return [pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[hit], node])), pa.array(found), pa.array(np.concatenate([ids[hit], root]))], names=["id", "links", "root"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from grouped(batches, ["pivot", "second", "i", "j"], work)

    return run


def dealt_lists(seen: DataFrame, shared: int, narrow: int = NARROW) -> DataFrame:
    """Entries (id, weight, v, order) of every inverted list, dealt into pairs of blocks: ``pivot, second, i, j, side``.

    Where two shared pivots are demanded, lists of more than narrow blocks are split by the second smallest pivot; second is -1
    for the others.
    """
    columns = ["id", "weight", "v", "order", "pivot", "second"]
    entries = seen.withColumn("pivot", F.explode("order"))
    blocks = F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")
    # as many rows as pivots: at most PIVOTS[1]
    sizes = write_table(entries.groupBy("pivot").agg(blocks), "lists")
    whole = sizes.where(F.col("blocks") <= narrow) if shared > 1 else sizes
    out = entries.join(F.broadcast(whole), "pivot").withColumn("second", F.lit(-1)).select(*columns, "blocks")
    long = sizes.where(F.col("blocks") > narrow).select("pivot")
    if shared > 1 and long.limit(1).count():
        split = entries.join(F.broadcast(long), "pivot").withColumn("second", F.explode(F.filter("order", lambda x: x > F.col("pivot"))))
        parts = split.groupBy("pivot", "second").agg(blocks)
        out = out.unionByName(split.join(parts, ["pivot", "second"]).select(*columns, "blocks"))
    return out.select(*columns, F.explode(block_pairs(F.col("id"), F.col("blocks"))).alias("p")).select(*columns, "p.*")


def near_dedup(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, shared: int = SHARED, narrow: int = NARROW) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of df.

    Pivots equally near go by their number. Links are pairs that share at least ``shared`` of their ``nearest`` pivots and have a cosine of at least threshold; none is
    below it. Vectors that are null, zero or hold null or non-finite components link with nothing. Vectors of different lengths
    are compared among themselves. Rows that share an id are one node, with the vector of the smallest hash; a null id links
    with nothing. Equal vectors are one class, whatever their number, and link with each other. An empty table gives an empty
    result; other columns are not read.
    """
    spark = df.sparkSession
    vector = F.col(vector_col) if dict(df.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))
    good = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    key = F.struct(F.size("v").alias("n"), F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), "v").alias("b"))
    nodes = write_table(good.groupBy("id").agg(F.min(key).alias("k")).select("id", "k.*"), "nodes")
    classes = write_table(nodes.groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    picked = good.withColumn("k", key).join(classes, (F.col("id") == F.col("rep")) & (F.col("k.n") == F.col("n")) & (F.col("k.a") == F.col("a")) & (F.col("k.b") == F.col("b")))
    found = None
    for length, count in sorted((r["n"], r["count"]) for r in classes.groupBy("n").count().collect()):
        same = picked.where(F.col("n") == length).select("id", "v", "weight").dropDuplicates(["id"])
        seen = write_table(permutations(same, choose_pivots(same, count, threshold), nearest), "permuted")
        dealt = dealt_lists(seen, shared, narrow)
        keyed = dealt.repartition(partitions(spark), "pivot", "second", "i", "j").sortWithinPartitions("pivot", "second", "i", "j", "side", "id")
        links = write_table(keyed.mapInArrow(_search(threshold, shared), "id long, links long, root long"), "links")
        found = links if found is None else found.union(links)
    if found is None:
        found = spark.createDataFrame([], "id long, links long, root long")
    parts = connected_components(found.where("id <> root").select(F.col("id").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "rep")
    per_class = classes.join(found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("far")), "rep", "left").join(parts, "rep", "left")
    per_class = per_class.select("n", "a", "b", (F.col("weight") - 1 + F.coalesce("far", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    per_node = nodes.join(per_class, ["n", "a", "b"]).select(F.col("id").alias("node"), "links", "component")
    out = rows.select("id").join(per_node, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
