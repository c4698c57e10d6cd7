"""Exact k nearest neighbours over any number of columns, by the cells of a k-d tree.

The tree is laid over a bounded sample, so that a cell has about as many different vectors as asked; every row is then in a cell. A vector
first looks in its own cell. The distance of the last one it needs bounds the cells that can have nearer ones, and only there it is
looked up again. Equal vectors are one: they ask once, and of them only as many stand to be found as one can need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityloom.sources.files import growing, stored

#: Different vectors of a cell, rows of the sample, vectors that ask in a cell at once, and in one task.
CELL, SAMPLE, BLOCK, ASKING = 1024, 100_000, 256, 65_536


class Tree:
    """Splits of a k-d tree: node n has the children 2n + 1 (at most the value) and 2n + 2; leaves have no dimension."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.depth = int(np.ceil(np.log2(max(leaves, 1)))) if len(sample) else 0
        self.dimension = np.full(2 ** (self.depth + 1) - 1, -1)
        self.value = np.zeros(len(self.dimension))
        todo = [(0, np.arange(len(sample)), 0)]
        while todo:
            node, rows, level = todo.pop()
            if level == self.depth or len(rows) < 2:
                continue
            own = sample[rows]
            wide = int(np.argmax(own.max(0) - own.min(0)))
            low, high = own[:, wide].min(), own[:, wide].max()
            if low == high:
                continue
            at = min(float(np.median(own[:, wide])), float(np.nextafter(high, low)))
            self.dimension[node], self.value[node] = wide, at
            right = own[:, wide] > at
            todo += [(2 * node + 1, rows[~right], level + 1), (2 * node + 2, rows[right], level + 1)]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            inner = self.dimension[node] >= 0
            right = x[np.arange(len(x)), np.maximum(self.dimension[node], 0)] > self.value[node]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def within(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of the leaves that may have a point within reach of each row."""
        rows, leaves = [], []
        todo = [(0, np.arange(len(x)), np.zeros(x.shape))]
        while todo:
            node, some, gap = todo.pop()
            if not len(some):
                continue
            d = self.dimension[node]
            if d < 0:
                rows.append(some)
                leaves.append(np.full(len(some), node))
                continue
            away = x[some, d] - self.value[node]
            for child, off in ((2 * node + 1, np.maximum(away, 0)), (2 * node + 2, np.maximum(-away, 0))):
                further = gap.copy()
                further[:, d] = np.maximum(further[:, d], off)
                near = (further * further).sum(1) <= reach[some] ** 2 * (1 + 1e-12)
                todo.append((child, some[near], further[near]))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def _matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)) for c in columns], 1) if columns else np.zeros((batch.num_rows, 0))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal keys, in order; one may come in several pieces."""
    for batch in batches:
        if batch.num_rows:
            cols = [np.asarray(batch.column(k)) for k in keys]
            change = np.any([c[1:] != c[:-1] for c in cols], 0)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield tuple(c[a] for c in cols), batch.slice(a, b - a)


def _search(columns: list[str], need: int):
    """Of rows sorted by cell and salt, those that can be found (side 0, by key) before those that ask (side 1): vid, d, found of the nearest within reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, keys, held, target = None, [], [], None
        for (cell, salt, side), rows in runs(batches, ["cell", "salt", "side"]):
            if (cell, salt) != place:
                place, keys, held, target = (cell, salt), [], [], None
            if side == 0:
                keys.append(rows.column("key"))
                held.append(_matrix(rows, columns))
                target = None
                continue
            if not held:
                continue
            if target is None:
                target, names = np.concatenate(held), pa.concat_arrays(keys)
                keys, held = [names], [target]
            ask, reach = _matrix(rows, columns), np.asarray(rows.column("reach"))
            for s in range(0, len(ask), BLOCK):
                some = ask[s : s + BLOCK]
                d = np.zeros((len(some), len(target)))
                for c in range(len(columns)):
                    d += (some[:, c : c + 1] - target[None, :, c]) ** 2
                d = np.sqrt(d)
                last = np.partition(d, need - 1, 1)[:, need - 1] if d.shape[1] > need else np.full(len(some), np.inf)
                i, j = np.nonzero(d <= np.minimum(last, reach[s : s + BLOCK])[:, None])
                order = np.lexsort((j, d[i, j], i))
                i, j = i[order], j[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < need
                i, j = i[keep], j[keep]
                yield pa.RecordBatch.from_arrays([rows.column("key").take(pa.array(s + i)), pa.array(d[i, j]), names.take(pa.array(j))], names=["vid", "d", "found"])

    return run


def _asked(found: DataFrame, asking: DataFrame, columns: list[str], need: int, kind: str) -> DataFrame:
    """``vid, d, found``: asking (cell, key, columns, reach) answered from found (cell, key, columns); a cell where very many ask is dealt to several tasks."""
    salts = asking.groupBy("cell").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("salts"))
    targets = found.join(growing(salts), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asks = asking.join(growing(salts), "cell").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts").cast("long")).cast("int"))
    wanted = ["cell", "salt", "key", *columns]
    both = targets.select(*wanted, F.lit(0).alias("side"), F.lit(0.0).alias("reach")).unionByName(asks.select(*wanted, F.lit(1).alias("side"), "reach"))
    dealt = both.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "side", "key")
    return dealt.mapInArrow(_search(columns, need), f"vid {kind}, d double, found {kind}")


def _first(rows: DataFrame, need: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("vid").orderBy("d", "found"))).where(F.col("rank") <= need)


def nearest(points: DataFrame, key: str, columns: list[str], k: int, cell: int = CELL, sample: int = SAMPLE) -> DataFrame:
    """``key, n_key, rank, d`` and the columns of the neighbour, prefixed by n_: the k nearest other points by Euclidean distance, fewer if there are no more.

    Ties go by key, which is unique and not null. Null columns count as 0. No list of neighbours longer than k + 1 comes about anywhere.
    """
    kind = points.schema[key].dataType.simpleString()
    cols = [f"c{n}" for n in range(len(columns))]
    rows = points.select(F.col(key).alias("key"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(n) for c, n in zip(columns, cols)])
    rows = stored(rows, "knn-rows")
    need = k + 1
    order = Window.partitionBy(*cols).orderBy("key")
    few = stored(rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= need), "knn-few")
    vectors = few.where("nth = 1").select("key", *cols)
    n = vectors.count()
    taken = vectors.orderBy(F.xxhash64(*cols)).limit(sample).select(*cols) if n > sample else vectors.select(*cols)
    tree = Tree(np.array([tuple(r) for r in taken.collect()], float).reshape(-1, len(cols)), -(-n // cell))
    known = points.sparkSession.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("cell", pa.array(known.value.leaf(_matrix(batch, cols))))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, leaf = known.value.within(_matrix(batch, cols), np.asarray(batch.column("reach")))
            other = leaf != np.asarray(batch.column("cell"))[row]
            out = batch.drop_columns(["cell"]).take(pa.array(row[other]))
            yield out.append_column("cell", pa.array(leaf[other]))

    ddl = f"key {kind}, " + ", ".join(f"{c} double" for c in cols)
    found = stored(few.select("key", *cols).mapInArrow(placed, f"{ddl}, cell long"), "knn-cells")
    asking = found.join(vectors.select("key"), "key", "left_semi")
    own = stored(_first(_asked(found, asking.withColumn("reach", F.lit(float("inf"))), cols, need, kind), need), "knn-own")
    if not tree.depth:  # one cell: nothing is further away
        return _lists_taken(rows, vectors, own, few, key, columns, cols, k)
    reach = own.where(F.col("rank") == need).select(F.col("vid").alias("key"), F.col("d").alias("reach"))
    again = asking.join(reach, "key", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    further = again.select("key", *cols, "reach", "cell").mapInArrow(reached, f"{ddl}, reach double, cell long")
    lists = stored(_first(own.drop("rank").unionByName(_asked(found, stored(further, "knn-further"), cols, need, kind)), need), "knn-lists")
    return _lists_taken(rows, vectors, lists, few, key, columns, cols, k)


def _lists_taken(rows: DataFrame, vectors: DataFrame, lists: DataFrame, few: DataFrame, key: str, columns: list[str], cols: list[str], k: int) -> DataFrame:
    """Every point takes the list of its vector, without itself."""
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cols]
    of = rows.alias("a").join(vectors.alias("b"), same).select(F.col("a.key").alias("key"), F.col("b.key").alias("vid"))
    pairs = of.join(lists, "vid").where(F.col("key") != F.col("found"))
    top = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("d", "found"))).where(F.col("rank") <= k)
    back = few.select(F.col("key").alias("found"), *[F.col(n).alias(f"n_{c}") for c, n in zip(columns, cols)])
    return top.join(back, "found").select(F.col("key").alias(key), F.col("found").alias(f"n_{key}"), "rank", "d", *[f"n_{c}" for c in columns])
