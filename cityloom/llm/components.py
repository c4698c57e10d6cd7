"""Connected components of an edge table by contraction: joins and minimum aggregates only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.llm.common import drop_table, write_table


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` for every node of an edge, component = smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks once more, and replaces the edges by those
    between the hooked nodes; rounds go on until no edge is left, which takes a logarithmic number of them. Null ends and
    loops are ignored; repeated edges count once; no edges give an empty table.
    """
    left = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    left = write_table(left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    mapping = None
    while left.limit(1).count():
        both = left.union(left.select("v", "u"))
        hook = write_table(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), "hooks")
        far = hook.select(F.col("node").alias("root"), F.col("root").alias("further"))
        jumped = write_table(hook.join(far, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "jumped")
        a = jumped.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = jumped.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = left.join(a, "u").join(b, "v").where("ru <> rv")
        less = write_table(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
        if mapping is None:
            new = jumped
        else:
            step = jumped.select(F.col("node").alias("root"), F.col("root").alias("further"))
            new = write_table(mapping.join(step, "root", "left").select("node", F.coalesce("further", "root").alias("root")), "mapping")
            drop_table(mapping)
            drop_table(jumped)
        for old in (left, hook):
            drop_table(old)
        left, mapping = less, new
    if mapping is None:
        return left.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return mapping.select("node", F.col("root").alias("component"))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links a[i]-b[i] within one task: (node, smallest node of its group) for all nodes that aren't that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = label != np.arange(len(nodes))
    return nodes[apart], nodes[label[apart]]
