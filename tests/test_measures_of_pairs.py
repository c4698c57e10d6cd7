"""Measures of pairs work on whole batches, whatever the pairs' numbers of corners, and equal the closed forms of boxes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cityloom.functions import polygons as pg, shapes as sh
from cityloom.operators import cover as cv


def column(rings):
    return pa.array([None if r is None else [{"x": float(x), "y": float(y)} for x, y in r] for r in rings], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def box(b, extra, turn):
    """A box with some more corners on its sides, either way round, closed or not."""
    x1, y1, x2, y2 = b
    ring = [(x1, y1), (x2, y1), (x2, y2), (x1, y2)]
    if extra:
        ring.insert(1, ((x1 + x2) / 2, y1))
    ring = ring[::-1] if turn else ring
    return ring if extra else [*ring, ring[0]]


def pairs_of_boxes(n):
    rng = np.random.default_rng(4)
    low, size = rng.integers(0, 40, (2, n, 2)) / 2, rng.integers(2, 24, (2, n, 2)) / 2
    a, b = (np.concatenate([low[k], low[k] + size[k]], 1) for k in (0, 1))
    rings = [[box(r, rng.random() < 0.3, rng.random() < 0.5) for r in s.tolist()] for s in (a, b)]
    return a.T, b.T, rings


def test_rings_in_batches_equal_closed_forms():
    a, b, (p, q) = pairs_of_boxes(4000)
    p, q = pg.Rings(column(p)), pg.Rings(column(q))
    wide, tall = (np.minimum(a[k + 2], b[k + 2]) - np.maximum(a[k], b[k]) for k in (0, 1))
    assert np.allclose(pg.overlaps(p, q), np.maximum(wide, 0) * np.maximum(tall, 0), atol=1e-9)
    assert np.allclose(pg.gaps(p, q), np.hypot(np.maximum(-wide, 0), np.maximum(-tall, 0)), atol=1e-9)
    t = pg.TOUCH
    want = 0.0
    for k, (c, d, e, f) in enumerate(((0, 1, 2, 3), (2, 1, 0, 3), (1, 0, 3, 2), (3, 0, 1, 2))):  # the side at c, along d to f
        held = (a[c] >= b[min(c, e)] - t) & (a[c] <= b[max(c, e)] + t)
        want = want + np.where(held, np.maximum(np.minimum(a[f], b[f]) - np.maximum(a[d], b[d]), 0), 0)
    assert np.allclose(pg.shared_lengths(p, q), want, atol=1e-3)


def test_unsound_rings_are_left_out_of_a_batch():
    sound, flat = [(0, 0), (2, 0), (2, 2), (0, 2)], [(0, 0), (1, 1)]
    p, q = pg.Rings(column([sound, None, flat, [(0, 0), (np.nan, 1), (2, 2)], sound])), pg.Rings(column([sound, sound, sound, sound, None]))
    assert p.sound.tolist() == [True, False, False, False, True] and p.null.tolist() == [False, True, False, False, False]
    assert pg.overlaps(p, q).tolist() == [4, 0, 0, 0, 0] and pg.shared_lengths(p, q).tolist() == [8, 0, 0, 0, 0]
    none = pg.Rings(column([]))
    assert not len(pg.overlaps(none, none)) and not len(pg.gaps(none, none)) and not len(pg.shared_lengths(none, none))


def test_containment_looks_at_a_batch_at_once():
    """Frames whose courtyards are narrower and wider than twice the tolerance, all in one call."""
    rows = [[(0, 0, w, w), (w / 4, w / 4, 3 * w / 4, 3 * w / 4)] for w in (6, 7.9, 8.1, 12)]
    around = lambda b: [{"x": x, "y": y} for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))]
    outer = sh.Edges(pa.array([[[around(b) for b in r]] for r in rows], sh._PARTS))
    inner = sh.Edges(pa.array([[[around((1, 1, w - 1, w - 1))]] for w in (6, 7.9, 8.1, 12)], sh._PARTS))
    assert sh._convex(inner).all() and not sh._convex(outer).any()
    assert sh._stick_out(inner, outer, np.arange(4), 2.0).tolist() == [False, False, True, True]
    assert sh._stick_out(inner, outer, np.array([3, 0]), 2.0).tolist() == [True, False]


def test_overlaps_keep_what_touches_and_measure_features_once(spark):
    def shapes(rows, key):
        corner = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
        ring = F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2"), corner("x1", "y1"))
        return spark.createDataFrame(rows, f"{key} long, x1 int, y1 int, x2 int, y2 int").select(key, F.array(F.array(ring)).alias("parts"))

    got = cv.overlaps(shapes([(1, 0, 0, 10, 10)], "bid"), shapes([(1, 5, 5, 15, 15), (2, 10, 10, 12, 12), (3, 11, 11, 12, 12), (4, 2, 2, 3, 3), (5, 10, 2, 14, 6)], "osmid"))
    assert {r["f_osmid"]: r["ratio"] for r in got.collect()} == {1: 0.25, 2: 0.0, 4: 1.0, 5: 0.0}
    assert "aggregate(" not in got.where("ratio > 0").select("bid")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
