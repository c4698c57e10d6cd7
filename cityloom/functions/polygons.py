"""Measures of general rings (``array<struct<x, y>>``) that column expressions can't give, in Arrow batches.

Null rings give null. Rings may be closed or not, and turn either way; holes are rings of their own, to be subtracted by the caller.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"
TOUCH = 1e-4


def rings(column: pa.Array) -> list[np.ndarray | None]:
    """The rings of a column, without their closing points; missing points and coordinates are NaN."""
    at, values = np.asarray(column.offsets), column.values
    gone = np.asarray(values.is_null())
    xy = np.stack([np.where(gone, np.nan, np.asarray(values.field(c).cast(pa.float64()).fill_null(math.nan))) for c in ("x", "y")], 1)
    shut = lambda r: r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r
    return [shut(xy[a:b]) if ok else None for a, b, ok in zip(at[:-1], at[1:], column.is_valid().to_pylist())]


def points(ring: list[dict] | None) -> np.ndarray | None:
    """(n, 2) of a ring, without the closing point."""
    if ring is None:
        return None
    out = np.array([(p["x"], p["y"]) if p and p["x"] is not None and p["y"] is not None else (math.nan, math.nan) for p in ring], float).reshape(-1, 2)
    return out[:-1] if len(out) > 1 and (out[0] == out[-1]).all() else out


def signed_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum()) / 2 if len(p) > 2 else 0.0


def _cross(o: np.ndarray, a: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (a[..., 0] - o[..., 0]) * (p[..., 1] - o[..., 1]) - (a[..., 1] - o[..., 1]) * (p[..., 0] - o[..., 0])


def under_both(ax, ay, bx, by, cx, cy, dx, dy) -> np.ndarray:
    """Signed areas below both edges a to b and c to d, down to the height 0, element by element; heights are not negative.

    With edges that go round two shapes, the sum over all pairs of edges is the area that the shapes share. Upright edges have nothing below them.
    """
    low, high = np.maximum(np.minimum(ax, bx), np.minimum(cx, dx)), np.minimum(np.maximum(ax, bx), np.maximum(cx, dx))
    wide = np.maximum(high - low, 0.0)
    rise, climb = (by - ay) / np.where(ax == bx, 1.0, bx - ax), (dy - cy) / np.where(cx == dx, 1.0, dx - cx)
    p, q, r, s = ay + (low - ax) * rise, ay + (high - ax) * rise, cy + (low - cx) * climb, cy + (high - cx) * climb
    first, last = np.minimum(p, r), np.minimum(q, s)
    area = (first + last) / 2 * wide
    before, after = p - r, q - s
    crossed = np.flatnonzero((before * after < 0) & (wide > 0))
    if len(crossed):  # the lower of the two lies above the line from end to end
        f, l, e, w = (np.ravel(x)[crossed] for x in (first, last, before, wide))
        at = e / (e - np.ravel(after)[crossed])
        flat = area.reshape(-1)
        start = np.ravel(p)[crossed]
        flat[crossed] += (start + at * (np.ravel(q)[crossed] - start) - f - at * (l - f)) * w / 2
        area = flat.reshape(area.shape)
    return area * (np.sign(bx - ax) * np.sign(dx - cx))


class Rings:
    """The rings of a column, without their closing points, in flat arrays; missing points and coordinates are NaN."""

    def __init__(self, column: pa.Array):
        at, values = np.asarray(column.offsets), column.values
        gone = np.asarray(values.is_null())
        self.xy = np.stack([np.where(gone, np.nan, np.asarray(values.field(c).cast(pa.float64()).fill_null(math.nan))) for c in ("x", "y")], 1)
        self.null, self.begins, n = ~np.asarray(column.is_valid()), at[:-1].astype(np.int64), np.diff(at).astype(np.int64)
        many = np.flatnonzero(n > 1)
        first, last = self.xy[self.begins[many]], self.xy[self.begins[many] + n[many] - 1]
        n[many[(first == last).all(1)]] -= 1
        self.n = np.where(self.null, 0, n)
        row = np.repeat(np.arange(len(n)), self.n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.n) - self.n, self.n) + self.begins[row]
        broken = np.bincount(row[~np.isfinite(self.xy[place]).all(1)], minlength=len(n)) > 0
        self.sound = (self.n > 2) & ~broken

    def slopes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((4, n) x1, y1, x2, y2 of the sides of rows in turn, number of them in each row), upright ones left out."""
        n = self.n[rows]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        at = place + np.repeat(self.begins[rows], n)
        after = np.where(place + 1 == np.repeat(n, n), np.repeat(self.begins[rows], n), at + 1)
        e = np.concatenate([self.xy[at].T, self.xy[after].T])
        kept = e[0] != e[2]
        return e[:, kept], np.bincount(np.repeat(np.arange(len(rows)), n)[kept], minlength=len(rows))

    def corners(self, rows: np.ndarray, n: int) -> np.ndarray:
        """(rows, n, 2) of rows that have n corners."""
        return self.xy[self.begins[rows][:, None] + np.arange(n)]


def alike(a: Rings, b: Rings, each: Callable[[int, int], int] = lambda m, n: m * n, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, corners of a, corners of b) of sound pairs with the same numbers of corners, so many at once that rows times each is about most."""
    good = np.flatnonzero(a.sound & b.sound)
    sizes, which = np.unique(np.stack([a.n[good], b.n[good]], 1), axis=0, return_inverse=True)
    order = np.argsort(which.reshape(-1), kind="stable")
    ends = np.cumsum(np.bincount(which.reshape(-1), minlength=len(sizes)))
    for k, (m, n) in enumerate(sizes.tolist()):
        rows = good[order[ends[k - 1] if k else 0 : ends[k]]]
        step = max(1, most // each(m, n))
        for some in (rows[s : s + step] for s in range(0, len(rows), step)):
            yield some, a.corners(some, m), b.corners(some, n)


def _sides(p: np.ndarray, axis: int) -> tuple[np.ndarray, ...]:
    """x1, y1, x2, y2 of the sides of rings (rows, n, 2), with an axis of length 1 for the other ring."""
    q = np.roll(p, -1, 1)
    return tuple(np.expand_dims(c, axis) for c in (p[..., 0], p[..., 1], q[..., 0], q[..., 1]))


def overlaps(a: Rings, b: Rings, most: int = 1 << 17) -> np.ndarray:
    """Areas that simple rings share, pair by pair: what lies below every edge of one and every edge of the other. 0 for rings that are not sound."""
    out = np.zeros(len(a.n))
    good = np.flatnonzero(a.sound & b.sound)
    (p, pn), (q, qn) = a.slopes(good), b.slopes(good)
    pairs, pat, qat = pn * qn, np.cumsum(pn) - pn, np.cumsum(qn) - qn
    for some in np.split(np.arange(len(good)), np.flatnonzero(np.diff(np.cumsum(pairs) // most)) + 1):
        if not len(some) or not pairs[some].sum():
            continue
        row = np.repeat(some, pairs[some])
        place = np.arange(len(row)) - np.repeat(np.cumsum(pairs[some]) - pairs[some], pairs[some])
        base = np.full((2, len(some)), np.inf)
        of = row - some[0]
        i, j = p[:, pat[row] + place // qn[row]], q[:, qat[row] + place % qn[row]]
        start = np.searchsorted(row, some[pairs[some] > 0])
        x, y = np.minimum(np.minimum(i[0], i[2]), np.minimum(j[0], j[2])), np.minimum(np.minimum(i[1], i[3]), np.minimum(j[1], j[3]))
        base[:, pairs[some] > 0] = np.minimum.reduceat(x, start), np.minimum.reduceat(y, start)
        shift = np.concatenate([base, base])[:, of]
        out[good[some]] = np.abs(np.bincount(of, under_both(*(i - shift), *(j - shift)), len(some)))
    return out


def _column(*given: np.ndarray) -> Rings:
    at = np.concatenate([[0], np.cumsum([len(r) for r in given])]).astype(np.int32)
    xy = np.concatenate(given).reshape(-1, 2).astype(float)
    return Rings(pa.ListArray.from_arrays(pa.array(at), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])))


def overlap(p: np.ndarray, q: np.ndarray) -> float:
    return float(overlaps(_column(p), _column(q))[0])


def _within(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Whether points (..., 1) lie within the ring whose sides are along the last axis."""
    over = (ay > y) != (by > y)
    rise = np.where(ay == by, 1.0, by - ay)
    return (over & (x < (bx - ax) * (y - ay) / rise + ax)).sum(-1) % 2 == 1


def _off(x: np.ndarray, y: np.ndarray, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Distance of each point to each side, all shapes broadcast; beyond an end exactly that to the corner."""
    dx, dy = bx - ax, by - ay
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0, 1)
    u, v = np.where(t < 1, x - ax - t * dx, x - bx), np.where(t < 1, y - ay - t * dy, y - by)
    return np.sqrt(u * u + v * v)


def shared_lengths(a: Rings, b: Rings, tolerance: float = TOUCH) -> np.ndarray:
    """Lengths of the first rings' boundaries within the second or tolerance of them: sides are cut where the other's sides and corners meet them, the pieces' middles tested."""
    out = np.zeros(len(a.n))
    for rows, p, q in alike(a, b, lambda m, n: 2 * m * n * (n + 1)):
        ax, ay, bx, by = _sides(p, 2)
        cx, cy, ex, ey = _sides(q, 1)
        dx, dy = bx - ax, by - ay
        long = np.hypot(dx, dy)
        turn, wx, wy = dx * (ey - cy) - dy * (ex - cx), cx - ax, cy - ay
        crossing = (wx * (ey - cy) - wy * (ex - cx)) / np.where(turn == 0, np.nan, turn)
        corner = (wx * dx + wy * dy) / np.where(long == 0, np.nan, long * long)
        ends = np.broadcast_to(np.array([0.0, 1.0]), (*crossing.shape[:2], 2))
        t = np.concatenate([ends, crossing, corner], 2)
        t = np.sort(np.where(np.isfinite(t), np.clip(t, 0, 1), 0.0), 2)
        middle = (t[..., :-1] + t[..., 1:]) / 2
        x, y = (ax + middle * dx)[..., None], (ay + middle * dy)[..., None]
        side = tuple(c[:, :, None] for c in (cx, cy, ex, ey))
        met = _within(x, y, *side) | (_off(x, y, *side).min(-1) <= tolerance)
        piece = np.where(met, np.diff(t, axis=2) * long, 0.0)
        for k in range(p.shape[1]):
            out[rows] += np.cumsum(piece[:, k], 1)[:, -1]
    return out


def shared(p: np.ndarray, q: np.ndarray) -> float:
    return float(shared_lengths(_column(p), _column(q))[0])


def _inside(at: np.ndarray, ring: np.ndarray) -> np.ndarray:
    a, b = ring, np.roll(ring, -1, 0)
    return _within(at[:, :1], at[:, 1:], a[:, 0], a[:, 1], b[:, 0], b[:, 1])


def crosses_itself(p: np.ndarray) -> bool:
    """Whether two edges that are no neighbours meet."""
    n = len(p)
    a, b = p, np.roll(p, -1, 0)
    for i in range(n - 2):
        j = np.arange(i + 2, n - (i == 0))
        s, t = _cross(a[i], b[i], a[j]), _cross(a[i], b[i], b[j])
        u, v = _cross(a[j], b[j], a[i][None]), _cross(a[j], b[j], b[i][None])
        flat = (s == 0) & (t == 0)
        over = (np.minimum(a[j], b[j]) <= np.maximum(a[i], b[i])).all(1) & (np.maximum(a[j], b[j]) >= np.minimum(a[i], b[i])).all(1)
        if ((~flat & (s * t <= 0) & (u * v <= 0)) | (flat & over)).any():
            return True
    return False


def repaired(p: np.ndarray) -> np.ndarray | None:
    """Ring without missing and repeated points, counter-clockwise and closed; none if nothing of an area is left or it crosses itself."""
    p = p[np.isfinite(p).all(1)]
    if len(p) > 1:
        p = p[(p != np.roll(p, 1, 0)).any(1)]
    area = signed_area(p)
    if len(p) < 3 or area == 0 or crosses_itself(p):
        return None
    p = p if area > 0 else p[::-1]
    return np.vstack([p, p[:1]])


def longest_edge_angle(p: np.ndarray) -> float | None:
    """Degrees from 0 to 180 of the longer side of the smallest rectangle round p; one side of it lies along the convex hull."""
    p = np.unique(p[np.isfinite(p).all(1)], axis=0)
    if len(p) < 3:
        return None

    def half(points: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for c in points:
            while len(out) > 1 and _cross(out[-2], out[-1], c) <= 0:
                out.pop()
            out.append(c)
        return out[:-1]

    hull = np.array(half(p) + half(p[::-1]))
    if len(hull) < 3:
        return None
    d = np.roll(hull, -1, 0) - hull
    angle = np.arctan2(d[:, 1], d[:, 0])
    along = hull @ np.stack([np.cos(angle), np.sin(angle)])
    aside = hull @ np.stack([-np.sin(angle), np.cos(angle)])
    w, h = np.ptp(along, axis=0), np.ptp(aside, axis=0)
    best = int(np.argmin(np.round(w * h, 9)))
    return float(np.degrees(angle[best] + (0 if w[best] >= h[best] else math.pi / 2)) % 180)


def _of_pairs(measure: Callable[[Rings, Rings], np.ndarray], a: Column, b: Column, none: Callable[[Rings], np.ndarray] = lambda r: r.null) -> Column:
    """A measure of two rings, a batch at a time; null where one of them is none."""

    @F.arrow_udf("double")
    def run(left: pa.Array, right: pa.Array) -> pa.Array:
        p, q = Rings(left), Rings(right)
        return pa.array(measure(p, q), pa.float64(), mask=none(p) | none(q))

    return run.asNondeterministic()(a, b)  # so to say, lest a filter on the result measure twice


def ring_overlap(a: Column, b: Column) -> Column:
    """Area of the intersection; 0 for rings of less than three points or with missing ones."""
    return _of_pairs(overlaps, a, b)


def shared_boundary(fragment: Column, host: Column) -> Column:
    """Length of the fragment's boundary that lies within the host or touches it."""
    return _of_pairs(shared_lengths, fragment, host)


def edge_angle(ring: Column) -> Column:
    """Angle of the longer side of the minimum rotated rectangle; null for rings without an area."""

    @F.arrow_udf("double")
    def run(rings: pa.Array) -> pa.Array:
        return pa.array([None if r is None else longest_edge_angle(points(r)) for r in rings.to_pylist()], pa.float64())

    return run(ring)


def repaired_ring(ring: Column) -> Column:
    """Valid form of a ring, or null."""

    @F.arrow_udf(RING)
    def run(rings: pa.Array) -> pa.Array:
        out = []
        for r in rings.to_pylist():
            fixed = None if r is None else repaired(points(r))
            out.append(None if fixed is None else [{"x": float(x), "y": float(y)} for x, y in fixed])
        return pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return run(ring)


def rotated(ring: Column, degrees: Column, cx: Column, cy: Column) -> Column:
    """Ring turned counter-clockwise about a point."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(ring, lambda p: F.struct((cx + (p["x"] - cx) * c - (p["y"] - cy) * s).alias("x"), (cy + (p["x"] - cx) * s + (p["y"] - cy) * c).alias("y")))


def ring_of(*xy: tuple[Column, Column]) -> Column:
    """Closed ring of the given corners."""
    corners = [F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in xy]
    return F.array(*corners, corners[0])


def gaps(a: Rings, b: Rings) -> np.ndarray:
    """Distances of sound rings: 0 where they meet or one holds a corner of the other."""
    out = np.zeros(len(a.n))
    for rows, p, q in alike(a, b):
        ax, ay, bx, by = one = _sides(p, 2)
        cx, cy, dx, dy = two = _sides(q, 1)
        turn = lambda x1, y1, x2, y2, x, y: (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        crossed = ((turn(*one, cx, cy) * turn(*one, dx, dy) < 0) & (turn(*two, ax, ay) * turn(*two, bx, by) < 0)).any((1, 2))
        held = _within(cx[:, 0, :1], cy[:, 0, :1], *(c[..., 0] for c in one)) | _within(ax[:, :1, 0], ay[:, :1, 0], *(c[:, 0] for c in two))
        near = np.minimum(_off(ax, ay, *two).min((1, 2)), _off(cx, cy, *one).min((1, 2)))
        out[rows] = np.where(crossed | held, 0.0, near)
    return out


def ring_gap(a: Column, b: Column) -> Column:
    """Distance of two rings; 0 where they overlap or one holds the other, null for rings that are null or have less than three sound points."""
    return _of_pairs(gaps, a, b, lambda r: ~r.sound)


def _inner(p: np.ndarray | None) -> dict | None:
    if p is None or len(p) < 3 or np.isnan(p).any():
        return None
    middle = (p[:, 1].min() + p[:, 1].max()) / 2
    above, below = p[p[:, 1] > middle, 1], p[p[:, 1] <= middle, 1]
    if not len(above):
        return None
    y = (below.max() + above.min()) / 2
    a, b = p, np.roll(p, -1, 0)
    cut = (a[:, 1] > y) != (b[:, 1] > y)
    a, b = a[cut], b[cut]
    x = np.sort(a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1]))
    best = int(np.argmax(x[1::2] - x[::2]))
    return {"x": float((x[2 * best] + x[2 * best + 1]) / 2), "y": float(y)}


def interior_point(ring: Column) -> Column:
    """``struct(x, y)`` of a point within a ring: the middle of the widest span of a horizontal line that meets no vertex.

    The line lies between the middle of the ring's height and the next vertex above; of spans equally wide the first counts. Null
    for rings that are null, flat, or have less than three sound points.
    """

    @F.arrow_udf("struct<x:double,y:double>")
    def inner(x: pa.Array) -> pa.Array:
        return pa.array([_inner(p) for p in rings(x)], pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    return inner(ring)
