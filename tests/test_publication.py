"""General polygons, reprojection, POI fusion, shares and labels against brute force and known values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from cityloom.functions import geometry as geo, labels as lb, polygons as pg
from cityloom.functions.alignment import common_subsequence
from cityloom.operators import audit, evidence as ev, models, proportions as pr
from cityloom.plans import publication, queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def star(seed: int, shift: float = 0.0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    a, r = np.sort(rng.uniform(0, 2 * math.pi, 9)), rng.uniform(1, 5, 9)
    return np.stack([shift + r * np.cos(a), r * np.sin(a)], 1)


GRID = np.stack(np.meshgrid(np.arange(-7, 9, 0.02), np.arange(-6, 6, 0.02)), -1).reshape(-1, 2) + 0.0013


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10**6), st.floats(-3, 3))
def test_overlap_of_stars_is_the_share_of_a_grid(seed, shift):
    p, q = star(seed), star(seed + 1, shift)
    # stars are simple only if no gap between two corners is over half a turn; a grid is right either way by parity, so test simple ones
    if pg.crosses_itself(p) or pg.crosses_itself(q):
        return
    got = pg.overlap(p, q)
    assert got == pytest.approx((pg._inside(GRID, p) & pg._inside(GRID, q)).sum() * 0.0004, abs=0.25)
    assert got == pytest.approx(pg.overlap(q, p), abs=1e-9) and got == pytest.approx(pg.overlap(p[::-1], q), abs=1e-9)


def test_shared_boundary_repair_and_angle():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    assert pg.shared(square + (2, 0.5), square) == pytest.approx(1.5)
    assert pg.shared(square + (2.00005, 0), square) == pytest.approx(2, abs=1e-3)
    assert pg.shared(square + (3, 0), square) == 0
    assert pg.shared(square * 0.5 + 0.5, square) == pytest.approx(4)
    assert pg.repaired(np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)) is None
    assert pg.repaired(np.array([(0, 0), (1, 1), (2, 2)], float)) is None
    fixed = pg.repaired(np.array([(0, 0), (0, 2), (0, 2), (math.nan, 1), (2, 2), (2, 0)], float))
    assert pg.signed_area(fixed[:-1]) == pytest.approx(4) and (fixed[0] == fixed[-1]).all()
    for degrees in (0, 17, 90, 133):
        t = math.radians(degrees)
        turned = np.array([(0, 0), (5, 0), (5, 1), (2, 1.5), (0, 1)]) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        assert (pg.longest_edge_angle(turned) - degrees) % 180 == pytest.approx(0, abs=1e-6)
    assert pg.longest_edge_angle(np.array([(0, 0), (1, 1), (2, 2)], float)) is None


def test_ring_functions_handle_nulls_and_short_rings(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]), (2, None), (3, []), (4, [(0.0, None), (1.0, 1.0), (2.0, 5.0)])], f"id int, r {pg.RING}")
    out = {r.id: r for r in rows.select("id", pg.ring_overlap("r", "r").alias("o"), pg.edge_angle(F.col("r")).alias("a"), pg.repaired_ring(F.col("r")).alias("f"), pg.shared_boundary("r", "r").alias("s")).collect()}
    assert out[1].o == pytest.approx(4) and len(out[1].f) == 5 and out[1].s == pytest.approx(8)
    assert out[2].o is None and out[2].f is None and out[2].a is None
    assert out[3].o == 0 and out[3].f is None and out[4].o == 0 and out[4].f is None


def test_wgs84_to_grid_at_the_origin(spark):
    """The published shift of the origin: 5.5 seconds of latitude and 8.8 of longitude, good to some metres."""
    lon, lat = 114 + 10 / 60 + (42.80 + 8.8) / 3600, 22 + 18 / 60 + (43.68 - 5.5) / 3600
    e, n = spark.range(1).select(*geo.wgs84_to_grid(F.lit(lon), F.lit(lat))).first()
    assert e == pytest.approx(836694.05, abs=5) and n == pytest.approx(819069.80, abs=5)


def test_reproject_is_a_similarity(spark):
    rows = queries.QUERIES["reproject"](spark, SF).collect()
    assert len(rows) > 100 and all(790000 < r.easting < 870000 and 790000 < r.northing < 860000 for r in rows)


def test_fuse_pois_equals_brute_force(spark):
    v = queries.Views(spark, SF)
    osm = v.pois.select("osmid", "name", "amenity", "shop", "px", "py")
    places = v.pois.where("osmid % 3 = 0").select((-F.col("osmid")).alias("osmid"), F.upper("name").alias("name"), "amenity", "shop", (F.col("px") + 3).alias("px"), "py")
    got = {r.osmid for r in audit.fuse_pois(osm, places).collect()}

    def ratio(a, b):
        x, y = set(a.split()), set(b.split())
        s, t, u = (" ".join(sorted(k)) for k in (x & y, x - y, y - x))
        p, q = (s + " " + t).strip(), (s + " " + u).strip()
        r = lambda m, n: 200.0 * common_subsequence(m, n) / (len(m) + len(n)) if m or n else 100.0
        return max(r(p, q), *((r(s, p), r(s, q)) if s else (0.0,)))

    a, b = osm.collect(), places.collect()
    want = {p.osmid for p in b}
    for o in a:
        gone = False
        for p in b:
            if math.hypot(o.px - p.px, o.py - p.py) < 10:
                m, n = (o.name or "").lower(), (p.name or "").lower()
                gone |= ratio(m, n) > 80 if m and n else not m and not n and (o.amenity is not None and o.amenity == p.amenity or o.shop is not None and o.shop == p.shop)
        if not gone:
            want.add(o.osmid)
    assert got == want and len(want) < len(a) + len(b)


def test_fuse_pois_query_takes_every_point_and_every_shop(spark):
    pois = queries.Views(spark, SF).pois.select("osmid", "shop", "px", "py").collect()
    got = {r.osmid for r in queries.QUERIES["fuse_pois"](spark, SF).collect()}
    shops = [p for p in pois if p.shop is not None]
    alone = {o.osmid for o in pois if all(math.hypot(o.px - p.px - 3, o.py - p.py) >= 10 for p in shops)}
    assert {-p.osmid for p in shops} == {k for k in got if k < 0} and alone and alone <= got <= {s * p.osmid for p in pois for s in (1, -1)}


def test_shares_add_up_and_take_nulls(spark):
    gfa = spark.createDataFrame([(1, 60.0, 40.0), (2, None, 10.0), (3, 0.0, 0.0), (4, None, None), (5, 0.0, 8.0)], "bid long, domestic double, nondomestic double")
    features = spark.createDataFrame([(1, "商业类别", "零售（Retail）", 3.0), (1, "商业类别", None, 1.0), (1, "工业类别", None, 4.0), (5, "工业类别", "x", 0.0), (5, None, None, None)], "bid long, main string, sub string, weight double")
    rows = {(r.bid, r.main, r.sub): round(r.share, 9) for r in pr.prop_by_gfa(gfa, features).collect()}
    assert rows == {(1, "住宅类别", "私人房屋（Private Housing）"): 0.6, (1, "商业类别", "零售（Retail）"): 0.2, (1, "工业类别", "其他工业（Other Industrial）"): 0.2, (2, "商业类别", "其他商业（Other Commercial）"): 1.0}
    assert pr.prop_by_gfa(gfa.where("false"), features).count() == 0
    own = spark.createDataFrame([(1, "商业类别", None), (2, "住宅类别", " "), (3, "混合用途", "s"), (4, None, None)], "bid long, main string, sub string")
    none = spark.createDataFrame([], "bid long, sub string")
    assert {(r.bid, r.sub, r.share) for r in pr.prop_final(own, none).collect()} == {(1, "其他商业（Other Commercial）", 1.0), (2, "私人房屋（Private Housing）", 1.0)}


def test_every_label_is_its_own_standard(spark):
    labels = [s for subs in lb.SUB_LABELS.values() for s in subs]
    rows = spark.createDataFrame([(s,) for s in labels], "s string").select("s", lb.std_sub(F.col("s")).alias("std"), lb.std_sub(lb.canon_sub(F.col("s"))).alias("back"), lb.canon_sub(F.col("s")).alias("c"), lb.canon_sub(lb.canon_sub(F.col("s"))).alias("cc")).collect()
    assert all(r.s == r.std and "_" in r.c and r.c == r.cc for r in rows)


def test_keyword_evidence_weights(spark):
    rows = spark.createDataFrame(
        [(1, "1", "gear shop", 10.0), (2, "4", "gear factory", 10.0), (3, "9", "bolt tower", 60.0), (4, "9", "bolt tower", 40.0), (5, "2", "Widget", 1.0), (6, "2", "Widget Centre", 1.0), (7, None, None, None), (8, "1", "WIDGET promo", 1.0)],
        "bid long, category string, text string, area double",
    )
    got = {r.bid: r.weight for r in ev.keyword_evidence(rows, publication._WORDS, ["promo"]).collect()}
    assert got == {1: 50, 2: 80, 3: 30, 4: 65, 5: 10, 6: 80, 8: 90}


def test_oversampling_and_share_model(spark):
    rows = queries.feature_table(queries.Views(spark, SF)).withColumn("rare", (F.col("bid") % 20 == 0).cast("int")).withColumn("train", F.lit(True))
    out = models.oversample(rows, "rare", "bid", models.FEATURES, least=40, cell=3000.0)
    assert out.where("rare = 1").count() == 40 and out.where("rare = 0").count() == rows.where("rare = 0").count()
    shares = queries.QUERIES["sub_shares_model"](spark, SF).collect()
    assert shares and all(0.05 < r.share <= 1 for r in shares)


def test_oversampling_balances_many_positives_and_reaches_far_ones(spark):
    rows = spark.range(1000).select(F.col("id").alias("bid"), (F.col("id") % 4 == 0).cast("int").alias("rare"), (F.col("id") * 7919 % 997).cast("double").alias("px"), (F.col("id") * 6101 % 991).cast("double").alias("py"))
    out = models.oversample(rows, "rare", "bid", ["px", "py"], cell=50.0)
    assert out.where("rare = 1").count() == 750 and out.where("rare = 0").count() == 750
    assert out.where("rare = 1").exceptAll(rows.where("rare = 1").withColumn("train", F.lit(None).cast("boolean"))).where("px IS NULL OR py IS NULL").count() == 0
    far = spark.createDataFrame([(k, int(k < 4), 10000.0 * k, 0.0) for k in range(20)], "bid long, rare int, px double, py double")
    more = models.oversample(far, "rare", "bid", ["px", "py"], least=11)
    assert more.where("rare = 1").count() == 11 and more.where("rare = 1 AND bid IS NULL AND px BETWEEN 0 AND 30000").count() == 7
    near = {r.bid: [x["n_bid"] for x in r.near] for r in models._nearest(rows.where("rare = 1").select("bid", "px", "py"), "bid", ["px", "py"], 5, 10.0).collect()}
    p = {r.bid: (r.px, r.py) for r in rows.where("rare = 1").collect()}
    assert near == {a: [b for _, b in sorted((math.dist(p[a], p[b]), b) for b in p if b != a)[:5]] for a in p}
