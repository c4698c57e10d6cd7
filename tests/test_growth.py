"""Joins whose work must not grow with the square of the table: what is dealt by cell stays so, and results equal brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cityloom.functions import automata, text as tx
from cityloom.operators import cover as cv, evidence as ev, spatial as sp
from cityloom.plans import queries as plans


def box_gap(p, b):
    return math.sqrt(max(b[1] - p[1], p[1] - b[3], 0.0) ** 2 + max(b[2] - p[2], p[2] - b[4], 0.0) ** 2)


@pytest.fixture(scope="module")
def town(spark):
    """Points in a dense quarter (on a grid, so that distances tie) and few elsewhere; boxes of all sizes, one without any neighbour."""
    rng = random.Random(3)
    points = [(k, rng.randrange(0, 120) / 2, rng.randrange(0, 120) / 2) for k in range(3000)] + [(3000 + k, rng.uniform(0, 2000), rng.uniform(0, 2000)) for k in range(60)] + [(9000, None, 1.0)]
    boxes = []
    for k in range(250):
        x, y = (rng.randrange(0, 140) / 2, rng.randrange(0, 140) / 2) if k % 2 else (rng.uniform(0, 2000), rng.uniform(0, 2000))
        boxes.append((k, x, y, x + rng.randrange(1, 20) / 2, y + rng.randrange(1, 20) / 2))
    boxes += [(900, -500.0, -500.0, 900.0, 40.0), (901, 5000.0, 5000.0, 5010.0, 5010.0)]
    rng.shuffle(points)
    return points, boxes, spark.createDataFrame(points, "rid long, px double, py double"), spark.createDataFrame(boxes, "bid long, x1 double, y1 double, x2 double, y2 double")


def nearest(points, boxes, gap):
    best = {b[0]: min(((gap(p, b), p[0]) for p in points if p[1] is not None), default=None) for b in boxes}
    return {k: (v[1], round(v[0], 9)) if v[0] <= 30 else (None, None) for k, v in best.items()}


def told(df):
    return {r["bid"]: (r["rid"], None if r["distance"] is None else round(r["distance"], 9)) for r in df.select("bid", "rid", "distance").collect()}


def test_nearest_of_dense_points_equals_brute_force(town):
    points, boxes, p, b = town
    assert sp.reaches(p, 30.0, 60.0)[0] < 2 and sp.reaches(p.where("rid >= 3000"), 30.0, 60.0) == [30.0] == sp.reaches(p.where("false"), 30.0, 60.0)
    assert told(sp.nearest_within(b, p, 30.0)) == nearest(points, boxes, box_gap)


def test_nearest_of_shapes_equals_brute_force(town):
    points, boxes, p, b = town

    def gap(q, s):
        w, h = (s[3] - s[1]) / 4, s[4]
        return min(box_gap(q, (0, s[1], s[2], s[1] + w, h)), box_gap(q, (0, s[3] - w, s[2], s[3], h)))

    ring = lambda x1, x2: F.array(*[F.struct(x.alias("x"), F.col(y).alias("y")) for x, y in ((x1, "y1"), (x2, "y1"), (x2, "y2"), (x1, "y2"), (x1, "y1"))])
    w = (F.col("x2") - F.col("x1")) / 4
    shapes = b.select("bid", F.array(F.array(ring(F.col("x1"), F.col("x1") + w)), F.array(ring(F.col("x2") - w, F.col("x2")))).alias("parts"))
    assert told(cv.nearest_within(shapes, p, 30.0)) == nearest(points, boxes, gap)


def test_grid_join_is_not_broadcast(town):
    """Tables that are small as files had their cells sent to every task, through the driver."""
    _, _, p, b = town
    plan = sp.grid_pairs(b, p, sp.BOX, sp.POINT, 40.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_counts_make_no_pair_of_points(spark):
    """The search for neighbours neither joins points with points nor sends cells through the driver; equal points, far ones and unknown labels are counted right."""
    rng = random.Random(5)
    rows = [(k, rng.randrange(0, 400) / 4, rng.randrange(0, 400) / 4, rng.choice(["a", "a", "a", "b", None])) for k in range(1500)]
    rows += [(2000 + k, 50.0, 50.0, "c") for k in range(100)] + [(3000, -4000.0, 9000.0, "a"), (3001, None, 1.0, "a"), (3002, 1.0, float("nan"), "a")]
    df = spark.createDataFrame(rows, "bid long, px double, py double, kind string").repartition(3)
    counts = sp.counted(df, "bid", 20.0, "kind")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "MapInArrow" in plan
    sound = [r for r in rows if r[1] is not None and r[2] == r[2]]
    want = {}
    for a in sound:
        for b in sound:
            if b[3] and math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])) <= 20.0:
                want[a[0], b[3]] = want.get((a[0], b[3]), 0) + 1
    assert {(r["bid"], r["kind"]): r["n"] for r in counts.collect()} == want


def test_touched_equals_pairs(town):
    _, boxes, _, b = town
    f = b.select(F.col("bid").alias("osmid"), *[(F.col(c) + 3).alias(c) for c in sp.BOX]).where("osmid % 3 = 0")
    for least in (0.0, 0.2):
        met = sp.touched(b, f, least)
        want = {r["bid"] for r in sp.intersects(b, f).where(F.col("ratio") >= least).select("bid").collect()}
        got = [r["bid"] for r in met.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan and "Broadcast" not in plan


def test_crowd_evidence_writes_no_pairs(spark):
    """Features of a tag are summed as they are found: a building has as many rows as tags, not as features, and the same sums."""
    v = plans.Views(spark, "/root/testdata/sf0.001")
    overlap, area = F.least("ratio", F.lit(1.0)), (F.col("f_x2") - F.col("f_x1")) * (F.col("f_y2") - F.col("f_y1"))
    want = {(r["bid"], r["f_building"]): (0.0, 0.0) for r in plans.strong(v).collect()}
    for r in plans.strong(v).select("bid", "f_building", overlap.alias("o"), (overlap * area).alias("w")).collect():
        old = want[r["bid"], r["f_building"]]
        want[r["bid"], r["f_building"]] = (old[0] + r["o"], old[1] + r["w"])
    rows = plans.crowd(v).collect()
    got = {(r["bid"], r["f_building"]): (pytest.approx(r["votes"]), pytest.approx(r["weight"])) for r in rows}
    assert len(rows) == len(got) > 0 and want == got
    plans.evidence_part(v, "OSM")
    assert "strong" not in v.held


def test_equal_rows_of_a_keyword_table_are_one(spark):
    b = spark.createDataFrame([(1, "9", "an old bolt", 10.0)], "bid long, category string, text string, area double")
    table = spark.createDataFrame([("bolt", tx.COMMERCIAL, tx.OFFICE)] * 3 + [("bolt", tx.INDUSTRIAL, tx.OTHER_INDUSTRIAL)], "keyword string, main string, sub string")
    got = ev.keyword_hits_evidence(b, automata.keywords_of(table), table, ())
    assert sorted(map(tuple, got.collect())) == sorted([(1, tx.COMMERCIAL, tx.OFFICE, 50), (1, tx.INDUSTRIAL, tx.OTHER_INDUSTRIAL, 50)])


def test_counts_in_boxes_equal_brute_force(town):
    """Points within boxes are counted by label without a pair of a box and a point, also where a cell is dealt to several tasks."""
    points, boxes, p, b = town
    labelled = p.withColumn("label", F.when(F.col("rid") % 3 < 2, F.concat(F.lit("k"), (F.col("rid") % 3).cast("string"))))
    want = {}
    for bid, x1, y1, x2, y2 in boxes:
        for rid, x, y in points:
            if rid % 3 < 2 and x is not None and x1 <= x <= x2 and y1 <= y <= y2:
                want[bid, f"k{rid % 3}"] = want.get((bid, f"k{rid % 3}"), 0) + 1
    odd = b.unionByName(b.limit(1).selectExpr("7777L as bid", "x1", "y1", "double('nan') as x2", "y2")).unionByName(b.limit(1).selectExpr("7778L as bid", "x1", "y1", "cast(null as double) as x2", "y2"))
    for sizes in ({}, {"cell": 16.0, "ranked": 50, "asking": 7}):
        rows = sp.counted_within(odd, labelled, "bid", "label", **sizes).collect()
        assert len(rows) == len(want) and {(r["bid"], r["label"]): r["n"] for r in rows} == want


def test_shares_make_no_row_for_a_point(spark):
    """What a building's points tell is counted by tag: evidence, podiums and shares write no row for each point within a building."""
    from cityloom.plans import publication

    v = plans.Views(spark, "/root/testdata/sf0.001")
    decided = publication.decided(v)
    assert "inside_pois" not in v.held and decided.count() == v.buildings.count()
    tags = [(r["bid"], r["amenity"], r["shop"]) for r in plans.building_pois(v).collect()]
    assert len(tags) == len(set(tags)) > 0
    assert plans.building_pois(v).agg(F.sum("n")).first()[0] == plans.inside_pois(v).count()


def test_traces_are_joined_once(spark):
    """A point's label is worked out before the join, and the pairs go straight to their buildings; they were written first."""
    from cityloom.plans import publication

    v = plans.Views(spark, "/root/testdata/sf0.001")
    rows = publication.poi_trace(v)
    assert not v.held
    said = v.pois.join(plans.inside_pois(v).where("sub IS NOT NULL").select("osmid", "bid"), "osmid").groupBy("bid").count()
    want = {r["bid"]: r["count"] for r in said.collect()}
    assert {r["bid"]: r["trace"].count("->") for r in rows.collect()} == want and want
