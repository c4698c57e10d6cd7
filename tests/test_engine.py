"""The building-stock engine: registered queries against their SQL, grid joins against brute force, decision tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cityloom.functions import alignment, geometry as geo, text as tx
from cityloom.operators import evidence as ev, spatial as sp, verdicts as vd
from cityloom.plans import queries as plans
from cityloom.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(data):
    return sorted(tuple(repr(round(x, 5)) if isinstance(x, float) else repr(x) for x in r) for r in data)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.execute(f"select {', '.join(columns)} from ({plans.ORACLES[name]})").fetchall()
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("cell", [5.0, 40.0, 1000.0])
def test_grid_pairs_equal_brute_force(spark, cell):
    rng = random.Random(1)
    box = lambda: (x := rng.uniform(-200, 200), y := rng.uniform(-200, 200), x + rng.uniform(0, 60), y + rng.uniform(0, 60))
    a, b = [(k, *box()) for k in range(60)], [(k, *box()) for k in range(60)]
    left = spark.createDataFrame(a, "a long, x1 double, y1 double, x2 double, y2 double")
    right = sp.prefixed(spark.createDataFrame(b, "b long, x1 double, y1 double, x2 double, y2 double"), "f_")
    got = sp.grid_pairs(left, right, sp.BOX, ("f_x1", "f_y1", "f_x2", "f_y2"), cell, 7.0)
    want = {(p[0], q[0]) for p in a for q in b if p[1] - 7 <= q[3] and q[1] <= p[3] + 7 and p[2] - 7 <= q[4] and q[2] <= p[4] + 7}
    pairs = [(r["a"], r["f_b"]) for r in got.select("a", "f_b").collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_geometry(spark):
    ring = F.expr("transform(array(array(0,0),array(4,0),array(4,3),array(0,3),array(0,0)), p -> struct(cast(p[0] as double) as x, cast(p[1] as double) as y))")
    east, north = geo.to_grid(F.lit(114 + 10 / 60 + 42.80 / 3600), F.lit(22 + 18 / 60 + 43.68 / 3600))
    r = one(spark, area=geo.ring_area(ring), way=geo.ring_perimeter(ring), inside=geo.in_ring(F.lit(1.0), F.lit(1.0), ring), out=geo.in_ring(F.lit(5.0), F.lit(1.0), ring), d=geo.ring_distance(F.lit(7.0), F.lit(7.0), ring), ok=geo.valid_ring(ring), east=east, north=north)
    assert (r["area"], r["way"], r["inside"], r["out"], r["d"], r["ok"]) == (12.0, 14.0, True, False, 5.0, True)
    assert abs(r["east"] - 836694.05) < 0.01 and abs(r["north"] - 819069.80) < 0.01


def test_text(spark):
    r = one(
        spark, id=tx.normalize_id(F.lit(" 12.0 ")), none=tx.normalize_id(F.lit("NaN")), bad=tx.safe_number(F.lit("n/a"), 5), nan=tx.safe_number(F.lit("NaN")), blocks=tx.block_numbers(F.lit("Block 3, 第 7 座")),
        hits=tx.keyword_hits(F.lit("A School of barbers, bar"), ["bar", "school"]), main=tx.canon_main(F.lit("混合用途")), en=tx.label_english(F.lit("食肆（Restaurant）")), en2=tx.label_english(F.lit("Retail_零售")), reg=tx.registry_class(F.lit("工廠 住宅"))[0],
        verdict=tx.norm_verdict(F.lit("MERGE it")), json=tx.extract_json(F.lit("so {\"a\": {}} ok")), norm=tx.norm_label(F.lit("- a  (b) -")), fold=tx.fold_script(F.lit("樓"), "樓", "楼"),
        ratio=alignment.name_ratio(F.lit("abcd"), F.lit("abxd")), tokens=alignment.token_set_ratio(F.lit("big cafe"), F.lit("cafe BIG")), gone=alignment.token_set_ratio(F.lit(None).cast("string"), F.lit("x")),
    )
    assert (r["id"], r["none"], r["bad"], r["nan"], r["blocks"], r["hits"]) == ("12", "", 5.0, None, [3, 7], ["school", "bar"])
    assert (r["main"], r["en"], r["en2"], r["reg"], r["verdict"], r["json"], r["norm"], r["fold"]) == ("Mixed-use_混合用途", "Restaurant", "Retail", tx.RESIDENTIAL, "merge", '{"a": {}}', "a （b）", "楼")
    assert (r["ratio"], r["tokens"], r["gone"]) == (75.0, 100.0, 0.0)


def test_fusion_branches(spark):
    b = spark.createDataFrame([(k, c) for k, c in enumerate("141919")], "bid long, category string")
    e = spark.createDataFrame([(0, "GFA", tx.MIXED, None, 0.9, 100.0), (1, "OSM", tx.COMMERCIAL, None, 0.5, 20.0), (2, "OSM", tx.COMMERCIAL, None, 0.5, 60.0), (2, "GFA", tx.RESIDENTIAL, None, 0.5, 50.0), (3, "OSM", tx.COMMERCIAL, tx.RETAIL, 0.5, 45.0), (3, "BDBIAR", tx.COMMERCIAL, tx.OFFICE, 0.5, 45.0)], "bid long, src string, main string, sub string, conf double, weight double")
    got = {r["bid"]: (r["main"], r["sub"], r["source"], r["conf"]) for r in ev.fusion(b, e).collect()}
    assert got[0] == (tx.MIXED, tx.MIXED, "GFA_Mixed", 0.95) and got[1] == (tx.COMMERCIAL, tx.OTHER_COMMERCIAL, "低证据推断", 0.4) and got[2] == (tx.MIXED, tx.MIXED, "Fusion_Inferred_Mixed", 0.35)
    assert got[3] == (tx.COMMERCIAL, tx.OFFICE, "BDBIAR+OSM", 0.75) and got[5] == (tx.UNKNOWN, tx.UNKNOWN, "Unknown", 0.0)


def test_podium_counts_every_tagged_poi(spark):
    """Two of ten tagged POIs are no half, whether or not the others are known."""
    f = spark.createDataFrame([(k, tx.RESIDENTIAL, tx.PRIVATE_HOUSING, 0.5, "OSM") for k in (1, 2)], "bid long, main string, sub string, conf double, source string")
    b = spark.createDataFrame([(1, "P"), (2, "P")], "bid long, structure_type string")
    pois = [(k, "restaurant", None, None, None) for k in (1, 1, 2, 2)] + [(1, None, "odd", None, None)] * 8 + [(2, None, "odd", None, None), (2, "nan", None, None, None)]
    got = {r["bid"]: (r["main"], r["sub"], r["overridden"]) for r in ev.podium_override(f, b, spark.createDataFrame(pois, "bid long, amenity string, shop string, main string, sub string")).collect()}
    assert got == {1: (tx.RESIDENTIAL, tx.PRIVATE_HOUSING, False), 2: (tx.COMMERCIAL, tx.RESTAURANT, True)}


@pytest.mark.parametrize("rule", ["keep", "merge", "delete", None])
@pytest.mark.parametrize("verdict", ["keep", "merge", "delete", "error", None])
def test_pair_table(spark, rule, verdict):
    got = one(spark, s=vd.pair_arbitrate(F.lit(rule).cast("string"), F.lit(verdict).cast("string")))["s"]
    r = rule or "keep"
    assert got == (f"Rule-Only_{r}" if verdict in ("error", None) else vd.OUTCOME[r, verdict])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features": [{"properties": {"n": "x"}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}, {"properties": {"n": "y"}, "geometry": {"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    got = files.scan_geojson(spark, str(tmp_path / "a.json"), "n:string", True).orderBy("n").collect()
    assert (got[0]["kind"], got[0]["px"], got[0]["py"], len(got[1]["ring"])) == ("POINT", 1.5, 2.0, 4)
    (tmp_path / "k.json").write_text('{"M": {"s": ["A", "b"], "t": ["a"]}, "__STRONG__": ["q"]}')
    assert sorted(map(tuple, files.keyword_dim(spark, str(tmp_path / "k.json")).collect())) == [("a", "M", "t"), ("b", "M", "s")]
    (tmp_path / "z.json").write_text('{"features": [{"attributes": {"ZONE_LABEL": "C"}, "geometry": {"rings": [[[0,0],[1,0],[1,1],[0,0]]]}}, {"attributes": {"ZONE_LABEL": "D"}, "geometry": null}]}')
    assert [r["zone_label"] for r in files.scan_esri_zones(spark, str(tmp_path / "z.json")).collect()] == ["C"]
    import struct

    wkb = bytearray(struct.pack("<BIdd", 1, 1, 3.0, 4.0))
    pts = files.wkb_points(spark.createDataFrame([(1, wkb), (2, None)], "id long, g binary"), "g").orderBy("id").collect()
    assert (pts[0]["px"], pts[0]["py"], pts[1]["px"]) == (3.0, 4.0, None)
    df = spark.createDataFrame([(1, float("nan"), [1], "nan")], "a long, b double, c array<int>, d string")
    assert tuple(files.sanitized(df).first()) == ("1", "", "[1]", "")
    files.write_csv(df, str(tmp_path / "out"))
    files.write_features(df, str(tmp_path / "feat"), F.lit(None).cast("string"), ["c"])
    assert spark.read.text(str(tmp_path / "feat")).count() == 1
    assert files.ensure_columns(df, "a long, z string").columns == ["a", "z"]
