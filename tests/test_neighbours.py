"""Nearest neighbours, counts by cells, names, degrees and the repeatable log against plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cityloom.functions import alignment, geometry as geo
from cityloom.operators import models, neighbours as nb, spatial as sp, verdicts as vd


def brute_nearest(rows, k):
    out = {}
    for a, x in rows.items():
        d = sorted((math.sqrt(sum((p - q) ** 2 for p, q in zip(x, y))), b) for b, y in rows.items() if b != a)
        out[a] = [(b, round(t, 9)) for t, b in d[:k]]
    return out


@pytest.mark.parametrize("cell,k,dims", [(8, 5, 3), (1024, 3, 2), (4, 1, 9), (16, 7, 1)])
def test_nearest_equals_brute_force(spark, cell, k, dims):
    rng = random.Random(cell)
    rows = {n: [rng.choice([rng.uniform(-50, 50), float(rng.randint(0, 3)), 1000 * rng.random()]) for _ in range(dims)] for n in range(220)}
    for n in range(220, 280):  # equal vectors, more of them than any point needs
        rows[n] = rows[0] if n < 260 else rows[n % 7]
    df = spark.createDataFrame([(n, *x) for n, x in rows.items()], "bid long, " + ", ".join(f"x{c} double" for c in range(dims))).repartition(3)
    got = {}
    for r in nb.nearest(df, "bid", [f"x{c}" for c in range(dims)], k, cell=cell).collect():
        got.setdefault(r["bid"], []).append((r["rank"], r["n_bid"], round(r["d"], 9), [r[f"n_x{c}"] for c in range(dims)]))
    want = brute_nearest(rows, k)
    assert {a: [(b, d) for _, b, d, _ in sorted(v)] for a, v in got.items()} == want
    assert all(x == rows[b] for v in got.values() for _, b, _, x in v)


def test_nearest_of_few_points_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.0, None), (2, 3.0, 0.0), (3, 0.0, 4.0)], "bid long, a double, b double")
    got = sorted((r["bid"], r["rank"], r["n_bid"], r["d"]) for r in nb.nearest(df, "bid", ["a", "b"], 5).collect())
    assert got == [(1, 1, 2, 3.0), (1, 2, 3, 4.0), (2, 1, 1, 3.0), (2, 2, 3, 5.0), (3, 1, 1, 4.0), (3, 2, 2, 5.0)]
    assert nb.nearest(df.limit(1), "bid", ["a", "b"], 5).count() == 0 and nb.nearest(df.limit(0), "bid", ["a", "b"], 5).count() == 0


@pytest.mark.parametrize("few,levels", [(32, 7), (1, 4), (2, 1)])
def test_counts_equal_brute_force(spark, few, levels):
    rng = random.Random(few)
    rows = [(n, rng.gauss(0, 20) if n % 3 else 5.0 + n % 4, rng.gauss(0, 20) if n % 3 else -5.0, rng.choice(["a", "b", None])) for n in range(300)]
    rows += [(900, 50.0, 0.0, "a"), (901, 0.0, 0.0, "b"), (902, 1e6, 1e6, "b"), (903, 60.0, 80.0, None)]
    df = spark.createDataFrame(rows, "bid long, px double, py double, label string").repartition(3)
    near = {a[0]: [b for b in rows if math.hypot(a[1] - b[1], a[2] - b[2]) <= 50] for a in rows}
    got = {r["bid"]: r["n"] for r in sp.counted(df, "bid", 50.0, few=few, levels=levels).collect()}
    assert got == {a: len(v) for a, v in near.items()}
    labelled = {(r["bid"], r["label"]): r["n"] for r in sp.counted(df, "bid", 50.0, "label", few=few, levels=levels).collect()}
    assert labelled == {(a, x): n for a, v in near.items() for x in ("a", "b") if (n := sum(b[3] == x for b in v))}


def test_common_subsequences_of_many_pairs():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdé漢𠀀 ") for _ in range(n))
    pairs = [(word(rng.choice([0, 1, 5, 63, 64, 65, 130, 300])), word(rng.choice([0, 1, 7, 64, 128, 200]))) for _ in range(200)]
    got = alignment.common_subsequences([p for p, _ in pairs], [q for _, q in pairs])
    assert got.tolist() == [alignment.common_subsequence(p, q) for p, q in pairs]
    assert alignment.common_subsequences([], []).tolist() == []


def test_name_ratio_of_repeated_and_missing_names(spark):
    rows = [(1, "abcd", "abxd"), (2, None, "x"), (3, "", ""), (4, "abcd", "abxd"), (5, "", "x"), (6, "x", None)]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    assert {r["k"]: r["r"] for r in df.select("k", alignment.name_ratio(F.col("a"), F.col("b")).alias("r")).collect()} == {1: 75.0, 2: 0.0, 3: 100.0, 4: 75.0, 5: 0.0, 6: 0.0}


def test_there_and_back_within_a_millimetre(spark):
    lon, lat = (g.ravel() for g in np.meshgrid(np.linspace(113.8, 114.5, 60), np.linspace(22.1, 22.6, 60)))
    east, north = geo._forward(np.radians(lon), np.radians(lat))
    back = geo.degrees_of(east, north)
    assert np.abs(back[0] - lon).max() * 111_320 < 1e-3 and np.abs(back[1] - lat).max() * 111_320 < 1e-3
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon[::97], lat[::97])] + [(None, 22.3)], "lon double, lat double")
    x, y = geo.wgs84_to_grid(F.col("lon"), F.col("lat"))
    placed = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    for r in placed.select("lon", "lat", "x", "y", geo.grid_to_wgs84(F.col("x"), F.col("y")).alias("at")).collect():
        if r["lon"] is None:
            assert r["at"] is None
            continue
        assert abs(r["at"]["lon"] - r["lon"]) < 1e-8 and abs(r["at"]["lat"] - r["lat"]) < 1e-8
        e, n = geo._forward(np.radians([r["lon"]]), np.radians([r["lat"]]))
        assert abs(e[0] - r["x"]) < 1e-6 and abs(n[0] - r["y"]) < 1e-6


def test_a_failed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda a, b: spark.range(a, b).select("id", F.lit("keep").alias("decision"))
    vd.append_log(rows(0, 5), path, 0)
    breaks = F.udf(lambda n: 1 / (n - 7), "double")
    with pytest.raises(Exception):
        vd.append_log(rows(5, 10).repartition(5).withColumn("x", breaks("id")).where("x IS NOT NULL").drop("x"), path, 1)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]
    for _ in range(2):
        vd.append_log(rows(5, 10), path, 1)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(10))
    vd.append_log(rows(0, 0), path, 1)
    assert sorted((r["id"], r["batch"]) for r in spark.read.parquet(path).collect()) == [(n, 0) for n in range(5)]


def test_streamed_batches(spark, tmp_path):
    for n in range(3):
        spark.range(10 * n, 10 * n + 4).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))

    def twice(rows, n):
        vd.append_log(rows, str(tmp_path / "log"), n)
        vd.append_log(rows, str(tmp_path / "log"), n)

    stream.writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [10 * n + k for n in range(3) for k in range(4)]


def test_models_are_judged_and_fitted_anew(spark):
    rng = random.Random(5)
    rows = []
    for n in range(600):
        x = rng.uniform(0, 10)
        rows.append((n, x, rng.random(), n % 3 > 0, n % 5 > 0, int(x > 9) if n % 3 else 0, 0))
    df = spark.createDataFrame(rows, "bid long, x double, y double, labelled boolean, train boolean, high int, none int")
    out, scores = models.refitted(df, ["high", "none"], columns=["x", "y"], rounds=3)
    got = {r["bid"]: (r["proba_high"], r["proba_none"]) for r in out.collect()}
    assert len(got) == 600 and {p for _, p in got.values()} == {0.0}
    assert np.mean([(got[r[0]][0] >= 0.5) == (r[1] > 9) for r in rows]) > 0.97
    assert [r["label"] for r in scores.collect()] == ["high"] and scores.first()["f1"] > 0.8
