"""Features, models and their report on MLlib."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityloom.operators.neighbours import nearest
from cityloom.sources.files import growing, stored

FEATURES = ["area", "perimeter", "compactness", "px", "py", "zone_code", "density", "dominant_code", "height"]


def split(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """df with ``train``: four fifths of the keys by hash, whatever the partitioning."""
    return df.withColumn("train", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(5)) < 4)


def assembled(df: DataFrame, columns: list[str] = FEATURES) -> DataFrame:
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled)


def one_vs_rest(df: DataFrame, labels: list[str], key: str = "bid", rounds: int = 10) -> DataFrame:
    """``key, proba_<label>``: a boosted tree model for each 0/1 label column, fitted on the rows marked train, applied to all."""
    data = assembled(stored(df, "features"))
    out = data
    for label in labels:
        ones = data.where("train").agg(F.sum(label), F.count("*")).first()
        if not ones[0] or ones[0] == ones[1]:
            out = out.withColumn(f"proba_{label}", F.lit(float(bool(ones[0]))))
            continue
        weight = F.when(F.col(label) == 1, F.lit(ones[1] / (2.0 * ones[0]))).otherwise(F.lit(ones[1] / (2.0 * (ones[1] - ones[0]))))
        model = GBTClassifier(labelCol=label, featuresCol="features", weightCol="w", maxIter=rounds, maxDepth=4, seed=42, predictionCol=f"hat_{label}").setRawPredictionCol(f"raw_{label}").setProbabilityCol(f"p_{label}")
        out = model.fit(data.where("train").withColumn("w", weight)).transform(out).withColumn(f"proba_{label}", vector_to_array(f"p_{label}")[1])
    return out.select(key, *[f"proba_{c}" for c in labels])


def refitted(df: DataFrame, labels: list[str], key: str = "bid", columns: list[str] = FEATURES, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """(``key, proba_<label>`` of every row, ``label, f1`` of the validation rows).

    df has the features, the 0/1 labels, ``labelled`` and ``train``. Each label's model is fitted on the oversampled training rows and
    judged on the labelled rows kept back; then it is fitted anew on all labelled rows, oversampled too, and that model scores every row. A label that all or no labelled rows
    have is not learnt: every row gets that answer.
    """
    data = stored(df.select(key, "labelled", "train", *columns, *labels), "refit")
    every = assembled(data, columns)
    out, scores = data.select(key), []

    def model(rows: DataFrame, label: str):
        more = assembled(oversample(rows.select(key, *columns, label), label, key, columns), columns)
        return GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=4, seed=42).fit(more)

    for label in labels:
        ones, n, own, tried = data.where("labelled").agg(F.sum(label), F.count("*"), F.sum(F.when(F.col("train"), F.col(label))), F.count_if("train")).first()
        if not ones or ones == n:
            out = out.withColumn(f"proba_{label}", F.lit(float(bool(ones))))
            continue
        if own and own < tried:
            judged = model(data.where("labelled AND train"), label).transform(every.where("labelled AND NOT train"))
            hit, said, true = judged.agg(F.sum(F.col("prediction") * F.col(label)), F.sum("prediction"), F.sum(label)).first()
            scores.append((label, float(2 * (hit or 0) / ((said or 0) + (true or 0)) if (said or 0) + (true or 0) else 0.0)))
        final = model(data.where("labelled"), label).transform(every).select(key, vector_to_array("probability")[1].alias(f"proba_{label}"))
        out = out.join(final, key)
    return out, df.sparkSession.createDataFrame(scores, "label string, f1 double")


def share_model(df: DataFrame, label: str, classes: int, key: str = "bid", trees: int = 50, floor: float = 0.05) -> DataFrame:
    """``key, shares``: class shares of a forest's leaves, those above the floor."""
    data = assembled(df)
    model = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=trees, maxDepth=5, seed=42).fit(data.where("train"))
    p = vector_to_array("probability")
    shares = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.struct(i.alias("k"), F.get(p, i).alias("v"))))
    return model.transform(data).select(key, F.map_filter(shares, lambda _, v: v > floor).alias("shares"))


def sub_share_models(df: DataFrame, subs: dict[str, tuple[str, ...]], key: str = "bid", main: str = "main", sub: str = "sub", least: int = 50, trees: int = 50, floor: float = 0.05) -> DataFrame:
    """``key, main, shares`` (sub class: share above the floor, two places) for every row of df and every main class that has a model.

    df has the features, ``train``, and main and sub of the rows that are labelled, null elsewhere. A main class of fewer than least
    labelled rows has no model. A label counts as the first of the main class's sub classes, in order, whose Chinese part it holds
    or that holds it; a null or other label as the first of all. Models are fitted on the rows marked train.
    """
    df = stored(df, "sub-features")
    out = None
    for name, labels in subs.items():
        labels = tuple(sorted(labels))
        own = df.where(F.col(main) == name)
        if own.limit(least).count() < least:
            continue
        n = F.lit(0.0)
        for k, label in reversed(list(enumerate(labels))):
            fits = F.contains(F.col(sub), F.lit(label.split("（")[0])) | F.contains(F.lit(label), F.col(sub))
            n = F.when(F.coalesce(fits, F.lit(False)), float(k)).otherwise(n)
        model = RandomForestClassifier(labelCol="n", featuresCol="features", numTrees=trees, maxDepth=5, seed=42).fit(assembled(own.where("train").withColumn("n", n)))
        p = vector_to_array("probability")
        shares = F.map_from_entries(F.transform(p, lambda x, i: F.struct(F.element_at(F.array(*[F.lit(x) for x in labels]), i + 1).alias("k"), x.alias("v"))))
        rows = model.transform(assembled(df)).select(key, F.lit(name).alias("main"), F.transform_values(F.map_filter(shares, lambda _, v: v > floor), lambda _, v: F.round(v, 2)).alias("shares"))
        out = rows if out is None else out.unionByName(rows)
    return df.select(key, F.lit("").alias("main"), F.create_map(F.lit(""), F.lit(0.0)).alias("shares")).limit(0) if out is None else out


def f1_report(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """``label, support, precision, recall, f1`` of every true label."""
    hit = F.sum((F.col(truth) == F.col(guess)).cast("long"))
    t = df.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), hit.alias("hits"))
    g = df.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("guessed"))
    j = t.join(g, "label", "left").withColumns({"precision": F.coalesce(F.col("hits") / F.col("guessed"), F.lit(0.0)), "recall": F.col("hits") / F.col("support")})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.select("label", "support", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def _nearest(points: DataFrame, key: str, columns: list[str], k: int, cell: float | None = None) -> DataFrame:
    """``key``, the columns and ``near``: the k nearest others by the columns, or all if there are fewer, the closest first."""
    found = nearest(points, key, columns, k)
    near = F.sort_array(F.collect_list(F.struct("rank", "d", f"n_{key}", *[f"n_{c}" for c in columns]))).alias("near")
    return points.select(key, *columns).join(growing(found.groupBy(key).agg(near)), key)


def oversample(df: DataFrame, label: str, key: str, columns: list[str], least: int = 200, k: int = 5, cell: float | None = None) -> DataFrame:
    """df with synthetic rows of the positive class: points between a row and one of its k nearest by all the columns.

    Up to ``least`` positives if there are fewer; else as many as there are other rows, if positives are under half of all. The
    copies are dealt evenly over the positives, what is left over to those with the smallest hashes. Fewer than two positives
    stay as they are. Null columns count as 0. cell says nothing any more: the search has cells of its own.
    """
    rare = df.where(F.col(label) == 1)
    total, n = df.agg(F.count("*"), F.count(F.when(F.col(label) == 1, 1))).first()
    target = least if n < least else total - n if n and total / n > 2 else n
    points = rare.select(key, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    seeds = points.count() if n > 1 and target > n else 0
    if seeds < 2:
        return df
    whole, rest = divmod(target - n, seeds)
    best = _nearest(points, key, columns, k)
    more = points.select(F.col(key).alias("more")).orderBy(F.xxhash64("more", F.lit(1)), "more").limit(rest)
    copies = F.lit(whole) + F.col("more").isNotNull().cast("int")
    made = best.join(growing(more), F.col(key) == F.col("more"), "left").withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    other = F.get(F.col("near"), F.pmod(F.xxhash64(key, "copy"), F.size("near")).cast("int"))
    t = F.pmod(F.xxhash64("copy", key), F.lit(1000)) / 1000.0
    rows = made.select(F.lit(1).alias(label), *[(F.col(c) + t * (other[f"n_{c}"] - F.col(c))).alias(c) for c in columns], F.lit(True).alias("train"))
    return df.unionByName(rows, allowMissingColumns=True)
