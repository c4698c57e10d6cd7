"""Row and table operators without geometry of their own: predicates on labels, joins by rule, samples, numbers, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.functions.text import UNKNOWN

# Sources that training trusts.
TRUSTED = ("OSM_Aggregation", "BDBIAR", "Keyword", "Keyword_Priority", "LandsD_Category", "Inherited_via_Consensus_merge", "Machine_Learning", "Corrected_by_Rule")


def high_confidence(source: Column) -> Column:
    """Whether a source is one of those trusted, by its whole text, or tells of a correction or an inheritance; null is not."""
    return F.coalesce(source.isin(*TRUSTED) | F.contains(source, F.lit("_LLM_Corrected")) | F.contains(source, F.lit("Inherited")), F.lit(False))


def class_family(label: Column) -> dict[str, Column]:
    """Tests of a label in either language: mixed, unknown, non_assessed. Null is none of them."""
    t = F.coalesce(label.cast("string"), F.lit(""))
    low = F.lower(t)
    one = lambda english, chinese: low.rlike(english) | F.contains(t, F.lit(chinese))
    return {"mixed": one("mixed[- ]use", "混合"), "unknown": one("unknown", "未知"), "non_assessed": one("non[- ]assessed", "非评估")}


def unknown_reset(df: DataFrame, main: str = "main", sub: str = "sub", source: str = "source") -> DataFrame:
    """df with main, sub and source of rows without a class set to the unknown ones."""
    lost = F.col(main).isNull() | F.lower(F.trim(main)).isin("", "nan", "unknown") | (F.col(main) == UNKNOWN)
    return df.withColumns({main: F.when(lost, UNKNOWN).otherwise(F.col(main)), sub: F.when(lost, UNKNOWN).otherwise(F.col(sub)), source: F.when(lost, "Unknown").otherwise(F.col(source))})


def split_by_kind(df: DataFrame, kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """(polygons and multipolygons, points) of a feature table; other kinds are in neither."""
    k = F.upper(F.col(kind))
    return df.where(k.isin("POLYGON", "MULTIPOLYGON")), df.where(k.isin("POINT", "MULTIPOINT"))


def join_right_wins(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join by key; of columns that both have, those of right stay, even where they are null."""
    return left.select(key, *[c for c in left.columns if c not in right.columns]).join(right, key)


def official_or_proxy(official: Column, proxy: Column) -> Column:
    """The official value where it is above 0, else the proxy."""
    return F.when(F.coalesce(official, F.lit(0.0)) > 0, official).otherwise(proxy)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a hash of seed and key: the same rows whatever the partitioning; ties by key."""
    return df.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256), key).limit(n)


def numbered(df: DataFrame, *order: str, name: str = "row_id") -> DataFrame:
    """df with consecutive numbers from 0 in the given order, which must leave no ties.

    Rows are sorted into ranges and numbered within each; only the ranges' sizes are summed in one place. The range of a row is a
    rank of its key among quantiles, so a repeated task gives the same numbers.
    """
    key = F.struct(*order)
    cuts = [r["k"] for r in df.select(key.alias("k")).withColumn("h", F.xxhash64("k")).where("h % 64 = 0").orderBy("h").limit(1024).select("k").collect()]
    at = sorted(cuts)[:: max(1, len(cuts) // 64)]
    part = F.lit(0)
    for n, cut in enumerate(at):
        part = F.when(key >= F.struct(*[F.lit(x).alias(c) for c, x in zip(order, cut)]), n + 1).otherwise(part)
    rows = df.withColumn("__part", part)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return rows.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def explode_vector(df: DataFrame, vector: Column, weight: Column, sub_to_main: Column, sub: str = "sub") -> DataFrame:
    """``main, sub, weight``: the weight of each row dealt to the labels of its vector (label: share), or to its sub class without one."""
    empty = vector.isNull() | (F.size(vector) == 0)
    whole = F.when(empty, F.create_map(F.coalesce(F.col(sub), F.lit(UNKNOWN)), F.lit(1.0))).otherwise(vector)
    rows = df.select(weight.alias("w"), F.explode(whole).alias("sub", "share"))
    return rows.select(F.coalesce(sub_to_main[F.col("sub")], F.lit(UNKNOWN)).alias("main"), "sub", (F.col("w") * F.col("share")).alias("weight"))


def coverage(df: DataFrame, matched: Column, weight: Column) -> DataFrame:
    """``rows, matched, share, weight_share``: how many rows match, by number and by weight (null weights count as 0)."""
    w = F.coalesce(weight, F.lit(0.0))
    return df.agg(F.count("*").alias("rows"), F.count_if(matched).alias("matched"), (F.count_if(matched) / F.count("*")).alias("share"), (F.sum(F.when(matched, w).otherwise(0.0)) / F.sum(w)).alias("weight_share"))


def taxonomy_text(labels: dict[str, tuple[str, ...]], strong: tuple[str, ...] = (), most: int = 40) -> str:
    """Main classes with their sub classes as lines, after the first strong keywords in Chinese characters."""
    chinese = [k for k in strong if any("\u4e00" <= ch <= "\u9fff" for ch in k)][:most]
    lines = [f"- Strong names: {', '.join(chinese)}"] if chinese else []
    return "\n".join([*lines, *[f"- {main}: {', '.join(subs)}" for main, subs in labels.items()]])
