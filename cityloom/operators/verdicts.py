"""External verdicts as tables: whom to ask, what was answered, and how answers change a class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.functions.labels import SEPARATOR
from cityloom.functions.text import COMMERCIAL, DEFAULT_SUB, INDUSTRIAL, MIXED, NON_ASSESSED, OTHER_COMMERCIAL, OTHER_HOUSING, RESIDENTIAL, RESTAURANT, UNKNOWN, dominant_label, format_vector, meaningful_length

# Thresholds, tags, outcomes and source strings.
LEAST_CONFIDENCE, LEAST_PROBABILITY = 0.80, 0.5
NOTHING = ("none", "nan", "", "无", "null", "undefined")
SHOP_TAGS = r"\[(?:restaurant|shop|retail|clinic|bank|school|cafe|fast_food|supermarket|pharmacy|hospital|kindergarten|office)\]"
#: Outcome of a pair by (rule, verdict).
OUTCOME = {
    ("keep", "keep"): "Consensus_keep", ("keep", "merge"): "Manual_Review_AI_Wants_Merge", ("keep", "delete"): "Manual_Review_AI_Wants_Delete",
    ("merge", "keep"): "Final_keep_with_inheritance", ("merge", "merge"): "Consensus_merge", ("merge", "delete"): "Final_delete (AI overrides Rule_Merge)",
    ("delete", "keep"): "Final_keep_(AI_overrides_Rule_Delete)", ("delete", "merge"): "Final_merge_(AI_overrides_Rule_Delete)", ("delete", "delete"): "Consensus_delete",
}
INHERIT = ("Consensus_merge", "Final_keep_with_inheritance", "Rule-Only_merge", "Final_merge_(AI_overrides_Rule_Delete)")
DELETE = ("Consensus_delete", "Final_delete (AI overrides Rule_Merge)", "Rule-Only_delete")


def review_candidates(df: DataFrame, done: DataFrame, name: str, official: str, pois: str) -> DataFrame:
    """Rows (main, sub, conflicted) to ask about, without those in done (bid).

    They have a name of more than one letter, an official name or POIs, and are unknown, non-assessed, vaguely commercial or in
    conflict.
    """
    said = lambda c: ~F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))).isin(*NOTHING)
    told = said(official) | said(pois)
    vague = (F.col("main") == COMMERCIAL) & F.contains("sub", F.lit("其他"))
    open_case = F.col("main").isNull() | F.col("main").isin(UNKNOWN, "Unknown", "待评估") | ((F.col("main") == NON_ASSESSED) & told) | F.coalesce(vague, F.lit(False)) | F.coalesce("conflicted", F.lit(False))
    return df.where((meaningful_length(F.col(name)) > 1) & told & open_case).join(done.select("bid"), "bid", "left_anti")


def prompts(df: DataFrame, given: dict[str, Column], taxonomy: str) -> DataFrame:
    """Batch table of one prompt a row for an external model: what is given of a building, line by line, then the taxonomy."""
    lines = [F.concat(F.lit(f"{name}: "), F.coalesce(c.cast("string"), F.lit(""))) for name, c in given.items()]
    return df.withColumn("prompt", F.concat_ws("\n", F.lit("Label a building."), *lines, F.lit(taxonomy), F.lit("Answer in JSON: reasoning, main_class, sub_class, confidence from 0 to 1.")))


def latest(log: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Last row of each key."""
    return log.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def unit_vectors(subs: Column, sub_to_main: Column) -> tuple[Column, Column]:
    """(main, sub) vectors in which every sub class of a list has the same share; mains in the order in which they come."""
    n = F.size(subs)
    share = lambda k, x: F.concat(k, F.lit(":"), F.format_string("%.2f", x))
    mains = F.filter(F.transform(subs, lambda s: sub_to_main[s]), lambda m: m.isNotNull())
    main = F.transform(F.array_distinct(mains), lambda m: share(m, F.size(F.filter(mains, lambda x: x == m)) / n))
    return F.array_join(main, "-"), F.array_join(F.transform(subs, lambda s: share(s, 1 / n)), "-")


def verdict_merge(df: DataFrame, sub_to_main: Column) -> DataFrame:
    """Merged class, source and vectors from main, sub, source, pois, main_vector, sub_vector and v_main, v_sub, v_conf of a verdict (or nulls)."""
    valid = F.col("v_main").isin(RESIDENTIAL, COMMERCIAL, INDUSTRIAL, MIXED, NON_ASSESSED)
    missing = F.col("v_main").isNull() | F.col("v_main").isin("nan", "None", "", "解析失败", UNKNOWN) | (F.coalesce("v_conf", F.lit(0.0)) < LEAST_CONFIDENCE)
    rescued = sub_to_main[F.trim("v_main")]
    main = F.when(valid, F.col("v_main")).otherwise(rescued)
    guarded = (F.col("main") == MIXED) & F.lower(F.coalesce("pois", F.lit(""))).rlike(SHOP_TAGS) & (main != MIXED)
    how = F.when(missing, "kept").when(main.isNull(), "invented").when(guarded, "guarded").otherwise("taken")
    new_sub = F.when(valid, F.col("v_sub")).otherwise(F.col("v_main"))
    df = df.withColumns({"how": how, "t_main": main, "t_sub": new_sub})
    take = F.col("how") == "taken"
    subs = F.filter(F.transform(F.split(F.coalesce("t_sub", F.lit("")), SEPARATOR), F.trim), lambda s: s != "")
    mains, parts = unit_vectors(subs, sub_to_main)
    several, one = (F.col("t_main") == MIXED) & (F.size(subs) > 1), lambda c: F.concat(c, F.lit(":1.00"))
    source = F.when(take, F.concat(F.lit("LLM_Verified (Conf: "), F.format_string("%.2f", F.bround("v_conf", 2)), F.lit(")"))).when(F.col("how") == "invented", F.concat("source", F.lit(" (LLM Rejected - Hallucination)"))).when(F.col("how") == "guarded", F.concat("source", F.lit(" (LLM Override Rejected - Bottom Shop Protected)"))).otherwise(F.col("source"))
    return df.withColumns({
        "final_main": F.when(take, F.col("t_main")).otherwise(F.col("main")),
        "final_sub": F.when(take, F.col("t_sub")).otherwise(F.col("sub")),
        "final_source": source,
        "overridden": take,
        "final_main_vector": F.when(take & several, mains).when(take, one(F.col("t_main"))).otherwise(F.col("main_vector")),
        "final_sub_vector": F.when(take & several, parts).when(take, one(F.col("t_sub"))).otherwise(F.col("sub_vector")),
    })


def ml_summary(df: DataFrame, classes: dict[str, str]) -> DataFrame:
    """df with ``ml_conf, active, ml_main, ml_sub, ml_source`` from a probability column for each class.

    Classes of at least 0.5 are active: none is low confidence, one is that class, several are mixed use. Null probabilities count as 0.
    """
    p = {name: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for name, c in classes.items()}
    df = df.withColumn("ml_conf", F.greatest(*p.values())).withColumn("active", F.array_compact(F.array(*[F.when(x >= LEAST_PROBABILITY, F.lit(name)) for name, x in p.items()])))
    n, first = F.size("active"), F.get("active", F.lit(0))
    return df.withColumns({
        "ml_main": F.when(n == 0, UNKNOWN).when(n == 1, first).otherwise(MIXED),
        "ml_sub": F.when(n == 0, UNKNOWN).when(n == 1, first).otherwise(F.array_join(F.array_sort("active"), "/")),
        "ml_source": F.when(n == 0, "ML Low Confidence").when(n == 1, "ML Single Class").otherwise("ML Multi-Label"),
    })


def pair_arbitrate(rule: Column, verdict: Column) -> Column:
    """Suggestion for a pair; a missing rule counts as keep, a missing or failed verdict leaves the rule alone."""
    r = F.coalesce(F.nullif(rule, F.lit("")), F.lit("keep"))
    out = F.lit("Unknown_Conflict")
    for (a, b), name in OUTCOME.items():
        out = F.when((r == a) & (verdict == b), F.lit(name)).otherwise(out)
    return F.when(verdict.isNull() | verdict.isin("error", "unknown", ""), F.concat(F.lit("Rule-Only_"), r)).otherwise(out)


def resolve_hosts(pairs: DataFrame, fragment: str = "fragment_id", suggestion: str = "suggestion") -> DataFrame:
    """Suggestion of a pair in view of all hosts of its fragment."""
    w = Window.partitionBy(fragment)
    s = F.col(suggestion)
    strong = F.max(s.isin("Consensus_merge", "Final_keep_with_inheritance", "Final_merge_(AI_overrides_Rule_Delete)").cast("int")).over(w)
    keep = F.max(F.contains(s, F.lit("keep")).cast("int")).over(w)
    merges = F.sum(s.isin(*INHERIT).cast("int")).over(w)
    return pairs.withColumn("final", F.when((strong == 1) & (keep == 1), "Keep_Override").when(merges > 1, "Manual_Review_Multi_Host").otherwise(s))


def apply_pairs(buildings: DataFrame, pairs: DataFrame) -> DataFrame:
    """buildings (bid, main) with the class a merged fragment inherits from its host, and noise for deleted ones."""
    host = buildings.select(F.col("bid").alias("host_id"), F.col("main").alias("host_main"))
    gain = pairs.where(F.col("final").isin(*INHERIT)).join(host, "host_id").groupBy(F.col("fragment_id").alias("bid")).agg(F.min(F.struct("host_id", "host_main")).alias("h"))
    gone = pairs.where(F.col("final").isin(*DELETE)).select(F.col("fragment_id").alias("bid"), F.lit(True).alias("gone")).distinct()
    j = buildings.join(gain, "bid", "left").join(gone, "bid", "left")
    main = F.when(F.col("gone"), NON_ASSESSED).otherwise(F.coalesce("h.host_main", "main"))
    source = F.when(F.col("gone"), "Deleted").when(F.col("h").isNotNull(), F.concat(F.lit("Inherited_"), F.col("h.host_id").cast("string"))).otherwise(F.lit("Own"))
    return j.select("bid", main.alias("main"), source.alias("source"))


def apply_pair_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """rows (bid, main, sub, vector, source) after the pairs: a merged fragment takes its host's main, sub and vector, a deleted one is noise; others stay.

    Of several hosts the one with the smallest id counts; a host that is not among the rows gives nothing.
    """
    host = rows.select(F.col("bid").alias("host_id"), F.struct(F.col("bid").alias("host"), "main", "sub", "vector").alias("h"))
    gain = pairs.where(F.col("final").isin(*INHERIT)).join(host, "host_id").groupBy(F.col("fragment_id").alias("bid")).agg(F.min("h").alias("h"))
    gone = pairs.where(F.col("final").isin(*DELETE)).select(F.col("fragment_id").alias("bid"), F.lit(True).alias("gone")).distinct()
    j = rows.join(gain, "bid", "left").join(gone, "bid", "left")
    noise = {"main": F.lit(NON_ASSESSED), "sub": F.lit(NON_ASSESSED), "vector": F.lit(f"{NON_ASSESSED}:1.00"), "source": F.lit("Deleted")}
    taken = {**{c: F.col(f"h.{c}") for c in ("main", "sub", "vector")}, "source": F.concat(F.lit("Inherited_"), F.col("h.host").cast("string"))}
    return j.select("bid", *[F.when(F.col("gone"), noise[c]).when(F.col("h").isNotNull(), taken[c]).otherwise(F.col(c)).alias(c) for c in ("main", "sub", "vector", "source")])


def _cleaned(c: str) -> Column:
    t = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.regexp_replace(F.when(F.lower(t).isin("unknown", "nan", "none", ""), UNKNOWN).otherwise(t), "餐饮（(?:Catering|Restaurant)）", RESTAURANT)


def final_calibration(df: DataFrame) -> DataFrame:
    """``final_main, final_sub, final_vector, final_source, note`` beside the columns of df.

    From the rule's main, sub, source and vector, the area, and of the models ml_main, ml_conf, active and props (main: sub:
    share, or null). Non-assessed buildings are protected; complete decisions of a source that is not weak stay; models of less
    than 0.5 discard; else the models decide: several active classes by equal shares of their top sub classes, one by its shares;
    without a model class small footprints become housing and others commercial.
    """
    rule = {c: _cleaned(c) for c in ("main", "sub", "source")}
    mix = F.regexp_replace(F.trim(F.coalesce("vector", F.lit(""))), "餐饮（(?:Catering|Restaurant)）", RESTAURANT)
    odd = (mix == "") | F.contains(mix, F.lit("未知")) | F.lower(mix).rlike("unknown|nan")
    gap = F.when(rule["main"] == UNKNOWN, "全残(主类未知)").when(rule["sub"] == UNKNOWN, "半残(子类未知)").when(odd, "半残(比例空缺或异常)").otherwise("")
    source = F.trim(F.coalesce("source", F.lit("None")))
    weak = source.isin("Fallback_to_Default", "Fallback_to_Area", "None", "Unknown")
    sure, model = F.coalesce("ml_conf", F.lit(0.0)), F.coalesce("ml_main", F.lit(UNKNOWN))
    step = F.when(rule["main"] == NON_ASSESSED, "protected").when((gap == "") & ~weak, "rule").when(sure < LEAST_PROBABILITY, "discard").when(model == MIXED, "several").when(model != UNKNOWN, "one").when(F.col("area") < 100, "area").otherwise("default")
    df = df.withColumns({"step": step, "r_main": rule["main"], "r_sub": rule["sub"], "r_mix": mix, "gap": gap})
    defaults = F.create_map(*[F.lit(x) for m in (RESIDENTIAL, COMMERCIAL, INDUSTRIAL) for x in (m, DEFAULT_SUB[m])])

    def top(main: Column) -> Column:
        known = F.col("props")[main]
        found = F.when(known.isNotNull() & (F.size(known) > 0), dominant_label(known))
        return F.coalesce(found, defaults[main], F.lit(OTHER_COMMERCIAL))

    tops = F.transform(F.when(F.size("active") > 0, F.col("active")).otherwise(F.array(F.lit(RESIDENTIAL), F.lit(COMMERCIAL))), top)
    own = F.col("props")[F.col("ml_main")]
    best = F.when(F.col("step") == "several", F.get(tops, F.lit(0))).otherwise(top(F.col("ml_main")))
    unclear = F.contains(best, F.lit("未知")) | F.contains(best, F.lit("Unknown"))
    alone = F.when(own.isNotNull() & (F.size(own) > 0) & ~unclear, format_vector(F.map_filter(own, lambda _, x: x > 0))).otherwise(F.concat(F.when(unclear, OTHER_COMMERCIAL).otherwise(best), F.lit(":1.00")))
    shared = F.array_join(F.transform(tops, lambda s: F.concat(s, F.lit(":"), F.format_string("%.2f", 1 / F.size(tops)))), "-")
    # step: main, sub, vector, source
    low = "置信度过低归为非评估"
    outcome = {
        "protected": (F.lit(NON_ASSESSED), F.lit(NON_ASSESSED), F.lit(f"{NON_ASSESSED}:1.00"), F.concat(F.lit("Protected("), source, F.lit(")"))),
        "rule": (F.col("r_main"), F.col("r_sub"), F.col("r_mix"), F.concat(F.lit("Rule_Engine("), source, F.lit(")"))),
        "discard": (F.lit(NON_ASSESSED), F.lit(low), F.lit(f"{low}:1.00"), F.lit("ML_Low_Confidence_Discard")),
        "several": (F.col("ml_main"), best, shared, F.lit("Machine_Learning_Predicted")),
        "one": (F.col("ml_main"), F.when(unclear, OTHER_COMMERCIAL).otherwise(best), alone, F.lit("Machine_Learning_Predicted")),
        "area": (F.lit(RESIDENTIAL), F.lit(OTHER_HOUSING), F.lit(f"{OTHER_HOUSING}:1.00"), F.lit("Fallback_to_Area")),
        "default": (F.lit(COMMERCIAL), F.lit(OTHER_COMMERCIAL), F.lit(f"{OTHER_COMMERCIAL}:1.00"), F.lit("Fallback_to_Default")),
    }

    def chosen(n: int) -> Column:
        out = F.lit(None).cast("string")
        for name, values in outcome.items():
            out = F.when(F.col("step") == name, values[n]).otherwise(out)
        return out

    said = F.concat(F.lit("(P="), F.format_string("%.2f", F.bround(F.coalesce("ml_conf", F.lit(0.0)), 2)), F.lit(")"))
    prefix = F.when(F.col("gap") == "", "ML推断填补-").otherwise(F.concat(F.lit("ML覆盖["), F.col("gap"), F.lit("]-")))
    note = F.when(F.col("step") == "protected", "保留被判定为噪声/非评估的建筑").when(F.col("step") == "rule", "保留规则确定性结论").when(F.col("step") == "discard", F.concat(F.lit("ML推断置信度过低"), said)).when(F.col("step") == "area", "全流程未识别,小面积归住宅").when(F.col("step") == "default", "强制兜底为商业")
    note = F.coalesce(note, F.concat(prefix, F.when(F.col("step") == "several", "ML多标签混合").otherwise("ML回归精准分配"), said))
    out = {"final_main": chosen(0), "final_sub": chosen(1), "final_vector": chosen(2), "final_source": chosen(3), "note": note}
    return df.withColumns(out).drop("step", "r_main", "r_sub", "r_mix", "gap")


def pending(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the log does not have yet."""
    return rows.join(log.select(*keys).distinct(), keys, "left_anti")


def append_log(rows: DataFrame, path: str, batch: int | None = None) -> None:
    """Append decisions to the log.

    With a batch number the rows are that batch, whatever the log had of it: a batch that is written again, because it failed midway or its
    writer did not hear of its success, replaces itself, and no other batch is touched. So it fits ``foreachBatch``, which may repeat a
    batch: ``lambda rows, n: append_log(rows, path, n)``. A batch without rows leaves none behind.
    """
    if batch is None:
        rows.write.mode("append").parquet(path)
        return
    spark = rows.sparkSession
    if rows.isEmpty():
        gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch}")
        gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        return
    rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
