"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. The whole part of target / size is certain for each of its documents. The rest is one more
copy of some: a document's inclusion probability for it grows with the root of its size class, scaled so that the expected
words are those left over; where that would exceed one, the copy is certain. Documents are ranked by the odds of a random number
over their inclusion odds, and taken in that order until the words left over are used up: a sample of fixed size in words. At
last the one document, if any, that brings the source closer to its target is added.

What is worked out for a source (its facts) decides every document by itself: no join on documents, no numbering of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.llm.common import drop_table, write_table

WORD = r"[^\x20\x09-\x0D]+"
#: A source's running total is taken over this many steps of the ranking, then over as many of the step it ends in.
STEPS = 64
#: Sources up to which what is known of them is broadcast.
FEW = 10_000


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 5, *more: Column) -> DataFrame:
    """``id, source, size, u`` and more: the number of words of every text (null: 0), and a random number in (0, 1) from id, text and seed."""
    text = F.col(text_col).cast("string")
    u = (F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), u.alias("u"), *more)


def _ranked(totals: DataFrame) -> DataFrame:
    """totals with ``place``, the number of the source by code point, null last: sorted in ranges, each numbered by itself."""
    key = [F.col("source").isNull(), F.encode("source", "utf-8")]
    ranges = write_table(totals.repartitionByRange(*key).withColumn("range", F.spark_partition_id()), "ranges")
    upto = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # as many rows as ranges
    before = ranges.groupBy("range").agg(F.count("*").alias("many")).withColumn("before", F.coalesce(F.sum("many").over(upto), F.lit(0))).select("range", "before")
    place = F.row_number().over(Window.partitionBy("range").orderBy(*key)) + F.col("before") - 1
    return ranges.join(F.broadcast(before), "range").select("source", "source_size", place.alias("place"))


def targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources by code point, null last, have the weights in turn. They share all words in proportion; a target that exceeds
    most_copies times its source's size stops there, and the rest is shared again by weight, until none is above. Each turn of
    that is one sum over the sources; as sizes and weights are whole numbers, sums don't depend on their order.
    """
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    t = write_table(_ranked(totals).select("source", "source_size", (F.col("source_size") * most_copies).alias("limit"), w.cast("long").alias("w")), "weighted")
    whole = t.agg(F.sum("source_size"), F.sum("w")).first()
    free, level = whole[0] or 0, 0.0
    if free:
        level, before = free / whole[1], -1.0
        while level != before:
            above = F.col("w") * F.lit(level) > F.col("limit")
            capped, open_w = t.agg(F.sum(F.when(above, F.col("limit"))), F.sum(F.when(~above, F.col("w")))).first()
            level, before = ((free - (capped or 0)) / open_w if open_w else level), level
    return t.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("w") * F.lit(float(level))).alias("target"))


def _weight(size: Column) -> Column:
    """Root of the size class; classes are half powers of two, so that a source has few."""
    return F.pow(F.lit(2.0), F.floor(F.lit(2.0) * F.log2(size.cast("double"))) / 4)


def _joined(rows: DataFrame, facts: DataFrame, few: bool) -> DataFrame:
    """rows with the facts of their source; a row for each source: broadcast where there are no more than FEW of them."""
    named = facts.withColumnRenamed("source", "s")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("s"))).drop("s")


def _chance() -> Column:
    """Inclusion probability of one more copy."""
    return F.when((F.col("size") > 0) & (F.col("scale") > 0), F.least(F.lit(1.0), F.col("scale") * _weight(F.col("size")))).otherwise(0.0)


def _z() -> Column:
    """Place in the Pareto order, in 0 to 1: q / (1 + q) of q = odds of u over inclusion odds; 1 where the chance is 0."""
    p, u = _chance(), F.col("u")
    return F.when(p <= 0, 1.0).otherwise(u * (1 - p) / (u * (1 - p) + (1 - u) * p))


def _boundary(rows: DataFrame, budget: DataFrame, fine: int, few: bool) -> DataFrame:
    """``source, step, room`` for each source of budget (source, room): the step of rows (source, size, z) that its running total ends in,
    and what the steps before it leave; without a row where the total stays below."""
    step = F.floor(F.col("z") * fine)
    sums = rows.groupBy("source", step.alias("step")).agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = _joined(sums.withColumn("run", F.sum("words").over(upto)), budget, few)
    ends = runs.where("run > room").groupBy("source").agg(F.min(F.struct("step", (F.col("room") - F.col("run") + F.col("words")).alias("left"))).alias("e"))
    return ends.select("source", "e.step", F.col("e.left").alias("room"))


def source_facts(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """``source, source_size, target, base, scale, cut, pick``: what decides the copies of each source's documents.

    base copies are certain; documents up to cut in the Pareto order, and the one at pick, have one more.
    """
    goal = write_table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_copies), "targets")
    few = goal.count() <= FEW
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    goal = goal.withColumn("base", F.least(F.floor(rate + 1e-12), F.lit(most_copies)).cast("long")).withColumn("more", F.greatest(F.col("target") - F.col("base") * F.col("source_size"), F.lit(0.0)))
    live = _joined(sized.where("size > 0"), goal.where(f"more > 0 AND base < {most_copies}"), few)
    # the largest classes are certain until the scale of the rest gives none a chance above one
    classes = live.groupBy("source", _weight(F.col("size")).alias("w")).agg(F.sum("size").alias("words"), F.max("more").alias("more"))
    down = Window.partitionBy("source").orderBy(F.desc("w"))
    sure = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("w")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    scales = classes.withColumn("c", (F.col("more") - sure) / rest).where("c * w <= 1.000000001").groupBy("source").agg(F.max_by("c", "w").alias("scale"))
    facts = write_table(_joined(goal, scales, few), "scales")
    ranked = _joined(sized.where("size > 0"), facts.select("source", "scale", "more"), few).select("source", "size", "more", _z().alias("z")).where("z < 1")
    budget = facts.select("source", F.col("more").alias("room"))
    coarse = write_table(_boundary(ranked, budget, STEPS, few), "coarse")
    near = _joined(ranked, coarse.withColumnRenamed("step", "k"), few).where(F.floor(F.col("z") * STEPS) == F.col("k"))
    fine = write_table(_boundary(near.select("source", "size", "z"), coarse.select("source", "room"), STEPS * STEPS, few), "fine")
    last = _joined(ranked, fine.withColumnRenamed("step", "k"), few).where(F.floor(F.col("z") * (STEPS * STEPS)) == F.col("k"))
    # rows that share a place (equal id and text) are taken together or not at all
    upto = Window.partitionBy("source").orderBy("z").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = last.withColumn("run", F.sum("size").over(upto)).groupBy("source").agg(F.max(F.when(F.col("run") <= F.col("room"), F.col("z"))).alias("within"))
    cuts = fine.join(ends.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("within", F.col("step") / (STEPS * STEPS) - 1e-15).alias("cut"))
    # a source without a boundary takes all that it ranks
    named = cuts.withColumnRenamed("source", "s")
    facts = write_table(facts.join(named, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "base", "more", "scale", F.coalesce("cut", F.lit(1.0)).alias("cut")), "cuts")
    taken = _joined(ranked.drop("more"), facts.select("source", "more", "cut"), few)
    left = taken.groupBy("source").agg((F.max("more") - F.coalesce(F.sum(F.when(F.col("z") <= F.col("cut"), F.col("size"))), F.lit(0))).alias("left"))
    free = _joined(taken.where("z > cut").drop("more"), write_table(left, "left"), few).where("size < 2 * left")
    picks = free.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "z")).alias("p")).select(F.col("source").alias("s"), F.col("p.z").alias("pick"))
    known = facts.join(picks, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "base", "scale", "cut", "pick").withColumnRenamed("source", "s")
    out = goal.join(known.drop("base"), F.col("source").eqNullSafe(F.col("s")), "left")
    out = write_table(out.select("source", "source_size", "target", "base", F.coalesce("scale", F.lit(0.0)).alias("scale"), F.coalesce("cut", F.lit(-1.0)).alias("cut"), F.coalesce("pick", F.lit(-1.0)).alias("pick")), "facts")
    for table in (coarse, fine, facts):
        drop_table(table)
    return out


def decided(sized: DataFrame, facts: DataFrame) -> DataFrame:
    """sized (id, source, size, u and any more columns) with the facts of its source, ``chance`` and ``copies``."""
    rows = _joined(sized, facts, facts.count() <= FEW)
    more = (F.col("size") > 0) & ((F.col("z") <= F.col("cut")) | (F.col("z") == F.col("pick")))
    return rows.withColumn("chance", _chance()).withColumn("z", _z()).withColumn("copies", F.col("base") + F.when(more & (F.col("chance") > 0), 1).otherwise(0))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3, seed: int = 5) -> DataFrame:
    """``doc_id, size, source_size, target, chance, copies, taken`` for every row of df; taken = copies x size.

    chance is the inclusion probability of a copy beyond the certain ones. Null texts have no words; documents without words get
    the certain copies and no more. A null source is a source of its own, the last. Repeated rows (equal id and text) share a
    place in the ranking and are taken together; ties in size between others are broken by the random numbers, which come from a
    hash of id, text and seed: reruns agree. Texts of any length count whole. An empty table gives an empty result; other columns
    are not read.
    """
    sized = write_table(sizes(df, id_col, text_col, source_col, seed), "sizes")
    out = decided(sized, source_facts(sized, weights, most_copies))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "chance", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3, seed: int = 5) -> DataFrame:
    """Rows of df, all columns, as often as ``mix`` takes each: the same decisions, made on the rows themselves."""
    sized = write_table(sizes(df, id_col, text_col, source_col, seed), "sizes")
    facts = source_facts(sized, weights, most_copies)
    row = F.struct(*[F.col(c) for c in df.columns]).alias("row")
    copies = decided(sizes(df, id_col, text_col, source_col, seed, row), facts).where("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
