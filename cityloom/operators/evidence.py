"""Evidence rows ``(bid, src, main, sub, conf, weight)`` from each source, and their fusion into one class per building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityloom.functions.automata import Keywords, with_hits
from cityloom.functions.text import (
    COMMERCIAL, DEFAULT_SUB, EDUCATION, HEALTH, INDUSTRIAL, MIXED, NOISE, NON_ASSESSED, NON_MANUFACTURING, OFFICE, OTHER_COMMERCIAL, OTHER_INDUSTRIAL, PRIVATE_HOUSING, PUBLIC_HOUSING, RESIDENTIAL, RESTAURANT, RETAIL, TEMPORARY, TRANSPORT, UNKNOWN, clean_tag, keyword_hits,
)
from cityloom.sources.files import growing

# Classes of category codes (others give no evidence), of words of a name, and of tags.
CATEGORY = {"1": (RESIDENTIAL, PRIVATE_HOUSING), "2": (RESIDENTIAL, PRIVATE_HOUSING), "3": (RESIDENTIAL, PUBLIC_HOUSING), "4": (COMMERCIAL, OTHER_COMMERCIAL)}
#: Words of a name that decide where nothing else does: word, main, sub, weight.
NAME_WORDS = (
    ("station", NON_ASSESSED, TRANSPORT, 65), ("restaurant", COMMERCIAL, RESTAURANT, 70), ("school", COMMERCIAL, EDUCATION, 70), ("hospital", COMMERCIAL, HEALTH, 70), ("garden", RESIDENTIAL, PRIVATE_HOUSING, 60),
    ("estate", RESIDENTIAL, PRIVATE_HOUSING, 60), ("factory", INDUSTRIAL, OTHER_INDUSTRIAL, 70), ("warehouse", INDUSTRIAL, NON_MANUFACTURING, 70), ("noise", NON_ASSESSED, NOISE, 70), ("temporary", NON_ASSESSED, TEMPORARY, 70),
)
#: Classes of tags.
TAG_CLASS = {
    "restaurant": (COMMERCIAL, RESTAURANT), "cafe": (COMMERCIAL, RESTAURANT), "fast_food": (COMMERCIAL, RESTAURANT), "bakery": (COMMERCIAL, RESTAURANT), "retail": (COMMERCIAL, RETAIL), "supermarket": (COMMERCIAL, RETAIL),
    "mall": (COMMERCIAL, RETAIL), "convenience": (COMMERCIAL, RETAIL), "bank": (COMMERCIAL, OFFICE), "office": (COMMERCIAL, OFFICE), "school": (COMMERCIAL, EDUCATION), "kindergarten": (COMMERCIAL, EDUCATION),
    "hospital": (COMMERCIAL, HEALTH), "clinic": (COMMERCIAL, HEALTH), "industrial": (INDUSTRIAL, OTHER_INDUSTRIAL), "warehouse": (INDUSTRIAL, NON_MANUFACTURING),
    "apartments": (RESIDENTIAL, PRIVATE_HOUSING), "residential": (RESIDENTIAL, PRIVATE_HOUSING), "house": (RESIDENTIAL, PRIVATE_HOUSING), "yes": (RESIDENTIAL, PRIVATE_HOUSING),
}
#: Tags that make a POI of a podium commercial by themselves.
PODIUM_TAGS = {
    "restaurant": RESTAURANT, "fast_food": RESTAURANT, "cafe": RESTAURANT, "bakery": RESTAURANT,
    "retail": RETAIL, "convenience": RETAIL, "supermarket": RETAIL, "mall": RETAIL, "optician": RETAIL, "eyewear_and_optician": RETAIL, "fruits_and_vegetables": RETAIL,
    "bank": OTHER_COMMERCIAL, "bank_credit_union": OTHER_COMMERCIAL, "real_estate": OTHER_COMMERCIAL, "hairdresser": OTHER_COMMERCIAL, "hair_salon": OTHER_COMMERCIAL, "beauty": OTHER_COMMERCIAL, "employment_agencies": OTHER_COMMERCIAL,
}
#: Building tags that are housing where a feature has no other tag, and what marks public housing in a name.
HOUSING_TAGS, PUBLIC_MARK = ("apartments", "residential", "house", "yes"), "邨"
SCHEMA = ("bid", "src", "main", "sub", "conf", "weight")
#: Sources of evidence in the order in which the first of equal weight gives the sub class.
SOURCES = ("GFA", "BDBIAR", "OSM", "LandsD_Category", "Keyword", "Name_Keyword")


def looked_up(c: Column, table: dict[str, tuple[str, ...]], pick: int) -> Column:
    return F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[pick])])[c]


def _rows(df: DataFrame, src: str, main: Column, sub: Column, conf: Column, weight: Column) -> DataFrame:
    return df.select("bid", F.lit(src).alias("src"), main.alias("main"), sub.alias("sub"), conf.cast("double").alias("conf"), weight.cast("double").alias("weight")).where("main IS NOT NULL")


def ev_gfa(gfa: DataFrame) -> DataFrame:
    """From registered floor areas (bid, domestic, nondomestic) of more than 20 in all."""
    total = F.col("domestic") + F.col("nondomestic")
    share = F.col("domestic") / total
    main = F.when(share > 0.99, RESIDENTIAL).when(share < 0.01, COMMERCIAL).otherwise(MIXED)
    shop = share < 0.01
    return _rows(gfa.where(total > 20), "GFA", main, F.when(share > 0.99, PRIVATE_HOUSING), F.when(shop, 0.9).otherwise(1.0), F.when(shop, 80).otherwise(100))


def ev_registry(matched: DataFrame, main: Column, sub: Column) -> DataFrame:
    return _rows(matched, "BDBIAR", main, sub, F.lit(0.6), F.lit(60))


def ev_category(buildings: DataFrame) -> DataFrame:
    return _rows(buildings, "LandsD_Category", looked_up(F.col("category"), CATEGORY, 0), looked_up(F.col("category"), CATEGORY, 1), F.lit(0.5), F.lit(50))


def crowd_class(features: DataFrame, keywords: dict[str, tuple[str, str]], building_name: Column) -> DataFrame:
    """features (shop, amenity, building, name) with main and sub.

    The first keyword in shop, amenity, building and name decides. A feature without amenity and shop is housing if its building
    tag says so, public housing if its name or the building's bears the mark of an estate; without a building tag it is unknown.
    """
    tag = {c: clean_tag(F.col(c)) for c in ("shop", "amenity", "building")}
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("shop", "amenity", "building", "name")])
    first = F.get(keyword_hits(text, list(keywords)), F.lit(0))
    bare, home = (tag["amenity"] == "") & (tag["shop"] == ""), tag["building"].isin(*HOUSING_TAGS)
    public = F.contains(F.coalesce("name", F.lit("")), F.lit(PUBLIC_MARK)) | F.contains(F.coalesce(building_name, F.lit("")), F.lit(PUBLIC_MARK))
    main = F.when(bare & home, RESIDENTIAL).when(bare & (tag["building"] == ""), UNKNOWN).otherwise(looked_up(first, keywords, 0))
    sub = F.when(bare & home, F.when(public, PUBLIC_HOUSING).otherwise(PRIVATE_HOUSING)).otherwise(looked_up(first, keywords, 1))
    return features.withColumns({"main": main, "sub": sub})


def crowd_votes(features: DataFrame) -> DataFrame:
    """Summed weight per (bid, main, sub) of classified features (bid, main, sub, weight); unknown classes don't vote."""
    return features.where(F.col("main").isNotNull() & (F.col("main") != UNKNOWN)).groupBy("bid", "main", "sub").agg(F.sum("weight").alias("votes"))


def ev_crowd(features: DataFrame) -> DataFrame:
    """Main and sub class with most votes (ties by name); weight 75 and 20 times the votes, 95 at most, 40 below 0.1 votes."""
    votes = crowd_votes(features)
    mains = votes.groupBy("bid", "main").agg(F.sum("votes").alias("votes"))
    top = mains.groupBy("bid").agg(F.min(F.struct((-F.round("votes", 9)).alias("v"), F.col("main").alias("main"))).alias("m"), F.sum("votes").alias("total"))
    subs = votes.where("sub IS NOT NULL").groupBy("bid", "sub").agg(F.sum("votes").alias("votes"))
    best = subs.groupBy("bid").agg(F.min(F.struct((-F.round("votes", 9)).alias("v"), F.col("sub").alias("sub"))).alias("s"))
    both = top.join(growing(best), "bid", "left")
    weight = F.when(F.col("total") < 0.1, 40.0).otherwise(75 + F.least(F.col("total") * 20, F.lit(20.0)))
    return _rows(both, "OSM", F.col("m.main"), F.col("s.sub"), F.least("total", F.lit(0.9)), weight)


# Words by which a keyword counts for more or less.
_FUNCTIONAL = r"\b(?:building|tower|block|hall|house|centre)\b|大厦|大楼|中心|馆"
_SHOP, _PLANT = "commercial|商業|office|寫字樓|centre", "industrial|工業|factory|工廠|warehouse"


def keyword_evidence(buildings: DataFrame, keywords: dict[str, tuple[str, str]], strong: list[str]) -> DataFrame:
    """``bid, main, sub, weight`` of every keyword (word: main, sub) in a building's text; buildings: bid, category, text, area.

    50; non-assessed 65, or 30 for a text that names a building of more than 50 square metres; commercial and industrial words
    with such a term 80; any strong keyword in the text 90; commercial in a residential category without more 10.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    rows = buildings.select("bid", "category", "area", low.alias("low"), F.explode(F.array_distinct(keyword_hits(F.col("text"), list(keywords)))).alias("k"))
    rows = rows.withColumns({"main": looked_up(F.col("k"), keywords, 0), "sub": looked_up(F.col("k"), keywords, 1)})
    large = F.col("low").rlike(_FUNCTIONAL) & (F.coalesce("area", F.lit(0.0)) > 50)
    term = ((F.col("main") == COMMERCIAL) & F.col("low").rlike(_SHOP)) | ((F.col("main") == INDUSTRIAL) & F.col("low").rlike(_PLANT))
    weight = F.when(F.size(keyword_hits(F.col("low"), strong)) > 0, 90).when(F.col("main") == NON_ASSESSED, F.when(large, 30).otherwise(65)).when(term, 80)
    weight = weight.when((F.col("main") == COMMERCIAL) & F.col("category").isin("1", "2", "3"), 10).otherwise(50)
    return rows.select("bid", "main", "sub", weight.alias("weight"))


def keyword_hits_evidence(buildings: DataFrame, keywords: Keywords, table: DataFrame, strong: tuple[str, ...]) -> DataFrame:
    """As keyword_evidence, for keywords of a table (keyword, main, sub) of any number: all of a text are found in one pass, their classes joined from the table.

    A keyword is strong if it is among those found; equal rows of the table are one. buildings: bid, category, text, area; keywords is the automaton of the table, in lower case.
    """
    rows = buildings.select("bid", "category", "area", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    found = with_hits(rows, F.col("low"), keywords, "found").withColumn("strong", F.arrays_overlap("found", F.array(*[F.lit(s) for s in strong]).cast("array<string>")))
    each = found.withColumn("keyword", F.explode(F.array_distinct("found"))).join(growing(table.select("keyword", "main", "sub").distinct()), "keyword")
    large = F.col("low").rlike(_FUNCTIONAL) & (F.coalesce("area", F.lit(0.0)) > 50)
    term = ((F.col("main") == COMMERCIAL) & F.col("low").rlike(_SHOP)) | ((F.col("main") == INDUSTRIAL) & F.col("low").rlike(_PLANT))
    weight = F.when(F.col("strong"), 90).when(F.col("main") == NON_ASSESSED, F.when(large, 30).otherwise(65)).when(term, 80)
    weight = weight.when((F.col("main") == COMMERCIAL) & F.col("category").isin("1", "2", "3"), 10).otherwise(50)
    return each.select("bid", "main", "sub", weight.alias("weight"))


def ev_keyword(hits: DataFrame) -> DataFrame:
    """Heaviest keyword evidence of a building from (bid, main, sub, weight); ties by main, then sub."""
    best = hits.groupBy("bid").agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("main").alias("main"), F.col("sub").alias("sub"))).alias("k"))
    return _rows(best, "Keyword", F.col("k.main"), F.col("k.sub"), -F.col("k.w") / 100, -F.col("k.w"))


def ev_name(buildings: DataFrame, evidence: DataFrame, name: Column) -> DataFrame:
    """For category 9 without any evidence: the heaviest word of the name, the first in the list among equals."""
    low = F.lower(F.coalesce(name, F.lit("")))
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.struct(F.lit(-weight).alias("w"), F.lit(n).alias("n"), F.lit(main).alias("main"), F.lit(sub).alias("sub"))) for n, (w, main, sub, weight) in enumerate(NAME_WORDS)]))
    bare = buildings.where("category = '9'").join(growing(evidence.select("bid").distinct()), "bid", "left_anti").withColumn("k", F.array_min(hits))
    return _rows(bare.where("k IS NOT NULL"), "Name_Keyword", F.col("k.main"), F.col("k.sub"), -F.col("k.w") / 100, -F.col("k.w"))


def score_board(evidence: DataFrame) -> DataFrame:
    """Per building the two mains with the largest summed weight (ties by name), the weight of all evidence, and of the winner its sources and the sub class of its heaviest evidence."""
    order = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in SOURCES]), F.col("src")), F.lit(0))
    heaviest = F.min(F.when(F.col("sub").isNotNull() & (F.col("sub") != UNKNOWN), F.struct((-F.col("weight")).alias("w"), order.alias("o"), F.col("sub").alias("sub"))))
    sums = evidence.groupBy("bid", "main").agg(F.sum("weight").alias("score"), F.array_join(F.array_sort(F.collect_set("src")), "+").alias("sources"), heaviest["sub"].alias("sub"))
    rank = F.row_number().over(Window.partitionBy("bid").orderBy(F.round("score", 9).desc(), "main"))
    ranked = sums.withColumn("rn", rank)
    at = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    return ranked.groupBy("bid").agg(
        at(1, "main").alias("winner"), at(1, "score").alias("score"), at(2, "main").alias("runner_up"), at(2, "score").alias("runner_score"), F.sum("score").alias("total"), at(1, "sources").alias("sources"), at(1, "sub").alias("sub")
    )


def fusion(buildings: DataFrame, evidence: DataFrame) -> DataFrame:
    """``bid, main, sub, conf, conflicted, mixed, source`` for every building, before its shares are worked out.

    A floor area that says mixed decides alone. Without evidence: unknown. Evidence of less than 30 in all: the category's class.
    A winner of less than 1.5 times the runner-up, neither of them mixed, is a conflict and becomes mixed. Else the source names
    all sources of the winner, and the sub class is that of its heaviest evidence, or the default one.
    """
    by_area = evidence.where((F.col("src") == "GFA") & (F.col("main") == MIXED)).select("bid", F.lit(True).alias("area_mixed")).distinct()
    b = buildings.select("bid", "category").join(growing(score_board(evidence)), "bid", "left").join(growing(by_area), "bid", "left")
    conflict = F.coalesce((F.col("score") < 1.5 * F.col("runner_score")) & (F.col("winner") != MIXED) & (F.col("runner_up") != MIXED), F.lit(False))
    b = b.withColumn("case", F.when(F.col("area_mixed"), "area").when(F.col("winner").isNull(), "none").when(F.col("total") < 30, "little").when(conflict, "conflict").otherwise("won"))
    case = lambda *names: F.col("case").isin(*names)
    fallback = lambda pick: F.coalesce(looked_up(F.col("category"), CATEGORY, pick), F.lit(UNKNOWN))
    main = F.when(case("area", "conflict"), MIXED).when(case("none"), UNKNOWN).when(case("little"), fallback(0)).otherwise(F.col("winner"))
    default = F.coalesce(looked_up(F.col("winner"), {k: (v,) for k, v in DEFAULT_SUB.items() if k != NON_ASSESSED}, 0), F.lit(UNKNOWN))
    sub = F.when(main == MIXED, MIXED).when(case("none"), UNKNOWN).when(case("little"), fallback(1)).otherwise(F.coalesce("sub", default))
    source = F.when(case("area"), "GFA_Mixed").when(case("none"), "Unknown").when(case("little"), "低证据推断").when(main == MIXED, "Fusion_Inferred_Mixed").otherwise(F.col("sources"))
    base = F.least(F.col("score") / 120, F.lit(0.99))
    conf = F.when(case("area"), 0.95).when(case("none"), 0.0).when(case("little"), 0.4).when(case("conflict"), base * 0.7).otherwise(base)
    return b.select("bid", main.alias("main"), sub.alias("sub"), F.round(conf, 6).alias("conf"), case("conflict").alias("conflicted"), (main == MIXED).alias("mixed"), source.alias("source"))


def podium_class(amenity: Column, shop: Column, main: Column, sub: Column) -> tuple[Column, Column, Column]:
    """(commercial, sub class, reason) of a POI by its tags; main and sub are what else is known of it. Untagged ones are skipped."""
    a, s = F.lower(clean_tag(amenity)), F.lower(clean_tag(shop))
    table = F.create_map(*[F.lit(x) for p in PODIUM_TAGS.items() for x in p])
    tag = F.when(a != "", a).otherwise(s)
    known = F.coalesce((main == COMMERCIAL) & (sub != UNKNOWN), F.lit(False))
    found = F.coalesce(table[a], table[s], F.when((tag != "") & known, sub))
    reason = F.when(tag == "", "skip:no_amenity_shop").when(table[a].isNotNull(), F.concat(F.lit("amenity:"), a)).when(table[s].isNotNull(), F.concat(F.lit("shop:"), s)).when(known, F.concat(F.lit("fallback:"), tag)).otherwise(F.concat(F.lit("unmapped:"), tag))
    return found.isNotNull(), found, reason


def times(rows: DataFrame) -> DataFrame:
    """rows with n, how often each stands; once where that column is missing."""
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(1))


def podium_override(fused: DataFrame, buildings: DataFrame, pois: DataFrame) -> DataFrame:
    """fused with ``overridden``: podiums won by residential become commercial if at least two POIs, and half of those with an amenity or a shop, are commercial.

    pois are ``bid, amenity, shop, main, sub``, and n where a row stands for several. The sub class is the one of most such POIs (ties by name), the confidence that of
    a weight of 95 at least, and the override is the only source.
    """
    commercial, sub, reason = podium_class(F.col("amenity"), F.col("shop"), F.col("main"), F.col("sub"))
    tagged = times(pois).select("bid", commercial.alias("hit"), sub.alias("p_sub"), "n").where(~reason.startswith("skip"))
    per_sub = tagged.groupBy("bid", "p_sub").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("h"))
    counts = per_sub.groupBy("bid").agg(F.sum("h").alias("hits"), F.sum("n").alias("tagged"), F.min(F.when(F.col("h") > 0, F.struct((-F.col("h")).alias("n"), "p_sub")))["p_sub"].alias("p_sub"))
    j = fused.join(growing(buildings.select("bid", "structure_type")), "bid").join(growing(counts), "bid", "left")
    turn = F.coalesce((F.col("structure_type") == "P") & (F.col("main") == RESIDENTIAL) & (F.col("hits") >= 2) & (F.col("hits") >= 0.5 * F.col("tagged")), F.lit(False))
    j = j.withColumn("overridden", turn)
    new = {"main": F.lit(COMMERCIAL), "sub": F.col("p_sub"), "conf": F.greatest("conf", F.round(F.lit(95 / 120), 6)), "source": F.lit("Podium_Commercial_Override")}
    return j.select("bid", *[F.when(F.col("overridden"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in fused.columns if c != "bid"], "overridden")


def sub_shares(weighted: DataFrame) -> DataFrame:
    """``bid, sub, share``: each sub class's part of a building's weight (bid, sub, weight)."""
    sums = weighted.groupBy("bid", "sub").agg(F.sum("weight").alias("w"))
    total = F.sum("w").over(Window.partitionBy("bid"))
    return sums.withColumn("t", total).where("t > 0").select("bid", "sub", (F.col("w") / F.col("t")).alias("share"))


def prop_by_floors(buildings: DataFrame, floors: Column, shares: DataFrame) -> DataFrame:
    """Mixed use without registered areas: one floor of all is commercial, dealt by the shares; the rest is housing."""
    part = F.when(floors <= 1, 1.0).otherwise(1.0 / floors)
    b = buildings.select("bid", part.alias("part"))
    shop = b.join(shares, "bid", "left").select("bid", F.coalesce("sub", F.lit(DEFAULT_SUB[COMMERCIAL])).alias("sub"), (F.col("part") * F.coalesce("share", F.lit(1.0))).alias("share"))
    home = b.where("part < 1").select("bid", F.lit(PRIVATE_HOUSING).alias("sub"), (1 - F.col("part")).alias("share"))
    return shop.unionByName(home)


def post_sub(main: Column, sub: Column, name: Column) -> Column:
    """Sub class of a non-assessed building by words of its name."""
    low = F.lower(F.coalesce(name, F.lit("")))
    named = F.when(low.rlike("noise|sound|barrier"), NOISE).when(low.rlike("road|rail|station|transport"), TRANSPORT).when(low.rlike("temp|misc"), TEMPORARY)
    return F.when(main == NON_ASSESSED, F.coalesce(named, sub)).otherwise(sub)


def prescreen(area: Column, has_registry: Column, has_feature: Column, name: Column, noise: str | None = None) -> Column:
    """Tiny buildings nothing is known of, and, if a noise pattern is given, those with such a name."""
    tiny = (area < 5) & ~has_registry & ~has_feature & (F.length(F.trim(F.coalesce(name, F.lit("")))) == 0)
    return tiny | F.coalesce(name.rlike(noise), F.lit(False)) if noise else tiny
