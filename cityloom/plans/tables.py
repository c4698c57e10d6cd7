"""Registered queries, third part: sources and sinks read back, predicates, joins by rule, samples, geometry of rings; each beside its SQL."""

from __future__ import annotations

import math
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.functions import alignment, geometry as geo, labels as lb, polygons as pg, text as tx
from cityloom.operators import evidence as ev, records as rc, spatial as sp, verdicts as vd
from cityloom.plans import publication as pb, queries as q
from cityloom.plans.publication import _pick, _sql_pick
from cityloom.plans.queries import B, Views, query
from cityloom.sources import collections, files

# Sources and sinks: the views are written, and read back by the source.


def _collection(v: Views, rows: DataFrame, properties: list[str], geometry: Column) -> str:
    """Path of one collection of a view of a bounded number of rows (the zones)."""
    path = files.work_path(v.spark, "collection")
    feature = F.to_json(F.struct(F.struct(*properties).alias("properties"), geometry.alias("geometry")))
    rows.agg(F.concat(F.lit('{"features": ['), F.array_join(F.array_sort(F.collect_list(feature)), ", "), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    return path


def _corner(x: str, y: str) -> Column:
    return F.array(F.col(x), F.col(y))


def _outline(*names: str) -> Column:
    x1, y1, x2, y2 = names
    return F.array(_corner(x1, y1), _corner(x2, y1), _corner(x2, y2), _corner(x1, y2), _corner(x1, y1))


def _shape(kind: str, coordinates: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))


@query(" select zone_id, zone_label from fx_zones", "zones")
def scan_geojson(v):
    path = _collection(v, v.zones, ["zone_id", "zone_label"], _shape("Polygon", F.array(_outline(*B))))
    return files.scan_geojson(v.spark, path, "zone_id long, zone_label string")


@query(" select zone_id, case when zone_id%2=0 then 'POLYGON' else 'MULTIPOLYGON' end as kind, case when zone_id%2=0 then 1 else 2 end::bigint as parts, case when zone_id%2=0 then 1 else 2 end::bigint as rings, round((x2-x1)*(y2-y1), 6) as area from fx_zones", "zones")
def scan_geojson_geom(v):
    """Polygons with a hole of no size, and pairs of equal polygons, by id."""
    one, two = _shape("Polygon", F.array(_outline(*B))), F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(_outline(*B)), F.array(_outline(*B))).alias("coordinates"))
    text = lambda s: F.struct(s["type"].alias("type"), F.to_json(s["coordinates"]).alias("c"))
    both = F.when(F.col("zone_id") % 2 == 0, text(one)).otherwise(text(two))
    path = files.work_path(v.spark, "geometry")
    row = F.format_string('{"properties": {"zone_id": %d}, "geometry": {"type": "%s", "coordinates": %s}}', "zone_id", both["type"], both["c"])
    v.zones.agg(F.concat(F.lit('{"features": ['), F.array_join(F.array_sort(F.collect_list(row)), ", "), F.lit("]}")).alias("value")).coalesce(1).write.text(path)
    rows = files.scan_geojson(v.spark, path, "zone_id long", True)
    return rows.select("zone_id", "kind", F.size("parts").cast("long").alias("parts"), F.size(F.flatten("parts")).cast("long").alias("rings"), F.round(geo.ring_area(F.col("ring")), 6).alias("area"))


@query(""" select bid, '{'||coalesce(name_en, 'no "name" \\')||'}]' as name, round((x2-x1)*(y2-y1), 6) as area from fx_buildings""", "buildings")
def scan_collection(v):
    """All buildings as one collection in one file, with braces, quotes and backslashes in names and lists named alike elsewhere; read in ranges of 64 kB."""
    path = files.work_path(v.spark, "collection")
    name = F.concat(F.lit("{"), F.coalesce("name_en", F.lit('no "name" \\')), F.lit("}]"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("bid", name.alias("name")).alias("properties"), _shape("Polygon", F.array(_outline(*B))).alias("geometry")))
    first = v.buildings.agg(F.min("bid").alias("first")).withColumn("k", F.lit(1))
    lines = v.buildings.withColumn("k", F.lit(1)).join(F.broadcast(first), "k").select(F.col("bid").alias("n"), F.concat(F.when(F.col("bid") == F.col("first"), "").otherwise(","), feature).alias("value"))
    ends = v.spark.createDataFrame([(-1, '{"crs": {"features": [{"bid": 1}]}, "features" : ['), (1 << 62, '], "other": [{"properties": {"bid": -1}}]}')], "n long, value string")
    lines.unionByName(ends).repartition(1).sortWithinPartitions("n").select("value").write.text(path)
    rows = collections.read_features(v.spark, path, "properties struct<bid:long,name:string>, geometry struct<type:string,coordinates:string>", size=1 << 16)
    shape = files.feature_geometry(F.col("f.geometry"))["parts"]
    return rows.select("f.properties.*", F.round(geo.ring_area(F.get(F.get(shape, F.lit(0)), F.lit(0))), 6).alias("area"))


@query(" select bid, category, name_en, round((x2-x1)*(y2-y1), 6) as area from fx_buildings", "buildings")
def geojson_sink(v):
    """Line-delimited features, written and read back."""
    path = files.work_path(v.spark, "features")
    files.write_features(v.buildings.select("bid", "category", "name_en", *B), path, _shape("Polygon", F.array(_outline(*B))), list(B))
    rows = files.scan_features(v.spark, path, "bid long, category string, name_en string")
    return rows.select("bid", "category", "name_en", F.round(geo.ring_area(F.get(F.get("parts", F.lit(0)), F.lit(0))), 6).alias("area"))


@query(" select rid, px, py from fx_registry where op_date is not null", "registry")
def scan_points_csv(v):
    """Without a date, a point has no latitude."""
    path = files.work_path(v.spark, "points")
    files.write_csv(v.registry.select("rid", F.col("px").alias("LONGITUDE"), F.when(F.col("op_date").isNotNull(), F.col("py")).alias("LATITUDE")), path)
    return files.scan_points_csv(v.spark, path, "rid long, LONGITUDE double, LATITUDE double", "LONGITUDE", "LATITUDE")


@query(" select 'ovt_'||osmid as osmid, name, case when coalesce(amenity,shop)='retail' then null else coalesce(amenity, shop) end as amenity, case when coalesce(amenity,shop)='retail' then 'retail' end as shop, px, py from fx_pois where user_point", "pois")
def scan_places(v):
    """Every fourth point, those without a name, has no geometry."""

    @F.arrow_udf("binary")
    def wkb(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([struct.pack("<BIdd", 1, 1, a, b) for a, b in zip(x.to_pylist(), y.to_pylist())], pa.binary())

    path = files.work_path(v.spark, "places")
    point = F.when(F.col("name").isNotNull(), wkb("px", "py"))
    v.pois.select(F.col("osmid").alias("id"), F.struct(F.col("name").alias("primary")).alias("names"), F.struct(F.coalesce("amenity", "shop").alias("primary")).alias("categories"), point.alias("geometry")).write.parquet(path)
    return files.scan_places(v.spark, path).select("osmid", "name", "amenity", "shop", "px", "py")


q.ORACLES["scan_places"] = q.ORACLES["scan_places"].replace("where user_point", "where name is not null")


@query(" select zone_label, 'zone '||zone_id as description, round((x2-x1)*(y2-y1), 6) as area from fx_zones where zone_label <> 'GB'", "zones")
def scan_esri_zones(v):
    """Green belts have no ring."""
    path = files.work_path(v.spark, "zones")
    rings = F.when(F.col("zone_label") != "GB", F.array(_outline(*B)))
    feature = F.to_json(F.struct(F.struct(F.col("zone_label").alias("ZONE_LABEL"), F.concat(F.lit("zone "), F.col("zone_id")).alias("DESC_ENG")).alias("attributes"), F.struct(rings.alias("rings")).alias("geometry")))
    v.zones.groupBy((F.col("zone_id") % 3).alias("file")).agg(F.concat(F.lit('{"features": ['), F.array_join(F.collect_list(feature), ", "), F.lit("]}")).alias("value")).write.partitionBy("file").text(path)
    return files.scan_esri_zones(v.spark, f"{path}/file=*").select("zone_label", "description", F.round(geo.ring_area(F.col("ring")), 6).alias("area"))


@query(" select lower(info_desc) as keyword, max(structure_type) as main, max_by(category, structure_type||category) as sub from fx_buildings group by 1", "buildings")
def keyword_dim(v):
    """A keyword file of what the buildings tell: structure type, category, description; the later entry of a keyword stays."""
    words = v.buildings.groupBy("structure_type", "category").agg(F.array_sort(F.collect_set("info_desc")).alias("w"))
    subs = words.groupBy("structure_type").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "w"))))).alias("s"))
    entry = F.format_string('"%s": %s', "structure_type", "s")
    path = files.work_path(v.spark, "keywords")
    subs.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit(', "__STRONG_KEYWORDS__": ["Promo"]}')).alias("value")).coalesce(1).write.text(path)
    return files.keyword_dim(v.spark, path).select("keyword", "main", "sub")


@query(" select osmid::varchar as osmid, case when lower(coalesce(amenity,''))='nan' then '' else coalesce(amenity,'') end as amenity, coalesce(shop,'') as shop, '['||osmid||','||osmid%7||']' as ids from fx_pois", "pois")
def sanitize_for_sink(v):
    return files.sanitized(v.pois.select("osmid", "amenity", "shop", F.array("osmid", F.col("osmid") % 7).alias("ids")))


@query(" select bid, category, name_en, storeys_text as storeys from (select *, case when storeys='' then null else storeys end as storeys_text from fx_buildings)", "buildings")
def csv_sink(v):
    """Written with a byte order mark, and read back; empty texts come back as nulls."""
    path = files.work_path(v.spark, "csv")
    files.write_csv(v.buildings.select("bid", "category", "name_en", "storeys"), path)
    return files.read_csv(v.spark, path, "bid long, category string, name_en string, storeys string")


@query(" select seq, ai_decision from fx_pair_log where ai_decision is not null", "pair_log")
def append_log(v):
    """Two batches of the log, appended one after the other."""
    path = files.work_path(v.spark, "log")
    said = v.pair_log.where("ai_decision IS NOT NULL").select("seq", "ai_decision")
    for batch in (said.where("ai_decision = 'keep'"), said.where("ai_decision <> 'keep'")):
        vd.append_log(batch, path)
    return v.spark.read.parquet(path)


@query(" select seq, ai_decision, (seq%3)::int as batch from fx_pair_log where ai_decision is not null and seq%3 < 2", "pair_log")
def log_batches(v):
    """Three batches of the log; the second is written by half, then as a whole and once more, the third has its rows taken back."""
    path = files.work_path(v.spark, "log")
    said = v.pair_log.where("ai_decision IS NOT NULL").select("seq", "ai_decision")
    part = lambda n: said.where(F.col("seq") % 3 == n)
    for n, rows in ((0, part(0)), (1, part(1).where("ai_decision = 'keep'")), (2, part(2)), (1, part(1)), (1, part(1)), (2, part(2).where("false"))):
        vd.append_log(rows, path, n)
    return v.spark.read.parquet(path).select("seq", "ai_decision", "batch")


@query(" select count(*) as rows, count(*) filter (category in ('1','2')) as training_rows, 3::bigint as columns, count(*) filter (category='1') as positives from fx_buildings", "buildings")
def persist_training(v):
    x = v.buildings.select("bid", "top_height", "base_height", "category")
    y = v.buildings.where("category IN ('1', '2')").select("bid", (F.col("category") == "1").cast("int").alias("is_one"))
    meta = files.persist_training(x, y, "bid", files.work_path(v.spark, "training"))
    return meta.select("rows", "training_rows", F.size("columns").cast("long").alias("columns"), F.col("positives")["is_one"].alias("positives"))


@query(" select bid, category, null::varchar as truth_main, null::varchar as truth_sub from fx_buildings order by sha256(bid::varchar), bid limit 100", "buildings")
def audit_sheet(v):
    path = files.work_path(v.spark, "sheet")
    files.write_audit_sheet(q.hash_sample_rows(v, "category"), path, ["truth_main", "truth_sub"])
    return files.read_csv(v.spark, path, "bid long, category string, truth_main string, truth_sub string")


@query(" select bid, category from fx_buildings", "buildings")
def prefer_cached(v):
    """The stage table where it was written, the raw one where not: half of the buildings from each."""
    path, odd = files.work_path(v.spark, "stage"), F.col("bid") % 2 == 1
    raw = v.buildings.select("bid", "category")
    raw.where(odd).write.parquet(path)
    missing = files.work_path(v.spark, "no-stage")
    return files.prefer_cached(v.spark, path, raw.limit(0)).unionByName(files.prefer_cached(v.spark, missing, raw.where(~odd)))


# Predicates, projections, joins by rule.


@query(" select 'area' as side, osmid from fx_polys union all select 'point', osmid from fx_pois", "polys", "pois")
def split_by_kind(v):
    kind = F.when(F.col("osmid") % 3 == 0, "MultiPolygon").otherwise("Polygon")
    mixed = v.polys.select("osmid", kind.alias("kind")).unionByName(v.pois.select("osmid", F.lit("Point").alias("kind")))
    areas, points = rc.split_by_kind(mixed)
    return areas.select(F.lit("area").alias("side"), "osmid").unionByName(points.select(F.lit("point").alias("side"), "osmid"))


_LOST = ["未知类别", None, "商业类别", "nan", "住宅类别"]


@query(f", r as (select bid, {_sql_pick(_LOST)} as main from fx_buildings) select bid, case when main in ('商业类别','住宅类别') then main else '未知类别' end as main, case when main in ('商业类别','住宅类别') then 's' else '未知类别' end as sub, case when main in ('商业类别','住宅类别') then 'GFA' else 'Unknown' end as source from r", "buildings")
def unknown_reset(v):
    return rc.unknown_reset(v.buildings.select("bid", _pick(_LOST).alias("main"), F.lit("s").alias("sub"), F.lit("GFA").alias("source")))


_SOURCES = ["GFA", "BDBIAR", "BDBIAR+OSM", None, "Inherited_from_7", "x_LLM_Corrected", "LandsD_Category", "xLLM_Corrected", "keyword"]


@query(f" select bid, bid%9 in (1,4,5,6) as trusted from fx_buildings", "buildings")
def high_conf_filter(v):
    return v.buildings.select("bid", rc.high_confidence(_pick(_SOURCES)).alias("trusted"))


_FAMILY = ["Mixed-use_混合用途", "mixed use", "未知", "Unknown", "Non-assessed_非评估类别", "non assessed", "Retail", None]


@query(" select bid, bid%8 in (0,1) as mixed, bid%8 in (2,3) as unknown, bid%8 in (4,5) as non_assessed from fx_buildings", "buildings")
def class_family_flags(v):
    return v.buildings.select("bid", *[c.alias(n) for n, c in rc.class_family(_pick(_FAMILY)).items()])


@query(q._GFA + " select bid, round(case when coalesce(domestic+nondomestic,0) > 0 then domestic+nondomestic else (x2-x1)*(y2-y1)*3 end, 3)::double as gfa from fx_buildings left join g using (bid)", "buildings", "permits", "permit_links")
def gfa_proxy(v):
    j = v.buildings.join(q.gfa(v), "bid")
    proxy = geo.box_area(*(F.col(c) for c in B)) * 3
    return j.select("bid", F.round(rc.official_or_proxy(F.col("domestic") + F.col("nondomestic"), proxy), 3).alias("gfa"))


@query(" select b.bid, structure_type, r.usage_class as category, r.address as name_en from fx_buildings b join fx_registry r on r.rid = b.bid", "buildings", "registry")
def join_right_wins(v):
    left = v.buildings.select("bid", "structure_type", "category", "name_en")
    return rc.join_right_wins(left, v.registry.select(F.col("rid").alias("bid"), F.col("usage_class").alias("category"), F.col("address").alias("name_en")), "bid")


@query(" select count(*) as rows, count(g.bid) as matched, round(count(g.bid)/count(*), 6)::double as share, round(sum(case when g.bid is not null then (x2-x1)*(y2-y1) else 0 end)/sum((x2-x1)*(y2-y1)), 6)::double as weight_share from fx_buildings b left join (select distinct bid from fx_permit_links) g on g.bid=b.bid", "buildings", "permit_links")
def coverage_by_gfa(v):
    j = v.buildings.join(v.permit_links.select("bid", F.lit(True).alias("linked")).distinct(), "bid", "left")
    out = rc.coverage(j, F.coalesce("linked", F.lit(False)), geo.box_area(*(F.col(c) for c in B)))
    return out.select("rows", "matched", F.round("share", 6).alias("share"), F.round("weight_share", 6).alias("weight_share"))


@query(q._STRONG + ", c as (select bid, count(distinct osmid) n from s group by bid) select count(*) as buildings, round(avg(n), 6) as mean, min(n) as least, quantile_cont(n, 0.25)::double as q1, quantile_cont(n, 0.5)::double as median, quantile_cont(n, 0.75)::double as q3, max(n) as most, round(stddev_samp(n), 6) as deviation from c", "buildings", "polys")
def multi_match_summary(v):
    c = q.features_of(v).select("bid", F.col("features").alias("n"))
    part = lambda p: F.percentile("n", F.lit(p))
    return c.agg(F.count("*").alias("buildings"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("least"), part(0.25).alias("q1"), part(0.5).alias("median"), part(0.75).alias("q3"), F.max("n").alias("most"), F.round(F.stddev_samp("n"), 6).alias("deviation"))


@query(" select bid from fx_buildings order by sha256('42:'||bid), bid limit 150", "buildings")
def seeded_sample(v):
    return rc.seeded_sample(v.buildings.select("bid"), "bid", 150, 42)


@query(" select osmid, row_number() over (order by building, osmid) - 1 as row_id from fx_polys", "polys")
def row_ids(v):
    return rc.numbered(v.polys.select("building", "osmid"), "building", "osmid").select("osmid", "row_id")


@query(" select b.bid, l.opno, p.domestic_gfa from fx_buildings b left join (select bid, min(opno) as opno from fx_permit_links group by bid) l using (bid) left join fx_permits p using (opno)", "buildings", "permit_links", "permits")
def dimension_lookup(v):
    """Left join of a dimension that has one row a key, the first by its order."""
    first = sp.first_by(v.permit_links, "bid", F.col("opno"))
    return v.buildings.select("bid").join(first, "bid", "left").join(v.permits, "opno", "left").select("bid", "opno", "domestic_gfa")


@query(" select bid, category, null::double as heat, null::varchar as owner from fx_buildings", "buildings")
def column_subset(v):
    """The wanted columns: those that are there, the others as typed nulls; all else is dropped."""
    return files.ensure_columns(v.buildings, "bid long, category string, heat double, owner string")


# Text.


@query(" select bid, round(case when name_en is null then 0 else 200.0*length(name_en)/(2*length(name_en)+3) end, 6)::double as ratio, case when name_en is null then 0.0 else 100.0 end::double as token_ratio, round(case when name_en is null then 0 else 200.0*(length(name_en)-1)/(2*length(name_en)) end, 6)::double as changed from fx_buildings", "buildings")
def name_ratio_forms(v):
    """Names against themselves with a suffix, with a word put in front, and with the last letter changed: the ratios have closed forms."""
    n = F.col("name_en")
    ratio, tokens = alignment.name_ratio(n, F.concat(n, F.lit(" 99"))), alignment.token_set_ratio(n, F.concat(F.lit("99 "), n))
    changed = alignment.name_ratio(n, F.concat(F.substr(n, F.lit(1), F.length(n) - 1), F.lit("#")))
    return v.buildings.select("bid", F.round(ratio, 6).alias("ratio"), tokens.alias("token_ratio"), F.round(changed, 6).alias("changed"))


_TRADITIONAL, _SIMPLIFIED = "廠樓學業飯店醫診", "厂楼学业饭店医诊"
_SIGNS = ["工廠大樓", "學校 School", "飯店", "Barber 酒", None, "醫診所 clinic"]


@query(f" select bid, {_sql_pick(['工厂大楼', '学校 School', '饭店', 'Barber 酒', None, '医诊所 clinic'])} as text, {_sql_pick(['工厂', '学校,school', '饭店', '', '', '诊所,clinic'])} as hits from fx_buildings", "buildings")
def fold_script(v):
    """Traditional texts against traditional keywords, both folded; keywords of one character are skipped."""
    words = ["工廠", "學校", "School", "飯店", "酒", "診所", "clinic", "bar"]
    t = _pick(_SIGNS)
    return v.buildings.select("bid", tx.fold_script(t, _TRADITIONAL, _SIMPLIFIED).alias("text"), F.array_join(tx.keyword_hits(t, words, fold=(_TRADITIONAL, _SIMPLIFIED)), ",").alias("hits"))


_MAINS = ["住宅类别", "混合用途(商住)", "Garden", None, "工业类别"]


@query(f" select bid, {_sql_pick(['住宅类别', '混合用途', '未知类别', '未知类别', '工业类别'])} as main from fx_buildings", "buildings")
def std_main(v):
    return v.buildings.select("bid", tx.std_main(_pick(_MAINS)).alias("main"))


@query(" select bid, case when bid%2=0 then 'Shop:0.75-Non-manufacturing:0.25' else 'Office:1.00' end as vector from fx_buildings", "buildings")
def relabel_vector(v):
    text = F.when(F.col("bid") % 2 == 0, "Retail:0.75-Non-manufacturing:0.25").otherwise("Office:1.00")
    names = F.create_map(F.lit("Retail"), F.lit("Shop"), F.lit("Plant"), F.lit("Factory"))
    return v.buildings.select("bid", tx.format_vector(tx.relabel_vector(tx.parse_vector(text), names)).alias("vector"))


_LISTS = ["私人房屋（Private Housing）-零售（Retail）", "零售（Retail）-办公室（Office）-其他工业（Other Industrial）", "零售"]


@query(f" select bid, {_sql_pick(['住宅类别:0.50-商业类别:0.50', '商业类别:0.67-工业类别:0.33', '商业类别:1.00'])} as mains, {_sql_pick(['私人房屋（Private Housing）:0.50-零售（Retail）:0.50', '零售（Retail）:0.33-办公室（Office）:0.33-其他工业（Other Industrial）:0.33', '零售:1.00'])} as subs from fx_buildings", "buildings")
def unit_weights(v):
    mains, subs = vd.unit_vectors(F.split(_pick(_LISTS), lb.SEPARATOR), lb.main_of_sub())
    return v.buildings.select("bid", mains.alias("mains"), subs.alias("subs"))


_CLASS_SQL = "case when amenity='restaurant' then '食肆（Restaurant）' when amenity='school' then '教育（Education）' when shop='retail' then '零售（Retail）' else '办公室（Office）' end"


@query(f", t as (select bid, osmid, {_CLASS_SQL} as sub from fx_buildings join fx_pois on px between x1 and x2 and py between y1 and y2 where amenity in ('restaurant','school') or shop in ('retail','bank')), k as (select bid, sub, count(*) as n from t group by 1,2), j as (select bid, '{{'||string_agg('\"'||sub||'\":'||n, ',' order by sub)||'}}' as counts from k group by bid) select bid, '['||string_agg('{{\"id\":'||osmid||',\"sub\":\"'||sub||'\"}}', ',' order by osmid)||']' as trace, any_value(counts) as counts from t join j using (bid) group by bid", "buildings", "pois")
def trace_json(v):
    told = pb._inside_pois(v).where("sub IS NOT NULL").select("bid", "osmid", "sub")
    rows = told.groupBy("bid").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("osmid").alias("id"), "sub")))).alias("trace"))
    counts = told.groupBy("bid", "sub").count().groupBy("bid").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sub", "count"))))).alias("counts"))
    return rows.join(counts, "bid")


_KEYS = {"restaurant": (tx.COMMERCIAL, tx.RESTAURANT), "school": (tx.COMMERCIAL, tx.EDUCATION), "retail": (tx.COMMERCIAL, tx.RETAIL), "industrial": (tx.INDUSTRIAL, tx.OTHER_INDUSTRIAL), "urgent": (tx.COMMERCIAL, tx.OFFICE)}
_ESTATE = "osmid%5=0"


@query(
    f" select osmid, case when building in ('apartments','yes') then '住宅类别' else '工业类别' end as main, case when building='industrial' then '其他工业（Other Industrial）' when {_ESTATE} then '公共房屋（Public Housing）' else '私人房屋（Private Housing）' end as sub from fx_polys"
    " union all select -osmid, case when amenity in ('restaurant','school') or shop='retail' then '商业类别' when coalesce(amenity,'nan')='nan' and shop is null then '未知类别' end, case when amenity='restaurant' then '食肆（Restaurant）' when amenity='school' then '教育（Education）' when shop='retail' then '零售（Retail）' end from fx_pois", "polys", "pois",
)
def crowd_class(v):
    """Polygons by building tag and name (every fifth one's name is that of an estate), points by shop, amenity and name."""
    none = F.lit(None).cast("string")
    named = F.when(F.col("osmid") % 5 == 0, F.concat("name", F.lit(" 彩虹邨"))).otherwise(F.col("name"))
    polys = v.polys.select("osmid", none.alias("shop"), none.alias("amenity"), "building", named.alias("name"))
    pois = v.pois.select((-F.col("osmid")).alias("osmid"), "shop", "amenity", none.alias("building"), none.alias("name"))
    out = ev.crowd_class(polys.unionByName(pois), _KEYS, none)
    clear = F.when((F.col("osmid") < 0) & (F.col("main") == tx.UNKNOWN), None).otherwise(F.col("sub"))
    return out.select("osmid", "main", clear.alias("sub"))


# Rings.


def _l_shapes(v: Views) -> DataFrame:
    return v.buildings.withColumn("ring", pb._l_ring())


_MID = "select bid, (x1+(x1+x2)/2)/2 as rx, ((y1+y2)/2+y2)/2 as ry from fx_buildings"


@query(f" select bid, round(rx, 6) as px, round(ry, 6) as py from ({_MID})", "buildings")
def interior_points(v):
    return _l_shapes(v).select("bid", pg.interior_point(F.col("ring")).alias("p")).select("bid", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query(f" select bid, min_by(zone_label, zone_id) as zone_label from ({_MID}) left join fx_zones on rx between x1 and x2 and ry between y1 and y2 group by bid", "buildings", "zones")
def zone_of_repr_point(v):
    inner = _l_shapes(v).select("bid", pg.interior_point(F.col("ring")).alias("p")).select("bid", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    return sp.zone_of_point(inner, v.zones, "bid", "px", "py").select("bid", "zone_label")


@query(f" select b.bid, f.osmid, round({q._GAP}, 6) as gap from fx_buildings b join fx_polys f on b.x1-10<=f.x2 and f.x1<=b.x2+10 and b.y1-10<=f.y2 and f.y1<=b.y2+10 where {q._GAP} <= 10", "buildings", "polys")
def geom_distance(v):
    """Polygons within 10 m of a building, by the distance of the rings."""
    f = sp.prefixed(v.polys.select("osmid", *B), "f_")
    pairs = sp.grid_pairs(v.buildings.select("bid", *B), f, B, ("f_x1", "f_y1", "f_x2", "f_y2"), 40.0, 10.0)
    dx, dy = (F.greatest(F.col(a) - F.col(f"f_{b}"), F.col(f"f_{a}") - F.col(b), F.lit(0.0)) for a, b in (("x1", "x2"), ("y1", "y2")))
    pairs = pairs.where(dx * dx + dy * dy <= 100.001)  # a ring is no closer than its box
    return pairs.withColumn("gap", pg.ring_gap(pb._box_ring(), pb._box_ring("f_"))).where("gap <= 10").select("bid", F.col("f_osmid").alias("osmid"), F.round("gap", 6).alias("gap"))


@query(" select bid from fx_buildings where bid%6 in (0, 5)", "buildings")
def drop_bad_geom(v):
    """Rings by id: sound, null, empty, open, with a coordinate that is none, sound."""
    x1, y1, x2, y2 = (F.col(c) for c in B)
    nan = F.lit(math.nan)
    opened, bad = pg.ring_of((x1, y1), (x2, y1), (x2, y2), (x1, y2)), pg.ring_of((x1, y1), (nan, y1), (x2, y2), (x1, y2))
    opened = F.slice(opened, 1, F.size(opened) - 1)
    k = F.col("bid") % 6
    ring = F.when(k == 1, None).when(k == 2, F.slice(pb._box_ring(), 1, 0)).when(k == 3, opened).when(k == 4, bad).otherwise(pb._box_ring())
    return v.buildings.withColumn("ring", ring).where(geo.valid_ring(F.col("ring"))).select("bid")


@query(" select 'areas' as layer, bid as id, round((x1+x2)/2, 6) as px, round((y1+y2)/2, 6) as py from fx_buildings union all select 'mixed', bid, null, null from fx_buildings", "buildings")
def layer_centroids(v):
    """A layer of polygons only becomes its centres; one that holds anything else stays as it is."""
    rows = v.buildings.select("bid", F.lit("POLYGON").alias("kind"), *B)
    mixed = rows.withColumn("kind", F.when(F.col("bid") % 2 == 0, "POINT").otherwise("POLYGON"))
    out = [sp.layer_points(t).select(F.lit(n).alias("layer"), F.col("bid").alias("id"), F.round("px", 6).alias("px"), F.round("py", 6).alias("py")) for n, t in (("areas", rows), ("mixed", mixed))]
    return out[0].unionByName(out[1])
