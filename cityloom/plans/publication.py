"""Registered queries, second part: labels and notes, shares, audits and repairs, general polygons; each beside its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.functions import automata, geometry as geo, labels as lb, polygons as pg, text as tx
from cityloom.operators import audit, evidence as ev, models, proportions as pr, records as rc, spatial as sp, verdicts as vd
from cityloom.plans import queries as q
from cityloom.plans.queries import B, Views, query
from cityloom.sources import files


def _pick(values: list[str | None], key: str = "bid") -> Column:
    """One of the values by the key."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql_pick(values: list[str | None], key: str = "bid") -> str:
    return f"case {key}%{len(values)} " + " ".join(f"when {k} then {'null' if v is None else repr(v)}" for k, v in enumerate(values)) + " end"


# Labels and notes: (given, expected).

_STD = [("私人房屋 (Private  Housing)", "私人房屋（Private Housing）"), ("零售", "零售（Retail）"), ("其它工业", "其他工业（Other Industrial）"), ("医疗（Clinic）", "医疗（Human Health）"), ("杂项设施", "临时/杂项设施"), (None, "未知类别"), ("Garden", "未知类别"), (" 非制造业（Non-manufacturing） ", "非制造业（Non-manufacturing）")]
_STDS = [("私人房屋（Private Housing）:0.80-零售（Retail）:0.20", "私人房屋（Private Housing）-零售（Retail）"), ("非制造业（Non-manufacturing）:1.00", "非制造业（Non-manufacturing）"), ("nothing-known", "混合用途"), (None, "混合用途")]
_CANON = [("零售（Retail）", "Retail_零售"), ("Non-manufacturing", "Non-manufacturing_非制造业"), ("交通基础设施", "Transport Infrastructure_交通基础设施"), ("", "Unknown_未知类别"), ("Market (街市)", "Market_街市"), ("Retail_零售", "Retail_零售"), ("办公室", "Office_办公室")]
_CANONS = [("零售（Retail）:0.25-办公室（Office）:0.75", "Retail_零售:0.25-Office_办公室:0.75"), ("Non-manufacturing:1.00", "Non-manufacturing_非制造业:1.00"), (None, "Unknown_未知类别"), ("教育", "Education_教育")]
_NOTE = [
    ("保留规则确定性结论", "Rule conclusion retained_保留规则确定性结论"), ("ML覆盖[未知]-ML多标签混合", "ML override with multi-label mixture_ML覆盖[未知]-ML多标签混合"), ("ML推断填补-商业-ML回归精准分配", "ML completion with regression-based subclass allocation_ML推断填补-商业-ML回归精准分配"),
    ("其他", "Pipeline decision note_其他"), ("", ""), ("Kept_保留", "Kept_保留"), ("ML推断置信度过低(0.31)", "ML confidence too low_ML推断置信度过低(0.31)"),
]


def _labelled(v: Views, cases: list[tuple], f) -> DataFrame:
    return v.buildings.select("bid", f(_pick([given for given, _ in cases])).alias("label"))


def _label_sql(cases: list[tuple]) -> str:
    return f" select bid, {_sql_pick([expected for _, expected in cases])} as label from fx_buildings"


@query(_label_sql(_STD), "buildings")
def std_sub(v):
    return _labelled(v, _STD, lb.std_sub)


@query(_label_sql(_STDS), "buildings")
def std_subs(v):
    return _labelled(v, _STDS, lb.std_subs)


@query(_label_sql(_CANON), "buildings")
def canon_sub(v):
    return _labelled(v, _CANON, lb.canon_sub)


@query(_label_sql(_CANONS), "buildings")
def canon_subs(v):
    return _labelled(v, _CANONS, lb.canon_subs)


@query(_label_sql(_NOTE), "buildings")
def note_bilingual(v):
    return _labelled(v, _NOTE, lb.note_bilingual)


_REASONS = ["ML覆盖[未知类别]-ML多标签混合", "ML覆盖[Fallback]-ML回归精准分配", "保留规则确定性结论", None, "ML覆盖[None]"]


@query(" select case bid%5 when 0 then '未知类别' when 1 then 'Fallback' else 'None' end as reason, count(*) as n from fx_buildings where bid%5 in (0,1,4) group by 1", "buildings")
def override_reasons(v):
    return audit.override_reasons(v.buildings.select(_pick(_REASONS).alias("note")))


def _inside_pois(v: Views) -> DataFrame:
    return v.once(q.inside_pois)


@query(
    " select bid, string_agg(coalesce(name, 'Unnamed_POI')||'['||coalesce(nullif(coalesce(amenity,''),'nan'), '')||coalesce(shop,'')||'->'||case when amenity='restaurant' then '食肆（Restaurant）' when amenity='school' then '教育（Education）' when shop='retail' then '零售（Retail）' else '办公室（Office）' end||']', ' | ' order by osmid) as trace"
    " from fx_buildings join fx_pois on px between x1 and x2 and py between y1 and y2 where amenity in ('restaurant','school') or shop in ('retail','bank') group by bid", "buildings", "pois",
)
def poi_trace(v):
    label = lb.poi_label(F.col("name"), lb.poi_tag(F.col("amenity"), F.col("shop"), F.lit(None)), F.col("sub"))  # once for a point, not for a pair
    points = q.poi_classes(v).where("sub IS NOT NULL").select("osmid", "px", "py", label.alias("trace"))
    return sp.texts_within(v.buildings.select("bid", *B), points, "bid", "osmid", "trace")


_STRONG_NAMES = ("商場", "Plaza", "工廠")
_TAXONOMY = rc.taxonomy_text(lb.SUB_LABELS, _STRONG_NAMES)
_TAXONOMY_SQL = "'||chr(10)||'".join(["- Strong names: 商場, 工廠"] + [f"- {m}: {', '.join(subs)}" for m, subs in lb.SUB_LABELS.items()])


@query(q._EV + q._FUSED + q._POI + q._POI_TRACE + f" select bid, 'Label a building.'||chr(10)||'Name: '||name_en||chr(10)||'Structure: '||structure_type||chr(10)||'POIs: '||case when pi.bid is null then 'No record' else 'x[y]' end||chr(10)||'Floors: '||coalesce(storeys,'Unknown')||chr(10)||'Category code: '||category||chr(10)||'Present class: '||main||chr(10)||'{_TAXONOMY_SQL}'||chr(10)||'Answer in JSON: reasoning, main_class, sub_class, confidence from 0 to 1.' as prompt from fu join fx_buildings using (bid) left join pi using (bid) where {q._OPEN}", *q._EV_VIEWS, "pois")
def review_prompts(v):
    rows = q.review_rows(v).join(v.buildings.select("bid", "structure_type", "storeys", "category"), "bid")
    asked = vd.review_candidates(rows, v.buildings.where("false"), "name_en", "official", "pois")
    given = {"Name": F.col("name_en"), "Structure": F.col("structure_type"), "POIs": F.coalesce("pois", F.lit("No record")), "Floors": F.coalesce("storeys", F.lit("Unknown")), "Category code": F.col("category"), "Present class": F.col("main")}
    return vd.prompts(asked, given, _TAXONOMY).select("bid", "prompt")


# Evidence of categories, keywords and names.


@query(" select bid, case when category='4' then '商业类别' else '住宅类别' end as main, case category when '3' then '公共房屋（Public Housing）' when '4' then '其他商业（Other Commercial）' else '私人房屋（Private Housing）' end as sub, 0.5::double as conf, 50.0::double as weight from fx_buildings where category in ('1','2','3','4')", "buildings")
def ev_category(v):
    return ev.ev_category(v.buildings).select("bid", "main", "sub", "conf", "weight")


#: Words of the stand-in descriptions as keywords: word, main, sub.
_WORDS = {"gear": (tx.INDUSTRIAL, "金属及机械（Metal & Machinery）"), "widget": (tx.COMMERCIAL, tx.RETAIL), "bolt": (tx.NON_ASSESSED, tx.TEMPORARY), "standard": (tx.COMMERCIAL, tx.OFFICE)}


@query(q._EV + " select bid, main, sub, weight::double as weight from e5", *q._EV_VIEWS)
def ev_keyword(v):
    """Names, descriptions and matched addresses against some words and all addresses of the registry."""
    return q.evidence_part(v, "Keyword").select("bid", "main", "sub", "weight")


@query(q._EV + " select bid, main, weight::double as weight from e6", *q._EV_VIEWS)
def ev_name(v):
    """Category 9, where no other source says anything."""
    return q.all_evidence(v).where("src = 'Name_Keyword'").select("bid", "main", "weight")


@query(q._EV + ", h as (select bid, regexp_extract_all(t, '\\b(hot gear|old bolt|standard|widget|small|promo|gear|bolt)\\b') as w, a from kt) select bid, array_to_string(case when a is null then w else list_append(w, a) end, '|') as hits from h", *q._EV_VIEWS)
def keyword_scan(v):
    """All keywords of a building's texts from left to right, the longest at a place."""
    text = F.concat_ws(" ", F.coalesce("name_en", F.lit("")), F.coalesce("info_desc", F.lit("")), F.coalesce("address", F.lit("")))
    rows = v.buildings.join(v.once(q.matched).select("bid", "address"), "bid", "left").withColumn("low", F.lower(text))
    return automata.with_hits(rows, F.col("low"), automata.keywords_of(q.keyword_table(v))).select("bid", F.array_join("hits", "|").alias("hits"))


_PHRASES = (("old bolt", "OB"), ("bolt", "B"), ("old", "O"), ("hot gear", "hot gear"), ("gear", "G"), ("hot", "H"), ("small ring", "SR"), ("ring", "R"))


@query(" select bid, replace(replace(replace(replace(replace(replace(replace(replace(replace(name_en, 'old bolt', 'OB'), 'hot gear', '~'), 'small ring', 'SR'), 'bolt', 'B'), 'old', 'O'), 'gear', 'G'), 'hot', 'H'), 'ring', 'R'), '~', 'hot gear') as text from fx_buildings", "buildings")
def fold_phrases(v):
    """Conversion by a phrase file, the longest phrase at each place: what a phrase keeps its parts would change."""
    path = files.work_path(v.spark, "phrases")
    table = v.spark.createDataFrame(list(_PHRASES), "phrase string, to string")
    table.select(F.concat_ws("\t", "phrase", F.translate("to", " ", "_")).alias("value")).write.text(path)
    read = files.phrase_table(v.spark, path).withColumn("to", F.translate("to", "_", " "))
    return automata.converted(v.buildings, F.col("name_en"), automata.phrases_of(read), "text").select("bid", "text")


# Shares.


def _weighted_features(v: Views) -> DataFrame:
    """Classified polygons by overlap and area, and classified points."""
    tag = F.col("f_building")
    polys = v.once(q.crowd).select("bid", ev.looked_up(tag, ev.TAG_CLASS, 0).alias("main"), ev.looked_up(tag, ev.TAG_CLASS, 1).alias("sub"), "weight")
    pois = q.building_pois(v).where("main IS NOT NULL").select("bid", "main", "sub", (F.col("n") * 0.3).alias("weight"))
    return polys.unionByName(pois)


_SHARE_BODY = (
    q._POI + f""", ft as (select bid, case f.building when 'industrial' then '工业类别' else '住宅类别' end as main, case f.building when 'industrial' then '其他工业（Other Industrial）' else '私人房屋（Private Housing）' end as sub, least({q._OVER},1.0::double)*((f.x2-f.x1)*(f.y2-f.y1)) as w from fx_buildings b join fx_polys f on {q._MEET} where {q._OVER} >= 0.2
 union all select bid, main, sub, 0.3::double from pc where main is not null)
, nz as (select bid, domestic/(domestic+nondomestic) as dr, nondomestic/(domestic+nondomestic) as nr from g where domestic+nondomestic > 0)
, fw as (select bid, sum(w) filter (main='商业类别') as c, sum(w) as t from ft where main in ('商业类别','工业类别') group by bid)
, ms as (select bid, '住宅类别' as main, dr as share from nz union all select nz.bid, '商业类别', nr*case when t is null then 1.0 else coalesce(c,0)/t end from nz left join fw using (bid) union all select nz.bid, '工业类别', nr*(t-coalesce(c,0))/t from nz join fw using (bid))
, mm as (select * from ms where share > 1e-12), ss as (select bid, main, sub, sum(w) as w from ft group by 1,2,3), sp as (select bid, main, sub, w/sum(w) over (partition by bid, main) as part from ss)
"""
)
_SHARES = q._GFA + _SHARE_BODY
_SHARE_VIEWS = ("buildings", "permits", "permit_links", "polys", "pois")


@query(_SHARES + " select mm.bid, mm.main, round(share, 6) as share from mm join fx_buildings using (bid)", *_SHARE_VIEWS)
def main_shares(v):
    return pr.main_shares(v.once(q.gfa), _weighted_features(v)).where("share > 1e-12").select("bid", "main", F.round("share", 6).alias("share"))


@query(_SHARES + " select mm.bid, mm.main, coalesce(sp.sub, case mm.main when '住宅类别' then '私人房屋（Private Housing）' when '商业类别' then '其他商业（Other Commercial）' else '其他工业（Other Industrial）' end) as sub, round(share*coalesce(part,1.0), 6) as share from mm join fx_buildings using (bid) left join sp on sp.bid=mm.bid and sp.main=mm.main", *_SHARE_VIEWS)
def prop_by_gfa(v):
    return pr.prop_by_gfa(v.once(q.gfa), _weighted_features(v)).where("share > 1e-12").select("bid", "main", "sub", F.round("share", 6).alias("share"))


_SINGLE = [tx.COMMERCIAL, tx.RESIDENTIAL, tx.MIXED, tx.COMMERCIAL, tx.INDUSTRIAL]


@query(q._POI + f", c as (select bid, sub, round(count(*)/sum(count(*)) over (partition by bid), 4)::double as part from pc where sub is not null group by bid, sub), b as (select bid, {_sql_pick(_SINGLE)} as main from fx_buildings) select b.bid, main, case when main='商业类别' and c.sub is not null then c.sub when bid%3=0 then 'own' else case main when '商业类别' then '其他商业（Other Commercial）' when '住宅类别' then '私人房屋（Private Housing）' else '其他工业（Other Industrial）' end end as sub, case when main='商业类别' then coalesce(part, 1.0) else 1.0 end::double as share from b left join c on c.bid=b.bid and main='商业类别' where main <> '混合用途'".replace("bid%3=0", "b.bid%3=0"), "buildings", "pois")
def prop_final(v):
    rows = v.buildings.select("bid", _pick(_SINGLE).alias("main"), F.when(F.col("bid") % 3 == 0, "own").when(F.col("bid") % 3 == 1, "nan").alias("sub"))
    return pr.prop_final(rows, q.building_pois(v).select("bid", "sub", "n"))


_FULL = q._EV + q._FUSED + q._PODIUM + _SHARE_BODY + f"""
, c1 as (select bid, sub, round(count(*)/sum(count(*)) over (partition by bid), 4)::double as part from pc where sub is not null group by bid, sub)
, x1 as (select po.bid, po.main, case when po.main='商业类别' and c1.sub is not null then c1.sub when po.sub='未知类别' then {q._DEFAULT.format('po.main')} else po.sub end as sub, case when po.main='商业类别' then coalesce(part, 1.0) else 1.0 end::double as share from po left join c1 on c1.bid=po.bid and po.main='商业类别' where po.main in ('住宅类别','商业类别','工业类别','非评估类别'))
, x2 as (select mm.bid, mm.main, coalesce(sp.sub, {q._DEFAULT.format('mm.main')}) as sub, mm.share*coalesce(part, 1.0) as share from mm join po on po.bid=mm.bid and po.main='混合用途' left join sp on sp.bid=mm.bid and sp.main=mm.main where po.source <> 'GFA_Mixed' or mm.share*coalesce(part, 1.0) > 0.01)
, pf as (select bid, case when fl <= 1 then 1.0 else 1.0/fl end::double as part from (select bid, coalesce(nullif(try_cast(storeys as double), 0), 5) as fl from fx_buildings) join po using (bid) where po.main='混合用途' and bid not in (select bid from nz))
, s1 as (select bid, sub, count(*)/sum(count(*)) over (partition by bid) as share from pc where sub is not null group by bid, sub)
, x3 as (select bid, '商业类别' as main, coalesce(sub, '其他商业（Other Commercial）') as sub, part*coalesce(share, 1) as share from pf left join s1 using (bid) union all select bid, '住宅类别', '私人房屋（Private Housing）', 1-part from pf where part < 1)
, xs as (select * from (select * from x1 union all select * from x2 union all select * from x3) where share > 1e-12)
, xn as (select bid, string_agg(sub, '-' order by round(share,9) desc, sub) as subs, first(sub order by round(share,9) desc, sub) as top from xs group by bid)
, fin as (select po.bid, main, case when main='混合用途' then coalesce(subs, main) else coalesce(top, po.sub) end as sub, conf, conflicted, mixed, source from po left join xn using (bid))
"""
_FULL_VIEWS = (*q._EV_VIEWS, "pois")


def decided(v: Views) -> DataFrame:
    """Decided buildings: evidence, podium override, shares, and the sub class that these give."""
    v.together(q.gfa, q.matched, q.crowd, q.poi_counts)
    board = ev.podium_override(q.fused(v), v.buildings, q.building_pois(v)).drop("overridden")
    n = F.coalesce(F.nullif(tx.safe_number(F.col("storeys")), F.lit(0.0)), F.lit(5.0))
    return pr.with_shares(board, v.once(q.gfa), _weighted_features(v), v.buildings, n, q.building_pois(v))


@query(_FULL + " select bid, main, sub, conf, conflicted, mixed, source from fin", *_FULL_VIEWS)
def fusion(v):
    return decided(v).drop("shares")


@query(_FULL + " select bid, main, sub, round(share, 6) as share from xs", *_FULL_VIEWS)
def fusion_shares(v):
    return decided(v).select("bid", F.inline("shares")).select("bid", "main", "sub", F.round("share", 6).alias("share"))


_FLOORS = "case when try_cast(storeys as double) > 0 then try_cast(storeys as double) when top_height > 0 then greatest(round_even((case when base_height > 0 then top_height-base_height else top_height end)/3, 0), 1.0) else 5.0 end::double"
_DEALT = _FULL + f", tg as (select bid, (x2-x1)*(y2-y1)*{_FLOORS} as gfa from fx_buildings), dl as (select bid, coalesce(xs.main, '未知类别') as main, coalesce(xs.sub, '未知类别') as sub, gfa*coalesce(share, 1.0) as w from tg left join xs using (bid))"


def dealt_areas(v: Views) -> DataFrame:
    """``bid, main, sub, weight``: footprint times floors of every building, dealt by its shares."""
    total = v.buildings.select("bid", (geo.box_area(*(F.col(c) for c in B)) * q.floors()).alias("gfa"))
    rows = total.join(decided(v).select("bid", "shares"), "bid").select("bid", "gfa", F.inline_outer("shares"))
    return rows.select("bid", F.coalesce("main", F.lit(tx.UNKNOWN)).alias("main"), F.coalesce("sub", F.lit(tx.UNKNOWN)).alias("sub"), (F.col("gfa") * F.coalesce("share", F.lit(1.0))).alias("weight"))


@query(_DEALT + " select main, sub, round(sum(w), 2) as gfa from dl group by main, sub", *_FULL_VIEWS)
def gfa_by_class(v):
    return dealt_areas(v).groupBy("main", "sub").agg(F.round(F.sum("weight"), 2).alias("gfa"))


_ZONED = _DEALT + f", zb as (select b.bid, zone_label from ({q._CENTRE}) b left join (select zone_label, x1 as zx1, y1 as zy1, x2 as zx2, y2 as zy2 from fx_zones) on cx > zx1 and cx < zx2 and cy > zy1 and cy < zy2)"


@query(_ZONED + " select round(sum(w) filter (main='商业类别' and (zone_label in ('C','C/R','CDA') or zone_label like 'C(%')) / sum(w) filter (main='商业类别'), 6) as commercial, round(sum(w) filter (main='住宅类别' and (regexp_matches(zone_label, '^R\\([A-E]\\)') or zone_label in ('V','C/R','CDA'))) / sum(w) filter (main='住宅类别'), 6) as residential from zb join dl using (bid)", *_FULL_VIEWS, "zones")
def zoning_alignment(v):
    zoned = sp.zone_of_point(sp.centroid(v.buildings).select("bid", "px", "py"), v.zones, "bid", "px", "py").select("bid", F.coalesce("zone_label", F.lit("")).alias("z"))
    j = zoned.join(dealt_areas(v), "bid")
    share = lambda main, ok: F.round(F.sum(F.when((F.col("main") == main) & ok, F.col("weight"))) / F.sum(F.when(F.col("main") == main, F.col("weight"))), 6)
    return j.agg(share(tx.COMMERCIAL, F.col("z").rlike(r"^(?:C|C/R|CDA)$|^C\(")).alias("commercial"), share(tx.RESIDENTIAL, F.col("z").rlike(r"^R\([A-E]\)|^(?:V|C/R|CDA)$")).alias("residential"))


# Names of the published columns.
_PUBLIC = {"bid": "Building_ID_建筑ID", "name_en": "Building_Name_EN_建筑英文名", "structure_type": "Structure_Type_建筑类型", "floors": "Estimated_Floors_估算层数", "main": "UBEM_Main_Class_主类别", "sub": "UBEM_Sub_Class_子类别", "conf": "Confidence_置信度", "source": "Source_来源"}
_CANON_SQL = "case sub " + " ".join(f"when '{k}' then '{x}'" for k, x in sorted(lb.canonical_table().items())) + " else sub end"


@query(_FULL + f" select bid as \"{_PUBLIC['bid']}\", name_en as \"{_PUBLIC['name_en']}\", structure_type as \"{_PUBLIC['structure_type']}\", {_FLOORS} as \"{_PUBLIC['floors']}\", case main when '住宅类别' then 'Residential_住宅类别' when '商业类别' then 'Commercial_商业类别' when '工业类别' then 'Industrial_工业类别' when '混合用途' then 'Mixed-use_混合用途' when '非评估类别' then 'Non-assessed_非评估类别' else 'Unknown_未知类别' end as \"{_PUBLIC['main']}\", array_to_string(list_transform(string_split(replace(sub, 'Non-m', 'Non~m'), '-'), lambda s: case replace(s, 'Non~m', 'Non-m') {_CANON_SQL.removeprefix('case sub').removesuffix('else sub end')} else replace(s, 'Non~m', 'Non-m') end), '-') as \"{_PUBLIC['sub']}\", conf as \"{_PUBLIC['conf']}\", source as \"{_PUBLIC['source']}\", 'POLYGON (('||printf('%.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f, %.2f %.2f', x1, y1, x2, y1, x2, y2, x1, y2, x1, y1)||'))' as geometry from fin join fx_buildings using (bid)", *_FULL_VIEWS)
def public_dataset(v):
    """The published table: renamed, in order, labels in both languages, with geometry."""
    rows = decided(v).join(v.buildings.select("bid", "name_en", "structure_type", q.floors().alias("floors"), *B), "bid")
    rows = rows.withColumns({"main": tx.canon_main(F.col("main")), "sub": F.when(F.col("sub") == tx.UNKNOWN, "Unknown_未知类别").otherwise(lb.canon_subs(F.col("sub")))})
    corner = [F.format_string("%.2f %.2f", *(F.col(c) for c in p)) for p in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1"))]
    shape = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corner), F.lit("))"))
    return rows.withColumn("geometry", shape).select(*_PUBLIC, "geometry").withColumnsRenamed(_PUBLIC)


# Audits, repairs, POI fusion.


@query(q._V + ", f as (select bid, case when how='taken' then tm else main end as fm from h) select h.bid, main as s3_main, vm as s4_main, fm as s5_main from h join f using (bid) where vc >= 0.8 order by sha256(h.bid::varchar), h.bid::varchar limit 100", "buildings")
def audit_semantic(v):
    rows = q.verdict_rows(v)
    sheet = audit.audit_semantic(rows, rows, vd.verdict_merge(rows, lb.main_of_sub()))
    return sheet.select("bid", "s3_main", "s4_main", "s5_main")


@query(q._RESOLVED + ", o as (select fragment_id*50+host_id as fragment_id, host_id, d.ai_decision, suggestion as action from a join d using (fragment_id, host_id)) select * from o where regexp_matches(lower(action), 'merge|delete') and action <> 'Final_keep_with_inheritance' order by sha256(fragment_id||'||'||host_id), fragment_id||'||'||host_id limit 100")
def audit_pairs(v):
    """Each pair as a fragment of its own, as those of the stand-ins have too many hosts to be decided."""
    own = F.col("fragment_id") * 50 + F.col("host_id")
    pairs = vd.resolve_hosts(q.pair_arbitrate(v).withColumn("fragment_id", own))
    main = F.when(F.col("bid") % 3 == 0, tx.RESIDENTIAL).otherwise(tx.COMMERCIAL)
    applied = vd.apply_pairs(v.buildings.select("bid", main.alias("main")), pairs)
    return audit.audit_pairs(pairs, q.last_pairs(v).withColumn("fragment_id", own), applied).select("fragment_id", "host_id", "ai_decision", "action")


_VECTOR = ["Retail_零售:0.75-Office_办公室:0.25", "Office_办公室:1.00", None, "Non-manufacturing_非制造业:1.00"]
_MAIN = ["Commercial_商业类别", "Mixed-use_混合用途", "Non-assessed_非评估类别"]
_SUB = ["Retail_零售", "Office_办公室", None]
_WRONG = f""", r as (select bid, {_sql_pick(_MAIN)} as main, {_sql_pick(_SUB).replace('bid%3', 'bid%6%3')} as sub, {_sql_pick(_VECTOR)} as vector, case when name_en like '%red%' then 'a' when name_en like '%blue%' then 'b' end as word from fx_buildings)
, x as (select *, case when main like 'Non-%' then case word when 'a' then 'Transport Infrastructure_交通基础设施' when 'b' then 'Noise-related Infrastructure_噪声相关基础设施' else 'Temporary/Miscellaneous Structures_临时/杂项设施' end when main like 'Mixed%' then null else case bid%4 when 0 then 'Retail_零售' when 1 then 'Office_办公室' when 3 then 'Non-manufacturing_非制造业' end end as expected from r)
"""


def published(v: Views) -> DataFrame:
    told = F.when(F.contains("name_en", F.lit("red")), "Flyover").when(F.contains("name_en", F.lit("blue")), "sound wall")
    return v.buildings.select("bid", _pick(_MAIN).alias("main"), _pick(_SUB).alias("sub"), _pick(_VECTOR).alias("vector"), told.alias("told"))


@query(_WRONG + " select bid, main, sub, expected, vector from x where expected is not null and (main like 'Non-%' or coalesce(sub,'') <> expected)", "buildings")
def qa_sub(v):
    return audit.qa_sub(published(v), F.col("told"))


@query(_WRONG + " select bid, main, coalesce(expected, sub) as sub, case when main like 'Non-%' then expected||':1.00' else vector end as vector, expected is not null and (main like 'Non-%' or coalesce(sub,'') <> expected) as repaired from x", "buildings")
def repair_sub(v):
    return audit.repair_sub(published(v), F.col("told")).drop("told")


@query()
def fuse_pois(v):
    """All points, and as places the shops among them, moved and in capitals."""
    osm = v.pois.select("osmid", "name", "amenity", "shop", "px", "py")
    places = v.pois.where("shop IS NOT NULL").select((-F.col("osmid")).alias("osmid"), F.upper("name").alias("name"), "amenity", "shop", (F.col("px") + 3).alias("px"), "py")
    return audit.fuse_pois(osm, places)


# Examples and traces.

_WITHIN = "b.x1-2<=f.x2 and f.x1<=b.x2+2 and b.y1-2<=f.y2 and f.y1<=b.y2+2 and (f.x2-f.x1)*(f.y2-f.y1) < 500 and " + " and ".join(f"sqrt(pow(greatest(b.x1-f.{x},f.{x}-b.x2,0.0::double),2)+pow(greatest(b.y1-f.{y},f.{y}-b.y2,0.0::double),2)) <= 2" for x in ("x1", "x2") for y in ("y1", "y2"))


@query(f" select bid, count(*) as features from fx_buildings b join fx_polys f on {_WITHIN} group by bid having count(*) >= 2 order by features desc, bid limit 1", "buildings", "polys")
def rich_building_poly(v):
    """With two polygons, as the stand-ins are sparse; the operator takes the number as a parameter."""
    f = v.polys.where((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) < 500)
    return audit.rich_building(audit.contained(v.buildings, sp.prefixed(f.select("osmid", *B), "f_"), ("f_x1", "f_y1", "f_x2", "f_y2")), 2)


@query(f" select bid, count(*) as features from fx_buildings join fx_pois on px between x1-2 and x2+2 and py between y1-2 and y2+2 where {q._DIST} <= 2 group by bid having count(*) >= 2 order by features desc, bid limit 1", "buildings", "pois")
def rich_building_poi(v):
    return audit.rich_building(audit.contained(v.buildings, v.pois.select("osmid", "px", "py"), sp.POINT), 2)


_TOWERS = f", p as (select b.bid, f.bid as tower, (f.x1+f.x2)/2 > b.x1 and (f.x1+f.x2)/2 < b.x2 and (f.y1+f.y2)/2 > b.y1 and (f.y1+f.y2)/2 < b.y2 as ins, b.bid%3 = f.bid%3 as named, {q._GAP} as gap from fx_buildings b join fx_buildings f on b.x1-8<=f.x2 and f.x1<=b.x2+8 and b.y1-8<=f.y2 and f.y1<=b.y2+8 where b.structure_type='P' and f.structure_type='T'), a as (select *, max(ins::int) over (partition by bid) as ai from p where ins or gap <= 8), c as (select *, max(named::int) over (partition by bid) as an from a where ins::int = ai)"


@query(_TOWERS + " select bid as podium_id, tower as tower_id, case when ins then 'inside' else 'near' end as level from c where named::int = an", "buildings")
def towers_on_podium(v):
    b = v.buildings.withColumn("text", F.concat(F.lit("Block "), (F.col("bid") % 3).cast("string")))
    return audit.towers_on_podium(b.where("structure_type = 'P'"), b.where("structure_type = 'T'"))


_FIRST = f", m as (select min(bid) as bid from {q._NEAR} where rn=1)"


@query(_FIRST + f", o as (select b.*, n.rid from fx_buildings b join m using (bid) join {q._NEAR} n on n.bid=b.bid and rn=1), e as (select rid as expected_rid, px, py from fx_registry where address like '%0007%' order by rid limit 1) select bid, o.rid, r.address, expected_rid, round({q._DIST.replace('px', 'e.px').replace('py', 'e.py')}, 6) as expected_distance, {q._DIST.replace('px', 'e.px').replace('py', 'e.py')} <= 30 as within from o join fx_registry r on r.rid=o.rid, e", "buildings", "registry")
def trace_match(v):
    matched = sp.nearest_within(v.buildings, v.registry.select("rid", "px", "py"), 30.0).select("bid", *B, "rid").where("rid IS NOT NULL")
    first = matched.agg(F.min("bid").alias("bid"))
    return audit.trace_match(matched.join(first, "bid", "left_semi"), v.registry, F.lit(True), "0007").withColumn("expected_distance", F.round("expected_distance", 6))


# General polygons: L-shaped buildings (a quarter cut out of the box), boxes as features.


def _box_ring(prefix: str = "") -> Column:
    x1, y1, x2, y2 = (F.col(prefix + c) for c in B)
    return pg.ring_of((x1, y1), (x2, y1), (x2, y2), (x1, y2))


def _l_ring() -> Column:
    x1, y1, x2, y2 = (F.col(c) for c in B)
    mx, my = (x1 + x2) / 2, (y1 + y2) / 2
    return pg.ring_of((x1, y1), (x2, y1), (x2, my), (mx, my), (mx, y2), (x1, y2))


_CUT = "greatest(least(b.x2,f.x2)-greatest((b.x1+b.x2)/2,f.x1),0.0::double)*greatest(least(b.y2,f.y2)-greatest((b.y1+b.y2)/2,f.y1),0.0::double)/((f.x2-f.x1)*(f.y2-f.y1))"


@query(f" select bid, f.osmid, round({q._OVER} - {_CUT} + 1e-9, 6) as ratio from fx_buildings b join fx_polys f on {q._MEET}", "buildings", "polys")
def overlap_ratio(v):
    polys = v.polys.select("osmid", *B).withColumn("area", geo.ring_area(_box_ring()))
    shared = pg.ring_overlap(_l_ring(), _box_ring("f_"))
    pairs = sp.intersects(v.buildings.select("bid", *B), polys)
    return pairs.select("bid", F.col("f_osmid").alias("osmid"), F.round(shared / F.col("f_area") + 1e-9, 6).alias("ratio"))


_IN = "(case when {c} between h.{a}1-0.0001 and h.{a}2+0.0001 then greatest(least(b.{b}2,h.{b}2+0.0001)-greatest(b.{b}1,h.{b}1-0.0001),0.0::double) else 0 end)"
_TOUCHED = "+".join(_IN.format(c=f"b.{a}{k}", a=a, b=b) for a, b in (("x", "y"), ("y", "x")) for k in (1, 2))


@query(f" select b.bid as fragment_id, h.bid as host_id, ({_TOUCHED})/(2*((b.x2-b.x1)+(b.y2-b.y1))) >= 0.3 as shares_boundary from fx_buildings b join fx_buildings h on b.bid<>h.bid and b.x1-3<=h.x2 and h.x1<=b.x2+3 and b.y1-3<=h.y2 and h.y1<=b.y2+3 where b.structure_type='U' and h.structure_type<>'U' and {q._GAP.replace('f.', 'h.')} <= 3", "buildings")
def boundary_rule(v):
    share = pg.shared_boundary(_box_ring(), _box_ring("h_")) / F.col("perimeter")
    return q.fragments(v, perimeter=geo.ring_perimeter(_box_ring())).select(F.col("bid").alias("fragment_id"), F.col("h_bid").alias("host_id"), (share >= 0.3).alias("shares_boundary"))


_W, _H = "(x2-x1+0.5)", "(y2-y1)"


@query(f" select bid, ((bid%180) + case when {_W} > {_H} then 0 else 90 end) % 180 as angle from fx_buildings", "buildings")
def edge_angle(v):
    wide = v.buildings.withColumn("x2", F.col("x2") + 0.5)
    turned = wide.select("bid", pg.rotated(_box_ring(), F.col("bid") % 180, F.col("x1"), F.col("y1")).alias("ring"))
    return turned.select("bid", (F.round(pg.edge_angle(F.col("ring"))).cast("long") % 180).alias("angle"))


@query(" select bid, case when bid%4 <> 2 then 5 end as points, case when bid%4 <> 2 then round((x2-x1)*(y2-y1), 6) end as area from fx_buildings", "buildings")
def repaired_rings(v):
    """Sound, clockwise with repeated points, crossing itself, and with a missing point, by id."""
    x1, y1, x2, y2 = (F.col(c) for c in B)
    backwards = pg.ring_of((x1, y1), (x1, y1), (x1, y2), (x2, y2), (x2, y2), (x2, y1))
    bow, gap = pg.ring_of((x1, y1), (x2, y2), (x2, y1), (x1, y2)), pg.ring_of((x1, y1), (x2, y1), (F.lit(None), y1), (x2, y2), (x1, y2))
    kind = F.col("bid") % 4
    rows = v.buildings.select("bid", pg.repaired_ring(F.when(kind == 0, _box_ring()).when(kind == 1, backwards).when(kind == 2, bow).otherwise(gap)).alias("ring"))
    return rows.select("bid", F.when(F.col("ring").isNotNull(), F.size("ring")).alias("points"), F.when(F.col("ring").isNotNull(), F.round(geo.ring_area(F.col("ring")), 6)).alias("area"))


def _grid_sql() -> str:
    """The published formulas once more, step by step: degrees, geocentric coordinates, the other datum, its degrees, the grid."""
    arc = "6378388*((1-{e}/4-3*{e}*{e}/64)*{p} - 3.0/8*({e}+{e}*{e}/4)*sin(2*{p}) + 15.0/256*{e}*{e}*sin(4*{p}))"
    e, lat0 = "e2", "radians(22+18/60.0+43.68/3600)"
    return f"""
, k as (select 1/298.257223563::double as wf, 1/297.0::double as hf, radians(0.067753/3600) as rx, radians(-2.243649/3600) as ry, radians(-1.158827/3600) as rz, 1-1.094246e-6::double as m)
, a as (select rid, radians(113.85+(rid%550)/1000.0::double) as l, radians(22.17+(rid%370)/1000.0::double) as p, k.*, 2*wf-wf*wf as we from fx_registry, k)
, b as (select *, 6378137/sqrt(1-we*sin(p)*sin(p)) as nu from a)
, c as (select *, (nu*cos(p)*cos(l)+162.619)/m as x0, (nu*cos(p)*sin(l)+276.959)/m as y0, (nu*(1-we)*sin(p)+161.764)/m as z0 from b)
, d as (select *, x0+rz*y0-ry*z0 as x, y0-rz*x0+rx*z0 as y, z0+ry*x0-rx*y0 as z, 2*hf-hf*hf as e2, 6378388*(1-hf) as sb from c)
, f as (select *, sqrt(x*x+y*y) as flat, atan2(z*6378388, sqrt(x*x+y*y)*sb) as t from d)
, h as (select *, atan2(y, x) - radians(114+10/60.0+42.80/3600) as dl, atan2(z+e2/(1-e2)*sb*pow(sin(t),3), flat-e2*6378388*pow(cos(t),3)) as q from f)
, i as (select *, 6378388/sqrt(1-e2*sin(q)*sin(q)) as n, (1-e2*sin(q)*sin(q))/(1-e2) as psi from h)
 select rid, round(836694.05 + n*dl*cos(q) + n*dl*dl*dl/6*pow(cos(q),3)*(psi-tan(q)*tan(q)), 3)::double as easting, round(819069.80 + {arc.format(e=e, p='q')} - {arc.format(e=e, p=lat0)} + n*sin(q)*dl*dl/2*cos(q), 3)::double as northing from i"""


@query(_grid_sql(), "registry")
def reproject(v):
    """Registry points, dealt over the territory in degrees, on the grid."""
    lon, lat = 113.85 + (F.col("rid") % 550) / 1000, 22.17 + (F.col("rid") % 370) / 1000
    east, north = geo.wgs84_to_grid(lon, lat)
    return v.registry.select("rid", F.round(east, 3).alias("easting"), F.round(north, 3).alias("northing"))


@query(" select rid, round(113.85+(rid%550)/1000.0::double, 8) as lon, round(22.17+(rid%370)/1000.0::double, 8) as lat from fx_registry", "registry")
def grid_degrees(v):
    """Registry points, dealt over the territory in degrees, put on the grid and brought back."""
    east, north = geo.wgs84_to_grid(113.85 + (F.col("rid") % 550) / 1000, 22.17 + (F.col("rid") % 370) / 1000)
    placed = v.registry.select("rid", east.alias("east"), north.alias("north"))
    back = placed.select("rid", geo.grid_to_wgs84(F.col("east"), F.col("north")).alias("at"))
    return back.select("rid", F.round("at.lon", 8).alias("lon"), F.round("at.lat", 8).alias("lat"))


# Models.


@query()
def sub_shares_model(v):
    """For every building, shares of the sub classes of each main class that has at least 50 decided buildings."""
    labelled = decided(v).where(F.col("main").isin(tx.RESIDENTIAL, tx.COMMERCIAL, tx.INDUSTRIAL)).select("bid", "main", "sub")
    rows = models.split(q.feature_table(v).join(labelled, "bid", "left"), "bid")
    subs = {m: lb.SUB_LABELS[m] for m in (tx.RESIDENTIAL, tx.COMMERCIAL, tx.INDUSTRIAL)}
    return models.sub_share_models(rows, subs).select("bid", "main", F.explode("shares").alias("label", "share"))


@query()
def oversampled(v):
    """Positive rows after minority oversampling."""
    rows = q.feature_table(v).withColumn("rare", (F.col("bid") % 50 == 0).cast("int"))
    return models.oversample(rows, "rare", "bid", models.FEATURES, cell=600.0).where("rare = 1").select(*models.FEATURES)
