"""All stages in a row: evidence, podiums and shares, external verdicts, pairs of fragments and hosts, models, final calibration, publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.functions import geometry as geo, labels as lb, text as tx
from cityloom.operators import verdicts as vd
from cityloom.plans import publication as pb, queries as q
from cityloom.plans.queries import B, Views, query
from cityloom.plans.views import with_views


def _vector(key: str) -> Column:
    """The shares by main or sub class as text."""
    sums = F.aggregate(
        F.coalesce("shares", F.array().cast("array<struct<main:string,sub:string,share:double>>")), F.create_map().cast("map<string,double>"),
        lambda m, s: F.map_concat(F.map_filter(m, lambda k, _: k != s[key]), F.create_map(s[key], F.coalesce(m[s[key]], F.lit(0.0)) + s["share"])),
    )
    return tx.format_vector(F.transform_values(sums, lambda _, x: F.round(x, 6)))


def ruled(v: Views) -> DataFrame:
    """What the rules decide, with vectors and the tags of the points within."""
    tags = q.building_pois(v).where("sub IS NOT NULL").groupBy("bid").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("x["), F.coalesce(F.nullif(tx.clean_tag(F.col("amenity")), F.lit("")), F.col("shop")), F.lit("]")))), " ").alias("pois"))
    rows = pb.decided(v).withColumns({"main_vector": _vector("main"), "sub_vector": _vector("sub")}).drop("shares")
    return rows.join(v.buildings.select("bid", "name_en", F.col("info_desc").alias("official")), "bid").join(tags, "bid", "left")


def judged(v: Views) -> DataFrame:
    """The same after the verdicts on those that were asked about."""
    rows = v.once(ruled)
    asked = vd.review_candidates(rows, v.buildings.where("false"), "name_en", "official", "pois").select("bid")
    said = q.verdict_rows(v).select("bid", "v_main", "v_sub", "v_conf").join(asked, "bid", "left_semi")
    merged = vd.verdict_merge(rows.join(said, "bid", "left"), lb.main_of_sub())
    return merged.select("bid", F.col("final_main").alias("main"), F.col("final_sub").alias("sub"), F.col("final_sub_vector").alias("vector"), F.col("final_source").alias("source"))


def end(v: Views, probabilities: DataFrame) -> DataFrame:
    """Calibrated and published rows; probabilities are bid, p_res, p_com, p_ind."""
    rows = vd.apply_pair_rows(v.once(judged), q.resolve_hosts(v))
    modelled = vd.ml_summary(rows.join(probabilities.select("bid", "p_res", "p_com", "p_ind"), "bid", "left"), {tx.RESIDENTIAL: "p_res", tx.COMMERCIAL: "p_com", tx.INDUSTRIAL: "p_ind"})
    area = v.buildings.select("bid", "name_en", "structure_type", q.floors().alias("floors"), geo.box_area(*(F.col(c) for c in B)).alias("area"))
    final = vd.final_calibration(modelled.join(area, "bid").withColumn("props", F.lit(None).cast("map<string,map<string,double>>")))
    return final.select(
        "bid", "name_en", "structure_type", "floors", tx.canon_main(F.col("final_main")).alias("main"), lb.canon_subs(F.col("final_sub")).alias("sub"), lb.canon_subs(F.col("final_vector")).alias("vector"), F.col("final_source").alias("source"), lb.note_bilingual(F.col("note")).alias("note"),
    )


def _list_sql(c: str) -> str:
    canon = pb._CANON_SQL.removeprefix("case sub").removesuffix("else sub end")
    one = "split_part(replace(s, 'Non~m', 'Non-m'), ':', 1)"
    return f"array_to_string(list_transform(string_split(replace({c}, 'Non-m', 'Non~m'), '-'), lambda s: case {one} {canon} when '未知类别' then '未知类别' else {one} end || case when contains(s, ':') then ':'||split_part(s, ':', 2) else '' end), '-')"


_NOTE_SQL = "case " + " ".join(f"when {' and '.join(f'contains(note, {w!r})' for w in words)} then '{english}_'||note" for words, english in lb.NOTES) + " else 'Pipeline decision note_'||note end"
_PAIRS = q._RESOLVED[len(with_views("fx_pair_log")) :]
_CHAIN = pb._FULL + f"""
, vm1 as (select bid, string_agg(main||':'||printf('%.2f', round_even(s, 2)), '-' order by s desc, main) as v from (select bid, main, round(sum(share), 6) as s from xs group by 1,2) group by bid)
, vs1 as (select bid, string_agg(sub||':'||printf('%.2f', round_even(s, 2)), '-' order by s desc, sub) as v from (select bid, sub, round(sum(share), 6) as s from xs group by 1,2) group by bid)
, pi as (select distinct bid from pc where sub is not null)
, ca as (select fin.*, coalesce(vs1.v, '') as svec, pi.bid is not null as shop, {q._OPEN} as asked from fin join fx_buildings using (bid) left join vs1 on vs1.bid=fin.bid left join pi on pi.bid=fin.bid)
, ve as (select *, case when asked then case when bid%11=0 then '混合用途' else case bid%5 when 0 then '住宅类别' when 1 then '商业类别' when 2 then 'invented' when 3 then '食肆（Restaurant）' end end end as vm, case bid%3 when 0 then '私人房屋（Private Housing）-零售（Retail）-办公室（Office）' when 1 then '零售（Retail）' else 'vs' end as vsub, (bid%100)/100.0 as vc from ca)
, vh as (select *, case when vm is null or vc < 0.8 then 'kept' when vm='invented' then 'invented' when main='混合用途' and shop and vm<>'混合用途' then 'guarded' else 'taken' end as how, case when vm='食肆（Restaurant）' then '商业类别' else vm end as tm, case when vm='食肆（Restaurant）' then vm else vsub end as ts from ve)
, j0 as (select bid, case when how='taken' then tm else main end as main, case when how='taken' then ts else sub end as sub, case how when 'taken' then 'LLM_Verified (Conf: '||printf('%.2f', vc::double)||')' when 'invented' then source||' (LLM Rejected - Hallucination)' when 'guarded' then source||' (LLM Override Rejected - Bottom Shop Protected)' else source end as source, case when how<>'taken' then svec when tm='混合用途' and bid%3=0 then '私人房屋（Private Housing）:0.33-零售（Retail）:0.33-办公室（Office）:0.33' else ts||':1.00' end as vector from vh)
""" + _PAIRS + """
, ph as (select fragment_id as bid, min(host_id) as host_id from y join j0 on j0.bid=host_id where final in ('Consensus_merge','Final_keep_with_inheritance','Rule-Only_merge','Final_merge_(AI_overrides_Rule_Delete)') group by 1)
, px as (select distinct fragment_id as bid from y where final in ('Consensus_delete','Final_delete (AI overrides Rule_Merge)','Rule-Only_delete'))
, j1 as (select j0.bid, case when px.bid is not null then '非评估类别' when ph.bid is not null then o.main else j0.main end as main, case when px.bid is not null then '非评估类别' when ph.bid is not null then o.sub else j0.sub end as sub, case when px.bid is not null then '非评估类别:1.00' when ph.bid is not null then o.vector else j0.vector end as vector, case when px.bid is not null then 'Deleted' when ph.bid is not null then 'Inherited_'||ph.host_id else j0.source end as source from j0 left join ph on ph.bid=j0.bid left join j0 o on o.bid=ph.host_id left join px on px.bid=j0.bid)
""" + q._ML + """
, c0 as (select j1.*, name_en, structure_type, storeys, top_height, base_height, area, ml_main, ml_conf, active, case when main='未知类别' then '全残(主类未知)' when sub='未知类别' then '半残(子类未知)' when vector='' or vector like '%未知%' or regexp_matches(lower(vector), 'unknown|nan') then '半残(比例空缺或异常)' else '' end as gap from j1 join ml using (bid))
, c9 as (select *, case when main='非评估类别' then 'protected' when gap='' and source not in ('Fallback_to_Default','Fallback_to_Area','None','Unknown') then 'rule' when ml_conf < 0.5 then 'discard' when ml_main='混合用途' then 'several' when ml_main<>'未知类别' then 'one' when area < 100 then 'area' else 'default' end as step, list_transform(active, lambda x: case x when '住宅类别' then '私人房屋（Private Housing）' when '商业类别' then '其他商业（Other Commercial）' else '其他工业（Other Industrial）' end) as tops from c0)
, en as (select *, case when step in ('protected','discard') then '非评估类别' when step='rule' then main when step in ('several','one') then ml_main when step='area' then '住宅类别' else '商业类别' end as final_main,
 case step when 'protected' then '非评估类别' when 'rule' then sub when 'discard' then '置信度过低归为非评估' when 'area' then '其他房屋（Other Housing）' when 'default' then '其他商业（Other Commercial）' else tops[1] end as final_sub,
 case step when 'protected' then '非评估类别:1.00' when 'rule' then vector when 'discard' then '置信度过低归为非评估:1.00' when 'area' then '其他房屋（Other Housing）:1.00' when 'default' then '其他商业（Other Commercial）:1.00' when 'several' then array_to_string(list_transform(tops, lambda x: x||':'||printf('%.2f', 1.0::double/len(tops))), '-') else tops[1]||':1.00' end as final_vector,
 case step when 'protected' then 'Protected('||source||')' when 'rule' then 'Rule_Engine('||source||')' when 'discard' then 'ML_Low_Confidence_Discard' when 'area' then 'Fallback_to_Area' when 'default' then 'Fallback_to_Default' else 'Machine_Learning_Predicted' end as final_source,
 case step when 'protected' then '保留被判定为噪声/非评估的建筑' when 'rule' then '保留规则确定性结论' when 'discard' then 'ML推断置信度过低(P='||printf('%.2f', ml_conf)||')' when 'area' then '全流程未识别,小面积归住宅' when 'default' then '强制兜底为商业' else case when gap='' then 'ML推断填补-' else 'ML覆盖['||gap||']-' end || case step when 'several' then 'ML多标签混合' else 'ML回归精准分配' end || '(P='||printf('%.2f', ml_conf)||')' end as note from c9)
"""
_MAIN_SQL = "case final_main when '住宅类别' then 'Residential_住宅类别' when '商业类别' then 'Commercial_商业类别' when '工业类别' then 'Industrial_工业类别' when '混合用途' then 'Mixed-use_混合用途' when '非评估类别' then 'Non-assessed_非评估类别' else 'Unknown_未知类别' end"


@query(_CHAIN + f" select bid, name_en, structure_type, {pb._FLOORS} as floors, {_MAIN_SQL} as main, {_list_sql('final_sub')} as sub, {_list_sql('final_vector')} as vector, final_source as source, {_NOTE_SQL} as note from en", *pb._FULL_VIEWS, "pair_log")
def end_to_end(v):
    """From evidence to the published table; what a model and an external reader would say is a stand-in, all else is what the stage before decided."""
    return end(v, q.probabilities(v))


@query()
def end_to_end_model(v):
    """The same with probabilities of models trained on what the rules decided."""
    scores = q.ml_scores(v)
    return end(v, scores.select("bid", F.col("proba_is_residential").alias("p_res"), F.col("proba_is_commercial").alias("p_com"), F.col("proba_is_industrial").alias("p_ind")))
