"""Stand-ins for the engine's inputs as views over the given tables; one text serves Spark and the SQL oracle.

Every seventh building is a small fragment that touches the left side of the building before it, some shops have a tag that no
table knows, and a permit belongs to a building where an order line of one or two pieces links them: so that some buildings
have floor areas and others none, every rule has rows to decide.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: view: (base table, SELECT with {S} for the string type)
VIEWS = {
    "fx_buildings": ("part", """select p_partkey as bid, case when p_partkey%7=1 then ((p_partkey-1)*7919)%30011/cast(10 as double) - 1 - p_size%5 else (p_partkey*7919)%30011/cast(10 as double) end as x1,
 case when p_partkey%7=1 then ((p_partkey-1)*6101)%29989/cast(10 as double) else (p_partkey*6101)%29989/cast(10 as double) end as y1,
 case when p_partkey%7=1 then ((p_partkey-1)*7919)%30011/cast(10 as double) else (p_partkey*7919)%30011/cast(10 as double) + 4 + p_size%20 end as x2,
 case when p_partkey%7=1 then ((p_partkey-1)*6101)%29989/cast(10 as double) + 2 + (p_size*3)%9 else (p_partkey*6101)%29989/cast(10 as double) + 4 + (p_size*3)%20 end as y2,
 case p_partkey%7 when 0 then 'P' when 1 then 'U' else 'T' end as structure_type,
 case p_size%6 when 0 then '9' else cast(p_size%6 as {S}) end as category,
 case when p_size%4=0 then null else p_name end as name_en, p_type as info_desc,
 case when p_size%3=0 then cast(p_size%12 as {S}) when p_size%3=1 then '' else 'n/a' end as storeys,
 p_retailprice/100 as top_height, cast(p_size%5 as double) as base_height from part"""),
    "fx_registry": ("customer", """select c_custkey as rid, (c_custkey*104729)%30011/cast(10 as double) as px, (c_custkey*15485863)%29989/cast(10 as double) as py,
 case c_custkey%3 when 0 then 'TOWER' when 1 then 'PODIUM' else 'OTHER' end as kind, c_mktsegment as usage_class, c_name as address,
 case c_nationkey%3 when 0 then cast(1950+c_nationkey*2 as {S}) || '-06-30' when 1 then 'unknown' else null end as op_date from customer"""),
    "fx_pois": ("events", """select event_id as osmid, (event_id*7877)%30011/cast(10 as double) as px, (event_id*6203)%29989/cast(10 as double) as py,
 case event_type when 'view' then 'restaurant' when 'click' then 'school' when 'error' then 'nan' else null end as amenity,
 case event_type when 'purchase' then 'retail' when 'signup' then case when event_id%3=0 then 'florist' else 'bank' end else null end as shop,
 case when event_id%4=0 then null else event_type || ' ' || cast(user_id as {S}) end as name, value, ts from events"""),
    "fx_polys": ("orders", """select o_orderkey as osmid, (o_orderkey*7907)%30011/cast(10 as double) as x1, (o_orderkey*5003)%29989/cast(10 as double) as y1,
 (o_orderkey*7907)%30011/cast(10 as double) + 3 + o_orderkey%11 as x2, (o_orderkey*5003)%29989/cast(10 as double) + 3 + o_orderkey%13 as y2,
 case o_orderstatus when 'F' then 'apartments' when 'O' then 'industrial' else 'yes' end as building, o_orderpriority as name from orders"""),
    "fx_zones": ("nation", """select n_nationkey as zone_id, (n_nationkey%5)*cast(620 as double) as x1, cast(floor(n_nationkey/5) as int)*cast(620 as double) as y1,
 (n_nationkey%5)*cast(620 as double)+620 as x2, cast(floor(n_nationkey/5) as int)*cast(620 as double)+620 as y2,
 case n_regionkey when 0 then 'C' when 1 then 'R(A)' when 2 then 'V' when 3 then 'C/R' else 'GB' end as zone_label from nation"""),
    "fx_permits": ("orders", """select o_orderkey as opno, case when o_orderpriority like '1%' then null else cast(o_totalprice as double) end as domestic_gfa,
 case when o_orderstatus='F' then cast(0 as double) else cast(o_totalprice as double)/2 end as nondomestic_gfa from orders"""),
    "fx_permit_links": ("lineitem", "select distinct l_partkey as bid, l_orderkey as opno from lineitem where l_quantity <= 2"),
    "fx_pair_log": ("events", """select user_id as fragment_id, event_id%50 as host_id, event_id as seq, ts,
 case event_type when 'view' then 'keep' when 'click' then 'merge' when 'purchase' then 'delete' when 'signup' then 'error' else null end as ai_decision,
 case cast(floor(value) as int)%4 when 0 then 'merge' when 1 then 'delete' when 2 then 'keep' else null end as rule_decision from events"""),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, text = VIEWS[name]
    head, _, tail = text.replace("{S}", "string").rpartition(f"from {table}")
    return spark.sql(head + "from {base}" + tail, base=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def with_views(*names: str) -> str:
    """WITH clause of an oracle."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1].replace('{S}', 'varchar')})" for n in names)
