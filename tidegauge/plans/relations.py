"""Queries on members, stages, configurations and stored targets over the landed tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidegauge.operators import resolution, views
from tidegauge.plans import oracle as sql, panel
from tidegauge.plans.catalog import customer, nation, orders, part, supplier

c = F.col


def name_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as configured, with a suffix and marks; every fourth is of another customer."""
    other = F.when(c("c_custkey") % 4 == 3, F.concat("c_name", F.lit("1"))).otherwise(F.concat(F.lit(" "), F.upper("c_name"), F.lit("-概念")))
    return customer(spark, sf_dir).select("c_custkey", resolution.names_agree(other, c("c_name")).alias("name_match"))


AGREEMENT = "select c_custkey, c_custkey % 4 <> 3 as name_match from customer"


def member_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types and names are industries; boards ask for words of them, for whole ones, and for concepts."""
    parts = part(spark, sf_dir)
    industries = parts.select(F.concat("p_name", F.lit("板块")).alias("industry"), c("p_partkey").alias("code"))
    words = parts.select(F.explode(F.split("p_name", " ")).alias("name"))
    asked = words.unionByName(parts.select(c("p_name").alias("name"))).unionByName(parts.select(c("p_brand").alias("name"))).distinct()
    targets = asked.select(F.explode(F.array(F.lit("industry"), F.lit("concept"))).alias("kind"), "name")
    constituents = parts.select(F.explode(F.array(F.lit("industry"), F.lit("concept"))).alias("kind"), c("p_brand").alias("name"), c("p_partkey").alias("code"))
    return resolution.members(targets, industries, constituents).groupBy("kind", "name", "origin").agg(F.count("*").alias("members"), F.sum("code").alias("code_sum"))


MEMBERS = """with names as (select distinct replace(p_name, ' ', '') as key, p_partkey as code from part), keys as (select distinct key from names),
asked as (select distinct name from (select unnest(string_split(p_name, ' ')) as name from part union all select p_name from part union all select p_brand from part)),
targets as (select kind, name, replace(lower(name), ' ', '') as wanted from asked, (values ('industry'), ('concept')) as k(kind)),
met as (select kind, name, key, row_number() over (partition by kind, name order by key <> wanted, length(key), key) as n from targets join keys on contains(key, wanted) and (key = wanted or length(wanted) >= 2) where kind = 'industry' and wanted <> ''),
found as (select kind, name, 'industry' as origin, code from met join names using (key) where n = 1
          union all select kind, name, 'constituents', p_partkey from targets t join part on p_brand = name where not exists (select 1 from met m where m.kind = t.kind and m.name = t.name))
select kind, name, origin, count(*) as members, sum(code)::bigint as code_sum from found group by all"""


def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of nations under their compact names, of some under their board names only."""
    k = c("n_nationkey")
    boards = nation(spark, sf_dir).select(F.concat("n_name", F.lit("板块")).alias("name"))
    catalog = nation(spark, sf_dir).filter(k % 5 != 4).select(k.alias("index_code"), F.when(k % 2 == 0, F.concat("n_name", F.lit("(板块)"))).otherwise(F.concat("n_name", F.lit("Ⅱ"))).alias("index_name"))
    return resolution.fallback_index(boards, catalog)


NAMES = "select n_name || '板块' as name, case when n_nationkey % 5 <> 4 then n_nationkey end::bigint as index_code, case when n_nationkey % 5 = 4 then null when n_nationkey % 2 = 0 then 'compact' else 'normalised' end as tier from nation"


def last_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pass at its last date. Which date that is needs no scores: the panel of bars has the same dates."""
    last = panel.metric_panel(spark, sf_dir).agg(F.max("as_of").alias("as_of"))
    return panel.first_pass(spark, sf_dir).join(F.broadcast(last), "as_of", "left_semi")  # one row


def sector_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sector's aliases are its members' boards: the concepts named by their numbers."""
    aliases = panel.sector_members(spark, sf_dir).select("sector", F.concat(F.lit("Board-"), c("code").cast("long").cast("string"), F.lit("行业")).alias("alias"))
    scored = last_scored(spark, sf_dir).filter("kind = 'concept'").select(F.concat(F.lit("board "), "code").alias("name"), "lifecycle", "mainline_score")
    return resolution.stages(aliases, scored)


def sector_month_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``sector_stages``, for each month: of its last week that had ended by the month's end."""
    rows = panel.first_pass(spark, sf_dir).filter("kind = 'concept'").select(F.trunc(F.date_add("as_of", 6), "month").alias("month"), "as_of", F.concat(F.lit("board "), "code").alias("name"), "lifecycle", "mainline_score")
    aliases = panel.sector_members(spark, sf_dir).select("sector", F.concat(F.lit("Board-"), c("code").cast("long").cast("string"), F.lit("行业")).alias("alias"))
    by_week = resolution.stages(aliases, rows.withColumnRenamed("as_of", "week"), ["month", "week"], unmet=True)  # a row for each sector and week, and one of the boards of none
    last = by_week.withColumn("last_week", F.max("week").over(Window.partitionBy("month")))
    return last.filter("week = last_week and sector is not null").drop("week", "last_week").withColumnRenamed("month", "as_of")


STAGES = f"""{sql.FIRST},
now as (select * from first_pass where kind = 'concept' and as_of = (select max(as_of) from first_pass)),
homes as (select 'sector_' || n_regionkey as sector, s_suppkey::varchar as code from supplier join nation on s_nationkey = n_nationkey),
stages as (select sector, lifecycle as stage, mainline_score as stage_score from (select *, row_number() over (partition by sector order by mainline_score desc, code desc) as n from homes join now using (code)) where n = 1)"""

MONTH_STAGES = f"""{sql.FIRST},
month_weeks as (select date_trunc('month', as_of + 6)::date as month, max(as_of) as week from first_pass where kind = 'concept' group by 1),
month_homes as (select 'sector_' || n_regionkey as sector, s_suppkey::varchar as code from supplier join nation on s_nationkey = n_nationkey),
month_stages as (select sector, month as as_of, lifecycle as stage from (select *, row_number() over (partition by sector, month order by mainline_score desc, code desc) as n from first_pass join month_weeks on as_of = week join month_homes using (code) where kind = 'concept') where n = 1)"""


def label_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extracts of a report: boards that lead, seeds, boxes and candidates."""
    rows = last_scored(spark, sf_dir)
    subsets = {"mainline": c("status").startswith("mainline"), "seed_radar": c("lifecycle").isin("Seed", "Ignition"), "sideways": c("sideways_seed_status").isin("sideways_seed", "sideways_watch"), "potential": c("status").isin("potential_start", "watch")}
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in subsets.items()]))
    return rows.select(F.explode(named).alias("subset"), "kind", "code", "mainline_score")


_SUBSETS = {"mainline": "status like 'mainline%'", "seed_radar": "lifecycle in ('Seed', 'Ignition')", "sideways": "sideways_seed_status in ('sideways_seed', 'sideways_watch')", "potential": "status in ('potential_start', 'watch')"}
SUBSETS = f"{sql.FIRST},\nnow as (select * from first_pass where as_of = (select max(as_of) from first_pass)),\nsubsets as (" + " union all ".join(f"select '{n}' as subset, kind, code, mainline_score from now where {r}" for n, r in _SUBSETS.items()) + ")"


def report_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_scored(spark, sf_dir).groupBy("as_of").agg(F.count("mainline_score").alias("scored"), F.count_if(c("mainline_score").isNull()).alias("failed"))


HEADER = f"{sql.FIRST},\nheader as (select max(as_of) as as_of, count(mainline_score) as scored, count(*) - count(mainline_score) as failed from first_pass where as_of = (select max(as_of) from first_pass))"


def top_hundred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ordered(last_scored(spark, sf_dir), "mainline_score", "kind", "code").limit(100)


HUNDRED = f"{sql.FIRST},\nhundred as (select * from first_pass where as_of = (select max(as_of) from first_pass) order by mainline_score desc, kind, code limit 100)"


def sector_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and segments are boards, customers their constituents; a region's boards are its nations and, for some, a segment."""
    specs = nation(spark, sf_dir).select(c("n_regionkey").alias("sector"), F.explode(F.array(c("n_name"), F.when(c("n_regionkey") < 2, "MACHINERY").otherwise("BUILDING"))).alias("board"))
    boards = customer(spark, sf_dir).join(nation(spark, sf_dir), c("c_nationkey") == c("n_nationkey")).select(F.explode(F.array("n_name", "c_mktsegment")).alias("board"), c("c_custkey").alias("code"), c("c_name").alias("name"))
    return resolution.sector_universe(specs, boards)


UNIVERSE = """with specs as (select distinct n_regionkey as sector, unnest([n_name, case when n_regionkey < 2 then 'MACHINERY' else 'BUILDING' end]) as board from nation),
boards as (select unnest([n_name, c_mktsegment]) as board, c_custkey as code, c_name as name from customer join nation on c_nationkey = n_nationkey)
select sector::bigint as sector, code, min(name) as name, count(distinct board) as board_hits from specs join boards using (board) group by sector, code"""


def sector_model_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in good standing are quoted; sectors are nations, some without a model; some suppliers bring their own."""
    stocks = supplier(spark, sf_dir).select(c("s_suppkey").alias("code"), c("s_nationkey").alias("sector"))
    quoted = supplier(spark, sf_dir).filter("s_acctbal > 0").select(c("s_suppkey").alias("code"))
    sectors = nation(spark, sf_dir).filter("n_regionkey <> 3").select(c("n_nationkey").alias("sector"), F.concat(F.lit("model_"), c("n_regionkey").cast("string")).alias("model"))
    own = supplier(spark, sf_dir).filter("s_acctbal > 5000").select(c("s_suppkey").alias("code"), F.lit("own").alias("model"))
    return resolution.configured(stocks, quoted, sectors, own)


MODELS = """select s_suppkey as code, s_nationkey::bigint as sector, case when n_regionkey <> 3 then 'model_' || n_regionkey when s_acctbal > 5000 then 'own' end as model, case when n_regionkey <> 3 then 'SECTOR' when s_acctbal > 5000 then 'OVERRIDE' else 'UNRESOLVED' end as model_source,
case when s_acctbal <= 0 then 'DATA_UNAVAILABLE' when n_regionkey = 3 and s_acctbal <= 5000 then 'MODEL_UNRESOLVED' else 'RESOLVED' end as model_status from supplier join nation on s_nationkey = n_nationkey"""


def unresolved_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of nations as wanted boards; those of customers with large balances are found."""
    specs = customer(spark, sf_dir).select(c("c_nationkey").alias("sector"), F.lit("industry").alias("kind"), c("c_name").alias("board"), F.when(c("c_mktsegment") == "BUILDING", "valuation").otherwise("inference").alias("purpose"))
    return resolution.unresolved_boards(specs, specs.join(customer(spark, sf_dir).filter("c_acctbal > 6000").select(c("c_name").alias("board")), "board", "left_semi"))


UNRESOLVED = """with specs as (select c_nationkey as sector, c_name as board, c_mktsegment = 'BUILDING' as valued, c_acctbal > 6000 as found from customer),
sums as (select sector, case when valued then 'valuation' else 'inference' end as purpose, count(*) filter (found) as found, coalesce(string_agg('industry:' || board, ';' order by board) filter (valued and not found), '') as unresolved from specs group by all)
select sector::bigint as sector, purpose, found, unresolved, case when found = 0 and unresolved <> '' then 'BOARD_RESOLUTION_FAILED' when found = 0 then 'EMPTY' else 'OK' end as resolution from sums"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored targets: their status is the model's version, their priority the configuration, their customer the code."""
    keyed = orders(spark, sf_dir).select(c("o_custkey").alias("code"), (c("o_orderkey") * 1.0).alias("trade_date"), c("o_orderstatus").alias("model_version"), c("o_orderpriority").alias("config_hash"), F.round("o_totalprice").cast("long").alias("price"))
    return keyed.withColumn("target", F.when(c("price") % 7 != 0, c("price") % 100))


def prev_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.previous_targets(_targets(spark, sf_dir), "F", "1-URGENT")


PREVIOUS = "select o_custkey as code, target::bigint as previous_target from (select *, case when round(o_totalprice)::bigint % 7 <> 0 then round(o_totalprice)::bigint % 100 end as target, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT') where n = 1"


def stock_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the first half of a day's customers are stored, the others are new; filled ones count as valued."""
    rows = orders(spark, sf_dir).select(F.to_date("o_orderdate").alias("trade_date"), (c("o_custkey") % 50).alias("code"), c("o_orderkey").alias("timestamp"), "o_orderstatus", "o_orderpriority")
    stored = rows.filter("o_orderpriority < '3'").select("trade_date", "code", "timestamp")
    new = rows.filter("o_orderpriority >= '3'").select("trade_date", "code", "timestamp", F.when(c("o_orderstatus") == "F", "OK").otherwise("INSUFFICIENT_DATA").alias("valuation_status"))
    return resolution.stock_upsert(stored, new)


UPSERT = "select o_orderdate::date::varchar as trade_date, o_custkey % 50 as code, max(o_orderkey) as timestamp from orders where o_orderpriority < '3' or o_orderstatus = 'F' group by 1, 2"

_HEAD = ["kind", "code", "mainline_score"]
#: Name, plan, columns and SQL of each query.
ENTRIES = [
    ("name_agreement", name_agreement, ["c_custkey", "name_match"], AGREEMENT),
    ("member_resolution", member_resolution, ["kind", "name", "origin", "members", "code_sum"], MEMBERS),
    ("name_match", name_match, ["name", "index_code", "tier"], NAMES),
    ("stage_join", sector_stages, ["sector", "stage", "stage_score"], sql.query(STAGES, "stages", sql.listed(["stage_score"], ["sector", "stage"]))),
    ("label_subsets", label_subsets, ["subset", *_HEAD], sql.query(SUBSETS, "subsets", sql.listed(["mainline_score"], ["subset", "kind", "code"]))),
    ("report_header", report_header, ["as_of", "scored", "failed"], sql.query(HEADER, "header", "as_of::varchar as as_of, scored, failed")),
    ("top_hundred", top_hundred, _HEAD, sql.query(HUNDRED, "hundred", sql.listed(["mainline_score"], ["kind", "code"]))),
    ("sector_universe", sector_universe, ["sector", "code", "name", "board_hits"], UNIVERSE),
    ("sector_model_join", sector_model_join, ["code", "sector", "model", "model_source", "model_status"], MODELS),
    ("unresolved_boards", unresolved_boards, ["sector", "purpose", "found", "unresolved", "resolution"], UNRESOLVED),
    ("prev_target", prev_target, ["code", "previous_target"], PREVIOUS),
    ("stock_upsert", stock_upsert, ["trade_date", "code", "timestamp"], UPSERT),
]
