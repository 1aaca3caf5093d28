"""Configurations written as JSON from landed rows, read back into dimension tables, and checked; with SQL that never sees the JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators import configuration
from tidegauge.sources import adapters

#: Suppliers in a document.
BLOCK = 100
_MODELS = ("utility", "growth_pe", "quality_growth", "innovation_drug", "commodity_cycle")
c = F.col


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each block of suppliers, with all nations as sectors; and three that are of no use: cut short, a list, without sectors."""
    k = c("n_nationkey")
    when = F.when
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    board = F.array(F.struct(when(k % 7 == 3, "index").otherwise("industry").alias("kind"), when(k % 3 == 0, text("B", k)).alias("board_code"), when(k % 11 != 4, F.array(text(c("n_name"), "概念"), text("N", k))).alias("aliases")))
    valued = F.array(F.struct(F.lit("concept").alias("kind"), when(k % 4 == 0, text("B", k)).alias("board_code"), F.array(when(k % 4 == 2, text("X", k)).otherwise(c("n_name"))).alias("aliases")))
    weights = F.create_map(F.lit("pe"), when(k % 10 == 4, -0.2).otherwise(0.6), F.lit("ocf_yield"), when(k % 7 == 1, 0.3).otherwise(0.4))
    sector = F.struct(
        when(k % 8 == 7, "guess").otherwise(F.element_at(F.array(*map(F.lit, _MODELS)), (k % 5 + 1).cast("int"))).alias("model"), when(k % 6 != 5, board).alias("boards"), when(k % 2 == 0, valued).alias("valuation_boards"), when(k % 3 != 0, weights).alias("model_weights"),
        F.lit(8.0).alias("fair_pe_floor"), when(k % 5 == 1, 5.0).otherwise(35.0).alias("fair_pe_cap"), F.lit(0.5).alias("fair_pb_floor"), when(k % 6 == 2, 0.25).otherwise(5.0).alias("fair_pb_cap"),
        when(k % 10 == 0, 0.02).otherwise(0.1).alias("required_return"), F.lit(0.03).alias("terminal_growth"), when(k % 2 == 1, 0.05).alias("target_ocf_yield"), when(k % 3 == 1, 12.5).alias("bootstrap_fair"), when(k % 6 == 1, "2024-02-30").otherwise("2024-02-28").alias("bootstrap_asof"),
    )
    sectors = adapters.landed(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", sector))).alias("sectors"))  # 25 nations
    n = c("s_suppkey")
    stock = F.struct(when(n % 13 != 0, c("s_name")).otherwise("").alias("name"), when(n % 17 != 0, when(n % 9 == 4, "NOWHERE").otherwise(c("n_name"))).alias("sector"), when(n % 18 == 4, F.struct(F.lit("growth_pe").alias("model"))).alias("model_override"))
    code = when(n % 10 == 3, text("12x", n)).otherwise(F.lpad(n.cast("string"), 6, "0"))
    nations = adapters.landed(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    stocks = adapters.landed(spark, sf_dir, "supplier").join(nations, c("s_nationkey") == c("n_nationkey")).groupBy(F.floor(n / BLOCK).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(code.alias("code"), stock))).alias("stocks"))  # a block's suppliers
    whole = stocks.crossJoin(F.broadcast(sectors)).select("block", F.to_json(F.struct("sectors", "stocks")).alias("text"))  # one row
    kinds = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("text")) for name, value in (("whole", c("text")), ("cut", F.substring("text", 1, 50)), ("list", F.lit("[1, 2]")), ("bare", F.lit('{"stocks": {}}')))])
    return whole.select("block", F.explode(kinds).alias("d")).select(text(c("d.name"), "-", c("block")).alias("document"), "d.text")


def table(name: str):
    return lambda spark, sf_dir: configuration.tables(documents(spark, sf_dir))[name]


def boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table("boards")(spark, sf_dir).withColumn("aliases", F.array_join("aliases", ","))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configuration.violations(configuration.tables(documents(spark, sf_dir)))


_SQL = f"""with blocks as (select distinct 'whole-' || (s_suppkey // {BLOCK}) as document from supplier),
k as (select *, n_nationkey as k, case when n_nationkey % 8 = 7 then 'guess' else [{", ".join(map(repr, _MODELS))}][n_nationkey % 5 + 1] end as model from nation),
sectors as (select document, n_name as sector, k, model, k % 6 <> 5 as has_boards, case when k % 3 <> 0 then 2 end as weights, case when k % 5 = 1 then 5.0::double else 35 end as fair_pe_cap, case when k % 6 = 2 then 0.25::double else 5 end as fair_pb_cap,
            case when k % 10 = 0 then 0.02::double else 0.1 end as required_return, case when k % 2 = 1 then 0.05::double end as target_ocf_yield, case when k % 3 = 1 then 12.5::double end as bootstrap_fair, case when k % 6 = 1 then '2024-02-30' else '2024-02-28' end as bootstrap_asof from blocks, k),
weights as (select document, n_name as sector, k, model, m.metric, case when m.metric = 'pe' then case when k % 10 = 4 then -0.2::double else 0.6 end else case when k % 7 = 1 then 0.3::double else 0.4 end end as weight from blocks, k, (values ('pe'), ('ocf_yield')) as m(metric) where k % 3 <> 0),
boards as (select document, n_name as sector, k, model, 'boards' as purpose, 0 as place, case when k % 7 = 3 then 'index' else 'industry' end as kind, case when k % 3 = 0 then 'B' || k end as board_code, case when k % 11 <> 4 then n_name || '概念,N' || k end as aliases from blocks, k where k % 6 <> 5
           union all select document, n_name, k, model, 'valuation_boards', 0, 'concept', case when k % 4 = 0 then 'B' || k end, case when k % 4 = 2 then 'X' || k else n_name end from blocks, k where k % 2 = 0),
stocks as (select 'whole-' || (s_suppkey // {BLOCK}) as document, case when s_suppkey % 10 = 3 then '12x' || s_suppkey else lpad(s_suppkey::varchar, 6, '0') end as code, case when s_suppkey % 13 <> 0 then s_name else '' end as name,
           case when s_suppkey % 17 <> 0 then case when s_suppkey % 9 = 4 then 'NOWHERE' else n_name end end as sector, s_suppkey % 18 = 4 as has_override from supplier join nation on s_nationkey = n_nationkey),
asked as (select * from sectors where model <> 'guess'),
sums as (select document, sector, sum(weight) as total, min(weight) as least from weights group by 1, 2)"""
_CHECKS = [
    ("sector", "unknown_model", "'guess'", "sectors where model = 'guess'"),
    ("sector", "boards_missing", "''", "asked where not has_boards"),
    ("sector", "weights_not_positive", "'-0.2'", "asked join sums using (document, sector) where least <= 0"),
    ("sector", "weights_sum", "round(total, 6)::varchar", "asked join sums using (document, sector) where least > 0 and abs(total - 1) > 1e-6"),
    ("sector", "fair_pe_bounds", "'8.0 > 5.0'", "asked where k % 5 = 1"),
    ("sector", "fair_pb_bounds", "'0.5 > 0.25'", "asked where k % 6 = 2"),
    ("sector", "return_not_above_growth", "'0.02 <= 0.03'", "asked where model = 'utility' and k % 10 = 0"),
    ("sector", "ocf_without_target_yield", "''", "asked where k % 3 <> 0 and k % 2 = 0"),
    ("sector", "bootstrap_date", "'2024-02-30'", "asked where k % 6 = 1"),
    ("sector", "board_kind", "'boards index'", "asked where k % 7 = 3 and has_boards"),
    ("sector", "board_unnamed", "'boards 0'", "asked where k % 11 = 4 and k % 3 <> 0 and has_boards"),
    ("sector", "boards_disjoint", "'x' || k", "asked where k % 4 = 2 and has_boards and k % 11 <> 4"),
    ("code", "stock_code", "''", "stocks where code like '12x%'"),
    ("code", "stock_name", "''", "stocks where name = ''"),
    ("code", "stock_sector", "''", "stocks where name <> '' and sector is null"),
    ("code", "unknown_sector", "coalesce(sector, 'null')", "stocks where name <> '' and coalesce(sector, 'NOWHERE') = 'NOWHERE' and not has_override"),
]
_BROKEN = " union all ".join(f"select document, {entity} as entity, '{rule}' as rule, {detail} as detail from {source}" for entity, rule, detail, source in _CHECKS)
_NUMBERS = ["fair_pe_floor", "fair_pe_cap", "fair_pb_floor", "fair_pb_cap", "required_return", "terminal_growth", "target_ocf_yield", "bootstrap_fair"]
_SHOWN = {"fair_pe_floor": "8.0::double", "fair_pb_floor": "0.5::double", "terminal_growth": "0.03::double"}
#: Name, plan, columns and SQL of each query.
ENTRIES = [
    ("config_sectors", table("sectors"), ["document", "sector", "model", "has_boards", *_NUMBERS, "bootstrap_asof"], f"{_SQL} select document, sector, model, has_boards, {', '.join(f'{_SHOWN.get(n, n)} as {n}' for n in _NUMBERS)}, bootstrap_asof from sectors"),
    ("config_boards", boards, ["document", "sector", "purpose", "place", "kind", "board_code", "aliases"], f"{_SQL} select document, sector, purpose, place, kind, board_code, aliases from boards"),
    ("config_weights", table("weights"), ["document", "sector", "metric", "weight"], f"{_SQL} select document, sector, metric, weight from weights"),
    ("config_stocks", table("stocks"), ["document", "code", "name", "sector", "has_override"], f"{_SQL} select document, code, name, sector, has_override from stocks"),
    ("config_malformed", table("malformed"), ["document", "reason"], f"select d || '-' || block as document, reason from (select distinct s_suppkey // {BLOCK} as block from supplier), (values ('cut', 'not_json'), ('list', 'not_json'), ('bare', 'no_sectors')) as m(d, reason)"),
    ("config_violations", violations, ["document", "entity", "rule", "detail"], f"{_SQL} {_BROKEN}"),
]
