"""Fair multiples and lenses of sectors and stocks on the landed tables, with SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators import fundamentals, history, trajectory, valuation
from tidegauge.plans import oracle as sql, panel

#: The families that sectors take in turn, and their terms.
MODELS = ("growth_pe", "cyclical_growth", "quality_growth", "utility", "innovation_drug")
TERMS = {
    "target_peg": 1.2, "growth_floor_pct": 5.0, "growth_cap_pct": 30.0, "profit_growth_premium_cap_pct": 20.0, "fair_pe_floor": 8.0, "fair_pe_cap": 35.0, "fair_ps_floor": 0.5, "fair_ps_cap": 10.0,
    "fair_pb_floor": 0.5, "fair_pb_cap": 5.0, "cycle_discount": 0.85, "base_ps": 1.5, "revenue_growth_ps_slope": 0.04, "reference_net_margin": 0.08, "margin_ps_slope": 6.0, "profitable_ps_bonus": 0.5,
    "base_pb": 1.2, "reference_roe": 0.10, "roe_pb_slope": 8.0, "terminal_growth": 0.03, "required_return": 0.09, "target_ocf_yield": 0.05,
}
GROWTH_COVERAGE = 0.50
c = F.col


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sector: its family and terms."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("r_regionkey") % len(MODELS) + 1).cast("int"))
    return region.select(F.concat(F.lit("sector_"), F.col("r_regionkey").cast("string")).alias("sector"), model.alias("model"), *[F.lit(v).alias(k) for k, v in TERMS.items()])


def fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    sectors = fundamentals.sector_aggregate(panel.sector_members(spark, sf_dir), panel.company_table(spark, sf_dir))
    return valuation.fair_multiples(sectors.join(config(spark, sf_dir), "sector"), GROWTH_COVERAGE)


#: Sectors of an even number start from a value of their own, for a while.
BOOTSTRAP = {"metric": "pe", "fair": 15.0, "asof": "1995-02-01"}


def month_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sector's multiples and fair multiples in each month, over the stocks quoted then, with a hash of these."""
    home = panel.sector_members(spark, sf_dir).select(c("sector").alias("home"), c("code").alias("stock"))
    month = F.date_format("as_of", "yyyyMM")
    companies = panel.cut(panel.month_companies(spark, sf_dir).withColumnRenamed("code", "stock").withColumn("code", F.concat("stock", F.lit("@"), month)))
    held = companies.filter("market_cap > 0").select("as_of", "stock", "code").join(home, "stock").withColumn("sector", F.concat("home", F.lit("@"), month))
    sectors = fundamentals.sector_aggregate(held, companies).join(trajectory.universe_hash(held, "sector", "stock"), "sector").join(held.select("sector", "home", "as_of").distinct(), "sector")
    started = F.when(F.substring_index("home", "_", -1).cast("int") % 2 == 0, F.to_date(F.lit(BOOTSTRAP["asof"])))
    terms = config(spark, sf_dir).withColumnRenamed("sector", "home")
    rows = valuation.fair_multiples(sectors.join(terms, "home"), GROWTH_COVERAGE)
    return rows.withColumns({"bootstrap_metric": F.lit(BOOTSTRAP["metric"]), "bootstrap_fair": F.lit(BOOTSTRAP["fair"]), "bootstrap_weight": valuation.bootstrap_weight(F.last_day("as_of"), started)})


def sector_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each sector's lenses in each month, their fair values drawn by what the same universe of stocks was worth in earlier months."""
    rows = panel.cut(month_sectors(spark, sf_dir))  # read by the lenses, by their history and by what it is known at
    own = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c(m).alias("value")) for m in ("pe", "pb", "ps")]))
    stored = rows.select("home", c("as_of").alias("date"), c("universe_hash").alias("stored_hash"), own.alias("v")).select("home", "date", "stored_hash", "v.*").filter("value > 0")
    past = history.known_at(rows.withColumn("code", c("sector")), stored, "home", "as_of", "date").filter("stored_hash = universe_hash")
    past = history.stats(history.last_positive(past, ["code", "metric"], "value", "date"), ["code", "metric"], "value", "date").withColumnRenamed("code", "sector")
    weights = valuation.model_weights(config(spark, sf_dir)).withColumnRenamed("sector", "home")
    return valuation.sector_lenses(rows, rows.select("sector", "home").join(weights, "home").drop("home"), past=past).join(rows.select("sector", "home", "as_of"), "sector")


def sector_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lenses = panel.cut(sector_lenses(spark, sf_dir))
    return valuation.sector_values(lenses).join(lenses.select("sector", "home", "as_of").distinct(), "sector")


def stock_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    stocks = panel.sector_members(spark, sf_dir).select("sector", "code").join(panel.company_table(spark, sf_dir), "code")
    anchors = fair(spark, sf_dir).select("sector", "fair_pe", "fair_ps", "fair_pb", "target_ocf_yield")
    return valuation.stock_lenses(stocks.join(anchors, "sector"), valuation.model_weights(config(spark, sf_dir)))


def _share(condition: str, of: str = "market_cap") -> str:
    return f"coalesce(sum({of}) filter ({condition}), 0) / sum(market_cap)"


def _above(top: str, bottom: str, condition: str) -> str:
    below = f"sum({bottom}) filter ({condition})"
    return f"case when {below} > 0 then sum({top}) filter ({condition}) / {below} end"


def _bounded(x: str, low: float, high: float) -> str:
    return f"case when {x} is not null then greatest({low}::double, least({high}::double, {x})) end"


def _within(x: str, name: str) -> str:
    return f"case when {x} is not null then greatest(fair_{name}_floor, least(fair_{name}_cap, {x})) end"


def _of_metric(pe: str, pb: str, ps: str, ocf: str) -> str:
    return f"case metric when 'pe' then {pe} when 'pb' then {pb} when 'ps' then {ps} else {ocf} end"


_BOTH, _GROWS = "net_profit_cur is not null and net_profit_pri is not null", f"model in ({', '.join(repr(f) for f in valuation.GROWTH_FAMILIES)})"
_WEIGHTS = ", ".join(f"('{family}', '{metric}', {weight}::double)" for family, weights in valuation.DEFAULT_WEIGHTS.items() for metric, weight in weights.items())
FAIR = f"""{sql.SECTORS},
config as (select 'sector_' || r_regionkey as sector, [{", ".join(repr(m) for m in MODELS)}][r_regionkey % {len(MODELS)} + 1] as model, {", ".join(f"{v}::double as {k}" for k, v in TERMS.items())} from region),
gauged as (select sector, coalesce(sum(net_profit_pri) filter ({_BOTH}) <= 0 and sum(net_profit_cur) filter ({_BOTH}) > 0, false) as turnaround, {_share("revenue_cur > 0 and revenue_pri > 0")} as growth_r, {_share(_BOTH)} as growth_p,
           {_above("ttm_profit", "ttm_revenue", "ttm_revenue > 0 and ttm_profit is not null")} as net_margin, {_above("ttm_operating_cashflow", "ttm_profit", "ttm_operating_cashflow is not null and ttm_profit is not null")} as cash_conversion,
           {_above("ttm_profit", "market_cap / pb", "pb > 0 and ttm_profit is not null")} as roe, {_share("ttm_profit is not null")} as pe_mcap_coverage, {_share("ttm_revenue > 0")} as ps_mcap_coverage,
           {_share("ttm_profit is not null", "market_cap * coalesce(ttm_profit_confidence, 0)")} as pe_sure, {_share("ttm_revenue is not null", "market_cap * coalesce(ttm_revenue_confidence, 0)")} as ps_sure,
           {_share("ttm_operating_cashflow is not null", "market_cap * coalesce(ttm_operating_cashflow_confidence, 0)")} as ocf_sure,
           {_share("ttm_roe_pct is not null", "market_cap * least(coalesce(ttm_profit_confidence, 0), case when average_equity is not null then 0.9::double else 0.45 end)")} as roe_sure,
           {_share("pb > 0 and ttm_profit is not null")} as roe_coverage from x group by sector),
known as (select s.*, g.* exclude (sector), c.* exclude (sector), case when profitable_mcap_coverage >= 0.70 then aggregate_pe end as pe, case when growth_r >= {GROWTH_COVERAGE} then revenue_growth * 100 end as rg,
          case when growth_p >= {GROWTH_COVERAGE} then profit_growth * 100 end as pg from sectors s join gauged g using (sector) join config c using (sector)),
based as (select *, turnaround or coalesce(abs(pg) >= 200, false) as low_base, case when pg is not null and rg is not null then least(pg, rg + profit_growth_premium_cap_pct) else pg end as first_cap from known),
capped as (select *, case when low_base and first_cap is not null then least(first_cap, greatest(coalesce(rg, 0), 0) + 10) else first_cap end as second_cap from based),
parts as (select *, {_bounded("second_cap", -30, 80)} as p, {_bounded("rg", -30, 60)} as r from capped),
blended as (select *, coalesce(case when low_base then 0.35::double * p + 0.65::double * r else 0.65::double * p + 0.35::double * r end, p, r) as normalized_growth_pct from parts),
grown as (select *, case when normalized_growth_pct is not null then greatest(growth_floor_pct, least(growth_cap_pct, normalized_growth_pct)) end as growth_used_pct,
          case when normalized_growth_pct is null then 'MISSING' when turnaround then 'TURNAROUND' when low_base then 'LOW_BASE' else 'NORMAL' end as growth_regime,
          case when model in ('cyclical_growth', 'commodity_cycle') then cycle_discount else 1.0 end as discount,
          case when model in ('quality_growth', 'mature_consumer', 'materials_mature') and cash_conversion is not null then {_bounded("0.85 + 0.15::double * cash_conversion", 0.8, 1.1)} else 1.0 end as cash from blended),
drawn as (select *, case when {_GROWS} and rg is not null and pg is not null then target_peg * growth_used_pct * discount * cash end as raw_pe,
          case when rg is null then null when {_GROWS} then base_ps + greatest(rg, 0) * revenue_growth_ps_slope + coalesce((net_margin - reference_net_margin) * margin_ps_slope, 0)
          when model in ('innovation_drug', 'early_growth_ps') then base_ps + greatest({_bounded("rg", -10, 50)}, 0) * revenue_growth_ps_slope + case when model = 'innovation_drug' and profit_growth > 0 and profitable_mcap_coverage > 0.6 then profitable_ps_bonus else 0 end end as raw_ps,
          case when roe is null then null when {_GROWS} then base_pb + greatest(roe - reference_roe, -0.05) * roe_pb_slope
          when model = 'utility' and roe > terminal_growth and required_return > terminal_growth then (roe - terminal_growth) / (required_return - terminal_growth) end as raw_pb from grown),
fair as (select *, {_within("raw_pe", "pe")} as fair_pe, {_within("raw_ps", "ps")} as fair_ps, {_within("raw_pb", "pb")} as fair_pb, coalesce(raw_pe <= fair_pe_floor, false) as floor_hit, coalesce(raw_pe >= fair_pe_cap, false) as cap_hit from drawn),
weights as (select sector, metric, weight from config join (values {_WEIGHTS}) as w(model, metric, weight) using (model))"""
_SURE = _of_metric("case when pe is not null then pe_sure else 0 end", "least(pb_mcap_coverage, case when roe_sure > 0 then roe_sure else roe_coverage end)", "ps_sure", "ocf_sure")
_MONTH_FAIR = (
    f"{sql.MONTHS}{FAIR[len(sql.MASTER):]}"
    .replace("x as (select 'sector_' || n_regionkey as sector, m.* from (select lpad(s_suppkey::varchar, 6, '0') as code, n_regionkey from supplier join nation on s_nationkey = n_nationkey) join master m using (code)",
             "x as (select 'sector_' || n_regionkey || '@' || strftime(as_of, '%Y%m') as sector, 'sector_' || n_regionkey as home, m.* from (select lpad(s_suppkey::varchar, 6, '0') as stock, n_regionkey from supplier join nation on s_nationkey = n_nationkey) join master m using (stock)")
    .replace("known as (select s.*, g.* exclude (sector), c.* exclude (sector),", "known as (select s.*, g.* exclude (sector), h.home, h.as_of, h.universe, c.* exclude (home),")
    .replace("join gauged g using (sector) join config c using (sector))", "join gauged g using (sector) join (select sector, home, as_of, string_agg(distinct stock, ',' order by stock) as universe from x group by all) h using (sector) join (select sector as home, * exclude (sector) from config) c using (home))")
)
SECTOR_LENSES = f"""{_MONTH_FAIR},
sector_values as (select home, universe, as_of as date, metric, v from (unpivot (select home, universe, as_of, pe, pb, ps from fair) on pe, pb, ps into name metric value v) where v > 0),
past_values as (select f.sector || '#' || metric as code, date, v from fair f join sector_values s on s.home = f.home and s.universe = f.universe and s.date < f.as_of),
{sql.statistics("past", "past_values")},
begun as (select *, case when home[-1:]::int % 2 = 0 and greatest(0, last_day(as_of) - date '{BOOTSTRAP["asof"]}') <= 180 then 0.30::double * greatest(0.10::double, 1 - greatest(0, last_day(as_of) - date '{BOOTSTRAP["asof"]}') / 180) else 0 end as begin_weight from fair),
paired as (select b.sector, home, as_of, w.metric, weight, {_of_metric("pe", "pb", "ps", "ocf_yield")} as current_value, {_of_metric("pe_mcap_coverage", "pb_mcap_coverage", "ps_mcap_coverage", "ocf_mcap_coverage")} as coverage, {_of_metric("fair_pe", "fair_pb", "fair_ps", "target_ocf_yield")} as model_fair,
           weight * greatest(0, least(1, coalesce({_SURE}, 0))) as sure, begin_weight, p.status = 'OK' as known_past, q[3] as past_median, effective_points / (effective_points + 60) * p.confidence as past_weight
           from begun b join (select sector as home, metric, weight from weights) w using (home) left join past p on p.code = b.sector || '#' || w.metric),
drawing as (select *, case when metric = 'ocf_yield' or not coalesce(model_fair > 0, false) then 'none' when coalesce(known_past, false) then 'past' when metric = '{BOOTSTRAP["metric"]}' and begin_weight > 0 then 'begin' else 'none' end as way from paired),
drawn_fair as (select *, case way when 'past' then past_weight when 'begin' then begin_weight else 0 end as history_weight, case way when 'past' then exp((1 - past_weight) * ln(model_fair) + past_weight * ln(past_median)) when 'begin' then exp((1 - begin_weight) * ln(model_fair) + begin_weight * ln({BOOTSTRAP["fair"]}::double)) else model_fair end as fair_value from drawing),
judged as (select *, case when not coalesce(current_value > 0 and coverage >= 0.70, false) then 'invalid_current_or_coverage' when not coalesce(model_fair > 0, false) then 'missing_independent_fair_anchor'
           when sure <= 0 then 'missing_confidence' else '' end as drop_reason from drawn_fair),
lenses as (select *, case when drop_reason = '' then case when metric = 'ocf_yield' then fair_value / current_value else current_value / fair_value end end as ratio, case when drop_reason = '' then sure else 0 end as weight_left from judged)"""
SECTOR_VALUES = f"""{SECTOR_LENSES},
summed as (select sector, home, as_of, sum(weight) as total, count(*) filter (ratio > 0 and weight_left > 0) as used, sum(weight_left) filter (ratio > 0 and weight_left > 0) as w, sum(weight_left * ln(ratio)) filter (ratio > 0 and weight_left > 0) as l,
           sum(weight_left * ln(ratio) * ln(ratio)) filter (ratio > 0 and weight_left > 0) as q, coalesce(string_agg(upper(metric), ';' order by metric) filter (ratio > 0 and weight_left > 0), '') as models_used from lenses group by sector, home, as_of),
valued_sectors as (select sector, home, as_of, exp(l / w) as center, case when used = 1 then 0 else sqrt(greatest(0, q / w - (l / w) * (l / w))) end as disagreement, coalesce(w, 0) / total as model_weight_coverage, models_used, exp(l / w) - 1 as multiple_deviation from summed),
labelled as (select *, case when multiple_deviation is null then 'unknown' when multiple_deviation <= -0.25 then 'undervalued' when multiple_deviation <= -0.10 then 'slightly_low' when multiple_deviation < 0.15 then 'fair'
             when multiple_deviation < 0.35 then 'high' when multiple_deviation < 0.70 then 'overvalued' else 'extreme' end as valuation_label,
             case when model_weight_coverage < 0.70 then 'LOW_MODEL_COVERAGE' when center is null then 'INSUFFICIENT_DATA' else 'OK' end as valuation_status from valued_sectors)"""
_BASIS = "case when {0} > 0 then {0} * {1} end"
_PROFIT_SURE = "coalesce(ttm_profit_confidence, 0)"
STOCK_LENSES = f"""{FAIR},
held as (select 'sector_' || n_regionkey as sector, m.*, fair_pe, fair_ps, fair_pb, target_ocf_yield from (select lpad(s_suppkey::varchar, 6, '0') as code, n_regionkey from supplier join nation on s_nationkey = n_nationkey)
         join master m using (code) join fair f on f.sector = 'sector_' || n_regionkey),
implied as (select code, sector, metric, weight, {_of_metric(_BASIS.format("ttm_eps", "fair_pe"), _BASIS.format("bvps", "fair_pb"), _BASIS.format("sps_ttm", "fair_ps"), "case when ttm_ocfps > 0 and target_ocf_yield > 0 then ttm_ocfps / target_ocf_yield end")} as implied_price,
            weight * coalesce({_of_metric(f"case when ttm_eps is not null then least({_PROFIT_SURE}, 0.9) else 0 end", f"least({_PROFIT_SURE}, case when average_equity is not null then 0.9 else 0.45 end)", "ttm_revenue_confidence", "case when ttm_operating_cashflow / shares_outstanding is not null then least(ttm_operating_cashflow_confidence, 0.9) when ocfps_cur is not null then 0.35 else 0 end")}, 0) as sure
            from held join weights using (sector)),
stock_lenses as (select code, sector, metric, weight, implied_price, case when not coalesce(implied_price > 0, false) then 'missing_basis_or_independent_anchor' when sure <= 0 then 'zero_data_confidence' else '' end as drop_reason, sure from implied),
stock_rows as (select *, case when drop_reason = '' then sure else 0 end as weight_left from stock_lenses)"""
_WIDE = [f"{k}_{m}" for m in valuation.METRICS for k in ("configured_weight", "effective_weight")]
_REASONS = [f"drop_reason_{m}" for m in valuation.METRICS]
WIDE = f"""{STOCK_LENSES},
wide_rows as (select code, {", ".join(f"max(weight) filter (metric = '{m}') as configured_weight_{m}, max(weight_left) filter (metric = '{m}') as effective_weight_{m}, max(drop_reason) filter (metric = '{m}') as drop_reason_{m}" for m in valuation.METRICS)} from stock_rows group by code)"""

_FAIR = ["normalized_growth_pct", "growth_used_pct", "fair_pe", "fair_ps", "fair_pb"]
_LENS = ["weight", "current_value", "fair_value", "history_weight", "ratio", "weight_left"]
_VALUE = ["center", "disagreement", "model_weight_coverage", "multiple_deviation"]
_IMPLIED = ["weight", "implied_price", "weight_left"]

#: Name, plan, columns and SQL of each query.
ENTRIES = [
    ("fair_multiples", fair, ["sector", "model", "growth_regime", "floor_hit", "cap_hit", *_FAIR], sql.query(FAIR, "fair", sql.listed(_FAIR, ["sector", "model", "growth_regime", "floor_hit", "cap_hit"]))),
    ("sector_lens", lambda s, d: sector_lenses(s, d).withColumnsRenamed({"current": "current_value", "fair": "fair_value", "left": "weight_left"}), ["home", "as_of", "metric", "drop_reason", *_LENS], sql.query(SECTOR_LENSES, "lenses", sql.listed(_LENS, ["home", "as_of::varchar as as_of", "metric", "drop_reason"]))),
    ("valuation_status", sector_values, ["home", "as_of", "models_used", "valuation_label", "valuation_status", *_VALUE], sql.query(SECTOR_VALUES, "labelled", sql.listed(_VALUE, ["home", "as_of::varchar as as_of", "models_used", "valuation_label", "valuation_status"]))),
    ("stock_lens", lambda s, d: stock_lenses(s, d).withColumnRenamed("left", "weight_left"), ["code", "sector", "metric", "drop_reason", *_IMPLIED], sql.query(STOCK_LENSES, "stock_rows", sql.listed(_IMPLIED, ["code", "sector", "metric", "drop_reason"]))),
    ("wide_result", lambda s, d: valuation.wide(stock_lenses(s, d), "code"), ["code", *_WIDE, *_REASONS], sql.query(WIDE, "wide_rows", sql.listed(_WIDE, ["code", *_REASONS]))),
]
