"""Stocks from their own fundamentals to a target position, month by month, each from what could be known then; with SQL for each step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators import fundamentals, history, resolution, valuation
from tidegauge.plans import appraisal, oracle as sql, panel, policy, relations

c = F.col


#: The version under which the engine's own centers are stored and read back.
VERSION = "own-1"


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier of a sector in each month beside its family's terms, with its own multiples. A row is named by ``code``, the
    stock's and the month. Ten times the price to book stands for the quote's price to earnings."""
    rows = panel.sector_members(spark, sf_dir).select("sector", "code").join(panel.month_companies(spark, sf_dir), "code").join(appraisal.config(spark, sf_dir), "sector")
    rows = rows.withColumnRenamed("code", "stock").withColumn("code", F.concat("stock", F.lit("@"), F.date_format("as_of", "yyyyMM")))
    return valuation.current_pe(valuation.stock_anchors(rows.withColumn("pe_dynamic", 10 * c("pb"))))


def lenses(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``rows`` with their lenses: anchors drawn to the stock's own multiples of that month and those before it, each taken at its own time."""
    multiples = {m: F.when(c(v) > 0, c(v)) for m, v in (("pe", "pe"), ("pb", "pb"), ("ps", "ps_ttm_calc"))}
    past = history.with_past(rows, "stock", "as_of", multiples, including=True, most=750, said=("status", "median", "effective_points", "confidence"))
    return valuation.anchored_lenses(past, valuation.model_weights(appraisal.config(spark, sf_dir)))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Center, data quality, growth gate and status of each stock and month."""
    rows = stocks(spark, sf_dir)
    market = rows.groupBy("as_of").agg(F.max("quote_trade_date").alias("today"), (F.count("revenue_cur") / F.count("*")).alias("report_coverage"))
    x = valuation.center_of(lenses(spark, sf_dir, rows)).join(F.broadcast(market), "as_of")  # a row for each month
    profit, revenue = F.coalesce("ttm_profit_confidence", F.lit(0.0)), c("ttm_revenue_confidence")
    age = lambda day: F.datediff("today", day)
    parts = {
        "ttm": F.when(revenue.isNotNull(), (profit + revenue) / 2).otherwise(profit),
        "growth": (c("revenue_growth").isNotNull().cast("double") + c("profit_growth").isNotNull().cast("double")) / 2,
        "history": c("history_confidence"),
        "cashflow": F.when(c("cash_conversion").isNotNull(), c("ttm_ocfps_confidence")),
        "sector": F.lit(1.0),
        "report_coverage": c("report_coverage"),
        "financial_age": fundamentals.age_score(age(F.to_date("period", "yyyyMMdd")), 120, 540),
        "quote_age": fundamentals.age_score(age("quote_trade_date"), 3, 10),
    }
    x = x.withColumn("quality", valuation.quality(parts, c("model"), resolution.names_agree(F.concat(F.lit(" "), "name", F.lit("概念")), c("name"))))
    label, coverage = valuation.confidence_label(c("quality")), c("model_weight_coverage")
    status = F.when((label != "NO_VALUATION") & c("center").isNotNull() & (coverage >= 0.70), "OK").when(coverage < 0.70, "LOW_MODEL_COVERAGE").otherwise("INSUFFICIENT_DATA")
    return x.withColumns({"valuation_confidence": label, "valuation_status": status, "gate": valuation.growth_gate(c("model"), c("revenue_growth"), c("profit_growth"), c("cash_conversion"))})


def snapshots(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """``judged`` rows as the engine stores them: with their residuals, under its version and the sector's configuration."""
    hashed = appraisal.config(spark, sf_dir)
    hashed = hashed.select("sector", F.sha2(F.to_json(F.struct(*sorted(hashed.columns))), 256).alias("config_hash"))
    residual = F.when((c("price") > 0) & (c("center") > 0), F.log(c("price") / c("center")))
    return rows.withColumn("residual", residual).join(F.broadcast(hashed), "sector").withColumn("model_version", F.lit(VERSION))  # a row for each sector


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judged`` with each residual beside those of earlier months that the same version and configuration stored, and the trade bands these make."""
    x = history.with_past(snapshots(spark, sf_dir, judged(spark, sf_dir)), ["stock", "config_hash", "model_version"], "as_of", {"residual": c("residual")})
    past = c("past_residual")
    x = x.withColumns({"res_status": F.coalesce(past["status"], F.lit("MISSING")), "res_mad": past["mad"], **{f"res_{q}": past[q] for q in history.QUANTILES}})
    ok = c("res_status") == "OK"
    x = x.withColumns({"valuation_quantile": F.when(ok, valuation.residual_place(past["ordered"], c("residual"))), "robust_z": F.when(ok, history.robust_z(c("residual"), c("res_q50"), c("res_mad")))}).drop("past_residual")
    terms = {"base_margin": F.lit(policy.MARGIN), "base_uncertainty": F.lit(policy.UNCERTAINTY), "cycle_penalty": F.when(c("model") == "cyclical_growth", 0.05).otherwise(0.0)}
    return valuation.trade_bands(valuation.interval(x.withColumns(terms)))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target for each stock and month under the stage its sector's best board had then; each month starts from the last target kept."""
    stages = relations.sector_month_stages(spark, sf_dir).select("sector", "as_of", "stage")
    x = banded(spark, sf_dir).join(F.broadcast(stages), ["sector", "as_of"], "left")  # a row for each sector and month
    x = x.withColumns({"stage": F.coalesce("stage", F.lit("UNKNOWN")), "tradable": c("valuation_status") == "OK", "classification_confidence": F.lit(1.0)})
    return valuation.position_path(x.withColumn("risk_flags", valuation.risk_flags(x)), "stock", "as_of", carry=("gate", "stage", "risk_flags"))


def family_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured stocks (customers' numbers) beside the last month's values: most have no quote, every ninth no model, one sector no boards."""
    number = c("c_custkey")
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.lpad(number.cast("string"), 6, "0").alias("stock"), (number % 5 != 3).alias("resolved"), (number % 9 != 0).alias("modelled"))
    last = judged(spark, sf_dir).groupBy("stock").agg(F.max_by(F.struct("center", "model_weight_coverage", "valuation_confidence"), "as_of").alias("v"))
    x = wanted.join(last, "stock", "left")
    return x.select("stock", valuation.family_status(c("resolved"), c("v").isNotNull(), c("modelled"), c("v.center"), c("v.model_weight_coverage"), c("v.valuation_confidence")).alias("family_status"))


# the same in SQL ----------------------------------------------------------------------------------------------------

_STEPS = ("known", "based", "capped", "parts", "blended", "grown", "drawn", "fair")
_FROM_BASED = appraisal.FAIR[appraisal.FAIR.index("based as (") : appraisal.FAIR.index(",\nweights as (")]


def _own_steps() -> str:
    """The sectors' steps from growth to multiples, over stocks."""
    text = _FROM_BASED
    for name in _STEPS:
        text = text.replace(f"{name} as (", f"own_{name} as (").replace(f"from {name})", f"from own_{name})")
    return text


_SURE = appraisal._of_metric(
    f"case when pe_ttm_calc > 0 then coalesce(ttm_profit_confidence, 0) when ttm_profit is null and pb > 0 then {valuation.QUOTED_PE_CONFIDENCE}::double else 0 end", "least(coalesce(ttm_profit_confidence, 0), case when average_equity is not null then 0.9::double else 0.45 end)", "ttm_revenue_confidence", "ocf_sure"
)
_BASIS = "case metric when 'pe' then ttm_eps when 'pb' then bvps when 'ps' then sps_ttm end"
_CONFIG = appraisal.FAIR[appraisal.FAIR.index("config as (") : appraisal.FAIR.index(",\ngauged as (")]
_WEIGHTS = appraisal.FAIR[appraisal.FAIR.index("weights as (") :]
CENTERS = f"""{sql.MONTHS},
{_CONFIG},
{_WEIGHTS},
own_known as (select m.*, h.sector, k.* exclude (sector), ttm_roe_pct / 100 as roe, case when revenue_pri > 0 then revenue_cur / revenue_pri - 1 end as revenue_growth, case when net_profit_pri > 0 then net_profit_cur / net_profit_pri - 1 end as profit_growth,
              case when revenue_pri > 0 then (revenue_cur / revenue_pri - 1) * 100 end as rg, case when net_profit_pri > 0 then (net_profit_cur / net_profit_pri - 1) * 100 end as pg, case when ttm_revenue > 0 then ttm_profit / ttm_revenue end as net_margin,
              case when ttm_profit > 0 then 1.0 else 0.0 end as profitable_mcap_coverage, coalesce(net_profit_pri <= 0 and net_profit_cur > 0, false) as turnaround, case when pe_ttm_calc > 0 then pe_ttm_calc when ttm_profit is null and pb > 0 then 10 * pb end as pe,
              case when pe_ttm_calc > 0 then ttm_profit_method when ttm_profit is null and pb > 0 then 'QUOTE_PROVIDER_PE' else 'MISSING' end as pe_method,
              case when ttm_operating_cashflow / shares_outstanding is not null then least(ttm_operating_cashflow_confidence, 0.9) when ocfps_cur is not null then 0.35 else 0 end as ocf_sure
              from master m join (select lpad(s_suppkey::varchar, 6, '0') as stock, 'sector_' || n_regionkey as sector from supplier join nation on s_nationkey = n_nationkey) h using (stock) join config k using (sector)),
multiples as (select stock, as_of as date, 'pe' as metric, pe as v from own_known where pe > 0 union all select stock, as_of, 'pb', pb from own_known where pb > 0 union all select stock, as_of, 'ps', ps_ttm_calc from own_known where ps_ttm_calc > 0),
past_multiples as (select o.code || '#' || metric as code, date, v from own_known o join multiples m on m.stock = o.stock and m.date <= o.as_of),
{sql.statistics("past", "past_multiples")},
{_own_steps()},
own_lenses as (select o.code, o.sector, metric, weight, case metric when 'pe' then fair_pe when 'pb' then fair_pb when 'ps' then fair_ps end as anchor, {_BASIS} as basis, case when ttm_ocfps > 0 and target_ocf_yield > 0 then ttm_ocfps / target_ocf_yield end as cash_price,
               weight * greatest(0, least(1, coalesce({_SURE}, 0))) as sure, case when p.status = 'OK' then p.q[3] end as past_median, p.effective_points, coalesce(p.confidence, 0) as past_confidence
               from own_fair o join weights using (sector) left join past p on p.code = o.code || '#' || metric),
own_weighed as (select *, case when anchor > 0 and past_median > 0 then effective_points / (effective_points + 60) * past_confidence else 0 end as history_weight from own_lenses),
own_priced as (select *, case when metric = 'ocf_yield' then cash_price when basis > 0 and anchor > 0 then basis * exp((1 - history_weight) * ln(anchor) + history_weight * ln(coalesce(past_median, 1))) end as implied_price from own_weighed),
own_judged as (select *, case when not coalesce(implied_price > 0, false) then case when metric = 'ocf_yield' then 'missing_positive_ocf_or_target_yield' else 'missing_basis_or_independent_anchor' end when sure <= 0 then 'zero_data_confidence' else '' end as drop_reason from own_priced),
own_left as (select *, case when drop_reason = '' then sure else 0 end as weight_left from own_judged),
own_summed as (select code, sum(weight) as total, count(*) filter (weight_left > 0) as used, sum(weight_left) filter (weight_left > 0) as w, sum(weight_left * ln(implied_price)) filter (weight_left > 0) as l, sum(weight_left * ln(implied_price) * ln(implied_price)) filter (weight_left > 0) as q,
               coalesce(string_agg(upper(metric), ';' order by metric) filter (weight_left > 0), '') as models_used, coalesce(sum(weight_left * history_weight * past_confidence) / nullif(sum(weight_left), 0), 0) as history_confidence from own_left group by code),
centers as (select code, exp(l / w) as center, case when used = 1 then 0 else sqrt(greatest(0, q / w - (l / w) * (l / w))) end as disagreement, coalesce(w, 0) / total as model_weight_coverage, models_used, history_confidence from own_summed)"""


def _total(weights: tuple) -> str:
    return " + ".join(f"{w}::double * least(1, greatest(0, coalesce(part_{p}, 0)))" for p, w in zip(valuation.QUALITY_PARTS, weights, strict=True))


_QUALITY = "case model " + " ".join(f"when '{m}' then {_total(w)}" for m, w in valuation.QUALITY.items() if m) + f" else {_total(valuation.QUALITY[''])} end"
_KNOWN = "(revenue_growth is not null and profit_growth is not null)"
JUDGED = f"""{CENTERS},
market as (select as_of, max(quote_day) as today, count(revenue_cur) / count(*) as report_coverage from own_fair group by as_of),
parted as (select *, case when ttm_revenue_confidence is not null then (coalesce(ttm_profit_confidence, 0) + ttm_revenue_confidence) / 2 else coalesce(ttm_profit_confidence, 0) end as part_ttm, ((revenue_growth is not null)::int + (profit_growth is not null)::int) / 2 as part_growth,
           history_confidence as part_history, case when cash_conversion is not null then ocf_sure end as part_cashflow, 1.0 as part_sector, report_coverage as part_report_coverage, (540 - (today - strptime(period, '%Y%m%d')::date)) / 420 as part_financial_age,
           (10 - (today - quote_day)) / 7 as part_quote_age from own_fair join centers using (code) join market using (as_of)),
rated as (select *, {_QUALITY} as quality from parted),
judged_stocks as (select *, case when quality < 0.40 then 'NO_VALUATION' when quality < 0.60 then 'LOW' when quality < 0.80 then 'MEDIUM' else 'HIGH' end as valuation_confidence,
           case when quality >= 0.40 and center is not null and model_weight_coverage >= 0.70 then 'OK' when model_weight_coverage < 0.70 then 'LOW_MODEL_COVERAGE' else 'INSUFFICIENT_DATA' end as valuation_status,
           case model when 'utility' then case when profit_growth < -0.25 then 'watch' else 'pass' end when 'cyclical_growth' then case when not {_KNOWN} or coalesce(cash_conversion < 0, false) then 'fail' else 'pass' end
           else case when not {_KNOWN} or profit_growth < -0.10 or revenue_growth < -0.10 then 'fail' when profit_growth < case when model in ('growth_pe', 'quality_growth', 'early_growth_ps', 'innovation_drug') then 0.10 else 0.03 end then 'watch' else 'pass' end end as gate from rated)"""


def _banded(stage: str, joined: str = "") -> str:
    """``stage``: the expression of a stock's stage; ``joined``: what it is joined from."""
    return f"""residuals as (select stock, as_of, code, ln(price / center) as residual from judged_stocks where price > 0 and center > 0),
distances as (select j.code, r.as_of as date, r.residual as v from judged_stocks j join residuals r on r.stock = j.stock and r.as_of < j.as_of),
{sql.statistics("res", "distances")},
placed as (select d.code, avg((d.v <= residual)::int) as place from distances d join residuals using (code) group by d.code),
posed as (select j.* exclude (status), center as median, coalesce(r.status, 'MISSING') as status, ln(price / center) as residual, case when r.status = 'OK' then place end as valuation_quantile, case when r.status = 'OK' and 1.4826::double * mad > 1e-12 then (ln(price / center) - q[3]) / (1.4826::double * mad) end as robust_z,
          {", ".join(f"exp(q[{n}]) * center as {name}" for n, name in enumerate(("q10", "q25", "q50", "q75", "q90"), 1))}, case when model = 'cyclical_growth' then 0.05::double else 0 end as cycle_penalty, {stage} as stage, valuation_status <> 'OK' or price is null as stopped, null::int as previous
          from (select *, null as status from judged_stocks) j left join res r using (code) left join placed using (code){joined}),
{_all_stages(policy.steps())}"""


def _all_stages(text: str) -> str:
    """The policy's steps for every stage: those that confirm a purchase, and all others like an unknown one."""
    confirmed = "stage in ('Seed', 'Ignition', 'Mainline', 'Diffusion')"
    text = text.replace("cheap and stage = 'UNKNOWN'", f"cheap and not {confirmed}")
    return text.replace("case stage when 'Seed' then 'BUILD_POSITION' when 'Mainline' then 'ADD_OR_HOLD'", f"case when stage in ('Seed', 'Ignition') then 'BUILD_POSITION' when {confirmed} then 'ADD_OR_HOLD'")


BANDED = f"{JUDGED},\n{_banded(chr(39) + 'UNKNOWN' + chr(39))}"
POSITIONS = f"""{JUDGED},
{relations.MONTH_STAGES},
{_banded('coalesce(s.stage, ' + chr(39) + 'UNKNOWN' + chr(39) + ')', ' left join month_stages s using (sector, as_of)')},
lined as (select *, row_number() over (partition by stock order by as_of) as n, not stopped and gate = 'pass' and stage <> 'Decay' and status = 'OK' and price > buy_price and price <= buy_exit_price as may_keep from policy),
held as (select stock, n, null::int as previous, target_position::int as target, false as kept, case when not stopped then target_position::int end as last_target from lined where n = 1
         union all select l.stock, l.n, h.last_target, case when coalesce(may_keep and h.last_target >= 70 and base < h.last_target, false) then h.last_target else target_position::int end, coalesce(may_keep and h.last_target >= 70 and base < h.last_target, false),
         case when stopped then h.last_target when coalesce(may_keep and h.last_target >= 70 and base < h.last_target, false) then h.last_target else target_position::int end from held h join lined l on l.stock = h.stock and l.n = h.n + 1),
walked as (select l.* exclude (target, previous), h.previous, h.target, case when h.kept then 'HOLD_HYSTERESIS' else action end as last_action from lined l join held h using (stock, n))"""
_FLAGS = f"""concat_ws(';', case when status <> 'OK' then 'RESIDUAL_HISTORY_INSUFFICIENT' end, case when center > 0 and status <> 'OK' then 'MODEL_PRIOR_BANDS' end, case when stage = 'UNKNOWN' then 'MAINLINE_UNKNOWN' end, case when model_weight_coverage < 0.70 then 'LOW_MODEL_COVERAGE' end,
 case when growth_regime <> 'NORMAL' then growth_regime end, case when floor_hit then 'FAIR_PE_FLOOR_HIT' end, case when cap_hit then 'FAIR_PE_CAP_HIT' end, case when not {_KNOWN} and model <> 'utility' then 'GROWTH_DATA_MISSING' end)"""

_LENS = ["weight", "history_weight", "implied_price", "weight_left"]
_CENTER = ["center", "disagreement", "model_weight_coverage", "history_confidence", "pe", "quality"]
_WORDS = ["sector", "model", "pe_method", "models_used", "valuation_confidence", "valuation_status", "gate"]
_BANDS = ["residual", "valuation_quantile", "robust_z", "margin", "sigma", "fair_low", "fair_high", "deep_buy_price", "buy_price", "buy_exit_price", "trim_price", "exit_price"]
_SOURCE = "case when center > 0 then trade_band_source else 'NONE' end as trade_band_source"
_DAY = ["stock", "as_of::varchar as as_of"]
_TARGETS = ["previous_target", "target_position"]


def _shown_lenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lenses(spark, sf_dir, stocks(spark, sf_dir)).select("code", F.explode("lenses").alias("lens"))
    return of.filter("lens is not null").select("code", "lens.*").withColumnRenamed("left", "weight_left")


#: Name, plan, columns and SQL of each query.
ENTRIES = [
    ("stock_history_lens", _shown_lenses, ["code", "metric", "drop_reason", *_LENS], sql.query(CENTERS, "own_left", sql.listed(_LENS, ["code", "metric", "drop_reason"]))),
    ("stock_valuation", judged, ["stock", "as_of", *_WORDS, *_CENTER], sql.query(JUDGED, "judged_stocks", sql.listed(_CENTER, [*_DAY, *_WORDS]))),
    ("stock_bands", banded, ["stock", "as_of", "res_status", "trade_band_source", *_BANDS], sql.query(BANDED, "bands", sql.listed(_BANDS, [*_DAY, "status as res_status", _SOURCE]))),
    ("stock_position", positions, ["stock", "as_of", "gate", "stage", "action", *_TARGETS, "risk_flags"], sql.query(POSITIONS, "walked", f"stock, as_of::varchar as as_of, gate, stage, last_action as action, previous::bigint as previous_target, target::bigint as target_position, {_FLAGS} as risk_flags").replace("with ", "with recursive ", 1)),
    ("family_status", family_statuses, ["stock", "family_status"], sql.query(f"{JUDGED},\nlast_values as (select * from judged_stocks qualify row_number() over (partition by stock order by as_of desc) = 1)", "customer left join last_values on stock = lpad(c_custkey::varchar, 6, '0')", "lpad(c_custkey::varchar, 6, '0') as stock, case when c_custkey % 5 = 3 then 'BOARD_RESOLUTION_FAILED' when last_values.stock is null then 'DATA_UNAVAILABLE' when c_custkey % 9 = 0 then 'MODEL_UNRESOLVED' else valuation_status end as family_status")),
]
