"""Fair values by several lenses, in long form: one row for each entity and metric, then weighted together.

A lens needs an anchor of its own from fundamentals; history may only draw it, never make it. Nothing loops over
entities: sectors or stocks, a handful or millions, are rows of one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.expr import clipped, first_label, holds
from tidegauge.operators import history

METRICS = ("pe", "pb", "ps", "ocf_yield")
GROWTH_FAMILIES = ("growth_pe", "cyclical_growth", "quality_growth", "mature_consumer", "materials_mature", "commodity_cycle")
# Each family's weights where a sector configures none.
DEFAULT_WEIGHTS = {
    "utility": {"pb": 0.60, "ocf_yield": 0.40},
    "mature_consumer": {"ocf_yield": 0.40, "pe": 0.35, "pb": 0.25},
    "materials_mature": {"ocf_yield": 0.35, "pe": 0.35, "pb": 0.30},
    "commodity_cycle": {"pb": 0.45, "ocf_yield": 0.30, "pe": 0.25},
    "quality_growth": {"pe": 0.50, "ocf_yield": 0.30, "ps": 0.20},
    "cyclical_growth": {"pe": 0.40, "pb": 0.30, "ps": 0.30},
    "innovation_drug": {"ps": 1.0},
    "early_growth_ps": {"ps": 1.0},
    "growth_pe": {"pe": 0.70, "ps": 0.30},
}
# The parts of the data-quality score by family.
QUALITY_PARTS = ("ttm", "growth", "history", "cashflow", "sector", "report_coverage", "financial_age", "quote_age")
QUALITY = {
    "utility": (0.22, 0.08, 0.08, 0.22, 0.10, 0.10, 0.10, 0.10),
    "innovation_drug": (0.18, 0.22, 0.08, 0.08, 0.14, 0.10, 0.10, 0.10),
    "early_growth_ps": (0.18, 0.22, 0.08, 0.08, 0.14, 0.10, 0.10, 0.10),
    "commodity_cycle": (0.20, 0.10, 0.12, 0.18, 0.10, 0.10, 0.10, 0.10),
    "": (0.24, 0.16, 0.10, 0.12, 0.10, 0.10, 0.09, 0.09),
}
# Fixed value: how far a quoted price to earnings is believed.
QUOTED_PE_CONFIDENCE = 0.30
# The caps of a position by price zone while a sector decays.
DECAY_CAPS = {"deep_value": 20, "value": 20, "fair": 20, "dear": 10, "extreme": 0}


def growth(rows: DataFrame, least_coverage: float = 0.0) -> DataFrame:
    """Growth in percent as far as its coverage holds, capped against revenue, blended by regime and bounded."""
    c = F.col
    revenue = F.when(c("revenue_growth_coverage") >= least_coverage, c("revenue_growth") * 100)
    profit = F.when(c("profit_growth_coverage") >= least_coverage, c("profit_growth") * 100)
    x = rows.withColumn("raw_revenue_growth_pct", revenue).withColumn("raw_profit_growth_pct", profit)
    rg, pg = c("raw_revenue_growth_pct"), c("raw_profit_growth_pct")
    low = c("turnaround") | holds(F.abs(pg) >= 200)
    capped = F.when(pg.isNotNull() & rg.isNotNull(), F.least(pg, rg + c("profit_growth_premium_cap_pct"))).otherwise(pg)
    capped = F.when(low & capped.isNotNull(), F.least(capped, F.greatest(F.coalesce(rg, F.lit(0.0)), F.lit(0.0)) + 10)).otherwise(capped)
    x = x.withColumn("low_base", low).withColumn("adjusted_profit_pct", capped)
    p, r = clipped(c("adjusted_profit_pct"), -30, 80), clipped(rg, -30, 60)
    blend = F.when(c("low_base"), 0.35 * p + 0.65 * r).otherwise(0.65 * p + 0.35 * r)
    x = x.withColumn("normalized_growth_pct", F.coalesce(blend, p, r))
    used = F.when(c("normalized_growth_pct").isNotNull(), F.greatest(c("growth_floor_pct"), F.least(c("growth_cap_pct"), c("normalized_growth_pct"))))
    regime = F.when(c("normalized_growth_pct").isNull(), "MISSING").when(c("turnaround"), "TURNAROUND").when(c("low_base"), "LOW_BASE").otherwise("NORMAL")
    return x.withColumn("growth_used_pct", used).withColumn("growth_regime", regime)


def simple_growth(profit: Column, revenue: Column, premium_cap: Column | None = None) -> Column:
    """Growth in percent without regimes: profit's, no more than ``premium_cap`` above revenue's, with a third of revenue's; either alone where the other is missing."""
    most = F.lit(None) if premium_cap is None else revenue + premium_cap
    p, r = clipped(F.when(profit > most, most).otherwise(profit), -30, 80), clipped(revenue, -30, 60)
    return F.coalesce(0.65 * p + 0.35 * r, p, r)


def fair_multiples(rows: DataFrame, least_coverage: float = 0.0) -> DataFrame:
    """``rows``: aggregates of an entity beside its configuration. Adds fair_pe, fair_ps, fair_pb and the bounds hit."""
    c = F.col
    x = growth(rows, least_coverage)
    grows, within = c("model").isin(*GROWTH_FAMILIES), lambda v, name: F.when(v.isNotNull(), F.greatest(c(f"fair_{name}_floor"), F.least(c(f"fair_{name}_cap"), v)))
    discount = F.when(c("model").isin("cyclical_growth", "commodity_cycle"), c("cycle_discount")).otherwise(1.0)
    cash = F.when(c("model").isin("quality_growth", "mature_consumer", "materials_mature") & c("cash_conversion").isNotNull(), clipped(0.85 + 0.15 * c("cash_conversion"), 0.80, 1.10)).otherwise(1.0)
    anchored = grows & c("raw_revenue_growth_pct").isNotNull() & c("raw_profit_growth_pct").isNotNull()
    x = x.withColumn("raw_fair_pe", F.when(anchored, c("target_peg") * c("growth_used_pct") * discount * cash))
    rg, roe = c("raw_revenue_growth_pct"), c("roe_ttm_pct") / 100
    ps = c("base_ps") + F.greatest(rg, F.lit(0.0)) * c("revenue_growth_ps_slope") + F.coalesce((c("net_margin") - c("reference_net_margin")) * c("margin_ps_slope"), F.lit(0.0))
    bonus = F.when(holds((c("model") == "innovation_drug") & (c("profit_growth") > 0) & (c("profitable_mcap_coverage") > 0.6)), c("profitable_ps_bonus")).otherwise(0.0)
    early = c("base_ps") + F.greatest(clipped(rg, -10, 50), F.lit(0.0)) * c("revenue_growth_ps_slope") + bonus
    pb = c("base_pb") + F.greatest(roe - c("reference_roe"), F.lit(-0.05)) * c("roe_pb_slope")
    gordon = (roe - c("terminal_growth")) / (c("required_return") - c("terminal_growth"))
    return x.withColumns({
        "fair_pe": within(c("raw_fair_pe"), "pe"),
        "floor_hit": holds(c("raw_fair_pe") <= c("fair_pe_floor")),
        "cap_hit": holds(c("raw_fair_pe") >= c("fair_pe_cap")),
        "fair_ps": F.when(rg.isNotNull(), within(F.when(grows, ps).when(c("model").isin("innovation_drug", "early_growth_ps"), early), "ps")),
        "fair_pb": F.when(roe.isNotNull(), within(F.when(grows, pb).when((c("model") == "utility") & (roe > c("terminal_growth")) & (c("required_return") > c("terminal_growth")), gordon), "pb")),
    })


def model_weights(configured: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(sector, metric, weight): a sector's own weights, else its family's."""
    cases = [F.when(F.col("model") == family, F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(w).alias("weight")) for m, w in weights.items()])) for family, weights in DEFAULT_WEIGHTS.items()]
    default = configured.select("sector", F.explode(F.coalesce(*cases)).alias("w")).select("sector", "w.metric", "w.weight")
    if own is None:
        return default
    return own.unionByName(default.join(own.select("sector").distinct(), "sector", "left_anti"))


def bootstrap_weight(as_of: Column, started: Column, days: int = 180, most: float = 0.30) -> Column:
    age = F.greatest(F.lit(0), F.datediff(as_of, started))
    return F.when(started.isNull() | (age > days), 0.0).otherwise(most * F.greatest(F.lit(0.10), 1 - age / float(days)))


def centered(lenses: DataFrame, entity: list[str], value: str, weight: str) -> DataFrame:
    """Weighted geometric mean of the lenses' positive values and their spread in logarithms."""
    good = holds((F.col(value) > 0) & (F.col(weight) > 0))
    w, ln = F.when(good, F.col(weight)), F.when(good, F.log(value))
    sums = lenses.groupBy(*entity).agg(F.sum(w).alias("effective_weight"), F.sum(F.col("weight")).alias("total_weight"), F.sum(w * ln).alias("_l"), F.sum(w * ln * ln).alias("_q"), F.count(w).alias("_n"), F.array_join(F.array_sort(F.collect_list(F.when(good, F.upper("metric")))), ";").alias("models_used"))
    mean = F.col("_l") / F.col("effective_weight")
    spread = F.when(F.col("_n") == 1, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("effective_weight") - mean * mean)))  # one value agrees with itself, without rounding
    return sums.withColumn("center", F.exp(mean)).withColumn("disagreement", spread).withColumn("model_weight_coverage", F.coalesce("effective_weight", F.lit(0.0)) / F.col("total_weight")).drop("_l", "_q", "_n")


def sector_lenses(rows: DataFrame, weights: DataFrame, least_coverage: float = 0.70, past: DataFrame | None = None, kappa: float = 60.0) -> DataFrame:
    """A row for each sector and weighted metric: the ratio of its value to the fair one, the weight left, why it drops.

    ``past`` (sector, metric, status, median, effective_points, confidence): the sector's own history. Where it is sound, it draws the model's
    value; where it isn't, the sector's bootstrap value does (bootstrap_metric, bootstrap_fair, bootstrap_weight of ``rows``); neither makes one."""
    c = F.col
    pick = lambda pattern, ocf: F.coalesce(*[F.when(c("metric") == m, c(pattern.format(m))) for m in ("pe", "pb", "ps")], F.when(c("metric") == "ocf_yield", ocf))
    x = rows.join(weights, "sector")
    x = x.withColumns({"current": pick("{}", c("ocf_yield")), "coverage": pick("{}_mcap_coverage", c("ocf_mcap_coverage")), "confidence": pick("{}_metric_confidence", c("ocf_metric_confidence")), "model_fair": pick("fair_{}", c("target_ocf_yield"))})
    usable, anchored = holds((c("current") > 0) & (c("coverage") >= least_coverage)), holds(c("model_fair") > 0)
    x = x.withColumns({"fair": c("model_fair"), "history_weight": F.lit(0.0)})
    if past is not None:
        x = x.join(past.select("sector", "metric", c("status").alias("_status"), c("median").alias("_median"), c("effective_points").alias("_points"), c("confidence").alias("_sure")), ["sector", "metric"], "left")
        drawn, weight = history.shrunk(c("model_fair"), c("_status"), c("_median"), c("_points"), c("_sure"), kappa)
        multiple = anchored & (c("metric") != "ocf_yield")
        known = multiple & holds(c("_status") == "OK")
        started = multiple & ~known & holds((c("metric") == c("bootstrap_metric")) & (c("bootstrap_fair") > 0) & (c("bootstrap_weight") > 0))
        blend = F.exp((1 - c("bootstrap_weight")) * F.log("model_fair") + c("bootstrap_weight") * F.log("bootstrap_fair"))
        x = x.withColumns({"fair": F.when(known, drawn).when(started, blend).otherwise(c("model_fair")), "history_weight": F.when(known, weight).when(started, c("bootstrap_weight")).otherwise(0.0)})
    left = c("weight") * clipped(F.coalesce("confidence", F.lit(0.0)), 0, 1)
    value = F.when(c("metric") == "ocf_yield", c("fair") / c("current")).otherwise(c("current") / c("fair"))
    drop = first_label([(~usable, "invalid_current_or_coverage"), (~anchored, "missing_independent_fair_anchor"), (left <= 0, "missing_confidence")], "")
    return x.select("sector", "metric", "weight", "current", "fair", "history_weight", F.when(drop == "", value).alias("ratio"), F.when(drop == "", left).otherwise(0.0).alias("left"), drop.alias("drop_reason"))


def label(deviation: Column) -> Column:
    return first_label([(deviation.isNull(), "unknown"), (deviation <= -0.25, "undervalued"), (deviation <= -0.10, "slightly_low"), (deviation < 0.15, "fair"), (deviation < 0.35, "high"), (deviation < 0.70, "overvalued")], "extreme")


def status(center: Column, coverage: Column, required: float = 0.70) -> Column:
    return F.when(coverage < required, "LOW_MODEL_COVERAGE").when(center.isNull(), "INSUFFICIENT_DATA").otherwise("OK")


def sector_values(lenses: DataFrame) -> DataFrame:
    out = centered(lenses, ["sector"], "ratio", "left")
    deviation = F.col("center") - 1
    return out.select("sector", "center", "disagreement", "model_weight_coverage", "models_used", deviation.alias("multiple_deviation"), label(deviation).alias("valuation_label"), status(F.col("center"), F.col("model_weight_coverage")).alias("valuation_status"))


def stock_lenses(stocks: DataFrame, weights: DataFrame) -> DataFrame:
    """``stocks``: master rows of a sector beside its fair multiples. A row for each stock and metric with the price implied."""
    c = F.col
    x = stocks.join(weights, "sector")
    basis = F.coalesce(F.when(c("metric") == "pe", c("ttm_eps")), F.when(c("metric") == "pb", c("bvps")), F.when(c("metric") == "ps", c("sps_ttm")))
    fair = F.coalesce(*[F.when(c("metric") == m, c(f"fair_{m}")) for m in ("pe", "pb", "ps")])
    price = F.when(c("metric") == "ocf_yield", F.when((c("ttm_ocfps") > 0) & (c("target_ocf_yield") > 0), c("ttm_ocfps") / c("target_ocf_yield"))).otherwise(F.when(basis > 0, basis * fair))
    confidence = F.coalesce(F.when(c("metric") == "pe", c("ttm_eps_confidence")), F.when(c("metric") == "pb", c("ttm_roe_confidence")), F.when(c("metric") == "ps", c("ttm_revenue_confidence")), F.when(c("metric") == "ocf_yield", c("ttm_ocfps_confidence")), F.lit(0.0))
    left = c("weight") * clipped(confidence, 0, 1)
    drop = first_label([(~holds(price > 0), "missing_basis_or_independent_anchor"), (left <= 0, "zero_data_confidence")], "")
    return x.select("code", "sector", "metric", "weight", price.alias("implied_price"), F.when(drop == "", left).otherwise(0.0).alias("left"), drop.alias("drop_reason"))


def quality(parts: dict[str, Column], family: Column, name_match: Column) -> Column:
    def total(weights: tuple) -> Column:
        terms = [w * clipped(F.coalesce(parts[p], F.lit(0.0)), 0, 1) for p, w in zip(QUALITY_PARTS, weights, strict=True)]
        return sum(terms[1:], terms[0])

    score = total(QUALITY[""])
    for name, weights in QUALITY.items():
        if name:
            score = F.when(family == name, total(weights)).otherwise(score)
    return F.greatest(F.lit(0.0), score - F.when(name_match, 0.0).otherwise(0.05))


def confidence_label(score: Column) -> Column:
    return first_label([(score.isNull() | (score < 0.40), "NO_VALUATION"), (score < 0.60, "LOW"), (score < 0.80, "MEDIUM")], "HIGH")


def interval(rows: DataFrame) -> DataFrame:
    """Margin of safety, total uncertainty and fair range, from center, disagreement, quality and the sector's own terms."""
    c, doubt = F.col, 1 - F.col("quality")
    margin = clipped(c("base_margin") + 0.35 * F.coalesce("disagreement", F.lit(0.12)) + 0.18 * doubt + c("cycle_penalty"), 0.10, 0.45)
    spread = F.coalesce("disagreement", c("base_uncertainty"))
    sigma = F.when(c("center") > 0, F.sqrt(spread * spread + c("base_uncertainty") * c("base_uncertainty") + (0.25 * doubt) * (0.25 * doubt)))
    x = rows.withColumn("margin", margin).withColumn("sigma", sigma)
    return x.withColumn("fair_low", c("center") * F.exp(-c("sigma"))).withColumn("fair_high", c("center") * F.exp(c("sigma")))


def trade_bands(rows: DataFrame) -> DataFrame:
    """Five prices in order, from the residuals' history where its status is OK (res_status, res_q10 ...), else the prior."""
    c = F.col
    known = c("res_status") == "OK"
    scale = F.greatest(F.coalesce("sigma", F.lit(0.20)), F.lit(0.08))
    prior = {"q10": -1.2816, "q25": -0.6745, "q35": -0.3853, "q75": 0.6745, "q90": 1.2816}
    q35 = c("res_q25") + 0.40 * (c("res_q50") - c("res_q25"))
    q = {k: F.when(known, q35 if k == "q35" else c(f"res_{k}")).otherwise(z * scale) for k, z in prior.items()}
    at = lambda k: c("center") * F.exp(q[k])
    x = rows.withColumn("trade_band_source", F.when(~holds(c("center") > 0), "NONE").when(known, "RESIDUAL_QUANTILES").otherwise("MODEL_PRIOR_BANDS")).withColumn("_safety", F.least("fair_low", c("center") * (1 - c("margin"))))
    x = x.withColumns({"_deep": F.least(at("q10"), 0.92 * c("_safety")), "buy_price": F.least(at("q25"), c("_safety")), "_trim": F.greatest(at("q75"), 1.02 * c("center")), "_out": at("q90"), "_back": at("q35")})
    x = x.withColumns({"_out": F.greatest("_out", 1.02 * c("_trim")), "_back": F.greatest(1.02 * c("buy_price"), "_back"), "deep_buy_price": F.least("_deep", 0.98 * c("buy_price")), "trim_price": F.greatest("_trim", 1.02 * c("buy_price"))})
    return x.withColumns({"buy_exit_price": F.least(F.greatest("_back", 1.02 * c("buy_price")), 0.98 * c("trim_price")), "exit_price": F.greatest("_out", 1.02 * c("trim_price"))}).drop("_safety", "_deep", "_trim", "_out", "_back")


def growth_gate(model: Column, revenue: Column, profit: Column, cash: Column) -> Column:
    known = revenue.isNotNull() & profit.isNotNull()
    threshold = F.when(model.isin("growth_pe", "quality_growth", "early_growth_ps", "innovation_drug"), 0.10).otherwise(0.03)
    utility = F.when(holds(profit < -0.25), "watch").otherwise("pass")
    cyclical = F.when(~known | holds(cash < 0), "fail").otherwise("pass")
    other = F.when(~known | holds(profit < -0.10) | holds(revenue < -0.10), "fail").when(profit < threshold, "watch").otherwise("pass")
    return F.when(model == "utility", utility).when(model == "cyclical_growth", cyclical).otherwise(other)


def position(rows: DataFrame, failed_cap: int = 0, watch_scale: float = 0.60, prior_cap: int = 30) -> DataFrame:
    """target_position and action from price, bands, gate, stage, tradable and previous_target."""
    c = F.col
    price = c("price")
    rules = [(price <= c("deep_buy_price"), "deep_value", 100), (price <= c("buy_price"), "value", 70), (price < c("trim_price"), "fair", 40), (price < c("exit_price"), "dear", 15)]
    zone = first_label([(r, n) for r, n, _ in rules], "extreme")
    base = F.coalesce(*[F.when(zone == n, t) for _, n, t in rules], F.lit(0))
    x = rows.withColumn("zone", zone).withColumn("_base", base)
    prior = c("trade_band_source") == "MODEL_PRIOR_BANDS"
    keeps = holds((c("gate") == "pass") & (c("stage") != "Decay") & ~prior & (c("previous_target") >= 70) & (price > c("buy_price")) & (price <= c("buy_exit_price")) & (c("_base") < c("previous_target")))
    after = F.when(c("gate") == "watch", 5 * F.bround(c("_base") * watch_scale / 5)).otherwise(c("_base"))
    after = F.when(prior, F.least(after, F.lit(prior_cap))).otherwise(after)
    decayed = F.least(after, F.coalesce(*[F.when(c("zone") == z, cap) for z, cap in DECAY_CAPS.items()], F.lit(0)))
    decay, cheap = c("stage") == "Decay", c("zone").isin("deep_value", "value")
    confirmed = c("stage").isin("Seed", "Ignition", "Mainline", "Diffusion")
    stopped = ~holds(c("tradable")) | price.isNull()
    target = F.when(stopped, 0).when(keeps, c("previous_target")).when(c("gate") == "fail", F.least(c("_base"), F.lit(failed_cap))).when(decay, decayed).when(cheap & ~confirmed, F.least(after, F.lit(30))).when(c("zone") == "extreme", 0).otherwise(after)
    action = (
        F.when(stopped, "NO_TRADE").when(keeps, "HOLD_HYSTERESIS").when(c("gate") == "fail", "NO_TRADE" if failed_cap <= 0 else "WATCH_ONLY").when(decay, F.when(decayed <= 0, "EXIT_PRIORITY").otherwise("TRIM_OR_WAIT"))
        .when(cheap, F.when(c("stage").isin("Seed", "Ignition"), "BUILD_POSITION").when(confirmed, "ADD_OR_HOLD").otherwise("WAIT_MAINLINE_CONFIRMATION")).when(c("zone") == "fair", "HOLD_OR_WAIT").when(c("zone") == "dear", "TRIM").otherwise("AVOID_OR_EXIT")
    )
    sized = F.when((target > 0) & (action != "HOLD_HYSTERESIS"), 5 * F.bround(target * F.when(c("sigma") > 0, clipped(0.22 / c("sigma"), 0.50, 1.00)).otherwise(0.50) / 5)).otherwise(target)
    return x.withColumn("action", action).withColumn("target_position", sized.cast("int")).drop("_base")


def position_path(rows: DataFrame, entity: str, order: str, failed_cap: int = 0, watch_scale: float = 0.60, prior_cap: int = 30, carry: Sequence[str] = ()) -> DataFrame:
    """(entity, order, previous_target, target_position, action): as ``position``, in order, each from the target before it, with the columns ``carry`` of the rows.

    All but the hysteresis is decided row by row. An entity's steps, of five small values each, are then folded in order: a target of 70
    or more stays while the price has not left the band. As only tradable rows are stored, the others pass the target before them on."""
    c = F.col
    free = position(rows.withColumn("previous_target", F.lit(None).cast("int")), failed_cap, watch_scale, prior_cap)
    base = F.coalesce(*[F.when(c("zone") == z, t) for z, t in (("deep_value", 100), ("value", 70), ("fair", 40), ("dear", 15))], F.lit(0))
    may_keep = holds(c("tradable") & (c("gate") == "pass") & (c("stage") != "Decay") & (c("trade_band_source") != "MODEL_PRIOR_BANDS") & (c("price") > c("buy_price")) & (c("price") <= c("buy_exit_price")))
    stored = holds(c("tradable")) & c("price").isNotNull()
    step = F.struct(c(order).alias("at"), may_keep.alias("may_keep"), base.alias("base"), stored.alias("stored"), c("target_position").alias("free"), "action", F.struct(F.lit(0).alias("_"), *carry).alias("own"))
    none = F.lit(None).cast("int")

    def walk(done: Column, x: Column) -> Column:
        previous = done["last"]
        keeps = F.coalesce(x["may_keep"] & (previous >= 70) & (x["base"] < previous), F.lit(False))
        target = F.when(keeps, previous).otherwise(x["free"])
        here = F.struct(x["at"].alias("at"), previous.alias("previous_target"), target.alias("target_position"), F.when(keeps, "HOLD_HYSTERESIS").otherwise(x["action"]).alias("action"), x["own"].alias("own"))
        return F.struct(F.when(x["stored"], target).otherwise(previous).alias("last"), F.concat(done["path"], F.array(here)).alias("path"))

    kinds = dict(free.dtypes)
    own = "".join(f",{name}:{kinds[name]}" for name in carry)
    start = F.struct(none.alias("last"), F.array().cast(f"array<struct<at:{kinds[order]},previous_target:int,target_position:int,action:string,own:struct<_:int{own}>>>").alias("path"))
    paths = free.groupBy(entity).agg(F.array_sort(F.collect_list(step)).alias("steps")).select(entity, F.explode(F.aggregate("steps", start, walk, lambda done: done["path"])).alias("p"))
    return paths.select(entity, c("p.at").alias(order), "p.previous_target", "p.target_position", "p.action", *[c(f"p.own.{name}") for name in carry])


def risk_flags(rows: DataFrame) -> Column:
    c = F.col
    flags = [
        (holds(c("res_status") != "OK"), "RESIDUAL_HISTORY_INSUFFICIENT"), (c("trade_band_source") == "MODEL_PRIOR_BANDS", "MODEL_PRIOR_BANDS"), (c("stage") == "UNKNOWN", "MAINLINE_UNKNOWN"), (c("model_weight_coverage") < 0.70, "LOW_MODEL_COVERAGE"),
        (c("growth_regime") != "NORMAL", c("growth_regime")), (c("floor_hit"), "FAIR_PE_FLOOR_HIT"), (c("cap_hit"), "FAIR_PE_CAP_HIT"), (c("classification_confidence") < 0.60, "SECTOR_LOW_CONFIDENCE"),
        (~(c("revenue_growth").isNotNull() & c("profit_growth").isNotNull()) & (c("model") != "utility"), "GROWTH_DATA_MISSING"),
    ]
    return F.concat_ws(";", *[F.when(holds(rule), name) for rule, name in flags])


def infer_sectors(hits: DataFrame, least: float = 0.60, codes: DataFrame | None = None) -> DataFrame:
    """``hits`` (code, sector, board_hits, boards, priority): the best sector of each code, unless it is ambiguous. Of ``codes``, where
    given, those without any candidate are rows too: unresolved, with no confidence."""
    scored = hits.withColumn("score", F.least(F.lit(1.0), F.col("board_hits") / F.greatest(F.lit(1), F.col("boards"))))
    ranked = scored.groupBy("code").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), (-F.col("board_hits")).alias("h"), "priority", "sector"))).alias("c"))
    top, runner = -F.col("c")[0]["s"], F.when(F.size("c") > 1, -F.get("c", F.lit(1))["s"])
    confidence = F.least(F.lit(1.0), 0.55 * top + 0.45 * F.greatest(F.lit(0.0), top - F.coalesce(runner, F.lit(0.0))))
    clear = (confidence >= least) & ~holds(F.abs(top - runner) < 0.20)
    found = ranked.select("code", F.when(clear, F.col("c")[0]["sector"]).otherwise("MODEL_REVIEW_REQUIRED").alias("sector"), F.col("c")[0]["sector"].alias("suggested_sector"), F.when(clear, "OK").otherwise("MODEL_REVIEW_REQUIRED").alias("classification_status"), confidence.alias("classification_confidence"), F.size("c").alias("candidates"))
    if codes is None:
        return found
    none = {"sector": "MODEL_UNRESOLVED", "classification_status": "MODEL_UNRESOLVED", "classification_confidence": 0.0, "candidates": 0}
    return codes.select("code").distinct().join(found, "code", "left").fillna(none)


def family_status(resolved: Column, quoted: Column, modelled: Column, center: Column, coverage: Column, confidence: Column, required: float = 0.70) -> Column:
    """What became of an entity's valuation, the first that holds: its boards are not found, it has no quote, no model, too little of its
    model's weight, no center or no confidence in it, or all is well."""
    valued = holds(center.isNotNull() & (confidence != "NO_VALUATION") & (coverage >= required))
    return first_label([(~holds(resolved), "BOARD_RESOLUTION_FAILED"), (~holds(quoted), "DATA_UNAVAILABLE"), (~holds(modelled), "MODEL_UNRESOLVED"), (valued, "OK"), (coverage < required, "LOW_MODEL_COVERAGE")], "INSUFFICIENT_DATA")


def wide(lenses: DataFrame, entity: str) -> DataFrame:
    """One row for each entity with a weight, what is left of it and the reason it dropped, for each metric."""
    out = lenses.groupBy(entity).pivot("metric", list(METRICS)).agg(F.first("weight").alias("configured_weight"), F.first("left").alias("effective_weight"), F.first("drop_reason").alias("drop_reason"))
    return out.select(entity, *[F.col(f"{m}_{k}").alias(f"{k}_{m}") for m in METRICS for k in ("configured_weight", "effective_weight", "drop_reason")])


def stock_anchors(stocks: DataFrame) -> DataFrame:
    """``stocks``: master rows beside a family and its terms. Each stock's own growth and margin, and the multiples they make."""
    c = F.col
    return fair_multiples(stocks.withColumns({
        "revenue_growth": F.when(c("revenue_pri") > 0, c("revenue_cur") / c("revenue_pri") - 1),
        "profit_growth": F.when(c("net_profit_pri") > 0, c("net_profit_cur") / c("net_profit_pri") - 1),
        "revenue_growth_coverage": F.lit(1.0),
        "profit_growth_coverage": F.lit(1.0),
        "net_margin": F.when(c("ttm_revenue") > 0, c("ttm_profit") / c("ttm_revenue")),
        "profitable_mcap_coverage": F.when(c("ttm_profit") > 0, 1.0).otherwise(0.0),
        "turnaround": holds((c("net_profit_pri") <= 0) & (c("net_profit_cur") > 0)),
        "roe_ttm_pct": c("ttm_roe_pct"),
    }))


def current_pe(rows: DataFrame) -> DataFrame:
    """The calculated multiple; the quote's only where the profit is missing, never where it is a loss."""
    c = F.col
    own, quoted = holds(c("pe_ttm_calc") > 0), c("ttm_profit").isNull() & holds(c("pe_dynamic") > 0)
    return rows.withColumns({
        "pe": F.when(own, c("pe_ttm_calc")).when(quoted, c("pe_dynamic")),
        "pe_method": F.when(own, c("ttm_profit_method")).when(quoted, "QUOTE_PROVIDER_PE").otherwise("MISSING"),
        "pe_confidence": F.when(own, F.coalesce("ttm_profit_confidence", F.lit(0.0))).when(quoted, QUOTED_PE_CONFIDENCE).otherwise(0.0),
    })


def anchored_lenses(stocks: DataFrame, weights: DataFrame, kappa: float = 60.0) -> DataFrame:
    """``stocks`` with ``lenses``: as ``stock_lenses``, of each stock's own multiples drawn to their past, a struct for each of ``METRICS``, NULL where it
    has no weight. past_pe, past_pb and past_ps, as of ``history.with_past``, stand in the rows. History draws an anchor, it never makes one; cash-flow yields have no history."""
    c = F.col
    sure = {"pe": c("pe_confidence"), "pb": c("ttm_roe_confidence"), "ps": c("ttm_revenue_confidence"), "ocf_yield": c("ttm_ocfps_confidence")}
    basis = {"pe": c("ttm_eps"), "pb": c("bvps"), "ps": c("sps_ttm")}
    by_sector = weights.groupBy("sector").agg(F.map_from_entries(F.collect_list(F.struct("metric", "weight"))).alias("_weights"))
    x, out = stocks.join(F.broadcast(by_sector), "sector"), []  # a row for each sector
    for m in METRICS:
        weight = F.try_element_at("_weights", F.lit(m))
        left = weight * clipped(F.coalesce(sure[m], F.lit(0.0)), 0, 1)
        if m == "ocf_yield":
            fair, drawn, known, missing = F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), "missing_positive_ocf_or_target_yield"
            price = F.when((c("ttm_ocfps") > 0) & (c("target_ocf_yield") > 0), c("ttm_ocfps") / c("target_ocf_yield"))
        else:
            anchor, past, missing = c(f"fair_{m}"), c(f"past_{m}"), "missing_basis_or_independent_anchor"
            value, share = history.shrunk(anchor, past["status"], past["median"], past["effective_points"], past["confidence"], kappa)
            fair, drawn, known = F.when(holds(anchor > 0), value), F.when(holds(anchor > 0), share).otherwise(0.0), F.coalesce(past["confidence"], F.lit(0.0))
            price = F.when(basis[m] > 0, basis[m] * fair)
        drop = first_label([(~holds(price > 0), missing), (left <= 0, "zero_data_confidence")], "")
        fields = {"metric": F.lit(m), "weight": weight, "fair": fair, "history_weight": drawn, "history_confidence": known, "implied_price": price, "left": F.when(drop == "", left).otherwise(0.0), "drop_reason": drop}
        out.append(F.when(weight.isNotNull(), F.struct(*[v.alias(k) for k, v in fields.items()])))
    return x.withColumn("lenses", F.array(*out)).drop("_weights")


def center_of(rows: DataFrame) -> DataFrame:
    """``rows`` with what ``centered`` makes of their ``lenses``, in the row itself, and with history_confidence: how far the weighted lenses rest on their history."""
    c = F.col
    lens = {m: F.get("lenses", F.lit(k)) for k, m in enumerate(METRICS)}
    good = {m: holds((x["implied_price"] > 0) & (x["left"] > 0)) for m, x in lens.items()}
    total = lambda of: sum((F.coalesce(of(x), F.lit(0.0)) for x in lens.values()), F.lit(0.0))
    right = lambda of: sum((F.when(good[m], of(x)).otherwise(0.0) for m, x in lens.items()), F.lit(0.0))
    x = rows.withColumns({
        "_n": sum((good[m].cast("int") for m in METRICS), F.lit(0)), "_w": right(lambda x: x["left"]), "_l": right(lambda x: x["left"] * F.log(x["implied_price"])), "_q": right(lambda x: x["left"] * F.log(x["implied_price"]) * F.log(x["implied_price"])),
        "total_weight": total(lambda x: x["weight"]), "_left": total(lambda x: x["left"]), "_rests": total(lambda x: x["left"] * x["history_weight"] * x["history_confidence"]),
        "models_used": F.concat_ws(";", *[F.when(good[m], m.upper()) for m in sorted(METRICS)]),
    })
    mean, some = F.try_divide("_l", "_w"), c("_n") > 0
    return x.withColumns({
        "effective_weight": F.when(some, c("_w")), "center": F.when(some, F.exp(mean)), "disagreement": F.when(c("_n") == 1, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.when(some, c("_q") / c("_w") - mean * mean)))),  # one value agrees with itself, without rounding
        "model_weight_coverage": F.try_divide("_w", "total_weight"), "history_confidence": F.when(c("_left") > 0, c("_rests") / c("_left")).otherwise(0.0),
    }).drop("_n", "_w", "_l", "_q", "_left", "_rests")


def residual_place(ordered: Column, current: Column) -> Column:
    """The share of past residuals, an array of them, that lie at or below the current one; NULL where either is missing."""
    return F.when(current.isNotNull(), F.try_divide(F.size(F.filter(ordered, lambda v: v <= current)), F.size(ordered)))
