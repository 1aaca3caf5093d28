"""Trailing-twelve-month fundamentals, per-share values and multiples, and sector aggregates on matched samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.expr import ratio

# How far a figure counts by the way it was made.
CONFIDENCE = {"EXACT_TTM": 1.0, "ANNUALIZED_Q3": 0.70, "ANNUALIZED_H1": 0.55, "ANNUALIZED_Q1": 0.35, "MISSING": 0.0}
METHOD = {"0331": "ANNUALIZED_Q1", "0630": "ANNUALIZED_H1", "0930": "ANNUALIZED_Q3", "1231": "EXACT_TTM"}
FACTOR = {"0331": 4.0, "0630": 2.0, "0930": 4.0 / 3.0, "1231": 1.0}
#: Shares of the quoted codes that the current, and of the current that the earlier reports must cover.
LEAST_COVERAGE = 0.80


def triplet(current: str) -> tuple[str, str, str]:
    """The current period, the same one a year before, and the year's end between them."""
    if len(current) != 8 or current[4:] not in FACTOR:
        raise ValueError(f"no report period: {current}")
    year = int(current[:4]) - 1
    return current, f"{year}{current[4:]}", f"{year}1231"


def candidate_periods(as_of: Column, most: int = 8) -> Column:
    """The last periods whose reports are due by ``as_of``: Q1 by 30 April, H1 by 31 August, Q3 by 31 October."""
    year = F.year(as_of)
    made = [F.when(as_of >= F.make_date(year - back, F.lit(m), F.lit(d)), F.concat((year - back).cast("string"), F.lit(end))) for back in range(4) for m, d, end in ((10, 31, "0930"), (8, 31, "0630"), (4, 30, "0331"))]
    return F.slice(F.filter(F.array(*made), lambda x: x.isNotNull()), 1, most)


def period_coverage(performance: DataFrame, spot: DataFrame) -> DataFrame:
    """Each candidate period with the shares of codes its reports cover, and whether it is the one to use."""
    as_of = spot.agg(F.max("quote_trade_date").alias("as_of"), F.count_distinct("code").alias("quoted"))
    periods = as_of.select("quoted", F.explode(candidate_periods(F.col("as_of"))).alias("period"))
    quoted = spot.select("code").distinct()
    reports = performance.select("report_date", "code").distinct()

    def codes(column: str, shift: Column) -> DataFrame:
        wanted = periods.select("period", shift.alias("report_date"))
        return reports.join(F.broadcast(wanted), "report_date").select("period", "code", F.lit(1).alias(column))  # eight periods

    year = (F.substring("period", 1, 4).cast("int") - 1).cast("string")
    current = codes("current", F.col("period"))
    joined = current.join(quoted.withColumn("quoted_code", F.lit(1)), "code", "left").join(codes("prior", F.concat(year, F.substring("period", 5, 4))), ["period", "code"], "left").join(codes("annual", F.concat(year, F.lit("1231"))), ["period", "code"], "left")
    counts = joined.groupBy("period").agg(F.count("current").alias("reports"), F.count("quoted_code").alias("in_spot"), F.count("prior").alias("prior"), F.count("annual").alias("annual"))
    out = periods.join(counts, "period", "left").select("period", ratio(F.coalesce("in_spot", F.lit(0)), F.col("quoted")).alias("current_coverage"), F.coalesce(ratio(F.col("prior"), F.col("reports")), F.lit(0.0)).alias("prior_coverage"), F.coalesce(ratio(F.col("annual"), F.col("reports")), F.lit(0.0)).alias("annual_coverage"))
    enough = (F.col("current_coverage") >= LEAST_COVERAGE) & (F.col("prior_coverage") >= LEAST_COVERAGE) & (F.col("annual_coverage") >= LEAST_COVERAGE)
    first = F.max(F.when(enough, F.col("period"))).over(Window.partitionBy(F.lit(0)))  # of eight rows
    return out.withColumn("selected", F.coalesce(F.col("period") == first, F.lit(False)))


def selected_period(performance: DataFrame, spot: DataFrame, explicit: str | None = None) -> str:
    """The period to take the figures at: ``explicit``, else the latest whose reports cover enough. One value."""
    if explicit is not None:
        return triplet(explicit)[0]
    chosen = period_coverage(performance, spot).filter("selected").select("period").first()
    if chosen is None:
        raise ValueError(f"no report period covers {LEAST_COVERAGE:.0%} of the quoted codes with its earlier reports")
    return chosen["period"]


FIGURES = ("revenue", "net_profit", "operating_cashflow", "ocfps", "bvps_reported", "roe_h1_pct", "gross_margin_pct")


def periods_due(quotes: DataFrame) -> DataFrame:
    """``quotes`` (as_of, code, quote_trade_date): for each as_of the codes quoted and the last periods due by its latest quote."""
    calendar = quotes.groupBy("as_of").agg(F.max("quote_trade_date").alias("_today"), F.count_distinct("code").alias("quoted"))
    return calendar.select("as_of", "quoted", F.explode(candidate_periods(F.col("_today"))).alias("period"))


def period_panel(performance: DataFrame, quotes: DataFrame) -> DataFrame:
    """As ``period_coverage``, for each as_of of ``quotes``: what could be known then, and the period to use."""
    due = periods_due(quotes)
    filed = by_period(performance.select("report_date", "code").distinct(), ()).filter("has_cur")
    whole = filed.groupBy("period").agg(F.count("*").alias("reports"), F.sum(F.col("has_pri").cast("int")).alias("prior"), F.sum(F.col("has_ann").cast("int")).alias("annual"))
    filed_by, due_by = filed.groupBy("code").agg(F.collect_list("period").alias("filed")), due.groupBy("as_of").agg(F.collect_list("period").alias("due"))  # a code's periods, eight of each as_of
    met = quotes.select("as_of", "code").distinct().join(F.broadcast(due_by), "as_of").join(filed_by, "code").select("as_of", F.explode(F.array_intersect("due", "filed")).alias("period")).groupBy("as_of", "period").agg(F.count("*").alias("in_spot"))
    found = due.join(whole, "period", "left").join(met, ["as_of", "period"], "left")
    share = lambda n, of: F.coalesce(ratio(F.col(n), F.col(of)), F.lit(0.0))
    out = found.select("as_of", "period", share("in_spot", "quoted").alias("current_coverage"), share("prior", "reports").alias("prior_coverage"), share("annual", "reports").alias("annual_coverage"))
    enough = F.least("current_coverage", "prior_coverage", "annual_coverage") >= LEAST_COVERAGE
    first = F.max(F.when(enough, F.col("period"))).over(Window.partitionBy("as_of"))  # of eight rows
    return out.withColumn("selected", F.coalesce(F.col("period") == first, F.lit(False)))


def by_period(performance: DataFrame, figures: tuple[str, ...]) -> DataFrame:
    """A row for each code and period that any of its reports serves: the period's own (cur), the year before's (pri), the
    last year's end (ann). A report serves its own period, the same of the next year, and as a year's end all of that year's."""
    year, end = F.substring("report_date", 1, 4).cast("int"), F.substring("report_date", 5, 4)
    next_year = (year + 1).cast("string")
    uses = F.array(F.struct(F.col("report_date").alias("period"), F.lit("cur").alias("tag")), F.struct(F.concat(next_year, end).alias("period"), F.lit("pri").alias("tag")))
    closing = F.array(*[F.struct(F.concat(next_year, F.lit(e)).alias("period"), F.lit("ann").alias("tag")) for e in FACTOR])
    rows = performance.withColumn("_use", F.explode(F.when(end == "1231", F.concat(uses, closing)).otherwise(uses))).select("code", "_use.*", *figures)
    sums = [F.max(F.when(F.col("tag") == tag, F.col(c))).alias(f"{c}_{tag}") for c in figures for tag in ("cur", "pri", "ann")]
    return rows.groupBy("period", "code").agg(*[F.bool_or(F.col("tag") == tag).alias(f"has_{tag}") for tag in ("cur", "pri", "ann")], *sums)


def ttm_panel(performance: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """For each code and period (those of ``periods`` only, where given): the three periods' figures and trailing-year revenue,
    profit and cash flow with their method and confidence."""
    wide = by_period(performance, FIGURES).drop("has_cur", "has_pri", "has_ann")
    if periods is not None:
        wide = wide.join(periods.select("period").distinct(), "period", "left_semi")
    end = F.substring("period", 5, 4)
    way = lambda of: F.coalesce(*[F.when(end == e, F.lit(of[e])) for e in FACTOR])
    factor, method, sure = way(FACTOR), way(METHOD), way({e: CONFIDENCE[m] for e, m in METHOD.items()})
    out = {}
    for name, figure in (("revenue", "revenue"), ("profit", "net_profit"), ("operating_cashflow", "operating_cashflow")):
        cur, pri, ann = (F.col(f"{figure}_{t}") for t in ("cur", "pri", "ann"))
        exact = ann + cur - pri
        out[f"ttm_{name}"] = F.coalesce(exact, cur * factor)
        out[f"ttm_{name}_method"] = F.when(exact.isNotNull(), "EXACT_TTM").when(cur.isNotNull(), method).otherwise("MISSING")
        out[f"ttm_{name}_confidence"] = F.when(exact.isNotNull(), 1.0).when(cur.isNotNull(), sure).otherwise(0.0)
    out["fallback_ocfps"] = F.col("ocfps_cur") * factor
    out["fallback_ocfps_confidence"] = F.when(F.col("ocfps_cur").isNotNull(), F.least(F.lit(0.35), sure)).otherwise(0.0)
    out["roe_factor"] = factor
    return wide.withColumns(out)


def ttm(performance: DataFrame, current: str) -> DataFrame:
    """``ttm_panel`` of one period."""
    needed = performance.filter(F.col("report_date").isin(*triplet(current)))
    return ttm_panel(needed).filter(F.col("period") == current)


def master(spot: DataFrame, funds: DataFrame, on: Sequence[str] = ("code",)) -> DataFrame:
    """Quotes with fundamentals, per-share values, multiples, return on equity and cash conversion."""
    x = spot.join(funds, list(on), "left")
    c = F.col
    shares = F.when((c("market_cap") > 0) & (c("price") > 0), c("market_cap") / c("price"))
    x = x.withColumn("shares_outstanding", shares)
    exact = F.when(c("shares_outstanding") > 0, c("ttm_operating_cashflow") / c("shares_outstanding"))
    book = F.when((c("pb") > 0) & (c("market_cap") > 0), c("market_cap") / c("pb"))
    average = F.when((c("bvps_reported_cur") > 0) & (c("bvps_reported_pri") > 0), (c("bvps_reported_cur") + c("bvps_reported_pri")) / 2 * c("shares_outstanding"))
    equity = F.coalesce(average, book)
    roe = F.when(equity > 0, c("ttm_profit") / equity * 100)
    profit_confidence = F.coalesce("ttm_profit_confidence", F.lit(0.0))
    x = x.withColumns({
        "ttm_eps": F.when(c("shares_outstanding") > 0, c("ttm_profit") / c("shares_outstanding")),
        "ttm_ocfps": F.coalesce(exact, c("fallback_ocfps")),
        "ttm_ocfps_confidence": F.when(exact.isNotNull(), F.least(c("ttm_operating_cashflow_confidence"), F.lit(0.90))).otherwise(F.coalesce("fallback_ocfps_confidence", F.lit(0.0))),
        "pe_ttm_calc": F.when((c("ttm_profit") > 0) & (c("market_cap") > 0), c("market_cap") / c("ttm_profit")),
        "ps_ttm_calc": F.when((c("ttm_revenue") > 0) & (c("market_cap") > 0), c("market_cap") / c("ttm_revenue")),
        "ttm_roe_pct": F.coalesce(roe, c("roe_h1_pct_cur") * c("roe_factor")),
        "ttm_roe_method": F.when(average.isNotNull(), "AVERAGE_EQUITY").when(roe.isNotNull(), "CURRENT_EQUITY").otherwise("ANNUALIZED_REPORTED"),
        "ttm_roe_confidence": F.least(profit_confidence, F.when(average.isNotNull(), 0.90).otherwise(0.45)),
        "sps_ttm": c("ttm_revenue") / c("shares_outstanding"),
        "bvps": F.when(c("shares_outstanding") > 0, book / c("shares_outstanding")),
        "gross_margin_trend_pct": c("gross_margin_pct_cur") - c("gross_margin_pct_pri"),
        "roe_trend_pct": c("roe_h1_pct_cur") - c("roe_h1_pct_pri"),
    })
    x = x.withColumn("ttm_eps_confidence", F.when(c("ttm_eps").isNotNull(), F.least(profit_confidence, F.lit(0.90))).otherwise(0.0))
    direct = F.when(c("ttm_profit") > 0, c("ttm_operating_cashflow") / c("ttm_profit"))
    return x.withColumn("cash_conversion", F.coalesce(direct, F.when(c("ttm_eps") > 0, c("ttm_ocfps") / c("ttm_eps"))))


def sector_aggregate(members: DataFrame, master_: DataFrame, least_profitable: float = 0.70) -> DataFrame:
    """Matched-sample multiples, growth and coverage of each sector, in one pass over its constituents."""
    x = members.select("sector", "code").distinct().join(master_, "code").filter(F.col("market_cap") > 0)
    c, cap = F.col, F.col("market_cap")
    total = lambda value, where: F.sum(F.when(where, value))
    profit, revenue, ocf = c("ttm_profit"), c("ttm_revenue"), c("ttm_operating_cashflow")
    has, pos, rev = profit.isNotNull(), profit > 0, revenue > 0
    both_r, both_p = (c("revenue_cur") > 0) & (c("revenue_pri") > 0), c("net_profit_cur").isNotNull() & c("net_profit_pri").isNotNull()
    priced, matched = c("pb") > 0, ocf.isNotNull() & profit.isNotNull()
    sure = lambda value, confidence: total(cap * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(confidence, F.lit(0.0)))), value.isNotNull())
    s = x.groupBy("sector").agg(
        F.count("*").alias("constituents"), F.sum(cap).alias("market_cap"), total(cap, has).alias("cap_has"), total(profit, has).alias("profit"), total(cap, pos).alias("cap_pos"), total(profit, pos).alias("profit_pos"), total(cap, profit <= 0).alias("cap_loss"),
        total(cap, rev).alias("cap_rev"), total(revenue, rev).alias("revenue"), total(cap, priced).alias("cap_pb"), total(cap / F.nullif(c("pb"), F.lit(0.0)), priced).alias("book"), total(cap, both_r).alias("cap_growth_r"), total(c("revenue_cur"), both_r).alias("rc"), total(c("revenue_pri"), both_r).alias("rp"),
        total(cap, both_p).alias("cap_growth_p"), total(c("net_profit_cur"), both_p).alias("pc"), total(c("net_profit_pri"), both_p).alias("pp"), total(cap, rev & has).alias("cap_margin"), total(revenue, rev & has).alias("margin_r"), total(profit, rev & has).alias("margin_p"),
        total(cap, ocf.isNotNull()).alias("cap_ocf"), total(ocf, ocf.isNotNull()).alias("ocf"), total(ocf, matched).alias("cash_o"), total(profit, matched).alias("cash_p"), total(cap, priced & has).alias("cap_roe"), total(cap / F.nullif(c("pb"), F.lit(0.0)), priced & has).alias("roe_book"), total(profit, priced & has).alias("roe_profit"),
        F.median("gross_margin_pct_cur").alias("gross_margin_pct"), total(cap, revenue.isNotNull()).alias("cap_revenue_known"), sure(profit, c("ttm_profit_confidence")).alias("pe_sure"), sure(revenue, c("ttm_revenue_confidence")).alias("ps_sure"), sure(ocf, c("ttm_operating_cashflow_confidence")).alias("ocf_sure"), sure(c("ttm_roe_pct"), c("ttm_roe_confidence")).alias("roe_sure"),
    )
    share = lambda name: F.coalesce(c(name), F.lit(0.0)) / c("market_cap")
    above = lambda a, b: F.when(c(b) > 0, c(a) / c(b))
    profitable = share("cap_pos")
    aggregate_pe = above("cap_has", "profit")
    roe_confidence = F.when(share("roe_sure") > 0, share("roe_sure")).otherwise(share("cap_roe"))
    pe = F.when(profitable >= least_profitable, aggregate_pe)
    return s.select(
        "sector", "constituents", "market_cap", pe.alias("pe"), aggregate_pe.alias("aggregate_pe"), above("cap_pos", "profit_pos").alias("positive_profit_pe"), above("cap_pb", "book").alias("pb"), above("cap_rev", "revenue").alias("ps"), (above("rc", "rp") - 1).alias("revenue_growth"), (above("pc", "pp") - 1).alias("profit_growth"),
        F.coalesce((c("pp") <= 0) & (c("pc") > 0), F.lit(False)).alias("turnaround"), above("margin_p", "margin_r").alias("net_margin"), share("cap_margin").alias("net_margin_mcap_coverage"), above("cash_o", "cash_p").alias("cash_conversion"), above("ocf", "cap_ocf").alias("ocf_yield"), (above("roe_profit", "roe_book") * 100).alias("roe_ttm_pct"), "gross_margin_pct",
        profitable.alias("profitable_mcap_coverage"), share("cap_loss").alias("loss_mcap_share"), share("cap_has").alias("pe_mcap_coverage"), share("cap_pb").alias("pb_mcap_coverage"), share("cap_rev").alias("ps_mcap_coverage"), share("cap_ocf").alias("ocf_mcap_coverage"), share("cap_roe").alias("roe_mcap_coverage"), share("cap_growth_r").alias("revenue_growth_coverage"), share("cap_growth_p").alias("profit_growth_coverage"),
        F.when(pe.isNotNull(), share("pe_sure")).otherwise(0.0).alias("pe_metric_confidence"), F.least(share("cap_pb"), roe_confidence).alias("pb_metric_confidence"), share("ps_sure").alias("ps_metric_confidence"), share("ocf_sure").alias("ocf_metric_confidence"), F.least(share("cap_revenue_known"), share("cap_has"), share("cap_growth_r"), share("cap_growth_p")).alias("data_coverage"),
    )


def age_score(age_days: Column, full: int, zero: int) -> Column:
    return F.when(age_days.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (zero - age_days) / float(zero - full))))
