"""The engine's registered queries over the landed tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.functions import expr
from tidegauge.operators import backtest, canonical, fundamentals, history, synthetic, trajectory, views
from tidegauge.plans import appraisal, auditing, catalog, chain, choice, configured, live, oracle as sql, panel, policy, relations, reporting
from tidegauge.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def shown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Plain types for output: dates and moments as text, whole numbers as long, doubles settled."""
    kinds = dict(df.dtypes)
    out = []
    for c in columns:
        kind, x = kinds[c], F.col(c)
        if kind == "double":
            x = expr.settled(x)
        elif kind in ("int", "smallint", "tinyint"):
            x = x.cast("long")
        elif kind == "timestamp":
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            x = x.cast("string")
        out.append(x.alias(c))
    return df.select(*out)


def add(name: str, build: Query, columns: Sequence[str], text: str | None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(build(spark, sf_dir), columns)

    _queries[name] = query
    if text:
        _sql[name] = text


KEY = ["kind", "code", "as_of"]


def board_query(name: str, build: Query, ctes: str, source: str, doubles: Sequence[str] = (), plain: Sequence[str] = (), counts: Sequence[str] = ()) -> None:
    add(name, build, [*KEY, *plain, *doubles, *counts], sql.query(ctes, source, sql.listed(doubles, [*sql.BOARD, *plain], counts)))


# bars and their features ------------------------------------------------------------------------------------------

OHLC = ["open", "high", "low", "close", "volume", "amount", "turnover"]
add("weekly_bars", adapters.bars, ["kind", "code", "date", *OHLC, "up_count", "down_count"], sql.query(sql.BARS, "bars", sql.listed(OHLC, ["kind", "code", "date::varchar as date"], ["up_count", "down_count"])))


def _as_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as vendors land them: dates in three spellings, numbers with separators, other column names."""
    rows = adapters.bars(spark, sf_dir)
    day = F.dayofyear("date") % 3
    text = F.when(day == 0, F.date_format("date", "yyyyMMdd")).when(day == 1, F.date_format("date", "yyyy-MM-dd")).otherwise(F.concat(F.date_format("date", "yyyyMMdd"), F.lit(".0")))
    return rows.select("kind", "code", text.alias("trade_day"), F.format_number("close", 10).alias("close_price"), F.format_number("volume", 1).alias("volume"), F.lit("-").alias("turnover"))


def _bars_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.bars(_as_landed(spark, sf_dir), {"date": ("trade_day",), "close": ("close",)})


add("bars_canonical", _bars_canonical, ["kind", "code", "date", "close", "volume", "turnover"], sql.query(sql.BARS, "bars", f"kind, code, date::varchar as date, {sql.settled("close")} as close, {sql.settled('volume')} as volume, null::double as turnover"))

for _name, _columns in {
    "bar_returns": [f"ret_{k}d" for k in (1, 3, 5, 10, 20)],
    "bar_slopes": ["slope_3d", "slope_5d", "slope_10d", "slope_20d", "trend_r2_5d", "trend_r2_10d", "trend_r2_20d"],
    "bar_acceleration": ["acceleration"],
    "bar_volatility": ["positive_days_10", "volatility_5d", "volatility_10d", "volatility_20d", "volatility_ratio_5_20"],
    "bar_boxes": ["distance_ma20", "distance_high20", "box_range_20d_pct", "distance_low_20d_pct", "range_position_60d_pct", "distance_high_60d_pct", "drawdown_10d"],
    "bar_ratios": ["amount_ratio_5_20", "turnover_ratio_5_20"],
    "cmf_proxy": ["flow_proxy_1d_pct", "flow_proxy_5d_pct", "flow_proxy_10d_pct"],
}.items():
    board_query(_name, panel.metric_panel, sql.METRICS, "metrics", _columns)
board_query("metric_panel", panel.metric_panel, sql.METRICS, "metrics", [c for c in sql.FEATURES if c != "level_lookback_days"], (), ["history_days", "level_lookback_days"])

# flows, ranks, scores ---------------------------------------------------------------------------------------------

board_query("breadth", lambda s, d: canonical.universe(panel.metric_panel(s, d)), sql.METRICS, "metrics", ["breadth"], (), ["up_count", "down_count"])
board_query(
    "flow_fusion", panel.fused_panel, sql.FUSED, "fused", [*[f"flow_{k}d_{x}" for k in (1, 5, 10) for x in ("pct", "confidence")], "flow_acceleration"], [*[f"flow_{k}d_source" for k in (1, 5, 10)], "flow_acceleration_source"]
)
board_query("relative_strength", panel.ranked_panel, sql.RANKED, "ranked", ["rs_5d", "rs_10d"])
board_query("amount_share", panel.ranked_panel, sql.RANKED, "ranked", ["amount_share"])
board_query("flow_signal", panel.ranked_panel, sql.RANKED, "ranked", list(sorted(sql.SIGNALS)))


def _pct_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.metric_panel(spark, sf_dir).select(*KEY, expr.percentile_rank(F.col("ret_20d"), "kind", "as_of").alias("ret_20d_rank"))


add("pct_rank", _pct_rank, [*KEY, "ret_20d_rank"], sql.query(sql.METRICS, "metrics", f"{', '.join(sql.BOARD)}, {sql.settled(sql.rank_of('ret_20d'))} as ret_20d_rank"))
board_query("mainline_score", panel.first_pass, sql.FIRST, "first_pass", ["mainline_score"])
board_query("confirmation_score", panel.first_pass, sql.FIRST, "first_pass", ["confirmation_score", "crowding_penalty"])
board_query("ignition_score", panel.first_pass, sql.FIRST, "first_pass", ["ignition_score", "ignition_history_coverage"])
board_query("sideways_seed", panel.first_pass, sql.FIRST, "first_pass", ["sideways_seed_score"], ["sideways_seed_status"])
board_query("status_label", panel.first_pass, sql.FIRST, "first_pass", [], ["status"])
board_query("lifecycle_label", panel.second_pass, sql.SECOND, "second_pass", [], ["lifecycle"])
SCORES = ["mainline_score", "confirmation_score", "ignition_score"]
board_query("two_pass_score", panel.second_pass, sql.SECOND, "second_pass", [*SCORES, "ignition_score_pass1", "ignition_history_coverage"], ["status", "lifecycle"])


def _top_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.top_views(relations.last_scored(spark, sf_dir), {"mainline": (F.lit(True), "mainline_score"), "seed": (F.col("sideways_seed_score") > 0, "sideways_seed_score"), "ignition": (F.col("ignition_score") >= 50, "ignition_score")}, 20)


_VIEWS = (("mainline", "mainline_score", "true"), ("seed", "sideways_seed_score", "sideways_seed_score > 0"), ("ignition", "ignition_score", "ignition_score >= 50"))
_LAST = " union all ".join(
    f"select '{v}' as view, * from (select row_number() over (order by {s} desc nulls last, kind, code) as place, kind, code, {s} as score from first_pass where as_of = (select max(as_of) from first_pass) and {c}) where place <= 20" for v, s, c in _VIEWS
)
add("top_views", _top_boards, ["view", "place", "kind", "code", "score"], f"with {sql.FIRST.strip()}, views as ({_LAST}) select view, place::bigint as place, kind, code, {sql.settled('score')} as score from views")


def _rebased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.rebased(adapters.bars(spark, sf_dir), spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lit("industry").alias("kind"), F.col("p_brand").alias("code")).distinct())


_TAIL = f"{sql.BARS}, tail as (select * from (select *, row_number() over (partition by kind, code order by date desc) as n from bars where kind = 'industry') where n <= 30)"
add("rebased_paths", _rebased, ["kind", "code", "date", "rebased"], sql.query(_TAIL, "tail", f"kind, code, date::varchar as date, {sql.settled('close / first_value(close) over (partition by kind, code order by date) * 100')} as rebased"))

# snapshots and their trajectories ---------------------------------------------------------------------------------

_MOMENT = "strftime({0}, '%Y-%m-%d %H:%M:%S') as {0}"
add("snapshot_refs", lambda s, d: trajectory.reference_calendar(adapters.snapshots(s, d)), ["captured_at", "ref_intraday", "ref_1d", "ref_3d"], sql.query(sql.REFS, "refs", ", ".join(_MOMENT.format(c) for c in ("captured_at", "ref_intraday", "ref_1d", "ref_3d"))))
_SHORT = ["mainline_score", "breadth", "amount_share"]
_DELTAS = [f"{c}_delta_{r}" for r in ("intraday", "1d", "3d") for c in _SHORT]
_VELOCITY = [f"mainline_score_rank_velocity_{r}" for r in ("intraday", "1d", "3d")]
_WITH = f"""{sql.REFS},
ranked as (select *, rank() over (partition by captured_at, kind order by mainline_score desc nulls last) as mainline_score_rank from snapshots join refs using (captured_at)),
deltas as (select s.captured_at, s.kind, s.code, {", ".join(f"s.{c} - p_{r}.{c} as {c}_delta_{r}" for r in ("intraday", "1d", "3d") for c in _SHORT)}, {", ".join(f"p_{r}.mainline_score_rank - s.mainline_score_rank as mainline_score_rank_velocity_{r}" for r in ("intraday", "1d", "3d"))}
           from ranked s {" ".join(f"left join ranked p_{r} on p_{r}.captured_at = s.ref_{r} and p_{r}.kind = s.kind and p_{r}.code = s.code" for r in ("intraday", "1d", "3d"))})"""
add("snapshot_deltas", lambda s, d: trajectory.deltas(adapters.snapshots(s, d)), ["captured_at", "kind", "code", *_DELTAS, *_VELOCITY], sql.query(_WITH, "deltas", sql.listed(_DELTAS, [_MOMENT.format("captured_at"), "kind", "code"], _VELOCITY)))
_MOVED = {r: [*[f"{c}_delta_{r}" for c in trajectory.VALUES], *[f"{c}_rank_velocity_{r}" for c in trajectory.SCORES]] for r in ("intraday", "1d", "3d")}
_EVERY = [x for r in _MOVED.values() for x in r]
_MOVES = f"""{sql.REFS},
placed as (select *, {", ".join(f"case when {c} is not null then rank() over (partition by captured_at, kind order by {c} desc nulls last) end as {c}_rank" for c in trajectory.SCORES)} from snapshots join refs using (captured_at)),
moved as (select s.captured_at, s.kind, s.code, s.ref_1d, {", ".join(f"s.{c} - p_{r}.{c} as {c}_delta_{r}" for r in _MOVED for c in trajectory.VALUES)}, {", ".join(f"p_{r}.{c}_rank - s.{c}_rank as {c}_rank_velocity_{r}" for r in _MOVED for c in trajectory.SCORES)}
          from placed s {" ".join(f"left join placed p_{r} on p_{r}.captured_at = s.ref_{r} and p_{r}.kind = s.kind and p_{r}.code = s.code" for r in _MOVED)}),
seen as (select *, case when ref_1d is null then 0 else ({" + ".join(f"({c} is not null)::int" for c in _MOVED["1d"])}) / {len(_MOVED["1d"])} end as snapshot_history_coverage from moved)"""
add("snapshot_moves", lambda s, d: trajectory.deltas(adapters.snapshots(s, d)), ["captured_at", "kind", "code", *_EVERY, "snapshot_history_coverage"], sql.query(_MOVES, "seen", sql.listed([*[x for x in _EVERY if "_delta_" in x], "snapshot_history_coverage"], [_MOMENT.format("captured_at"), "kind", "code"], [x for x in _EVERY if "_velocity_" in x])))
add("snapshot_latest", lambda s, d: trajectory.latest_of_day(adapters.snapshots(s, d)), ["captured_at", "kind", "code", *SCORES], sql.query(sql.DAYS, "latest", sql.listed(SCORES, [_MOMENT.format("captured_at"), "kind", "code"])))


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.snapshots(spark, sf_dir)
    odd = F.dayofmonth("captured_at") % 2 == 1
    return trajectory.upserted(rows.filter(~odd), rows.filter(odd), ["kind", "code"], "captured_at")


add("snapshot_upsert", _upserted, ["captured_at", "kind", "code", *SCORES], sql.query(sql.SNAPSHOTS, "(select *, row_number() over (partition by kind, code order by captured_at desc) as n from snapshots) where n = 1", sql.listed(SCORES, [_MOMENT.format("captured_at"), "kind", "code"])))
_AFTER = ["ignition_score", "alert_ret_5d", "forward_rs_3d", "forward_rs_5d", "forward_rs_10d"]
add("backtest_detail", lambda s, d: backtest.detail(adapters.snapshots(s, d)), ["signal_date", "kind", "code", "became_mainline", "false_start", "lead_time_sessions", *_AFTER], sql.query(sql.DETAIL, "detail", sql.listed(_AFTER, ["signal_date::varchar as signal_date", "kind", "code", "became_mainline", "false_start"], ["lead_time_sessions"])))
_SUMS = {"precision_at_10": "avg(became_mainline::int)", "false_start_rate": "avg(false_start::int)", "median_lead_time_sessions": "median(lead_time_sessions)", "median_alert_ret_5d": "median(alert_ret_5d)", **{f"mean_forward_rs_{n}d": f"avg(forward_rs_{n}d)" for n in (3, 5, 10)}}
add("backtest_summary", lambda s, d: backtest.summary(backtest.detail(adapters.snapshots(s, d))), ["signals", *_SUMS], sql.query(sql.DETAIL, "detail", "count(*)::bigint as signals, " + ", ".join(f"{sql.settled(e)} as {c}" for c, e in _SUMS.items())))
_PAIR = ["later_score", "later_rs"]
add("future_pairs", lambda s, d: backtest.future_pairs(adapters.snapshots(s, d)), ["snapshot_date", "kind", "code", "offset", *_PAIR], sql.query(sql.DAYS, "met", sql.listed(_PAIR, ["snapshot_date::varchar as snapshot_date", "kind", "code"]) + ', "offset"::bigint as "offset"'))

# synthetic indexes, waterfalls, names -----------------------------------------------------------------------------

def _synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months compound to large levels, so prices are shown as logarithms."""
    rows = synthetic.index(adapters.constituents(spark, sf_dir), adapters.stock_bars(spark, sf_dir))
    return rows.withColumns({f"ln_{c}": F.log(c) for c in OHLC[:4]})


_INDEX = [*[f"ln_{c}" for c in OHLC[:4]], *OHLC[4:], "synthetic_coverage"]
add("synthetic_index", _synthetic, ["board", "date", *_INDEX, "constituent_count"], sql.query(sql.SYNTHETIC, "log_index", sql.listed(_INDEX, ["board", "date::varchar as date"], ["constituent_count"])))


def _waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some boards are missing from the first source, some from both; the last source has all."""
    rows = panel.cut(adapters.bars(spark, sf_dir).select("kind", "code", "date", "close"))  # all three sources come from it
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("long")
    return canonical.waterfall([("primary", rows.filter(number % 3 == 0)), ("secondary", rows.filter(number % 2 == 0)), ("synthetic", rows)])


add("source_waterfall", _waterfall, ["kind", "code", "date", "close", "data_source"], sql.query(sql.BARS, "bars", f"kind, code, date::varchar as date, {sql.settled('close')} as close, case when regexp_extract(code, '([0-9]+)$', 1)::bigint % 3 = 0 then 'primary' when regexp_extract(code, '([0-9]+)$', 1)::bigint % 2 = 0 then 'secondary' else 'synthetic' end as data_source"))


def _name_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("c01 "), "p_name", F.lit("_(概念)")).alias("name")).distinct()
    x = F.col("name")
    return names.select("name", expr.board_name(x).alias("board_key"), expr.theme_name(x).alias("theme_key"), expr.compact_name(x).alias("compact_key"), expr.valuation_name(x).alias("valuation_key"), expr.stage_name(x).alias("stage_key"))


_MARKS = r"regexp_replace(lower(trim({})), '[\s_()（）\-—·{}]', '', 'g')"
_BOARD = "regexp_replace(regexp_replace({}, '(概念|板块)$', ''), '[ⅰⅱⅲⅳⅴ]+$', '')"
add(
    "name_keys", _name_keys, ["name", "board_key", "theme_key", "compact_key", "valuation_key", "stage_key"],
    f"""select distinct name, {_BOARD.format(_MARKS.format("name", ""))} as board_key, {_BOARD.format(_MARKS.format("regexp_replace(lower(trim(name)), '^[a-z][0-9][0-9]', '')", ""))} as theme_key, {_MARKS.format("name", "")} as compact_key,
        regexp_replace({_MARKS.format("name", "/")}, '(概念|板块|行业)$', '') as valuation_key, regexp_replace({_MARKS.format("name", "/")}, '概念|板块|行业', '', 'g') as stage_key from (select 'c01 ' || p_name || '_(概念)' as name from part)""",
)
add("code_extract", lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.array_join(expr.stock_codes(F.concat_ws(" ", F.lpad(F.col("c_custkey").cast("string"), 6, "6"), F.col("c_name"), F.lit("sh.600519"), F.lit("600519"))), ",").alias("codes")), ["c_custkey", "codes"],
    "select c_custkey, lpad(c_custkey::varchar, 6, '6') || case when lpad(c_custkey::varchar, 6, '6') = '600519' then '' else ',600519' end as codes from customer")
add("dataset_freshness", lambda s, d: canonical.freshness({"lines": (adapters.landed(s, d, "lineitem"), "l_shipdate"), "orders": (adapters.landed(s, d, "orders"), "o_orderdate"), "events": (adapters.landed(s, d, "events"), "ts")}), ["dataset", "rows", "last_date"],
    "select 'lines' as dataset, count(*)::bigint as rows, max(l_shipdate)::date::varchar as last_date from lineitem union all select 'orders', count(*), max(o_orderdate)::date::varchar from orders union all select 'events', count(*), max(ts)::date::varchar from events")
add("universe_hash", lambda s, d: trajectory.universe_hash(panel.sector_members(s, d), "sector", "code"), ["sector", "universe_hash"],
    f"with {sql.STOCKS.strip()} select 'sector_' || n_regionkey as sector, substr(sha256(string_agg(distinct stock_code, ',' order by stock_code)), 1, 16) as universe_hash from constituents group by 1")

# fundamentals -----------------------------------------------------------------------------------------------------

_REPORT = ["revenue", "net_profit", "operating_cashflow", "ocfps", "bvps_reported", "roe_h1_pct", "gross_margin_pct"]
add("reports", adapters.performance, ["report_date", "code", *_REPORT], sql.query(sql.REPORTS, "performance", sql.listed(_REPORT, ["report_date", "code"])))
_TTM = [f"ttm_{f}" for f in ("revenue", "profit", "operating_cashflow")]
_PLAIN, _SURE = [f"{t}_method" for t in _TTM], [*_TTM, *[f"{t}_confidence" for t in _TTM], "fallback_ocfps"]
add("ttm", panel.trailing, ["code", *_PLAIN, *_SURE], sql.query(sql.TTM, "ttm", sql.listed(_SURE, ["code", *_PLAIN])))
_MULTIPLES = ["price", "market_cap", "pb", "shares_outstanding", "ttm_eps", "ttm_ocfps", "pe_ttm_calc", "ps_ttm_calc", "sps_ttm", "bvps", "ttm_roe_pct", "cash_conversion"]
add("multiples", panel.company_table, ["code", "name", *_MULTIPLES], sql.query(sql.MASTER, "master", sql.listed(_MULTIPLES, ["code", "name"])))
_SECTOR = ["market_cap", "aggregate_pe", "positive_profit_pe", "pb", "ps", "revenue_growth", "profit_growth", "gross_margin_pct", "profitable_mcap_coverage", "loss_mcap_share", "pb_mcap_coverage", "ocf_mcap_coverage", "ocf_yield", "data_coverage"]
add("sector_aggregate", lambda s, d: fundamentals.sector_aggregate(panel.sector_members(s, d), panel.company_table(s, d)), ["sector", "constituents", *_SECTOR], sql.query(sql.SECTORS, "sectors", sql.listed(_SECTOR, ["sector"], ["constituents"])))
_COVERAGE = ["current_coverage", "prior_coverage", "annual_coverage"]
add("period_select", lambda s, d: fundamentals.period_coverage(adapters.performance(s, d), adapters.spot(s, d)), ["period", *_COVERAGE, "selected"], sql.query(f"{sql.REPORTS},{sql.PERIODS}", "chosen", sql.listed(_COVERAGE, ["period", "selected"])))


add("ttm_selected", panel.trailing, ["code", "period", *_PLAIN, *_SURE], sql.query(sql.TTM, "ttm", sql.listed(_SURE, ["code", "period", *_PLAIN])))
add("month_periods", panel.month_periods, ["as_of", "period", *_COVERAGE, "selected"], sql.query(sql.MONTHS, "chosen", sql.listed(_COVERAGE, ["as_of::varchar as as_of", "period", "selected"])))
add("month_multiples", panel.month_companies, ["as_of", "code", "period", *_PLAIN, *_TTM, *_MULTIPLES], sql.query(sql.MONTHS, "master", sql.listed([*_TTM, *_MULTIPLES], ["as_of::varchar as as_of", "stock as code", "period", *_PLAIN])))
_STATS = ["effective_points", "confidence", "median", "q10", "q25", "q50", "q75", "q90", "mad"]
_HISTORY = f"""{sql.STOCKS},
prepared as (select stock_code as code, date, close, lag(close) over (partition by stock_code order by date) as before, abs(close - median(close) over (partition by stock_code)) as off from stock_bars),
counted as (select code, count(*) as points, max(date) as last_date, greatest(-0.95, least(0.95, corr(close, before))) as rho, quantile_cont(close, [0.1, 0.25, 0.5, 0.75, 0.9]) as q, median(off) as mad from prepared group by code),
sized as (select *, case when points < 3 or rho is null then points else least(points, greatest(1, points * (1 - rho) / (1 + rho))) end as effective_points from counted),
stats as (select *, q[3] as median, q[1] as q10, q[2] as q25, q[3] as q50, q[4] as q75, q[5] as q90, least(1, effective_points / 30) as confidence,
          case when points < 30 then 'INSUFFICIENT_POINTS' when effective_points < 6 then 'INSUFFICIENT_EFFECTIVE_POINTS' else 'OK' end as status from sized)"""
add("history_stats", lambda s, d: history.stats(adapters.stock_bars(s, d).withColumnRenamed("stock_code", "code"), "code", "close", "date"), ["code", "status", "points", "last_date", *_STATS], sql.query(_HISTORY, "stats", sql.listed(_STATS, ["code", "status", "last_date::varchar as last_date"], ["points"])))


def _last_against_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stock's last close beside its own history, and a model value (1.1 of that close) drawn to the median."""
    rows = adapters.stock_bars(spark, sf_dir).withColumnRenamed("stock_code", "code")
    last = rows.groupBy("code").agg(F.max_by("close", "date").alias("last_close"))
    both = history.stats(rows, "code", "close", "date").join(last, "code")
    value, weight = history.shrunk(1.1 * F.col("last_close"), F.col("status"), F.col("median"), F.col("effective_points"), F.col("confidence"))
    return both.select("code", "last_close", history.robust_z(F.col("last_close"), F.col("median"), F.col("mad")).alias("robust_z"), value.alias("shrunk_value"), weight.alias("history_weight"))


_LAST = f"""{_HISTORY},
lasting as (select code, max_by(close, date) as last_close from prepared group by code),
weighed as (select *, case when status = 'OK' and median > 0 then effective_points / (effective_points + 60) * confidence else 0 end as history_weight from stats join lasting using (code)),
against as (select *, case when 1.4826::double * mad > 1e-12 then (last_close - median) / (1.4826::double * mad) end as robust_z, exp((1 - history_weight) * ln(1.1::double * last_close) + history_weight * ln(median)) as shrunk_value from weighed)"""
for _name, _columns in {"robust_z": ["last_close", "robust_z"], "shrinkage": ["shrunk_value", "history_weight"]}.items():
    add(_name, _last_against_history, ["code", *_columns], sql.query(_LAST, "against", sql.listed(_columns, ["code"])))

# fair values, the audit and the policy ----------------------------------------------------------------------------------------

for _entry in [*appraisal.ENTRIES, *auditing.ENTRIES, *policy.entries(_HISTORY), *catalog.ENTRIES, *relations.ENTRIES, *chain.ENTRIES, *choice.ENTRIES, *configured.ENTRIES, *live.ENTRIES, *reporting.ENTRIES]:
    add(*_entry)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
