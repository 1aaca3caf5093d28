"""SQL for the registered queries: written from the definitions, over the landed tables, for any engine with windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from tidegauge.operators.scoring import CONFIRMATION, GROUP, IGNITION, MAINLINE, SIGNALS, TRAJECTORY
from tidegauge.operators import fundamentals


def settled(x: str) -> str:
    return f"floor(({x}) * 1000000.0 + 0.500123) / 1000000.0"


def listed(doubles: Sequence[str] = (), plain: Sequence[str] = (), counts: Sequence[str] = ()) -> str:
    return ", ".join([*plain, *[f"{settled(c)} as {c}" for c in doubles], *[f"{c}::bigint as {c}" for c in counts]])


def frame(k: int, back: int = 0) -> str:
    return f"(partition by kind, code order by date rows between {k - 1 + back} preceding and {back} preceding)"


def rank_of(x: str, by: str = ", ".join(GROUP)) -> str:
    return f"(case when {x} is not null then (rank() over (partition by {by} order by {x} asc nulls last) + (count(*) over (partition by {by}, {x}) - 1) / 2.0) / count({x}) over (partition by {by}) else 0.5 end)"


PRICED = """
lines as (select l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_linestatus, l_shipdate::date as day, date_trunc('week', l_shipdate)::date as date,
          l_extendedprice / l_quantity as px from lineitem),
priced as (select 'industry' as kind, p_brand as code, lines.* from lines join part on p_partkey = l_partkey
           union all select 'concept', l_suppkey::varchar, lines.* from lines)"""
BARS = f"""{PRICED},
opened as (select kind, code, date, avg(px) as open from (select *, min(day) over (partition by kind, code, date) as first_day from priced) where day = first_day group by kind, code, date),
weekly as (select kind, code, date, max(px) as high, min(px) as low, avg(px) as close, sum(l_quantity) as volume, sum(l_extendedprice) as amount, sum(l_quantity) / count(distinct l_partkey) as turnover,
           count(*) filter (l_discount < 0.05) as up_count, count(*) filter (l_discount > 0.05) as down_count from priced group by kind, code, date),
bars as (select * from weekly join opened using (kind, code, date))"""


def slope(k: int, back: int = 0, shrink: bool = False) -> str:
    need = f"least({k}, n)" if shrink else str(k)
    return f"(case when count(ln_close) over {frame(k, back)} = {need} then regr_slope(ln_close, n) over {frame(k, back)} * 100 end)"


def fit(k: int, shrink: bool = False) -> str:
    need = f"least({k}, n)" if shrink else str(k)
    return f"(case when count(ln_close) over {frame(k)} = {need} then greatest(0, least(1, case when regr_syy(ln_close, n) over {frame(k)} <= 1e-12 then 1.0 else regr_r2(ln_close, n) over {frame(k)} end)) end)"


def change(k: int) -> str:
    return f"(case when lag(close, {k}) over w > 0 then (close / lag(close, {k}) over w - 1) * 100 end)"


HIGH, LOW = f"max(coalesce(high, close)) over {frame(60)}", f"min(coalesce(low, close)) over {frame(60)}"
FEATURES = {
    **{f"ret_{k}d": change(k) for k in (1, 3, 5, 10, 20)},
    **{f"slope_{k}d": slope(k) for k in (3, 5, 10)},
    "slope_20d": slope(20, shrink=True),
    "trend_r2_5d": fit(5),
    "trend_r2_10d": fit(10),
    "trend_r2_20d": fit(20, shrink=True),
    "acceleration": f"coalesce({slope(3)} - {slope(5, 3)}, {slope(3)} - {slope(10)})",
    "positive_days_10": f"avg(case when r > 0 then 1.0::double else 0.0 end) over {frame(10)}",
    **{f"volatility_{k}d": f"stddev_pop(r) over {frame(k)} * 100" for k in (5, 10, 20)},
    "volatility_ratio_5_20": f"case when stddev_pop(r) over {frame(20)} > 0 then (stddev_pop(r) over {frame(5)} * 100) / (stddev_pop(r) over {frame(20)} * 100) end",
    "distance_ma20": f"(close / nullif(avg(close) over {frame(20)}, 0) - 1) * 100",
    "distance_high20": f"(close / nullif(max(close) over {frame(20)}, 0) - 1) * 100",
    "box_range_20d_pct": f"(max(coalesce(high, close)) over {frame(20)} / nullif(min(coalesce(low, close)) over {frame(20)}, 0) - 1) * 100",
    "distance_low_20d_pct": f"(close / nullif(min(coalesce(low, close)) over {frame(20)}, 0) - 1) * 100",
    "range_position_60d_pct": f"case when {HIGH} - {LOW} > 0 then (close - {LOW}) / ({HIGH} - {LOW}) * 100 else 50.0 end",
    "distance_high_60d_pct": f"(close / nullif({HIGH}, 0) - 1) * 100",
    "level_lookback_days": "least(60, n)",
    "amount_ratio_5_20": f"avg(amount) over {frame(5)} / nullif(avg(amount) over {frame(20)}, 0)",
    "turnover_ratio_5_20": f"avg(turnover) over {frame(5)} / nullif(avg(turnover) over {frame(20)}, 0)",
    "drawdown_10d": f"(close / nullif(max(close) over {frame(10)}, 0) - 1) * 100",
    **{f"flow_proxy_{k}d_pct": f"sum(multiplier * amount) over {frame(k)} / nullif(sum(case when multiplier is not null then amount end) over {frame(k)}, 0) * 100" for k in (1, 5, 10)},
}
METRICS = f"""{BARS},
logged as (select *, row_number() over w as n, case when close > 0 then ln(close) end as ln_close, case when lag(close) over w <> 0 then close / lag(close) over w - 1 end as r,
           case when high = low then 0 else greatest(-1, least(1, (2 * close - high - low) / (high - low))) end as multiplier from bars window w as (partition by kind, code order by date)),
panel as (select kind, code, date as as_of, up_count, down_count, n as history_days, close as last_close, amount as last_amount, {", ".join(f"{e} as {k}" for k, e in FEATURES.items())}
          from logged window w as (partition by kind, code order by date)),
metrics as (select *, up_count / nullif(up_count + down_count, 0) as breadth from panel where history_days >= 12)"""
FLOWS = f"""
sides as (select kind, code, date, sum(case when l_linestatus = 'F' then l_extendedprice else -l_extendedprice end) as net, sum(l_extendedprice) as total from priced group by kind, code, date),
flows as (select kind, code, date as as_of, {", ".join(f"100 * (sum(net) over {frame(k)} / nullif(sum(total) over {frame(k)}, 0)) as flow_{k}d_direct_pct" for k in (1, 5, 10))}
          from sides where regexp_extract(code, '([0-9]+)$', 1)::bigint % 3 <> 0)"""
_D = {k: f"flow_{k}d_direct_pct" for k in (1, 5, 10)}
_SAME, _PROXY = f"{_D[1]} is not null and {_D[5]} is not null", f"{_D[1]} is null and {_D[5]} is null and flow_proxy_1d_pct - flow_proxy_5d_pct is not null"
FUSED = f"""{METRICS}, {FLOWS},
fused as (select m.*, {", ".join(f"{_D[k]}, coalesce({_D[k]}, flow_proxy_{k}d_pct) as flow_{k}d_pct, case when {_D[k]} is not null then 'direct' when flow_proxy_{k}d_pct is not null then 'cmf_proxy' else 'missing' end as flow_{k}d_source, case when {_D[k]} is not null then 1.0::double when flow_proxy_{k}d_pct is not null then 0.55 else 0 end as flow_{k}d_confidence" for k in (1, 5, 10))},
          case when {_SAME} then {_D[1]} - {_D[5]} / 5 when {_PROXY} then flow_proxy_1d_pct - flow_proxy_5d_pct end as flow_acceleration,
          case when {_SAME} then 'direct_same' when {_PROXY} then 'cmf_same' else 'not_comparable' end as flow_acceleration_source
          from metrics m left join flows using (kind, code, as_of))"""
_G = ", ".join(GROUP)


def _signal(value: str, by: str, members: str, confidence: str) -> str:
    return f"0.5 + (case when {members} over (partition by {by}) >= 3 then {rank_of(value, by)} else 0.5 end - 0.5) * {confidence}"


RANKED = f"""{FUSED},
strong as (select *, ret_5d - median(ret_5d) over (partition by {_G}) as rs_5d, ret_10d - median(ret_10d) over (partition by {_G}) as rs_10d,
           greatest(last_amount, 0) / nullif(sum(greatest(last_amount, 0)) over (partition by {_G}), 0) as amount_share from fused),
ranked as (select *, {", ".join(_signal(f"flow_{k}d_pct", f"{_G}, flow_{k}d_source", "count(*)", f"flow_{k}d_confidence") + f" as flow_{k}d_signal" for k in (1, 5, 10))},
           case when flow_acceleration is not null and flow_acceleration_source <> 'not_comparable' then {_signal("flow_acceleration", f"{_G}, flow_acceleration_source", "count(flow_acceleration)", "least(flow_1d_confidence, flow_5d_confidence)")} else 0.5 end as flow_acceleration_signal
           from strong)"""


def weighted(weights: Mapping[str, float], flags: Mapping[str, str] | None = None) -> str:
    parts, total = [], []
    for name, weight in weights.items():
        signal = f"coalesce({name}, 0.5)" if name in SIGNALS else rank_of(name)
        flag = (flags or {}).get(name)
        parts.append(f"{signal} * {weight}::double" if flag is None else f"case when {flag} then {signal} * {weight}::double else 0 end")
        total.append(f"{weight}::double" if flag is None else f"case when {flag} then {weight}::double else 0 end")
    return f"({' + '.join(parts)}) / ({' + '.join(total)}) * 100"


CROWDING = "coalesce(least(18, greatest(0, distance_ma20 - 12) * 0.7 + case when ret_10d is null then null else greatest(0, ret_10d - 18) end * 0.5), 0)"
EARLY = "coalesce(least(22, case when ret_5d is null then null else greatest(0, ret_5d - 8) end * 0.9 + case when ret_10d is null then null else greatest(0, ret_10d - 15) end * 0.45), 0)"


def scored(source: str, ignition: Mapping[str, float], flags: Mapping[str, str] | None = None, coverage: str = "0.0::double") -> str:
    return f"""select *, {weighted(MAINLINE)} as mainline_score, greatest(0, least(100, {weighted(CONFIRMATION)} - {CROWDING})) as confirmation_score, {CROWDING} as crowding_penalty,
        greatest(0, least(100, {weighted(ignition, flags)} - {EARLY})) as ignition_score, {coverage} as ignition_history_coverage from {source}"""


def _ramp(x: str) -> str:
    return f"case when {x} is null then null else greatest(0, least(1, {x})) end"


SIDEWAYS = f"""100 * (0.25 * {_ramp("(18 - box_range_20d_pct) / 12")} + 0.20 * {_ramp("1 - abs(slope_20d) / 0.50")} + 0.20 * {_ramp("(55 - range_position_60d_pct) / 55")} + 0.15 * {_ramp("1 - distance_low_20d_pct / 12")}
        + 0.10 * coalesce({_ramp("(1.20 - volatility_ratio_5_20) / 0.80")}, 0.5) + 0.10 * case when drawdown_10d >= -8 and slope_5d >= -0.60 then 1 else 0 end)"""
_BOX = "level_lookback_days >= 40 and box_range_20d_pct <= 15 and abs(slope_20d) <= 0.35 and range_position_60d_pct <= 55 and distance_high_60d_pct <= -8"
_MAIN, _CANDIDATE = "slope_5d > 0 and ret_10d > 0 and coalesce(breadth, 0.5) >= 0.45", "slope_3d > 0 and acceleration > 0 and ret_10d < 18"
_MOVING = "ret_5d < 8 and ignition_history_coverage >= 0.40"
LABELS = f"""case when mainline_score >= 80 and {_MAIN} then 'mainline_core' when mainline_score >= 68 and {_MAIN} then 'mainline_watch' when confirmation_score >= 75 and {_CANDIDATE} then 'potential_start'
        when confirmation_score >= 65 and {_CANDIDATE} then 'watch' else 'ordinary' end as status,
        case when mainline_score >= 60 and slope_3d < 0 and acceleration < 0 then 'Decay' when crowding_penalty >= 8 and mainline_score >= 65 then 'Crowded' when mainline_score >= 80 and {_MAIN} then 'Mainline'
        when ignition_score >= 72 and {_MOVING} then 'Ignition' when ignition_score >= 60 and {_MOVING} then 'Seed' when mainline_score >= 62 and {_MAIN} then 'Diffusion' else 'Dormant' end as lifecycle"""
FIRST = f"""{RANKED},
sideways as (select *, {SIDEWAYS} as sideways_seed_score from ranked),
seeded as (select *, case when {_BOX} and sideways_seed_score >= 70 then 'sideways_seed' when {_BOX} and sideways_seed_score >= 60 then 'sideways_watch'
           when level_lookback_days < 40 then 'insufficient_data' else 'not_sideways' end as sideways_seed_status from sideways),
scored as ({scored("seeded", {k: w for k, w in IGNITION.items() if k not in TRAJECTORY})}),
first_pass as (select *, {LABELS} from scored)"""
_FLAGS = {c: "ref_1d is not null" if c.endswith("_1d") else "ref_3d is not null" if c.endswith("_3d") else "false" for c in TRAJECTORY}
_SEEN, _KNOWN = (" + ".join(f"case when {flag}{more.format(c)} then 1 else 0 end" for c, flag in _FLAGS.items()) for more in ("", " and {} is not null"))
SECOND = f"""{FIRST},
days as (select as_of, lag(as_of) over (order by as_of) as ref_1d, lag(as_of, 3) over (order by as_of) as ref_3d from (select distinct as_of from first_pass)),
placed as (select f.*, ref_1d, ref_3d, rank() over (partition by f.as_of, kind order by confirmation_score desc nulls last) as place from first_pass f join days using (as_of)),
moved as (select p.* exclude (mainline_score, confirmation_score, crowding_penalty, ignition_score, ignition_history_coverage, status, lifecycle), p.ignition_score as ignition_score_pass1,
          a.place - p.place as confirmation_score_rank_velocity_1d, b.place - p.place as confirmation_score_rank_velocity_3d, p.confirmation_score - a.confirmation_score as confirmation_score_delta_1d,
          p.breadth - a.breadth as breadth_delta_1d, null::double as breadth_delta_intraday, p.amount_share - a.amount_share as amount_share_delta_1d, null::double as amount_share_delta_intraday
          from placed p left join placed a on a.as_of = p.ref_1d and a.kind = p.kind and a.code = p.code left join placed b on b.as_of = p.ref_3d and b.kind = p.kind and b.code = p.code),
rescored as ({scored("moved", IGNITION, _FLAGS, f"coalesce(({_KNOWN})::double / nullif({_SEEN}, 0), 0)")}),
second_pass as (select *, {LABELS} from rescored)"""

SNAPSHOTS = """
bucketed as (select time_bucket(interval '6 hours', ts) as captured_at, event_type as kind, (user_id % 10)::varchar as code, value from events),
grouped as (select captured_at, kind, code, avg(value) as level, max(value) as top, min(value) as bottom, sum(value) as amount, avg(case when value > 50 then 1.0::double else 0 end) as breadth from bucketed group by captured_at, kind, code),
snapshots as (select captured_at, captured_at::date as snapshot_date, kind, code, least(100, level * 1.1::double) as mainline_score, least(100, top) as confirmation_score, least(100, top) as candidate_score, least(100, (level + top) / 2) as ignition_score, breadth,
              amount / nullif(sum(amount) over (partition by captured_at, kind), 0) as amount_share, top - level as ret_1d, level - bottom as ret_5d from grouped)"""
REFS = f"""{SNAPSHOTS},
moments as (select distinct captured_at, snapshot_date from snapshots),
closes as (select snapshot_date, max(captured_at) as closing from moments group by snapshot_date),
before as (select snapshot_date, lag(closing) over (order by snapshot_date) as ref_1d, lag(closing, 3) over (order by snapshot_date) as ref_3d from closes),
refs as (select captured_at, lag(captured_at) over (partition by snapshot_date order by captured_at) as ref_intraday, ref_1d, ref_3d from moments join before using (snapshot_date))"""
DAYS = f"""{SNAPSHOTS},
latest as (select * from snapshots where captured_at in (select max(captured_at) from snapshots group by snapshot_date)),
days as (select *, dense_rank() over (order by snapshot_date) as day, ret_1d - median(ret_1d) over (partition by snapshot_date, kind) as rs from latest),
met as (select a.kind, a.code, a.day, a.snapshot_date, b.day - a.day as "offset", b.mainline_score as later_score, b.rs as later_rs from days a join days b on a.kind = b.kind and a.code = b.code and b.day > a.day and b.day <= a.day + 10)"""
DETAIL = f"""{DAYS},
signals as (select * from (select *, row_number() over (partition by day order by ignition_score desc, kind, code) as place from days where ignition_score >= 70) where place <= 10 and day < (select max(day) from days)),
nth as (select *, row_number() over (partition by kind, code, day order by later_rs is null, "offset") as nth from met),
after as (select kind, code, day, min("offset") filter (later_score >= 80) as lead_time_sessions, {", ".join(f"sum(later_rs) filter (nth <= {n}) as forward_rs_{n}d" for n in (3, 5, 10))} from nth group by kind, code, day),
detail as (select snapshot_date as signal_date, kind, code, ignition_score, ret_5d as alert_ret_5d, lead_time_sessions is not null as became_mainline, lead_time_sessions, lead_time_sessions is null as false_start,
           forward_rs_3d, forward_rs_5d, forward_rs_10d from signals left join after using (kind, code, day))"""

STOCKS = """
months as (select lpad(l_suppkey::varchar, 6, '0') as stock_code, date_trunc('month', l_shipdate)::date as date, avg(l_extendedprice / l_quantity) as close, max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
           sum(l_quantity) as volume, sum(l_extendedprice) as amount, avg(l_quantity) as turn from lineitem group by 1, 2),
stock_bars as (select *, (high + low) / 2 as open from months),
constituents as (select n_name as board, lpad(s_suppkey::varchar, 6, '0') as stock_code, s_name as name, n_regionkey from supplier join nation on s_nationkey = n_nationkey)"""
SYNTHETIC = f"""{STOCKS},
chosen as (select board, stock_code from (select board, stock_code, row_number() over (partition by board order by stock_code) as place from constituents) where place <= 24),
valid as (select board, stock_code, count(*) over (partition by board) as members from chosen where stock_code in (select stock_code from stock_bars group by 1 having count(*) >= 12)),
relative as (select *, {", ".join(f"case when lag(close) over w > 0 then {c} / lag(close) over w - 1 end as r_{c}" for c in ("open", "high", "low", "close"))} from stock_bars window w as (partition by stock_code order by date)),
dated as (select board, date, max(members) as members, count(r_close) as available, avg(r_open) as r_open, avg(r_high) as r_high, avg(r_low) as r_low, avg(r_close) as r_close, sum(amount) as amount, sum(volume) as volume, avg(turn) as turnover
          from relative join valid using (stock_code) where members >= 3 group by board, date),
levels as (select *, available >= least(3, members) as valid, exp(sum(case when available >= least(3, members) and r_close > -1 then ln(1 + r_close) else 0 end) over (partition by board order by date rows unbounded preceding)) * 100 as close from dated),
chained as (select *, coalesce(lag(close) over (partition by board order by date), 100) as previous from levels),
synthetic as (select board, date, previous * (1 + coalesce(r_open, r_close)) as open, greatest(previous * (1 + coalesce(r_open, r_close)), previous * (1 + coalesce(r_high, r_close)), close) as high, least(previous * (1 + coalesce(r_open, r_close)), previous * (1 + coalesce(r_low, r_close)), close) as low, close, amount, volume, turnover,
              available as constituent_count, available / members as synthetic_coverage from chained where valid),
log_index as (select *, ln(open) as ln_open, ln(high) as ln_high, ln(low) as ln_low, ln(close) as ln_close from synthetic)"""

REPORTS = """
quarters as (select l_suppkey, year(l_shipdate) as y, quarter(l_shipdate) as q, sum(l_extendedprice * (1 - l_discount)) as revenue, sum(l_extendedprice * (0.055::double - l_discount)) as net_profit, sum(l_extendedprice * (l_tax - 0.02::double)) as ocf,
             sum(l_extendedprice) as gross from lineitem group by 1, 2, 3),
dates as (select l_suppkey, y, q, sum(revenue) over w as revenue, sum(net_profit) over w as net_profit, sum(ocf) over w as ocf, sum(gross) over w as gross from quarters window w as (partition by l_suppkey, y order by q rows unbounded preceding)),
performance as (select a.y::varchar || ['0331', '0630', '0930', '1231'][a.q] as report_date, lpad(a.l_suppkey::varchar, 6, '0') as code, a.revenue, a.net_profit, case when a.l_suppkey % 7 <> 0 then a.ocf end as operating_cashflow,
                a.ocf / 1000 as ocfps, case when a.l_suppkey % 5 <> 0 then a.revenue / 5000 end as bvps_reported, 100 * (a.net_profit / nullif(a.revenue, 0)) as roe_h1_pct, 100 * ((a.revenue - 0.6::double * a.gross) / nullif(a.revenue, 0)) as gross_margin_pct from dates a)"""
_FIGURES = ("revenue", "net_profit", "operating_cashflow", "ocfps", "bvps_reported", "roe_h1_pct", "gross_margin_pct")


def _ttm(name: str, figure: str) -> str:
    exact = f"{figure}_ann + {figure}_cur - {figure}_pri"
    return f"""coalesce({exact}, {figure}_cur * factor) as ttm_{name}, case when {exact} is not null then 'EXACT_TTM' when {figure}_cur is not null then method else 'MISSING' end as ttm_{name}_method,
        case when {exact} is not null then 1.0::double when {figure}_cur is not null then sure else 0 end as ttm_{name}_confidence"""


#: Trailing figures of every code at every period that a report of it serves.
TRAILING = f"""{REPORTS},
ways as (select * from (values ('0331', 4.0::double, 'ANNUALIZED_Q1', 0.35::double), ('0630', 2.0::double, 'ANNUALIZED_H1', 0.55::double), ('0930', 4.0::double / 3, 'ANNUALIZED_Q3', 0.70::double), ('1231', 1.0::double, 'EXACT_TTM', 1.0::double)) as w(e, factor, method, sure)),
serving as (select report_date as period, 'cur' as tag, * from performance union all select (report_date[:4]::int + 1)::varchar || report_date[5:], 'pri', * from performance
            union all select (report_date[:4]::int + 1)::varchar || e, 'ann', p.* from performance p, ways where report_date[5:] = '1231'),
wide as (select period, code, {", ".join(f"max({c}) filter (tag = '{tag}') as {c}_{tag}" for c in _FIGURES for tag in ("cur", "pri", "ann"))} from serving group by period, code),
trailed as (select *, {_ttm("revenue", "revenue")}, {_ttm("profit", "net_profit")}, {_ttm("operating_cashflow", "operating_cashflow")}, ocfps_cur * factor as fallback_ocfps from wide join ways on e = period[5:])"""
#: The periods due by the last quote, their coverage, and the one to use.
PERIODS = f"""
today as (select max(l_shipdate)::date as d from lineitem where l_suppkey in (select s_suppkey from supplier)),
made as (select (year(d) - back)::int as y, e from today, range(4) as b(back), (values (10, 31, '0930'), (8, 31, '0630'), (4, 30, '0331')) as m(month, day, e) where make_date(year(d) - back, month, day) <= d),
periods as (select y::varchar || e as period, (y - 1)::varchar || e as prior, (y - 1)::varchar || '1231' as annual from made order by y desc, e desc limit 8),
reported as (select distinct report_date, code from performance),
covered as (select period, count(r.code) as reports, count(q.s_suppkey) as in_spot, count(p.code) as prior, count(a.code) as annual from periods left join reported r on r.report_date = period left join supplier q on lpad(q.s_suppkey::varchar, 6, '0') = r.code
            left join reported p on p.code = r.code and p.report_date = periods.prior left join reported a on a.code = r.code and a.report_date = periods.annual group by period),
shares as (select period, in_spot / (select count(*) from supplier) as current_coverage, coalesce(prior / nullif(reports, 0), 0) as prior_coverage, coalesce(annual / nullif(reports, 0), 0) as annual_coverage from covered),
chosen as (select *, coalesce(period = (select max(period) from shares where least(current_coverage, prior_coverage, annual_coverage) >= {fundamentals.LEAST_COVERAGE}::double), false) as selected from shares)"""
TTM = f"""{TRAILING},{PERIODS},
ttm as (select t.* from trailed t join chosen using (period) where selected)"""
#: From quotes beside trailing figures to values a share and multiples.
VALUED = """valued as (select *, ttm_profit / shares_outstanding as ttm_eps, coalesce(ttm_operating_cashflow / shares_outstanding, fallback_ocfps) as ttm_ocfps, case when ttm_profit > 0 and market_cap > 0 then market_cap / ttm_profit end as pe_ttm_calc,
           case when ttm_revenue > 0 and market_cap > 0 then market_cap / ttm_revenue end as ps_ttm_calc, ttm_revenue / shares_outstanding as sps_ttm, book / shares_outstanding as bvps,
           case when bvps_reported_cur > 0 and bvps_reported_pri > 0 then (bvps_reported_cur + bvps_reported_pri) / 2 * shares_outstanding end as average_equity from shared),
master as (select *, coalesce(case when coalesce(average_equity, book) > 0 then ttm_profit / coalesce(average_equity, book) * 100 end, roe_h1_pct_cur * factor) as ttm_roe_pct,
           coalesce(case when ttm_profit > 0 then ttm_operating_cashflow / ttm_profit end, case when ttm_eps > 0 then ttm_ocfps / ttm_eps end) as cash_conversion from valued)"""
MASTER = f"""{TTM},
monthly as (select l_suppkey, date_trunc('month', l_shipdate)::date as month, avg(l_extendedprice / l_quantity) as price from lineitem group by 1, 2),
priced_last as (select l_suppkey, max_by(price, month) as price from monthly group by 1),
spot as (select lpad(s_suppkey::varchar, 6, '0') as code, s_name as name, price, case when s_acctbal > 0 then s_acctbal * 1000 end as market_cap, case when s_acctbal > 0 and s_suppkey % 11 <> 0 then 0.5::double + (s_acctbal % 500) / 100 end as pb
         from supplier left join priced_last on l_suppkey = s_suppkey),
shared as (select *, case when market_cap > 0 and price > 0 then market_cap / price end as shares_outstanding, case when pb > 0 and market_cap > 0 then market_cap / pb end as book from spot left join ttm using (code)),
{VALUED}"""
#: As MASTER, for every stock and month: what could be known then. Its key is the stock's code and the month.
MONTHS = f"""{TRAILING},
month_prices as (select l_suppkey, date_trunc('month', l_shipdate)::date as as_of, avg(l_extendedprice / l_quantity) as price, max(l_shipdate)::date as quote_day from lineitem group by 1, 2),
grown_prices as (select *, price / first_value(price) over (partition by l_suppkey order by as_of) as price_growth from month_prices),
spot as (select as_of, lpad(s_suppkey::varchar, 6, '0') as stock, s_name as name, price, quote_day, case when s_acctbal > 0 then s_acctbal * 1000 * price_growth end as market_cap,
         case when s_acctbal > 0 and s_suppkey % 11 <> 0 then (0.5::double + (s_acctbal % 500) / 100) * price_growth end as pb from supplier join grown_prices on l_suppkey = s_suppkey),
calendar as (select as_of, max(quote_day) as d, count(distinct stock) as quoted from spot group by as_of),
made as (select as_of, quoted, (year(d) - back)::int as y, e from calendar, range(4) as b(back), (values (10, 31, '0930'), (8, 31, '0630'), (4, 30, '0331')) as m(month, day, e) where make_date(year(d) - back, month, day) <= d),
due as (select as_of, quoted, y::varchar || e as period from made qualify row_number() over (partition by as_of order by y desc, e desc) <= 8),
filed as (select period, code, bool_or(tag = 'pri') as has_pri, bool_or(tag = 'ann') as has_ann from serving group by period, code having bool_or(tag = 'cur')),
filed_whole as (select period, count(*) as reports, sum(has_pri::int) as prior, sum(has_ann::int) as annual from filed group by period),
filed_met as (select as_of, period, count(*) as in_spot from due join spot using (as_of) join filed using (period) where filed.code = spot.stock group by as_of, period),
covered as (select as_of, period, coalesce(in_spot / quoted, 0) as current_coverage, coalesce(prior / reports, 0) as prior_coverage, coalesce(annual / reports, 0) as annual_coverage from due left join filed_whole using (period) left join filed_met using (as_of, period)),
chosen as (select *, coalesce(period = max(case when least(current_coverage, prior_coverage, annual_coverage) >= {fundamentals.LEAST_COVERAGE}::double then period end) over (partition by as_of), false) as selected from covered),
shared as (select s.*, c.period, t.* exclude (period, code), stock || '@' || strftime(as_of, '%Y%m') as code, case when market_cap > 0 and price > 0 then market_cap / price end as shares_outstanding, case when pb > 0 and market_cap > 0 then market_cap / pb end as book
           from spot s left join (select as_of, period from chosen where selected) c using (as_of) left join trailed t on t.period = c.period and t.code = s.stock),
{VALUED}"""
SECTORS = f"""{MASTER},
x as (select 'sector_' || n_regionkey as sector, m.* from (select lpad(s_suppkey::varchar, 6, '0') as code, n_regionkey from supplier join nation on s_nationkey = n_nationkey) join master m using (code) where market_cap > 0),
sectors as (select sector, count(*) as constituents, sum(market_cap) as market_cap, sum(market_cap) filter (ttm_profit is not null) / case when sum(ttm_profit) > 0 then sum(ttm_profit) end as aggregate_pe,
            sum(market_cap) filter (ttm_profit > 0) / case when sum(ttm_profit) filter (ttm_profit > 0) > 0 then sum(ttm_profit) filter (ttm_profit > 0) end as positive_profit_pe,
            sum(market_cap) filter (pb > 0) / nullif(sum(market_cap / pb) filter (pb > 0), 0) as pb, sum(market_cap) filter (ttm_revenue > 0) / nullif(sum(ttm_revenue) filter (ttm_revenue > 0), 0) as ps,
            sum(revenue_cur) filter (revenue_cur > 0 and revenue_pri > 0) / nullif(sum(revenue_pri) filter (revenue_cur > 0 and revenue_pri > 0), 0) - 1 as revenue_growth,
            sum(net_profit_cur) filter (net_profit_pri is not null) / case when sum(net_profit_pri) filter (net_profit_cur is not null) > 0 then sum(net_profit_pri) filter (net_profit_cur is not null) end - 1 as profit_growth,
            median(gross_margin_pct_cur) as gross_margin_pct, coalesce(sum(market_cap) filter (ttm_profit > 0), 0) / sum(market_cap) as profitable_mcap_coverage, coalesce(sum(market_cap) filter (ttm_profit <= 0), 0) / sum(market_cap) as loss_mcap_share,
            coalesce(sum(market_cap) filter (pb > 0), 0) / sum(market_cap) as pb_mcap_coverage, coalesce(sum(market_cap) filter (ttm_operating_cashflow is not null), 0) / sum(market_cap) as ocf_mcap_coverage,
            least(coalesce(sum(market_cap) filter (ttm_revenue is not null), 0), coalesce(sum(market_cap) filter (ttm_profit is not null), 0), coalesce(sum(market_cap) filter (revenue_cur > 0 and revenue_pri > 0), 0), coalesce(sum(market_cap) filter (net_profit_cur is not null and net_profit_pri is not null), 0)) / sum(market_cap) as data_coverage,
            sum(ttm_operating_cashflow) / case when sum(market_cap) filter (ttm_operating_cashflow is not null) > 0 then sum(market_cap) filter (ttm_operating_cashflow is not null) end as ocf_yield from x group by sector)"""


def statistics(name: str, source: str) -> str:
    """Rows (code, date, v) of ``source`` to statistics by code."""
    return f"""{name}_ready as (select *, lag(v) over (partition by code order by date) as before, abs(v - median(v) over (partition by code)) as off from {source}),
{name}_counted as (select code, count(*) as points, greatest(-0.95, least(0.95, corr(v, before))) as rho, quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) as q, median(off) as mad from {name}_ready group by code),
{name}_sized as (select *, case when points < 3 or rho is null then points else least(points, greatest(1, points * (1 - rho) / (1 + rho))) end as effective_points from {name}_counted),
{name} as (select *, least(1, effective_points / 30) as confidence, case when points < 30 then 'INSUFFICIENT_POINTS' when effective_points < 6 then 'INSUFFICIENT_EFFECTIVE_POINTS' else 'OK' end as status from {name}_sized)"""


def query(ctes: str, source: str, columns: str) -> str:
    return f"with {ctes.strip()}\nselect {columns} from {source}"


BOARD = ("kind", "code", "as_of::varchar as as_of")
