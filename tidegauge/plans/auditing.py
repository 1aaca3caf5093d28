"""The completeness audit on the landed tables, with SQL. Boards lose a stage by their number, so that every status occurs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.operators import audit
from tidegauge.plans import oracle as sql, panel
from tidegauge.sources import adapters

#: Days before the last bar's date of the last completed session, and of the last one that boards which went stale have.
CUTOFF, STALE = 7, 28


def _number() -> Column:
    return F.regexp_extract("code", r"(\d+)$", 1).cast("long")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars beside their flows, written once: all that an audit reads comes from them, and lines are dealt but once."""
    flows = [f"flow_{n}d_direct_pct" for n in audit.WINDOWS]
    return panel.cut(adapters.with_flows(adapters.funded_bars(spark, sf_dir)).select("kind", "code", "date", "high", "low", "close", "data_source", *flows))


def rows(lines: DataFrame) -> DataFrame:
    """The audit of ``lines``, as of ``bars``."""
    boards = panel.cut(lines.groupBy("kind", "code").agg(F.max("date").alias("last")))  # read by every stage; few beside the bars
    last = boards.agg(F.max("last")).first()[0]
    before = lambda days: F.date_sub(F.lit(last).cast("date"), days)
    source = boards.select("kind", "code").withColumn("name", F.when(_number() % 9 == 0, "shared").otherwise(F.col("code")))
    kept = lines.filter((_number() % 5 != 3) & ~((_number() % 8 == 5) & (F.col("date") > before(STALE))) & ~((_number() % 7 == 3) & (F.col("date") == before(2 * CUTOFF))))
    failures = source.withColumn("error", F.when(_number() % 10 == 7, "too_short").when(_number() % 10 == 9, "fetch_failed")).filter("error is not null")
    scored = source.filter(_number() % 6 != 1).withColumns({"flow_1d_pct": F.when(_number() % 2 == 0, 1.0), "flow_5d_pct": F.when(_number() % 3 != 0, 1.0), "flow_10d_pct": F.when(_number() % 7 == 0, 1.0)})
    flows = lines.filter(_number() % 3 != 0).select("kind", F.col("code").alias("name"), *[F.col(f"flow_{n}d_direct_pct").alias(f"flow_{n}d_pct") for n in audit.WINDOWS])
    return audit.rows(source, source.filter(_number() % 4 != 0), kept, failures, flows, scored, before(CUTOFF))


AUDIT = f"""{sql.BARS},
boards as (select *, case when number % 9 = 0 then 'shared' else code end as name from (select distinct kind, code, regexp_extract(code, '([0-9]+)$', 1)::bigint as number from bars)),
ended as (select max(date) as last from bars),
kept as (select b.* from bars b join boards using (kind, code), ended where number % 5 <> 3 and not (number % 8 = 5 and date > last - {STALE}) and not (number % 7 = 3 and date = last - {2 * CUTOFF})),
longest as (select kind, code from (select kind, code, row_number() over (partition by kind order by count(distinct date) desc, code) as place from kept group by kind, code) where place = 1),
expected as (select kind, date from (select kind, date, row_number() over (partition by kind order by date desc) as place from kept join longest using (kind, code)), ended where place <= {audit.CALENDAR_DAYS} and date <= last - {CUTOFF}),
history as (select kind, code, count(*) as history_rows, min(date) as first_date, max(date) as last_date, count(*) filter (not coalesce(close > 0, false)) as invalid_close,
            count(*) filter (high < low or close > high or close < low) as invalid_ohlc from kept group by kind, code),
due as (select h.kind, h.code, e.date, last_date from history h join expected e on e.kind = h.kind and e.date >= h.first_date),
gaps as (select kind, code, count(*) as missing_count, string_agg(strftime(date, '%Y-%m-%d'), ',' order by date) as missing_trading_dates, count(*) filter (date > last_date) as stale_sessions
         from due d anti join kept using (kind, code, date) group by kind, code),
staged as (select kind, code, name, false as duplicate_code, count(*) over (partition by kind, name) > 1 as duplicate_name, number % 4 <> 0 as is_target, coalesce(history_rows, 0) as history_rows, case when history_rows > 0 then 'lines' end as history_source,
           0 as duplicate_dates, coalesce(invalid_close, 0) as invalid_close, coalesce(invalid_ohlc, 0) as invalid_ohlc, coalesce(missing_count, 0) as missing_count, coalesce(missing_trading_dates, '') as missing_trading_dates,
           coalesce(stale_sessions, 0) as stale_sessions, number % 3 <> 0 as flow_1d_matched, number % 3 <> 0 as flow_5d_matched, number % 3 <> 0 as flow_10d_matched, number % 6 <> 1 as is_scored,
           number % 3 <> 0 or (number % 6 <> 1 and number % 2 = 0) as flow_1d_available, number % 3 <> 0 as flow_5d_available, number % 3 <> 0 or (number % 6 <> 1 and number % 7 = 0) as flow_10d_available, case number % 10 when 7 then 'too_short' when 9 then 'fetch_failed' end as error
           from boards left join history using (kind, code) left join gaps using (kind, code)),
audited as (select *, not is_scored as is_omitted, case when not is_target then 'filtered' when history_rows = 0 and error = 'too_short' then 'too_short' when history_rows = 0 then 'failed' when invalid_close + invalid_ohlc > 0 then 'bad_quality'
            when stale_sessions > 0 then 'stale' when missing_count > 0 then 'gap' when not is_scored then 'unscored' when not (flow_1d_available and flow_5d_available and flow_10d_available) then 'partial_flow' else 'complete' end as audit_status from staged)"""
_FLOWS = [f"flow_{n}d_{x}" for n in audit.WINDOWS for x in ("matched", "available")]
_PLAIN = ["kind", "code", "name", "duplicate_code", "duplicate_name", "is_target", "history_source", "missing_trading_dates", *_FLOWS, "is_scored", "audit_status", "is_omitted"]
_COUNTS = ["history_rows", "duplicate_dates", "invalid_close", "invalid_ohlc", "missing_count", "stale_sessions"]
_OF_TARGET = {"target": "true", "history_success": "history_rows > 0", "scored": "is_scored", "omitted": "is_omitted", "warnings": "audit_status in ('bad_quality', 'stale', 'gap', 'partial_flow')"}
_TOTALS = ["universe", "filtered", *_OF_TARGET]
_SHARED = {"target_coverage_pct": "is_scored"} | {f"flow_{n}d_{y}_pct": f"flow_{n}d_{x}" for x, y in (("matched", "match"), ("available", "available")) for n in audit.WINDOWS}
SUMMARY = f"""{AUDIT},
shares as (select coalesce(kind, 'all') as kind, count(*) as universe, count(*) filter (not is_target) as filtered, {", ".join(f"count(*) filter (is_target and {x}) as {n}" for n, x in _OF_TARGET.items())},
           {", ".join(f"round_even(count(*) filter (is_target and {x}) * 100.0::double / nullif(count(*) filter (is_target), 0), 2) as {n}" for n, x in _SHARED.items())} from audited group by rollup (kind))"""
_SHARES = list(_SHARED)

STATUS = f"""with {SUMMARY.strip()},
items as (unpivot (select {", ".join(f"{n}::double as {n}" for n in (*_TOTALS, *_SHARED))} from shares where kind = 'all') on columns(*) into name item value value)
select item, {sql.settled('value')} as value, case when ends_with(item, '_pct') then case when value >= 80 then 'PASS' else 'WARN' end when item in ('omitted', 'warnings') then case when value = 0 then 'PASS' else 'WARN' end else '' end as status from items"""

#: Name, plan, columns and SQL of each query.
ENTRIES = [
    ("audit_rows", lambda s, d: rows(bars(s, d)), [*_PLAIN, *_COUNTS], sql.query(AUDIT, "audited", sql.listed((), _PLAIN, _COUNTS))),
    ("audit_summary", lambda s, d: audit.summary(rows(bars(s, d))), ["kind", *_TOTALS, *_SHARES], sql.query(SUMMARY, "shares", sql.listed(_SHARES, ["kind"], _TOTALS))),
    ("audit_distribution", lambda s, d: audit.distribution(rows(bars(s, d))), ["audit_status", "history_source", "boards"], sql.query(AUDIT, "audited", "audit_status, history_source, count(*)::bigint as boards") + " group by all"),
    ("audit_sources", lambda s, d: audit.distributions(rows(bars(s, d))), ["by", "value", "history_source", "boards"], sql.query(AUDIT, "audited", "'status' as \"by\", audit_status as value, history_source, count(*)::bigint as boards") + " group by all union all select 'kind', kind, history_source, count(*) from audited group by all"),
    ("run_status", lambda s, d: audit.run_status(audit.summary(rows(bars(s, d)))), ["item", "value", "status"], STATUS),
]
