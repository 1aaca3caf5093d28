"""The completeness audit on planted faults, and the calendar it expects."""

import datetime

from pyspark.sql import functions as F

from tidegauge.operators import audit

DAYS = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(40)]


def test_stale_and_gap(spark):
    """A board that ends early is stale, one that misses a session has a gap; sessions after the cutoff are not expected."""
    cutoff = DAYS[-2]
    dates = {"whole": DAYS, "current": DAYS[:-1], "stale": DAYS[:-4], "gap": DAYS[:20] + DAYS[21:], "old_gap": DAYS[:3] + DAYS[4:], "late": DAYS[25:]}
    bars = spark.createDataFrame([("industry", code, d, 1.0, 1.0, 1.0, 1.0, "lines") for code, ds in dates.items() for d in ds], "kind string, code string, date date, open double, high double, low double, close double, data_source string")
    source = bars.select("kind", "code").distinct().withColumn("name", F.col("code"))
    failures = spark.createDataFrame([], "kind string, code string, name string, error string")
    flows = [F.lit(1.0).alias(f"flow_{n}d_pct") for n in audit.WINDOWS]
    got = {r.code: r for r in audit.rows(source, source, bars, failures, source.select("kind", "name", *flows), source.select("kind", "code", *flows), F.lit(cutoff)).collect()}
    assert {code: r.audit_status for code, r in got.items()} == {"whole": "complete", "current": "complete", "stale": "stale", "gap": "gap", "old_gap": "complete", "late": "complete"}
    assert {code: (r.missing_count, r.stale_sessions, r.missing_trading_dates) for code, r in got.items() if r.missing_count} == {
        "stale": (3, 3, ",".join(str(d) for d in DAYS[-4:-1])), "gap": (1, 0, str(DAYS[20])),
    }


def test_statuses(spark):
    """An error matters only without a history; a flow needs all windows; shares are of the target."""
    bar = lambda code, d, *x: ("concept", code, d, *x, "lines")
    good = (1.0, 1.0, 1.0, 1.0)
    odd = {"open_outside": (5.0, 2.0, 1.0, 1.5), "close_above": (1.0, 2.0, 1.0, 3.0), "no_close": (1.0, 1.0, 1.0, None)}
    codes = ["erred", "one_window", *odd]
    bars = spark.createDataFrame([bar(code, d, *(odd.get(code, good) if k == 5 else good)) for code in codes for k, d in enumerate(DAYS)], "kind string, code string, date date, open double, high double, low double, close double, data_source string")
    source = spark.createDataFrame([("concept", c, c) for c in [*codes, "short", "lost", "left_out"]], "kind string, code string, name string")
    failures = spark.createDataFrame([("concept", c, c, e) for c, e in (("erred", "too_short"), ("short", "too_short"), ("lost", "timeout"))], "kind string, code string, name string, error string")
    flows = spark.createDataFrame([("concept", c, 1.0, 1.0, None if c == "one_window" else 1.0) for c in codes], "kind string, name string, flow_1d_pct double, flow_5d_pct double, flow_10d_pct double")
    scored = spark.createDataFrame([("concept", c, None, None, None) for c in codes], "kind string, code string, flow_1d_pct double, flow_5d_pct double, flow_10d_pct double")
    found = audit.rows(source, source.filter("code <> 'left_out'"), bars, failures, flows, scored, F.lit(DAYS[-1]))
    assert {r.code: r.audit_status for r in found.collect()} == {"erred": "complete", "one_window": "partial_flow", "open_outside": "complete", "close_above": "bad_quality", "no_close": "bad_quality", "short": "too_short", "lost": "failed", "left_out": "filtered"}
    total = next(r for r in audit.summary(found).collect() if r.kind == "all")
    assert (total.universe, total.filtered, total.target, total.history_success, total.scored, total.omitted, total.warnings) == (8, 1, 7, 5, 5, 2, 3)
    assert (total.target_coverage_pct, total.flow_1d_match_pct, total.flow_10d_available_pct) == (71.43, 71.43, 57.14)


def test_an_audit_deals_its_lines_once(spark):
    """The bars are written once; none of the audit's stages reads the landed lines again."""
    from tidegauge.plans import auditing

    bars = auditing.bars(spark, "/root/testdata/sf0.001")
    plan = auditing.rows(bars)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and "l_partkey" not in plan
