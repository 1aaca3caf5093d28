"""What a month's valuation may know: reports due by then, multiples and residuals up to then, the target before it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import fundamentals, history, trajectory, valuation

DAY = dt.date.fromisoformat


def test_the_period_of_each_month(spark):
    filed = [(p, c) for p in ("20190331", "20180331", "20181231", "20190630", "20180630", "20190930", "20180930", "20171231", "20170930") for c in "abcde"]
    performance = spark.createDataFrame([*filed, ("20200331", "a"), ("20191231", "a")], "report_date string, code string")
    days = {"2019-04-01": "2019-04-29", "2019-05-01": "2019-05-31", "2019-09-01": "2019-09-10", "2019-11-01": "2019-11-01", "2020-05-01": "2020-05-20"}
    quotes = spark.createDataFrame([(DAY(m), c, DAY(d)) for m, d in days.items() for c in "abcde"], "as_of date, code string, quote_trade_date date")
    got = {str(r.as_of): r.period for r in fundamentals.period_panel(performance, quotes).filter("selected").collect()}
    # the first quarter of 2019 counts from the end of April on; one report of five is not enough for that of 2020
    assert got == {"2019-04-01": "20180930", "2019-05-01": "20190331", "2019-09-01": "20190630", "2019-11-01": "20190930", "2020-05-01": "20190930"}


@pytest.mark.parametrize(("period", "want"), [("20190930", (160.0, "EXACT_TTM", 1.0)), ("20200630", (None, "MISSING", 0.0)), ("20180930", (40.0 * (4 / 3), "ANNUALIZED_Q3", 0.70)), ("20181231", (100.0, "EXACT_TTM", 1.0))])
def test_trailing_figures_of_a_period(spark, period, want):
    rows = [("20180930", "a", 40.0), ("20181231", "a", 100.0), ("20190930", "a", 100.0), ("20171231", "a", 80.0)]
    empty = [c for c in fundamentals.FIGURES if c != "revenue"]
    performance = spark.createDataFrame(rows, "report_date string, code string, revenue double").withColumns({c: F.lit(None).cast("double") for c in empty})
    found = [(r.ttm_revenue, r.ttm_revenue_method, r.ttm_revenue_confidence) for r in fundamentals.ttm_panel(performance).filter(F.col("period") == period).collect()]
    if period == "20200630":
        assert found == []  # nothing serves it but the year before's half year, which is not there
    else:
        assert found == [want] and found == [(r.ttm_revenue, r.ttm_revenue_method, r.ttm_revenue_confidence) for r in fundamentals.ttm(performance, period).collect()]


def test_history_ends_where_the_row_stands(spark):
    """Changed values of later days change nothing before them."""
    days = [DAY(f"2020-{m:02d}-01") for m in range(1, 13)]
    rows = spark.createDataFrame([("s", d, f"s@{d}") for d in days], "stock string, as_of date, code string")

    def medians(values, including):
        past = spark.createDataFrame([("s", d, float(v)) for d, v in zip(days, values, strict=True)], "stock string, date date, residual double")
        known = history.known_at(rows, past, "stock", "as_of", "date", including)
        return {r.code: (r.points, r["median"]) for r in history.stats(known, "code", "residual", "date").collect()}

    values = [5, 1, 4, 2, 8, 3, 9, 7, 6, 0, 11, 10]
    changed = values[:6] + [1000] * 6
    for including in (False, True):
        a, b = medians(values, including), medians(changed, including)
        for k, d in enumerate(days[: 6 + (not including)]):
            assert a.get(f"s@{d}") == b.get(f"s@{d}")
            known = sorted(values[: k + including])
            assert a.get(f"s@{d}") == (None if not known else (len(known), (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2))


def test_a_store_of_another_version(spark):
    assert trajectory.stored_status(None, "residual") == "MISSING" == trajectory.stored_status(["code", "price"], "residual")
    assert trajectory.stored_status(["code", "residual"], "residual") == "VERSION_MISMATCH" == trajectory.stored_status(["code", "residual", "model_version"], "residual")
    assert trajectory.stored_status(["residual", "model_version", "config_hash"], "residual") == ""
    stored = spark.createDataFrame([("a", "own-1", "x"), ("b", "own-0", "x"), ("c", "own-1", "y")], "code string, model_version string, config_hash string")
    assert [r.code for r in trajectory.of_version(stored, "own-1", "x").collect()] == ["a"]


def walk(spark, prices, **own):
    """Targets of one stock over months with fixed bands: bought up to 80, held up to 90, trimmed from 120, out from 150."""
    bands = {"deep_buy_price": 70.0, "buy_price": 80.0, "buy_exit_price": 90.0, "trim_price": 120.0, "exit_price": 150.0, "sigma": 0.2, "gate": "pass", "stage": "Mainline", "trade_band_source": "RESIDUAL_QUANTILES", "tradable": True}
    rows = [{**bands, "stock": "s", "n": k, "price": p, **{c: v[k] for c, v in own.items()}} for k, p in enumerate(prices)]
    kinds = "stock string, n int, price double, deep_buy_price double, buy_price double, buy_exit_price double, trim_price double, exit_price double, sigma double, gate string, stage string, trade_band_source string, tradable boolean"
    out = valuation.position_path(spark.createDataFrame(rows, kinds), "stock", "n").orderBy("n").collect()
    return [(r.previous_target, r.target_position, r.action) for r in out]


def test_a_target_stays_while_the_price_is_in_its_band(spark):
    got = walk(spark, [78.0, 85.0, 90.0, 91.0, 85.0, 60.0, 86.0])
    assert got == [(None, 70, "ADD_OR_HOLD"), (70, 70, "HOLD_HYSTERESIS"), (70, 70, "HOLD_HYSTERESIS"), (70, 40, "HOLD_OR_WAIT"), (40, 40, "HOLD_OR_WAIT"), (40, 100, "ADD_OR_HOLD"), (100, 100, "HOLD_HYSTERESIS")]


def test_rows_that_are_not_stored_pass_the_target_on(spark):
    got = walk(spark, [78.0, 85.0, 85.0, None, 85.0], tradable=[True, False, True, True, True], gate=["pass", "pass", "pass", "pass", "watch"])
    assert got == [(None, 70, "ADD_OR_HOLD"), (70, 0, "NO_TRADE"), (70, 70, "HOLD_HYSTERESIS"), (70, 0, "NO_TRADE"), (70, 25, "HOLD_OR_WAIT")]


def test_flags_in_their_order(spark):
    row = {"res_status": "MISSING", "trade_band_source": "MODEL_PRIOR_BANDS", "stage": "UNKNOWN", "model_weight_coverage": 0.5, "growth_regime": "LOW_BASE", "floor_hit": True, "cap_hit": True, "classification_confidence": 0.5, "revenue_growth": None, "profit_growth": 0.1, "model": "growth_pe"}
    kinds = "res_status string, trade_band_source string, stage string, model_weight_coverage double, growth_regime string, floor_hit boolean, cap_hit boolean, classification_confidence double, revenue_growth double, profit_growth double, model string"
    frame = spark.createDataFrame([tuple(row.values())], kinds)
    assert frame.select(valuation.risk_flags(frame)).first()[0] == "RESIDUAL_HISTORY_INSUFFICIENT;MODEL_PRIOR_BANDS;MAINLINE_UNKNOWN;LOW_MODEL_COVERAGE;LOW_BASE;FAIR_PE_FLOOR_HIT;FAIR_PE_CAP_HIT;SECTOR_LOW_CONFIDENCE;GROWTH_DATA_MISSING"
    quiet = frame.selectExpr("'OK' res_status", "'RESIDUAL_QUANTILES' trade_band_source", "'Seed' stage", "0.9d model_weight_coverage", "'NORMAL' growth_regime", "false floor_hit", "false cap_hit", "1.0d classification_confidence", "revenue_growth", "profit_growth", "'utility' model")
    assert quiet.select(valuation.risk_flags(quiet)).first()[0] == ""


def test_every_row_beside_its_past_in_one_pass(spark):
    """What rows joined with their past say of it, without that join: the plan has none, and what a row may know is the same."""
    import random

    draw = random.Random(7)
    kinds = "stock string, as_of date, code string, multiple double"
    days = [DAY("2020-01-01") + dt.timedelta(days=9 * k) for k in range(60)]
    flat = {"flat": 2.0}
    rows = spark.createDataFrame([(s, d, f"{s}@{d}", flat.get(s, draw.choice([None, -1.0, float("nan"), 1.5, *[draw.random() + 0.1] * 7]))) for s in ("a", "b", "flat") for d in days if draw.random() < 0.9], kinds)
    good = F.when(F.col("multiple") > 0, F.col("multiple")).otherwise(None)
    for including in (False, True):
        for most in (750, 35):
            got = history.with_past(rows, "stock", "as_of", {"m": good}, including, most)
            assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
            past = history.known_at(rows, rows.select("stock", F.col("as_of").alias("date"), "multiple").filter("multiple > 0 and not isnan(multiple)"), "stock", "as_of", "date", including)
            want = {r.code: r for r in history.stats(history.last_positive(past, "code", "multiple", "date", most), "code", "multiple", "date").collect()}
            seen = {r.code: r.past_m for r in got.collect()}
            assert {k for k, v in seen.items() if v is not None} == set(want) and len(seen) == rows.count()
            for code, r in want.items():
                assert seen[code].status == r.status
                for f in ("points", "effective_points", "confidence", "median", "q10", "q25", "q75", "q90", "mad"):
                    assert seen[code][f] == pytest.approx(r[f], rel=1e-9, abs=1e-12), (code, f)


def test_the_residuals_place_in_its_past(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], 2.0), ([1.0], None), (None, 1.0)], "past array<double>, now double")
    assert [r[0] for r in row.select(valuation.residual_place(F.col("past"), F.col("now"))).collect()] == [0.5, None, None]
