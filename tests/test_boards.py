"""Boards' bars, ranks and changes: the right figures, and plans that deal rows once."""

import re

import pytest
from pyspark.sql import Window, functions as F

from tidegauge.operators import canonical, scoring, trajectory
from tidegauge.plans import panel

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranks_among_parts_with_ties_and_nulls(spark):
    rows = spark.createDataFrame([("k", 1, str(i), v, p) for i, (v, p) in enumerate([(1.0, "a"), (2.0, "a"), (2.0, "a"), (None, "a"), (5.0, "b")])], "kind string, as_of int, code string, x double, part string")
    got = {r.code: (r.rank_x, r.held_x, r.size_x) for r in scoring.ranked(rows, {"x": (F.col("x"), F.col("part"))}).collect()}
    assert got == {"0": (1 / 3, 3, 4), "1": (2.5 / 3, 3, 4), "2": (2.5 / 3, 3, 4), "3": (None, 3, 4), "4": (1.0, 1, 1)}


@pytest.mark.parametrize("build, exchanges", [(panel.first_pass, 5), (panel.second_pass, 15)])
def test_scores_write_no_copy_and_multiply_no_rows(spark, build, exchanges):
    plan = plan_of(build(spark, DATA).select("kind", "code", "as_of", "mainline_score", "lifecycle"))
    assert "ExistingRDD" not in plan and "Generate" not in plan  # nothing is written between, and no row becomes one for each signal
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= exchanges


def exchanged(node):
    """Raw bytes of every exchange that ran under a plan; an exchange read twice counts once."""
    name = node.getClass().getSimpleName()
    if name == "ReusedExchangeExec":
        return 0
    inner = "executedPlan" if name == "AdaptiveSparkPlanExec" else "plan" if name.endswith("QueryStageExec") else None
    below = [getattr(node, inner)()] if inner else [node.children().apply(i) for i in range(node.children().size())]
    own = node.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(exchanged(x) for x in below)


@pytest.mark.parametrize("columns", [["mainline_score", "confirmation_score", "ignition_score", "ignition_score_pass1", "ignition_history_coverage", "status", "lifecycle"], ["lifecycle"]])
def test_what_travels_for_the_second_pass_is_short(spark, columns):
    made = panel.second_pass(spark, DATA).select("kind", "code", "as_of", *columns)
    rows = len(made.collect())
    assert exchanged(made._jdf.queryExecution().executedPlan()) / rows < 950  # the panel is dealt once, for the days and the scores; then scores and places travel


def test_ranks_made_of_places_are_the_ranks(spark):
    rows = spark.createDataFrame([("k", n % 3, str(n), None if n % 11 == 0 else float(n * n % 17)) for n in range(200)], "kind string, as_of int, code string, x double")
    found = scoring.ranked(rows, {"x": (F.col("x"), None)}).withColumnRenamed("rank_x", "want")
    assert scoring.replaced(found, ["x"]).filter("not (rank_x <=> want)").count() == 0


def test_labels_by_bits_are_those_of_the_rules(spark):
    """The bits travel for the second pass, so they must say of every row, unknown figures included, what the rules' own columns say."""
    from itertools import islice, product

    names = ["mainline_score", "confirmation_score", "ignition_score", "ignition_history_coverage", "slope_3d", "acceleration", "slope_5d", "ret_5d", "ret_10d", "breadth", "crowding_penalty"]
    values = [(59.9, 60.0, 62.0, 65.0, 68.0, 80.0), (64.9, 65.0, 75.0), (59.9, 60.0, 72.0), (0.39, 0.4), (-1.0, 0.0, 1.0, None), (-1.0, 1.0, None), (0.0, 1.0, None), (7.9, 8.0, None), (0.0, 1.0, 18.0, None), (0.44, 0.45, None), (0.0, 8.0)]
    rows = list(islice(product(*values), 0, None, 487))

    def rules(x):
        less, more = (lambda a, b: a is not None and a < b), (lambda a, b: a is not None and a > b)
        main = more(x["slope_5d"], 0) and more(x["ret_10d"], 0) and (0.5 if x["breadth"] is None else x["breadth"]) >= 0.45
        candidate = more(x["slope_3d"], 0) and more(x["acceleration"], 0) and less(x["ret_10d"], 18)
        moving, m, i, c = less(x["ret_5d"], 8) and x["ignition_history_coverage"] >= 0.4, x["mainline_score"], x["ignition_score"], x["confirmation_score"]
        status = [n for ok, n in ((m >= 80 and main, "mainline_core"), (m >= 68 and main, "mainline_watch"), (c >= 75 and candidate, "potential_start"), (c >= 65 and candidate, "watch"), (True, "ordinary")) if ok][0]
        falling = m >= 60 and less(x["slope_3d"], 0) and less(x["acceleration"], 0)
        stages = ((falling, "Decay"), (x["crowding_penalty"] >= 8 and m >= 65, "Crowded"), (m >= 80 and main, "Mainline"), (i >= 72 and moving, "Ignition"), (i >= 60 and moving, "Seed"), (m >= 62 and main, "Diffusion"), (True, "Dormant"))
        return status, [n for ok, n in stages if ok][0]

    table = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).withColumn("standing", scoring.standing())
    got = scoring.labelled(table.select("standing", "ignition_score", "ignition_history_coverage", *[F.col(n).alias(f"_{n}") for n in names])).collect()
    assert len({r.lifecycle for r in got}) == 7 and len({r.status for r in got}) == 5
    assert [(r.status, r.lifecycle) for r in got] == [rules({n: r[f"_{n}"] for n in names}) for r in got]


def test_weeks_of_odd_lines(spark, tmp_path):
    """A part of two brands counts in both, a part met twice in a week once; a week opens on its first day with lines; lines without day, brand or supplier are left out of what needs them."""
    from tidegauge.sources import adapters

    lines = [(1, 7, 1.0, 10.0, 0.01, "F", "2024-01-03"), (1, 7, 1.0, 30.0, 0.09, "O", "2024-01-03"), (2, 7, 2.0, 10.0, 0.05, "O", "2024-01-05"), (3, None, 1.0, 4.0, 0.0, "F", "2024-01-08"), (9, 7, 1.0, 8.0, 0.0, "F", "1969-12-31"), (1, 7, 1.0, 1.0, 0.0, "F", None), (None, 7, 1.0, 6.0, 0.0, None, "2024-01-05")]
    columns = "l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_linestatus string, day string"
    spark.createDataFrame(lines, columns).withColumn("l_shipdate", F.to_timestamp("day").cast("timestamp_ntz")).drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "A"), (9, None)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r.kind, r.code, str(r.date)): (r.open, r.high, r.low, r.volume, r.amount, r.up_count, r.down_count, r.net, r.turnover) for r in adapters.funded_bars(spark, str(tmp_path)).collect()}
    assert got == {
        ("industry", "A", "2024-01-01"): (20.0, 30.0, 5.0, 4.0, 50.0, 1, 1, -30.0, 2.0), ("industry", "B", "2024-01-01"): (20.0, 30.0, 10.0, 2.0, 40.0, 1, 1, -20.0, 2.0), ("industry", "A", "2024-01-08"): (4.0, 4.0, 4.0, 1.0, 4.0, 1, 0, 4.0, 1.0),
        ("concept", "7", "2024-01-01"): (20.0, 30.0, 5.0, 5.0, 56.0, 2, 1, -36.0, 5.0 / 3), ("concept", "7", "1969-12-29"): (8.0, 8.0, 8.0, 1.0, 8.0, 1, 0, 8.0, 1.0),
    }


def test_daily_changes_equal_those_of_snapshots(spark):
    days = [f"2024-01-{d:02d}" for d in range(1, 8)]
    rows = [(day, "k", code, float(i * 7 % 5) + n) for i, day in enumerate(days) for n, code in enumerate("abc") if (i + n) % 4]
    table = spark.createDataFrame(rows, "day string, kind string, code string, level double").select(F.to_timestamp("day").alias("captured_at"), F.to_date("day").alias("snapshot_date"), "kind", "code", *[F.col("level").alias(c) for c in trajectory.VALUES])
    want = trajectory.deltas(table)
    ranked = table.withColumn("breadth_rank", F.rank().over(Window.partitionBy("captured_at", "kind").orderBy(F.desc("breadth"))))
    got = trajectory.daily_deltas(ranked, trajectory.daily_calendar(table), ["breadth"], ["breadth_rank"])
    key = ["snapshot_date", "code", "breadth_delta_1d", "breadth_delta_3d"]
    assert sorted(got.select(*key).collect(), key=str) == sorted(want.select(*key).collect(), key=str)
    moved = lambda df, c: [tuple(r) for r in df.select("snapshot_date", "code", f"{c}_velocity_1d", f"{c}_velocity_3d").sort("snapshot_date", "code").collect()]
    assert moved(got, "breadth_rank") == moved(want, "mainline_score_rank")


def test_boards_of_one_name_do_not_meet_in_pairs(spark):
    wanted = spark.range(2000).select(F.col("id"), F.lit(0).alias("alias_pos"), F.concat(F.lit("a name"), (F.col("id") % 1).cast("string")).alias("alias"), F.lit("").alias("board_code"))
    catalog = spark.range(2000).select(F.format_string("%04d", "id").alias("code"), F.concat(F.lit("a name"), (F.col("id") % 1).cast("string"), F.lit("概念")).alias("name"))
    a = canonical.resolve_coded(wanted, catalog, exact_only=True)
    assert {r.code for r in a.collect()} == {"0000"} and a.count() == 2000
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[b#\d+\]", plan)  # of a name's boards one is left before they are met


def test_long_spans_are_put_together_of_short_ones(spark):
    from tidegauge.operators import metrics

    closes = [10.0, 11.0, None, 10.5, 0.0, 12.0] + [12.0] * 25 + [12.0 + (i * 7 % 11) for i in range(70)]
    rows = spark.createDataFrame([("k", "a", i, x, x and x + 1, x and x - 1, i % 5 + 1.0, 2.0) for i, x in enumerate(closes)], "kind string, code string, date int, close double, high double, low double, amount double, turnover double")
    made = metrics.bar_metrics(rows)
    got = made.toPandas().set_index("as_of")
    assert {int(k) for k in re.findall(r"RowFrame, -(\d+), currentrow", plan_of(made))} == {2, 4}  # no frame of more than five bars
    known = [(i, x) for i, x in enumerate(closes) if x is not None]
    for at, (i, x) in enumerate(known):
        if at >= 11:
            sixty, twenty = [y for _, y in known[max(0, at - 59) : at + 1]], [y for _, y in known[max(0, at - 19) : at + 1]]
            assert got.distance_high_60d_pct[i] == pytest.approx((x / (max(sixty) + 1) - 1) * 100)
            assert got.distance_ma20[i] == pytest.approx((x / (sum(twenty) / len(twenty)) - 1) * 100)
    assert got.trend_r2_20d[27] == 1.0 and got.volatility_20d[28] == 0.0 and got.slope_20d[28] == 0.0  # nothing moves, and nothing is left of rounding


def test_a_price_on_its_band_is_in_one_zone(spark):
    from tidegauge.operators import valuation
    from tidegauge.plans import policy

    rows = [(float(i), 10.0 + d, 8.0, 10.0, 10.2, 12.0, 13.0, "pass", "Seed", True, 0, "RESIDUAL_QUANTILES", 0.2) for i, d in enumerate((0.0, 2e-15, -2e-15))]
    names = "code double, price double, deep_buy_price double, buy_price double, buy_exit_price double, trim_price double, exit_price double, gate string, stage string, tradable boolean, previous_target int, trade_band_source string, sigma double"
    assert {r.zone for r in valuation.position(policy.compared(spark.createDataFrame(rows, names))).collect()} == {"value"}
