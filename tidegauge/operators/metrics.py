"""Trailing-window features of each board on each date: one sort by (kind, code), shared by every window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidegauge.functions.expr import clipped, ratio

#: Bars a board needs before it has metrics.
LEAST_BARS = 12


def board() -> WindowSpec:
    return Window.partitionBy("kind", "code").orderBy("date")


def last(n: int) -> WindowSpec:
    return board().rowsBetween(1 - n, 0)


def returns(k: int) -> Column:
    base = F.lag("close", k).over(board())
    return F.when(base > 0, (F.col("close") / base - 1) * 100)


def _block(c: str, n: int, line: bool = False) -> dict[str, Column]:
    """The moments of ``c`` over the last ``n`` bars."""
    over = lambda x: F.coalesce(x.over(last(n)), F.lit(0.0))
    count = F.count(c).over(last(n))
    found = {"count": count, "mean": over(F.avg(c)), "squares": over(F.var_pop(c)) * count}
    if line:
        found["products"] = over(F.regr_sxy(c, "n"))
    return {f"{c}_{n}_{k}": x for k, x in found.items()}


def _joined(c: str, n: int, line: bool = False) -> dict[str, Column]:
    """The moments of ``c`` over the last 2 * ``n`` bars: of its last ``n`` and the ``n`` before."""
    now = lambda k: F.col(f"{c}_{n}_{k}")
    old = lambda k: F.coalesce(F.lag(f"{c}_{n}_{k}", n).over(board()), F.lit(0))
    count = now("count") + old("count")
    share = now("count") * old("count") / F.greatest(count, F.lit(1))
    step = now("mean") - old("mean")
    found = {"count": count, "mean": old("mean") + F.when(now("count") > 0, step * now("count") / F.greatest(count, F.lit(1))).otherwise(0.0), "squares": now("squares") + old("squares") + step * step * share}
    if line:  # of blocks without gaps, whose middles lie half their counts apart; others have no line
        found["products"] = now("products") + old("products") + step * count / 2 * share
    return {f"{c}_{2 * n}_{k}": x for k, x in found.items()}


def _whole(k: int, shrink: bool) -> Column:
    return F.col(f"ln_close_{k}_count") == (F.least(F.lit(k), F.col("n")) if shrink else F.lit(k))


def slope(k: int, shrink: bool = False) -> Column:
    """Least-squares slope of ln(close), in percent a bar; over fewer rows at a board's start only if ``shrink``."""
    m = F.col(f"ln_close_{k}_count")
    return F.when(_whole(k, shrink), ratio(F.col(f"ln_close_{k}_products"), m * (m * m - 1) / 12) * 100)


def fit(k: int, shrink: bool = False) -> Column:
    m, squares = F.col(f"ln_close_{k}_count"), F.col(f"ln_close_{k}_squares")
    exact = F.when(squares <= 1e-12, 1.0).otherwise(ratio(F.col(f"ln_close_{k}_products") * F.col(f"ln_close_{k}_products"), m * (m * m - 1) / 12 * squares))
    return F.when(_whole(k, shrink), clipped(exact, 0, 1))


def widened(rows: DataFrame) -> DataFrame:
    """``rows`` with what the features need of their last 3, 5, 10, 20 and 60 bars.

    Only spans of up to five bars are read bar by bar. A longer one is put together of two or three shorter ones, so that a bar costs the same whatever the span."""
    most = {"high_": F.coalesce("high", "close"), "close_": F.col("close")}
    sums = {"close_sum": F.col("close"), "amount_sum": F.col("amount"), "turnover_sum": F.col("turnover"), "flow_sum": F.col("multiplier") * F.col("amount"), "flowing_sum": F.when(F.col("multiplier").isNotNull(), F.col("amount"))}
    counted = {"close_n": F.col("close"), "amount_n": F.col("amount"), "turnover_n": F.col("turnover"), "rising_n": F.when(F.col("r") > 0, 1)}
    first = {f"{c}5": F.sum(x).over(last(5)) for c, x in sums.items()} | {f"{c}5": F.count(x).over(last(5)) for c, x in counted.items()}
    first |= {f"{c}5": F.max(x).over(last(5)) for c, x in most.items()} | {"low_5": F.min(F.coalesce("low", "close")).over(last(5))}
    out = rows.withColumns({**_block("ln_close", 3, True), **_block("ln_close", 5, True), **_block("r", 5), **first})
    for n in (5, 10):
        back = lambda c: F.lag(f"{c}{n}", n).over(board())  # noqa: E731, B023
        more = {f"{c}{2 * n}": F.when(F.col(f"{c}{n}").isNotNull() | back(c).isNotNull(), F.coalesce(f"{c}{n}", F.lit(0)) + F.coalesce(back(c), F.lit(0))) for c in (*sums, *counted)}
        more |= {f"{c}{2 * n}": F.greatest(f"{c}{n}", back(c)) for c in most} | {f"low_{2 * n}": F.least(f"low_{n}", back("low_"))}
        out = out.withColumns({**_joined("ln_close", n, True), **_joined("r", n), **more})
    return out.withColumns({"high_60": F.greatest("high_20", *[F.lag("high_20", k).over(board()) for k in (20, 40)]), "low_60": F.least("low_20", *[F.lag("low_20", k).over(board()) for k in (20, 40)])})


def bar_metrics(bars: DataFrame) -> DataFrame:
    """``bars`` with about forty features, for rows from the 12th bar of a board on. Bars without a close are dropped."""
    rows = bars.filter(F.col("close").isNotNull() & F.col("date").isNotNull())
    base = rows.withColumn("n", F.row_number().over(board())).withColumn("ln_close", F.when(F.col("close") > 0, F.log("close"))).withColumn("r", F.when(F.lag("close").over(board()) != 0, F.col("close") / F.lag("close").over(board()) - 1))
    span = F.col("high") - F.col("low")
    flow = F.when(F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("amount").isNotNull(), F.coalesce(clipped(ratio(2 * F.col("close") - F.col("high") - F.col("low"), span), -1, 1), F.lit(0.0)))
    base = widened(base.withColumn("multiplier", flow)).withColumns({"slope_3": slope(3), "slope_5": slope(5)})
    vol = {k: F.when(F.col(f"r_{k}_count") > 0, F.sqrt(F.col(f"r_{k}_squares") / F.greatest(f"r_{k}_count", F.lit(1)))) * 100 for k in (5, 10, 20)}
    top60, bottom60 = F.col("high_60"), F.col("low_60")
    mean = lambda c, k: ratio(F.col(f"{c}_sum{k}"), F.col(f"{c}_n{k}"))
    flowing = {1: (F.col("multiplier") * F.col("amount"), F.when(F.col("multiplier").isNotNull(), F.col("amount")))} | {k: (F.col(f"flow_sum{k}"), F.col(f"flowing_sum{k}")) for k in (5, 10)}
    features = {
        **{f"ret_{k}d": returns(k) for k in (1, 3, 5, 10, 20)},
        **{f"slope_{k}d": slope(k) for k in (3, 5, 10)},
        "slope_20d": slope(20, shrink=True),
        **{f"trend_r2_{k}d": fit(k) for k in (5, 10)},
        "trend_r2_20d": fit(20, shrink=True),
        "acceleration": F.coalesce(F.col("slope_3") - F.lag("slope_5", 3).over(board()), F.col("slope_3") - slope(10)),
        "positive_days_10": F.col("rising_n10") / F.least(F.lit(10), F.col("n")),
        **{f"volatility_{k}d": vol[k] for k in (5, 10, 20)},
        "volatility_ratio_5_20": F.when(vol[20] > 0, ratio(vol[5], vol[20])),
        "distance_ma20": (ratio(F.col("close"), mean("close", 20)) - 1) * 100,
        "distance_high20": (ratio(F.col("close"), F.col("close_20")) - 1) * 100,
        "box_range_20d_pct": (ratio(F.col("high_20"), F.col("low_20")) - 1) * 100,
        "distance_low_20d_pct": (ratio(F.col("close"), F.col("low_20")) - 1) * 100,
        "range_position_60d_pct": F.when(top60 - bottom60 > 0, (F.col("close") - bottom60) / (top60 - bottom60) * 100).otherwise(50.0),
        "distance_high_60d_pct": (ratio(F.col("close"), top60) - 1) * 100,
        "level_lookback_days": F.least(F.lit(60), F.col("n")),
        "amount_ratio_5_20": ratio(mean("amount", 5), mean("amount", 20)),
        "turnover_ratio_5_20": ratio(mean("turnover", 5), mean("turnover", 20)),
        "drawdown_10d": (ratio(F.col("close"), F.col("close_10")) - 1) * 100,
        **{f"flow_proxy_{k}d_pct": ratio(*flowing[k]) * 100 for k in (1, 5, 10)},
    }
    kept = [c for c in bars.columns if c not in ("kind", "code", "date")]
    out = base.select("kind", "code", F.col("date").alias("as_of"), *kept, F.col("n").alias("history_days"), F.col("close").alias("last_close"), F.col("amount").alias("last_amount"), *[e.alias(k) for k, e in features.items()])
    return out.filter(F.col("history_days") >= LEAST_BARS)
