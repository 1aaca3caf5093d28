"""Cross-sectional signals, weighted scores, and the labels they give."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.expr import at_least, clipped, holds, last_label, ramp

GROUP = ("kind", "as_of")

# The weights of the scores.
MAINLINE = {
    "ret_5d": 0.11, "ret_10d": 0.12, "slope_5d": 0.14, "slope_10d": 0.07, "trend_r2_10d": 0.07, "rs_10d": 0.10, "flow_5d_signal": 0.12, "flow_10d_signal": 0.06,
    "breadth": 0.08, "amount_ratio_5_20": 0.07, "positive_days_10": 0.06,
}
CONFIRMATION = {
    "acceleration": 0.18, "slope_3d": 0.13, "rs_5d": 0.09, "flow_1d_signal": 0.14, "flow_acceleration_signal": 0.10, "amount_ratio_5_20": 0.11, "turnover_ratio_5_20": 0.05,
    "breadth": 0.08, "trend_r2_5d": 0.07, "distance_high20": 0.05,
}
IGNITION = {
    "confirmation_score_rank_velocity_1d": 0.12, "confirmation_score_rank_velocity_3d": 0.08, "confirmation_score_delta_1d": 0.10, "breadth_delta_1d": 0.15, "breadth_delta_intraday": 0.05,
    "amount_share_delta_1d": 0.15, "amount_share_delta_intraday": 0.05, "flow_acceleration_signal": 0.10, "acceleration": 0.10, "amount_ratio_5_20": 0.06, "ret_1d": 0.04,
}
TRAJECTORY = list(IGNITION)[:7]
SIGNALS = {"flow_1d_signal", "flow_5d_signal", "flow_10d_signal", "flow_acceleration_signal"}


def ranked(rows: DataFrame, signals: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """``rows`` and for each signal (its value, and a column that parts its cross-sections further): ``rank_`` its average-tie percentile rank
    among the values of its part, null for null; ``place_`` twice its place there, a whole number, ``held_`` the values and ``size_`` the rows of that part.

    Every cross-section is dealt once, as all windows are of it or of a part of it; each signal sorts it where it lies. Ranks that nobody reads are pruned with their sorts."""
    out = rows
    for n, (value, part) in signals.items():
        out = out.withColumns({"_value": value.cast("double"), "_part": F.lit("") if part is None else part})
        by = Window.partitionBy(*GROUP, *([] if part is None else ["_part"])).orderBy(F.col("_value").asc_nulls_last())
        whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        held = F.count("_value").over(whole)
        place = F.when(F.col("_value").isNotNull(), F.rank().over(by) + F.count("_value").over(by))
        out = out.withColumns({f"place_{n}": place, f"rank_{n}": place / 2.0 / held, f"held_{n}": held, f"size_{n}": F.count("*").over(whole)}).drop("_value", "_part")
    return out


def replaced(rows: DataFrame, names: Iterable[str]) -> DataFrame:
    """``rows`` with the ranks of ``names`` made of their places (``place_``), which are shorter and so travel in their stead; not for signals ranked within parts."""
    whole = Window.partitionBy(*GROUP)
    return rows.withColumns({f"rank_{n}": F.col(f"place_{n}") / 2.0 / F.count(f"place_{n}").over(whole) for n in names})


FLOWS = ("flow_acceleration", "flow_1d", "flow_5d", "flow_10d")


def flow_signals(rows: DataFrame) -> DataFrame:
    """Flow ranks among boards of one source, drawn to 0.5 by the source's confidence; 0.5 in groups below three."""
    found = ranked(rows, {n: (F.col(n if n == "flow_acceleration" else f"{n}_pct"), F.col(f"{n}_source")) for n in FLOWS})
    out = {}
    for n in FLOWS[1:]:
        among = F.when(F.col(f"size_{n}") >= 3, F.coalesce(f"rank_{n}", F.lit(0.5))).otherwise(0.5)
        out[f"{n}_signal"] = 0.5 + (among - 0.5) * F.col(f"{n}_confidence")
    value, source = F.col("flow_acceleration"), F.col("flow_acceleration_source")
    confidence = F.least("flow_1d_confidence", "flow_5d_confidence")
    among = F.when(F.col("held_flow_acceleration") >= 3, F.coalesce("rank_flow_acceleration", F.lit(0.5))).otherwise(0.5)
    out["flow_acceleration_signal"] = F.when(value.isNotNull() & (source != "not_comparable"), 0.5 + (among - 0.5) * confidence).otherwise(0.5)
    return found.withColumns(out).drop(*[f"{x}_{n}" for n in FLOWS for x in ("place", "rank", "held", "size")])


def weighted(weights: Mapping[str, float], present: Mapping[str, Column] | None = None) -> Column:
    """100 * sum(weight * signal) / sum(weight), over the columns that are present for the cross-section.

    ``present``: for a column that some cross-sections lack as a whole, whether this one has it. Columns other than signals
    count by their ranks, which ``ranked`` has added.
    """
    present = present or {}
    parts, total = [], []
    for name, weight in weights.items():
        signal = F.coalesce(F.col(name), F.lit(0.5)) if name in SIGNALS else F.coalesce(f"rank_{name}", F.lit(0.5))
        here = present.get(name)
        parts.append(signal * weight if here is None else F.when(here, signal * weight).otherwise(0.0))
        total.append(F.lit(weight) if here is None else F.when(here, F.lit(weight)).otherwise(0.0))
    return sum(parts[1:], parts[0]) / sum(total[1:], total[0]) * 100


def crowding() -> Column:
    raw = at_least(F.col("distance_ma20") - 12, 0) * 0.7 + at_least(F.col("ret_10d") - 18, 0) * 0.5
    return F.coalesce(F.when(raw.isNotNull(), F.least(raw, F.lit(18.0))), F.lit(0.0))


def early_crowding() -> Column:
    raw = at_least(F.col("ret_5d") - 8, 0) * 0.9 + at_least(F.col("ret_10d") - 15, 0) * 0.45
    return F.coalesce(F.when(raw.isNotNull(), F.least(raw, F.lit(22.0))), F.lit(0.0))


def _shown(found: DataFrame, out: Mapping[str, Column]) -> DataFrame:
    return found.select(*[c for c in found.columns if c not in out and not c.startswith(("held_", "size_"))], *[x.alias(n) for n, x in out.items()])


def ignition(weights: Mapping[str, float], early: Column, present: Mapping[str, Column] | None = None) -> Column:
    return clipped(weighted(weights, present) - early, 0, 100)


def ignited(rows: DataFrame, present: Mapping[str, Column] | None = None) -> DataFrame:
    """The ignition score and how much of its history is known; trajectory columns may be absent. A penalty that stands in the rows (early_penalty) is taken from there."""
    present = dict(present or {})
    weights = {k: w for k, w in IGNITION.items() if k in rows.columns or f"rank_{k}" in rows.columns}
    seen = [c for c in TRAJECTORY if c in rows.columns]
    here = [F.when(present.get(c, F.lit(True)), 1).otherwise(0) for c in seen]
    known = [F.when(present.get(c, F.lit(True)) & F.col(c).isNotNull(), 1.0).otherwise(0.0) for c in seen]
    count = sum(here[1:], here[0]) if seen else F.lit(0)
    coverage = F.when(count > 0, sum(known[1:], known[0]) / count).otherwise(0.0) if seen else F.lit(0.0)
    unranked = {n: (F.col(n), None) for n in weights if n not in SIGNALS and f"rank_{n}" not in rows.columns}
    found = ranked(rows, unranked) if unranked else rows
    early = F.col("early_penalty") if "early_penalty" in rows.columns else early_crowding()
    return _shown(found, {"ignition_score": ignition(weights, early, present), "ignition_history_coverage": coverage})


def scores(rows: DataFrame, present: Mapping[str, Column] | None = None) -> DataFrame:
    """mainline, confirmation (candidate), ignition scores with their penalties; trajectory columns may be absent."""
    unranked = {n: (F.col(n), None) for n in dict.fromkeys((*MAINLINE, *CONFIRMATION)) if n not in SIGNALS and f"rank_{n}" not in rows.columns}
    found = ranked(rows, unranked) if unranked else rows
    confirmation = clipped(weighted(CONFIRMATION) - crowding(), 0, 100)
    return ignited(_shown(found, {"mainline_score": weighted(MAINLINE), "confirmation_score": confirmation, "candidate_score": confirmation, "crowding_penalty": crowding()}), present)


def sideways(rows: DataFrame) -> DataFrame:
    c = F.col
    steady = F.when(holds((c("drawdown_10d") >= -8) & (c("slope_5d") >= -0.60)), 1.0).otherwise(0.0)
    score = 100 * (
        0.25 * ramp((18 - c("box_range_20d_pct")) / 12) + 0.20 * ramp(1 - F.abs("slope_20d") / 0.50) + 0.20 * ramp((55 - c("range_position_60d_pct")) / 55)
        + 0.15 * ramp(1 - c("distance_low_20d_pct") / 12) + 0.10 * F.coalesce(ramp((1.20 - c("volatility_ratio_5_20")) / 0.80), F.lit(0.5)) + 0.10 * steady
    )
    enough = c("level_lookback_days") >= 40
    box = enough & (c("box_range_20d_pct") <= 15) & (F.abs("slope_20d") <= 0.35) & (c("range_position_60d_pct") <= 55) & (c("distance_high_60d_pct") <= -8)
    status = last_label("not_sideways", (~enough, "insufficient_data"), (box & (c("sideways_seed_score") >= 60), "sideways_watch"), (box & (c("sideways_seed_score") >= 70), "sideways_seed"))
    return rows.withColumn("sideways_seed_score", score).withColumn("sideways_seed_status", status)


#: What the labels ask of a board but its ignition, in the bits of a number: four ways to its status, five to its stage.
STANDING = ("watch", "potential_start", "mainline_watch", "mainline_core", "cool", "Diffusion", "Mainline", "Crowded", "Decay")


def standing() -> Column:
    c = F.col
    main = (c("slope_5d") > 0) & (c("ret_10d") > 0) & (F.coalesce("breadth", F.lit(0.5)) >= 0.45)
    candidate = (c("slope_3d") > 0) & (c("acceleration") > 0) & (c("ret_10d") < 18)
    met = {
        "watch": (c("confirmation_score") >= 65) & candidate, "potential_start": (c("confirmation_score") >= 75) & candidate, "mainline_watch": (c("mainline_score") >= 68) & main, "mainline_core": (c("mainline_score") >= 80) & main,
        "cool": c("ret_5d") < 8, "Diffusion": (c("mainline_score") >= 62) & main, "Mainline": (c("mainline_score") >= 80) & main, "Crowded": (c("crowding_penalty") >= 8) & (c("mainline_score") >= 65),
        "Decay": (c("mainline_score") >= 60) & (c("slope_3d") < 0) & (c("acceleration") < 0),
    }
    bits = [F.when(holds(met[n]), 1 << k).otherwise(0) for k, n in enumerate(STANDING)]
    return sum(bits[1:], bits[0])


def labelled(rows: DataFrame) -> DataFrame:
    """Status and stage of life, by the scores and by ``standing``, which is found here unless it stands in the rows."""
    found = rows if "standing" in rows.columns else rows.withColumn("standing", standing())
    c, met = F.col, {n: F.col("standing").bitwiseAND(1 << k) > 0 for k, n in enumerate(STANDING)}
    status = last_label("ordinary", *[(met[n], n) for n in STANDING[:4]])
    moving = met["cool"] & (c("ignition_history_coverage") >= 0.40)
    lifecycle = last_label(
        "Dormant", (met["Diffusion"], "Diffusion"), ((c("ignition_score") >= 60) & moving, "Seed"), ((c("ignition_score") >= 72) & moving, "Ignition"), *[(met[n], n) for n in STANDING[-3:]],
    )
    return found.withColumns({"status": status, "lifecycle": lifecycle})
