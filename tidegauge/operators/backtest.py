"""Replay of ignition signals: which boards became mainline, how soon, and how strong they were afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.operators.trajectory import latest_of_day


def numbered_days(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each day, with the day's number; days are few, so one window numbers them."""
    last = latest_of_day(snapshots)
    # the optimizer broadcasts the days where they are small
    days = last.select("snapshot_date").distinct().withColumn("day", F.row_number().over(Window.orderBy("snapshot_date")))
    return last.join(days, "snapshot_date")


def future_pairs(snapshots: DataFrame, horizon: int = 10) -> DataFrame:
    """Each board's row with its rows of the next ``horizon`` snapshot days: offset and the strength against its kind."""
    days = numbered_days(snapshots)
    strong = days.withColumn("rs", F.col("ret_1d") - F.median("ret_1d").over(Window.partitionBy("day", "kind")))
    later = strong.select("kind", "code", F.col("day").alias("later_day"), F.col("mainline_score").alias("later_score"), F.col("rs").alias("later_rs"))
    base = days.select("snapshot_date", "day", "kind", "code", "ignition_score", "ret_5d")
    ahead = base.withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("later_day", F.col("day") + F.col("offset"))
    return ahead.join(later, ["kind", "code", "later_day"])


def detail(snapshots: DataFrame, top_k: int = 10, horizon: int = 10, ignition: float = 70, mainline: float = 80) -> DataFrame:
    days = numbered_days(snapshots)
    place = F.row_number().over(Window.partitionBy("day").orderBy(F.desc("ignition_score"), "kind", "code"))
    final = days.agg(F.max("day").alias("final"))
    signals = days.filter(F.col("ignition_score") >= ignition).withColumn("place", place).filter(F.col("place") <= top_k).join(F.broadcast(final)).filter("day < final")
    nth = F.row_number().over(Window.partitionBy("kind", "code", "day").orderBy(F.col("later_rs").isNull(), "offset"))
    met = future_pairs(snapshots, horizon).withColumn("nth", nth)
    strength = lambda n: F.sum(F.when((F.col("nth") <= n) & F.col("later_rs").isNotNull(), F.col("later_rs"))).alias(f"forward_rs_{n}d")
    after = met.groupBy("kind", "code", "day").agg(F.min(F.when(F.col("later_score") >= mainline, F.col("offset"))).alias("lead_time_sessions"), *[strength(n) for n in (3, 5, 10)])
    out = signals.join(after, ["kind", "code", "day"], "left")
    return out.select(F.col("snapshot_date").alias("signal_date"), "kind", "code", "ignition_score", F.col("ret_5d").alias("alert_ret_5d"), F.col("lead_time_sessions").isNotNull().alias("became_mainline"), "lead_time_sessions", F.col("lead_time_sessions").isNull().alias("false_start"), "forward_rs_3d", "forward_rs_5d", "forward_rs_10d")


def summary(rows: DataFrame, top_k: int = 10) -> DataFrame:
    return rows.agg(
        F.count("*").alias("signals"), F.avg(F.col("became_mainline").cast("double")).alias(f"precision_at_{top_k}"), F.avg(F.col("false_start").cast("double")).alias("false_start_rate"), F.median("lead_time_sessions").alias("median_lead_time_sessions"),
        F.median("alert_ret_5d").alias("median_alert_ret_5d"), *[F.avg(f"forward_rs_{n}d").alias(f"mean_forward_rs_{n}d") for n in (3, 5, 10)],
    )
