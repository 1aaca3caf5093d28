"""Snapshots of scored boards: calendars of reference snapshots, deltas, rank velocities, upserts, isolated versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.expr import descending_rank

SCORES = ("mainline_score", "confirmation_score", "candidate_score", "ignition_score")
VALUES = (*SCORES, "breadth", "amount_share")


def reference_calendar(snapshots: DataFrame) -> DataFrame:
    """For each captured_at: the latest earlier one of its day, the last of the previous day, the last of the third day
    before. One row for each capture, so the ordering window is over captures, not over boards."""
    moments = snapshots.select("captured_at", "snapshot_date").distinct()
    day = Window.partitionBy("snapshot_date").orderBy("captured_at")
    closes = moments.groupBy("snapshot_date").agg(F.max("captured_at").alias("close"))
    line = Window.orderBy("snapshot_date")
    before = closes.select("snapshot_date", F.lag("close", 1).over(line).alias("ref_1d"), F.lag("close", 3).over(line).alias("ref_3d"))
    return moments.withColumn("ref_intraday", F.lag("captured_at").over(day)).join(before, "snapshot_date")


def ranked(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumns({f"{s}_rank": descending_rank(F.col(s), "captured_at", "kind") for s in SCORES})


def latest_of_day(snapshots: DataFrame) -> DataFrame:
    last = snapshots.groupBy("snapshot_date").agg(F.max("captured_at").alias("captured_at"))
    return snapshots.join(last, ["snapshot_date", "captured_at"], "left_semi")


def deltas(snapshots: DataFrame) -> DataFrame:
    """Each row with its change since the three reference snapshots, and the share of one-day changes it has."""
    rows = ranked(snapshots)
    out = rows.join(reference_calendar(snapshots).drop("snapshot_date"), "captured_at")
    ranks = [f"{s}_rank" for s in SCORES]
    for name in ("intraday", "1d", "3d"):
        prior = rows.dropDuplicates(["captured_at", "kind", "code"]).select(F.col("captured_at").alias(f"ref_{name}"), "kind", "code", *[F.col(c).alias(f"{c}_prev") for c in (*VALUES, *ranks)])
        out = out.join(prior, [f"ref_{name}", "kind", "code"], "left")
        out = out.withColumns({**{f"{c}_delta_{name}": F.col(c) - F.col(f"{c}_prev") for c in VALUES}, **{f"{c}_velocity_{name}": F.col(f"{c}_prev") - F.col(c) for c in ranks}}).drop(*[f"{c}_prev" for c in (*VALUES, *ranks)])
    known = [F.col(c).isNotNull().cast("double") for c in out.columns if c.endswith(("_delta_1d", "_velocity_1d"))]
    return out.withColumn("snapshot_history_coverage", F.when(F.col("ref_1d").isNotNull(), sum(known[1:], known[0]) / len(known)).otherwise(0.0))


def daily_calendar(days: DataFrame) -> DataFrame:
    """``days`` (snapshot_date) once each, with the one before and the third before. The ordering window is over days, not over boards."""
    line = Window.orderBy("snapshot_date")
    return days.select("snapshot_date").distinct().select("snapshot_date", F.lag("snapshot_date", 1).over(line).alias("ref_1d"), F.lag("snapshot_date", 3).over(line).alias("ref_3d"))


def daily_deltas(rows: DataFrame, calendar: DataFrame, values: Sequence[str], ranks: Sequence[str] = ()) -> DataFrame:
    """``rows`` with one capture a day (snapshot_date), and what ``deltas`` finds of their one-day and three-day references: a board's row of one of
    the three days before is one of its last three rows, so it is met in the board's own order and nothing is joined but the ``calendar`` of days."""
    line = Window.partitionBy("kind", "code").orderBy("snapshot_date")
    columns = ("snapshot_date", *values, *ranks)
    out = rows.join(F.broadcast(calendar), "snapshot_date").withColumn("_past", F.array(*[F.lag(F.struct(*columns), k).over(line) for k in (1, 2, 3)]))  # the calendar has a row a day
    for name in ("1d", "3d"):
        reference = F.col(f"ref_{name}")
        out = out.withColumn("_prior", F.coalesce(*[F.when(F.col("_past")[k]["snapshot_date"] == reference, F.col("_past")[k]) for k in range(3)]))
        out = out.withColumns({**{f"{c}_delta_{name}": F.col(c) - F.col(f"_prior.{c}") for c in values}, **{f"{c}_velocity_{name}": F.col(f"_prior.{c}") - F.col(c) for c in ranks}}).drop("_prior")
    return out.drop("_past")


def upserted(stored: DataFrame, new: DataFrame, keys: list[str], moment: str, ties: Sequence[str] = ()) -> DataFrame:
    """Both tables' rows, of each key the last by ``moment``, then by ``ties``; then the new table wins."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in (moment, *ties)], F.desc("_new")))
    return both.withColumn("_place", place).filter("_place = 1").drop("_place", "_new")


def of_version(stored: DataFrame, version: str, config_hash: str | Column, universe: DataFrame | None = None) -> DataFrame:
    """Rows that this model version and configuration (and, by sector, universe_hash) wrote."""
    own = stored.filter((F.col("model_version") == version) & (F.col("config_hash") == config_hash))
    return own if universe is None else own.join(universe, ["sector", "universe_hash"], "left_semi")


def stored_status(columns: Sequence[str] | None, value: str) -> str:
    """Why a store of snapshots, None if there is none, gives no history; '' if it may: without the value it is missing, without
    a version or a configuration it is of another model."""
    if columns is None or value not in columns:
        return "MISSING"
    return "" if {"model_version", "config_hash"} <= set(columns) else "VERSION_MISMATCH"


def universe_hash(members: DataFrame, group: str, code: str) -> DataFrame:
    return members.groupBy(group).agg(F.substring(F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(code))).cast("binary"), 256), 1, 16).alias("universe_hash"))
