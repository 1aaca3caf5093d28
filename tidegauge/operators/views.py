"""Views and extracts of scored boards: orderings, groups, paths and headers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F


def ordered(rows: DataFrame, score: str = "mainline_score", *ties: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(score), *ties)


def top_views(rows: DataFrame, views: Mapping[str, tuple[Column, str]], n: int = 20) -> DataFrame:
    """The first ``n`` rows of each view (its condition and its score), one below the other."""
    parts = []
    for name, (condition, score) in views.items():
        place = F.row_number().over(Window.partitionBy(F.lit(name)).orderBy(F.desc_nulls_last(score), "kind", "code"))
        first = rows.filter(F.coalesce(condition, F.lit(False))).orderBy(F.desc_nulls_last(score), "kind", "code").limit(n)
        parts.append(first.withColumn("place", place).select(F.lit(name).alias("view"), "place", "kind", "code", F.col(score).alias("score")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def display_groups(rows: DataFrame, score: str = "mainline_score") -> DataFrame:
    """Of boards whose names differ by a trailing level only, the one with the best score."""
    group = F.regexp_replace("name", "[ⅠⅡⅢⅣⅤ]+$", "")
    place = F.row_number().over(Window.partitionBy("kind", "display_group").orderBy(F.desc_nulls_last(score), "code"))
    return rows.withColumn("display_group", group).withColumn("_n", place).filter("_n = 1").drop("_n")


def rebased(bars: DataFrame, chosen: DataFrame, last: int = 30) -> DataFrame:
    """The last bars of the chosen boards, as percent of the first of them."""
    tail = bars.join(F.broadcast(chosen.select("kind", "code")), ["kind", "code"], "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("kind", "code").orderBy(F.desc("date")))).filter(F.col("_n") <= last)  # a top-k list
    first = F.first("close").over(Window.partitionBy("kind", "code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return tail.select("kind", "code", "date", (F.col("close") / first * 100).alias("rebased"))


def scaled(rows: DataFrame, columns: list[str], factor: float = 100.0) -> DataFrame:
    return rows.withColumns({c: F.col(c) * factor for c in columns})


def fronted(rows: DataFrame, first: list[str]) -> DataFrame:
    return rows.select(*first, *[c for c in rows.columns if c not in first])


def decoded(column: Column, labels: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[column], column)


def warnings(stocks: DataFrame) -> DataFrame:
    """Stocks that need a look, and one row for all if the stage of most is unknown."""
    c = F.col
    cause = c("valuation_status") != "OK"
    doubtful = stocks.filter(F.coalesce(cause | (c("stage") == "UNKNOWN") | (c("quality") < 0.6) | (c("gate") == "fail") | (c("risk_flags") != ""), F.lit(True)))
    rows = doubtful.select("code", "valuation_status", "risk_flags")
    unknown = stocks.agg(F.avg((c("stage") == "UNKNOWN").cast("double")).alias("share")).filter("share >= 0.8")
    return rows.unionByName(unknown.select(F.lit("ALL").alias("code"), F.lit("STAGE_UNKNOWN").alias("valuation_status"), F.lit("").alias("risk_flags")))
