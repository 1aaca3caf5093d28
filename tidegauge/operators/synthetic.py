"""Equal-weight indexes of boards from their constituents' bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.functions.expr import market_date, number

MOST, LEAST, LEAST_BARS = 24, 3, 12
#: The status of a session in which a stock was traded.
TRADED = "1"


def traded(raw: DataFrame, status: str = "trade_status") -> DataFrame:
    """Vendor bars of stocks as ``index`` takes them: sessions without trade go (without a status all count as traded), texts become
    numbers and dates, rows without a date or close go."""
    rows = raw.filter(F.trim(F.col(status).cast("string")) == TRADED).drop(status) if status in raw.columns else raw
    figures = ("open", "high", "low", "close", "volume", "amount", "turn")
    return rows.withColumns({"date": market_date(F.col("date"))} | {c: number(F.col(c)) for c in figures}).filter("date is not null and close is not null")


def rejects(constituents: DataFrame, stock_bars: DataFrame, most: int = MOST) -> DataFrame:
    """Boards that get no index: how many codes they map to, how many of these have enough bars, and which of the two was too few."""
    codes = constituents.select("board", "stock_code").distinct()
    place = F.row_number().over(Window.partitionBy("board").orderBy(F.col("stock_code").asc_nulls_last()))
    chosen = codes.withColumn("place", place).filter(F.col("place") <= most).drop("place")
    enough = stock_bars.filter("close is not null and date is not null").groupBy("stock_code").agg((F.count("*") >= LEAST_BARS).alias("enough"))
    counted = chosen.join(enough, "stock_code", "left").groupBy("board").agg(F.count("stock_code").alias("mapped"), F.count_if(F.coalesce("enough", F.lit(False))).alias("valid"))
    error = F.when(F.col("mapped") < LEAST, "too_few_members").when(F.col("valid") < LEAST, "too_few_histories")
    return counted.withColumn("error", error).filter("error is not null")


def members(constituents: DataFrame, stock_bars: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` codes of each board, of which at least three have enough bars."""
    codes = constituents.select("board", "stock_code").filter("stock_code is not null").distinct()
    chosen = codes.withColumn("place", F.row_number().over(Window.partitionBy("board").orderBy("stock_code"))).filter(F.col("place") <= most).drop("place")
    valid = stock_bars.filter("close is not null and date is not null").groupBy("stock_code").agg(F.count("*").alias("bars")).filter(F.col("bars") >= LEAST_BARS)
    kept = chosen.join(valid.select("stock_code"), "stock_code", "left_semi")
    enough = kept.groupBy("board").agg(F.count("*").alias("members")).filter(F.col("members") >= LEAST)
    return kept.join(enough, "board")


def index(constituents: DataFrame, stock_bars: DataFrame) -> DataFrame:
    """Daily index from 100: mean returns of the members that traded; days with too few are dropped at the end."""
    own = Window.partitionBy("stock_code").orderBy("date")
    before = F.lag("close").over(own)
    relative = stock_bars.select("stock_code", "date", "amount", "volume", "turn", *[F.when(before > 0, F.col(c) / before - 1).alias(f"r_{c}") for c in ("open", "high", "low", "close")])
    joined = relative.join(members(constituents, stock_bars), "stock_code")
    days = joined.groupBy("board", "date").agg(
        F.max("members").alias("members"), F.count("r_close").alias("available"), *[F.avg(f"r_{c}").alias(f"r_{c}") for c in ("open", "high", "low", "close")], F.sum("amount").alias("amount"), F.sum("volume").alias("volume"), F.avg("turn").alias("turnover")
    )
    valid = F.col("available") >= F.least(F.lit(LEAST), F.col("members"))
    line = Window.partitionBy("board").orderBy("date")
    growth = F.when(valid & (F.col("r_close") > -1), F.log1p("r_close")).otherwise(0.0)
    levels = days.withColumn("valid", valid).withColumn("close", F.exp(F.sum(growth).over(line.rowsBetween(Window.unboundedPreceding, 0))) * 100)
    levels = levels.withColumn("previous", F.coalesce(F.lag("close").over(line), F.lit(100.0)))
    at = lambda c: F.col("previous") * (1 + F.coalesce(f"r_{c}", "r_close"))  # noqa: E731  # a price that no member has moves as the closes do
    out = levels.filter("valid").select("board", "date", at("open").alias("open"), at("high").alias("h"), at("low").alias("l"), "close", "amount", "volume", "turnover", F.col("available").alias("constituent_count"), (F.col("available") / F.col("members")).alias("synthetic_coverage"))
    return out.withColumn("high", F.greatest("open", "h", "close")).withColumn("low", F.least("open", "l", "close")).drop("h", "l").withColumn("data_source", F.lit("synthetic_index"))
