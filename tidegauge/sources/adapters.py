"""Canonical tables from the landed star schema: bars, boards, flows, snapshots, constituents, reports and quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegauge.functions.expr import ratio

#: Numbers of shares in the reports' per-share columns.
SHARES = 1000.0


def landed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lean(lines: DataFrame, *keys: str | Column) -> DataFrame:
    """``keys`` and figures of ``lines`` in few bytes, as every line is dealt: its day and the three things that are true of it or not are one number."""
    facts = [F.col("l_discount") < 0.05, F.col("l_discount") > 0.05, F.col("l_linestatus") == "F"]
    bits = [F.when(x, 1 << k).otherwise(0) for k, x in enumerate(facts)]
    return lines.filter("l_shipdate is not null").select(*keys, "l_quantity", "l_extendedprice", (F.unix_date(F.col("l_shipdate").cast("date")).cast("long") * 8 + sum(bits[1:], bits[0])).alias("marked"))


def _weeks(lines: DataFrame) -> DataFrame:
    """Weekly bars of ``lines`` (kind, code, l_partkey and what ``_lean`` leaves), with the counts that make breadth and the net amount.

    The lines must lie together by code or by l_partkey: then the parts not seen before in a week are found where they lie, and only sums travel.
    A week opens at the mean price of the first of its seven days that has lines."""
    day, amount, px = F.date_from_unix_date(F.shiftright("marked", 3).cast("int")), F.col("l_extendedprice"), F.col("l_extendedprice") / F.col("l_quantity")
    week, fact = ["kind", "code", "date"], [F.col("marked").bitwiseAND(1 << k) > 0 for k in range(3)]
    rows = lines.withColumn("date", F.date_trunc("week", day).cast("date")).withColumn("weekday", F.datediff(day, "date"))
    rows = rows.withColumn("fresh", F.row_number().over(Window.partitionBy("code", "date", "l_partkey").orderBy("l_partkey")) == 1)
    days = [F.col("weekday") == k for k in range(7)]
    sums = rows.groupBy(*week).agg(
        F.max(px).alias("high"), F.min(px).alias("low"), (F.sum(px) / F.count("*")).alias("close"), F.sum("l_quantity").alias("volume"), F.sum(amount).alias("amount"), F.count_if(fact[0]).alias("up_count"), F.count_if(fact[1]).alias("down_count"),
        F.sum(F.when(fact[2], amount).otherwise(-amount)).alias("net"), F.count_if("fresh").alias("parts"), *[F.sum(F.when(x, px)).alias(f"px_{k}") for k, x in enumerate(days)], *[F.count_if(x).alias(f"lines_{k}") for k, x in enumerate(days)],
    )
    first = F.coalesce(*[F.when(F.col(f"lines_{k}") > 0, F.struct((F.col(f"px_{k}") / F.col(f"lines_{k}")).alias("px"))) for k in range(7)])["px"]
    return sums.select(*week, first.alias("open"), "high", "low", "close", "volume", "amount", "up_count", "down_count", "net", (F.col("volume") / F.col("parts")).alias("turnover"))


def funded_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each board, with their net amounts: filled less open ones. Brands are industries, suppliers are concepts.

    Lines are dealt twice, by part, where they meet its brand, and by supplier. A brand's lines are summed where its parts lie, so that only sums of weeks are dealt by brand."""
    lines, parts = landed(spark, sf_dir, "lineitem"), landed(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code")).filter("code is not null")
    branded = _lean(lines, "l_partkey").repartition("l_partkey").join(parts, "l_partkey").withColumn("kind", F.lit("industry"))
    supplied = _lean(lines.filter("l_suppkey is not null"), F.col("l_suppkey").cast("string").alias("code"), "l_partkey").repartition("code").withColumn("kind", F.lit("concept"))
    return _weeks(branded).repartition("code").unionByName(_weeks(supplied)).withColumn("data_source", F.lit("lines"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of each board, with the counts that make breadth."""
    return funded_bars(spark, sf_dir).drop("net")


def breadth(up: Column, down: Column) -> Column:
    return F.when(up + down > 0, up / (up + down))


def with_flows(rows: DataFrame) -> DataFrame:
    """``rows`` of boards with the shares of filled less open amounts over the last 1, 5 and 10 bars; every third board has none."""
    last = lambda n: Window.partitionBy("kind", "code").orderBy("date").rowsBetween(1 - n, 0)
    known = F.regexp_extract("code", r"(\d+)$", 1).cast("long") % 3 != 0
    return rows.withColumns({f"flow_{n}d_direct_pct": F.when(known, 100 * ratio(F.sum("net").over(last(n)), F.sum("amount").over(last(n)))) for n in (1, 5, 10)}).drop("net")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flows of the boards that have some, as a table of their own."""
    shares = [f"flow_{n}d_direct_pct" for n in (1, 5, 10)]
    rows = with_flows(funded_bars(spark, sf_dir)).filter(F.regexp_extract("code", r"(\d+)$", 1).cast("long") % 3 != 0)
    return rows.select("kind", F.col("code").alias("name"), F.col("date").alias("as_of"), *shares)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of boards as captured every six hours, from the event stream."""
    events = landed(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    captured = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 21600) * 21600)
    grouped = events.groupBy(captured.alias("captured_at"), F.col("event_type").alias("kind"), (F.col("user_id") % 10).cast("string").alias("code")).agg(
        F.avg("value").alias("level"), F.max("value").alias("top"), F.min("value").alias("bottom"), F.sum("value").alias("amount"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("breadth"), F.count("*").alias("n")
    )
    kind = Window.partitionBy("captured_at", "kind")
    return grouped.select(
        "captured_at", F.to_date("captured_at").alias("snapshot_date"), "kind", "code", F.least(F.lit(100.0), F.col("level") * 1.1).alias("mainline_score"), *[F.least(F.lit(100.0), F.col("top")).alias(c) for c in ("confirmation_score", "candidate_score")],
        F.least(F.lit(100.0), (F.col("level") + F.col("top")) / 2).alias("ignition_score"), "breadth", ratio(F.col("amount"), F.sum("amount").over(kind)).alias("amount_share"), (F.col("top") - F.col("level")).alias("ret_1d"), (F.col("level") - F.col("bottom")).alias("ret_5d"),
    )


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers, nations = landed(spark, sf_dir, "supplier"), landed(spark, sf_dir, "nation")
    return suppliers.join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("board"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("stock_code"), F.col("s_name").alias("name"), "n_regionkey")


def stock_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of suppliers, as a board's constituents."""
    lines = landed(spark, sf_dir, "lineitem").select(F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock_code"), F.date_trunc("month", F.col("l_shipdate")).cast("date").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"), "l_quantity", "l_extendedprice")
    return lines.groupBy("stock_code", "date").agg(F.avg("px").alias("close"), F.max("px").alias("high"), F.min("px").alias("low"), ((F.max("px") + F.min("px")) / 2).alias("open"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"), F.avg("l_quantity").alias("turn"))


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-to-date reports of each supplier at each quarter's end; some lack the cash flow or the book value."""
    ext, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    lines = landed(spark, sf_dir, "lineitem").select("l_suppkey", F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"), ext, disc, tax)
    quarters = lines.groupBy("l_suppkey", "year", "quarter").agg(F.sum(ext * (1 - disc)).alias("revenue"), F.sum(ext * (0.055 - disc)).alias("net_profit"), F.sum(ext * (tax - 0.02)).alias("ocf"), F.sum(ext).alias("gross"))
    to_date = Window.partitionBy("l_suppkey", "year").orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    sums = quarters.select("l_suppkey", "year", "quarter", *[F.sum(c).over(to_date).alias(c) for c in ("revenue", "net_profit", "ocf", "gross")])
    same = Window.partitionBy("l_suppkey", "quarter").orderBy("year")
    before = lambda c: F.when(F.lag("year").over(same) == F.col("year") - 1, F.lag(c).over(same))
    code, end = F.col("l_suppkey"), F.element_at(F.array(*map(F.lit, ("0331", "0630", "0930", "1231"))), F.col("quarter"))
    return sums.select(
        F.concat(F.col("year").cast("string"), end).alias("report_date"), F.lpad(code.cast("string"), 6, "0").alias("code"), "revenue", "net_profit", F.when(code % 7 != 0, F.col("ocf")).alias("operating_cashflow"), (F.col("ocf") / SHARES).alias("ocfps"), (F.col("net_profit") / SHARES).alias("eps"),
        F.when(code % 5 != 0, F.col("revenue") / (5 * SHARES)).alias("bvps_reported"), (100 * ratio(F.col("net_profit"), F.col("revenue"))).alias("roe_h1_pct"), (100 * ratio(F.col("revenue") - 0.6 * F.col("gross"), F.col("revenue"))).alias("gross_margin_pct"),
        (100 * (ratio(F.col("revenue"), before("revenue")) - 1)).alias("revenue_yoy"), F.when(before("net_profit") > 0, 100 * (F.col("net_profit") / before("net_profit") - 1)).alias("profit_yoy"),
    )


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quote of each supplier on its last month: price, market value and price to book, some of them missing."""
    lines = landed(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    months = lines.groupBy("s_suppkey", "month").agg(F.avg("px").alias("price"), F.max("day").alias("day"))
    last = months.groupBy("s_suppkey").agg(F.max_by("price", "month").alias("price"), F.max("day").alias("quote_trade_date"))
    code, balance = F.col("s_suppkey"), F.col("s_acctbal")
    return landed(spark, sf_dir, "supplier").join(last, "s_suppkey", "left").select(
        F.lpad(code.cast("string"), 6, "0").alias("code"), F.col("s_name").alias("name"), "price", F.when(balance > 0, balance * 1000).alias("market_cap"), F.when((balance > 0) & (code % 11 != 0), 0.5 + F.pmod(balance, F.lit(500.0)) / 100).alias("pb"), "quote_trade_date"
    )


def quotes_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's quote in each month: mean price, market value and book multiple of a number of shares and a book that were settled in its first month."""
    lines = landed(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("as_of"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("px"))
    months = lines.groupBy("s_suppkey", "as_of").agg(F.avg("px").alias("price"), F.max("day").alias("quote_trade_date"))
    rows = months.withColumn("first_price", F.first("price").over(Window.partitionBy("s_suppkey").orderBy("as_of")))
    code, balance, grown = F.col("s_suppkey"), F.col("s_acctbal"), F.col("price") / F.col("first_price")
    return landed(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").join(rows, "s_suppkey").select(
        "as_of", F.lpad(code.cast("string"), 6, "0").alias("code"), F.col("s_name").alias("name"), "price", F.when(balance > 0, balance * 1000 * grown).alias("market_cap"),
        F.when((balance > 0) & (code % 11 != 0), (0.5 + F.pmod(balance, F.lit(500.0)) / 100) * grown).alias("pb"), "quote_trade_date"
    )
