"""Completeness audit: from the source universe through histories and flows to the scored boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.functions.expr import first_label, holds

CALENDAR_DAYS = 30
WINDOWS = (1, 5, 10)
#: Statuses that count as quality warnings in the summary.
WARNED = ("bad_quality", "stale", "gap", "partial_flow")


def calendar(bars: DataFrame, cutoff, sizes: DataFrame | None = None) -> DataFrame:
    """The last dates of each kind's longest history, then without those after the last completed session. ``sizes`` (kind, code, n): the dates
    of each history, where they are counted already."""
    sizes = bars.groupBy("kind", "code").agg(F.count_distinct("date").alias("n")) if sizes is None else sizes
    longest = sizes.groupBy("kind").agg(F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("code"))
    dates = bars.select("kind", "code", "date").join(F.broadcast(longest), ["kind", "code"], "left_semi").select("kind", "date").distinct()  # a row for each kind
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("date")))
    return dates.withColumn("place", place).filter((F.col("place") <= CALENDAR_DAYS) & (F.col("date") <= cutoff)).drop("place")


def rows(source: DataFrame, target: DataFrame, bars: DataFrame, failures: DataFrame, flows: DataFrame, scored: DataFrame, cutoff) -> DataFrame:
    """A row for each source board: stages it reached, gaps, staleness, quality counts and one status.

    ``source`` and ``target``: kind, code, name; ``bars`` with OHLC and data_source; ``flows``: kind, name and
    flow_{n}d_pct for the ``WINDOWS``; ``scored``: kind, code and the same. A board's fetch error only tells why it has no
    history; a history is judged by its bars.
    """
    key = ["kind", "code"]
    doubled = source.withColumns({"duplicate_code": F.count("*").over(Window.partitionBy("kind", "code")) > 1, "duplicate_name": F.count("*").over(Window.partitionBy("kind", "name")) > 1})
    bad = holds(F.col("high") < F.col("low")) | holds(F.col("close") > F.col("high")) | holds(F.col("close") < F.col("low"))
    history = bars.groupBy(*key).agg(
        F.count("*").alias("history_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), (F.count("*") - F.count_distinct("date")).alias("duplicate_dates"),
        F.sum(F.when(holds(F.col("close") > 0), 0).otherwise(1)).alias("invalid_close"), F.sum(F.when(bad, 1).otherwise(0)).alias("invalid_ohlc"), F.max_by("data_source", F.when(F.col("data_source").isNotNull(), F.col("date"))).alias("history_source"),
    )
    expected = calendar(bars, cutoff, history.select(*key, (F.col("history_rows") - F.col("duplicate_dates")).alias("n")))
    due = history.select(*key, "first_date", "last_date").join(F.broadcast(expected), "kind").filter("date >= first_date")  # at most 30 dates for each kind
    there = bars.select(*key, "date").join(F.broadcast(expected), ["kind", "date"], "left_semi")  # a board's bars of these dates only
    gone = due.join(there.distinct(), [*key, "date"], "left_anti")
    gaps = gone.groupBy(*key).agg(F.count("*").alias("missing_count"), F.array_join(F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM-dd"))), ",").alias("missing_trading_dates"), F.sum((F.col("date") > F.col("last_date")).cast("int")).alias("stale_sessions"))
    flow = [f"flow_{n}d" for n in WINDOWS]
    matched = flows.groupBy("kind", "name").agg(*[(F.count(f"{w}_pct") > 0).alias(f"{w}_matched") for w in flow])
    known = scored.groupBy(*key).agg(F.lit(True).alias("is_scored"), *[(F.count(f"{w}_pct") > 0).alias(f"{w}_known") for w in flow])
    placed = (
        doubled.join(target.select(*key).distinct().withColumn("is_target", F.lit(True)), key, "left").join(history, key, "left").join(gaps, key, "left").join(failures.select(*key, "error").dropDuplicates(key), key, "left")
        .join(matched, ["kind", "name"], "left").join(known, key, "left")
    )
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("is_target", "is_scored", *[f"{w}_{x}" for w in flow for x in ("matched", "known")])}
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("history_rows", "duplicate_dates", "invalid_close", "invalid_ohlc", "missing_count", "stale_sessions")}
    out = placed.withColumns(flags | counts | {"missing_trading_dates": F.coalesce("missing_trading_dates", F.lit(""))})
    out = out.withColumns({f"{w}_available": F.col(f"{w}_matched") | F.col(f"{w}_known") for w in flow})
    c = F.col
    available = F.forall(F.array(*[f"{w}_available" for w in flow]), lambda x: x)
    status = first_label(
        [
            (~c("is_target"), "filtered"), ((c("history_rows") == 0) & (c("error") == "too_short"), "too_short"), (c("history_rows") == 0, "failed"), (c("duplicate_dates") + c("invalid_close") + c("invalid_ohlc") > 0, "bad_quality"),
            (c("stale_sessions") > 0, "stale"), (c("missing_count") > 0, "gap"), (~c("is_scored"), "unscored"), (~available, "partial_flow"),
        ],
        "complete",
    )
    return out.withColumns({"audit_status": status, "is_omitted": ~c("is_scored")}).select("kind", "code", "name", "duplicate_code", "duplicate_name", "is_target", "history_rows", "history_source", "duplicate_dates", "invalid_close", "invalid_ohlc", "missing_count", "missing_trading_dates", "stale_sessions", *[f"{w}_{x}" for w in flow for x in ("matched", "available")], "is_scored", "audit_status", "is_omitted")


def summary(audit: DataFrame) -> DataFrame:
    """Totals and shares of each kind, and of all; but for the universe and the boards filtered, all are of the target."""
    c = F.col
    flag = lambda x: F.coalesce(F.sum(x.cast("int")), F.lit(0))
    target = lambda x: flag(c("is_target") & x)
    share = lambda x: F.bround(F.try_divide(target(x) * 100.0, F.nullif(target(F.lit(True)), F.lit(0))), 2)
    return audit.rollup("kind").agg(
        F.when(F.grouping("kind") == 1, "all").otherwise(F.first("kind")).alias("group"), F.count("*").alias("universe"), flag(~c("is_target")).alias("filtered"), target(F.lit(True)).alias("target"), target(c("history_rows") > 0).alias("history_success"),
        target(c("is_scored")).alias("scored"), target(c("is_omitted")).alias("omitted"), target(c("audit_status").isin(*WARNED)).alias("warnings"), share(c("is_scored")).alias("target_coverage_pct"),
        *[share(c(f"flow_{n}d_{x}")).alias(f"flow_{n}d_{y}_pct") for x, y in (("matched", "match"), ("available", "available")) for n in WINDOWS],
    ).drop("kind").withColumnRenamed("group", "kind")


def distribution(audit: DataFrame) -> DataFrame:
    return audit.groupBy("audit_status", "history_source").agg(F.count("*").alias("boards"))


def distributions(audit: DataFrame) -> DataFrame:
    """Boards by status and source, and by kind and source, in one pass; a board without a history has no source."""
    counted = audit.select("audit_status", "kind", "history_source").groupingSets([["audit_status", "history_source"], ["kind", "history_source"]], "audit_status", "kind", "history_source").agg(F.grouping("kind").alias("_no_kind"), F.count("*").alias("boards"))
    return counted.select(F.when(F.col("_no_kind") == 1, "status").otherwise("kind").alias("by"), F.when(F.col("_no_kind") == 1, F.col("audit_status")).otherwise(F.col("kind")).alias("value"), "history_source", "boards")


def run_status(summary_: DataFrame, least_pct: float = 80.0) -> DataFrame:
    """The row of all boards as items: value, and PASS or WARN where something is asked of it: coverages of ``least_pct`` per cent
    or more, nothing omitted, no warnings."""
    c = F.col
    numbers = [n for n in summary_.columns if n != "kind"]
    items = summary_.filter("kind = 'all'").select(*[c(n).cast("double").alias(n) for n in numbers]).unpivot([], numbers, "item", "value")
    asked = F.when(c("item").endswith("_pct"), c("value") >= least_pct).when(c("item").isin("omitted", "warnings"), c("value") == 0)
    return items.withColumn("status", F.when(asked, "PASS").when(~asked, "WARN").when(c("value").isNull() & c("item").endswith("_pct"), "WARN").otherwise(""))


def provenance(bars: DataFrame) -> DataFrame:
    """Where each board's history comes from: the source of its last bar that states one, the median number of constituents
    and the mean coverage of its synthetic bars (null where it has none)."""
    return bars.groupBy("kind", "code").agg(
        F.max_by("data_source", F.when(F.col("data_source").isNotNull(), F.col("date"))).alias("history_source"),
        F.median("constituent_count").alias("synthetic_constituents"), F.avg("synthetic_coverage").alias("synthetic_coverage"),
    )


def placed(audit: DataFrame) -> DataFrame:
    """The audit with each row's place in the report's order: omitted boards first, then by status, kind, name and code.

    Rows are numbered within status and kind, and begin where the statuses and kinds before them end, so no task holds all rows.
    The audit is read twice; callers write it once.
    """
    group = ["is_omitted", "audit_status", "kind"]
    sizes = audit.groupBy(*group).agg(F.count("*").alias("n"))  # a row for each status and kind
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("is_omitted"), "audit_status", "kind").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*group).orderBy("name", "code"))
    return audit.withColumn("_own", own).join(starts, group).withColumn("place", F.col("_start") + F.col("_own")).drop("_start", "_own")


def subsets(audit: DataFrame) -> DataFrame:
    """The extracts of an audit: boards omitted from the scores, and scored ones that are not complete (warnings)."""
    extract = F.when(F.col("is_omitted"), "omitted").when(F.col("audit_status") != "complete", "warnings")
    return audit.withColumn("subset", extract).filter("subset is not null")


def facts(scored: DataFrame, failures: DataFrame, summary_: DataFrame) -> DataFrame:
    """The head of a report, one row: the last date of the scores, how many boards were scored and failed, and the audit's totals."""
    total = summary_.filter("kind = 'all'").select("universe", "filtered", "target", F.col("scored").alias("target_scored"), "target_coverage_pct")
    head = scored.agg(F.max("as_of").alias("data_cutoff"), F.count("*").alias("scored"))
    return head.crossJoin(failures.agg(F.count("*").alias("failures"))).crossJoin(total)  # of one row each
