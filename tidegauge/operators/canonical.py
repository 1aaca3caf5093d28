"""Canonicalisation of landed tables, source waterfalls, and resolution of names."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.functions.expr import board_name, market_date, number, ratio


def resolved(df: DataFrame, needles: Sequence[str]) -> str | None:
    """The column that a list of aliases names: exactly first, then as a part of the column's name."""
    for test in (lambda c, n: c == n, lambda c, n: n in c):
        for needle in needles:
            for column in df.columns:
                if test(column, needle):
                    return column
    return None


def bars(df: DataFrame, aliases: Mapping[str, Sequence[str]], keys: Sequence[str] = ("kind", "code")) -> DataFrame:
    """Vendor bars under the canonical names: parsed dates, cleaned numbers, no row without date or close."""
    def column(name: str) -> Column:
        found = resolved(df, aliases.get(name, (name,)))
        raw = F.lit(None).cast("string") if found is None else F.col(found)
        return (market_date(raw) if name == "date" else number(raw)).alias(name)

    names = ("date", "open", "high", "low", "close", "volume", "amount", "turnover")
    return df.select(*keys, *[column(n) for n in names]).filter("date is not null and close is not null")


def with_history(bars_: DataFrame, least: int = 12) -> tuple[DataFrame, DataFrame]:
    """Bars of entities with enough of them, and a rejects row for each of the others."""
    counted = bars_.groupBy("kind", "code").agg(F.count("*").alias("bars"))
    rejects = counted.filter(F.col("bars") < least).select("kind", "code", "bars", F.lit("too_short").alias("error"))
    return bars_.join(counted.filter(F.col("bars") >= least), ["kind", "code"], "left_semi"), rejects


def waterfall(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = ("kind", "code")) -> DataFrame:
    """The whole history of each entity from the first source that has any of it; sources are never mixed."""
    tagged = [df.withColumn("priority", F.lit(k)).withColumn("data_source", F.lit(name)) for k, (name, df) in enumerate(sources)]
    both = tagged[0]
    for other in tagged[1:]:
        both = both.unionByName(other)
    first = both.groupBy(*keys).agg(F.min("priority").alias("priority"))
    return both.join(first, [*keys, "priority"], "left_semi").drop("priority")


def source_trail(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str] = ("kind", "code")) -> DataFrame:
    """What a ``waterfall`` made of each source, in order: the entities it has, and those taken from it."""
    tagged = [df.select(*keys).distinct().withColumn("priority", F.lit(k)) for k, (_, df) in enumerate(sources)]
    own = functools.reduce(DataFrame.unionByName, tagged).withColumn("_first", F.min("priority").over(Window.partitionBy(*keys)))
    counted = own.groupBy("priority").agg(F.count("*").alias("offered"), F.sum((F.col("priority") == F.col("_first")).cast("long")).alias("taken"))
    every = counted.sparkSession.createDataFrame([(k, name) for k, (name, _) in enumerate(sources)], "priority int, source string")
    return every.join(counted, "priority", "left").select("priority", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("offered", "taken")])


def first_passing(sources: Sequence[tuple[str, DataFrame]], measures: Mapping[str, Column], gate: Column, namespaces: Mapping[str, str] | None = None, beside: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole table of the first source that passes a gate, and a trail with a row for each source.

    ``measures``: aggregates over a source's rows; ``gate``: a condition on them and on ``beside``, a table of one row; a source without
    rows fails. Rows get data_source, and namespace where sources name their codes differently: ``same_namespace`` guards later joins by
    it. Neither result needs an action; the trail says passed, chosen and why a source failed: empty or gate."""
    tagged = [df.withColumns({"priority": F.lit(k), "data_source": F.lit(name), "namespace": F.lit((namespaces or {}).get(name, "own"))}) for k, (name, df) in enumerate(sources)]
    both = functools.reduce(DataFrame.unionByName, tagged)
    measured = both.groupBy("priority").agg(F.count("*").alias("rows"), *[x.alias(n) for n, x in measures.items()])
    every = both.sparkSession.createDataFrame([(k, name) for k, (name, _) in enumerate(sources)], "priority int, source string")
    x = every.join(measured, "priority", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    x = x if beside is None else x.crossJoin(beside)  # one row
    x = x.withColumn("passed", (F.col("rows") > 0) & F.coalesce(gate, F.lit(False)))
    first = F.min(F.when(F.col("passed"), F.col("priority"))).over(Window.partitionBy(F.lit(0)))  # a row for each source
    trail = x.withColumn("chosen", F.coalesce(F.col("priority") == first, F.lit(False))).withColumn("reason", F.when(F.col("passed"), "").when(F.col("rows") == 0, "empty").otherwise("gate"))
    rows = both.join(trail.filter("chosen").select("priority"), "priority", "left_semi").drop("priority")
    return rows, trail.select("priority", "source", "rows", *measures, "passed", "chosen", "reason")


def same_namespace(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A join by code of tables whose sources name codes alike: rows of another namespace never meet."""
    return left.join(right, [*on, "namespace"])


def filtered_universe(boards: DataFrame, pattern: str, most: int | None = None) -> DataFrame:
    """Concepts whose name matches ``pattern`` go; an empty pattern keeps all; ``most`` boards of each kind stay."""
    kept = boards if not pattern else boards.filter(~F.coalesce((F.col("kind") == "concept") & F.col("name").rlike(pattern), F.lit(False)))
    if most is None:
        return kept
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy("code"))).filter(F.col("_n") <= most).drop("_n")


def flow_table(pieces: DataFrame) -> DataFrame:
    """Long rows (kind, name, window, pct) as one row for each board with a column for each window."""
    return pieces.groupBy("kind", "name").pivot("window", [1, 5, 10]).agg(F.first("pct")).select("kind", "name", *[F.col(str(k)).alias(f"flow_{k}d_pct") for k in (1, 5, 10)])


def quotes(raw: DataFrame, declared: int, share: float = 0.9) -> DataFrame:
    """Quotes keyed by the six digits of their code, first row of each; all rejected unless enough rows and market values
    of the declared total arrived."""
    code = F.regexp_extract("code", r"(\d{6})", 1)
    first = F.row_number().over(Window.partitionBy("code").orderBy(F.col("name"), F.col("price")))
    kept = raw.withColumn("code", code).filter("code <> ''").withColumn("_n", first).filter("_n = 1").drop("_n")
    gate = kept.agg(F.count("*").alias("_rows"), F.count(F.when(F.col("market_cap") > 0, 1)).alias("_caps"))
    passed = kept.join(F.broadcast(gate)).filter((F.col("_rows") >= share * declared) & (F.col("_caps") >= share * declared))
    return passed.drop("_rows", "_caps")


def quote_table(raw: DataFrame, aliases: Mapping[str, Sequence[str]], source: str, trade_date: Column, market_cap_unit: float = 1.0, comparable_pe: bool = True) -> DataFrame:
    """One source's quotes under the canonical names, stamped with the date of trade and the source; the first row of each code by name and price.

    ``aliases``: columns by canonical name (code, name, price, market_cap, pe_dynamic, pb); ``market_cap_unit``: what the source
    counts market values in; a source whose multiples are no trailing ones (``comparable_pe`` false) gives null."""
    def column(name: str) -> Column:
        found = resolved(raw, aliases.get(name, (name,)))
        return F.lit(None).cast("string") if found is None else F.col(f"`{found}`").cast("string")

    pe = number(column("pe_dynamic")) if comparable_pe else F.lit(None).cast("double")
    rows = raw.select(F.regexp_extract(column("code"), r"(\d{6})", 1).alias("code"), column("name").alias("name"), number(column("price")).alias("price"), (number(column("market_cap")) * market_cap_unit).alias("market_cap"), pe.alias("pe_dynamic"), number(column("pb")).alias("pb"))
    stamped = rows.filter("code <> ''").withColumns({"quote_trade_date": trade_date, "quote_source": F.lit(source)})
    return stamped.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy("name", "price"))).filter("_n = 1").drop("_n")


def members(raw: DataFrame) -> DataFrame:
    return raw.withColumn("code", F.regexp_extract("code", r"(\d{6})", 1)).filter("code <> ''").dropDuplicates(["board", "code"])


def history(raw: DataFrame, entity: str, date: str, order: str) -> DataFrame:
    """The last observation of each entity and trade date."""
    rows = raw.withColumn("trade_date", market_date(F.col(date))).filter("trade_date is not null")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(entity, "trade_date").orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def pool(default: DataFrame, custom: DataFrame, removed: DataFrame) -> DataFrame:
    """The curated pool with the custom one's other codes, without those removed from the custom one."""
    own = custom.join(default.select("code"), "code", "left_anti").join(removed.select("code"), "code", "left_anti")
    return default.withColumn("origin", F.lit("default")).unionByName(own.withColumn("origin", F.lit("custom")))


def resolve_boards(wanted: DataFrame, catalog: DataFrame, exact_only: bool = False) -> DataFrame:
    """For each wanted (id, alias_pos, alias) the catalog's board (code, name): exact names first, in the order of the
    aliases, then (unless ``exact_only``) names that hold each other, nearest in length.

    Names meet by equal parts: each name's distinct parts of any length against the other side's whole names, both ways. A name of n
    characters has at most n * (n + 1) / 2 parts, so the join grows with the names, not with their pairs."""
    a = wanted.withColumn("a", board_name(F.col("alias"))).filter("a <> ''")
    b = catalog.select("code", "name", board_name(F.col("name")).alias("b")).filter("b <> ''")
    b = b.groupBy("b").agg(F.min(F.struct("code", "name")).alias("first")).select("b", "first.*")  # of equal names the least code wins, so the others need not meet
    if exact_only:
        near = a.join(b, F.col("a") == F.col("b"))
    else:
        parts = lambda x: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.transform(F.sequence(F.lit(1), F.length(x) - i + 1), lambda n: F.substr(x, i, n))))))
        held = a.join(b.select("b").distinct().select("b", parts(F.col("b")).alias("a")), "a")
        holds_ = a.select("a").distinct().select("a", parts(F.col("a")).alias("b")).filter("a <> b").join(a, "a")
        near = held.select("id", "alias_pos", "alias", "a", "b").unionByName(holds_.select("id", "alias_pos", "alias", "a", "b")).join(b, "b")
    tier = F.when(F.col("a") == F.col("b"), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("id").orderBy(tier, "alias_pos", F.abs(F.length("a") - F.length("b")), "code"))
    return near.withColumn("tier", tier).withColumn("place", place).filter("place = 1").select("id", "alias", "code", "name", "tier")


def resolve_coded(wanted: DataFrame, catalog: DataFrame, exact_only: bool = False) -> DataFrame:
    """As ``resolve_boards``, but for rows of ``wanted`` with a ``board_code``: these find the board of that code of the catalog, or none;
    their alias is the code and their tier -1."""
    coded = F.coalesce(F.col("board_code") != "", F.lit(False))
    codes = wanted.filter(coded).select("id", F.col("board_code").alias("code")).distinct()
    by_code = codes.join(catalog.groupBy("code").agg(F.min("name").alias("name")), "code").select("id", F.col("code").alias("alias"), "code", "name", F.lit(-1).alias("tier"))
    return by_code.unionByName(resolve_boards(wanted.filter(~coded), catalog, exact_only))


def performance(raw: DataFrame, aliases: Mapping[str, Sequence[str]], attributable: Sequence[str], consolidated: Sequence[str]) -> DataFrame:
    """Reports under the canonical names, keyed by the six digits of their code, the first row of each by ``report_date`` and name.

    ``aliases``: columns by canonical name, cleaned to numbers but for code, name and report_date. Both profits are kept, each null where no
    column has it; net_profit is, row by row, the attributable one, else the consolidated one."""
    def column(names: Sequence[str]) -> Column:
        found = resolved(raw, names)
        return F.lit(None).cast("string") if found is None else F.col(f"`{found}`")

    plain = ("code", "name", "report_date")
    code = F.regexp_extract(column(aliases["code"]), r"(\d{6})", 1)
    x = raw.select(code.alias("code"), *[column(aliases[n]).cast("string").alias(n) for n in plain[1:]], *[number(column(a)).alias(n) for n, a in aliases.items() if n not in plain], number(column(attributable)).alias("attributable_net_profit"), number(column(consolidated)).alias("consolidated_net_profit"))
    x = x.filter("code <> ''").withColumn("net_profit", F.coalesce("attributable_net_profit", "consolidated_net_profit"))
    first = F.row_number().over(Window.partitionBy("report_date", "code").orderBy("name", "net_profit"))
    return x.withColumn("_n", first).filter("_n = 1").drop("_n")


def freshness(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and last moment of each dataset."""
    parts = [df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), F.max(F.col(moment).cast("date")).alias("last_date")) for name, (df, moment) in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def freshness_log(tables: Mapping[str, tuple[DataFrame, str, str | None, int]], now: DataFrame) -> DataFrame:
    """A row for each dataset, by name: rows, the source of its last row, when that landed, the minutes that a copy of it serves, and whether
    the stored copy still served at ``now`` (one row, one moment ``now``).

    ``tables``: frame, column of the moment, column of the source or None, minutes."""
    def described(name: str, df: DataFrame, moment: str, source: str | None, minutes: int) -> DataFrame:
        at = F.col(moment).cast("timestamp")
        label = F.lit("") if source is None else F.coalesce(F.max_by(source, F.struct(at, F.col(source))), F.lit(""))
        return df.agg(F.lit(name).alias("dataset"), F.count("*").alias("rows"), label.alias("source"), F.max(at).alias("fetched_at"), F.lit(minutes).alias("ttl_minutes"))

    rows = functools.reduce(DataFrame.unionByName, [described(n, *t) for n, t in tables.items()])
    served = F.timestamp_diff("MINUTE", F.col("fetched_at"), F.col("now")) <= F.col("ttl_minutes")
    return rows.crossJoin(now).withColumn("cache_used", F.coalesce(served, F.lit(False))).drop("now").orderBy("dataset")


def board_metrics(boards: DataFrame, metrics: DataFrame) -> DataFrame:
    """The universe's columns beside each board's metrics, for boards that have both; of repeated boards the first by name."""
    once = boards.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "code").orderBy("name"))).filter("_n = 1").drop("_n")
    return once.join(metrics, ["kind", "code"])


def universe(df: DataFrame) -> DataFrame:
    """Boards with breadth: risers among those that moved."""
    up, down = F.col("up_count"), F.col("down_count")
    return df.withColumn("breadth", F.when(up + down > 0, ratio(up, up + down)))
