"""Whole tables chosen among sources, and snapshots written and listed, on the landed tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.functions.expr import settled
from tidegauge.operators import canonical
from tidegauge.plans import live, oracle as sql
from tidegauge.sources import adapters, snapshots

c = F.col


def _catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boards from a source that has none, from one of industries only, and from one of both kinds that names codes its own way."""
    part = adapters.landed(spark, sf_dir, "part").select(F.when(c("p_partkey") % 2 == 0, "concept").otherwise("industry").alias("kind"), c("p_partkey").cast("string").alias("code"), c("p_name").alias("name"))
    sources = [("direct", part.filter("kind = 'none'")), ("mirror", part.filter("kind = 'industry'")), ("other", part.withColumn("code", F.concat(F.lit("T"), "code"))), ("last", part)]
    return canonical.first_passing(sources, {"kinds": F.count_distinct("kind")}, c("kinds") == 2, {"other": "themes"})


def catalog_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the chosen catalog's boards: lines are landed under both kinds of codes, and only those of its own meet it."""
    lines = adapters.landed(spark, sf_dir, "lineitem").groupBy(c("l_partkey").cast("string").alias("code")).agg(F.count("*").alias("lines"))
    both = lines.withColumn("namespace", F.lit("own")).unionByName(lines.select(F.concat(F.lit("T"), "code").alias("code"), (-c("lines")).alias("lines"), F.lit("themes").alias("namespace")))
    return canonical.same_namespace(_catalogs(spark, sf_dir)[0], both, ["code"])


def _quotes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Quotes from a source that lacks stocks, from one that lacks market values, and from one that has both; the universe says how many there should be."""
    spot = adapters.spot(spark, sf_dir).select("code", "name", "price").withColumn("market_cap", F.lit(1000.0) * (c("code").cast("long") + 1))
    number = c("code").cast("long")
    sources = [("fast", spot.filter(number % 3 != 0)), ("partial", spot.withColumn("market_cap", F.when(number % 2 == 0, c("market_cap")))), ("slow", spot)]
    declared = adapters.landed(spark, sf_dir, "supplier").agg(F.count("*").alias("declared"))
    enough = (c("rows") >= 0.9 * c("declared")) & (c("caps") >= 0.9 * c("declared"))
    return canonical.first_passing(sources, {"caps": F.count(F.when(c("market_cap") > 0, 1))}, enough, beside=declared)


def source_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trail of ``source_waterfall``."""
    rows = adapters.bars(spark, sf_dir).select("kind", "code").distinct()
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("long")
    return canonical.source_trail([("primary", rows.filter(number % 3 == 0)), ("secondary", rows.filter(number % 2 == 0)), ("synthetic", rows), ("spare", rows.limit(0))])


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Snapshots in a folder of their own, the odd days' moments written twice, and two folders whose names state no moment."""
    folder, rows = f"{live._folder(spark)}/snapshots", adapters.snapshots(spark, sf_dir)
    snapshots.write(rows.withColumn("mainline_score", F.when(F.dayofmonth("captured_at") % 2 == 1, -1.0).otherwise(c("mainline_score"))), folder)
    snapshots.write(rows.filter(F.dayofmonth("captured_at") % 2 == 1), folder)
    for name in ("latest", "2024-13-01_000000"):
        rows.filter("kind = 'click'").write.parquet(f"{folder}/{snapshots.FOLDER}={name}")
    return folder, rows


def snapshot_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = _stored(spark, sf_dir)
    return snapshots.read(spark, folder, rows.schema)


def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, rows = _stored(spark, sf_dir)
    return snapshots.listed(spark, folder, rows.schema)


def _cents(x: Column) -> Column:
    """Sums of lines end on half cents, and the last bit of a sum must not decide: the cut lies just below the half."""
    return settled(x, 2)


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as a vendor writes them, in cents with halves up: prefixed codes, numbers as text with marks, attributable profit missing from every third row, rows twice."""
    said = adapters.performance(spark, sf_dir).select(
        F.concat(F.lit("sh."), "code").alias("stock code"), F.concat(F.lit("n"), "code").alias("short name"), c("report_date").alias("period"), F.concat(_cents(c("revenue")).cast("decimal(20,2)").cast("string"), F.lit(" ")).alias("total revenue"),
        F.when(c("code").cast("long") % 3 != 0, _cents(c("net_profit")).cast("decimal(20,2)").cast("string")).otherwise("--").alias("profit of owners"), _cents(c("net_profit") * 2).cast("decimal(20,2)").cast("string").alias("net profit"),
    )
    aliases = {"code": ["code"], "name": ["short name"], "report_date": ["period"], "revenue": ["revenue"], "eps": ["per share"]}
    return canonical.performance(said.unionByName(said), aliases, ["profit of owners"], ["net profit"])


_SCORES = ["mainline_score", "confirmation_score", "ignition_score", "breadth"]
_MOMENT = "strftime(captured_at, '%Y-%m-%d %H:%M:%S') as captured_at"
_SPOT = "select lpad(s_suppkey::varchar, 6, '0') as code, s_name as name, price, 1000.0::double * (s_suppkey + 1) as market_cap, 'slow' as data_source from supplier left join (select l_suppkey, max_by(price, month) as price from (select l_suppkey, date_trunc('month', l_shipdate) as month, avg(l_extendedprice / l_quantity) as price from lineitem group by 1, 2) group by 1) on l_suppkey = s_suppkey"
_TRAIL = ["priority", "source", "rows"]
#: Name, plan, columns and SQL of each query.
ENTRIES = [
    ("catalog_choice", lambda s, d: _catalogs(s, d)[0], ["kind", "code", "name", "data_source", "namespace"], "select case when p_partkey % 2 = 0 then 'concept' else 'industry' end as kind, 'T' || p_partkey as code, p_name as name, 'other' as data_source, 'themes' as namespace from part"),
    ("catalog_trail", lambda s, d: _catalogs(s, d)[1], [*_TRAIL, "kinds", "passed", "chosen", "reason"], "with n as (select count(*) as n, count(*) filter (p_partkey % 2 = 1) as odd from part) select 0 as priority, 'direct' as source, 0 as rows, null::bigint as kinds, false as passed, false as chosen, 'empty' as reason union all select 1, 'mirror', odd, 1, false, false, 'gate' from n union all select 2, 'other', n, 2, true, true, '' from n union all select 3, 'last', n, 2, true, false, '' from n"),
    ("catalog_members", catalog_members, ["code", "name", "lines"], "select 'T' || p_partkey as code, p_name as name, -count(*)::bigint as lines from part join lineitem on l_partkey = p_partkey group by all"),
    ("quote_choice", lambda s, d: _quotes(s, d)[0], ["code", "name", "price", "market_cap", "data_source"], f"with spot as ({_SPOT}) select {sql.listed(['price', 'market_cap'], ['code', 'name', 'data_source'])} from spot"),
    ("quote_trail", lambda s, d: _quotes(s, d)[1], [*_TRAIL, "caps", "passed", "chosen", "reason"], "with n as (select count(*) as n, count(*) filter (s_suppkey % 3 <> 0) as two, count(*) filter (s_suppkey % 2 = 0) as even from supplier) select 0 as priority, 'fast' as source, two as rows, two as caps, false as passed, false as chosen, 'gate' as reason from n union all select 1, 'partial', n, even, false, false, 'gate' from n union all select 2, 'slow', n, n, true, true, '' from n"),
    ("source_trail", source_trail, ["priority", "source", "offered", "taken"], sql.query(sql.BARS, "(select distinct kind, code, regexp_extract(code, '([0-9]+)$', 1)::bigint as n from bars), (values (0, 'primary'), (1, 'secondary'), (2, 'synthetic'), (3, 'spare')) as s(priority, source) group by all", "priority, source, count(*) filter (case priority when 0 then n % 3 = 0 when 1 then n % 2 = 0 else priority = 2 end) as offered, count(*) filter (case priority when 0 then n % 3 = 0 when 1 then n % 3 <> 0 and n % 2 = 0 when 2 then n % 3 <> 0 and n % 2 <> 0 else false end) as taken")),
    ("snapshot_store", snapshot_store, ["captured_at", "kind", "code", *_SCORES], sql.query(sql.SNAPSHOTS, "snapshots", sql.listed(_SCORES, [_MOMENT, "kind", "code"]))),
    ("snapshot_list", snapshot_list, ["name", "captured_at", "rows"], f"with {sql.SNAPSHOTS.strip()} select strftime(captured_at, '%Y-%m-%d_%H%M%S') as name, {_MOMENT}, count(*) as rows from snapshots group by captured_at union all select n, null, count(*) from snapshots, (values ('latest'), ('2024-13-01_000000')) as odd(n) where kind = 'click' group by n"),
    ("performance_canonical", performance, ["report_date", "code", "name", "revenue", "eps", "attributable_net_profit", "consolidated_net_profit", "net_profit"],
     f"with {sql.REPORTS.strip()}, two as (select report_date, code, (floor(revenue * 100 + 0.500123) / 100)::decimal(20, 2)::double as revenue, case when code::bigint % 3 <> 0 then (floor(net_profit * 100 + 0.500123) / 100)::decimal(20, 2)::double end as own, (floor(net_profit * 2 * 100 + 0.500123) / 100)::decimal(20, 2)::double as whole from performance) select report_date, code, 'n' || code as name, {sql.settled('revenue')} as revenue, null::double as eps, {sql.settled('own')} as attributable_net_profit, {sql.settled('whole')} as consolidated_net_profit, {sql.settled('coalesce(own, whole)')} as net_profit from two"),
]
