"""Queries on sources, names, pools, configuration and views over the landed tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.functions import expr
from tidegauge.operators import canonical, fundamentals, history, trajectory, valuation, views
from tidegauge.plans import oracle as sql
from tidegauge.sources import adapters

c = F.col


def _table(name: str):
    return lambda spark, sf_dir: adapters.landed(spark, sf_dir, name)


customer, supplier, part, orders, nation, events = map(_table, ("customer", "supplier", "part", "orders", "nation", "events"))


def _text(column: str) -> Column:
    return c(column).cast("string")


def exchange_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every market and of none, bare or with a prefix."""
    digits = F.concat(F.element_at(F.array(*map(F.lit, "6034891")), (c("c_custkey") % 7 + 1).cast("int")), F.lpad((c("c_custkey") * 7919 % 100000).cast("string"), 5, "0"))
    raw = F.when(c("c_custkey") % 3 == 0, F.concat(F.lit("SH."), digits)).when(c("c_custkey") % 3 == 1, F.concat(F.lit(" sz"), digits, F.lit(" "))).otherwise(digits)
    return customer(spark, sf_dir).select(raw.alias("raw")).distinct().withColumn("code", expr.exchange_code(c("raw")))


EXCHANGE = """select distinct raw, case when c_custkey % 3 = 0 then lower(raw) when digits[1] = '6' then 'sh.' || digits when digits[1] in ('0', '3') then 'sz.' || digits when digits[1] in ('4', '8') or digits[:2] = '92' then 'bj.' || digits end as code
from (select *, case c_custkey % 3 when 0 then 'SH.' || digits when 1 then ' sz' || digits || ' ' else digits end as raw from (select c_custkey, substr('6034891', (c_custkey % 7 + 1)::int, 1) || lpad((c_custkey * 7919 % 100000)::varchar, 5, '0') as digits from customer))"""


def universe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = part(spark, sf_dir).select(F.when(c("p_partkey") % 2 == 0, "concept").otherwise("industry").alias("kind"), _text("p_partkey").alias("code"), c("p_name").alias("name"))
    return canonical.filtered_universe(boards, "^cold|gadget", 40)


UNIVERSE = """select kind, code, name from (select *, row_number() over (partition by kind order by code) as n from (select case when p_partkey % 2 = 0 then 'concept' else 'industry' end as kind, p_partkey::varchar as code, p_name as name from part)
where not (kind = 'concept' and regexp_matches(name, '^cold|gadget'))) where n <= 40"""


def history_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with twelve orders or more, and a reject for each of the others."""
    kept, rejects = canonical.with_history(orders(spark, sf_dir).select(F.lit("customer").alias("kind"), _text("o_custkey").alias("code"), "o_orderdate"))
    counted = kept.groupBy("kind", "code").agg(F.count("*").alias("bars"), F.lit("").alias("error"))
    return counted.unionByName(rejects)


SPLIT = "select 'customer' as kind, o_custkey::varchar as code, count(*) as bars, case when count(*) < 12 then 'too_short' else '' end as error from orders group by o_custkey"


def flow_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = F.when(F.floor("l_quantity") % 3 == 0, 1).when(F.floor("l_quantity") % 3 == 1, 5).otherwise(10)
    pieces = adapters.landed(spark, sf_dir, "lineitem").select(F.lit("concept").alias("kind"), _text("l_suppkey").alias("name"), window.alias("window"), "l_discount", "l_suppkey").filter("not (l_suppkey % 4 = 0 and window = 5)")
    return canonical.flow_table(pieces.groupBy("kind", "name", "window").agg((F.avg("l_discount") * 100).alias("pct")))


_WINDOWS = {1: "0", 5: "1", 10: "2"}
FLOWS = "with wide as (select 'concept' as kind, l_suppkey::varchar as name, " + ", ".join(f"avg(l_discount) filter (floor(l_quantity) % 3 = {m}{' and l_suppkey % 4 <> 0' if n == 5 else ''}) * 100 as flow_{n}d_pct" for n, m in _WINDOWS.items()) + " from lineitem group by l_suppkey) select kind, name, " + ", ".join(f"{sql.settled(f'flow_{n}d_pct')} as flow_{n}d_pct" for n in _WINDOWS) + " from wide"


def quote_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that arrived twice, under prefixed codes; one batch has enough positive values, the other is rejected."""
    own = supplier(spark, sf_dir)
    raw = own.select(F.concat(F.lit("sh"), F.lpad(_text("s_suppkey"), 6, "0")).alias("code"), c("s_name").alias("name"), c("s_acctbal").alias("price"), (F.abs("s_acctbal") + 1).alias("market_cap"))
    declared = own.count()
    short = raw.withColumn("market_cap", F.when(F.right("code", F.lit(1)) < "5", c("market_cap")))
    passed = canonical.quotes(raw.unionByName(raw.withColumn("price", c("price") + 1)), declared).withColumn("batch", F.lit("whole"))
    return passed.unionByName(canonical.quotes(short, declared).withColumn("batch", F.lit("short")))


QUOTES = f"select 'whole' as batch, lpad(s_suppkey::varchar, 6, '0') as code, s_name as name, {sql.settled('s_acctbal')} as price, {sql.settled('abs(s_acctbal) + 1')} as market_cap from supplier"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = customer(spark, sf_dir).select(F.concat(F.lit("board_"), _text("c_nationkey")).alias("board"), F.when(c("c_custkey") % 11 == 0, "n/a").otherwise(F.concat(F.lit("SZ"), F.lpad((c("c_custkey") % 50).cast("string"), 6, "0"))).alias("code"))
    return canonical.members(raw)


MEMBERS = "select distinct 'board_' || c_nationkey as board, lpad((c_custkey % 50)::varchar, 6, '0') as code from customer where c_custkey % 11 <> 0"


def history_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with dates of two forms and none; the last of each entity and date stays."""
    ts = c("ts").cast("timestamp")
    written = F.when(c("event_id") % 13 == 0, "unknown").when(c("event_id") % 2 == 0, F.date_format(ts, "yyyyMMdd")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    return canonical.history(events(spark, sf_dir).select("user_id", written.alias("date"), "event_id", "value"), "user_id", "date", "event_id")


PREPARE = f"select user_id, trade_date::varchar as trade_date, event_id, {sql.settled('value')} as value from (select *, ts::date as trade_date, row_number() over (partition by user_id, ts::date order by event_id desc) as n from events where event_id % 13 <> 0) where n = 1"


def pool_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stocks = customer(spark, sf_dir).select(_text("c_custkey").alias("code"), c("c_name").alias("name"), "c_custkey")
    picked = lambda n: stocks.filter(c("c_custkey") % n == 0).select("code", "name")
    return canonical.pool(picked(3), picked(2), picked(5).select("code"))


POOL = "select c_custkey::varchar as code, c_name as name, case when c_custkey % 3 = 0 then 'default' else 'custom' end as origin from customer where c_custkey % 3 = 0 or (c_custkey % 2 = 0 and c_custkey % 5 <> 0)"


def board_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's aliases: its name with a suffix, a part of it, or a foreign one first; loosely, and by exact names only."""
    boards = nation(spark, sf_dir).select(_text("n_nationkey").alias("code"), F.concat("n_name", F.lit("概念")).alias("name"), "n_nationkey", "n_name")
    own = F.when(c("n_nationkey") % 3 == 0, F.substring("n_name", 2, 20)).otherwise(F.concat(F.lit(" "), "n_name", F.lit("板块")))
    wanted = boards.select(c("n_nationkey").alias("id"), F.posexplode(F.array(F.lit("elsewhere"), own)).alias("alias_pos", "alias"))
    parts = [canonical.resolve_boards(wanted, boards.select("code", "name"), exact).withColumn("exact_only", F.lit(exact)) for exact in (False, True)]
    return parts[0].unionByName(parts[1])


RESOLUTION = """with boards as (select n_nationkey as id, n_nationkey::varchar as code, n_name || '概念' as name, lower(replace(n_name, '_', '')) as b, case when n_nationkey % 3 = 0 then substr(n_name, 2, 20) else ' ' || n_name || '板块' end as alias,
  case when n_nationkey % 3 = 0 then lower(replace(substr(n_name, 2, 20), '_', '')) else lower(replace(n_name, '_', '')) end as a from nation),
met as (select w.id, w.alias, c.code, c.name, case when w.a = c.b then 0 else 1 end as tier, abs(length(w.a) - length(c.b)) as away from boards w join boards c on contains(c.b, w.a) or contains(w.a, c.b)),
ranked as (select *, x as exact_only, row_number() over (partition by x, id order by tier, away, code) as n from met, (values (false), (true)) as f(x) where not x or tier = 0)
select id, alias, code, name, tier::bigint as tier, exact_only from ranked where n = 1"""


def last_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.stock_bars(spark, sf_dir).select("stock_code", "date", F.when(F.dayofmonth("date") % 5 != 0, c("close")).alias("close"))
    return history.last_positive(rows, "stock_code", "close", "date", 20).select("stock_code", "date", "close")


LAST = sql.query(f"{sql.STOCKS},\nlatest as (select *, row_number() over (partition by stock_code order by date desc) as n from stock_bars where day(date) % 5 <> 0 and close > 0)", "latest", f"stock_code, date::varchar as date, {sql.settled('close')} as close") + " where n <= 20"


def version_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values of other versions, configurations or universes are not read."""
    stored = orders(spark, sf_dir).select("o_orderkey", F.when(c("o_orderkey") % 2 == 0, "v0").otherwise("v1").alias("model_version"), (c("o_orderkey") % 3).cast("string").alias("config_hash"), (c("o_custkey") % 5).cast("string").alias("sector"), (c("o_orderkey") % 7).cast("string").alias("universe_hash"))
    universe = spark.range(5).select(_text("id").alias("sector"), _text("id").alias("universe_hash"))
    return trajectory.of_version(stored, "v1", "2", universe)


VERSIONS = "select o_orderkey, (o_custkey % 5)::varchar as sector from orders where o_orderkey % 2 = 1 and o_orderkey % 3 = 2 and o_orderkey % 7 = o_custkey % 5"


def display_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, ("", "Ⅰ", "Ⅱ"))), (c("p_partkey") % 3 + 1).cast("int"))
    boards = part(spark, sf_dir).select(c("p_type").alias("kind"), _text("p_partkey").alias("code"), F.concat("p_brand", level).alias("name"), c("p_retailprice").alias("mainline_score"))
    return views.display_groups(boards)


GROUPS = f"select kind, code, name, display_group, {sql.settled('score')} as mainline_score from (select p_type as kind, p_partkey::varchar as code, p_brand || case p_partkey % 3 when 0 then '' when 1 then 'Ⅰ' else 'Ⅱ' end as name, p_brand as display_group, p_retailprice as score, row_number() over (partition by p_type, p_brand order by p_retailprice desc, p_partkey::varchar) as n from part) where n = 1"


def presentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as shown: kinds by their labels where one is known, ratios as percent, names in front."""
    rows = canonical.universe(adapters.bars(spark, sf_dir)).withColumn("label", views.decoded(c("kind"), {"industry": "行业"}))
    return views.fronted(views.scaled(rows, ["breadth"]), ["label", "code", "date"])


PRESENTED = sql.query(sql.BARS, "bars", f"case kind when 'industry' then '行业' else kind end as label, code, date::varchar as date, {sql.settled('100.0 * up_count / nullif(up_count + down_count, 0)')} as breadth")


def age_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of each order at the last order's date: quotes count in full for 5 days and not after 30, reports for 200 and 600."""
    last = orders(spark, sf_dir).agg(F.max(F.to_date("o_orderdate"))).first()[0]
    age = F.when(c("o_orderkey") % 9 != 0, F.datediff(F.lit(last).cast("date"), F.to_date("o_orderdate")))
    started = F.when(c("o_orderkey") % 4 != 0, F.to_date("o_orderdate"))
    return orders(spark, sf_dir).select("o_orderkey", fundamentals.age_score(age, 5, 30).alias("quote_score"), fundamentals.age_score(age, 200, 600).alias("report_score"), valuation.bootstrap_weight(F.lit(last).cast("date"), started).alias("bootstrap_weight"))


_AGE = lambda full, zero: f"case when o_orderkey % 9 = 0 then 0.0 else greatest(0, least(1, ({zero} - age) / {float(zero - full)}::double)) end"
AGES = f"select o_orderkey, {sql.settled(_AGE(5, 30))} as quote_score, {sql.settled(_AGE(200, 600))} as report_score, {sql.settled('case when o_orderkey % 4 = 0 or age > 180 then 0.0 else 0.3::double * greatest(0.1::double, 1 - greatest(0, age) / 180.0::double) end')} as bootstrap_weight from (select o_orderkey, (max(o_orderdate::date) over ()) - o_orderdate::date as age from orders)"


def growth_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth read off balances, for a family of each branch; some parts unknown."""
    model = F.element_at(F.array(*map(F.lit, ("growth_pe", "utility", "cyclical_growth", "bank"))), (c("s_suppkey") % 4 + 1).cast("int"))
    x = c("s_acctbal") / 10000
    return supplier(spark, sf_dir).select("s_suppkey", model.alias("model"), F.when(c("s_suppkey") % 7 != 0, x - 0.2).alias("revenue"), F.when(c("s_suppkey") % 11 != 0, x - 0.35).alias("profit"), F.when(c("s_suppkey") % 13 != 0, x - 0.3).alias("cash")).withColumn("gate", valuation.growth_gate(c("model"), c("revenue"), c("profit"), c("cash")))


GATES = """with x as (select s_suppkey, case s_suppkey % 4 when 0 then 'growth_pe' when 1 then 'utility' when 2 then 'cyclical_growth' else 'bank' end as model, case when s_suppkey % 7 <> 0 then s_acctbal / 10000 - 0.2::double end as revenue,
  case when s_suppkey % 11 <> 0 then s_acctbal / 10000 - 0.35::double end as profit, case when s_suppkey % 13 <> 0 then s_acctbal / 10000 - 0.3::double end as cash from supplier)
select s_suppkey, model, case when model = 'utility' then case when profit < -0.25 then 'watch' else 'pass' end when model = 'cyclical_growth' then case when revenue is null or profit is null or cash < 0 then 'fail' else 'pass' end
  when revenue is null or profit is null or profit < -0.1 or revenue < -0.1 then 'fail' when profit < case model when 'growth_pe' then 0.10 else 0.03 end then 'watch' else 'pass' end as gate from x"""


def sector_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = customer(spark, sf_dir).withColumn("code", (c("c_custkey") % 40).cast("string")).groupBy("code", c("c_mktsegment").alias("sector")).agg(F.count("*").alias("n"))
    boards = hits.select("code", "sector", (c("n") % 4).alias("board_hits"), F.lit(3).alias("boards"), F.length("sector").alias("priority"))
    return valuation.infer_sectors(boards, codes=customer(spark, sf_dir).select((c("c_custkey") % 44).cast("string").alias("code")))  # four of them in no board


INFERENCE = f"""with hits as (select (c_custkey % 40)::varchar as code, c_mktsegment as sector, count(*) % 4 as board_hits, length(c_mktsegment) as priority from customer group by all),
ranked as (select *, least(1, board_hits / 3.0::double) as score, row_number() over w as n, lead(least(1, board_hits / 3.0::double)) over w as runner, count(*) over (partition by code) as candidates from hits window w as (partition by code order by least(1, board_hits / 3.0::double) desc, board_hits desc, priority, sector)),
best as (select *, least(1, 0.55::double * score + 0.45::double * greatest(0, score - coalesce(runner, 0))) as confidence from ranked where n = 1),
judged as (select *, confidence >= 0.6::double and not coalesce(abs(score - runner) < 0.2::double, false) as clear from best)
select code, case when clear then sector else 'MODEL_REVIEW_REQUIRED' end as sector, sector as suggested_sector, case when clear then 'OK' else 'MODEL_REVIEW_REQUIRED' end as classification_status, {sql.settled('confidence')} as classification_confidence, candidates::bigint as candidates from judged
union all select distinct (c_custkey % 44)::varchar, 'MODEL_UNRESOLVED', null, 'MODEL_UNRESOLVED', 0, 0 from customer where c_custkey % 44 >= 40"""


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks with each cause for a look, and the row for all when most stages are unknown."""
    k = c("c_custkey")
    flags = {"res_status": F.when(k % 17 == 0, "SHORT").otherwise("OK"), "trade_band_source": F.when(k % 19 == 0, "MODEL_PRIOR_BANDS").otherwise("RESIDUAL"), "stage": F.when(k % 10 == 1, "Seed").otherwise("UNKNOWN"), "model_weight_coverage": F.when(k % 23 == 0, 0.5).otherwise(0.9), "floor_hit": k % 29 == 0, "cap_hit": k % 31 == 0, "growth_regime": F.when(k % 37 == 0, "DECLINE").otherwise("NORMAL"), "classification_confidence": F.when(k % 41 == 0, 0.5).otherwise(0.9), "revenue_growth": F.when(k % 43 != 0, 0.1), "profit_growth": F.lit(0.1), "model": F.when(k % 2 == 0, "utility").otherwise("growth_pe")}
    stocks = customer(spark, sf_dir).select(_text("c_custkey").alias("code"), *[x.alias(n) for n, x in flags.items()], F.when(k % 7 == 0, "NO_ANCHOR").otherwise("OK").alias("valuation_status"), F.when(k % 5 != 0, 0.7).alias("quality"), F.when(k % 6 == 0, "fail").otherwise("pass").alias("gate"))
    return views.warnings(stocks.withColumn("risk_flags", valuation.risk_flags(stocks)))


_FLAGS = {"RESIDUAL_HISTORY_INSUFFICIENT": "17 = 0", "MODEL_PRIOR_BANDS": "19 = 0", "MAINLINE_UNKNOWN": "10 <> 1", "LOW_MODEL_COVERAGE": "23 = 0", "DECLINE": "37 = 0", "FAIR_PE_FLOOR_HIT": "29 = 0", "FAIR_PE_CAP_HIT": "31 = 0", "SECTOR_LOW_CONFIDENCE": "41 = 0", "GROWTH_DATA_MISSING": "43 = 0 and c_custkey % 2 = 1"}
WARNINGS = "with stocks as (select c_custkey, concat_ws(';', " + ", ".join(f"case when c_custkey % {x} then '{n}' end" for n, x in _FLAGS.items()) + ") as risk_flags from customer)" + """
select c_custkey::varchar as code, case when c_custkey % 7 = 0 then 'NO_ANCHOR' else 'OK' end as valuation_status, risk_flags from stocks where c_custkey % 7 = 0 or c_custkey % 5 = 0 or c_custkey % 6 = 0 or risk_flags <> ''
union all select 'ALL', 'STAGE_UNKNOWN', '' from stocks having avg((c_custkey % 10 <> 1)::int) >= 0.8"""

#: Name, plan, columns and SQL of each query.
ENTRIES = [
    ("exchange_codes", exchange_codes, ["raw", "code"], EXCHANGE),
    ("universe_filter", universe_filter, ["kind", "code", "name"], UNIVERSE),
    ("history_split", history_split, ["kind", "code", "bars", "error"], SPLIT),
    ("flow_pivot", flow_pivot, ["kind", "name", *[f"flow_{n}d_pct" for n in _WINDOWS]], FLOWS),
    ("quote_gate", quote_gate, ["batch", "code", "name", "price", "market_cap"], QUOTES),
    ("constituents_canonical", members, ["board", "code"], MEMBERS),
    ("history_prepare", history_prepare, ["user_id", "trade_date", "event_id", "value"], PREPARE),
    ("pool_merge", pool_merge, ["code", "name", "origin"], POOL),
    ("board_resolution", board_resolution, ["id", "alias", "code", "name", "tier", "exact_only"], RESOLUTION),
    ("last_750", last_observations, ["stock_code", "date", "close"], LAST),
    ("version_isolation", version_isolation, ["o_orderkey", "sector"], VERSIONS),
    ("display_groups", display_groups, ["kind", "code", "name", "display_group", "mainline_score"], GROUPS),
    ("presentation", presentation, ["label", "code", "date", "breadth"], PRESENTED),
    ("age_scores", age_scores, ["o_orderkey", "quote_score", "report_score", "bootstrap_weight"], AGES),
    ("growth_gates", growth_gates, ["s_suppkey", "model", "gate"], GATES),
    ("sector_inference", sector_inference, ["code", "sector", "suggested_sector", "classification_status", "classification_confidence", "candidates"], INFERENCE),
    ("warnings", warnings, ["code", "valuation_status", "risk_flags"], WARNINGS),
]
