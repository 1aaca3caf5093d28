"""Provenance, extracts and heads of reports, tables of quotes, boards by code, and indexes of traded sessions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.operators import audit, canonical, synthetic, valuation
from tidegauge.plans import auditing, oracle as sql, panel
from tidegauge.sources import adapters

c = F.col


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of lines have no constituents; nations' boards are synthetic."""
    own = adapters.bars(spark, sf_dir).select("kind", "code", "date", "data_source", F.lit(None).cast("long").alias("constituent_count"), F.lit(None).cast("double").alias("synthetic_coverage"))
    made = synthetic.index(adapters.constituents(spark, sf_dir), adapters.stock_bars(spark, sf_dir))
    return audit.provenance(own.unionByName(made.select(F.lit("nation").alias("kind"), c("board").alias("code"), "date", "data_source", "constituent_count", "synthetic_coverage")))


PROVENANCE = f"""{sql.BARS},{sql.SYNTHETIC},
provenance as (select distinct kind, code, 'lines' as history_source, null::double as synthetic_constituents, null::double as synthetic_coverage from bars
               union all select 'nation', board, 'synthetic_index', median(constituent_count), avg(synthetic_coverage) from synthetic group by board)"""


def subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit is read twice by its places, so it is written once."""
    return audit.subsets(audit.placed(panel.cut(auditing.rows(auditing.bars(spark, sf_dir)))))


SUBSETS = f"""{auditing.AUDIT},
extracts as (select * from (select *, row_number() over (order by is_omitted desc, audit_status, kind, name, code) as place, case when is_omitted then 'omitted' when audit_status <> 'complete' then 'warnings' end as subset from audited) where subset is not null)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards with a score as of their last bar, and those that could not be fetched, as the audit has them."""
    lines = auditing.bars(spark, sf_dir)
    last = lines.groupBy("kind", "code").agg(F.max("date").alias("as_of"))
    number = F.regexp_extract("code", r"(\d+)$", 1).cast("long")
    return audit.facts(last.filter(number % 6 != 1), last.filter((number % 10).isin(7, 9)), audit.summary(auditing.rows(lines)))


FACTS = f"""{auditing.SUMMARY},
facts as (select (select max(date) from bars join boards using (kind, code) where number % 6 <> 1)::varchar as data_cutoff, (select count(*) from boards where number % 6 <> 1) as scored, (select count(*) from boards where number % 10 in (7, 9)) as failures,
          universe, filtered, target, scored as target_scored, target_coverage_pct from shares where kind = 'all')"""


def _vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks' bars as texts with a status: none trades in February, and every fourth in one year only."""
    rows = adapters.stock_bars(spark, sf_dir)
    paused = (F.month("date") == 2) | ((c("stock_code").cast("long") % 4 == 1) & (F.year("date") != 1993))
    return rows.withColumn("trade_status", F.when(paused, "0").otherwise(" 1")).withColumn("date", F.date_format("date", "yyyyMMdd"))


_TRADED = "month(date) <> 2 and not (stock_code::bigint % 4 = 1 and year(date) <> 1993)"
_TRADED_SQL = sql.SYNTHETIC.replace("from months)", f"from months where {_TRADED})")


def traded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = synthetic.index(adapters.constituents(spark, sf_dir), synthetic.traded(_vendor_bars(spark, sf_dir)))
    return rows.withColumn("ln_close", F.log("close"))


def index_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' boards, and one whose constituents are unknown."""
    known = adapters.constituents(spark, sf_dir).select("board", "stock_code")
    nobody = adapters.landed(spark, sf_dir, "region").select(c("r_name").alias("board"), F.lit(None).cast("string").alias("stock_code"))
    return synthetic.rejects(known.unionByName(nobody), synthetic.traded(_vendor_bars(spark, sf_dir)))


REJECTS = f"""{sql.STOCKS},
first_codes as (select board, stock_code from (select board, stock_code, row_number() over (partition by board order by stock_code) as place from constituents) where place <= 24),
long_enough as (select stock_code from stock_bars where {_TRADED} group by 1 having count(*) >= 12),
counts as (select board, count(*) as mapped, count(*) filter (stock_code in (select stock_code from long_enough)) as valid from first_codes group by board union all select r_name, 0, 0 from region),
refused as (select *, case when mapped < 3 then 'too_few_members' else 'too_few_histories' end as error from counts where mapped < 3 or valid < 3)"""


def quotes_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of one source under its own headings with marks of thousands, and of another that counts market values in ten thousands and states other multiples; each lands twice."""
    own, key = adapters.landed(spark, sf_dir, "supplier"), c("s_suppkey")
    code = F.lpad(key.cast("string"), 6, "0")
    day = F.lit("1998-12-01").cast("date")
    figures = {"最新价": F.format_number(key * 1234, 0), "总市值": (key * 10000 + 5000).cast("string"), "市盈率-动态": F.when(key % 3 == 0, "-").otherwise(key.cast("string")), "市净率": c("s_acctbal").cast("string")}
    board = own.select(F.concat(F.lit("sz"), code).alias("股票代码"), c("s_name").alias("股票简称"), *[x.alias(n) for n, x in figures.items()])
    other = own.select(code.alias("code"), c("s_name").alias("name"), (key * 2).cast("string").alias("trade"), (key + 0.5).cast("string").alias("mktcap"), key.cast("string").alias("per"), F.when(key % 4 != 0, c("s_acctbal")).alias("pb"))
    first = {"code": ("代码", "股票代码"), "name": ("名称", "股票简称"), "price": ("最新价",), "market_cap": ("总市值",), "pe_dynamic": ("市盈率-动态", "市盈率"), "pb": ("市净率",)}
    second = {"price": ("trade",), "market_cap": ("mktcap",), "pe_dynamic": ("per",)}
    parts = (canonical.quote_table(board.unionByName(board), first, "board", day), canonical.quote_table(other.unionByName(other), second, "other", day, 10000.0, comparable_pe=False))
    return parts[0].unionByName(parts[1])


_QUOTE = ["price", "market_cap", "pe_dynamic", "pb"]
QUOTES = f"""quotes as (select lpad(s_suppkey::varchar, 6, '0') as code, s_name as name, s_suppkey * 1234 as price, s_suppkey * 10000 + 5000 as market_cap, case when s_suppkey % 3 <> 0 then s_suppkey end as pe_dynamic, s_acctbal as pb, 'board' as quote_source from supplier
           union all select lpad(s_suppkey::varchar, 6, '0'), s_name, s_suppkey * 2, s_suppkey * 10000 + 5000, null, case when s_suppkey % 4 <> 0 then s_acctbal end, 'other' from supplier)"""


def board_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as boards: wanted by their code, by a code that is none though the name is right, and by name."""
    parts = adapters.landed(spark, sf_dir, "part")
    key = c("p_partkey")
    catalog = parts.select(key.cast("string").alias("code"), F.concat(c("p_name"), F.lit("概念")).alias("name"))
    code = F.when(key % 3 == 0, key.cast("string")).when(key % 3 == 1, F.concat(F.lit("X"), key.cast("string"))).otherwise("")
    wanted = parts.select(key.alias("id"), F.lit(0).alias("alias_pos"), c("p_name").alias("alias"), code.alias("board_code"))
    return canonical.resolve_coded(wanted, catalog, exact_only=True)


CODES = """with own as (select p_partkey as id, p_partkey::varchar as code, p_name as name, replace(lower(p_name), ' ', '') as k from part)
select id, code as alias, code, name || '概念' as name, (-1)::bigint as tier from own where id % 3 = 0
union all select w.id, w.name, arg_min(o.code, o.code), arg_min(o.name || '概念', o.code), 0 from own w join own o using (k) where w.id % 3 = 2 group by w.id, w.name"""


def freshness_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events say their source; the log is taken at their last moment."""
    events = adapters.landed(spark, sf_dir, "events")
    tables = {"lines": (adapters.landed(spark, sf_dir, "lineitem"), "l_shipdate", None, 30), "events": (events, "ts", "event_type", 5), "orders": (adapters.landed(spark, sf_dir, "orders"), "o_orderdate", "o_orderstatus", 1440)}
    return canonical.freshness_log(tables, events.agg(F.max(c("ts").cast("timestamp")).alias("now")))


_LOG = {"lines": ("lineitem", "l_shipdate", "''", 30), "events": ("events", "ts", "event_type", 5), "orders": ("orders", "o_orderdate", "o_orderstatus", 1440)}
LOG = "with log as (" + " union all ".join(f"select '{n}' as dataset, count(*) as rows, max({s}) filter ({m} = (select max({m}) from {t})) as source, max({m})::timestamp as fetched_at, {ttl}::bigint as ttl_minutes from {t}" for n, (t, m, s, ttl) in _LOG.items()) + ") select dataset, rows, source, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') as fetched_at, ttl_minutes, date_diff('second', fetched_at, (select max(ts)::timestamp from events)) // 60 <= ttl_minutes as cache_used from log"


def board_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog has names of brands and suppliers, some of them twice; suppliers of even numbers only."""
    brands = adapters.landed(spark, sf_dir, "part").select(F.lit("industry").alias("kind"), c("p_brand").alias("code"), F.concat(F.lit("brand "), "p_brand", F.lit(" "), "p_type").alias("name"))
    suppliers = adapters.landed(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.lit("concept").alias("kind"), c("s_suppkey").cast("string").alias("code"), c("s_name").alias("name"))
    return canonical.board_metrics(brands.unionByName(suppliers), panel.metric_panel(spark, sf_dir))


BOARDS = f"""{sql.METRICS},
catalog as (select 'industry' as kind, p_brand as code, min('brand ' || p_brand || ' ' || p_type) as name from part group by p_brand union all select 'concept', s_suppkey::varchar, s_name from supplier where s_suppkey % 2 = 0),
named as (select * from catalog join metrics using (kind, code))"""


def _growths() -> tuple[Column, Column]:
    """Revenue's and profit's growth against the year before, either missing where the landed rows make it so."""
    return c("revenue_yoy"), c("profit_yoy")


def simple_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every report's growth; codes of even numbers hold profit near revenue."""
    revenue, profit = _growths()
    cap = F.when(c("code").cast("long") % 2 == 0, 10.0)
    return adapters.performance(spark, sf_dir).withColumns({"growth": valuation.simple_growth(profit, revenue), "held_growth": valuation.simple_growth(profit, revenue, cap)})


_CLIP = "greatest(-30, least({1}, {0}))"


def _blend(profit: str) -> str:
    p, r = (f"case when {x} is not null then {_CLIP.format(x, top)} end" for x, top in ((profit, 80), ("rg", 60)))
    return f"coalesce(0.65::double * ({p}) + 0.35::double * ({r}), {p}, {r})"


GROWTH = f"""{sql.REPORTS},
yearly as (select d.*, case when e.revenue <> 0 then 100 * (d.revenue / e.revenue - 1) end as rg, case when e.net_profit > 0 then 100 * (d.net_profit / e.net_profit - 1) end as pg from dates d left join dates e on e.l_suppkey = d.l_suppkey and e.q = d.q and e.y = d.y - 1),
grown as (select y::varchar || ['0331', '0630', '0930', '1231'][q] as report_date, lpad(l_suppkey::varchar, 6, '0') as code, {_blend('pg')} as growth, {_blend('(case when l_suppkey % 2 = 0 and rg is not null and pg > rg + 10 then rg + 10 else pg end)')} as held_growth from yearly)"""

_HEAD = ["universe", "filtered", "target", "target_scored"]
_METRICS = ["ret_5d", "slope_10d", "volatility_20d"]
#: Name, plan, columns and SQL of each query.
ENTRIES = [
    ("audit_provenance", provenance, ["kind", "code", "history_source", "synthetic_constituents", "synthetic_coverage"], sql.query(PROVENANCE, "provenance", sql.listed(["synthetic_constituents", "synthetic_coverage"], ["kind", "code", "history_source"]))),
    ("audit_subsets", subsets, ["subset", "kind", "code", "name", "audit_status", "place"], sql.query(SUBSETS, "extracts", "subset, kind, code, name, audit_status, place")),
    ("report_facts", facts, ["data_cutoff", "scored", "failures", *_HEAD, "target_coverage_pct"], sql.query(FACTS, "facts", sql.listed(["target_coverage_pct"], ["data_cutoff"], ["scored", "failures", *_HEAD]))),
    ("traded_index", traded_index, ["board", "date", "ln_close", "synthetic_coverage", "constituent_count"], sql.query(_TRADED_SQL, "log_index", sql.listed(["ln_close", "synthetic_coverage"], ["board", "date::varchar as date"], ["constituent_count"]))),
    ("index_rejects", index_rejects, ["board", "mapped", "valid", "error"], sql.query(REJECTS, "refused", "board, mapped, valid, error")),
    ("quotes_canonical", quotes_canonical, ["code", "name", *_QUOTE, "quote_trade_date", "quote_source"], sql.query(QUOTES, "quotes", sql.listed(_QUOTE, ["code", "name", "'1998-12-01' as quote_trade_date", "quote_source"]))),
    ("board_codes", board_codes, ["id", "alias", "code", "name", "tier"], CODES),
    ("freshness_log", freshness_log, ["dataset", "rows", "source", "fetched_at", "ttl_minutes", "cache_used"], LOG),
    ("board_metrics", board_metrics, ["kind", "code", "name", "as_of", *_METRICS], sql.query(BOARDS, "named", sql.listed(_METRICS, ["kind", "code", "name", "as_of::varchar as as_of"]))),
    ("simple_growth", simple_growth, ["report_date", "code", "growth", "held_growth"], sql.query(GROWTH, "grown", sql.listed(["growth", "held_growth"], ["report_date", "code"]))),
]
