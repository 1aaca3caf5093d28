"""Configurations: JSON documents taken apart into dimension tables, and every rule that they break."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.expr import holds, valuation_name
from tidegauge.operators.valuation import DEFAULT_WEIGHTS

#: A sector's numbers.
NUMBERS = ("fair_pe_floor", "fair_pe_cap", "fair_ps_floor", "fair_ps_cap", "fair_pb_floor", "fair_pb_cap", "required_return", "terminal_growth", "target_ocf_yield", "target_peg", "bootstrap_fair")
_BOARDS = "array<struct<kind:string,board_code:string,aliases:array<string>>>"
_SECTOR = f"struct<model:string,boards:{_BOARDS},valuation_boards:{_BOARDS},model_weights:map<string,double>,{','.join(f'{n}:double' for n in NUMBERS)},bootstrap_metric:string,bootstrap_asof:string>"
SCHEMA = f"sectors map<string,{_SECTOR}>, stocks map<string,struct<name:string,sector:string,model_override:struct<model:string>>>, _unread string"
_KEY = ["document", "sector"]


def parsed(documents: DataFrame) -> DataFrame:
    """``documents`` (document, text) with ``read``, null where the text is no such JSON object, and why it can't be used (reason)."""
    x = documents.withColumn("read", F.from_json("text", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"}))
    bad = F.col("read").isNull() | F.col("read._unread").isNotNull() | ~F.ltrim("text").startswith("{")
    empty = F.coalesce(F.size("read.sectors") <= 0, F.lit(True))
    return x.withColumn("reason", F.when(bad, "not_json").when(empty, "no_sectors").when(F.col("read.stocks").isNull(), "no_stocks"))


def tables(documents: DataFrame) -> dict[str, DataFrame]:
    """``documents`` (document, text) -> sectors, boards, weights, stocks: the rows of all that can be used; malformed: the others.

    boards has a row for each board of a sector and purpose (boards, valuation_boards), its aliases as an array; a sector whose
    document doesn't name boards at all has ``has_boards`` false, empty weights ``weights`` 0 where it names none."""
    x = parsed(documents)
    good = x.filter("reason is null")
    own = good.select("document", F.explode("read.sectors").alias("sector", "s"))
    sectors = own.select(*_KEY, "s.model", F.col("s.boards").isNotNull().alias("has_boards"), F.size("s.model_weights").alias("weights"), *[f"s.{n}" for n in NUMBERS], "s.bootstrap_metric", "s.bootstrap_asof")
    each = own.select(*_KEY, F.explode(F.array(*[F.struct(F.lit(p).alias("purpose"), F.col(f"s.{p}").alias("b")) for p in ("boards", "valuation_boards")])).alias("p"))
    boards = each.select(*_KEY, "p.purpose", F.posexplode("p.b").alias("place", "board")).select(*_KEY, "purpose", "place", "board.*")
    return {
        "sectors": sectors,
        "boards": boards,
        "weights": own.select(*_KEY, F.explode("s.model_weights").alias("metric", "weight")),
        "stocks": good.select("document", F.explode("read.stocks").alias("code", "s")).select("document", "code", F.col("s.name").alias("name"), F.col("s.sector").alias("sector"), F.col("s.model_override").isNotNull().alias("has_override"), F.col("s.model_override.model").alias("override_model")),
        "malformed": x.filter("reason is not null").select("document", "reason"),
    }


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """(document, entity, rule, detail): a row for each rule of ``tables`` that is broken. A sector of an unknown model, and a
    stock without a name, are asked nothing else."""
    c, text = F.col, lambda *parts: F.concat_ws(" ", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])

    def broken(rows: DataFrame, entity: str, checks: list[tuple[str, Column, Column]]) -> DataFrame:
        """One pass for all checks of a table: those that hold, exploded."""
        found = F.array_compact(F.array(*[F.when(holds(rule), F.struct(F.lit(name).alias("rule"), F.coalesce(detail, F.lit("")).alias("detail"))) for name, rule, detail in checks]))
        return rows.withColumn("_broken", F.explode(found)).select("document", c(entity).alias("entity"), "_broken.*")

    known = holds(c("model").isin(*DEFAULT_WEIGHTS))
    sectors = t["sectors"]
    asked = sectors.filter(known)
    of_asked = lambda rows: rows.join(asked.select(*_KEY), _KEY, "left_semi")
    weights = t["weights"].groupBy(*_KEY).agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.max(F.when(c("metric") == "ocf_yield", c("weight"))).alias("ocf"))
    x = asked.join(weights, _KEY, "left")
    positive = (c("weights") == 0) | (c("least") <= 0)
    zero = lambda n: F.coalesce(c(n), F.lit(0.0))
    simple = broken(x, "sector", [
        ("boards_missing", ~c("has_boards"), F.lit("")),
        ("weights_not_positive", positive, text(c("least"))),
        ("weights_sum", ~holds(positive) & (F.abs(c("total") - 1) > 1e-6), text(F.round("total", 6))),
        *[(f"fair_{m}_bounds", c(f"fair_{m}_floor") > c(f"fair_{m}_cap"), text(c(f"fair_{m}_floor"), ">", c(f"fair_{m}_cap"))) for m in ("pe", "pb", "ps")],
        ("return_not_above_growth", (c("model") == "utility") & (zero("required_return") <= zero("terminal_growth")), text(zero("required_return"), "<=", zero("terminal_growth"))),
        ("ocf_without_target_yield", (c("ocf") > 0) & (zero("target_ocf_yield") <= 0), F.lit("")),
        ("bootstrap_date", c("bootstrap_fair").isNotNull() & F.expr("try_cast(bootstrap_asof as date)").isNull(), c("bootstrap_asof")),
    ])
    boards = of_asked(t["boards"])
    nameless = (F.coalesce(c("board_code"), F.lit("")) == "") & (F.coalesce(F.size("aliases"), F.lit(0)) <= 0)
    per_board = broken(boards.withColumn("_kind", F.concat(c("purpose"), F.lit("_kind"))), "sector", [("board_kind", ~holds(c("kind").isin("industry", "concept")), text(c("purpose"), F.coalesce("kind", F.lit("null")))), ("board_unnamed", nameless, text(c("purpose"), c("place")))])
    sets = boards.groupBy(*_KEY).agg(*[
        F.flatten(F.collect_list(F.when(c("purpose") == p, values))).alias(f"{p}_{what}")
        for p in ("boards", "valuation_boards") for what, values in (("names", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), valuation_name)), ("codes", F.filter(F.array("board_code"), lambda v: v.isNotNull() & (v != ""))))
    ])
    apart = (F.size("boards_names") > 0) & (F.size("valuation_boards_names") > 0) & ~F.arrays_overlap("boards_names", "valuation_boards_names") & ~F.arrays_overlap("boards_codes", "valuation_boards_codes")
    disjoint = broken(sets, "sector", [("boards_disjoint", apart, F.array_join(F.array_sort(F.array_distinct("valuation_boards_names")), ","))])
    unknown = broken(sectors, "sector", [("unknown_model", ~known, F.coalesce("model", F.lit("null")))])
    stocks = t["stocks"].join(sectors.select("document", "sector", F.lit(True).alias("_there")), ["document", "sector"], "left")
    blank = lambda n: F.coalesce(F.trim(c(n)), F.lit("")) == ""
    named = ~blank("name")
    of_stocks = broken(stocks, "code", [
        ("stock_code", ~c("code").rlike(r"^\d{6}$"), F.lit("")),
        ("stock_name", ~named, F.lit("")),
        ("stock_sector", named & blank("sector"), F.lit("")),
        ("unknown_sector", named & c("_there").isNull() & ~c("has_override"), F.coalesce("sector", F.lit("null"))),
    ])
    return functools.reduce(DataFrame.unionByName, [simple, per_board, disjoint, unknown, of_stocks])
