"""Which rows belong together: members of named boards, stages of sectors, configurations of stocks, targets of before.

Names meet on keys, so every match is an equi-join; a name inside another is found among the parts of the longer one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.expr import board_name, compact_name, holds, stage_name, theme_name, valuation_name
from tidegauge.operators import trajectory

#: A name of more member rows than this is dealt in parts of about so many.
ROWS = 10_000


def names_agree(configured: Column, quoted: Column) -> Column:
    return holds(valuation_name(configured) == valuation_name(quoted))


def _dealt(targets: DataFrame, held: DataFrame, on: list[str], counts: DataFrame) -> DataFrame:
    """``targets`` joined with the rows of ``held`` (``on``, code), each of these once. A few names may have most of the rows, so a name's
    rows are dealt by their codes in parts of some ``ROWS``, and its targets go to each of them. ``counts`` (``on``, count): rows of each name.

    Of the rows nothing is broadcast, however small they seem before they are read; of the names at most one in ``ROWS`` rows."""
    many = counts.filter(F.col("count") > ROWS).select(*on, F.ceil(F.col("count") / ROWS).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    split = lambda rows, part: rows.join(F.broadcast(many), on, "left").withColumn("_part", part).drop("_parts")
    rows = split(held, F.pmod(F.xxhash64("code"), parts)).repartition(*on, "_part").distinct()
    return split(targets, F.explode(F.sequence(F.lit(0), parts - 1))).hint("shuffle_hash").join(rows, [*on, "_part"]).drop("_part")


def members(targets: DataFrame, industries: DataFrame, constituents: DataFrame) -> DataFrame:
    """``targets`` (kind, name), ``industries`` (industry, code), ``constituents`` (kind, name, code): codes of each target.

    An industry's members come from the equal name, else from the shortest name that contains it (of two characters or
    more; ties to the first by letters); where there is none, and for concepts, from the constituents.
    """
    c, by = F.col, ["kind", "name"]
    theme = lambda name: F.coalesce(theme_name(c(name)), F.lit(""))  # noqa: E731  # never null, so no filter of nulls takes every row's name apart
    wanted = targets.select(*by).distinct().withColumn("wanted", theme("name"))
    held = industries.select(theme("industry").alias("key"), "code")
    counts = industries.groupBy("industry").count().groupBy(theme("industry").alias("key")).agg(F.sum("count").alias("count"))
    length = F.length("key")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda at: F.transform(F.sequence(at, length), lambda to: F.substring(c("key"), at, to - at + 1))))
    inside = counts.filter(length > 0).select("key", F.explode(F.array_distinct(parts)).alias("wanted"))  # none of them is empty
    named = wanted.filter(c("kind") == "industry").hint("shuffle_hash").join(inside, "wanted").filter((c("key") == c("wanted")) | (F.length("wanted") >= 2))
    chosen = named.groupBy(*by).agg(F.min_by("key", F.struct((c("key") != c("wanted")).alias("inside"), length.alias("length"), c("key").alias("k"))).alias("key"))
    found = _dealt(chosen, held, ["key"], counts).select(*by, "code", F.lit("industry").alias("origin"))
    rest = wanted.select(*by).join(chosen, by, "left_anti")
    others = constituents.select(*by, "code").dropna(subset=by)
    return found.unionByName(_dealt(rest, others, by, others.groupBy(*by).count()).withColumn("origin", F.lit("constituents")))


def fallback_index(boards: DataFrame, catalog: DataFrame) -> DataFrame:
    """``boards`` (name), ``catalog`` (index_code, index_name): the index of the same compact name, else of the same board name."""
    first = lambda key, name: catalog.groupBy(key(F.col("index_name")).alias(name)).agg(F.min("index_code").alias(f"{name}_code"))
    keyed = boards.withColumns({"compact": compact_name(F.col("name")), "board": board_name(F.col("name"))})
    out = keyed.join(first(compact_name, "compact"), "compact", "left").join(first(board_name, "board"), "board", "left")
    tier = F.when(F.col("compact_code").isNotNull(), "compact").when(F.col("board_code").isNotNull(), "normalised")
    return out.select(*boards.columns, F.coalesce("compact_code", "board_code").alias("index_code"), tier.alias("tier"))


def stages(aliases: DataFrame, scored: DataFrame, by: Sequence[str] = (), unmet: bool = False) -> DataFrame:
    """``aliases`` (sector, alias), ``scored`` (name, lifecycle, mainline_score): the stage of each sector's best board, for each value of ``by``.
    Ties go to the later name. With ``unmet``, the boards that no alias names are those of a sector NULL."""
    keyed = aliases.select("sector", stage_name(F.col("alias")).alias("key")).distinct()
    met = scored.withColumn("key", stage_name(F.col("name"))).join(keyed, "key", "left" if unmet else "inner")
    return met.groupBy("sector", *by).agg(F.max_by("lifecycle", F.struct("mainline_score", "name")).alias("stage"), F.max("mainline_score").alias("stage_score"))


def sector_universe(specs: DataFrame, constituents: DataFrame) -> DataFrame:
    """``specs`` (sector, board), ``constituents`` (board, code, name): each sector's codes, with the number of its boards that hold them."""
    met = specs.select("sector", "board").distinct().join(constituents, "board")
    return met.groupBy("sector", "code").agg(F.min_by("name", F.struct("board", "name")).alias("name"), F.count_distinct("board").alias("board_hits"))


def configured(stocks: DataFrame, quoted: DataFrame, sectors: DataFrame, overrides: DataFrame) -> DataFrame:
    """Each stock (code, sector) with its sector's model, else with its own; never with a model that nobody named."""
    own = overrides.select("code", F.col("model").alias("_own"))
    x = stocks.join(quoted.select("code").distinct().withColumn("_quoted", F.lit(True)), "code", "left").join(sectors.select("sector", "model"), "sector", "left").join(own, "code", "left")
    source = F.when(F.col("model").isNotNull(), "SECTOR").when(F.col("_own").isNotNull(), "OVERRIDE").otherwise("UNRESOLVED")
    model = F.coalesce("model", "_own")
    status = F.when(F.col("_quoted").isNull(), "DATA_UNAVAILABLE").when(model.isNull(), "MODEL_UNRESOLVED").otherwise("RESOLVED")
    return x.select("code", "sector", model.alias("model"), source.alias("model_source"), status.alias("model_status"))


def unresolved_boards(specs: DataFrame, resolved: DataFrame) -> DataFrame:
    """``specs`` (sector, kind, board, purpose), ``resolved`` (kind, board): a row for each sector and purpose with the boards
    that were not found. Valuation boards must be: if none is, the sector fails. Others are skipped and not listed."""
    c, found = F.col, resolved.select("kind", "board").distinct().withColumn("_found", F.lit(True))
    met = specs.join(found, ["kind", "board"], "left").withColumn("_lost", c("_found").isNull() & (c("purpose") == "valuation"))
    sums = met.groupBy("sector", "purpose").agg(F.count("_found").alias("found"), F.concat_ws(";", F.array_sort(F.collect_set(F.when(c("_lost"), F.concat("kind", F.lit(":"), "board"))))).alias("unresolved"))
    status = F.when((c("found") == 0) & (c("unresolved") != ""), "BOARD_RESOLUTION_FAILED").when(c("found") == 0, "EMPTY").otherwise("OK")
    return sums.withColumn("resolution", status)


def stock_upsert(stored: DataFrame, new: DataFrame, moment: str = "timestamp") -> DataFrame:
    """Stock snapshots: of new rows only those that were valued; of each date and code the last."""
    return trajectory.upserted(stored, new.filter("valuation_status = 'OK'").drop("valuation_status"), ["trade_date", "code"], moment)


def previous_targets(stored: DataFrame, version: str, config_hash: str, date: str = "trade_date") -> DataFrame:
    """The last target of each code that the same model version and configuration set. A last one without a number is none."""
    own = trajectory.of_version(stored, version, config_hash)
    return own.groupBy("code").agg(F.max_by("target", date).alias("previous_target"))
