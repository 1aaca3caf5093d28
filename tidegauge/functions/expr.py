"""Expression helpers: missing numbers are NULL, comparisons with NULL are false, ranks are neutral at 0.5."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, Window, functions as F


def settled(x: Column | str, digits: int = 6) -> Column:
    """Rounds for output; the cut lies just off the decimal halves, so that the last bit of a sum does not decide."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10.0**digits + 0.500123) / 10.0**digits


def number(text: Column) -> Column:
    """A number from text with thousands separators or a percent sign; NULL if it is none, and never NaN."""
    value = F.regexp_replace(F.trim(text.cast("string")), "[,%]", "").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def market_date(text: Column) -> Column:
    """A date from yyyyMMdd or ISO text, with or without a trailing .0."""
    plain = F.regexp_replace(F.trim(text.cast("string")), r"\.0$", "")
    return F.when(plain.rlike(r"^\d{8}$"), F.try_to_timestamp(plain, F.lit("yyyyMMdd"))).otherwise(F.try_to_timestamp(plain)).cast("date")


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def clipped(x: Column, low: float, high: float) -> Column:
    """x within bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def ramp(x: Column) -> Column:
    return clipped(x, 0.0, 1.0)


def at_least(x: Column, low: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), x))


def percentile_rank(x: Column, *by: str | Column) -> Column:
    """Average-tie percentile rank among the values that are not NULL; 0.5 for NULL."""
    group = Window.partitionBy(*by)
    place = F.rank().over(group.orderBy(x.asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0
    return F.when(x.isNotNull(), place / F.count(x).over(group)).otherwise(0.5)


def descending_rank(x: Column, *by: str) -> Column:
    return F.when(x.isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(x.desc_nulls_last())))


def last_label(default: str, *rules: tuple[Column, str]) -> Column:
    """The label of the last rule that holds, as if each were assigned in turn."""
    out = F.lit(default)
    for condition, label in rules:
        out = F.when(holds(condition), F.lit(label)).otherwise(out)
    return out


def first_label(rules: Iterable[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for condition, label in reversed(list(rules)):
        out = F.when(holds(condition), F.lit(label)).otherwise(out)
    return out


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


# name keys ----------------------------------------------------------------------------------------------------------

_MARKS = r"[\s_()（）\-—·]"


def board_name(name: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.trim(name)), _MARKS, "")
    return F.regexp_replace(F.regexp_replace(plain, "(概念|板块)$", ""), "[ⅰⅱⅲⅳⅴ]+$", "")


def theme_name(name: Column) -> Column:
    return board_name(F.regexp_replace(F.lower(F.trim(name)), r"^[a-z]\d{2}", ""))


def compact_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), _MARKS, "")


def valuation_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[\s_()（）\-—·/]", ""), "(概念|板块|行业)$", "")


def stage_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[\s_()（）\-—·/]", ""), "概念|板块|行业", "")


def exchange_code(code: Column) -> Column:
    text = F.lower(F.trim(code))
    digits = F.right(F.regexp_replace(text, r"\D", ""), F.lit(6))
    market = F.when(digits.startswith("6"), "sh").when(digits.startswith("0") | digits.startswith("3"), "sz").when(digits.startswith("4") | digits.startswith("8") | digits.startswith("92"), "bj")
    return F.when(text.rlike(r"^(sh|sz|bj)\."), text).when(F.length(digits) == 6, F.concat(market, F.lit("."), digits))


def stock_codes(text: Column) -> Column:
    """The distinct six-digit codes in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![0-9])([0-9]{6})(?![0-9])"), F.lit(1)))
