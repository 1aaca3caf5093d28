"""Trade bands and target positions of stocks on the landed tables, with SQL. A stock's number gives its gate, stage and past."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.functions.expr import settled
from tidegauge.operators import history, valuation
from tidegauge.plans import oracle as sql
from tidegauge.sources import adapters

#: A sector's own terms, one for all here.
MARGIN, UNCERTAINTY = 0.20, 0.12


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of a stock's closes is its center, their distances from it the residuals."""
    closes = adapters.stock_bars(spark, sf_dir).withColumnRenamed("stock_code", "code")
    last = closes.groupBy("code").agg(F.max_by("close", "date").alias("price"))
    rows = history.stats(closes, "code", "close", "date").join(last, "code")
    number, c = F.col("code").cast("long"), F.col
    rows = rows.select(
        "code", "price", c("median").alias("center"), c("confidence").alias("quality"), c("status").alias("res_status"), *[F.log(c(q) / c("median")).alias(f"res_{q}") for q in ("q10", "q25", "q50", "q75", "q90")],
        F.when(number % 2 == 1, 0.1).alias("disagreement"), F.lit(MARGIN).alias("base_margin"), F.lit(UNCERTAINTY).alias("base_uncertainty"), F.when(number % 4 == 1, 0.05).otherwise(0.0).alias("cycle_penalty"),
        F.when(number % 5 == 0, "fail").when(number % 5 == 1, "watch").otherwise("pass").alias("gate"), F.element_at(F.array(*map(F.lit, ("Decay", "Seed", "Mainline", "UNKNOWN"))), (number % 4 + 1).cast("int")).alias("stage"),
        (number % 7 != 0).alias("tradable"), F.when(number % 3 == 0, 70).otherwise(0).alias("previous_target"),
    )
    return valuation.trade_bands(valuation.interval(rows))


_COMPARED = ["price", "deep_buy_price", "buy_price", "buy_exit_price", "trim_price", "exit_price"]


def compared(rows: DataFrame) -> DataFrame:
    """A last close is often a quantile of its own history, hence a band: prices and bands are compared at six places, so that the last bit does not decide."""
    return rows.withColumns({x: settled(x) for x in _COMPARED})


_PRIOR = {"q10": "-1.2816", "q25": "-0.6745", "q35": "-0.3853", "q75": "0.6745", "q90": "1.2816"}
_Q35 = "ln(q25 / median) + 0.40::double * (ln(q50 / median) - ln(q25 / median))"


def _at(q: str) -> str:
    known = _Q35 if q == "q35" else f"ln({q} / median)"
    return f"center * exp(case when status = 'OK' then {known} else {_PRIOR[q]}::double * greatest(coalesce(sigma, 0.20), 0.08) end)"


def sql_of(stats: str) -> str:
    """``stats``: the SQL of the stocks' statistics, with ``prepared`` (code, date, close) among it."""
    return f"""{stats},
lasting as (select code, max_by(close, date) as price from prepared group by code),
posed as (select *, code::bigint as number, median as center, confidence as quality, case when code::bigint % 2 = 1 then 0.1::double end as disagreement, case when code::bigint % 4 = 1 then 0.05::double else 0 end as cycle_penalty from stats join lasting using (code)),
{steps(_OWN)}"""


_OWN = """case when number % 5 = 0 then 'fail' when number % 5 = 1 then 'watch' else 'pass' end as gate, ['Decay', 'Seed', 'Mainline', 'UNKNOWN'][number % 4 + 1] as stage, number % 7 = 0 as stopped, case when number % 3 = 0 then 70 else 0 end as previous,
          """


def steps(own: str = "") -> str:
    """From ``posed`` to the target. ``own``: columns gate, stage, stopped and previous, where ``posed`` has none."""
    return f"""doubted as (select *, greatest(0.10::double, least(0.45::double, {MARGIN}::double + 0.35::double * coalesce(disagreement, 0.12) + 0.18::double * (1 - quality) + cycle_penalty)) as margin,
            case when center > 0 then sqrt(coalesce(disagreement, {UNCERTAINTY}) ** 2 + {UNCERTAINTY}::double ** 2 + (0.25::double * (1 - quality)) ** 2) end as sigma from posed),
ranged as (select *, center * exp(-sigma) as fair_low, center * exp(sigma) as fair_high from doubted),
safe as (select *, least(fair_low, center * (1 - margin)) as safety from ranged),
first_bands as (select *, least({_at("q10")}, 0.92::double * safety) as deep, least({_at("q25")}, safety) as buy_price, greatest({_at("q75")}, 1.02::double * center) as trim, {_at("q90")} as out_, {_at("q35")} as back from safe),
next_bands as (select *, greatest(out_, 1.02::double * trim) as out_2, greatest(1.02::double * buy_price, back) as back_2, least(deep, 0.98::double * buy_price) as deep_buy_price, greatest(trim, 1.02::double * buy_price) as trim_price from first_bands),
bands as (select *, case when status = 'OK' then 'RESIDUAL_QUANTILES' else 'MODEL_PRIOR_BANDS' end as trade_band_source, least(greatest(back_2, 1.02::double * buy_price), 0.98::double * trim_price) as buy_exit_price, greatest(out_2, 1.02::double * trim_price) as exit_price from next_bands),
zoned as (select *, {own}case when price <= deep_buy_price then 'deep_value' when price <= buy_price then 'value' when price < trim_price then 'fair' when price < exit_price then 'dear' else 'extreme' end as zone from bands),
placed_bases as (select *, case zone when 'deep_value' then 100 when 'value' then 70 when 'fair' then 40 when 'dear' then 15 else 0 end as base from zoned),
gated as (select *, case when gate = 'watch' then 5 * round_even(base * 0.6::double / 5, 0) else base end as watched, gate = 'pass' and stage <> 'Decay' and status = 'OK' and previous >= 70 and price > buy_price and price <= buy_exit_price and base < previous as keeps from placed_bases),
after as (select *, case when status = 'OK' then watched else least(watched, 30) end as after, zone in ('deep_value', 'value') as cheap from gated),
decayed as (select *, least(after, case zone when 'dear' then 10 when 'extreme' then 0 else 20 end) as decayed from after),
aimed as (select *, case when stopped then 0 when keeps then previous when gate = 'fail' then least(base, 0) when stage = 'Decay' then decayed when cheap and stage = 'UNKNOWN' then least(after, 30) when zone = 'extreme' then 0 else after end as target,
          case when stopped then 'NO_TRADE' when keeps then 'HOLD_HYSTERESIS' when gate = 'fail' then 'NO_TRADE' when stage = 'Decay' then case when decayed <= 0 then 'EXIT_PRIORITY' else 'TRIM_OR_WAIT' end
          when cheap then case stage when 'Seed' then 'BUILD_POSITION' when 'Mainline' then 'ADD_OR_HOLD' else 'WAIT_MAINLINE_CONFIRMATION' end when zone = 'fair' then 'HOLD_OR_WAIT' when zone = 'dear' then 'TRIM' else 'AVOID_OR_EXIT' end as action from decayed),
policy as (select *, case when target > 0 and action <> 'HOLD_HYSTERESIS' then 5 * round_even(target * case when sigma > 0 then greatest(0.5::double, least(1.0::double, 0.22::double / sigma)) else 0.5 end / 5, 0) else target end as target_position from aimed)"""


def _compared_sql(text: str) -> str:
    """``text`` with each comparison of the price with a band as in ``compared``."""
    return re.sub(r"\bprice (<=|<|>) (\w+)", lambda m: f"{sql.settled('price')} {m[1]} {sql.settled(m[2])}", text)


_BANDS = ["margin", "sigma", "fair_low", "fair_high", "deep_buy_price", "buy_price", "buy_exit_price", "trim_price", "exit_price"]


def entries(stats: str) -> list:
    """Name, plan, columns and SQL of each query."""
    text = sql_of(stats)
    return [
        ("trade_bands", bands, ["code", "trade_band_source", *_BANDS], sql.query(text, "bands", sql.listed(_BANDS, ["code", "trade_band_source"]))),
        ("position_policy", lambda s, d: valuation.position(compared(bands(s, d))), ["code", "gate", "stage", "zone", "action", "target_position"], sql.query(_compared_sql(text), "policy", sql.listed((), ["code", "gate", "stage", "zone", "action"], ["target_position"]))),
    ]
