"""The report period that the coverage selects, an explicit one, and none."""

import pytest

from tidegauge.operators import fundamentals


def tables(spark, reports, codes=("a", "b", "c", "d", "e"), day="2020-05-02"):
    performance = spark.createDataFrame(reports, "report_date string, code string")
    return performance, spark.createDataFrame([(c, day) for c in codes], "code string, day string").selectExpr("code", "to_date(day) as quote_trade_date")


def filed(periods, codes):
    return [(p, c) for p in periods for c in codes]


def test_latest_covered_period_is_selected(spark):
    full = filed(("20190331", "20181231", "20180331", "20190930", "20180930", "20171231"), "abcde")
    assert fundamentals.selected_period(*tables(spark, full)) == "20190930"
    assert fundamentals.selected_period(*tables(spark, full + filed(("20200331", "20191231"), "abcd"))) == "20200331"  # four of five are enough
    assert fundamentals.selected_period(*tables(spark, full + filed(("20200331", "20191231"), "abc"))) == "20190930"
    assert fundamentals.selected_period(*tables(spark, full + filed(("20200331",), "abcde"))) == "20190930"  # the year's end is missing


def test_explicit_period_and_none(spark):
    assert fundamentals.selected_period(*tables(spark, []), explicit="20190630") == "20190630"
    with pytest.raises(ValueError, match="no report period"):
        fundamentals.selected_period(*tables(spark, []), explicit="20190531")
    with pytest.raises(ValueError, match="covers 80%"):
        fundamentals.selected_period(*tables(spark, filed(("20200331",), "abcde")))
