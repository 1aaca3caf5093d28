"""Whole sources chosen behind a gate, names that hold each other, snapshots and their folders, prices that no member has."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidegauge.functions.expr import board_name
from tidegauge.operators import audit, canonical, synthetic
from tidegauge.sources import snapshots


def test_first_source_behind_the_gate(spark):
    table = lambda *codes: spark.createDataFrame([(c, 1.0) for c in codes], "code string, cap double")
    gate = F.col("rows") >= 2

    def choose(*sources):
        rows, trail = canonical.first_passing([(n, table(*t)) for n, t in sources], {"caps": F.count("cap")}, gate, {"b": "themes"})
        return {(r.code, r.data_source, r.namespace) for r in rows.collect()}, [(r.source, r.rows, r.passed, r.chosen, r.reason) for r in trail.orderBy("priority").collect()]

    rows, trail = choose(("a", ["1"]), ("b", ["1", "2"]), ("c", ["1", "2", "3"]))
    assert rows == {("1", "b", "themes"), ("2", "b", "themes")}  # as a whole: nothing of the others
    assert trail == [("a", 1, False, False, "gate"), ("b", 2, True, True, ""), ("c", 3, True, False, "")]
    rows, trail = choose(("a", []), ("b", ["1"]))
    assert rows == set() and trail == [("a", 0, False, False, "empty"), ("b", 1, False, False, "gate")]
    left = spark.createDataFrame([("1", "own"), ("2", "themes")], "code string, namespace string")
    assert canonical.same_namespace(left, left.withColumn("namespace", F.lit("own")), ["code"]).count() == 1


def test_the_trail_of_a_waterfall(spark):
    table = lambda *codes: spark.createDataFrame([("k", c, 1) for c in codes], "kind string, code string, n int")
    trail = canonical.source_trail([("a", table("1", "1", "2")), ("b", table("2", "3")), ("c", table()), ("d", table("1"))])
    assert [(r.source, r.offered, r.taken) for r in trail.orderBy("priority").collect()] == [("a", 2, 2), ("b", 2, 1), ("c", 0, 0), ("d", 1, 0)]


def test_names_that_hold_each_other(spark):
    draw = random.Random(4)
    name = lambda: "".join(draw.choice("abc 概念()") for _ in range(draw.randrange(7)))
    wanted = spark.createDataFrame([(i, p, name()) for i in range(60) for p in range(2)], "id int, alias_pos int, alias string")
    catalog = spark.createDataFrame([(f"{i:03d}", name()) for i in range(80)], "code string, name string")
    a, b = (t.withColumn("key", board_name(F.col(c))).collect() for t, c in ((wanted, "alias"), (catalog, "name")))
    for exact in (False, True):
        want = {}
        for x in a:
            for y in b:
                if x.key and y.key and (x.key == y.key or (not exact and (x.key in y.key or y.key in x.key))):
                    rank = (x.key != y.key, x.alias_pos, abs(len(x.key) - len(y.key)), y.code)
                    want[x.id] = min(want.get(x.id, (rank, y.code)), (rank, y.code))
        got = {r.id: (r.code, r.tier) for r in canonical.resolve_boards(wanted, catalog, exact).collect()}
        assert got == {i: (code, int(rank[0])) for i, (rank, code) in want.items()}


def test_snapshots_in_folders(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 2, h, m, 5)
    rows = spark.createDataFrame([("a", at(1), 1.0), ("b", at(1), 2.0), ("a", at(2), 3.0)], "code string, captured_at timestamp, score double")
    folder = str(tmp_path / "s")
    snapshots.write(rows, folder)
    snapshots.write(spark.createDataFrame([("c", at(2), 9.0)], rows.schema), folder)  # replaces its moment, leaves the other
    for odd in ("now", "2024-02-30_000000", "2024-01-02_0100"):
        rows.limit(1).write.parquet(f"{folder}/capture={odd}")
    got = {(r.code, r.captured_at, r.score) for r in snapshots.read(spark, folder, rows.schema).collect()}
    assert got == {("a", at(1), 1.0), ("b", at(1), 2.0), ("c", at(2), 9.0)}
    listed = {r.name: (r.captured_at, r.rows) for r in snapshots.listed(spark, folder, rows.schema).collect()}
    assert listed == {"2024-01-02_010005": (at(1), 2), "2024-01-02_020005": (at(2), 1), "now": (None, 1), "2024-02-30_000000": (None, 1), "2024-01-02_0100": (None, 1)}


def test_a_price_that_no_member_has_moves_as_the_closes_do(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(13)]
    bars = [(s, d, None if k == 12 else 10.0 + k, None if k == 12 else 11.0 + k, 9.0 + k, 10.0 + k, 1.0, 1.0, 1.0) for s in "abc" for k, d in enumerate(days)]
    stock_bars = spark.createDataFrame(bars, "stock_code string, date date, open double, high double, low double, close double, amount double, volume double, turn double")
    members = spark.createDataFrame([("x", s, s) for s in "abc"], "board string, stock_code string, name string")
    last = synthetic.index(members, stock_bars).orderBy(F.desc("date")).first()
    assert abs(last.close / last.open - 1) < 1e-12 and last.high == max(last.open, last.close) and last.low < last.close


def test_report_rows(spark):
    rows = spark.createDataFrame([("gap", "k", "x"), ("gap", "k", None), ("ok", "k", "x"), ("ok", "j", "x")], "audit_status string, kind string, history_source string")
    got = {(r.by, r["value"], r.history_source, r.boards) for r in audit.distributions(rows).collect()}
    assert got == {("status", "gap", "x", 1), ("status", "gap", None, 1), ("status", "ok", "x", 2), ("kind", "k", "x", 2), ("kind", "k", None, 1), ("kind", "j", "x", 1)}
    summary = spark.createDataFrame([("all", 5, 0, 3, 79.9, None), ("k", 1, 1, 1, 100.0, 1.0)], "kind string, universe long, omitted long, warnings long, target_coverage_pct double, flow_1d_match_pct double")
    got = {r["item"]: (r["value"], r.status) for r in audit.run_status(summary).collect()}
    assert got == {"universe": (5.0, ""), "omitted": (0.0, "PASS"), "warnings": (3.0, "WARN"), "target_coverage_pct": (79.9, "WARN"), "flow_1d_match_pct": (None, "WARN")}


def test_half_cents_do_not_hang_on_the_last_bit(spark):
    from tidegauge.plans import choice

    rows = spark.createDataFrame([(x,) for x in (10.125, 10.125 - 2e-13, 10.125 + 2e-13)], "x double").select(choice._cents(F.col("x")).alias("y"))
    assert {r.y for r in rows.collect()} == {10.13}
