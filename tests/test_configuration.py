"""Configuration documents: what is taken from them, and one document for each way to be wrong."""

import json

from tidegauge.operators import configuration

FINE = {"model": "growth_pe", "boards": [{"kind": "industry", "aliases": ["Chips 概念"]}], "valuation_boards": [{"kind": "concept", "aliases": ["chips板块"]}], "model_weights": {"pe": 0.7, "ps": 0.3}, "fair_pe_floor": 8, "fair_pe_cap": 35}
STOCK = {"name": "n", "sector": "s"}


def document(stocks=None, **change):
    sector = {k: v for k, v in (FINE | change).items() if v is not ...}
    return json.dumps({"sectors": {"s": sector}, "stocks": {"000001": STOCK} if stocks is None else stocks}, ensure_ascii=False)


CASES = {
    "fine": (document(), set()),
    "model": (document(model="guess", model_weights={"pe": -1}, boards=...), {("s", "unknown_model")}),
    "no model": (document(model=...), {("s", "unknown_model")}),
    "no boards": (document(boards=...), {("s", "boards_missing")}),
    "empty boards": (document(boards=[], valuation_boards=...), set()),
    "kind": (document(boards=[{"kind": "index", "aliases": ["chips"]}]), {("s", "board_kind")}),
    "unnamed": (document(boards=[{"kind": "industry", "aliases": []}], valuation_boards=...), {("s", "board_unnamed")}),
    "by code": (document(boards=[{"kind": "industry", "board_code": "B1"}], valuation_boards=[{"kind": "concept", "board_code": "B2"}]), set()),
    "apart": (document(valuation_boards=[{"kind": "concept", "aliases": ["ships"]}]), {("s", "boards_disjoint")}),
    "same code": (document(boards=[{"kind": "industry", "aliases": ["a"], "board_code": "B"}], valuation_boards=[{"kind": "concept", "aliases": ["b"], "board_code": "B"}]), set()),
    "no weights": (document(model_weights=...), set()),
    "empty weights": (document(model_weights={}), {("s", "weights_not_positive")}),
    "negative": (document(model_weights={"pe": 1.5, "pb": -0.5}), {("s", "weights_not_positive")}),
    "sum": (document(model_weights={"pe": 0.5, "pb": 0.4}), {("s", "weights_sum")}),
    "bounds": (document(fair_pe_floor=40, fair_ps_floor=2, fair_ps_cap=1), {("s", "fair_pe_bounds"), ("s", "fair_ps_bounds")}),
    "one bound": (document(fair_pb_floor=40), set()),
    "returns of a utility": (document(model="utility", required_return=0.02, terminal_growth=0.03), {("s", "return_not_above_growth")}),
    "a utility's nulls": (document(model="utility"), {("s", "return_not_above_growth")}),
    "others' returns": (document(required_return=0.02, terminal_growth=0.03), set()),
    "yield": (document(model_weights={"pe": 0.6, "ocf_yield": 0.4}), {("s", "ocf_without_target_yield")}),
    "bootstrap": (document(bootstrap_fair=12, bootstrap_asof="2024-02-30"), {("s", "bootstrap_date")}),
    "bootstrap without a day": (document(bootstrap_fair=12), {("s", "bootstrap_date")}),
    "day without a value": (document(bootstrap_asof="x"), set()),
    "stock code": (document({"12x": STOCK, "0000011": STOCK}), {("12x", "stock_code"), ("0000011", "stock_code")}),
    "stock name": (document({"000001": {"sector": "t"}, "000002": {"name": "  "}}), {("000001", "stock_name"), ("000002", "stock_name")}),
    "stock sector": (document({"000001": {"name": "n"}}), {("000001", "stock_sector"), ("000001", "unknown_sector")}),
    "another sector": (document({"000001": {"name": "n", "sector": "t"}, "000002": {"name": "n", "sector": "t", "model_override": {"model": "utility"}}}), {("000001", "unknown_sector")}),
}
USELESS = {"cut": ('{"sectors": {', "not_json"), "list": ("[]", "not_json"), "text": ("sectors", "not_json"), "null": (None, "not_json"), "empty": ("{}", "no_sectors"), "no sectors": ('{"sectors": {}, "stocks": {}}', "no_sectors"), "no stocks": (json.dumps({"sectors": {"s": FINE}}), "no_stocks"), "a number": ('{"sectors": {"s": 5}, "stocks": {}}', "not_json")}


def test_every_rule(spark):
    rows = [(k, text) for k, (text, _) in CASES.items()] + [(k, text) for k, (text, _) in USELESS.items()]
    tables = configuration.tables(spark.createDataFrame(rows, "document string, text string"))
    found = {}
    for r in configuration.violations(tables).collect():
        found.setdefault(r.document, set()).add((r.entity, r.rule))
    assert {k: found.get(k, set()) for k in CASES} == {k: want for k, (_, want) in CASES.items()}
    assert not set(found) - set(CASES)
    assert {r.document: r.reason for r in tables["malformed"].collect()} == {k: reason for k, (_, reason) in USELESS.items()}


def test_tables(spark):
    t = configuration.tables(spark.createDataFrame([("d", document())], "document string, text string"))
    assert [(r.metric, r.weight) for r in t["weights"].orderBy("metric").collect()] == [("pe", 0.7), ("ps", 0.3)]
    assert [(r.purpose, r.place, r.kind, r.board_code, r.aliases) for r in t["boards"].orderBy("purpose").collect()] == [("boards", 0, "industry", None, ["Chips 概念"]), ("valuation_boards", 0, "concept", None, ["chips板块"])]
    s = t["sectors"].first()
    assert (s.model, s.has_boards, s.weights, s.fair_pe_floor, s.fair_ps_cap) == ("growth_pe", True, 2, 8.0, None)
    assert tuple(t["stocks"].first()) == ("d", "000001", "n", "s", False, None)
    empty = configuration.tables(spark.createDataFrame([], "document string, text string"))
    assert all(df.count() == 0 for df in empty.values()) and configuration.violations(empty).count() == 0
