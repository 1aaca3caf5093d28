"""Defined results of the toxicity scores at the edges: nulls, no labels, one label, repeated rows, clashing names."""

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import toxicity

SCHEMA = "doc_id long, text string, score double, predicted string, row string, ID long"
NASTY, KIND = "you are a stupid worthless idiot , you pathetic scum !", "the river runs past the mill and the old bridge ."


def table(spark, texts):
    return spark.createDataFrame([(i, t, 0.5, "x", "y", 1) for i, t in texts], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, toxic int")


def scores(docs, marks, **more):
    return toxicity.score(docs, marks, F.col("id") < 0, **more)


@pytest.mark.parametrize("marks, share", [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0), (2, 0)], 0.0), ([(None, 1), (1, None), (2, 7)], 0.0)])
def test_without_both_labels(spark, marks, share):
    found = scores(table(spark, [(1, NASTY), (2, None), (None, "")]), labels(spark, marks)).collect()
    assert sorted((r.id is None, r.id or 0, r.score, r.predicted, r.held_out) for r in found) == [(False, 1, share, int(share), False), (False, 2, share, int(share), False), (True, 0, share, int(share), False)]


def test_empty_table(spark):
    assert scores(table(spark, []), labels(spark, [(1, 1), (2, 0)])).collect() == []


def test_learned_scores_and_rows_carried(spark):
    texts = [(i, f"{NASTY if i % 2 else KIND} {i}") for i in range(120)] + [(200, None), (201, ""), (202, " \t\n"), (203, NASTY), (203, NASTY), (None, NASTY), (204, f"{KIND} " * 20_000)]
    docs, marks = table(spark, texts), labels(spark, [(i, i % 2) for i in range(120)] + [(200, 0)])
    plain = scores(docs, marks).collect()
    assert len(plain) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in plain)
    assert {r.predicted for r in plain if r.id is not None and r.id < 120 and r.id % 2} == {1} and {r.predicted for r in plain if r.id is not None and r.id < 120 and not r.id % 2} == {0}
    assert len({r.score for r in plain if r.id in (203, None)}) == 1 and len({r.score for r in plain if r.id in (200, 201, 202)}) == 1
    key = lambda r: (r.id is None, r.id or 0, r.score)
    carried = scores(docs, marks, carry=True).collect()
    assert sorted(map(key, carried)) == sorted(map(key, plain))
    assert sorted((r.row.doc_id or -1, r.row.text or "", r.row.score, r.row.row) for r in carried) == sorted((i or -1, t or "", 0.5, "y") for i, t in texts)
