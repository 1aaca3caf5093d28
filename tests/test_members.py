"""Members of named boards: against brute force with names in parts, and where the rows of a name that has most of them lie."""

import random

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.expr import theme_name
from tidegauge.operators import resolution

ROWS = ("kind string, name string", "industry string, code long", "kind string, name string, code long")


@pytest.mark.parametrize("rows", [1, 3, 10_000])
def test_members_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(resolution, "ROWS", rows)
    draw = random.Random(5)
    name = lambda: draw.choice([None, "", " "]) if draw.random() < 0.1 else "".join(draw.choice("abAB _板块Ⅱ") for _ in range(draw.randrange(1, 6)))
    names, kind = [name() for _ in range(40)], lambda: draw.choice(["industry", "concept", None])
    targets = [(kind(), draw.choice(names)) for _ in range(90)]
    industries = [(draw.choice(names), draw.choice([None, *range(9)])) for _ in range(150)]
    constituents = [(kind(), draw.choice(names), draw.choice([None, *range(9)])) for _ in range(400)]
    key = {r.name: r.key for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", theme_name(F.col("name")).alias("key")).collect()}
    want = set()
    for kind, name in targets:
        w = key[name]
        met = [k for k in {key[i] for i, _ in industries} if kind == "industry" and w and k and (k == w or (len(w) >= 2 and w in k))]
        best = min(met, key=lambda k: (k != w, len(k), k)) if met else None
        want |= {(kind, name, code, "industry") for i, code in industries if met and key[i] == best}
        want |= {(kind, name, code, "constituents") for k, n, code in constituents if not met and None not in (kind, name) and (k, n) == (kind, name)}
    got = [tuple(r) for r in resolution.members(*[spark.createDataFrame(t, s) for t, s in zip((targets, industries, constituents), ROWS, strict=True)]).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {"industry", "constituents"} == {r[3] for r in got}


def test_no_task_gets_all_rows_of_a_name(spark, monkeypatch):
    """One industry and one concept have all of the rows; on eight partitions no task may give most of them, whatever the planner takes for small."""
    monkeypatch.setattr(resolution, "ROWS", 500)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 20_000
        targets = spark.createDataFrame([("industry", "ring"), ("concept", "x")], ROWS[0])
        rows = resolution.members(targets, spark.range(n).select(F.lit("red ring").alias("industry"), F.col("id").alias("code")), spark.range(n).select(F.lit("concept").alias("kind"), F.lit("x").alias("name"), F.col("id").alias("code")))
        dealt = rows.groupBy("origin", F.spark_partition_id().alias("task")).count().groupBy("origin").agg(F.sum("count").alias("rows"), F.max("count").alias("most")).collect()
        assert {r.origin: r.rows for r in dealt} == {"industry": n, "constituents": n}
        assert all(r.most <= n / 2 for r in dealt), dealt
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
