"""Sharding against the law stated plainly, over many small buckets, and its edges."""

import zlib
from collections import Counter, defaultdict

import pytest

from tidegauge.llm import sharding

SCHEMA = "doc_id long, text string, source string, stratum string, slot long, TEXT_CRC32 string"


def placed(spark, rows, shards):
    return [r.asDict() for r in sharding.interleave(spark.createDataFrame(rows, SCHEMA), shards).collect()]


@pytest.mark.parametrize("shards", [1, 7, 24])
def test_law_over_many_buckets(spark, monkeypatch, shards):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 3)
    monkeypatch.setattr(sharding, "SUMMED", 2)
    rows = [(i, f"text {i % 50}" if i % 11 else None, None if i % 13 == 0 else "abcc"[i % 4], "x", i, "y") for i in range(301)]
    found = placed(spark, rows, shards)
    of = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), s) for i, t, s, *_ in rows}
    assert {r["id"]: (r["size"], r["text_crc32"], r["stratum"]) for r in found} == of
    sizes = Counter(s for *_, s in of.values())
    ranks = defaultdict(list)
    for r in found:
        ranks[r["stratum"]].append(r["stratum_rank"])
    assert all(sorted(v) == list(range(1, sizes[s] + 1)) for s, v in ranks.items())
    order = sorted(found, key=lambda r: ((r["stratum_rank"] - 0.5) / sizes[r["stratum"]], "" if r["stratum"] is None else f"={r['stratum']}"))
    firsts = [-(-k * len(rows) // shards) for k in range(shards)]
    assert all((r["shard"], r["slot"]) == (at * shards // len(rows), at - firsts[at * shards // len(rows)]) for at, r in enumerate(order))
    for k in range(shards):
        inside = Counter(r["stratum"] for r in found if r["shard"] == k)
        assert all(abs(inside[s] - n * sum(inside.values()) / len(rows)) < 2 for s, n in sizes.items())


def test_edges(spark):
    assert placed(spark, [], 24) == []
    rows = [(None, None, None, "x", 0, "y"), (5, "a b", "s", "x", 0, "y"), (5, "a b", "s", "x", 0, "y"), (6, "", "", "x", 0, "y"), (7, "é" * 300_000, "s", "x", 0, "y")]
    found = placed(spark, rows, 3)
    assert sorted((r["id"] is None, r["id"] or 0, r["size"]) for r in found) == [(False, 5, 11), (False, 5, 11), (False, 6, 8), (False, 7, 600_008), (True, 0, 8)]
    assert sorted(Counter(r["shard"] for r in found).values()) == [1, 2, 2]
    for k in range(3):
        slots = sorted(r["slot"] for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))
