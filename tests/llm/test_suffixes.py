"""Removal of repeated byte strings against a table of all windows, and the sorts and hashes it is made of."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tidegauge.llm import queries, suffixes

DATA = "/root/testdata/sf0.001"


def plainly(texts, length=200):
    """id -> (n_bytes, n_removed, n_spans, kept), by counting every window. ``texts``: (id, bytes) rows."""
    seen = Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    out = []
    for key, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(docs, **how):
    return sorted([(r.id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in suffixes.deduplicate(docs, **how).collect()], key=repr)


def test_the_query(spark):
    texts = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted([tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in queries.op13_suffix_dedup(spark, DATA).collect()], key=repr)
    assert got == plainly(texts) and any(x[2] for x in got)


def test_edges(spark):
    passage = " ".join(f"p{i}" for i in range(90))
    texts = [(1, passage), (2, f"a {passage} b"), (3, None), (4, ""), (5, "same " * 200), (6, "x" * 300_000), (7, f"{passage} é {passage}"), (8, "y" * 199), (8, "y" * 199), (9, "z" * 200), (None, "z" * 200), (9, "z" * 200), (10, "q" * 200), (None, None), (11, "\0" * 250 + passage[:150] + "\0" * 90)]
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in texts], "doc_id long, text string, n_bytes int, bucket string")
    assert found(docs) == plainly([(k, (t or "").encode()) for k, t in texts])
    assert suffixes.deduplicate(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_small_buckets_and_chunks(spark, monkeypatch, seed):
    """Windows of 12 bytes over few letters, one passage in most documents, dealt to many chunks and buckets of a few segments."""
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3_000)
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 9_000)
    monkeypatch.setattr(suffixes, "BLOCK", [7, 64, 1000, 1 << 18][seed])
    monkeypatch.setattr(suffixes, "LEAF", 2)
    if seed % 2:
        monkeypatch.setattr(suffixes, "MAX_SPLITTERS", 6)
    random = np.random.default_rng(seed)
    letters = lambda n, k: bytes(97 + random.integers(k, size=n)).decode()
    passage = letters(40, 20)
    texts = [(i, letters(random.integers(60), 20) + (passage if i % 3 else passage[: random.integers(40)]) + letters(random.integers(60), 2 + i % 9)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = plainly([(k, t.encode()) for k, t in texts], 12)
    assert found(docs, length=12) == want and sum(x[2] for x in want) > 5_000


def test_spans(spark):
    docs = spark.createDataFrame([(1, "abcdefghijkl-----ABCDEFGHIJKLM"), (2, "abcdefghijkl+++ABCDEFGHIJKLM")], "doc_id long, text string")
    got = {r.id: ([(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffixes.deduplicate(docs, length=12).collect()}
    assert got == {1: ([(0, 12), (17, 30)], b"-----"), 2: ([(0, 12), (15, 28)], b"+++")}


def test_sorts():
    random = np.random.default_rng(5)
    for n, width, letters in ((0, 9, 3), (1, 9, 3), (900, 23, 2), (3000, 200, 2), (2000, 16, 250)):
        rows = random.integers(letters, size=(n, width)).astype(np.uint8)
        rows[n // 2 :, : width // 2] = 1
        order = suffixes.multikey_order(rows)
        sorted_ = [rows[k].tobytes() for k in order]
        assert sorted_ == sorted(r.tobytes() for r in rows) and sorted(order) == list(range(n))
        common = suffixes.common_prefixes(rows, order)
        assert all(a[:c] == b[:c] and (c == width or a[c] != b[c]) for a, b, c in zip(sorted_, sorted_[1:], common[1:].tolist(), strict=False))
    values = random.integers(100, size=500)
    assert all(suffixes.sliding_least(values, w).tolist() == [min(values[i : i + w]) for i in range(501 - w)] for w in (1, 2, 7, 64, 137))
