"""Operator 8 against plain forms: fingerprints term by term, likeness bit by bit, the search within a radius over all pairs."""

import math
import random

import pandas as pd
import pytest
import xxhash

from tidegauge.llm import fingerprints, queries

DATA = "/root/testdata/sf0.001"
MASK = 2**64 - 1


def mixed(h):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> shift)) * factor & MASK
    return h ^ (h >> 31)


def plainly(text):
    """Every term's vote on every bit, one by one; bits of a word of 64 in the order of its bytes in memory."""
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh3_64_intdigest(w) for w in words]
    terms = [(h, min(len(w), 8) / 16) for h, w in zip(hashes, words, strict=True)] + [(mixed((a * 0x9E3779B97F4A7C15 + b) & MASK), 1.0) for a, b in zip(hashes, hashes[1:], strict=False)]
    votes = [0.0] * fingerprints.BITS
    for half in range(fingerprints.BITS // 64):
        for h, weight in terms:
            spread = mixed((h + (0xC2B2AE3D27D4EB4F * (half + 1) & MASK)) & MASK)
            for byte in range(8):
                for bit in range(8):
                    votes[64 * half + 8 * byte + bit] += weight if spread >> (8 * byte + 7 - bit) & 1 else -weight
    return "".join(f"{int(''.join('1' if v > 0 else '0' for v in votes[i : i + 4]), 2):x}" for i in range(0, fingerprints.BITS, 4))


def alike(a, b):
    if a == b or "0" * 32 in (a, b):
        return float(a == b)
    return max(0.0, math.cos(math.pi * sum(x != y for x, y in zip(f"{int(a, 16):0128b}", f"{int(b, 16):0128b}", strict=True)) / 128))


@pytest.fixture(scope="module")
def found(spark):
    return queries.op8_simhash(spark, DATA).toPandas().set_index("doc_id")


def test_fingerprints_and_likeness(found):
    documents = pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")
    texts = dict(zip(documents.doc_id.tolist(), documents.text.tolist(), strict=True))
    ids = sorted(texts)
    for k, i in enumerate(ids[:60]):
        after = texts[ids[k + 1]]
        n = len(texts[i]) // 4
        changed = texts[i][: len(texts[i]) - n] + after[:n]
        assert found.fingerprint[i] == plainly(texts[i]) and found.edited_fingerprint[i] == plainly(changed)
        assert abs(found.near_edited[i] - alike(plainly(texts[i]), plainly(changed))) < 1e-12
        assert abs(found.near_next[i] - alike(plainly(texts[i]), plainly(after))) < 1e-12


def test_neighbours_of_all_documents(found):
    marks = [int(m, 16) for m in found.fingerprint]
    for own, equal, near in zip(marks, found.n_equal, found.n_near, strict=True):
        distances = [(own ^ m).bit_count() for m in marks]
        assert (equal, near) == (sum(d == 0 for d in distances) - 1, sum(0 < d <= 3 for d in distances))


def test_edges(spark):
    texts = [(1, "one"), (2, None), (3, ""), (4, " \n "), (5, "one"), (5, "two words"), (None, "null id"), (6, "x " * 200_000), (7, "One")]
    docs = spark.createDataFrame([(i, t, "f", 1.0) for i, t in texts], "doc_id long, text string, fingerprint string, near_next double")
    rows = fingerprints.fingerprints(docs).collect()
    assert sorted((r.id is None, r.id or 0, r.n_chars) for r in rows) == sorted((i is None, i or 0, len(t or "")) for i, t in texts)
    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        t, after = t or "", after or ""
        n = len(t) // 4
        want = (plainly(t) if len(t) < 1000 else None, t[: len(t) - n] + after[:n])
        assert any(r.id == i and want[0] in (None, r.fingerprint) and r.edited == want[1] for r in rows)
    assert len({r.fingerprint for r in rows if r.id in (2, 3, 4)}) == 1
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0 and fingerprints.neighbours(docs.limit(0)).count() == 0


def test_within_radius(spark):
    draw = random.Random(3)
    marks = [draw.getrandbits(fingerprints.BITS) for _ in range(40)]
    near = [m ^ sum(1 << b for b in draw.sample(range(fingerprints.BITS), draw.randrange(9))) for m in marks for _ in range(3)]
    width = fingerprints.BITS // 4
    hexed = [f"{m:0{width}x}" for m in marks + near]
    frame = spark.createDataFrame([(h,) for h in [*hexed, hexed[0], None]], "fingerprint string")
    for radius in (0, 3, 6):
        got = sorted(tuple(r) for r in fingerprints.within_radius(frame, frame, radius).collect())
        pairs = ((a, b, (int(a, 16) ^ int(b, 16)).bit_count()) for a in set(hexed) for b in set(hexed))
        assert got == sorted(p for p in pairs if p[2] <= radius)
