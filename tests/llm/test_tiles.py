"""Near-duplicates in one large family of texts around the threshold, against all pairs; small tiles give the same."""

import random

import pytest
from test_contracts import components

from tidegauge.llm import neardup


@pytest.mark.parametrize("tile", [8, 1024])
def test_family_around_the_threshold(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    draw = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = {}
    for i in range(120):  # each changes some words of the same text, in one place or in several
        words = list(base)
        for at in draw.sample(range(150), draw.choice([1, 2, 3, 5, 8])):
            words[at] = f"x{i}y{at}"
        start, n = draw.randrange(100), draw.choice([0, 0, 10, 30])
        words[start : start + n] = [f"z{i}y{k}" for k in range(n)]
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == components(texts)


def test_linked_joins_each_component_once():
    import numpy as np

    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 10, 200, 205, 400)]
    i, j = np.array([0, 0, 0, 0, 1, 3, 3]), np.array([1, 2, 3, 5, 2, 4, 5])
    assert neardup.linked(sets, np.arange(6), i, j, 75) == [(0, 1), (0, 2), (3, 4)]
