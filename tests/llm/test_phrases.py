"""Phrase counts and scores against a plain count of all phrases."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidegauge.llm import phrases


def plainly(rows, least=10, longest=3, share=50, top=2000):
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                count[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in held.items():
            inside = [b for q, b in held.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * b >= share * a for b in inside):
                continue
            score, cut = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def found(docs, **how):
    return sorted(map(tuple, phrases.collocations(docs, **how).collect()))


def rows(seed, n=400):
    random = np.random.default_rng(seed)
    words = ["a", "B", "é", "x y", "日本", "der", "Die", "IT'S", "\x1c", "ÄÖ", "zwölf", "q"]
    odds = np.array([1 / (k + 1) for k in range(len(words))])
    text = lambda: "".join(random.choice(words, p=odds / odds.sum()) + random.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", "!"], p=[0.6, 0.1, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]) for _ in range(random.integers(30)))
    return [(["en", "de", None, "und"][random.integers(4)], text() if random.random() > 0.05 else None) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_count(spark, monkeypatch, seed):
    monkeypatch.setattr(phrases, "WORDS", [50, 700, 10**6][seed])
    monkeypatch.setattr(phrases, "PART_BYTES", [5, 40, 10**6][seed])
    monkeypatch.setattr(phrases, "SHARDS", [1, 3, 2][seed])
    monkeypatch.setattr(phrases, "MAX_CELLS", [64, 1 << 16, 1 << 16][seed])  # the first opens nearly all at once
    given = rows(seed)
    how = [{}, {"least": 4, "longest": 4, "share": 70}, {"least": 3, "top": 7}][seed]
    docs = spark.createDataFrame([(t, lang, 3, "x") for lang, t in given], "text string, lang string, n int, count string")
    want = plainly(given, **how)
    assert len(want) > 20 and found(docs, **how) == want


def test_edges(spark):
    docs = spark.createDataFrame([("same words again " * 5000 + "end", "en"), (None, "en"), ("", None), ("one", "de"), ("tie a. tie b. " * 10, "fr")], "text string, lang string")
    given = [(r.lang, r.text) for r in docs.collect()]
    assert found(docs) == plainly(given)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.filter("text is null")).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 3 * 10**12
    counted = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1)], "lang string, phrase string, length int, count long")
    words = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    (r,) = phrases.scored(counted, words).collect()
    assert (r.score, r.l, r.r) == (10**6 * (big - 1) ** 2 // (big * (big + 1)), big, big + 1)
