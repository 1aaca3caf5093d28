"""The pipeline's dedup stages on rows without an id and rows that share one."""

import random

from pyspark.sql import functions as F

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_null_and_repeated_ids(spark):
    draw = random.Random(5)
    a, b, c, d, e = (" ".join(f"w{draw.randrange(10**6)}" for _ in range(200)) for _ in range(5))
    rows = [(1, a, "en", "x"), (1, a, "en", "x"), (1, b, "fr", "y"), (None, c, "de", "p"), (None, c, "de", "p"), (None, c, "es", "q"), (None, d, "en", "q"), (2, a, "en", "z"), (3, e, "en", "z"), (None, e, "en", "z"), (None, None, "en", "z"), (None, None, "en", "z")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    got = [(r.doc_id, r.text, r.lang) for r in kept.collect()]
    of_c = [g for g in got if g[1] == c]
    assert len(of_c) == 1 and of_c[0][2] in ("de", "es")
    rest = sorted((str(g) for g in got if g[1] != c))
    assert rest == sorted(map(str, [(1, a, "en"), (1, b, "fr"), (None, d, "en"), (3, e, "en"), (None, None, "en"), (None, None, "en")]))


def test_passages_of_null_and_repeated_ids(spark):
    draw = random.Random(6)
    passage, *own = (" ".join(f"w{draw.randrange(10**6)}" for _ in range(150)) for _ in range(5))
    rows = [(1, f"{own[0]} {passage}", "en", "x"), (1, f"{own[1]} {passage}", "fr", "y"), (None, f"{own[2]} {passage}", "de", "p"), (None, own[3], "es", "q")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], SCHEMA)
    got = {r.text.split()[0] if r.text else "": r for r in corpus_pipeline.cut_repeated_passages(spark, docs, "").collect()}
    assert len(got) == 4 and sum(passage in " ".join(r.text.split()) for r in got.values()) == 1
    assert {w.split()[0]: (i, lang, source) for i, w, lang, source in rows} == {k: (r.doc_id, r.lang, r.source) for k, r in got.items()}


def test_rows_whose_first_hash_is_one(spark, monkeypatch):
    """Where every first hash meets, no row and no word is lost."""
    real = corpus_pipeline._print
    monkeypatch.setattr(corpus_pipeline, "_print", lambda seed: real(seed) if seed else F.lit(1 << 62))
    test_null_and_repeated_ids(spark)
    test_passages_of_null_and_repeated_ids(spark)


def test_numbers(spark):
    """One row of each id has it as its number; the others, and those without one, have numbers above all ids; equal rows share theirs."""
    rows = [(1, "a", "en", "x"), (1, "b", "en", "x"), (2, "c", "en", "x"), (None, "d", "en", "x"), (None, "e", "en", "x"), (None, "e", "en", "x"), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    got = corpus_pipeline.numbered(docs).collect()
    assert len(got) == len(rows) and {r.number for r in got if r.number < 1 << 62} == {1, 2}
    assert len({r.number for r in got}) == 6 and len({r.number for r in got if r.text == "e"}) == 1
    assert corpus_pipeline.numbered(docs.filter("doc_id = 2")).columns == [*docs.columns, "number"]
    assert corpus_pipeline.numbered(docs.limit(0)).count() == 0
