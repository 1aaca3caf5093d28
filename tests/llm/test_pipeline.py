"""Every stage of the pipeline against brute force over what the stage before it kept."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from test_contracts import DATA, WORD, components, cut

import corpus_pipeline
from tidegauge.llm import queries


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents, then each stage's rows, written and read again as the pipeline does."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.toPandas())
    return out


def texts(frame):
    return {int(i): t if isinstance(t, str) else "" for i, t in zip(frame.doc_id, frame.text, strict=True)}


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "packing"]
    assert all(list(s.columns) == corpus_pipeline.COLUMNS for s in stages[:-1])


def test_toxicity_stage(spark, stages):
    scored = queries.op1_toxicity(spark, DATA).toPandas()
    assert sorted(stages[1].doc_id) == sorted(scored.doc_id[scored.predicted == 0])
    before = texts(stages[0])
    assert all(before[i] == t for i, t in texts(stages[1]).items())


def test_near_duplicate_stage(stages):
    found = components(texts(stages[1]))
    assert sorted(stages[2].doc_id) == sorted(i for i, (_, component) in found.items() if component == i)


def test_passage_stage(stages):
    want = {i: kept for i, (_, _, kept) in cut(texts(stages[2])).items()}
    got = texts(stages[3])
    assert {i: hashlib.sha256(b" ".join(WORD.findall(t.encode()))).hexdigest() for i, t in got.items()} == want
    assert all(n == len(got[i]) for i, n in zip(stages[3].doc_id, stages[3].n_chars, strict=True))


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    left = texts(stages[3])
    assert set(stages[4].doc_id) == set(left)
    for i, rows in stages[4].groupby("doc_id"):
        ids = np.array([*plain.encode(left[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, DATA).groupBy("doc_id").agg({"length": "sum"}).toPandas().set_index("doc_id").iloc[:, 0]
    want = stages[4].groupby("doc_id").length.sum()
    assert got.sort_index().tolist() == want.tolist() and isinstance(want, pd.Series)
