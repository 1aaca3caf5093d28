"""Token alignment against both libraries on whole texts, and its sparse products against dense ones."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tidegauge.llm import alignment, bpe, queries

DATA = "/root/testdata/sf0.001"
JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def model():
    with open(MODEL, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def plainly():
    """Whole texts -> what the contract asks for, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    back = {c: b for b, c in enumerate(bpe.byte_characters())}

    def one(text):
        if not text:
            return [], [], []
        a = [(i, bytes(back[c] for c in whole.id_to_token(i))) for i in whole.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()) for i in pieces.encode(text)]
        if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
            return [], [], []
        ends = [dict(zip(np.cumsum([len(x) for _, x in t]).tolist(), range(len(t)), strict=True)) for t in (a, b)]
        return [i for i, _ in a], [i for i, _ in b], [(ends[0][e], ends[1][e]) for e in sorted(set(ends[0]) & set(ends[1]))]

    def every(texts):
        found = {k: one(t) for k, t in texts.items()}
        count = Counter((a[i], b[j]) for a, b, at in found.values() for i, j in at)
        best = Counter()
        for (_, j), n in count.items():
            best[j] = max(best[j], n)
        out = {}
        for k, (a, b, at) in found.items():
            said, i, j = [], 0, 0
            for x, y in at:
                said.append(f"{','.join(map(str, a[i : x + 1]))}|{','.join(map(str, b[j : y + 1]))}")
                i, j = x + 1, y + 1
            n = [count[a[x], b[y]] for x, y in at]
            out[k] = (len(a), len(b), len(at), len(at), sum(c == best[b[y]] for c, (_, y) in zip(n, at, strict=True)), sum(n), hashlib.sha256(";".join(said).encode()).hexdigest() if a else "")
        return out

    return every


def columns(rows):
    return {r["id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows}


ODD = {
    1: "plain words, and  two   spaces\n\n \nlines\t \ttabs ",
    2: None,
    3: "",
    4: " ",
    5: "a▁b is read otherwise",
    6: "<|endoftext|> and </s> <0x41> <unk>",
    7: "plain words, and  two   spaces\n\n \nlines\t \ttabs ",
    8: "日本語の文 \U0001f600\U0001f468‍\U0001f469 éé ﬁ\x00\x1c \x1d x\u0085 y z　",
    9: "=" * 500 + " " * 77 + "-" * 33,
    10: "it's we'll 12 345  ' s\r\n x  y ﻿",
    11: "word " * 30_000 + "x" * 20_000,
}


def test_the_query(spark, plainly):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op11_token_alignment(spark, DATA).withColumnRenamed("doc_id", "id").collect()
    assert len(got) == len(texts) and columns(got) == plainly(texts)


def test_odd_texts_and_clashing_names(spark, plainly, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_STRETCHES", 3)
    docs = spark.createDataFrame([(k, t, 5, "x") for k, t in ODD.items()], "doc_id long, text string, n_a int, a string")
    got = alignment.summary(docs, bpe.from_json(JSON), model()).collect()
    want = plainly(ODD)
    assert columns(got) == want
    assert want[5][0] == 0 and want[1] == want[7] and want[8][0] > 0
    again = docs.unionByName(docs.filter("doc_id = 1")).unionByName(docs.filter("doc_id = 1").selectExpr("cast(null as long) doc_id", "text", "n_a", "a"))
    rows = alignment.summary(again, bpe.from_json(JSON), model()).collect()
    assert len(rows) == len(ODD) + 2 and len({(r.n_a, r.n_links, r.count_sum) for r in rows if r.id in (1, 7, None)}) == 1
    assert alignment.summary(docs.limit(0), bpe.from_json(JSON), model()).count() == 0


def test_links_of_tokens(spark):
    docs = spark.createDataFrame([(k, t) for k, t in ODD.items() if k < 11], "doc_id long, text string")
    sizes = [np.array([len(x) for x in t]) for t in (bpe.token_bytes(bpe.from_json(JSON)), alignment.aligner(bpe.from_json(JSON), model(), bpe.odd_characters()).bytes_b)]
    summed = {r.id: r for r in alignment.summary(docs, bpe.from_json(JSON), model()).collect()}
    for r in alignment.align(docs, bpe.from_json(JSON), model()).collect():
        a, b = (np.repeat(np.arange(len(ids)), s[ids]) if ids else np.empty(0, int) for ids, s in zip((r.a_ids, r.b_ids), sizes, strict=True))
        assert {(x.a, x.b): x.bytes for x in r.overlaps} == Counter(zip(a.tolist(), b.tolist(), strict=True))
        assert len(r.overlaps) == summed[r.id].n_overlaps and len(r.ends) == summed[r.id].n_links
        groups = Counter(r.b_groups)
        assert sum(groups[g] for g in r.a_groups) == summed[r.id].n_shared


@pytest.mark.parametrize("entries", [1, 7, 10**6])
def test_products_equal_dense_ones(monkeypatch, entries):
    monkeypatch.setattr(alignment, "PRODUCT_ENTRIES", entries)
    random = np.random.default_rng(entries)
    for _ in range(30):
        n, m, k = random.integers(1, 9, 3)
        dense = [(random.random(s) < 0.4).astype(int) for s in ((n, m), (m, k))]
        sparse = [alignment.Rows.of(d.sum(1), np.nonzero(d)[1], d.shape[1]) for d in dense]
        row, col, value = alignment.joined_blocks(alignment.product(*sparse))
        got = np.zeros((n, k), int)
        got[row, col] = value
        assert (got == dense[0] @ dense[1]).all() and (np.diff(row * k + col) > 0).all()
        turned = sparse[0].turned()
        assert all(sorted(turned.columns[turned.starts[j] : turned.starts[j + 1]]) == np.flatnonzero(dense[0][:, j]).tolist() for j in range(m))
