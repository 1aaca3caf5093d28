"""Byte-level BPE: offsets of tokens that split characters, decoding, and edge cases."""

import base64

import public_tokenizers
import pytest
import tiktoken

from tidegauge.llm import bpe

TEXTS = [None, "", "plain words, and more", "\U0001f9ff\U0001f9ff é中文 க்", " \t\n  x", "<|endoftext|> is text", "a" * 50_000, "word " * 20_000, "plain words, and more"]


@pytest.fixture(scope="module")
def known():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return own, bpe.from_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_offsets_and_bytes(spark, known):
    own, source = known
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, tokens string")
    encoded = bpe.encode(docs, source, decoded=True)
    apart = {r.doc_id: bytes(r.decoded) for r in bpe.decode(encoded, source).collect()}
    rows = {r.doc_id: r for r in encoded.collect()}
    for i, text in enumerate(TEXTS):
        ids = own.encode_ordinary(text or "")
        assert rows[i].ids == ids and bytes(rows[i].decoded) == apart[i] == (text or "").encode()
        starts, at = [], 0
        for token in ids:  # the character that holds the token's first byte
            head = (text or "").encode()[: at + 1]
            starts.append(len(head.decode(errors="ignore")) - (len(head.decode(errors="ignore").encode()) == len(head)))
            at += len(own.decode_single_token_bytes(token))
        assert rows[i].char_starts == starts
    assert bpe.encode(docs.limit(0), source).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("tokens", "ids"), source, keep=("doc_id", "ids"))


def test_unknown_and_null_ids(spark, known):
    frame = spark.createDataFrame([(1, [31373, -1, 10**9]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in bpe.decode(frame, known[1]).collect()}
    assert got == {1: b"hello", 2: b"", 3: b""}


def test_slices_hold_every_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "SLICE_BYTES", 10)
    batch = pa.record_batch({"text": ["abc", None, "x" * 40, "", "abcdef", "abcdef"]})
    parts = list(bpe.slices(batch, 0))
    assert pa.Table.from_batches(parts).column("text").to_pylist() == batch.column("text").to_pylist() and len(parts) > 2
