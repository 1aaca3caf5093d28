"""The registered queries of the training-data operators against plain brute force over whole small tables."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from tidegauge.llm import neardup, queries, substring

DATA = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents():
    frame = pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")
    return dict(zip(frame.doc_id.tolist(), [t if isinstance(t, str) else "" for t in frame.text], strict=True))


def run(spark, name):
    return queries.queries()[name](spark, DATA).toPandas()


def shingles(text, n=5):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def components(texts):
    """Smallest id reachable by links of 100 * intersection >= 75 * union, over all pairs."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def cut(texts, window=13):
    first, words = {}, {i: WORD.findall(t.encode()) for i, t in texts.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    with duckdb.connect() as con:
        for table in ("documents", "embeddings", "conversations"):
            con.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
        want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = run(spark, name)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(tuple, got[order].astype(str).values)) == sorted(map(tuple, want[order].astype(str).values))


def test_toxicity_on_held_out_rows(spark):
    found = run(spark, "op1_toxicity")
    assert found.doc_id.is_unique and found.score.between(0, 1).all()
    assert ((found.score >= 0.5).astype(int) == found.predicted).all()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()


def test_near_duplicates(spark, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op3_near_duplicates").itertuples()}
    assert got == components(documents)


def test_near_duplicates_edges(spark):
    long = " ".join(f"w{i}" for i in range(200))
    texts = {1: long, 2: long + " more", 3: None, 4: "", 5: "one two", 6: "ONE  two", 7: long.upper(), 8: "   "}
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, kept string")
    got = {r.id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == components({k: t or "" for k, t in texts.items()})
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_substring_dedup(spark, documents):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op7_substring_dedup").itertuples()}
    assert got == cut(documents)


def test_substring_edges(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    texts = {1: passage, 2: f"a {passage} b", 3: None, 4: "", 5: "same " * 40, 6: "same " * 40, 7: f"{passage} {passage}"}
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "doc_id long, text string, n_words int")
    got = {r.id: (r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in substring.deduplicate(docs).collect()}
    assert got == cut({k: t or "" for k, t in texts.items()})
    assert substring.deduplicate(docs.limit(0)).count() == 0


def test_sharding(spark, documents):
    found = run(spark, "op6_sharding")
    assert set(found.doc_id) == set(documents) and len(found) == len(documents)
    assert {r.doc_id: (r.size, r.text_crc32) for r in found.itertuples()} == {i: (len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in documents.items()}
    counts = found.groupby("shard").slot.agg(["count", "min", "max"])
    assert set(found.law) == {"rows"} and len(counts) == 24 and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all()


def test_simhash(spark, documents):
    found = run(spark, "op8_simhash").set_index("doc_id")
    ids = sorted(documents)
    for k, i in enumerate(ids):
        text, after = documents[i], documents[ids[(k + 1) % len(ids)]]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert found.edited_sha256[i] == hashlib.sha256(edited.encode()).hexdigest() and found.n_chars[i] == len(text)
    prints = defaultdict(set)
    for i in ids:
        prints[documents[i]].add(found.fingerprint[i])
    assert all(len(p) == 1 for p in prints.values())
    assert found.near_edited.mean() > found.near_next.mean() + 0.3


def test_byte_bpe(spark, documents):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {i: (len(x), sha(" ".join(map(str, x)).encode()), sha(t.encode())) for i, t in documents.items() for x in [own.encode_ordinary(t)]}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op9_byte_bpe").itertuples()} == want


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    found = run(spark, "op10_packing")
    for i, rows in found.groupby("doc_id"):
        ids = [*plain.encode(documents[i], add_special_tokens=False).ids, 1]
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert set(found.doc_id) == set(documents)
    for _, rows in found.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 2048


def test_toxicity_accuracy_on_held_out_rows(spark):
    """Labels that were not learned from, on the table with enough of them."""
    data = "/root/testdata/sf0.1"
    found = queries.op1_toxicity(spark, data).filter("held_out").toPandas().merge(pd.read_parquet(f"{data}/labels.parquet"), on="doc_id")
    ones, zeros = (found.score[found.toxic == k].to_numpy() for k in (1, 0))
    area = (ones[:, None] > zeros).mean() + (ones[:, None] == zeros).mean() / 2
    assert area > 0.95 and (ones >= 0.5).mean() > 0.8 and (zeros >= 0.5).mean() < 0.03
