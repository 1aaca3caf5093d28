"""Exact top-k search by inner product with vector-approximation files.

Two files are written: the approximation file holds, in blocks of bounded size, one byte for each component, the cell of a
grid of the block; the vector file holds the exact vectors. Every block of queries scans the approximation file alone for
a lower and an upper bound of every score; a candidate that k others surely beat is out. The exact vectors of the rest are
read in the order of their bounds: first the k + 1 likeliest of each query, then those whose bound still reaches the kth
exact score, after which the result is certain.

How it scales: what meets every block of queries, which the query set states, is one byte a component; exact vectors travel
once for each (query, survivor). Each meeting works on two bounded sets. Products are a join of rows, so no group of them
is ever held; a vector that many queries read is a skewed key of that join, which adaptive execution splits. Equal vectors
are one candidate that carries its k + 1 smallest ids, so copies cost nothing and lose nothing. Vectors whose cells tell
nothing apart, as far larger ranges than the differences of scores do, survive in large numbers; they cost reads, not
results. Nothing is broadcast or collected but the number of vectors.

Defined results: vectors that are null, empty or hold null or non-finite components take no part; vectors of another
length than a query's are no candidates for it; a query has fewer rows if there are fewer candidates; ties go to the
smaller id; rows that share an id and a vector are one; components and scores beyond the range of a long stand at its
ends, and scores are exact up to there; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.runtime import Scratch, shuffle_width

#: Cells of a component's grid: each is a byte.
CELLS = 256
#: Distinct vectors in a block, blocks in a stripe, distinct queries in a block.
BLOCK, STRIPE, QUERIES = 4096, 4, 1024
#: Products below this, and their halves, are exact in doubles.
_EXACT = 2.0**50


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower edges and whole widths of each component's cells, and the cell of every component."""
    exact = vectors.astype(np.float64)
    low = exact.min(axis=0)
    width = np.maximum(np.ceil((exact.max(axis=0) - low + 1.0) / CELLS), 1.0)
    return low, width, np.clip(np.floor((exact - low) / width), 0, CELLS - 1).astype(np.uint8)


def scan(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the score of each (query, vector), from the cells alone. A cell holds its edge and the width - 1 integers above."""
    queries = queries.astype(np.float64)
    middle = low + (width - 1) / 2
    centre = (queries * width) @ cells.T.astype(np.float64) + (queries @ middle)[:, None]
    reach = np.abs(queries).max(axis=1, initial=0) * (np.abs(low) + CELLS * width).max(initial=0) * len(low)
    lost = np.where(reach >= _EXACT, reach * len(low) * 2.0**-48, 0.0)  # what doubles of that size may have lost
    half = (np.abs(queries) @ ((width - 1) / 2) + lost)[:, None]
    return np.clip(centre - half, -(2.0**63), 2.0**63), np.clip(centre + half, -(2.0**63), 2.0**63)


def unbeaten(low: np.ndarray, high: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions that k others do not surely beat, by a higher score or the same with a smaller id."""
    if len(low) <= k:
        return np.arange(len(low))
    kth = np.partition(low, len(low) - k)[len(low) - k]
    last = np.sort(ids[low == kth])[k - np.count_nonzero(low > kth) - 1]
    return np.flatnonzero((high > kth) | ((high == kth) & (ids <= last)))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner product of each row with its row; large ones by whole numbers of any size, cut to the range of a long."""
    reach = np.abs(queries.astype(np.float64)).max(axis=1, initial=0) * np.abs(vectors.astype(np.float64)).max(axis=1, initial=0) * queries.shape[1]
    out = np.einsum("ij,ij->i", queries, vectors)
    ends = np.iinfo(np.int64)
    for i in np.flatnonzero(reach >= _EXACT):
        out[i] = min(max(sum(map(int.__mul__, queries[i].tolist(), vectors[i].tolist())), ends.min), ends.max)
    return out


def _joined(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()])


def approximation_file(vectors: DataFrame) -> DataFrame:
    """Blocks (block, dim, low, width, cells, keys, ids) of about ``BLOCK`` rows of (key, dim, v, first)."""
    count = max(1, -(-vectors.count() // BLOCK))

    def pack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        low, width, cells = quantised(table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim))
        held = {"low": low, "width": width, "cells": cells, "keys": table.column("key").to_numpy(), "ids": table.column("first").to_numpy()}
        return pa.table({"block": table.column("block")[:1], "dim": table.column("dim")[:1]} | {n: pa.array([a.tobytes()], pa.binary()) for n, a in held.items()})

    placed = vectors.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(count)).cast("int"))
    return placed.groupBy("block", "dim").applyInArrow(pack, "block int, dim int, low binary, width binary, cells binary, keys binary, ids binary")


def query_blocks(queries: DataFrame) -> DataFrame:
    """Blocks (asker, dim, asks, marks) of about ``QUERIES`` rows of (mark, dim, v)."""
    count = max(1, -(-queries.count() // QUERIES))

    def pack(table: pa.Table) -> pa.Table:
        held = {"asks": table.column("v").combine_chunks().flatten().to_numpy(), "marks": table.column("mark").to_numpy()}
        return pa.table({"asker": table.column("asker")[:1], "dim": table.column("dim")[:1]} | {n: pa.array([a.astype("<i8").tobytes()], pa.binary()) for n, a in held.items()})

    placed = queries.withColumn("asker", F.pmod(F.xxhash64("mark"), F.lit(count)).cast("int"))
    return placed.groupBy("asker", "dim").applyInArrow(pack, "asker int, dim int, asks binary, marks binary")


def scanned(blocks: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """(mark, key, first, low, high): what no stripe of the approximation file can leave out, for each query."""
    stripe = (F.col("block") / STRIPE).cast("int").alias("stripe")
    askers, stripes = asking.select(F.col("asker").alias("to"), "dim").distinct(), blocks.select(stripe, "dim").distinct()
    left = blocks.join(askers, "dim").select("to", stripe, "dim", "low", "width", "cells", "keys", "ids")
    right = asking.join(stripes, "dim").select(F.col("asker").alias("to"), "stripe", "dim", "asks", "marks")

    def meet(held: pa.Table, queries: pa.Table) -> pa.Table:
        names, found = ["mark", "key", "first", "low", "high"], []
        if held.num_rows and queries.num_rows:
            dim = queries.column("dim")[0].as_py()
            asks, marks = _joined(queries.column("asks"), "<i8").reshape(-1, dim), _joined(queries.column("marks"), "<i8")
            near: list[list] = [[] for _ in marks]
            for row in held.to_pylist():
                keys, ids = np.frombuffer(row["keys"], "<i8"), np.frombuffer(row["ids"], "<i8")
                grid = np.frombuffer(row["low"]), np.frombuffer(row["width"]), np.frombuffer(row["cells"], np.uint8).reshape(-1, dim)
                for at in range(0, len(marks), 128):
                    lows, highs = scan(asks[at : at + 128], *grid)
                    for n, (low, high) in enumerate(zip(lows, highs, strict=True), at):
                        some = unbeaten(low, high, ids, k)
                        near[n].append((keys[some], ids[some], low[some], high[some]))
            for mark, parts in zip(marks, near, strict=True):
                key, first, low, high = map(np.concatenate, zip(*parts, strict=True))
                some = unbeaten(low, high, first, k)
                found.append((np.full(len(some), mark), key[some], first[some], low[some], high[some]))
        columns = map(np.concatenate, zip(*found, strict=True)) if found else [np.empty(0, np.int64)] * 3 + [np.empty(0)] * 2
        return pa.Table.from_arrays([pa.array(c) for c in columns], names)

    keys = ["to", "stripe", "dim"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "mark long, key long, first long, low double, high double")


def read_exactly(wanted: DataFrame, asked: DataFrame, vectors: DataFrame) -> DataFrame:
    """(mark, ids, score) of ``wanted`` (mark, key), from the exact vectors."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, v = batch.column("q"), batch.column("v")
            same = np.diff(q.offsets.to_numpy())
            for dim in np.unique(same):
                rows = pa.array(np.flatnonzero(same == dim))
                part = [x.take(rows).flatten().to_numpy().reshape(-1, dim) for x in (q, v)]
                yield pa.RecordBatch.from_arrays([batch.column("mark").take(rows), batch.column("ids").take(rows), pa.array(products(*part))], ["mark", "ids", "score"])

    rows = wanted.select("mark", "key").join(vectors.select("key", "v", "ids"), "key").join(asked.select("mark", F.col("v").alias("q")), "mark")
    return rows.select("mark", "ids", "q", "v").mapInArrow(score, "mark long, ids array<long>, score long")


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * component) as integers, or null where the vector takes no part."""
    sound = F.coalesce(F.size(vector) > 0, F.lit(False)) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return F.when(sound, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """For each row where ``is_query``: its k best rows but itself, as (query_id, rank, id, score), rank from 1.

    ``key`` must be an integer. Scores are inner products of floor(factor * component).
    """
    scratch = Scratch(vectors.sparkSession, "topk")
    plain = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), scaled(F.col(f"`{vector}`"), factor).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).filter("v is not null and id is not null").dropDuplicates(["id", "v"])
    # of equal vectors, the k + 1 smallest ids: each partition's first, then the first of those
    some = Window.partitionBy("v", "part").orderBy("id")
    every = Window.partitionBy("v").orderBy("id")
    firsts = plain.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(shuffle_width(vectors)))).withColumn("n", F.row_number().over(some)).filter(F.col("n") <= k + 1)
    firsts = firsts.withColumn("n", F.row_number().over(every)).filter(F.col("n") <= k + 1)
    distinct = firsts.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    # numbers given once: the tables are written before anything reads them
    file = scratch.keep(distinct.select(F.monotonically_increasing_id().alias("key"), F.size("v").alias("dim"), "v", "ids", F.col("ids")[0].alias("first")))
    asked = scratch.keep(plain.filter("asks").select("v").distinct().select(F.monotonically_increasing_id().alias("mark"), F.size("v").alias("dim"), "v"))
    blocks = scratch.keep(approximation_file(file.select("key", "dim", "v", "first")))

    # one more than k: a query's own vector may be among them
    met = scanned(blocks, query_blocks(asked), k + 1)
    mark = Window.partitionBy("mark")
    kth = F.max(F.when(F.col("n") == k + 1, F.struct("low", "first"))).over(mark)
    met = met.withColumn("n", F.row_number().over(mark.orderBy(F.col("low").desc(), "first"))).withColumn("kth", kth)
    beaten = (F.col("high") < F.col("kth.low")) | ((F.col("high") == F.col("kth.low")) & (F.col("first") > F.col("kth.first")))
    met = met.filter(F.col("kth").isNull() | ~beaten)
    left = scratch.keep(met.select("mark", "key", "high", F.row_number().over(mark.orderBy(F.col("high").desc(), "first")).alias("turn")))
    scored = scratch.keep(read_exactly(left.filter(F.col("turn") <= k + 1), asked, file))
    reached = scored.groupBy("mark").agg(F.min("score").cast("double").alias("least"))
    more = read_exactly(left.filter(F.col("turn") > k + 1).join(reached, "mark").filter("high >= least"), asked, file)

    order = [F.col("score").desc(), F.col("id")]
    rows = scored.unionByName(more).select("mark", F.explode("ids").alias("id"), "score")
    best = rows.withColumn("n", F.row_number().over(mark.orderBy(*order))).filter(F.col("n") <= k + 1)
    # k + 1 rows for each distinct query vector: enough for k once a query's own row is left out
    found = scratch.keep(best.join(asked, "mark").select("v", "id", "score"))
    scratch.drop(file, asked, blocks, left, scored)
    pairs = plain.filter("asks").select(F.col("id").alias("query_id"), "v").join(found, "v").filter("query_id <> id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
