"""Hierarchical multi-length packing of documents into training sequences.

Documents are tokenized and routed: every full window of the longest context is a sequence of its own, and what is left
goes to the shortest context size (tier) that holds it. Tiers are packed from the longest down: a piece opens a window of
its tier, the gap is filled with the largest pieces of shorter tiers that fit, and the last gap by cutting one piece to
measure. So windows are full, and their lengths are powers of two. What no window of its tier can be filled with waits
for later rows of the task; at its end the rest is cut by powers of two. Each tier's sequences are dealt to step groups
of equal tokens.

A task packs the rows of its own partition as they stream by: no shuffle, and memory for ``BUFFER_TOKENS``.

Defined results: a null or empty text is the end token alone; repeated rows are packed as often as they occur; an empty
table gives an empty table; a text of any length is packed whole; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tidegauge.llm import bpe

CONTEXT = 2048
TIERS = (2048, 1024, 512, 256)
#: Tokens that wait in a task before they are packed.
BUFFER_TOKENS = 2_000_000
#: Windows of the longest context in a step group, or as many tokens of shorter ones.
STEP_WINDOWS = 16


class Packer:
    """Packs pieces (key, ids of the piece, its start) of one task into full windows."""

    def __init__(self, tiers: tuple[int, ...], first: int):
        if any(t & (t - 1) for t in tiers):
            raise ValueError("context sizes must be powers of two")
        self.tiers = sorted(tiers, reverse=True)
        self.pools: dict[int, list] = {t: [] for t in self.tiers}  # each ascending by length
        self.sequence, self.out, self.first = first, [], first
        self.tokens = dict.fromkeys(self.tiers, 0)
        self.waiting = self.serial = 0

    def add(self, key: int, ids: np.ndarray) -> None:
        longest, n = self.tiers[0], len(ids)
        at = 0
        while n - at >= longest:
            self.emit(longest, [(key, ids[at : at + longest], at, n)])
            at += longest
        if at < n:
            self.wait((key, ids[at:], at, n))

    def wait(self, piece: tuple) -> None:
        tier = next(t for t in reversed(self.tiers) if len(piece[1]) <= t)
        self.serial += 1
        bisect.insort(self.pools[tier], (len(piece[1]), self.serial, piece))
        self.waiting += len(piece[1])

    def take(self, tier: int, at: int) -> tuple:
        piece = self.pools[tier].pop(at)[2]
        self.waiting -= len(piece[1])
        return piece

    def fitting(self, gap: int, below: int) -> tuple | None:
        """The largest waiting piece of at most ``gap`` tokens, of the tiers up to ``below``."""
        for tier in self.tiers:
            if tier <= below and (at := bisect.bisect_right(self.pools[tier], gap, key=lambda x: x[0])):
                return self.take(tier, at - 1)
        return None

    def cut(self, gap: int, below: int) -> tuple | None:
        """The first ``gap`` tokens of the shortest waiting piece that is longer; what is left of it waits on."""
        for tier in reversed(self.tiers):
            if tier <= below and (at := bisect.bisect_right(self.pools[tier], gap, key=lambda x: x[0])) < len(self.pools[tier]):
                key, ids, start, n = self.take(tier, at)
                self.wait((key, ids[gap:], start + gap, n))
                return key, ids[:gap], start, n
        return None

    def pack(self, final: bool) -> None:
        for tier in self.tiers:
            while self.pools[tier]:
                window, gap = [self.take(tier, len(self.pools[tier]) - 1)], tier
                gap -= len(window[0][1])
                while gap and (piece := self.fitting(gap, tier) or self.cut(gap, tier)):
                    window.append(piece)
                    gap -= len(piece[1])
                if gap:
                    for piece in window:  # nothing of this tier or below is left to fill it with
                        self.wait(piece)
                    break
                self.emit(tier, window)
        if final:
            rest = [x[2] for t in self.tiers for x in self.pools[t]]
            self.pools = {t: [] for t in self.tiers}
            self.waiting = 0
            total = sum(len(p[1]) for p in rest)
            while total:
                size = min(self.tiers[0], 1 << (total.bit_length() - 1))
                window, gap = [], size
                while gap:
                    key, ids, start, n = rest.pop()
                    window.append((key, ids[:gap], start, n))
                    if len(ids) > gap:
                        rest.append((key, ids[gap:], start + gap, n))
                    gap -= min(gap, len(ids))
                self.emit(size, window)
                total -= size

    def emit(self, size: int, window: list) -> None:
        tier = next(t for t in reversed(self.tiers) if size <= t)
        step = self.first + self.tokens[tier] // (STEP_WINDOWS * self.tiers[0])
        self.tokens[tier] += size
        offset = 0
        for key, ids, start, n in window:
            self.out.append((key, start, len(ids), ids, n, self.sequence, offset, size, tier, step))
            offset += len(ids)
        self.sequence += 1


def pack(docs: DataFrame, source: str, key: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, end: int = 1, with_ids: bool = True) -> DataFrame:
    """A row for each piece: ``key``, start, length, ids_crc32, doc_tokens, sequence_id, offset; sequence_tokens (the
    window's length, a power of two), tier and step_group (sequences of a tier and of equal tokens in all, by tier);
    with ``with_ids`` also ids array<int>.

    ``source``: a tokenizer as JSON; ``end``: the id that ends each document.
    """
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "tier", "step_group"]
    if key in [*names, "ids"]:
        raise ValueError(f"column {key} would be overwritten; rename it first")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in names], *[T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * with_ids])
    odd = bpe.odd_characters()
    shipped = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = bpe.encoder(shipped.value, bpe.GPT2_PATTERN, odd)
        last = np.array([end], "<u4").tobytes()
        packer = Packer(tiers, TaskContext.get().partitionId() << 40)
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(k, np.frombuffer(code(t.as_py() or "") + last, "<u4"))
                if packer.waiting > BUFFER_TOKENS:
                    packer.pack(final=False)
                if len(packer.out) >= 20_000:
                    yield written(packer, kind)
        code.pieces.clear()
        packer.pack(final=True)
        if packer.out:
            yield written(packer, kind)

    def written(packer: Packer, kind: pa.DataType) -> pa.RecordBatch:
        rows, packer.out = packer.out, []
        keys, start, length, ids, n, sequence, offset, size, tier, step = zip(*rows, strict=True)
        crc = [zlib.crc32(np.ascontiguousarray(x)) for x in ids]
        columns = [pa.array(keys, kind), *[pa.array(x, pa.int64()) for x in (start, length, crc, n, sequence, offset, size, tier, step)]]
        if with_ids:
            from tidegauge.llm.runtime import lists

            columns.append(lists([x.view("<i4") for x in ids], pa.int32()))
        return pa.RecordBatch.from_arrays(columns, [key, *names, *["ids"] * with_ids])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)
