"""Alignment of the tokens of two tokenizers by the bytes they stand for.

A is a byte-level BPE of the tokenizers library, given a space and the text; B is a sentencepiece model, which puts that
space before the text itself. A token is a row of a sparse matrix whose columns are the bytes of the text.

Method: token-byte incidence matrices in compressed rows, multiplied row by row after Gustavson. A·Bᵀ has an entry for each
pair of tokens that share bytes, its value how many: the overlap links. Where both tokens of an overlap link end at the same
byte, a group of tokens ends; the products of the token-group incidences are the shared-group links, their last ones the
links that end together.

Both tokenizers cut before every space that follows a character which is no white space: no pattern match of A and no
piece of B goes across. A text is therefore a row of such stretches, the products are block diagonal, and equal blocks are
worked out once for each task (``MEMO_STRETCHES``).

How it scales: texts are encoded where they are read, no text is shuffled. A slice of texts becomes one row: its documents as
rows of stretches, its stretches as rows of id pairs, its distinct pairs. Counts of pairs are summed over slices, then
each slice gets the counts of its own pairs back and multiplies them through. What is shuffled are the distinct pairs of each slice and
its narrow rows. Nothing is broadcast but the two vocabularies.

Defined results: a text that is null, empty, or that a tokenizer does not give back byte for byte (B reads U+2581 as a space) has no
tokens: zeros, and '' for its groups. Special tokens' strings in a text are plain text. Rows that share an id or a text are aligned each;
all their links count. An empty table gives an empty table. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm import bpe
from tidegauge.llm.runtime import Scratch

#: Stretches a task remembers before it starts anew, and those it works out together: at most so many bytes but for a longer one alone.
MEMO_STRETCHES, BLOCK_BYTES = 250_000, 1_000_000
#: Stretches looked up together.
LOOKED_UP = 50_000
#: Entries that a product holds before it adds them up.
PRODUCT_ENTRIES = 4_000_000
#: Rows of a slice.
SLICE_ROWS = 5_000
#: From a space to the next space that follows a character other than white space.
_STRETCH = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
_SPACE = "▁"
FIGURES, LEVELS = ["n_a", "n_b", "n_links", "n_overlaps", "n_shared"], ["documents", "stretches", "per_stretch", "links"]


class Rows(NamedTuple):
    """A sparse matrix of ones in compressed rows: row i has the columns ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    @classmethod
    def of(cls, sizes: np.ndarray, columns: np.ndarray, width: int) -> Rows:
        return cls(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), columns, width)

    def turned(self) -> Rows:
        """The transpose."""
        row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        return Rows.of(np.bincount(self.columns, minlength=self.width), row[order], len(self.starts) - 1)


def product(left: Rows, right: Rows) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of rows of ``left`` · ``right``: row, column and value of each entry, in order.

    After Gustavson: row i is the sum of the rows of ``right`` that row i of ``left`` names.
    """
    sizes = np.diff(right.starts)[left.columns]
    before = np.concatenate([[0], np.cumsum(sizes)])
    at, rows = 0, len(left.starts) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(before[left.starts], before[left.starts[at]] + PRODUCT_ENTRIES, "right")) - 1)
        part = slice(left.starts[at], left.starts[to])
        n = sizes[part]
        row = np.repeat(np.repeat(np.arange(at, to), np.diff(left.starts[at : to + 1])), n)
        from_ = np.repeat(right.starts[left.columns[part]] - (np.cumsum(n) - n), n) + np.arange(len(row))
        entry = row * right.width + right.columns[from_]
        if np.any(entry[1:] < entry[:-1]):
            entry.sort()
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.empty(0, np.int64)
        yield entry[first] // right.width, entry[first] % right.width, np.diff(first, append=len(entry))
        at = to


def joined_blocks(blocks: Iterator[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    found = list(blocks)
    return tuple(np.concatenate([np.empty(0, np.int64), *[b[k] for b in found]]).astype(np.int64) for k in range(3))


class Links(NamedTuple):
    """Of tokens numbered from 0: overlap links (a, b, shared bytes), links that end together (a, b), each token's group,
    and for each A token how many shared-group links it has."""

    overlap: tuple[np.ndarray, np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    group_a: np.ndarray
    group_b: np.ndarray

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of the shared-group links: the product of the token-group incidences."""
        n = len(self.ends[0])
        one = lambda g: Rows.of(np.ones(len(g), np.int64), g, n)
        return product(one(self.group_a), one(self.group_b).turned())


def links(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Links:
    """Links of two rows of tokens, given the bytes of each, over the same bytes."""
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    n = int(ends_a[-1]) if len(ends_a) else 0
    a, b = (Rows.of(s, np.arange(n), n) for s in (sizes_a, sizes_b))
    overlap = joined_blocks(product(a, b.turned()))
    last = ends_a[overlap[0]] == ends_b[overlap[1]]
    ends = overlap[0][last], overlap[1][last]
    return Links(overlap, ends, np.searchsorted(ends[0], np.arange(len(ends_a))), np.searchsorted(ends[1], np.arange(len(ends_b))))


class Known:
    """What each stretch seen so far adds to its document, by its number: figures, its groups as text (None: not given back), and its pairs:
    a * 2^32 + b of each link that ends together."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[bytes | None] = []
        self.blocks: list[tuple[np.ndarray, np.ndarray]] = []
        self.joined: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def add(self, new: list[str], groups: list[bytes | None], figures: np.ndarray, pairs: np.ndarray) -> None:
        """``figures``: a row for each stretch of n_a, n_b, n_links, n_overlaps, n_shared; ``pairs`` of all of them in a row."""
        self.number.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups += groups
        self.blocks.append((figures, pairs))
        self.joined = None

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Figures, and pairs in compressed rows: starts, pairs."""
        if self.joined is None:
            figures, pairs = (np.concatenate(x) for x in zip((np.empty((0, len(FIGURES)), np.int32), np.empty(0, np.int64)), *self.blocks, strict=True))
            self.blocks = [(figures, pairs)]
            self.joined = figures, np.concatenate([[0], np.cumsum(figures[:, 2], dtype=np.int64)]), pairs
        return self.joined


class Aligner:
    """Aligns stretches. ``source``: tokenizer A as JSON; ``model``: B's file, both some megabytes at most."""

    def __init__(self, source: str, model: bytes, odd: str):
        import sentencepiece

        self.code = bpe.Encoder(source, bpe.GPT2_PATTERN, odd)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a = bpe.token_bytes(source)
        self.bytes_b = piece_bytes(self.pieces)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.space = self.pieces.piece_to_id(_SPACE)
        self.names = list(map(str, range(max(len(self.bytes_a), len(self.bytes_b)))))
        self.known = Known()

    def forget(self) -> None:
        self.code.pieces.clear()
        self.known = Known()

    def numbers(self, stretches: list[str]) -> np.ndarray:
        """The numbers of stretches in ``known``; new ones are aligned first."""
        number = self.known.number
        new = [s for s in dict.fromkeys(stretches) if s not in number]
        at = 0
        while at < len(new):
            to, size = at + 1, len(new[at])
            while to < len(new) and size + len(new[to]) <= BLOCK_BYTES // 2:
                size += len(new[to])
                to += 1
            self.align(new[at:to])
            at = to
        return np.fromiter(map(number.__getitem__, stretches), np.int64, len(stretches))

    def tokens(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and B in a row, how many each stretch has, and which stretches both give back byte for byte; the others have none."""
        coded = list(map(self.code, stretches))
        pieces = [i if len(s) > 1 else [self.space] for s, i in zip(stretches, self.pieces.encode([s[1:] for s in stretches], num_threads=1), strict=True)]
        a, b = np.frombuffer(b"".join(coded), "<i4").astype(np.int64), np.fromiter(chain.from_iterable(pieces), np.int64)
        per_a, per_b = np.fromiter(map(len, coded), np.int64, len(coded)) // 4, np.fromiter(map(len, pieces), np.int64, len(pieces))
        size = np.fromiter((len(s.encode()) for s in stretches), np.int64, len(stretches))
        good = np.ones(len(stretches), bool)
        for ids, per, table, sizes in ((a, per_a, self.bytes_a, self.sizes_a), (b, per_b, self.bytes_b, self.sizes_b)):
            ends = np.cumsum(np.concatenate([[0], per]))
            own = np.diff(np.concatenate([[0], np.cumsum(sizes[ids])])[ends])
            if np.any(own != size) or b"".join(map(table.__getitem__, ids.tolist())) != "".join(stretches).encode():
                good &= [bpe.joined(ids[x:y], table) == s.encode() for s, x, y in zip(stretches, ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        return a[np.repeat(good, per_a)], b[np.repeat(good, per_b)], per_a * good, per_b * good, good

    def align(self, new: list[str]) -> None:
        """Works out new stretches in one product of block-diagonal matrices."""
        a, b, per_a, per_b, good = self.tokens(new)
        found = links(self.sizes_a[a], self.sizes_b[b])
        ends = np.cumsum(np.concatenate([[0], per_a]))
        closed = np.searchsorted(found.ends[0], ends)  # links before each stretch, as all end where their stretch does
        shared = np.zeros(len(a) + 1, np.int64)
        for row, _, _ in found.shared():
            shared[1:] += np.bincount(row, minlength=len(a))
        figures = np.stack([per_a, per_b, *map(np.diff, (closed, np.searchsorted(found.overlap[0], ends), np.cumsum(shared)[ends]))], 1).astype(np.int32)
        text_a, text_b = (list(map(self.names.__getitem__, ids.tolist())) for ids in (a, b))
        to_a, to_b = ((x + 1).tolist() for x in found.ends)
        said = [f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in zip([0, *to_a[:-1]], to_a, [0, *to_b[:-1]], to_b, strict=True)] if to_a else []
        groups = [";".join(said[i:j]).encode() if g else None for i, j, g in zip(closed[:-1].tolist(), closed[1:].tolist(), good.tolist(), strict=True)]
        self.known.add(new, groups, figures, a[found.ends[0]] << 32 | b[found.ends[1]])


def piece_bytes(pieces) -> list[bytes]:
    """The bytes of every id of a sentencepiece model: U+2581 is a space, a byte piece its byte; control ids have none."""
    out = []
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        if pieces.is_byte(i):
            out.append(bytes([int(piece[3:-1], 16)]))
        else:
            out.append(b"" if pieces.is_control(i) or pieces.is_unknown(i) else piece.replace(_SPACE, " ").encode())
    return out


@functools.lru_cache(1)
def aligner(source: str, model: bytes, odd: str) -> Aligner:
    """One for each worker, kept between tasks."""
    return Aligner(source, model, odd)


def without_added(source: str) -> str:
    """Tokenizer A without its added tokens: their strings in a text are plain text."""
    return json.dumps(json.loads(source) | {"added_tokens": []})


def stretches_of(text: str | None) -> list[str]:
    return _STRETCH.findall(f" {text}") if text else []


def small(values: np.ndarray) -> bytes:
    """Whole numbers from 0 in as few bytes as the largest needs."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def unsmall(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def align(docs: DataFrame, source: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, a_ids and b_ids array<int>, and links between positions in them: overlaps
    array<struct<a,b,bytes>>, ends array<struct<a,b>>; a_groups, b_groups array<int> give each token's group: tokens of
    equal groups are linked by it."""
    shipped = docs.sparkSession.sparkContext.broadcast((without_added(source), model, bpe.odd_characters()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*shipped.value)
        for batch in (part for whole in batches for part in bpe.slices(whole, 1)):
            out = []
            for id_, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b, _, _, good = own.tokens(stretches_of(text_))
                if not good.all():
                    a, b = a[:0], b[:0]
                found = links(own.sizes_a[a], own.sizes_b[b])
                out.append({"id": id_, "a_ids": a, "b_ids": b, "overlaps": [dict(zip(("a", "b", "bytes"), x, strict=True)) for x in zip(*(v.tolist() for v in found.overlap), strict=True)], "ends": [dict(zip(("a", "b"), x, strict=True)) for x in zip(*(v.tolist() for v in found.ends), strict=True)], "a_groups": found.group_a, "b_groups": found.group_b})
            yield pa.RecordBatch.from_pylist(out, schema)
        own.forget()

    pair = [("a", pa.int32()), ("b", pa.int32())]
    ints = pa.list_(pa.int32())
    schema = pa.schema([("id", pa.int64()), ("a_ids", ints), ("b_ids", ints), ("overlaps", pa.list_(pa.struct([*pair, ("bytes", pa.int32())]))), ("ends", pa.list_(pa.struct(pair))), ("a_groups", ints), ("b_groups", ints)])
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "id long, a_ids array<int>, b_ids array<int>, overlaps array<struct<a:int,b:int,bytes:int>>, ends array<struct<a:int,b:int>>, a_groups array<int>, b_groups array<int>")


def sliced(rows: DataFrame, source: str, model: bytes) -> DataFrame:
    """(id, text) -> a row for each slice of texts: its documents' figures, and three levels of narrow rows: documents of
    stretches, stretches of pairs, and the distinct pairs with the links that have them."""
    shipped = rows.sparkSession.sparkContext.broadcast((without_added(source), model, bpe.odd_characters()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, done = aligner(*shipped.value), 0
        for batch in (part for whole in batches for part in bpe.slices(whole, 1, SLICE_ROWS)):
            if len(own.known.groups) > MEMO_STRETCHES:
                own.forget()
            texts, shas, kept, at = batch.column(1), [], [], 0
            while at < len(texts):  # texts whose stretches are looked up together
                parts, held = [], 0
                while at < len(texts) and held < LOOKED_UP:
                    parts.append(stretches_of(texts[at].as_py()))
                    held += len(parts[-1])
                    at += 1
                n = own.numbers([s for p in parts for s in p])
                for n in np.split(n, np.cumsum(list(map(len, parts)))[:-1]):
                    said = [own.known.groups[k] for k in n.tolist()]
                    if None in said:
                        n, said = n[:0], []
                    kept.append(n)
                    shas.append(hashlib.sha256(b";".join(said)).hexdigest() if said else "")
            figures, starts, all_pairs = own.known.table()
            used, at = np.unique(np.concatenate([np.empty(0, np.int64), *kept]), return_inverse=True)
            figures, per = figures[used], np.diff(starts)[used]
            from_ = np.repeat(starts[used] - (np.cumsum(per) - per), per) + np.arange(per.sum())
            pairs, link = np.unique(all_pairs[from_], return_inverse=True)
            linked = np.bincount(link, np.repeat(np.bincount(at, minlength=len(used)), per), len(pairs)).astype(np.int64)
            ends = np.cumsum([0, *map(len, kept)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(figures[at, k], dtype=np.int64)])[ends]) for k in range(len(FIGURES))]
            row = [pa.array([TaskContext.get().partitionId() << 32 | done]), one(batch.column(0)), *map(one, sums), one(shas), *[pa.array([small(x)]) for x in (np.diff(ends), at, per, link)], one(pairs >> 32, pa.int32()), one(pairs & 0xFFFFFFFF, pa.int32()), one(linked)]
            yield pa.RecordBatch.from_arrays(row, schema=schema)
            done += 1
        own.forget()

    def one(values, kind: pa.DataType | None = None) -> pa.ListArray:
        """A list column of one row."""
        flat = values if isinstance(values, pa.Array) else pa.array(values, kind or (pa.string() if isinstance(values, list) else pa.int64()))
        return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("slice", pa.int64()), ("ids", longs), *[(c, longs) for c in FIGURES], ("groups", pa.list_(pa.string())), *[(c, pa.binary()) for c in LEVELS], ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("times", longs)])
    return rows.mapInArrow(run, f"slice long, ids array<long>, {', '.join(f'{c} array<long>' for c in FIGURES)}, groups array<string>, {', '.join(f'{c} binary' for c in LEVELS)}, a array<int>, b array<int>, times array<long>")


def pair_counts(slices: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of all slices hold a pair of ids, and whether no pair of that B id has more."""
    own = slices.select(F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("p.*")
    return own.groupBy("a", "b").agg(F.sum("times").alias("count")).withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("b")))


def summary(docs: DataFrame, source: str, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, n_a, n_b, n_groups, n_links (those that end together), n_best (of these, links whose
    pair no other of its B id exceeds in the whole table), count_sum (their pairs' counts), groups_sha256, n_overlaps, n_shared."""
    scratch = Scratch(docs.sparkSession, "alignment")
    slices = scratch.keep(sliced(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")), source, model))
    own = slices.select("slice", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("slice", "at", "p.*")
    told = own.join(pair_counts(slices), ["a", "b"]).groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("at", "count", "best"))).alias("told"))
    told = told.select("slice", F.col("told.count").alias("counts"), F.col("told.best").alias("best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                value = lambda c: np.asarray(row[c].values) if row[c].is_valid else np.empty(0, np.int64)  # noqa: E731, B023
                n_docs, at, per, link = (unsmall(row[c].as_py()) for c in LEVELS)
                through = [np.diff(np.concatenate([[0], np.cumsum(v[link])])[np.cumsum(np.concatenate([[0], per]))]) for v in (value("counts").astype(np.int64), np.asarray(row["best"].values.cast(pa.int64())) if row["best"].is_valid else np.empty(0, np.int64))]
                ends = np.cumsum(np.concatenate([[0], n_docs]))
                count_sum, n_best = (np.diff(np.concatenate([[0], np.cumsum(v[at])])[ends]) for v in through)
                columns = [row["ids"].values, value("n_a"), value("n_b"), value("n_links"), value("n_links"), n_best, count_sum, row["groups"].values, value("n_overlaps"), value("n_shared")]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps", "n_shared"]
    answered = slices.drop("a", "b", "times").join(told, "slice", "left")
    return answered.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names))
