"""Removal of long byte strings that occur more than once, by a distributed, sparse suffix array.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else, in the same document or another, goes.
Such a string is called a window; windows never cross documents, and are judged on the input, not on what is left.

Method: suffixes are sorted where windows have an anchor: the place in a window whose first K bytes hash least, the first
of these on a tie. Equal windows have their anchors at the same distance x from their start, so a window is repeated if and
only if another anchor has the same ``length - x`` bytes after it and the same x bytes before it. About one place in 70 is an anchor.

1. Splitters are sampled from all anchored suffixes.
2. A prefilter drops anchors whose first K bytes (by 64 bits of a hash) no other anchor has; a false alarm costs room only.
3. The windows of each anchor left travel as one segment to the bucket that the splitters assign to the suffix at the anchor.
4. A bucket sorts the suffixes by multikey quicksort, the bytes before the anchors likewise, and has from both orders and their
   longest common prefixes, for each distance x, classes of equal windows. All comparisons are of bytes.
5. Buckets compare across their boundaries: windows whose bytes after the anchor begin a splitter may have their like in the next
   bucket, so their SHA-256 digests are grouped over buckets. Equal digests are taken for equal windows.

How it scales: documents are dealt to chunks of bounded size, one exchange of texts serves all passes. A chunk sends equal
segments once, and a prefix of K bytes once, so copies cost each chunk one entry. A prefix that a third of all documents share
is cut into buckets by what follows it, then by what stands before it, then by chunk. Splitters are at most ``MAX_SPLITTERS`` (each of at most some
400 bytes); beyond that many buckets, their parts are told apart by the prefix's hash. No group is larger than a chunk, a bucket, or a range of hashes.

Defined results: a null or empty text has no bytes; texts shorter than ``length`` lose none; equal texts of at least ``length`` bytes all
lose everything, whatever their ids, as rows are documents even where they share an id or have none; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.runtime import mixed, shuffle_width, text_bytes
from tidegauge.llm.substring import packed, split_points, unpacked

LENGTH = 200
#: Bytes of text in a chunk and in a block of one; bytes of segments in a bucket, if no anchor were dropped; entries that a merging task gets.
CHUNK_BYTES, BLOCK, BUCKET_BYTES, RANGE_ENTRIES = 4_000_000, 1 << 18, 24_000_000, 3_000_000
#: Splitters at most, and suffixes sampled for each of them.
MAX_SPLITTERS, OVERSAMPLE = 1 << 15, 8
#: Groups of suffixes that quicksort leaves to a plain sort of the rest of their bytes.
LEAF = 256
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW32 = np.uint64(0xFFFFFFFF)


class Shape(NamedTuple):
    """A window's length; the bytes that its anchor is chosen by."""

    length: int
    prefix: int

    @classmethod
    def of(cls, length: int) -> Shape:
        return cls(length, 1 << max(0, (length // 3).bit_length() - 1))

    @property
    def reach(self) -> int:
        """An anchor's largest distance from the start of its window."""
        return self.length - self.prefix

    def segment_bytes(self, text_bytes_: int) -> int:
        """About the bytes of all segments of a text: an anchor for each (reach + 2) / 2 places, length more for each."""
        return text_bytes_ * (1 + 2 * self.length // (self.reach + 2))


def prefix_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width`` (a power of two) consecutive bytes, by joining halves."""
    h, w = _BYTE[data], 1
    while w < width:
        h = h[:-w] * np.uint64(0xD6E8FEB86659FD93 + 2 * w) + h[w:]
        w *= 2
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of all ``width`` consecutive values."""
    w = 1
    while 2 * w <= width:
        values = np.minimum(values[:-w], values[w:])
        w *= 2
    return np.minimum(values[: len(values) - (width - w)], values[width - w :])


class Chunk:
    """A chunk's documents in a settled order, and their anchors: for each, the first window, the last one, the place, the prefix's hash."""

    def __init__(self, table: pa.Table, shape: Shape):
        rows = sorted(zip(table.column("id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1] or b""))
        self.shape, self.ids = shape, [i for i, _ in rows]
        texts = [t or b"" for _, t in rows]
        self.data = b"".join(texts)
        self.bytes = np.frombuffer(self.data, np.uint8)
        self.ends = np.cumsum([0, *map(len, texts)])
        parts = [self.block(spans) for spans in self.blocks()]
        self.first, self.last, self.place, self.hash = (np.concatenate([np.empty(0, kind), *[p[k] for p in parts]]) for k, kind in enumerate((np.int64, np.int64, np.int64, np.uint64)))

    def blocks(self):
        """Ranges of windows of one document each, gathered to about ``BLOCK`` bytes."""
        out, size = [], 0
        for start, end in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True):
            for at in range(start, end - self.shape.length + 1, BLOCK):
                to = min(at + BLOCK, end - self.shape.length + 1)
                if out and size + to - at > BLOCK:
                    yield out
                    out, size = [], 0
                out.append((at, to))
                size += to - at
        if out:
            yield out

    def block(self, spans: list[tuple[int, int]]):
        base, over = spans[0][0], spans[-1][1] - 1 + self.shape.length
        hashes = prefix_hashes(self.bytes[base:over], self.shape.prefix)
        keys = mixed(hashes) & ~_LOW32 | np.arange(len(hashes), dtype=np.uint64)
        anchor = (sliding_least(keys, self.shape.reach + 1) & _LOW32).astype(np.int64)
        start, to = (np.array(x, np.int64) - base for x in zip(*spans, strict=True))
        window = np.arange(len(anchor))
        if len(spans) > 1:
            inside = np.zeros(len(anchor) + 1, np.int64)
            np.add.at(inside, start, 1)
            np.add.at(inside, to, -1)
            window = window[np.cumsum(inside[:-1]) > 0]
        anchor = anchor[window]
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(window)]]) - 1
        place = anchor[first]
        return window[first] + base, window[last] + base, place + base, mixed(hashes[place] ^ np.uint64(0x9E3779B97F4A7C15))  # not the bits that they were chosen by

    def key(self, k: int) -> bytes:
        """What the segment of anchor k is sorted by: the suffix, then the bytes before it, the nearest first."""
        return self.data[self.place[k] : self.last[k] + self.shape.length].ljust(self.shape.length, b"\0") + self.data[self.first[k] : self.place[k]][::-1]


class Segments(NamedTuple):
    """Distinct segments: bytes before the anchor, windows, whether they occur more than once, and their bytes in a row."""

    left: np.ndarray
    windows: np.ndarray
    again: np.ndarray
    data: bytes

    def to_row(self) -> dict:
        return {"left": self.left.astype("<u2").tobytes(), "windows": self.windows.astype("<u2").tobytes(), "again": np.packbits(self.again).tobytes(), "data": zstandard.compress(self.data, 1)}

    @classmethod
    def of_rows(cls, rows: list[dict]) -> Segments:
        left, windows = (np.concatenate([np.frombuffer(r[c], "<u2") for r in rows]).astype(np.int64) for c in ("left", "windows"))
        again = np.concatenate([np.unpackbits(np.frombuffer(r["again"], np.uint8), count=len(r["left"]) // 2) for r in rows]).astype(bool)
        return cls(left, windows, again, b"".join(zstandard.decompress(r["data"]) for r in rows))

    def chosen(self, which: np.ndarray, length: int) -> Segments:
        ends = np.cumsum(np.concatenate([[0], self.windows + length - 1])).tolist()
        return Segments(self.left[which], self.windows[which], self.again[which], b"".join(self.data[ends[k] : ends[k + 1]] for k in which.tolist()))


def multikey_order(rows: np.ndarray) -> np.ndarray:
    """The order of equally long byte strings (a matrix of bytes) by multikey quicksort, eight bytes at a time: three parts by a
    pivot at one depth, of which the middle one goes on to the next; small groups are left to a sort of whole strings."""
    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = rows
    words, whole = padded.view(">u8"), padded.view(f"S{padded.shape[1]}").ravel()
    order, stack = np.arange(n), [(0, n, 0)]
    while stack:
        lo, hi, depth = stack.pop()
        if hi - lo < 2 or depth == words.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= LEAF:
            order[lo:hi] = part[np.argsort(whole[part], kind="stable")]
            continue
        word = words[part, depth]
        pivot = np.sort(word[:: max(1, len(word) // 9)])[4]
        low, same = word < pivot, word == pivot
        order[lo:hi] = np.concatenate([part[low], part[same], part[~low & ~same]])
        a, b = lo + int(low.sum()), lo + int(low.sum()) + int(same.sum())
        stack += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many bytes each string shares with the one before it in order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 15):
        to = min(at + (1 << 15), len(order))
        unlike = rows[order[at:to]] != rows[order[at - 1 : to - 1]]
        out[at:to] = np.where(unlike.any(1), unlike.argmax(1), rows.shape[1])
    return out


class Bucket:
    """Sorted segments of a bucket."""

    def __init__(self, segments: Segments, shape: Shape):
        self.segments, self.shape = segments, shape
        n, size = len(segments.left), segments.windows + shape.length - 1
        self.start = np.cumsum(size) - size
        data = np.concatenate([np.frombuffer(segments.data, np.uint8), np.zeros(shape.length, np.uint8)])
        anchor = self.start + segments.left
        self.after, self.before = np.zeros((n, shape.length), np.uint8), np.zeros((n, max(1, shape.reach)), np.uint8)
        for at in range(0, n, 1 << 14):
            part = slice(at, at + (1 << 14))
            k = np.arange(shape.length)
            self.after[part] = np.where(k < (size - segments.left)[part, None], data[np.minimum(anchor[part, None] + k, len(data) - 1)], 0)
            k = np.arange(max(1, shape.reach))
            self.before[part] = np.where(k < segments.left[part, None], data[np.maximum(anchor[part, None] - 1 - k, 0)], 0)
        self.orders = [multikey_order(m) for m in (self.after, self.before)]
        self.common = [common_prefixes(m, o) for m, o in zip((self.after, self.before), self.orders, strict=True)]
        self.offset = np.cumsum(segments.windows) - segments.windows  # of a segment's windows among all

    def classes(self):
        """For each distance x: the segments that have a window so far before their anchor, and the class of each one's window."""
        n, least = len(self.start), self.segments.left - self.segments.windows + 1
        for x in range(self.shape.reach + 1):
            has = np.flatnonzero((least <= x) & (self.segments.left >= x))
            if not len(has):
                continue
            number = np.empty((2, n), np.int64)
            for k, enough in enumerate((self.shape.length - x, x)):
                number[k, self.orders[k]] = np.cumsum(self.common[k] < enough)
            _, class_ = np.unique(number[0, has] * (n + 1) + number[1, has], return_inverse=True)
            yield x, has, class_

    def window(self, k: int, x: int) -> bytes:
        at = self.start[k] + self.segments.left[k] - x
        return self.segments.data[at : at + self.shape.length]


def shared_lengths(rows: np.ndarray, splitter: bytes) -> np.ndarray:
    """How many leading bytes each row has in common with a splitter."""
    edge = np.frombuffer(splitter[: rows.shape[1]], np.uint8)
    unlike = rows[:, : len(edge)] != edge
    return np.where(unlike.any(1), unlike.argmax(1), len(edge)) if len(edge) else np.zeros(len(rows), np.int64)


def separators(sample: list[bytes], wanted: int) -> list[bytes]:
    """At most ``wanted`` ascending splitters at equal distances in a sorted sample, each as short as it can be."""
    if not sample or wanted < 1:
        return []
    out = []
    for k in range(1, wanted + 1):
        at = min(len(sample) - 1, k * len(sample) // (wanted + 1))
        here, before = sample[at], sample[at - 1] if at else b""
        n = next((i for i, (a, b) in enumerate(zip(here, before, strict=False)) if a != b), min(len(here), len(before)))
        out.append(here[: n + 1])
    return sorted(set(out))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """A row for each row of ``docs``: id, n_bytes, n_removed, spans array<struct<start,end>> (maximal removed runs, in bytes), kept binary."""
    shape, width, spark = Shape.of(length), shuffle_width(docs), docs.sparkSession
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_bytes(F.col(f"`{text}`")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).cast("long")).first()[0]
    chunks = max(width, -(-total // CHUNK_BYTES))
    anchors = 2 * total // (shape.reach + 2)
    ranges = max(width, -(-anchors // RANGE_ENTRIES))
    buckets = max(width, -(-shape.segment_bytes(total) // BUCKET_BYTES))
    wanted = min(buckets, MAX_SPLITTERS) - 1
    parts = -(-buckets // (wanted + 1))
    taken = spark.sparkContext.broadcast(separators(sampled(plain, shape, total, anchors, wanted, chunks), wanted))  # at most MAX_SPLITTERS
    chunked = plain.withColumn("chunk", F.pmod(F.xxhash64("id", F.octet_length("text"), F.rand(13)), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    def bucket_of(chunk: Chunk, k: int, number: int) -> int:
        return bisect_right(taken.value, chunk.key(k) + number.to_bytes(4, "big")) * parts + int(chunk.hash[k] % np.uint64(parts))

    def mark(table: pa.Table) -> pa.Table:
        hashes = np.sort(Chunk(table, shape).hash)
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.empty(0, np.int64)
        again, hashes, number = np.diff(first, append=len(hashes)) > 1, hashes[first], table.column("chunk")[0].as_py()
        at = split_points(hashes, ranges, 64)
        out = [{"range": int(r), "chunk": number, "data": packed(hashes[at[r] : at[r + 1]]), "again": np.packbits(again[at[r] : at[r + 1]]).tobytes()} for r in np.flatnonzero(np.diff(at))]
        return pa.Table.from_pylist(out, mark_schema)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = [unpacked(r["data"]) for r in rows]
        _, where, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        often = times > 1
        often[where[np.concatenate([np.unpackbits(np.frombuffer(r["again"], np.uint8), count=len(h)) for r, h in zip(rows, hashes, strict=True)]).astype(bool)]] = True
        return pa.Table.from_pylist([{"chunk": r["chunk"], "kind": 0, "place": r["range"], "bits": np.packbits(b).tobytes()} for r, b in zip(rows, np.split(often[where], np.cumsum([len(h) for h in hashes])[:-1]), strict=True)], answer_schema)

    def left_in(chunk: Chunk, replies: dict) -> np.ndarray:
        """Anchors whose prefix another anchor has, too."""
        hashes = np.unique(chunk.hash)
        at = split_points(hashes, ranges, 64)
        often = np.concatenate([np.empty(0, bool), *[np.unpackbits(np.frombuffer(replies[0, int(r)], np.uint8), count=at[r + 1] - at[r]).astype(bool) for r in np.flatnonzero(np.diff(at))]])
        return np.flatnonzero(often[np.searchsorted(hashes, chunk.hash)]) if len(hashes) else np.empty(0, np.int64)

    def dealt(chunk: Chunk, number: int, replies: dict) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray], np.ndarray]:
        """The anchors left in, each one's distinct segment (by an anchor that has it), and the distinct ones of each bucket."""
        left, known, which, times = left_in(chunk, replies), {}, [], []
        firsts: list[int] = []
        first, last, place = chunk.first[left].tolist(), (chunk.last[left] + length).tolist(), chunk.place[left].tolist()
        for k, (a, b, p) in enumerate(zip(first, last, place, strict=True)):
            n = known.setdefault((p - a, chunk.data[a:b]), len(firsts))
            if n == len(firsts):
                firsts.append(k)
                times.append(0)
            times[n] += 1
            which.append(n)
        firsts_ = left[np.array(firsts, np.int64)]
        in_bucket = np.array([bucket_of(chunk, k, number) for k in firsts_.tolist()], np.int64)
        order = np.argsort(in_bucket, kind="stable")
        cut = np.flatnonzero(np.diff(in_bucket[order])) + 1
        groups = {int(in_bucket[g[0]]): g for g in np.split(order, cut) if len(g)}
        return left, np.array(which, np.int64), {b: (firsts_[g], g) for b, g in groups.items()}, np.array(times, np.int64)

    def answers(rows: pa.Table) -> dict:
        return {(r["kind"], r["place"]): r["bits"] for r in rows.to_pylist()}

    def offer(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], segment_schema)
        chunk, number, out = Chunk(table, shape), table.column("chunk")[0].as_py(), []
        _, _, groups, times = dealt(chunk, number, answers(replies))
        for bucket, (k, n) in groups.items():
            data = b"".join(chunk.data[a:b] for a, b in zip(chunk.first[k].tolist(), (chunk.last[k] + length).tolist(), strict=True))
            out.append({"bucket": bucket, "chunk": number, **Segments(chunk.place[k] - chunk.first[k], chunk.last[k] - chunk.first[k] + 1, times[n] > 1, data).to_row()})
        return pa.Table.from_pylist(out, segment_schema)

    def at_edges(segments: Segments, bucket: int) -> tuple[Bucket, np.ndarray, np.ndarray] | None:
        """The segments whose prefix begins a splitter of the bucket, and how many leading bytes they share with one."""
        edges = [taken.value[e] for e in (bucket // parts - 1, bucket // parts) if 0 <= e < len(taken.value)]
        edges = [e for e in edges if len(e) >= shape.prefix]
        if not edges:
            return None
        size = segments.windows + length - 1
        anchor = np.cumsum(size) - size + segments.left
        begin = np.frombuffer(segments.data, np.uint8)[anchor[:, None] + np.arange(shape.prefix)]
        near = np.flatnonzero(np.any([shared_lengths(begin, e) == shape.prefix for e in edges], axis=0))
        if not len(near):
            return None
        sorted_ = Bucket(segments.chosen(near, length), shape)
        return sorted_, near, np.max([shared_lengths(sorted_.after, e) for e in edges], axis=0)

    def edge_windows(found: tuple[Bucket, np.ndarray, np.ndarray]):
        """For each distance: the segments at an edge, each one's class, and a digest of each class."""
        sorted_, near, common = found
        for x, has, class_ in sorted_.classes():
            touch = common[has] >= length - x
            has, class_ = has[touch], class_[touch]
            if len(has):
                _, first, class_ = np.unique(class_, return_index=True, return_inverse=True)
                yield x, has, class_, [hashlib.sha256(sorted_.window(k, x)).digest() for k in has[first].tolist()]

    def edges(table: pa.Table) -> pa.Table:
        rows, bucket = sorted(table.to_pylist(), key=lambda r: r["chunk"]), table.column("bucket")[0].as_py()
        found = at_edges(Segments.of_rows(rows), bucket)
        mine: dict[int, list[bytes]] = {}
        for d in {d for *_, digests in edge_windows(found) for d in digests} if found else ():
            mine.setdefault(int.from_bytes(d[:4], "big") % ranges, []).append(d)
        return pa.Table.from_pylist([{"part": p, "bucket": bucket, "digests": b"".join(d)} for p, d in mine.items()], edge_schema)

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        all_ = [np.frombuffer(r["digests"], "S32") for r in rows]
        _, where, times = np.unique(np.concatenate(all_), return_inverse=True, return_counts=True)
        often = np.split((times > 1)[where], np.cumsum([len(d) for d in all_])[:-1])
        return pa.Table.from_pylist([{"bucket": r["bucket"], "digests": d[o].tobytes()} for r, d, o in zip(rows, all_, often, strict=True) if o.any()], met_schema)

    def decide(table: pa.Table, met: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], answer_schema)
        rows, bucket = sorted(table.to_pylist(), key=lambda r: r["chunk"]), table.column("bucket")[0].as_py()
        segments = Segments.of_rows(rows)
        sorted_ = Bucket(segments, shape)
        repeated = np.repeat(segments.again, segments.windows)
        for x, has, class_ in sorted_.classes():
            often = np.bincount(class_)[class_] > 1
            repeated[(sorted_.offset + segments.left - x)[has[often]]] = True
        elsewhere = {d[i : i + 32] for d in met.column("digests").to_pylist() for i in range(0, len(d), 32)}
        if elsewhere:
            found = at_edges(segments, bucket)
            for x, has, class_, digests in edge_windows(found):
                here = np.array([d in elsewhere for d in digests], bool)[class_]
                k = found[1][has[here]]
                repeated[sorted_.offset[k] + segments.left[k] - x] = True
        per_row = np.cumsum([int(np.frombuffer(r["windows"], "<u2").sum(dtype=np.int64)) for r in rows])[:-1]
        return pa.Table.from_pylist([{"chunk": r["chunk"], "kind": 1, "place": bucket, "bits": np.packbits(b).tobytes()} for r, b in zip(rows, np.split(repeated, per_row), strict=True)], answer_schema)

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], result_schema)
        chunk, got = Chunk(table, shape), answers(replies)
        left, which, groups, _ = dealt(chunk, table.column("chunk")[0].as_py(), got)
        mark = np.zeros(len(chunk.data), bool)
        flags: list = [None] * (int(which.max()) + 1 if len(which) else 0)
        for bucket, (k, n) in groups.items():
            windows = chunk.last[k] - chunk.first[k] + 1
            bits = np.unpackbits(np.frombuffer(got[1, bucket], np.uint8), count=int(windows.sum())).astype(bool)
            for i, b in zip(n.tolist(), np.split(bits, np.cumsum(windows)[:-1]), strict=True):
                flags[i] = np.flatnonzero(b)
        hits = [flags[i] for i in which.tolist()]
        at = np.concatenate([np.empty(0, np.int64), *hits]) + np.repeat(chunk.first[left], [len(h) for h in hits])
        mark[at] = True
        before = np.concatenate([np.zeros(length, np.int64), np.cumsum(mark)])
        gone = before[length:] > before[:-length]
        out = []
        for i, a, b in zip(chunk.ids, chunk.ends[:-1].tolist(), chunk.ends[1:].tolist(), strict=True):
            own = gone[a:b]
            turns = np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
            out.append({"id": i, "n_bytes": b - a, "n_removed": int(own.sum()), "spans": [{"start": s, "end": e} for s, e in turns.reshape(-1, 2).tolist()], "kept": chunk.bytes[a:b][~own].tobytes()})
        return pa.Table.from_pylist(out, result_schema)

    number, blob = pa.int32(), pa.binary()
    mark_schema = pa.schema([("range", number), ("chunk", number), ("data", blob), ("again", blob)])
    answer_schema = pa.schema([("chunk", number), ("kind", number), ("place", number), ("bits", blob)])
    segment_schema = pa.schema([("bucket", number), ("chunk", number), ("left", blob), ("windows", blob), ("again", blob), ("data", blob)])
    edge_schema = pa.schema([("part", number), ("bucket", number), ("digests", blob)])
    met_schema = pa.schema([("bucket", number), ("digests", blob)])
    result_schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", blob)])
    answer = "chunk int, kind int, place int, bits binary"

    by_chunk = chunked.groupBy("chunk")
    often = by_chunk.applyInArrow(mark, "range int, chunk int, data binary, again binary").groupBy("range").applyInArrow(merge, answer)
    segments = by_chunk.cogroup(often.groupBy("chunk")).applyInArrow(offer, "bucket int, chunk int, left binary, windows binary, again binary, data binary").repartition("bucket")
    met = segments.groupBy("bucket").applyInArrow(edges, "part int, bucket int, digests binary").groupBy("part").applyInArrow(meet, "bucket int, digests binary")
    decided = segments.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(decide, answer)
    return by_chunk.cogroup(often.unionByName(decided).groupBy("chunk")).applyInArrow(remove, "id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")


def sampled(plain: DataFrame, shape: Shape, total: int, anchors: int, wanted: int, chunks: int) -> list[bytes]:
    """Sorted keys of some of all anchored suffixes: about ``OVERSAMPLE`` for each splitter wanted, every place as likely as another."""
    keys = max(1, wanted * OVERSAMPLE)
    within = 64  # one anchor of so many of a sampled document
    share = min(1.0, keys * within / max(1, anchors))
    one_of = max(1, round(anchors * share / keys))

    def run(batches):
        random = np.random.default_rng(13)
        for batch in batches:
            for r in range(batch.num_rows):
                chunk = Chunk(pa.Table.from_batches([batch.slice(r, 1)]), shape)
                chosen = np.flatnonzero(random.integers(one_of, size=len(chunk.first)) == 0).tolist()
                yield pa.RecordBatch.from_pydict({"key": [chunk.key(k) + int(random.integers(chunks)).to_bytes(4, "big") for k in chosen]}, pa.schema([("key", pa.binary())]))

    return sorted(bytes(r.key) for r in plain.filter(F.rand(29) < share).mapInArrow(run, "key binary").collect()) if total else []
