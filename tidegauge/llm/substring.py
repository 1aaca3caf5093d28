"""Removal of passages that an earlier document already has.

A window is ``WINDOW`` consecutive words of one document. Every word that lies in a window whose word sequence also
starts in a document with a smaller id is removed.

Method: a count-min prefilter, then exact groups. Documents are dealt to chunks of bounded size. Pass 1: each chunk marks
the sketch cells of its windows; the partition sketches are merged by ranges of cells, and each chunk learns which of its
cells count more than one window. The estimate is never too low, so no repeated window is lost. Pass 2: only windows
estimated repeated are grouped, by 96 bits of their words, and each chunk learns which of them start in a document of
another chunk with a smaller id. Pass 3 removes the words.

How it scales: the sketch has ``CELLS`` cells for each window, so its error does not grow with the data; it is never
gathered in one place. A chunk sends a cell and a window once, however often it has them, so a passage that a third of
all documents share costs each merging task one entry for each chunk. Answers return as one bit for each entry. The passes
are one plan over one exchange of the texts, which Spark reuses.

Words are compared by 64-bit hashes and windows by 96 bits made of these: with N distinct windows, two different ones pass for equal
with a probability of about N * N / 2^97, and two words of V with one of V * V / 2^65.

Defined results: the key is a number; a null or empty text has no words and loses none; windows are judged on the input, not on what is left;
windows repeated only within one document stay; rows that share an id are the same document; a row without an id has no
smaller one before it and comes before none, so it keeps its words; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import re
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.runtime import hash_words, mixed, rolling, shuffle_width, text_bytes

WINDOW = 13
#: Bytes of text in a chunk, sketch cells for each window, rows of cells in the sketch, and entries a merging task gets.
CHUNK_BYTES, CELLS, ROWS, RANGE_ENTRIES = 6_000_000, 8, 2, 3_000_000
#: Bytes of a word and the space after it, about.
WORD_BYTES = 6
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_SECOND, _LOW = np.uint64(0xD6E8FEB86659FD93), np.uint64((1 << 22) - 1)


class Windows:
    """The windows of a chunk's documents: the hash and the first word of each occurrence, in order of the documents."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("id").to_pylist()
        self.words = [(t.as_py() or b"").split() for t in table.column("text")]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        each = [hash_words(w) for w in self.words]
        self.word_hashes = np.concatenate([np.empty(0, np.uint64), *each])
        self.hash = np.concatenate([np.empty(0, np.uint64), *[rolling(h, WINDOW) for h in each]])
        counts = np.maximum(self.sizes - WINDOW + 1, 0)
        self.document = np.repeat(np.arange(len(each)), counts)
        shift = np.cumsum(self.sizes) - self.sizes - (np.cumsum(counts) - counts)
        self.start = np.arange(len(self.hash)) + shift[self.document]

    def sketched(self, row: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's cells in a row of the sketch, ascending, and which of them it fills more than once."""
        cells = np.sort(cells_of(self.hash, row, bits))
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.empty(0, np.int64)
        return cells[first], np.diff(first, append=len(cells)) > 1

    def estimated(self, got: dict, ranges: int, bits: int) -> np.ndarray:
        """The occurrences whose windows every row of the sketch counts more than once."""
        chosen = np.arange(len(self.hash))
        for row in range(ROWS):
            cells, _ = self.sketched(row, bits)
            at = split_points(cells, ranges, bits)
            often = cells[np.concatenate([np.empty(0, bool), *[got[f"row{row}", int(r)] for r in np.flatnonzero(np.diff(at))]])]
            if not len(often):
                return np.empty(0, np.int64)
            own = cells_of(self.hash[chosen], row, bits)
            quick = np.zeros(1 << 22, bool)  # a table of the cells' low bits leaves few to look up in order
            quick[often & _LOW] = True
            near = np.flatnonzero(quick[own & _LOW])
            own = own[near]
            chosen = chosen[near[often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own]]
        return chosen

    def grouped(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen occurrences: the distinct windows' hashes, 32 more bits, the least ids they start in; and the
        occurrences in that order with each one's window."""
        more = np.zeros(len(chosen), np.uint64)
        for k in range(WINDOW):
            more = more * _SECOND + self.word_hashes[self.start[chosen] + k]
        more = (mixed(more) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((more, self.hash[chosen]))
        chosen, more = chosen[order], more[order]
        hashes = self.hash[chosen]
        first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (more[1:] != more[:-1])])) if len(hashes) else np.empty(0, np.int64)
        least = np.minimum.reduceat(self.numbers()[self.document[chosen]], first) if len(first) else np.empty(0, np.int64)
        window = np.repeat(np.arange(len(first)), np.diff(first, append=len(hashes)))
        return hashes[first], more[first], least, chosen, window

    def numbers(self) -> np.ndarray:
        return np.array([2**63 - 1 if i is None else i for i in self.ids], np.int64)


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch: other bits of it for each row."""
    turned = hashes if row == 0 else (hashes << np.uint64(23 * row)) | (hashes >> np.uint64(64 - 23 * row))
    return (turned * np.uint64(0x9E3779B97F4A7C15 + 2 * row)) >> np.uint64(64 - bits)


def packed(sorted_values: np.ndarray) -> bytes:
    """One or more ascending integers: the first, then the differences in as few bytes as the largest needs."""
    steps = np.diff(sorted_values)
    kind = np.min_scalar_type(int(steps.max(initial=0)))
    return bytes([kind.itemsize]) + sorted_values[:1].tobytes() + steps.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    first, steps = np.frombuffer(data, "<u8", 1, offset=1), np.frombuffer(data, f"<u{data[0]}", offset=9)
    return np.cumsum(np.concatenate([first, steps.astype(np.uint64)]), dtype=np.uint64)


def shifted(values: np.ndarray) -> bytes:
    """Integers in any order: the least, then what each is above it, in as few bytes as the largest needs."""
    above = (values - values.min()).astype(np.uint64)
    kind = np.min_scalar_type(int(above.max()))
    return bytes([kind.itemsize]) + values.min().tobytes() + above.astype(kind).tobytes()


def unshifted(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8", 1, offset=1)[0] + np.frombuffer(data, f"<u{data[0]}", offset=9).astype(np.int64)


def split_points(sorted_values: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each of ``ranges`` equal ranges of ``bits``-bit values begins."""
    edges = np.array([(i << bits) // ranges for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_values, edges), [len(sorted_values)]])


def left_of(text: bytes, away: np.ndarray) -> bytes:
    """A text without the words marked; each run of words that stay keeps its white space, runs are joined by a space."""
    spans = [m.span() for m in _WORD.finditer(text)]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], away, [True]]).astype(np.int8)))
    return b" ".join(text[spans[a][0] : spans[b - 1][1]] for a, b in zip(edges[::2], edges[1::2], strict=True))


def answers(rows: pa.Table) -> dict[tuple[str, int], np.ndarray]:
    """The bits that came back to a chunk, by what was asked (a row of the sketch, or the exact groups) and range."""
    return {(r["kind"], r["range"]): np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["entries"]).astype(bool) for r in rows.to_pylist()}


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each row of ``docs``: id, n_words, n_removed, kept (binary: the kept words joined by one space); with
    ``with_text`` also text: what is left of the text with its own white space, or all of it if nothing goes."""
    width = shuffle_width(docs)
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_bytes(F.col(f"`{text}`")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`"))), F.lit(0)).cast("long")).first()[0]
    windows = total // WORD_BYTES  # sizes the sketch and its ranges; results are right for any number
    chunks = max(width, -(-total // CHUNK_BYTES))
    bits = max(16, (windows * CELLS).bit_length())
    ranges = max(width, -(-windows * ROWS // RANGE_ENTRIES))
    chunked = plain.withColumn("chunk", F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")

    def mark(table: pa.Table) -> pa.Table:
        found, chunk, out = Windows(table), table.column("chunk")[0].as_py(), []
        for row in range(ROWS):
            cells, again = found.sketched(row, bits)
            at = split_points(cells, ranges, bits)
            for r in np.flatnonzero(np.diff(at)):
                part = slice(at[r], at[r + 1])
                out.append({"range": int(r), "kind": f"row{row}", "chunk": chunk, "data": packed(cells[part]), "more": np.packbits(again[part]).tobytes(), "entries": int(at[r + 1] - at[r])})
        return pa.Table.from_pylist(out, sketch_schema)

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        cells = [unpacked(r["data"]) for r in rows]
        seen, where, times = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
        often = times > 1
        again = np.concatenate([np.unpackbits(np.frombuffer(r["more"], np.uint8), count=r["entries"]) for r in rows]).astype(bool)
        often[where[again]] = True
        return pa.Table.from_pylist([{"chunk": r["chunk"], "kind": r["kind"], "range": r["range"], "bits": np.packbits(b).tobytes(), "entries": r["entries"]} for r, b in zip(rows, np.split(often[where], np.cumsum([len(c) for c in cells])[:-1]), strict=True)], answer_schema)

    def offer(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], exact_schema)
        found, out = Windows(table), []
        hashes, more, least, _, _ = found.grouped(found.estimated(answers(replies), ranges, bits))
        at = split_points(hashes, ranges, 64)
        for r in np.flatnonzero(np.diff(at)):
            part = slice(at[r], at[r + 1])
            out.append({"range": int(r), "chunk": table.column("chunk")[0].as_py(), "data": packed(hashes[part]), "more": more[part].tobytes(), "least": shifted(least[part]), "entries": int(at[r + 1] - at[r])})
        return pa.Table.from_pylist(out, exact_schema)

    def group(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = np.concatenate([unpacked(r["data"]) for r in rows])
        more = np.concatenate([np.frombuffer(r["more"], "<u4") for r in rows])
        least = np.concatenate([unshifted(r["least"]) for r in rows])
        order = np.lexsort((more, hashes))
        new = np.concatenate([[True], (np.diff(hashes[order]) != 0) | (np.diff(more[order]) != 0)])
        first = np.empty(len(order), np.int64)
        first[order] = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        elsewhere = np.split(first < least, np.cumsum([r["entries"] for r in rows])[:-1])
        return pa.Table.from_pylist([{"chunk": r["chunk"], "kind": "exact", "range": r["range"], "bits": np.packbits(b).tobytes(), "entries": r["entries"]} for r, b in zip(rows, elsewhere, strict=True)], answer_schema)

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_pylist([], result_schema)
        found, got = Windows(table), answers(replies)
        hashes, _, least, chosen, window = found.grouped(found.estimated(got, ranges, bits))
        at = split_points(hashes, ranges, 64)
        elsewhere = np.concatenate([np.empty(0, bool), *[got["exact", int(r)] for r in np.flatnonzero(np.diff(at))]])
        known = np.array([i is not None for i in found.ids], bool)[found.document[chosen]]
        gone = chosen[known & (elsewhere[window] | (least[window] < found.numbers()[found.document[chosen]]))]
        size = len(found.word_hashes) + 1
        lost = np.cumsum(np.bincount(found.start[gone], minlength=size) - np.bincount(found.start[gone] + WINDOW, minlength=size)) > 0
        out, at_word = [], 0
        for i, words in zip(found.ids, found.words, strict=True):
            away = lost[at_word : at_word + len(words)]
            at_word += len(words)
            removed = int(away.sum())
            out.append((i, len(words), removed, b" ".join(compress(words, (~away).tolist()) if removed else words)))
            if with_text:
                whole = table.column("text")[len(out) - 1].as_py()
                out[-1] += ((left_of(whole, away) if removed else whole or b"").decode(),)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), result_schema.types, strict=True)], schema=result_schema)

    sketch_schema = pa.schema([("range", pa.int32()), ("kind", pa.string()), ("chunk", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("entries", pa.int32())])
    answer_schema = pa.schema([("chunk", pa.int32()), ("kind", pa.string()), ("range", pa.int32()), ("bits", pa.binary()), ("entries", pa.int32())])
    exact_schema = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("least", pa.binary()), ("entries", pa.int32())])
    result_schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), *[("text", pa.string())] * with_text])
    answer = "chunk int, kind string, range int, bits binary, entries int"

    by_chunk = chunked.groupBy("chunk")
    marked = by_chunk.applyInArrow(mark, "range int, kind string, chunk int, data binary, more binary, entries int")
    often = marked.groupBy("range", "kind").applyInArrow(merge, answer)
    offered = by_chunk.cogroup(often.groupBy("chunk")).applyInArrow(offer, "range int, chunk int, data binary, more binary, least binary, entries int")
    exact = offered.groupBy("range").applyInArrow(group, answer)
    return by_chunk.cogroup(often.unionByName(exact).groupBy("chunk")).applyInArrow(remove, "id long, n_words long, n_removed long, kept binary" + ", text string" * with_text)
