"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is split by the vocabulary's pattern; each piece's UTF-8 bytes are mapped to the printable characters that
byte-level vocabularies are written in, and the library's BPE model merges them. Pieces recur, so a task remembers
the ids of those it has seen, up to ``MEMO_PIECES``.

Defined results: a null text counts as empty and has no ids; a text of any length is encoded whole; equal texts have
equal ids; an empty table gives an empty table; columns of the input other than those named are not read, and those kept
with ``keep`` pass through unchanged.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces a task remembers before it starts anew, at some 200 bytes each; a worker's next task starts without any.
MEMO_PIECES = 300_000
#: Rows, and bytes of text, whose ids a worker holds at a time; a longer text is held alone.
SLICE_ROWS, SLICE_BYTES = 500, 8_000_000
#: The byte-level pattern this module has a fast form of; others go through the ``regex`` module.
GPT2_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FAST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""


@functools.cache
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves, the rest from 256 up."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


@functools.cache
def odd_characters() -> str:
    """A character class of the characters that Python's ``re`` sorts otherwise than the Unicode properties do.

    With them go the separators that libraries differ on, and all beyond the basic plane, which ``re`` tests slowly.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))
    odd = set("\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff")
    for mine, theirs in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        odd |= set(re.findall(mine, every)) ^ set(regex.findall(theirs, every))
    return f"[{''.join(f'\\u{ord(c):04x}' for c in sorted(odd))}\\U00010000-\\U0010ffff]"


def ranked_merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts each token of a rank file was merged from, by replaying the merges of lower rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = min(((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if found[0] >= rank:
                raise ValueError(f"token {token!r} cannot be merged from lower ranks")
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


@functools.lru_cache(4)
def from_ranks(path: str, pattern: str = GPT2_PATTERN) -> str:
    """A tokenizer, as the library's JSON, that encodes by a file of base64 tokens and their ranks."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    to = byte_characters()
    seen = lambda token: "".join(to[b] for b in token)
    tokenizer = Tokenizer(models.BPE({seen(t): r for t, r in ranks.items()}, [(seen(a), seen(b)) for a, b in ranked_merges(ranks)]))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer.to_str()


@functools.lru_cache(4)
def from_json(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


class Encoder:
    """Encodes texts to little-endian 32-bit ids. ``source``: a tokenizer as JSON, some megabytes at most."""

    def __init__(self, source: str, pattern: str, odd: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(source)
        self.added = re.compile("|".join(re.escape(x["content"]) for x in json.loads(source)["added_tokens"]) or r"(?!)")
        self.model, self.memo = self.whole.model, {}
        self.split = re.compile(_FAST).findall if pattern == GPT2_PATTERN else regex.compile(pattern).findall
        self.odd = re.compile(odd) if pattern == GPT2_PATTERN else re.compile(r"(?!)")
        self.to = dict(enumerate(byte_characters()))
        owner = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                mapped = piece.encode().decode("latin-1").translate(owner.to)
                found = self[piece] = np.array([t.id for t in owner.model.tokenize(mapped)], "<u4").tobytes()
                return found

        self.pieces = Pieces()

    def __call__(self, text: str) -> bytes:
        if self.odd.search(text) or self.added.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


@functools.lru_cache(2)
def encoder(source: str, pattern: str, odd: str) -> Encoder:
    """One encoder for each worker, kept between tasks."""
    return Encoder(source, pattern, odd)


def token_bytes(source: str) -> list[bytes]:
    """The bytes of every id: the byte table read backwards; added tokens stand for themselves."""
    back = {c: b for b, c in enumerate(byte_characters())}
    read = json.loads(source)
    out = {i: bytes(back[c] for c in token) for token, i in read["model"]["vocab"].items()}
    out |= {x["id"]: x["content"].encode() for x in read["added_tokens"]}
    return [out.get(i, b"") for i in range(max(out, default=-1) + 1)]


@functools.lru_cache(2)
def byte_table(source: str) -> list[bytes]:
    return token_bytes(source)


def slices(batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of at most ``rows`` rows and about ``SLICE_BYTES`` bytes of a text column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        limit = (ends[at - 1] if at else 0) + SLICE_BYTES
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, limit, "right"))))
        yield batch.slice(at, to - at)
        at = to


def joined(ids: np.ndarray, table: list[bytes]) -> bytes:
    """The bytes that ids stand for; unknown ids give none."""
    return b"".join([table[i] for i in ids.tolist() if 0 <= i < len(table)])


def encode(docs: DataFrame, source: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pattern: str = GPT2_PATTERN, offsets: bool = True, decoded: bool = False) -> DataFrame:
    """Adds to the columns ``keep``: ids array<int>, and with ``offsets`` char_starts array<int>; with ``decoded`` the
    bytes that ``decode`` gives for the ids, from the same worker.

    char_starts[i] is the code point of the text in which token i begins; tokens that split a character between them
    share its position.
    """
    clash = {"ids", "char_starts", "decoded"} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten; rename them first")
    odd = odd_characters()
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *[T.StructField("char_starts", T.ArrayType(T.IntegerType(), False))] * offsets, *[T.StructField("decoded", T.BinaryType())] * decoded])
    shipped = docs.sparkSession.sparkContext.broadcast(source)  # one vocabulary, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidegauge.llm.runtime import lists

        code = encoder(shipped.value, pattern, odd)
        table = byte_table(shipped.value) if offsets or decoded else []
        sizes = np.array([len(b) for b in table])
        for batch in (part for whole in batches for part in slices(whole, len(keep))):
            texts = batch.column(len(keep)).to_pylist()
            ids = [np.frombuffer(code(t or ""), "<i4") for t in texts]
            columns = [*batch.columns[: len(keep)], lists(ids, pa.int32())]
            if offsets:
                columns.append(lists([character_starts(t or "", i, sizes) for t, i in zip(texts, ids, strict=True)], pa.int32()))
            if decoded:
                columns.append(pa.array([joined(i, table) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", *["char_starts"] * offsets, *["decoded"] * decoded])
        code.pieces.clear()

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def character_starts(text: str, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    starts = np.concatenate([[0], np.cumsum(sizes[ids])[:-1]]).astype(np.int64) if len(ids) else np.empty(0, np.int64)
    return character[starts].astype(np.int32)


def decode(encoded: DataFrame, source: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """Adds to the columns ``keep``: decoded binary. Tokens may split a character, so bytes are joined before they are
    read as UTF-8 (``cast('string')``). Null ids give no bytes; unknown ids give none."""
    if "decoded" in keep:
        raise ValueError("column decoded would be overwritten; rename it first")
    shipped = encoded.sparkSession.sparkContext.broadcast(source)
    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(shipped.value)
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            column = batch.column(len(keep))
            flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            parts = [joined(flat[a:b], table) for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(parts, pa.binary())], [*keep, "decoded"])

    return encoded.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("__ids")).mapInArrow(run, schema)
