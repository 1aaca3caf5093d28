"""SimHash fingerprints, and the search for all fingerprints within a Hamming radius by permuted block tables.

A text's terms are its words (A-Z in lower case) and its pairs of neighbouring words. Each term's hash votes on every bit
with the term's weight, once for each time it occurs: pairs weigh 1, a word a sixteenth for each of its first eight bytes,
so that short common words say little. A bit is set if its votes are above zero. The share d of differing bits of two
fingerprints estimates the angle between the term vectors, so ``likeness`` is the cosine cos(pi * d), at least 0.

``neighbours`` counts, for each fingerprint, the other rows within a Hamming radius, by the permuted block tables.

Defined results: a text without terms (null, empty, white space) has the fingerprint of no set bits; the likeness of two
such is 1, of one such and any other text 0; equal texts have equal fingerprints; an empty table gives an empty table;
the key is a number; rows without an id come first in order; rows of one id follow each other by text; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.runtime import hash_words, mixed, shuffle_width

BITS = 128
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64) * 2 - 1)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_HALVES = [np.uint64(0xC2B2AE3D27D4EB4F * (half + 1) % 2**64) for half in range(BITS // 64)]


def fingerprint(text: str | None) -> bytes:
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(BITS // 8)
    hashes = hash_words(words)
    weights = np.minimum(np.fromiter(map(len, words), np.float64, len(words)), 8) / 16
    terms = np.concatenate([hashes, mixed(hashes[:-1] * _PAIR + hashes[1:])])
    weights = np.concatenate([weights, np.ones(len(words) - 1)])
    votes = []
    for half in _HALVES:
        spread = mixed(terms + half).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            votes.append(np.bincount(spread[:, byte], weights, 256) @ _SIGNS)
    return np.packbits(np.concatenate(votes) > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    none = bytes(BITS // 8)
    if a == b or none in (a, b):
        return float(a == b)
    differing = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, float(np.cos(np.pi * differing / BITS)))


def edited(text: str, after: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many of ``after``, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def followed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (span, id, text, tail) such that each span of ids, in order, ends with a copy of the row that follows it.

    The copies have tail true; the last row is followed by the first. Spans come from quantiles of the ids, as many as
    there are shuffle partitions, so the rows looked up for their ends are as few.
    """
    spans = shuffle_width(docs)
    plain = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    cuts = plain.agg(F.percentile_approx("id", [i / spans for i in range(1, spans)] or [0.5], 10_000)).first()[0] or []
    edges = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    placed = plain.withColumn("span", F.coalesce(F.size(F.filter(edges, lambda x: x <= F.col("id"))), F.lit(0)))
    line = Window.partitionBy(F.lit(0)).orderBy("span")  # a row for each span
    least = placed.groupBy("span").agg(F.min(F.struct(F.col("id").isNotNull(), "id"))["id"].alias("head"))
    heads = least.select("head", F.coalesce(F.lag("span").over(line), F.max("span").over(Window.partitionBy(F.lit(0)))).alias("before"))
    ends = plain.join(F.broadcast(heads), F.col("id").eqNullSafe(F.col("head"))).groupBy("before", "id").agg(F.min("text").alias("text"))
    rows = placed.select("span", "id", "text", F.lit(False).alias("tail")).unionByName(ends.select(F.col("before").alias("span"), "id", "text", F.lit(True).alias("tail")))
    return rows.repartitionByRange(spans, "span").sortWithinPartitions("span", "tail", "id", "text").select("id", "text", "tail")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: id, n_chars, edited (the edited text), fingerprint and edited_fingerprint (lower-case
    hex), near_edited and near_next: the likeness to the edited text's fingerprint and to the next row's."""

    kind = docs.schema[key].dataType.simpleString()
    names = ["id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch, out = whole.slice(at, 1000), []
                for i, t, tail in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                    row = (i, t.as_py(), fingerprint(t.as_py()))
                    if held is not None:
                        changed = edited(held[1], row[1])
                        mark = held[2] if changed == held[1] else fingerprint(changed)
                        out.append((held[0], len(held[1]), changed, held[2].hex(), mark.hex(), likeness(held[2], mark), likeness(held[2], row[2])))
                    held = None if tail else row
                kinds = [batch.schema.field(0).type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(7)], names)

    return followed(docs, key, text).mapInArrow(run, f"id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def within_radius(queries: DataFrame, marks: DataFrame, radius: int = 3) -> DataFrame:
    """All (query, fingerprint, distance) of distinct fingerprints within ``radius`` bits of each other.

    Both inputs: column fingerprint, hex. The bits are cut into radius + 1 blocks; fingerprints within the radius agree in
    one block at least, so a table for each block, led by that block, finds them all. Copies are one row from the start.
    """
    digits, blocks = BITS // 4, radius + 1
    if radius < 0 or blocks > digits:
        raise ValueError("the radius must be from 0 to one less than the number of hex digits")
    edges = [i * digits // blocks for i in range(blocks + 1)]
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.substring("fingerprint", a + 1, b - a).alias("led_by")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]))

    def led(df: DataFrame, to: str) -> DataFrame:
        return df.select("fingerprint").filter("fingerprint is not null").distinct().select(F.col("fingerprint").alias(to), table.alias("t")).select(to, "t.block", "t.led_by")

    words = [F.bit_count(F.conv(F.substring("query", a + 1, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("fingerprint", a + 1, 8), 16, 10).cast("long"))) for a in range(0, digits, 8)]
    distance = sum(words[1:], words[0])
    met = led(queries, "query").join(led(marks, "fingerprint"), ["block", "led_by"])
    return met.withColumn("distance", distance).filter(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()


def neighbours(marks: DataFrame, radius: int = 3) -> DataFrame:
    """``marks``: a row for each document with its fingerprint. (fingerprint, n_equal, n_near): for each fingerprint the other rows
    that have it too, and the rows of other fingerprints within ``radius`` bits. Rows without one are not counted."""
    own = marks.filter("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("rows"))
    met = within_radius(own, own, radius).filter("distance > 0").join(own, "fingerprint").groupBy("query").agg(F.sum("rows").alias("n_near"))
    return own.join(met.withColumnRenamed("query", "fingerprint"), "fingerprint", "left").select("fingerprint", (F.col("rows") - 1).alias("n_equal"), F.coalesce("n_near", F.lit(0)).alias("n_near"))
