"""Collocations: phrases whose words stand together more often than their parts' counts suggest, for each language.

A phrase is 2 to ``longest`` consecutive words of one piece of a text; pieces end at ``[.,;:!?]`` and at line ends. f(phrase) are
all its occurrences in its language, overlaps included.

Method: dynamic itemset counting. The texts are dealt to ``SHARDS`` shards, read in turn, again and again. Single words are counted
from the first shard on. As soon as both subphrases of a phrase (all but its last word, all but its first) are known to reach the
threshold, it is counted too, from the next shard on, until each has seen every shard once. Lengths are so interleaved: pairs are
counted while words still are, longer ones while pairs still are.

How it scales: a scan counts each task's phrases locally, by exact ids of their words, and ships distinct ones only. Which phrases
have opened, and at which step, is told to the tasks by a filter of one byte a cell, of at most ``MAX_CELLS`` cells: a phrase is open from the latest
step of its cells. It never misses one; a phrase it opens early, as others fill its cells, is counted over a full cycle from that
step all the same. So a crowded filter costs counting, never results. Sums are Spark's grouped sums of strings; what completes its cycle
below the threshold is forgotten. Ranks are taken in parts of a language first.

Defined results: a null text is empty; a null language is ``und``; equal rows all count; a text of any length is read whole; an empty table
gives an empty table; columns other than text and language are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from tidegauge.llm.runtime import Scratch, mixed, text_bytes

SHARDS = 2
#: Cells of the filter at most, and bytes of text for each cell up to there.
MAX_CELLS, CELL_BYTES = 1 << 26, 32
#: Words whose phrases a task counts together.
WORDS = 1_000_000
#: Bytes of a text that are read together.
PART_BYTES = 1_000_000
#: Parts of a language that are ranked apart before they are ranked together.
RANK_PARTS = 64
_NEVER = 255
_RANGES = 64
_STEP, _FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes as pieces are read: capitals lower, piece ends as a point.
_READ = bytes(46 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Vocabulary(dict):
    """Words and their numbers; 0 is the end of a piece."""

    def __init__(self):
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(text: bytes, vocabulary: Vocabulary) -> np.ndarray:
    """A text's words as numbers, the ends of its pieces as 0; one 0 at its end. Long texts are read in parts, cut at spaces."""
    read, out, at = text.translate(_READ), [], 0
    while at < len(read):
        to = read.find(b" ", at + PART_BYTES) if len(read) - at > PART_BYTES else -1
        words = read[at : to if to > 0 else len(read)].replace(b".", b" . ").split()
        out.append(np.fromiter(map(vocabulary.__getitem__, words), np.int64, len(words)))
        at = to if to > 0 else len(read)
    return np.concatenate([*out, np.zeros(1, np.int64)])


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def phrase_hash(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word, and its last word's."""
    return before * _STEP + last


def cells_of(hashes: np.ndarray, lang: str, cells: int) -> list[np.ndarray]:
    """Two cells of each phrase; ``cells`` is a power of two."""
    h = mixed(hashes ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
    shift = np.uint64(64 - (cells.bit_length() - 1))
    return [(h * f) >> shift for f in (_FIRST, _SECOND)]


def opened(hashes: np.ndarray, lang: str, stamps: np.ndarray) -> np.ndarray:
    """The step from which each phrase is known to reach the threshold; ``_NEVER`` if it isn't yet."""
    a, b = cells_of(hashes, lang, len(stamps))
    return np.maximum(stamps[a], stamps[b])


def counted(ids: np.ndarray, words: pa.Array, hashes: np.ndarray, lang: str, stamps: np.ndarray, step: int, shards: int, longest: int) -> Iterator[tuple[pa.Array, int, np.ndarray, np.ndarray]]:
    """Of a row of numbered words, for each length: the distinct phrases that are counted in this step, the length, the step
    each is counted from, and how often each occurs."""
    if step < shards:
        times = np.bincount(ids, minlength=len(words))
        times[0] = 0
        used = np.flatnonzero(times)
        yield words.take(pa.array(used)), 1, np.zeros(len(used), np.uint8), times[used]
    known = opened(hashes, lang, stamps)
    known[0] = _NEVER  # ends of pieces are in no phrase
    at = np.flatnonzero(known[ids] != _NEVER)  # where a phrase that is open stands
    open_, hash_, dense = known[ids[at]], hashes[ids[at]], ids[at]
    for length in range(2, longest + 1):
        near = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, since = at[near], np.maximum(open_[near], open_[near + 1])
        if not len(at):
            return
        last = ids[at + length - 1]
        key = dense[near] << 32 | last
        hash_ = phrase_hash(hash_[near], hashes[last])
        active = np.flatnonzero(since.astype(np.int64) + shards > step)
        if length == 2:  # the key is the pair, so no place of it has to be kept while sorting
            pairs, times = np.unique(key[active], return_counts=True)
            ids_, since = [pairs >> 32, pairs & 0xFFFFFFFF], np.maximum(known[pairs >> 32], known[pairs & 0xFFFFFFFF])
        else:
            _, first, times = np.unique(key[active], return_index=True, return_counts=True)
            first = active[first]
            ids_, since = [ids[at[first] + k] for k in range(length)], since[first]
        yield pc.binary_join_element_wise(*[words.take(pa.array(i)) for i in ids_], pa.scalar(" ", words.type)), length, since, times
        if length < longest:
            open_ = opened(hash_, lang, stamps)
            still = np.flatnonzero(open_ != _NEVER)
            at, open_, hash_ = at[still], open_[still], hash_[still]
            dense = np.unique(key[still], return_inverse=True)[1]


def scan(shard: DataFrame, stamps, step: int, shards: int, longest: int) -> DataFrame:
    """(lang, text binary) -> (lang, phrase, length, since, count): what each task counts in a step. ``stamps``: the filter, broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(stamps.value, np.uint8)
        vocabulary, texts, held = Vocabulary(), {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            plain = list(vocabulary)
            words, hashes = pa.array(plain, pa.binary()).cast(pa.string()), word_hash(plain)
            for lang, parts in texts.items():
                for phrases, length, since, times in counted(np.concatenate(parts), words, hashes, lang, filter_, step, shards, longest):
                    n = len(phrases)
                    columns = [pa.array([lang]).take(pa.array(np.zeros(n, np.int64))), phrases, pa.array(np.full(n, length, np.int32)), pa.array(since.astype(np.int32)), pa.array(times.astype(np.int64))]
                    whole = pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "length", "since", "count"])
                    yield from (whole.slice(k, 50_000) for k in range(0, n, 50_000))

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = numbered(text.as_py(), vocabulary)
                texts.setdefault(lang, []).append(ids)
                held += len(ids)
                if held > WORDS:
                    yield from flush()
                    vocabulary, texts, held = Vocabulary(), {}, 0
        yield from flush()

    return shard.mapInArrow(run, "lang string, phrase string, length int, since int, count long")


def filled_cells(open_: DataFrame, cells: int) -> np.ndarray:
    """The cells of the phrases in ``open_`` (lang, phrase): bits, or-ed by ranges of cells; their size depends on ``cells`` alone."""
    size = max(1, cells // _RANGES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[list[bytes]]] = {}
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(phrase.encode().split(b" "))
            found = [np.empty(0, np.uint64)]
            for lang, phrases in by_lang.items():
                ends = np.cumsum([0, *map(len, phrases)])
                hashes = word_hash([w for p in phrases for w in p])
                whole, left = hashes[ends[:-1]], np.diff(ends)
                for k in range(1, int(left.max(initial=0))):
                    more = np.flatnonzero(left > k)
                    whole[more] = phrase_hash(whole[more], hashes[ends[more] + k])
                found += cells_of(whole, lang, cells)
            all_ = np.unique(np.concatenate(found)).astype(np.int64)
            cut = np.searchsorted(all_, np.arange(1, _RANGES) * size)
            rows = [(r, part) for r, part in enumerate(np.split(all_, cut)) if len(part)]
            yield pa.RecordBatch.from_pydict({"range": [r for r, _ in rows], "data": [(part - r * size).astype("<u4").tobytes() for r, part in rows]}, schema)

    def merge(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, bool)
        for part in table.column("data"):
            bits[np.frombuffer(part.as_py(), "<u4")] = True
        return pa.Table.from_pydict({"range": [table.column("range")[0].as_py()], "data": [np.packbits(bits).tobytes()]}, schema)

    schema = pa.schema([("range", pa.int32()), ("data", pa.binary())])
    merged = open_.select("lang", "phrase").mapInArrow(spread, "range int, data binary").groupBy("range").applyInArrow(merge, "range int, data binary")
    out = np.zeros(size * _RANGES, bool)
    for r in merged.collect():  # at most _RANGES rows of MAX_CELLS / _RANGES bits
        out[r.range * size : (r.range + 1) * size] = np.unpackbits(np.frombuffer(r.data, np.uint8), count=size).astype(bool)
    return out


def counts(docs: DataFrame, scratch: Scratch, text: str, lang: str, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, count) of all phrases of up to ``longest`` words that occur ``least`` times or more; (lang, n): words in all."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), text_bytes(F.col(f"`{text}`")).alias("text")).filter("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long")).first()[0]
    shards = scratch.keep(rows.withColumn("shard", F.floor(F.rand(17) * SHARDS).cast("int")), "shard")
    cells = min(MAX_CELLS, max(1 << 16, 1 << (total // CELL_BYTES).bit_length()))
    stamps, tally, kept, done, words, step, last_opened = np.full(cells, _NEVER, np.uint8), None, None, [], None, 0, 0
    while last_opened + SHARDS > step:
        told = context.broadcast(stamps.tobytes())  # MAX_CELLS bytes at most
        own = scan(shards.filter(F.col("shard") == step % SHARDS).select("lang", "text"), told, step, SHARDS, longest)
        after = (own if tally is None else own.unionByName(tally)).repartition("lang", "phrase")  # a task's phrases are distinct already: summing them before they are dealt would only cost
        before, kept = kept, scratch.keep(after.groupBy("lang", "phrase", "length").agg(F.min("since").alias("since"), F.sum("count").alias("count")))
        if before is not None:
            scratch.drop(before)
        complete = F.col("since") + SHARDS <= step + 1
        if step == SHARDS - 1:
            words = scratch.keep(kept.filter("length = 1").groupBy("lang").agg(F.sum("count").alias("n")))
        done.append(scratch.keep(kept.filter(complete & (F.col("count") >= least)).drop("since")))
        tally, step = kept.filter(~complete), step + 1
        new = filled_cells(kept.filter((F.col("length") < longest) & (F.col("count") >= least)), cells) & (stamps == _NEVER)
        if new.any():
            stamps[new], last_opened = step, step
        told.unpersist()
    found = scratch.keep(functools.reduce(DataFrame.unionByName, done))
    scratch.drop(shards, kept, *done)
    return found, words


def scored(found: DataFrame, words: DataFrame, share: int = 50, longest: int = 3) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of two and more words in ``found`` that no longer one of it explains:
    one in which they stand, and that has at least ``share`` hundredths of their occurrences."""
    split, cut = F.split("phrase", " "), F.col("cut")
    longer = found.filter("length > 1").select("lang", "phrase", "length", F.col("count").alias("a"))
    part = lambda a, n: F.array_join(F.slice(split, a, n), " ")
    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("length") - 1))).withColumns({"first": part(F.lit(1), cut), "rest": part(cut + 1, F.col("length") - cut)})
    side = lambda name, as_: found.select("lang", F.col("phrase").alias(name), F.col("count").alias(as_))
    exact = "cast({} as decimal(19,0))".format
    rated = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    rated = rated.withColumn("score", F.expr(f"(cast(1000000 as decimal(7,0)) * {exact('a')} * {exact('a')}) div ({exact('l')} * {exact('r')})"))
    rated = rated.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("best")).select("lang", "phrase", "best.*")
    inner = longer.filter("length > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("length") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)))
    over = inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("over"))
    left = rated.join(over, ["lang", "phrase"], "left").filter(f"over is null or {exact('over')} * 100 < {exact('a')} * {int(share)}")
    return left.join(words, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, longest: int = 3, share: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language, by score, occurrences and name: lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(docs.sparkSession, "phrases")
    found, words = counts(docs, scratch, text, lang, least, longest)
    rated = scored(found, words, share, longest).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = rated.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
