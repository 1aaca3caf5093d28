"""Near-duplicate documents: MinHash bands propose pairs, sequential Bayesian verification prunes them, and full shingle
sets confirm the rest.

A document's set holds its distinct 5-word shingles; a shorter document is one shingle; an empty one has none and is
linked with nothing. Two documents are linked if their sets' Jaccard similarity is ``threshold`` or more; groups are the
connected components of the links.

How it scales: equal sets are one class from the start, so copies cost one row each. Buckets of equal band keys are never
listed: each elects a leader by a partial minimum, and a document is compared with its leaders. Verification looks at one
byte of each MinHash, batch by batch. Of the pairs that survive, a document's likeliest is confirmed first, and others
only where they still lie in different components; a text travels to its leader, whose own text is joined to it and not
sent for each pair. Other leaders are drawn for buckets that still hold several components. What is left is compared
within the bucket in tiles of bounded size, each member outside the bucket's largest component with all others; sizes and
MinHashes rule pairs out there, whole sets decide on the rest, and only links that join components become rows. Nothing
is collected to the driver; tables between the steps are written, and deleted once replaced.

What can be missed: a pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6, and is pruned with a
posterior probability below ``MISS`` at each look. Shingles are compared by 64-bit hashes of 64-bit word hashes: two different
ones of one pair of documents with n shingles each pass for equal with a probability of about n * n / 2^64.

Defined results: the key is a number; null and empty texts have n_shingles 0, component_id their own id; of rows that
share an id each takes the component of its own set, and sets whose smallest id is the same are one component; rows
without an id are kept, in no component; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.components import components
from tidegauge.llm.runtime import Scratch, hash_words, lists, mixed, rolling, text_bytes

WORDS = 5
BANDS, ROWS = 32, 4
#: Hashes compared at each look, and the posterior probability of similarity below which a pair is given up.
LOOKS, MISS = (32, 64, 96, 128), 1e-7
#: Members of a bucket on a side of a tile, and their shingles; parts that a bucket's rows are dealt to where they meet
#: its leader.
TILE, TILE_SHINGLES, SALTS = 1024, 2_000_000, 16
#: Shingles hashed at a time, so that the work stays in a core's cache.
_SLICE = 60_000
_random = np.random.default_rng(7)
HASHES = BANDS * ROWS
_XOR = _random.integers(1, 2**32, HASHES, dtype=np.uint32)
_ODD = _random.integers(1, 2**32, (2, HASHES), dtype=np.uint32) | np.uint32(1)


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or b"").lower().split()  # of bytes: A-Z, and white space 09-0D and 20, only
    if not words:
        return np.empty(0, np.uint64)
    hashes = hash_words(words)
    if len(words) < WORDS:
        return rolling(hashes, len(words), seed=len(words))
    return np.unique(rolling(hashes, WORDS))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures by ``HASHES`` hash functions, a row for each set; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + len(sets[to]) <= _SLICE):
            n += len(sets[to])
            to += 1
        flat = np.concatenate(sets[at:to])
        low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        for k in range(HASHES):
            x = (low ^ _XOR[k]) * _ODD[0, k]
            x ^= x >> np.uint32(16)
            x *= _ODD[1, k]
            out[at:to, k] = np.minimum.reduceat(x, starts)
        at = to
    return out


def band_keys(signed: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature; bands differ by their numbers."""
    rows = signed.astype(np.uint64).reshape(-1, BANDS, ROWS)
    keys = np.broadcast_to(mixed(np.arange(1, BANDS + 1, dtype=np.uint64)), rows.shape[:2])
    for k in range(ROWS):
        keys = mixed(keys ^ (rows[:, :, k] + np.uint64(k << 32)))
    return keys.view(np.int64)


def sketch(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, n_shingles, set_hi and set_lo (equal for equal sets), bands (keys, none for empty sets), marks (a byte of each
    MinHash; bytes agree by chance once in 256, which rules out less, never more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                sets = [shingles(t.as_py()) for t in batch.column(1)]
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
                full = [i for i, s in enumerate(sets) if len(s)]
                signed = signatures([sets[i] for i in full])
                keys, marks = dict(zip(full, band_keys(signed), strict=True)), dict(zip(full, signed.astype(np.uint8), strict=True))
                none = np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists([keys.get(i, none) for i in range(len(sets))], pa.int64()), pa.array([marks[i].tobytes() if i in marks else b"" for i in range(len(sets))], pa.binary())],
                    ["id", "n_shingles", "set_hi", "set_lo", "bands", "marks"],
                )

    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_bytes(F.col(f"`{text}`")).alias("text"))
    return plain.mapInArrow(run, "id long, n_shingles long, set_hi long, set_lo long, bands array<long>, marks binary")


def least_matches(threshold: float, looks: Iterable[int] = LOOKS) -> list[tuple[int, int]]:
    """After n compared hashes, the matches below which P(similarity >= threshold | matches) < MISS, from a uniform prior.

    The posterior is Beta(m + 1, n - m + 1), whose upper tail is a binomial sum.
    """
    out = []
    for n in looks:
        tail, m = 0.0, 0
        for m in range(n + 2):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= MISS:
                break
        out.append((n, m))
    return out


def looked_at(left: np.ndarray, i: np.ndarray, right: np.ndarray, j: np.ndarray, looks: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (left[i], right[j]) of marks no look rules out, and the matches of those."""
    alive, matches, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, least in looks:
        for at in range(0, len(alive), 100_000):
            some = slice(at, at + 100_000)
            matches[some] += (left[i[alive[some]], done:n] == right[j[alive[some]], done:n]).sum(axis=1)
        more = matches >= least
        alive, matches, done = alive[more], matches[more], n
    return alive, matches


def marks_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def sets_of(texts: DataFrame) -> DataFrame:
    """(id, set: its sorted shingles, eight bytes each) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py()).tobytes() for t in batch.column(1)], pa.binary())], ["id", "set"])

    return texts.select("id", "text").mapInArrow(run, "id long, set binary")


def with_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` joined to the one row of their band; a band's rows are dealt to ``SALTS`` parts, so that none is hot."""
    each = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(SALTS)).cast("int")).join(each, ["band", "salt"]).drop("salt")


def promising(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those that neither the sizes of their sets nor a look at their marks rules out, with ``matches``."""
    looks = least_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = marks_of(batch.column(2)), marks_of(batch.column(3))
            each = np.arange(batch.num_rows)
            alive, matches = looked_at(left, each, right, each, looks)
            kept = batch.take(pa.array(alive))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(matches.astype(np.int32))], ["a", "b", "matches"])

    def side(x: str) -> DataFrame:
        return signed.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("marks").alias(f"marks_{x}"))

    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").filter(sized)
    return both.select("a", "b", "marks_a", "marks_b").mapInArrow(run, "a long, b long, matches int")


def linked(sets: list[np.ndarray], component: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs (i, j), in the order of i, links that join the components of these sets: no more than there are sets.

    Two sets are compared whole, unless links found before have joined their components.
    """
    ends = np.cumsum([0, *map(len, sets)])
    _, dense = np.unique(np.concatenate(sets), return_inverse=True)
    parts = [dense[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    held = np.zeros(int(dense.max(initial=-1)) + 1, bool)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            x = up
        return x

    labels, out = component.tolist(), []
    edges = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:], strict=False):
        mine = int(i[a])
        held[parts[mine]] = True
        theirs = [y for y in j[a:b].tolist() if root(labels[y]) != root(labels[mine])]
        at = 0
        while at < len(theirs):
            to, n = at, 0
            while to < len(theirs) and (to == at or n + len(parts[theirs[to]]) <= TILE_SHINGLES):
                n += len(parts[theirs[to]])
                to += 1
            some = theirs[at:to]
            sizes = np.array([len(parts[y]) for y in some])
            common = np.add.reduceat(held[np.concatenate([parts[y] for y in some])], np.cumsum(sizes) - sizes, dtype=np.int64)
            for y in np.array(some)[100 * common >= percent * (len(parts[mine]) + sizes - common)].tolist():
                if root(labels[y]) != root(labels[mine]):
                    parent[root(labels[y])] = root(labels[mine])
                    out.append((mine, y))
            at = to
        held[parts[mine]] = False
    return out


def crossing(members: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the bands of ``members`` (band, id, component) that join different components.

    ``known``: id, n_shingles, marks and set. Each member outside its band's largest component (``other``) meets every
    member in a tile; there sizes and marks rule pairs out, whole sets decide on the rest, and no other pair is a row.
    """
    looks = least_matches(percent / 100)

    def tile(table: pa.Table) -> pa.Table:
        ids, component, size = (table.column(c).to_numpy() for c in ("id", "component", "n_shingles"))
        across, other, marks = table.column("across").to_numpy(), table.column("other").to_numpy(), marks_of(table.column("marks"))
        left, right = np.flatnonzero(~across), np.flatnonzero(across)
        small, large = np.minimum(size[left][:, None], size[right][None, :]), np.maximum(size[left][:, None], size[right][None, :])
        open_ = (component[left][:, None] != component[right][None, :]) & (100 * small >= percent * large)
        open_ &= ~other[left][:, None] | (ids[left][:, None] < ids[right][None, :])  # two others meet once
        i, j = (x.astype(np.int32) for x in np.nonzero(open_))
        alive, _ = looked_at(marks, left[i], marks, right[j], looks)
        found = []
        if len(alive):
            sets = [np.frombuffer(x, "<u8") for x in table.column("set").to_pylist()]
            found = linked(sets, component, left[i[alive]], right[j[alive]], percent)
        a, b = (ids[[x[k] for x in found]] if found else np.empty(0, np.int64) for k in (0, 1))
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    counts = members.join(known.select("id", "n_shingles"), "id").groupBy("band", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    sizes = counts.groupBy("band").agg(F.max_by(F.struct("component", "n", "shingles"), F.struct("n", "component")).alias("most"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    parts = lambda n, shingles: F.greatest(F.ceil(n / TILE), F.ceil(shingles / TILE_SHINGLES)).cast("int")
    cut = sizes.select("band", F.col("most.component").alias("largest"), parts(F.col("n"), F.col("shingles")).alias("rows"), parts(F.col("n") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")).alias("columns"))
    placed = with_bucket(members, cut).withColumn("other", F.col("component") != F.col("largest")).join(known, "id")
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    what = ["id", "component", "n_shingles", "other", "marks", "set"]
    down = placed.select("band", part("rows", "row").alias("row"), every("columns").alias("column"), F.lit(False).alias("across"), *what)
    over = placed.filter("other").select("band", every("rows").alias("row"), part("columns", "column").alias("column"), F.lit(True).alias("across"), *what)
    return down.unionByName(over).groupBy("band", "row", "column").applyInArrow(tile, "a long, b long").distinct()


def texts_of(ids: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of the documents with these ids."""
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), text_bytes(F.col(f"`{text}`")).alias("text"))
    return plain.join(ids, "id", "left_semi")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = b"", np.empty(0, np.uint64)  # pairs come in the order of b as a rule
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = []
                for i, (mine, theirs) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                    t = theirs.as_py()
                    last = last if last[0] == t else (t, shingles(t))
                    s, t = shingles(mine.as_py()), last[1]
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        found.append(i)
                yield batch.select([0, 1]).take(pa.array(found, pa.int32()))

    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs that lie in different components, with both: component_a, component_b."""
    side = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"component_{x}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.withColumns({f"component_{x}": F.coalesce(f"component_{x}", x) for x in ("a", "b")}).filter("component_a <> component_b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """A row for each row of ``docs``: id, n_shingles, component_id (the smallest id of its group), kept (it is that id).

    ``key`` must be an integer; ``percent`` is the least similarity of linked documents.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sketched = scratch.keep(sketch(docs, key, text))
    full = sketched.filter("n_shingles > 0 and id is not null")
    classes = scratch.keep(full.groupBy("set_hi", "set_lo").agg(F.min("id").alias("id"), F.min_by(F.struct("n_shingles", "bands", "marks"), "id").alias("s")).select("set_hi", "set_lo", "id", "s.*"))
    signed = classes.select("id", "n_shingles", "marks")

    banded = classes.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    bucketed = scratch.keep(with_bucket(banded, shared))  # only what shares a bucket

    # a link's documents are one component from then on, whatever else is proposed
    led = bucketed.filter("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    tried = scratch.keep(promising(led, signed, percent))
    # ids are written first: with their size known, they are broadcast only where they are few
    texts = scratch.keep(texts_of(scratch.keep(tried.select(F.explode(F.array("a", "b")).alias("id")).distinct()), docs, key, text))
    first = tried.groupBy("a").agg(F.max_by("b", F.struct("matches", -F.col("b"))).alias("b"))
    links = scratch.keep(confirmed(first, texts, percent))
    found = components(links, scratch)

    def joined(more: DataFrame) -> None:
        """Takes further links into the components."""
        nonlocal links, found
        added = scratch.keep(more)
        if not added.isEmpty():
            before, links = found, scratch.keep(links.unionByName(added))
            found = components(links, scratch)
            scratch.drop(before)

    joined(confirmed(apart(tried, found).join(first, ["a", "b"], "left_anti"), texts, percent))
    checked = tried.select("a", "b")

    def mixed_buckets(members: DataFrame, turn: int) -> DataFrame:
        """The members (band, id, component) of the buckets that hold several components, with a leader drawn at random."""
        at = members.join(found.select("id", "component"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
        salt = F.xxhash64("band", F.lit(turn))
        drawn = at.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min(F.struct(F.col("id").bitwiseXOR(salt).alias("draw"), "id", "component")).alias("l")).filter("least <> most")
        return with_bucket(at, drawn.select("band", F.col("l.id").alias("leader"), F.col("l.component").alias("of_leader")))

    many = scratch.keep(mixed_buckets(bucketed.filter("members > 2").select("band", "id"), 1))
    texts = scratch.keep(texts_of(scratch.keep(many.select("id").distinct()), docs, key, text))
    for turn in (1, 2):  # another leader merges most of what is left of a large bucket
        many = many if turn == 1 else scratch.keep(mixed_buckets(many.select("band", "id"), turn))
        pairs = many.filter("component <> of_leader").select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
        more = scratch.keep(promising(pairs.join(checked, ["a", "b"], "left_anti"), signed, percent))
        if not more.isEmpty():
            joined(confirmed(more, texts, percent))
            checked = checked.unionByName(more.select("a", "b"))
    left = scratch.keep(mixed_buckets(many.select("band", "id"), 3).select("band", "id", "component"))
    known = scratch.keep(signed.join(sets_of(texts.join(left.select("id").distinct(), "id", "left_semi")), "id"))
    joined(crossing(left, known, percent))

    placed = classes.select("set_hi", "set_lo", "id").join(found.select("id", "component"), "id", "left").select("set_hi", "set_lo", F.coalesce("component", "id").alias("component_id"))
    own = sketched.select("id", "n_shingles", "set_hi", "set_lo")
    alone = own.filter("n_shingles = 0 or id is null").select("id", "n_shingles", F.col("id").alias("component_id"))
    grouped = own.filter("n_shingles > 0 and id is not null").join(placed, ["set_hi", "set_lo"]).select("id", "n_shingles", "component_id")
    scratch.drop(*(read for read, _ in scratch.kept if not any(read is x for x in (sketched, classes, found))))
    return grouped.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
