"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order; row r of n gets the fraction (r - 1/2) / n; all rows are sorted by
fraction and cut into shards of equal counts. So every shard holds every source in proportion, to within a row.

How it scales: texts are read once, to narrow rows (id, size, checksum, source) in the shared folder. A rank within a
source, and one over all, come from counts by hash bucket (or by slice of the fraction), their running sums in two
levels, and a rank inside the bucket. No task ranks a whole source; buckets hold about ``BUCKET_ROWS`` rows.

Defined results: null sources are a source of their own; null texts count no bytes; rows that are equal in key and text
are interchangeable; an empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge.llm.runtime import Scratch

#: Rows ranked together, on average, and buckets whose counts one task sums.
BUCKET_ROWS, SUMMED = 5_000, 4_096


def running(counts: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """Adds ``__before`` to counts by (group, bucket): the sum over smaller buckets of the group, block by block of them."""
    earlier = lambda by, order: Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.withColumn("__block", F.floor(F.col(bucket) / SUMMED))
    totals = blocks.groupBy(*group, "__block").agg(F.sum("__count").alias("__total"))
    starts = totals.select(*group, "__block", F.coalesce(F.sum("__total").over(earlier(group, "__block")), F.lit(0)).alias("__start"))
    inside = blocks.withColumn("__inside", F.coalesce(F.sum("__count").over(earlier([*group, "__block"], bucket)), F.lit(0)))
    return inside.join(starts, [*group, "__block"]).select(*group, bucket, (F.col("__start") + F.col("__inside")).alias("__before"))


def numbered(rows: DataFrame, group: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... over (bucket, order) within each group, without a window over a whole group."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("__count"))
    placed = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)))
    return placed.join(running(counts, group, bucket), [*group, bucket]).withColumn(name, (F.col(name) + F.col("__before")).cast("long")).drop("__before")


def interleave(docs: DataFrame, shards: int, key: str = "doc_id", stratum: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """A row for each row of ``docs``: id, size (UTF-8 bytes and 8), text_crc32, stratum, stratum_rank, law (``rows``),
    shard from 0, slot from 0 without gaps."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`").cast("string")), F.lit("")).alias("stratum"),
    ).withColumn("draw", F.xxhash64(F.lit(seed), F.col("id"), F.col("text_crc32")))
    rows = Scratch(docs.sparkSession, "sharding").keep(rows)
    total = rows.count()
    buckets = max(1, -(-total // BUCKET_ROWS))

    def slice_of(fraction: Column) -> Column:
        return F.least(F.floor(fraction * buckets), F.lit(buckets - 1)).cast("long")

    rows = rows.withColumn("bucket", slice_of(F.shiftrightunsigned("draw", 11) / float(2**53)))
    ranked = numbered(rows, ["stratum"], "bucket", ["draw", "id", "size"], "stratum_rank")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    mixed = ranked.join(sizes, "stratum").withColumn("fraction", (F.col("stratum_rank") - 0.5) / F.col("n")).drop("bucket", "n")
    placed = numbered(mixed.withColumn("slice", slice_of(F.col("fraction"))), [], "slice", ["fraction", "stratum", "draw", "id"], "place")
    at = F.col("place") - 1
    exact = F.floor((at * F.lit(shards)).cast("decimal(38,0)") / F.lit(max(total, 1)).cast("decimal(20,0)")).cast("int")
    first = F.ceil((F.col("shard").cast("decimal(20,0)") * F.lit(total).cast("decimal(20,0)")) / F.lit(shards).cast("decimal(10,0)")).cast("long")
    out = placed.withColumn("shard", exact).withColumn("slot", at - first).withColumn("law", F.lit("rows"))
    return out.select("id", "size", "text_crc32", F.expr("nullif(substring(stratum, 2), '')").alias("stratum"), "stratum_rank", "law", "shard", "slot")
