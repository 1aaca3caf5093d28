"""From raw documents to packed training sequences, in four stages over the whole table.

Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next reads it. All but the last return the
columns of documents: doc_id, text, lang, source, n_chars. Null texts stay, as empty documents do: no stage rejects them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.llm import bpe, neardup, packing, queries, runtime, substring, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic, by labels of the table and none of the held-out ones."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), queries.held_out(), carry=True)
    return scored.filter("predicted = 0").select("row.*").select(*COLUMNS)


def _print(seed: int) -> Column:
    """A hash of a row's content, its id among it, above all smaller ids: 2^62 and 62 bits that depend on ``seed``."""
    content = F.xxhash64(F.lit(seed), *[x for c in ("doc_id", "text", "lang", "source") for x in (F.col(c), F.col(c).isNull())])
    return content.bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``number``: the id for one row of each id, and a number above all ids for the rest.

    Only rows of null or repeated ids are told apart by hashes. Where rows of different content share the first hash, the second
    one numbers them, so rows are taken for one only if they agree in 124 bits. Rows of equal content are one row.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").select(F.col("doc_id").alias("odd_id"))
    if odd.isEmpty():
        return docs.withColumn("number", F.col("doc_id"))
    marked = docs.join(odd.withColumn("is_odd", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("odd_id")), "left").drop("odd_id")
    rows = marked.withColumns({"first_print": F.when(F.col("is_odd"), _print(0)), "second_print": F.when(F.col("is_odd"), _print(1))})
    told = rows.filter("is_odd").groupBy("doc_id", "first_print", "second_print").agg(F.lit(True).alias("is_odd"))
    met = told.groupBy("first_print").agg(F.count("*").alias("contents")).filter("contents > 1").select(F.col("first_print").alias("met_print"), F.lit(True).alias("is_met"))
    single = told.join(met, F.col("first_print") == F.col("met_print"), "left").withColumn("print", F.when(F.col("is_met"), F.col("second_print")).otherwise(F.col("first_print")))
    own = single.filter("doc_id is not null").groupBy("doc_id").agg(F.min("print").alias("print"))
    keyed = single.join(own.withColumn("is_own", F.lit(True)), ["doc_id", "print"], "left")
    number = F.when(F.col("is_own"), F.col("doc_id")).otherwise(F.col("print"))
    numbers = keyed.select(F.col("first_print").alias("a"), F.col("second_print").alias("b"), number.alias("odd_number"))
    out = rows.join(numbers, (F.col("first_print") == F.col("a")) & (F.col("second_print") == F.col("b")), "left")
    return out.withColumn("number", F.when(F.col("is_odd"), F.col("odd_number")).otherwise(F.col("doc_id"))).drop("is_odd", "first_print", "second_print", "a", "b", "odd_number")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of the smallest id (null ids last, then by content).

    Rows are told apart by ``numbered``, as ids may be null or repeated. Rows without shingles all stay.
    """
    rows = numbered(docs)
    found = neardup.near_duplicates(rows, key="number").select(F.col("id").alias("number"), "n_shingles", "component_id").distinct()
    ids = rows.select("number", "doc_id").distinct()
    kept = found.join(ids, "number").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "number"))["number"].alias("number"), F.max("n_shingles").alias("n_shingles"))
    left = rows.join(kept.select("number", "n_shingles"), "number")
    apart = F.when(F.col("n_shingles") == 0, F.monotonically_increasing_id())
    return left.withColumn("apart", apart).dropDuplicates(["number", "apart"]).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that one of a smaller id has too; rows of null or repeated ids come last."""
    rows = numbered(docs)
    cut = substring.deduplicate(rows, key="number", with_text=True).select("id", "text")
    about = rows.select("number", "doc_id", "lang", "source").dropDuplicates(["number"])
    joined = cut.join(about, F.col("id").eqNullSafe(F.col("number")))
    return joined.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, bpe.from_json(public_tokenizers.path("byte_bpe_50k.json")), with_ids=False)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: The trees and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what lies between them goes to the shared folder of checkpoints."""
    scratch = runtime.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
