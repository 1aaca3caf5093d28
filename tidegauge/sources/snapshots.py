"""Snapshots of scored boards in a folder for each moment, written and listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: How a moment is named, and the folder of its rows.
MOMENT, FOLDER = "yyyy-MM-dd_HHmmss", "capture"


def write(rows: DataFrame, folder: str, moment: str = "captured_at") -> None:
    """Adds ``rows`` in a folder for each moment, to the second. A moment that is there already is replaced, the others are left."""
    named = rows.withColumn(FOLDER, F.date_format(moment, MOMENT))
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(FOLDER).parquet(folder)


def _name() -> Column:
    return F.regexp_extract("_metadata.file_path", f"/{FOLDER}=([^/]*)/", 1)


def _moment(name: Column) -> Column:
    """The moment that a folder's name states, null if it states none."""
    parsed = F.try_to_timestamp(name, F.lit(MOMENT))
    return F.when(F.date_format(parsed, MOMENT) == name, parsed)


def read(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rows of all folders whose names state a moment, which ``captured_at`` has; whatever the rows say themselves."""
    own = T.StructType([f for f in schema if f.name != "captured_at"])
    rows = spark.read.schema(own).option("recursiveFileLookup", "true").parquet(folder)
    return rows.withColumn("captured_at", _moment(_name())).filter("captured_at is not null")


def listed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """(name, captured_at, rows, files): a row for each folder; captured_at is null where the name states no moment, and ``read`` leaves it out."""
    named = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder).select(_name().alias("name"), F.col("_metadata.file_path").alias("file"))
    return named.groupBy("name").agg(F.count("*").alias("rows"), F.count_distinct("file").alias("files")).withColumn("captured_at", _moment(F.col("name"))).select("name", "captured_at", "rows", "files")
