"""Structured Streaming forms: periodic cross-sections, keep-last upserts, deltas against the last snapshot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tidegauge.operators.trajectory import upserted


def cross_sections(events: DataFrame, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Quotes (ts, kind, code, value) as one row for each board and window; a quote older than the one kept does not win."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", every).alias("w"), "kind", "code").agg(F.avg("value").alias("level"), F.max("value").alias("top"), F.max_by("value", "ts").alias("last_value"), F.max("ts").alias("last_ts"), F.count("*").alias("quotes"))
    return grouped.select(F.col("w.start").alias("captured_at"), "kind", "code", "level", "top", "last_value", "last_ts", "quotes")


def distinct_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


class DayTable:
    """A table in folders by one column, of which batches replace some. A batch is first staged whole, then takes its folders'
    place: one that failed half way, or comes again, is put in place from what was staged, and merges nothing twice."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, by: str):
        self.spark, self.folder, self.schema, self.by = spark, folder, schema, by

    def _there(self, path: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _delete(self, path: str) -> None:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def read(self, days: list | None = None) -> DataFrame:
        """The rows of all folders, or of those named; types are the table's own, not inferred from folder names."""
        path = f"{self.folder}/table"
        rows = self.spark.read.schema(self.schema).parquet(path).select(*self.schema.names) if self._there(path) else self.spark.createDataFrame([], self.schema)
        return rows if days is None else rows.filter(F.col(self.by).isin(days))

    def replace(self, number: int, rows: Callable[[], DataFrame]) -> bool:
        """Puts ``rows()``, whole folders, in the place of the folders they fill; whether they had to be made."""
        staged, new = f"{self.folder}/staged/{number}", False
        if not self._there(f"{staged}/_SUCCESS"):
            rows().select(*self.schema.names).write.mode("overwrite").partitionBy(self.by).parquet(staged)
            new = True
        self.spark.read.schema(self.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(f"{self.folder}/table")
        self._delete(f"{self.folder}/staged/{number - 2}")  # the last batch and this one may come again
        return new


def upsert_stream(rows: DataFrame, folder: str, checkpoint: str, keys: list[str], moment: str, partition: str, ties: Sequence[str] = ()) -> StreamingQuery:
    """Keeps of each key the row of the latest ``moment`` (then the largest ``ties``), whatever batch it comes in: ``read_upserts`` has
    the table. ``partition`` must be one of the keys: a batch reads and rewrites the folders of its own values only, late rows' among them."""
    if partition not in keys:
        raise ValueError("the partition column must be a key, or a key's row could lie in a folder that its batch does not touch")
    schema = rows.schema

    def merge(batch: DataFrame, number: int) -> None:
        table = DayTable(batch.sparkSession, folder, schema, partition)

        def merged() -> DataFrame:
            days = [r[0] for r in batch.select(partition).distinct().collect()]  # of one batch
            return upserted(table.read(days), batch, keys, moment, ties)

        batch.persist()
        table.replace(number, merged)
        batch.unpersist()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserts(spark: SparkSession, folder: str, schema: T.StructType, partition: str) -> DataFrame:
    return DayTable(spark, folder, schema, partition).read()


def intraday_deltas(batch: DataFrame, stored: DataFrame, value: str = "level") -> DataFrame:
    """A micro-batch's rows beside the latest earlier snapshot of their day, stored or of the same batch: what changed since. Both are
    laid out by board and day, so that no row meets another day's, and each batch row looks back along its own line."""
    line = ["kind", "code", "captured_at"]
    both = stored.select(*line, value, F.lit(False).alias("_asks")).join(batch.select(*line), line, "left_anti").unionByName(batch.select(*line, value, F.lit(True).alias("_asks")))
    earlier = Window.partitionBy("kind", "code", F.to_date("captured_at")).orderBy(F.unix_micros("captured_at")).rangeBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("previous", F.last(value, ignorenulls=True).over(earlier)).filter("_asks")
    return seen.select(*line, value, "previous", (F.col(value) - F.col("previous")).alias("delta_intraday"))


def delta_stream(rows: DataFrame, folder: str, checkpoint: str, value: str = "level") -> StreamingQuery:
    """Cross-sections (kind, code, captured_at, value) as they close, each beside the latest earlier one of its day: of the same batch, or
    of the days stored by the batches before, which are all that it reads. Rows and deltas are stored by day; ``read_deltas`` has them.

    A row that comes later than a newer one of its day is compared with what was before it, and the stored rows after it in that day
    are compared anew, so deltas do not depend on how rows are cut into batches."""
    schema = T.StructType([*[rows.schema[c] for c in ("kind", "code", "captured_at", value)], T.StructField("previous", T.DoubleType()), T.StructField("delta_intraday", T.DoubleType()), T.StructField("day", T.DateType())])

    def step(batch: DataFrame, number: int) -> None:
        table = DayTable(batch.sparkSession, folder, schema, "day")

        def compared() -> DataFrame:
            own = batch.select("kind", "code", "captured_at", value)
            days = [r[0] for r in own.select(F.to_date("captured_at")).distinct().collect()]  # of one batch
            stored = table.read(days).select("kind", "code", "captured_at", value)
            every = upserted(stored, own, ["kind", "code", "captured_at"], "captured_at")
            return intraday_deltas(every, every.limit(0), value).withColumn("day", F.to_date("captured_at"))

        batch.persist()
        table.replace(number, compared)
        batch.unpersist()

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_deltas(spark: SparkSession, folder: str, schema: T.StructType, value: str = "level") -> DataFrame:
    """What ``delta_stream`` stored of rows with ``schema``."""
    own = T.StructType([*[schema[c] for c in ("kind", "code", "captured_at", value)], T.StructField("previous", T.DoubleType()), T.StructField("delta_intraday", T.DoubleType()), T.StructField("day", T.DateType())])
    return DayTable(spark, folder, own, "day").read()
