"""Queries that run as streams over the landed events, each compared with SQL over the table as a whole."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.plans import oracle as sql
from tidegauge.sources import adapters
from tidegauge.streaming import streams

c = F.col


def _folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one; only a local session without one gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/live-{uuid.uuid4().hex}"


def _quotes(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", c("ts").cast("timestamp").alias("ts"), c("event_type").alias("kind"), (c("user_id") % 10).cast("string").alias("code"), "value")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed events as a stream of quotes of boards."""
    schema = adapters.landed(spark, sf_dir, "events").schema
    return _quotes(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]"))  # a pattern, as the table may be one file or a folder


#: The landed events arrive as so many files or more, cut by time.
SLICES = 6


def _slice(spark: SparkSession, sf_dir: str, folder: str, order: Sequence[int]) -> DataFrame:
    """The landed events, cut at equal distances in time, as a stream whose batches have the slices in ``order``."""
    landed = adapters.landed(spark, sf_dir, "events")
    ts = F.unix_micros(c("ts").cast("timestamp"))
    low, high = landed.agg(F.min(ts), F.max(ts)).first()
    cut = F.least(F.lit(SLICES - 1), F.floor((ts - low) * SLICES / ((high - low) + 1)))
    for n in order:  # one after the other, as a stream takes files by their times
        landed.filter(cut == n).write.mode("append").parquet(f"{folder}/landed")
    files = max(1, landed.rdd.getNumPartitions())
    return _quotes(spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/landed"))


def _run(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """The rows that a stream hands on until its input ends."""
    folder = _folder(spark)
    rows.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def live_cross_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed; the last ones are still open when the input ends."""
    return _run(streams.cross_sections(_events(spark, sf_dir), "6 hours", "10 minutes"), spark)


_WINDOWS = """quotes as (select time_bucket(interval '6 hours', ts) as captured_at, event_type as kind, (user_id % 10)::varchar as code, value, ts from events),
closed as (select captured_at, kind, code, avg(value) as level, max(value) as top, arg_max(value, ts) as last_value, count(*) as quotes from quotes group by all),
ended as (select * from closed where captured_at + interval '6 hours' <= (select max(ts) - interval '10 minutes' from events))"""


def live_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event lands twice and is counted once."""
    rows = _events(spark, sf_dir)
    once = _run(streams.distinct_events(rows.unionByName(rows), ["event_id"], "10 minutes"), spark)
    return once.groupBy("kind", "code").agg(F.count("*").alias("events"), F.sum("value").alias("value"))


def live_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last quote of each board and day, after a batch for each slice of the events, of which one comes late."""
    folder = _folder(spark)
    rows = _slice(spark, sf_dir, folder, (0, 2, 1, *range(3, SLICES))).withColumn("day", F.to_date("ts"))
    streams.upsert_stream(rows, folder, f"{folder}/state", ["kind", "code", "day"], "ts", "day", ["event_id"]).awaitTermination()
    return streams.read_upserts(spark, folder, rows.schema, "day")


def live_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each window as it closes beside the one before it on its day, batch by batch."""
    folder = _folder(spark)
    rows = streams.cross_sections(_slice(spark, sf_dir, folder, range(SLICES)), "6 hours", "10 minutes").select("captured_at", "kind", "code", "level")
    streams.delta_stream(rows, folder, f"{folder}/state").awaitTermination()
    return streams.read_deltas(spark, folder, rows.schema)


#: Name, plan, columns and SQL of each query.
ENTRIES = [
    ("live_cross_sections", live_cross_sections, ["captured_at", "kind", "code", "level", "top", "last_value", "quotes"], sql.query(_WINDOWS, "ended", sql.listed(["level", "top", "last_value"], ["strftime(captured_at, '%Y-%m-%d %H:%M:%S') as captured_at", "kind", "code", "quotes"]))),
    ("live_distinct", live_distinct, ["kind", "code", "events", "value"], f"select event_type as kind, (user_id % 10)::varchar as code, count(*) as events, {sql.settled('sum(value)')} as value from events group by 1, 2"),
    ("live_upsert", live_upsert, ["kind", "code", "day", "event_id", "value"], f"select kind, code, day::varchar as day, event_id, {sql.settled('value')} as value from (select event_type as kind, (user_id % 10)::varchar as code, ts::date as day, event_id, value, row_number() over (partition by event_type, user_id % 10, ts::date order by ts desc, event_id desc) as n from events) where n = 1"),
    ("live_deltas", live_deltas, ["captured_at", "kind", "code", "previous", "delta_intraday"], sql.query(f"{_WINDOWS},\nbefore as (select *, lag(level) over (partition by kind, code, captured_at::date order by captured_at) as previous from ended)", "before", f"strftime(captured_at, '%Y-%m-%d %H:%M:%S') as captured_at, kind, code, {sql.settled('previous')} as previous, {sql.settled('level - previous')} as delta_intraday")),
]
