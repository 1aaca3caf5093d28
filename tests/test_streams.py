"""Streams over several batches: late rows, repeated batches, folders left alone."""

import datetime as dt
import os

import pytest

from tidegauge.streaming import streams

START = dt.datetime(2024, 3, 1)


def land(spark, folder, rows, schema):
    """One file, later than those before it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


QUOTES = "code string, day string, at long, value double"
BATCHES = [
    [("a", "01", 5, 1.0), ("b", "01", 1, 2.0), ("a", "01", 7, 3.0)],
    [("a", "02", 20, 4.0)],
    [("a", "01", 6, 9.0), ("b", "01", 3, 5.0)],  # late: the first loses, the second wins
    [("c", "03", 40, 6.0)],
    [("a", "02", 20, 8.0), ("c", "03", 40, 6.0)],  # ties: the larger value stays
    [("c", "03", 39, 7.0)],
]
WANT = {("a", "01", 7, 3.0), ("b", "01", 3, 5.0), ("a", "02", 20, 8.0), ("c", "03", 40, 6.0)}


def test_upserts_over_batches(spark, tmp_path):
    landed, table = str(tmp_path / "landed"), str(tmp_path / "t")
    written = {}
    for n, rows in enumerate(BATCHES):
        land(spark, landed, rows, QUOTES)
        streams.upsert_stream(stream(spark, landed, QUOTES), table, str(tmp_path / "state"), ["code", "day"], "at", "day", ["value"]).awaitTermination()
        now = {d: sorted(os.listdir(f"{table}/table/{d}")) for d in os.listdir(f"{table}/table") if d.startswith("day=")}
        touched = {f"day={r[1]}" for r in rows}
        assert all(now[d] == files for d, files in written.items() if d not in touched), f"batch {n} rewrote other days"
        written = now
    schema = spark.createDataFrame([], QUOTES).schema
    assert {tuple(r) for r in streams.read_upserts(spark, table, schema, "day").collect()} == WANT


def test_all_files_at_once_and_a_batch_that_comes_again(spark, tmp_path):
    landed, table = str(tmp_path / "landed"), str(tmp_path / "t")
    for rows in BATCHES:
        land(spark, landed, rows, QUOTES)
    schema = spark.createDataFrame([], QUOTES).schema
    start = lambda: streams.upsert_stream(stream(spark, landed, QUOTES), table, str(tmp_path / "state"), ["code", "day"], "at", "day", ["value"])
    query = start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len(BATCHES)
    last = max(map(int, (f for f in os.listdir(tmp_path / "state" / "commits") if f.isdigit())))
    for name in (f"{last}", f".{last}.crc"):
        path = tmp_path / "state" / "commits" / name
        if path.exists():
            path.unlink()  # as if the driver had died before it noted the batch
    start().awaitTermination()
    assert {tuple(r) for r in streams.read_upserts(spark, table, schema, "day").collect()} == WANT


def test_a_failed_replacement_is_finished_from_what_was_staged(spark, tmp_path):
    schema = spark.createDataFrame([], "k string, day string, v long").schema
    table = streams.DayTable(spark, str(tmp_path), schema, "day")
    rows = lambda *x: spark.createDataFrame(x, schema)
    assert table.replace(0, lambda: rows(("a", "1", 1), ("b", "2", 2)))
    assert table.replace(1, lambda: rows(("a", "1", 5)))
    for f in (tmp_path / "table" / "day=1").iterdir():
        f.unlink()  # between the removal of the old folder and the arrival of the new one
    assert not table.replace(1, lambda: pytest.fail("was made again"))
    assert {tuple(r) for r in table.read().collect()} == {("a", "1", 5), ("b", "2", 2)}


def test_the_partition_must_be_a_key(spark, tmp_path):
    land(spark, str(tmp_path / "landed"), BATCHES[0], QUOTES)
    with pytest.raises(ValueError, match="must be a key"):
        streams.upsert_stream(stream(spark, str(tmp_path / "landed"), QUOTES), str(tmp_path / "t"), str(tmp_path / "s"), ["code"], "at", "day")


SECTIONS = "kind string, code string, captured_at timestamp, level double"


def test_deltas_do_not_depend_on_batches(spark, tmp_path):
    """Rows of two days in five batches, one of them late: as lag gives over all rows."""
    at = lambda day, hour: START + dt.timedelta(days=day, hours=hour)
    rows = [("k", c, at(d, h), float(10 * d + h + (c == "y"))) for d in range(2) for h in (0, 6, 12, 18) for c in "xy"]
    for part in (rows[:3], rows[7:9], rows[3:7], rows[9:15], [*rows[15:], rows[0]]):
        land(spark, str(tmp_path / "landed"), part, SECTIONS)
    source = stream(spark, str(tmp_path / "landed"), SECTIONS)
    streams.delta_stream(source, str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    got = {(r.code, r.captured_at): (r.level, r.previous, r.delta_intraday) for r in streams.read_deltas(spark, str(tmp_path / "t"), source.schema).collect()}
    level = {(r[1], r[2]): r[3] for r in rows}
    before = {(c, t): level.get((c, t - dt.timedelta(hours=6))) if t.hour else None for c, t in level}
    assert got == {k: (v, before[k], None if before[k] is None else v - before[k]) for k, v in level.items()}


def test_late_quotes_within_and_beyond_the_watermark(spark, tmp_path):
    """A window stays open for late quotes until the watermark passes its end; the latest quote by its own time wins."""
    quote = lambda minute, value: (START + dt.timedelta(minutes=minute), "k", "c", value)
    for part in ([quote(1, 1.0), quote(4, 4.0)], [quote(11, 9.0)], [quote(2, 2.0)], [quote(40, 5.0)], [quote(41, 5.0)], [quote(3, 100.0)], [quote(90, 7.0)]):
        land(spark, str(tmp_path / "landed"), part, "ts timestamp, kind string, code string, value double")
    rows = streams.cross_sections(stream(spark, str(tmp_path / "landed"), "ts timestamp, kind string, code string, value double"), "5 minutes", "10 minutes")
    rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    got = {r.captured_at: (r.quotes, r.top, r.last_value) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    first = got[START]
    assert first == (3, 4.0, 4.0)  # the quote of minute 2 came late but in time, that of minute 3 after the window had closed
    assert got[START + dt.timedelta(minutes=10)] == (1, 9.0, 9.0)
