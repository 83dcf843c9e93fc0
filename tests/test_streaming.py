"""Streams in the mode in which they would run: what is over is written once, and late events within bounds count."""

import datetime as dt
import glob
import os

from quaymark.session import shared_folder
from quaymark.streaming import bars as B

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def at(day, hour):
    return dt.datetime(2024, 1, day, hour, tzinfo=dt.timezone.utc)


def put(spark, path, rows):
    """One more file, dated behind those that are there: streams read files by date."""
    before = set(glob.glob(f"{path}/*.parquet"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    for file in set(glob.glob(f"{path}/*.parquet")) - before:
        os.utime(file, (1_700_000_000 + 60 * len(before),) * 2)


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def test_bars_of_days_that_are_over(spark, tmp_path):
    path = str(tmp_path / "events")
    put(spark, path, [(1, at(1, 9), 1, "A", 5.0), (2, at(1, 10), 1, "A", 7.0), (3, at(2, 9), 1, "A", 4.0)])
    put(spark, path, [(4, at(1, 12), 2, "A", 6.0), (5, at(5, 9), 2, "A", 9.0)])
    put(spark, path, [(6, at(5, 10), 2, "A", 8.0)])
    put(spark, path, [(7, at(1, 13), 2, "A", 99.0), (8, at(5, 11), 2, "A", 8.0)])
    got = B.drain(B.daily_bars(stream(spark, path)), "append", shared_folder(spark))
    rows = {r.day.day: (r.open, r.high, r.low, r.close, r.volume) for r in got.collect()}
    assert 5 not in rows and rows[2] == (4.0, 4.0, 4.0, 4.0, 4.0)
    # The event of noon came within a day of the latest one seen; that of one o'clock came when its day had been written.
    assert rows[1] == (5.0, 7.0, 5.0, 6.0, 18.0)


def test_sessions_that_are_over(spark, tmp_path):
    path = str(tmp_path / "events")
    put(spark, path, [(1, at(1, 9), 1, "A", 1.0), (2, at(1, 9).replace(minute=20), 1, "A", 2.0), (3, at(1, 12), 1, "A", 4.0)])
    put(spark, path, [(4, at(5, 9), 2, "A", 9.0)])
    put(spark, path, [(5, at(5, 9), 3, "A", 9.0)])
    got = B.drain(B.user_sessions(stream(spark, path)), "append", shared_folder(spark))
    assert sorted((r.user_id, r.n_events, r.value) for r in got.collect()) == [(1, 1, 4.0), (1, 2, 3.0)]


def test_rolling_telemetry_over_batches_and_a_restart(spark, tmp_path):
    from quaymark.streaming import telemetry

    telemetry.use_rocksdb(spark)
    events = spark.range(400).selectExpr("id as event_id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(pmod(id * 37, 400) as int)) as ts", "if(id % 3 = 0, 'a', 'b') as event_type", "double(id % 70) as value")
    odd = spark.sql("select cast(null as bigint) as event_id, timestamp'2024-01-01' as ts, 'a' as event_type, 1.0D as value")

    def some(low, high):
        events.where(f"event_id >= {low} and event_id < {high}").unionByName(odd).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        query = telemetry.rolling(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    for low in (0, 100, 200):
        some(low, low + 100)
    run()
    some(300, 400)
    run()
    told = spark.read.schema(telemetry.SCHEMA).parquet(f"{tmp_path}/out")
    assert told.where("kind = 'a'").count() == 4
    rows = events.collect()
    for r in telemetry.latest(told).collect():
        last = sorted(((x.ts, x.event_id, x.value) for x in rows if x.event_type == r.kind), reverse=True)
        assert r.seen == len(last) and r.requests == 50
        values = [v for _, _, v in last[:50]]
        assert (r.mean_value, r.max_value, r.slow_recent) == (round(sum(values) / 50, 4), max(values), sum(v > 50 for v in values[:20]))
