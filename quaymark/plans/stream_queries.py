"""The streaming operators, run to the end of a table's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymark.plans.catalogue import register
from quaymark.session import shared_folder
from quaymark.sources import views as V
from quaymark.streaming import bars as B
from quaymark.streaming import telemetry


def _stream(s, d):
    return B.events(s, f"{d}/events.parquet" if V.is_folder(s, f"{d}/events.parquet") else f"{d}/events*.parquet")


register("stream_daily_bars", V.with_(V.BARS_INTRADAY) + "SELECT ticker, day, open, high, low, close, volume FROM bars_intraday")(lambda s, d: B.drain(B.daily_bars(_stream(s, d)), "complete", shared_folder(s)))
register("stream_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS begin, count(*) AS n_events, round(sum(value), 4) AS value FROM r GROUP BY user_id, run""")(lambda s, d: B.drain(B.user_sessions(_stream(s, d)), "complete", shared_folder(s)).withColumn("begin", F.col("begin").cast("timestamp_ntz")))
register("stream_asof_rate", V.with_(V.DECISIONS) + "SELECT event_id, effective, target_bp FROM events ASOF LEFT JOIN decisions ON CAST(ts AS DATE) >= effective")(lambda s, d: B.drain(B.with_rate(_stream(s, d), V.decisions(s, d)), "append", shared_folder(s)))


def _rolling(s, d):
    """Events may come in any order of time: none is taken for late."""
    telemetry.use_rocksdb(s)
    return telemetry.latest(B.drain(telemetry.rolling(_stream(s, d), late="36500 days"), "append", shared_folder(s)))


register("stream_rolling", """WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth, count(*) OVER (PARTITION BY event_type) AS seen FROM events)
SELECT event_type AS kind, any_value(seen) AS seen, count(*) AS requests, round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value, count(*) FILTER (nth <= 20 AND value > 50) AS slow_recent FROM l WHERE nth <= 50 GROUP BY 1""")(_rolling)
