"""Rolling telemetry of a stream: what the last requests of each kind were like, kept as state between batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: How many requests are kept of each kind, over how many of them slow ones are counted, and from which value one is slow.
KEPT, RECENT, SLOW = 50, 20, 50.0
#: A kind of which nothing comes until the stream's time is so much later is forgotten.
FORGET_MS = 30 * 24 * 3600 * 1000

SCHEMA = "kind string, seen bigint, requests bigint, mean_value double, max_value double, slow_recent bigint"
_RING = "at array<bigint>, id array<bigint>, value array<double>, seen bigint"


class Rolling(StatefulProcessor):
    """Keeps the last KEPT requests of a kind, by time and id, and tells of them after each batch that had some. The order in which files come doesn't matter."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.ring = handle, handle.getValueState("ring", _RING)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, ids, values, seen = self.ring.get() if self.ring.exists() else ([], [], [], 0)
        held = list(zip(at, ids, values, strict=True))
        for batch in rows:
            seen += len(batch)
            held += zip(batch["at"].tolist(), batch["event_id"].tolist(), batch["value"].tolist(), strict=True)
            held = sorted(held, reverse=True)[:KEPT]
        self.ring.update(tuple(list(x) for x in zip(*held, strict=True)) + (seen,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[0][0] // 1000 + FORGET_MS)
        values = [v for _, _, v in held]
        yield pd.DataFrame({"kind": [key[0]], "seen": [seen], "requests": [len(held)], "mean_value": [round(sum(values) / len(values), 4)], "max_value": [round(max(values), 4)], "slow_recent": [sum(v > SLOW for v in values[:RECENT])]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        yield pd.DataFrame({c.split()[0]: [] for c in SCHEMA.split(", ")}).astype({"seen": "int64", "requests": "int64", "slow_recent": "int64", "kind": "str"})

    def close(self) -> None:
        pass


def rolling(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """(kind, seen, requests, mean_value, max_value, slow_recent): a row for each kind and batch, in append mode, from events with event_id, ts, event_type, value. Events without a time, an id or a value are left out."""
    given = stream.where("ts is not null and event_id is not null and value is not null").withWatermark("ts", late).selectExpr("ts", "event_type as kind", "unix_micros(ts) as at", "cast(event_id as bigint) as event_id", "cast(value as double) as value")
    return given.groupBy("kind").transformWithStateInPandas(Rolling(), SCHEMA, "Append", "EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    """State of this kind needs a store with column families; sessions that have one already keep it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest(told: DataFrame) -> DataFrame:
    """Of each kind what was told last."""
    return told.groupBy("kind").agg({"seen": "max"}).withColumnRenamed("max(seen)", "seen").join(told, ["kind", "seen"]).distinct()
