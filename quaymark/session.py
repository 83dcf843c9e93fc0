"""One place that says how a session is built when the caller brings none, and where its shared tables go."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


def build(app: str = "quaymark", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE and UTC dates. What spark-submit or a running session has set wins over what isn't asked for here."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = {**conf, **({"spark.master": master} if master else {}), **({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {})}
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    # Without spark-submit this process starts its own JVM: then it is a local one.
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or SparkSession.getActiveSession() is not None
    if not submitted:
        settings |= {"spark.master": f"local[{cpus}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus}
    given = SparkConf() if submitted else SparkConf(loadDefaults=False)
    builder = SparkSession.builder.appName(app)
    for key, value in {**{k: v for k, v in settings.items() if not given.contains(k)}, **wanted}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_OWN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets one of its own, made once; a cluster's executors have no folder in common then, so that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        there = _OWN[spark.sparkContext] = f"file://{tempfile.mkdtemp(prefix='spark-quaymark-')}"
    return there.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table of the shared folder: what a plan draws once stays as drawn."""
    path = f"{shared_folder(df.sparkSession)}/quaymark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
