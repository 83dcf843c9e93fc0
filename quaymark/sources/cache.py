"""A cache of computed rows by key that is kept: appended files, a log of what is valid, and one writer that wins.

The folder holds data/<name>/bucket=b files, whose keys have Parquet's Bloom filters, and log/<n>, a text file a version that
lists the data folders that are valid. A version is made by creating its log file, which fails if another writer was first; the
loser reads the log again and adds to that. Of several rows of a key the earliest added counts. Data that no version names, of a
writer that was lost, is never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32
#: So few wanted keys are named in the scan, where Bloom filters and minima can leave files out; more are joined.
NAMED_KEYS = 1000
ATTEMPTS = 20


class Cache:
    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS):
        """schema of the rows that are kept, as DDL; key is one of their columns."""
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, added bigint, bucket int"

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> tuple[int, list[str]]:
        """The last version and its data folders; version 0 has none."""
        path, fs = self._path("log")
        numbers = [int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit()] if fs.exists(path) else []
        if not numbers:
            return 0, []
        lines = self.spark.read.text(f"{self.folder}/log/{max(numbers):09d}").collect()  # a line a folder; compact() keeps them few
        return max(numbers), [r.value for r in lines if r.value]

    def _commit(self, number: int, folders: list[str]) -> bool:
        """Whether this writer made the version."""
        path, fs = self._path(f"log/{number:09d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            if fs.exists(path):
                return False
            raise e
        out.write(bytearray("\n".join(folders).encode()))
        out.close()
        return True

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self, folders: list[str]) -> DataFrame:
        each = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{x}") for x in folders]
        return reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, added) -> str:
        name = uuid.uuid4().hex
        dealt = rows.select(*self.columns, added.cast("bigint").alias("added"), self._bucket().alias("bucket")).repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.option(f"parquet.bloom.filter.enabled#{self.key}", "true").partitionBy("bucket").parquet(f"{self.folder}/data/{name}")
        return name

    def _first(self, rows: DataFrame) -> DataFrame:
        """A row a key: the earliest added, and of these the least."""
        rest = ["added", *[c for c in self.columns if c != self.key]]
        return rows.groupBy(self.key).agg(F.min(F.struct(*rest)).alias("row")).select(self.key, *[F.col("row")[c].alias(c) for c in rest])

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows that are kept of the keys, once each, with the version that added them. Null keys are never kept."""
        return self._get(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct(), self.version()[1])

    def _get(self, keys: DataFrame, folders: list[str]) -> DataFrame:
        rows, few = self._rows(folders), keys.limit(NAMED_KEYS + 1).collect()
        if len(few) <= NAMED_KEYS:
            rows = rows.where(F.col(self.key).isin([r[0] for r in few])) if few else rows.limit(0)
            buckets = [r[0] for r in keys.select(self._bucket()).distinct().collect()] if few else []  # NAMED_KEYS at most
            return self._first(rows.where(F.col("bucket").isin(buckets)) if buckets else rows)
        return self._first(rows.join(keys.withColumn("bucket", self._bucket()), ["bucket", self.key], "left_semi"))

    def get_or_compute(self, keys: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A row a key: what is kept, and what compute makes of the keys that aren't, which is kept before it is returned. compute isn't called where nothing is lacking."""
        wanted = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        number, folders = self.version()
        lacking = wanted.join(self._get(wanted, folders).select(self.key), self.key, "left_anti")
        if not lacking.isEmpty():
            name = self._write(compute(lacking).join(lacking, self.key, "left_semi"), F.lit(number + 1))
            for _ in range(ATTEMPTS):
                if self._commit(number + 1, [*folders, name]):
                    break
                number, folders = self.version()  # another writer was first; keys that both computed count as that one's
            else:
                raise RuntimeError(f"no version of {self.folder} could be made in {ATTEMPTS} attempts")
        return self.get(wanted)

    def compact(self) -> bool:
        """One data folder with a row a key instead of all; False if another writer was first, and nothing is changed then."""
        number, folders = self.version()
        if len(folders) < 2:
            return False
        first = self._first(self._rows(folders))
        return self._commit(number + 1, [self._write(first, F.col("added"))])
