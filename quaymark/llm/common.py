"""What several corpus operators share: reading, scratch tables on the shared folder, word and shingle hashes."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: ASCII that is neither digit nor letter. Letters A-Z are lower-cased first; every other byte is part of a word.
_BREAK = np.ones(256, dtype=bool)
_BREAK[0x30:0x3A] = False
_BREAK[0x61:0x7B] = False
_BREAK[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


#: Rows that go to a Python worker at once. Whole texts are long: at Spark's default of 10,000 a batch takes tens of MB, several times, in each of an executor's tasks.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Have this session's Arrow batches hold BATCH_ROWS rows at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets one of its own, made once; a cluster's executors have no folder in common then, so that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        there = _OWN[spark.sparkContext] = f"file://{tempfile.mkdtemp(prefix='spark-quaymark-')}"
    return there.rstrip("/")


_OWN: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_PLACES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it back: lineage ends here, and what a plan draws once stays as drawn."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/quaymark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PLACES[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, once all that was derived from them is itself written."""
    for table in tables:
        place = _PLACES.pop(table, None)
        if place:
            spark = table.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than one of so many parts of all rows is hot; there are fewer hot keys than parts.
HOT_PARTS = 1000


def joined(rows: DataFrame, side: DataFrame, keys: list[str], times: str) -> DataFrame:
    """The inner join of rows with a side that has each key once, with its number of rows in the column times (which goes). Hot keys, fewer than HOT_PARTS, meet by broadcast, where rows stay where they are; the others are shuffled. Both frames are read twice, so they had better be tables."""
    total = side.agg(F.sum(times)).first()[0] or 0
    hot = F.col(times) * HOT_PARTS > F.lit(total)
    few, rest = side.where(hot & (F.col(times) > 1)).drop(times), side.where(~(hot & (F.col(times) > 1))).drop(times)
    cold = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(rest.hint("merge"), keys)
    return rows.join(F.broadcast(few), keys).unionByName(cold)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def outputs(id_col: str, *names: str) -> list[str]:
    """Names of output columns: those given, with an underscore where the id's column has that name."""
    return [n + "_" if n.lower() == id_col.lower() else n for n in names]


#: Bytes that a slice of a batch takes, unless it is a single row.
SLICE_BYTES = 32 << 20


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows and bytes, so that what a task makes of one stays small whatever the session's batch size."""
    for batch in batches:
        if batch.nbytes <= SLICE_BYTES:
            cuts = range(0, batch.num_rows, rows)
        else:
            size = np.zeros(batch.num_rows, dtype=np.int64)
            for column in batch.columns:
                if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                    size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            cuts, held = [], SLICE_BYTES + 1
            for k, n in enumerate(size.tolist()):
                if held + n > SLICE_BYTES or k - cuts[-1] >= rows:
                    cuts.append(k)
                    held = 0
                held += n
        ends = [*cuts[1:], batch.num_rows]
        for a, b in zip(cuts, ends, strict=True):
            yield batch.slice(a, b - a)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), _BASE, dtype=np.uint64)]), dtype=np.uint64)
    return _POWERS


_POWERS = np.ones(1, dtype=np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, in order; null and wordless texts have none."""
    if not text:
        return np.empty(0, dtype=np.uint64)
    raw = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = np.empty(len(raw) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_BREAK[raw], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    kept = inside[1:-1]
    lengths = ends - starts
    firsts = np.zeros(len(starts), dtype=np.int64)
    np.cumsum(lengths[:-1], out=firsts[1:])
    chars = raw[kept].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(chars)) - np.repeat(firsts, lengths)
    return mixed(np.add.reduceat(chars * _powers(int(lengths.max()) + 1)[place], firsts) + lengths.astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; a text of fewer words, but not none, is one run."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    run = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        run = run * _BASE + words[i : i + n]
    return np.unique(mixed(run + np.uint64(k)))
