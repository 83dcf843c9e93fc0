"""A bounded sample of labelled texts, for operators that learn from document labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import shingle_hashes, sliced, small_batches, word_hashes


def held_out(id_col: str, fold: int, held: int):
    """Whether crc32(id as text) mod fold is held; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, held: int, fit_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, y): about fit_docs texts at most, picked by hash, whose id isn't null or held out. Of near copies, found by the least hash of their word 5-grams, one stays; ids with labels at odds count as 1."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label).alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull() & (F.crc32(F.col("id").cast("string")) % fold != held)).groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, fit_docs / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("id", F.lit(label)), F.lit(1_000_000)) < share * 1_000_000)
    if picked.count() <= 2 * fit_docs:  # as it is unless hashes conspire; beyond it, a shuffle
        picked = F.broadcast(picked)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(picked, "id")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            grams = [shingle_hashes(word_hashes(t)) for t in batch.column(1).to_pylist()]
            keys = [int(g[0]) >> 1 if len(g) else -1 for g in grams]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "key"])

    kind = rows.schema["id"].dataType.simpleString()
    wide = rows.select("id", "text", F.col("y").cast("int").alias("y")).mapInArrow(keyed, f"id {kind}, text string, y int, key bigint")
    return wide.groupBy("key", "y").agg(F.min(F.struct("id", "text")).alias("one")).select("one.id", "one.text", "y")
