"""The corpus pipeline: language identification, line dedup, near duplicates, decontamination, encoding.

Every stage reads all that the one before it kept; run() writes each one's rows as Parquet to the shared folder and
reads them again, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm import bpe, chosenpath, decontaminate, langid, linededup
from quaymark.llm.common import discard, fresh, read, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those that the nearest centroid rejects go."""
    return langid.keep_known(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated passages; a document of which no word is left goes. n_chars follows the text."""
    removed = fresh(docs, "n_lines", "n_removed")[1]
    found = linededup.dedupe(docs)
    kept = found.where((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    return kept.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id."""
    return chosenpath.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the texts that are left (little-endian unsigned 32-bit integers), and the hash of the text that they decode to. Other columns of the documents end here."""
    decoded = bpe.round_trip(docs)
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Learned centroids and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        kept = written(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = kept
    return docs
