"""Readers and writers of the file formats that evidence comes in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.functions.scalars import flexible_date
from quaymark.session import stored

PRICE_SCHEMA = "ticker string, date string, open double, high double, low double, close double, volume double"
ARTICLE_SCHEMA = "HEADLINE string, SUBHEAD string, INTRO string, TEXT string, PUBLICATIONDATE string"


def rates_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rate decisions (effective, target_bp, change_bp) of a CSV with a header, which a byte-order mark may precede; rows without a date go."""
    raw = spark.read.option("header", True).csv(path).toDF("date", "change", "target")
    bp = lambda c: F.round(F.col(c).cast("decimal(9,4)") * 100).cast("int")
    rows = raw.where(F.trim(F.coalesce("date", F.lit(""))) != "")
    return rows.select(flexible_date(F.col("date")).alias("effective"), bp("target").alias("target_bp"), bp("change").alias("change_bp")).orderBy("effective")


def prices_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Bars of all files of a folder; the ticker is the record's, company the file name's second part. A missing field or date fails the read."""
    raw = spark.read.schema(PRICE_SCHEMA).option("mode", "FAILFAST").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^[^-]*-(.*)\.jsonl?$", 1)
    day = flexible_date(F.col("date"))
    whole = day.isNotNull()
    for c in ("ticker", "open", "high", "low", "close", "volume"):
        whole = whole & F.col(c).isNotNull()
    checked = F.when(whole, day).otherwise(F.raise_error(F.concat(F.lit("incomplete price record: "), F.to_json(F.struct("ticker", "date")))).cast("date"))
    return raw.select("ticker", checked.alias("day"), "open", "high", "low", "close", "volume", F.lower(F.regexp_replace(stem, "[-_]", " ")).alias("company"))


def articles_jsonl(spark: SparkSession, path: str, include: str = "*.jsonl") -> DataFrame:
    """Articles of the files whose name fits; missing texts are empty, dates that can't be read null."""
    raw = spark.read.schema(ARTICLE_SCHEMA).option("pathGlobFilter", include).json(path)
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    blob = F.lower(F.concat_ws("\n", *[part(c) for c in ("HEADLINE", "SUBHEAD", "INTRO", "TEXT")]))
    return raw.select(F.xxhash64("HEADLINE", "SUBHEAD", "INTRO", "TEXT", "PUBLICATIONDATE").alias("article_id"), part("HEADLINE").alias("headline"), blob.alias("blob"), flexible_date(F.col("PUBLICATIONDATE")).alias("publication"))


def reconcile(loaded: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Rows by key that were loaded, those that a summary (key, rows) expects, and whether they agree; a mismatch is told, not raised."""
    have = loaded.groupBy(key).agg(F.count("*").alias("loaded"))
    both = expected.join(have, key, "full")
    return both.select(key, F.coalesce("loaded", F.lit(0)).alias("loaded"), F.coalesce("rows", F.lit(0)).alias("expected"), (F.coalesce("loaded", F.lit(0)) == F.coalesce("rows", F.lit(0))).alias("agrees"))


def corpus_summary(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows) of a corpus summary with perFile entries of file and articles."""
    return spark.read.option("multiLine", True).json(path).select(F.inline("perFile")).select("file", F.col("articles").alias("rows"))


def questions_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Question components (id, difficulty, dataset_scope, component_id, expected_fact, points, tolerance_note)."""
    raw = spark.read.json(path)
    return raw.select("id", "difficulty", "dataset_scope", F.col("grading.tolerance_note").alias("tolerance_note"), F.explode("grading.components").alias("c")).select("id", "difficulty", "dataset_scope", "tolerance_note", "c.component_id", "c.expected_fact", F.col("c.points").cast("double").alias("points"))


def frozen_evidence(spark: SparkSession, folder: str, condition: str = "clean") -> DataFrame:
    """One row for each evidence file of a condition: qid, prompt and its trace of (tool, args, result)."""
    trace = "array<struct<tool:string,args:map<string,string>,result:string,compact:string,ok:boolean>>"
    return spark.read.schema(f"qid string, prompt string, difficulty string, tool_trace {trace}").option("multiLine", True).option("pathGlobFilter", f"*.{condition}.json").json(folder)


def write_chat(examples: DataFrame, path: str) -> None:
    """One JSON record a line: messages of role and content; letters stay as they are."""
    messages = F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("content")) for role, c in (("system", "system"), ("user", "question"), ("assistant", "answer"))])
    examples.select(messages.alias("messages")).write.mode("errorifexists").json(path)


def write_flat(examples: DataFrame, path: str) -> None:
    examples.select("system", F.col("question").alias("input"), F.col("answer").alias("output")).write.mode("errorifexists").json(path)


def computed(wanted: DataFrame, cache: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Get or compute: all wanted keys with their values, and the new rows to add to the cache. Only keys that the cache lacks are computed, once: what was computed is a table of the shared folder. Of several rows of a key the greatest, by columns in order, counts."""
    misses = wanted.select(key).distinct().join(cache.select(key), key, "left_anti")
    fresh = stored(compute(misses), "computed")
    rest = [c for c in cache.columns if c != key]
    known = cache.unionByName(fresh).groupBy(key).agg(F.max(F.struct(*rest)).alias("row")).select(key, *[F.col("row")[c].alias(c) for c in rest])
    return wanted.join(known, key), fresh


def lookup(wanted: DataFrame, records: DataFrame, key: str, record_key: str) -> tuple[DataFrame, DataFrame]:
    """The wanted rows with their records, and the distinct keys that have none."""
    found = wanted.join(records.withColumnRenamed(record_key, key) if record_key != key else records, key)
    missing = wanted.select(key).distinct().join(records.select(F.col(record_key).alias(key)), key, "left_anti")
    return found, missing


def write_report(cells: DataFrame, path: str, title: str) -> None:
    """A report of a few cells (a row an arm and condition): a folder with JSON records, and one with a markdown table."""
    cells.coalesce(1).write.mode("errorifexists").json(f"{path}/json")
    names = cells.columns
    row = lambda texts: F.concat(F.lit("| "), F.concat_ws(" | ", *texts), F.lit(" |"))
    head = cells.sparkSession.createDataFrame([(0, f"# {title}"), (1, ""), (2, "| " + " | ".join(names) + " |"), (3, "|" + "---|" * len(names))], "n int, value string")
    body = cells.select(F.lit(4).alias("n"), row([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]).alias("value"))
    head.union(body).coalesce(1).sortWithinPartitions("n", "value").select("value").write.mode("errorifexists").text(f"{path}/markdown")
