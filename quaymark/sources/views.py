"""The canonical tables over which questions are asked, derived from the stored ones, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (ticker, day, open, high, low, close, volume), one row for each ticker and session."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("day"))
    return days.agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").cast("double").alias("volume"))


def bars_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same shape from the event stream's table."""
    at = F.struct("ts", "event_id")
    days = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("ticker"), F.col("ts").cast("date").alias("day"))
    return days.agg(F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.round(F.sum("value"), 4).alias("volume"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step function (effective, target_bp, change_bp) in whole basis points, one row a month."""
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("effective")
    level = table(spark, sf_dir, "orders").groupBy(month).agg((25 * F.floor(F.avg("o_totalprice") / 10000)).cast("int").alias("target_bp"))
    before = F.lag("target_bp").over(Window.orderBy("effective"))  # a row a month: a dimension
    return level.select("effective", "target_bp", F.coalesce(F.col("target_bp") - before, F.lit(0)).alias("change_bp"))


def publication(doc_id: Column) -> Column:
    """A date for each document; one in 97 is undated."""
    return F.when(doc_id % 97 != 7, F.date_add(F.lit("2015-01-01").cast("date"), ((doc_id * 37) % 2557).cast("int")))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(article_id, headline, blob, publication): blob is lower-cased, publication may be null."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), F.element_at(F.split(text, "\n", -1), 1).alias("headline"), F.lower(text).alias("blob"), publication(F.col("doc_id")).alias("publication"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training examples (example_id, category, gold_key, question, answer, tokens): documents stand in for generated ones."""
    text = F.coalesce("text", F.lit(""))
    gold = F.substring(F.sha1(F.concat_ws("|", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), (F.col("doc_id") % 50).cast("string"))), 1, 16)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("example_id"), F.coalesce("lang", F.lit("none")).alias("category"), gold.alias("gold_key"), F.element_at(F.split(text, "\n", -1), 1).alias("question"), text.alias("answer"),
        (F.regexp_count(F.lower(text), F.lit("[a-z0-9]+")) + 8).cast("bigint").alias("tokens"),
    )


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two arms (qid, arm, points) at component grain; integers, so that sums are exact."""
    item = table(spark, sf_dir, "benchmark").select("item_id")
    return item.select(F.col("item_id"), (F.col("item_id") % 12).alias("qid"), F.explode(F.array(F.struct(F.lit("base").alias("arm"), ((F.col("item_id") * 37 + 11) % 101).alias("points")), F.struct(F.lit("tuned").alias("arm"), ((F.col("item_id") * 53 + 29) % 101).alias("points")))).alias("x")).select("item_id", "qid", "x.arm", "x.points")


# The same in DuckDB, as common table expressions.
BARS = """bars AS (SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"""
BARS_INTRADAY = """bars_intraday AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 4) AS volume FROM events GROUP BY 1, 2)"""
DECISIONS = """decisions AS (SELECT effective, target_bp, coalesce(target_bp - lag(target_bp) OVER (ORDER BY effective), 0) AS change_bp FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS effective, CAST(25 * floor(avg(o_totalprice) / 10000) AS INTEGER) AS target_bp FROM orders GROUP BY 1))"""
ARTICLES = """articles AS (SELECT doc_id AS article_id, string_split(coalesce(text, ''), chr(10))[1] AS headline, lower(coalesce(text, '')) AS blob, CASE WHEN doc_id % 97 <> 7 THEN DATE '2015-01-01' + CAST((doc_id * 37) % 2557 AS INTEGER) END AS publication FROM documents)"""
EXAMPLES = """examples AS (SELECT doc_id AS example_id, coalesce(lang, 'none') AS category, substr(sha1(concat_ws('|', coalesce(lang, 'none'), coalesce(source, 'none'), CAST(doc_id % 50 AS VARCHAR))), 1, 16) AS gold_key, string_split(coalesce(text, ''), chr(10))[1] AS question, coalesce(text, '') AS answer, CAST(len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) + 8 AS BIGINT) AS tokens FROM documents)"""
ARMS = """arms AS (SELECT item_id, item_id % 12 AS qid, 'base' AS arm, (item_id * 37 + 11) % 101 AS points FROM benchmark UNION ALL SELECT item_id, item_id % 12, 'tuned', (item_id * 53 + 29) % 101 FROM benchmark)"""


# Signals of an answer in DuckDB, told by splitting and searching instead of the library's patterns.
_ANY = "len(list_filter([{}], lambda w: {})) > 0"


def _words(text: str) -> str:
    return ", ".join(f"'{w}'" for w in text.split("|"))


def hedged_sql(answer: str) -> str:
    """A digit in the 40 characters behind any place of a hedge."""
    hedges = _words("approximately|roughly|about|around|circa|some|nearly|almost|just over|just under|in the region of|or so|give or take|ballpark|estimated|close to|upwards of|north of|south of")
    return _ANY.format(hedges, f"len(list_filter(string_split(lower({answer}), w)[2:], lambda p: translate(substr(p, 1, 40), '0123456789', '') <> substr(p, 1, 40))) > 0")


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def leaked_sql(answer: str) -> str:
    """Phrases anywhere, and openings of lines."""
    phrases = _words("<think>|</think>|thinking process|let me think|let me check|let me work|let me see|i need to find|i need to check|i need to look|the user is asking|the user wants|based on the tool result i|based on the tool results i|based on the tool result, i|based on the tool results, i")
    opens = _words("step 0|step 1|step 2|step 3|step 4|step 5|step 6|step 7|step 8|step 9|first i|first, i|okay so|okay, so|hmm")
    lines = f"list_transform(string_split(lower({answer}), chr(10)), lambda l: ltrim(l, {_BLANKS}))"
    return f"({_ANY.format(phrases, f'contains(lower({answer}), w)')} OR len(list_filter({lines}, lambda l: {_ANY.format(opens, 'starts_with(l, w)')})) > 0)"


def misformatted_sql(answer: str) -> str:
    """Marks anywhere, numbered calls by what surrounds a closing bracket, objects by what surrounds a brace."""
    low = f"lower({answer})"
    marks = _words("domain_predict_mode|mock-fallback|tool_trace|query_data(|dataset_coverage(|```|verified tool results")
    after = f"len(list_filter([{_words('query_data|retrieve|dataset_coverage')}], lambda w: starts_with(ltrim(s[k + 1], {_BLANKS}), w) AND ltrim(s[k + 1], {_BLANKS}) <> s[k + 1])) > 0"
    number = "string_split(s[k], '[')[-1]"
    call = f"len(list_filter(list_transform([string_split({low}, ']')], lambda s: len(list_filter(range(1, len(s)), lambda k: contains(s[k], '[') AND {number} <> '' AND translate({number}, '0123456789', '') = '' AND {after}))), lambda n: n > 0)) > 0"
    blank = f"ltrim(string_split(s[k], chr(10))[-1], {_BLANKS}) = '' AND (k = 1 OR contains(s[k], chr(10)))"
    brace = f"len(list_filter(list_transform([string_split({low}, '{{')], lambda s: len(list_filter(range(1, len(s)), lambda k: {blank} AND substr(ltrim(s[k + 1], {_BLANKS}), 1, 1) IN (chr(34), chr(39))))), lambda n: n > 0)) > 0"
    return f"({_ANY.format(marks, f'contains({low}, w)')} OR {call} OR {brace})"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a table is a folder of files; asked of the path's own file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()
