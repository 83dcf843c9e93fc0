"""The file formats, each written from the tables to the shared folder and read back, and the query surface."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.api import Engine
from quaymark.plans.catalogue import register
from quaymark.session import shared_folder
from quaymark.sources import evidence, files, metrics
from quaymark.sources import views as V
from quaymark.sources.cache import Cache


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quaymark/{name}-{uuid.uuid4().hex}"


def _rates(s, d):
    """Decisions as a CSV of points and percent, with days in words."""
    path, points = _place(s, "rates"), lambda c: F.format_string("%.2f", F.col(c) / 100)
    V.decisions(s, d).select(F.date_format("effective", "d MMM yyyy").alias("Effective Date"), points("change_bp").alias("Change % points"), points("target_bp").alias("Cash rate target%")).write.option("header", True).csv(path)
    return files.rates_csv(s, path)


register("rates_csv_scan", V.with_(V.DECISIONS) + "SELECT effective, target_bp, change_bp FROM decisions")(_rates)


def _prices(s, d):
    path = _place(s, "prices")
    V.bars(s, d).select("ticker", F.date_format("day", "yyyy-MM-dd").alias("date"), "open", "high", "low", "close", "volume").write.json(path)
    return files.prices_jsonl(s, path).drop("company")


register("prices_jsonl_scan", V.with_(V.BARS) + "SELECT * FROM bars")(_prices)


def _articles(s, d):
    """Documents as article records: a headline and the whole text, every 97th without a date; the blob comes back as its hash."""
    path, text = _place(s, "articles"), F.coalesce("text", F.lit(""))
    day = F.coalesce(F.date_format(V.publication(F.col("doc_id")), "yyyyMMdd"), F.lit(""))
    V.table(s, d, "documents").select(F.col("doc_id").cast("string").alias("SUBHEAD"), F.element_at(F.split(text, "\n", -1), 1).alias("HEADLINE"), text.alias("TEXT"), day.alias("PUBLICATIONDATE")).write.json(path)
    return files.articles_jsonl(s, path, "*.json").select(F.sha2("headline", 256).alias("headline_sha256"), F.sha2("blob", 256).alias("blob_sha256"), "publication")


register("articles_jsonl_scan", V.with_(V.ARTICLES) + "SELECT sha256(headline) AS headline_sha256, sha256(lower(headline) || chr(10) || article_id || chr(10) || chr(10) || blob) AS blob_sha256, publication FROM articles")(_articles)


def _questions(s, d):
    """Twelve items or fewer to a question, each a component with its points."""
    path = _place(s, "questions")
    part = F.struct(F.concat(F.lit("c"), F.col("item_id")).alias("component_id"), F.concat(F.lit("fact "), F.col("item_id")).alias("expected_fact"), (F.col("item_id") % 5 / 2).alias("points"))
    rows = V.table(s, d, "benchmark").select("item_id", F.floor(F.col("item_id") / 12).alias("q"), part.alias("part")).groupBy("q").agg(F.collect_list("part").alias("components"))
    record = rows.select(F.concat(F.lit("Q"), F.col("q")).alias("id"), F.when(F.col("q") % 2 == 0, "easy").otherwise("hard").alias("difficulty"), F.lit("cross").alias("dataset_scope"), F.struct(F.lit("exact").alias("tolerance_note"), "components").alias("grading"))
    record.write.json(path)
    return files.questions_jsonl(s, path)


register("questions_jsonl_scan", "SELECT 'Q' || (item_id // 12) AS id, CASE WHEN (item_id // 12) % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty, 'cross' AS dataset_scope, 'exact' AS tolerance_note, 'c' || item_id AS component_id, 'fact ' || item_id AS expected_fact, (item_id % 5) / 2.0::DOUBLE AS points FROM benchmark")(_questions)


def _written_examples(s, d) -> DataFrame:
    return V.examples(s, d).select(F.lit("Answer from the evidence.").alias("system"), "question", "answer")


def _chat(s, d):
    path = _place(s, "chat")
    files.write_chat(_written_examples(s, d), path)
    turn = s.read.schema("messages array<struct<role:string,content:string>>").json(path).select(F.posexplode("messages").alias("place", "m"))
    return turn.select("place", "m.role", F.sha2("m.content", 256).alias("content_sha256"))


register("chat_roundtrip", V.with_(V.EXAMPLES) + "SELECT 0 AS place, 'system' AS role, sha256('Answer from the evidence.') AS content_sha256 FROM examples UNION ALL SELECT 1, 'user', sha256(question) FROM examples UNION ALL SELECT 2, 'assistant', sha256(answer) FROM examples")(_chat)


def _flat(s, d):
    path = _place(s, "flat")
    files.write_flat(_written_examples(s, d), path)
    return s.read.schema("system string, input string, output string").json(path).select("system", F.sha2("input", 256).alias("input_sha256"), F.sha2("output", 256).alias("output_sha256"))


register("flat_roundtrip", V.with_(V.EXAMPLES) + "SELECT 'Answer from the evidence.' AS system, sha256(question) AS input_sha256, sha256(answer) AS output_sha256 FROM examples")(_flat)


def _report(s, d):
    """Items and points of each arm as a report; the lines of its markdown."""
    path = _place(s, "report")
    cells = V.arms(s, d).groupBy("arm").agg(F.count("*").alias("items"), F.sum("points").alias("points"))
    files.write_report(cells, path, "Arms")
    return s.read.text(f"{path}/markdown").where("value <> ''")


register("report_markdown", V.with_(V.ARMS) + "SELECT '# Arms' AS value UNION ALL SELECT '| arm | items | points |' UNION ALL SELECT '|---|---|---|' UNION ALL SELECT '| ' || arm || ' | ' || count(*) || ' | ' || CAST(sum(points) AS BIGINT) || ' |' FROM arms GROUP BY arm")(_report)


def _cached(s, d):
    """Word counts of all documents, of which the labelled ones of good quality are in a cache already, as -1."""
    docs, labels = V.table(s, d, "documents"), V.table(s, d, "labels")
    cache = labels.where("quality = 1").select("doc_id").distinct().withColumn("words", F.lit(-1).cast("bigint"))
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("bigint")
    got, fresh = files.computed(docs.select("doc_id"), cache, "doc_id", lambda keys: docs.join(keys, "doc_id").select("doc_id", count.alias("words")))
    return got.join(fresh.select("doc_id", F.lit(True).alias("is_new")), "doc_id", "left").select("doc_id", "words", F.coalesce("is_new", F.lit(False)).alias("is_new"))


register("get_or_compute", r"WITH c AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT doc_id, CASE WHEN c.doc_id IS NULL THEN len(regexp_extract_all(coalesce(text, ''), '\S+')) ELSE -1 END AS words, c.doc_id IS NULL AS is_new FROM documents LEFT JOIN c USING (doc_id)")(_cached)

_D = V.with_(V.DECISIONS)
register("surface_query_data", _D + "SELECT count(*) AS records FROM decisions WHERE effective BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")(lambda s, d: Engine(s, d).frame("decisions", "count", start="1996", end="Jun 1997")[0])
register("surface_execute", V.with_(V.BARS) + "SELECT true AS ok, count(DISTINCT ticker) AS tickers FROM bars WHERE ticker <> '5-LOW' UNION ALL SELECT false, 0")(
    # A metric's own name finds its dataset; a name that nobody has is told, not raised.
    lambda s, d: (lambda e: s.createDataFrame([(ok, len(told.get("rows", []))) for told, ok in (e.execute("basket_tickers", {}), e.execute("no_such_metric", {}))], "ok boolean, tickers bigint"))(Engine(s, d))
)


def _kept(s, d):
    """Words of documents through a cache that is kept: first those that are labelled, then all, then all again, which computes nothing."""
    docs = V.table(s, d, "documents")
    cache = Cache(s, f"{shared_folder(s)}/quaymark/cache-{uuid.uuid4().hex}", "doc_id bigint, words bigint", "doc_id")
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\S+")).cast("bigint")
    words = lambda keys: docs.join(keys, "doc_id").select("doc_id", count.alias("words"))
    cache.get_or_compute(docs.join(V.table(s, d, "labels"), "doc_id", "left_semi"), words)
    cache.get_or_compute(docs, words)
    cache.compact()
    return cache.get_or_compute(docs, lambda keys: keys.select("doc_id", F.raise_error(F.lit("nothing is lacking")).cast("bigint").alias("words")))


register("kept_cache", r"SELECT doc_id, max(len(regexp_extract_all(coalesce(text, ''), '\S+'))) AS words, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 2 END AS added FROM documents GROUP BY doc_id")(_kept)


def _evidence_folders(s, d):
    """Bars as a folder of JSON lines for each ticker, of which two are read back, a broken line among them."""
    path = f"{shared_folder(s)}/quaymark/evidence-{uuid.uuid4().hex}"
    bars = V.bars(s, d).select(F.col("ticker").alias("name"), F.to_json(F.struct("ticker", "day", "volume")).alias("value"))
    broken = bars.select("name").distinct().withColumn("value", F.lit('{"ticker": '))
    bars.unionByName(broken).write.partitionBy("name").text(path)
    evidence.register(s)
    found = s.read.format("evidence").option("path", path).option("include", "*.txt").load().where(F.col("folder").isin("name=1-URGENT", "name=5-LOW"))
    return found.groupBy("folder").agg(F.count("record").alias("records"), F.count("error").alias("broken"), F.round(F.sum(F.get_json_object("record", "$.volume").cast("double")), 2).alias("volume"))


register("evidence_two_folders", V.with_(V.BARS) + "SELECT 'name=' || ticker AS folder, count(*) AS records, 1 AS broken, round(sum(volume), 2) AS volume FROM bars WHERE ticker IN ('1-URGENT', '5-LOW') GROUP BY ticker")(_evidence_folders)


def _asked(text):
    """A question in SQL, over the table functions of this folder."""

    def query(s, d):
        metrics.register(s, d)
        return s.sql(text)

    return query


register("sql_rates_count", _D + "SELECT count(*) AS records FROM decisions WHERE effective >= DATE '1997-01-01'")(_asked("SELECT * FROM rates_count(start => '1997')"))
register("sql_changes_lateral", V.with_(V.DECISIONS, V.BARS) + """, y AS (SELECT DISTINCT year(day) AS year FROM bars)
SELECT y.year, count(effective) AS records, count(*) FILTER (change_bp > 0) AS increases, count(*) FILTER (change_bp < 0) AS decreases, round(coalesce(sum(change_bp), 0) / 100.0, 2) AS net_points FROM y LEFT JOIN decisions ON effective BETWEEN make_date(y.year, 7, 1) AND make_date(y.year + 1, 6, 30) GROUP BY y.year""")(
    # Each year of the bars, as the twelve months from July: windows from a table.
    _asked("SELECT y.year, records, increases, decreases, net_points FROM (SELECT DISTINCT year(day) AS year FROM quaymark_bars) y, LATERAL rates_count_changes(y.year || '-07', (y.year + 1) || '-06')")
)
register("sql_window_return", V.with_(V.BARS) + """, w AS (SELECT ticker, arg_max(close, day) FILTER (day <= DATE '1996-01-01') AS a, max(day) FILTER (day <= DATE '1996-01-01') AS start_day, arg_max(close, day) AS b, max(day) AS end_day FROM bars WHERE day <= DATE '1998-06-30' AND ticker <> '5-LOW' GROUP BY ticker)
SELECT ticker, start_day, end_day, round((b / a - 1) * 100, 4) AS return_pct FROM w WHERE a IS NOT NULL""")(_asked("SELECT * FROM prices_window_return('1996', 'Jun 1998', exclude => array('5-LOW'))"))
register("sql_text_by_year", V.with_(V.ARTICLES) + r""", y AS (SELECT year(publication) AS year, count(*) AS matches FROM articles WHERE publication IS NOT NULL AND regexp_matches(blob, '(^|[^\p{L}\p{N}_])(the|und)([^\p{L}\p{N}_]|$)') GROUP BY 1)
SELECT year, matches, row_number() OVER (ORDER BY matches DESC, year) = 1 AS peak FROM y""")(_asked("SELECT * FROM text_count_by_year(terms => array('The', 'und'))"))
