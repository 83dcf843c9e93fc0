"""Text questions over the article corpus."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.operators import postings
from quaymark.operators import text as T
from quaymark.plans.catalogue import register
from quaymark.session import shared_folder
from quaymark.sources import views as V

TERMS = ["the", "la", "ai"]
WHOLE, PARTS = T.build_pattern(terms=TERMS), T.build_pattern(terms=TERMS, whole_word=False)
DAY = "2016-03-01"
_A = V.with_(V.ARTICLES)
_HIT = "regexp_matches(blob, '" + WHOLE + "')"
_PART = "regexp_matches(blob, '" + PARTS + "')"


def _share(where: str, corpus: str = "articles") -> str:
    return _A + f"SELECT count(*) FILTER ({where}) AS matches, count(*) AS total, round(100.0 * count(*) FILTER ({where}) / count(*), 4) AS share_pct FROM {corpus}"


register("articles", _A + "SELECT article_id, headline, sha256(blob) AS blob_sha256, publication FROM articles")(lambda s, d: V.articles(s, d).select("article_id", "headline", F.sha2("blob", 256).alias("blob_sha256"), "publication"))
register("text_coverage", _A + "SELECT count(*) AS total, count(publication) AS dated, count(*) - count(publication) AS undated, min(publication) AS first_day, max(publication) AS last_day FROM articles")(lambda s, d: T.coverage(V.articles(s, d)))
register("text_count", _share(f"{_HIT} AND coalesce(publication BETWEEN DATE '2016-01-01' AND DATE '2018-12-31', false)"))(lambda s, d: T.count(V.articles(s, d), WHOLE, start="2016-01-01", end="2018-12-31"))
register("text_terms_whole_word", _share(_HIT))(lambda s, d: T.count(V.articles(s, d), WHOLE))
register("text_terms_substring", _share(_PART))(lambda s, d: T.count(V.articles(s, d), PARTS))
register("text_count_month_any_year", _share(f"{_HIT} AND coalesce(month(publication) = 5, false)"))(lambda s, d: T.count(V.articles(s, d), WHOLE, month=5))
register("text_share", _share(_HIT, "(SELECT * FROM articles WHERE year(publication) = 2017)"))(lambda s, d: T.share(V.articles(s, d), WHOLE, 2017))
register("text_by_year", _A + f"SELECT *, row_number() OVER (ORDER BY matches DESC, year) = 1 AS peak FROM (SELECT year(publication) AS year, count(*) AS matches FROM articles WHERE publication IS NOT NULL AND {_HIT} GROUP BY 1)")(lambda s, d: T.by_year(V.articles(s, d), WHOLE))
register("text_by_month", _A + f"SELECT *, row_number() OVER (ORDER BY matches DESC, month DESC) = 1 AS peak FROM (SELECT strftime(publication, '%Y-%m') AS month, count(*) AS matches FROM articles WHERE publication IS NOT NULL AND {_HIT} GROUP BY 1)")(lambda s, d: T.by_month(V.articles(s, d), WHOLE))
#: Patterns as askers write them, in any case; ten, of every kind that the index tells apart.
PATTERNS = [r"interest rates?|cash rate|rate cut|rate hike|\bRBA\b", r"\bTHE\b", r"\bthe\b|\bLa\b", r"\bAND\b", "Data", r"\bQue\b|\bund\b", "th[a-z]+ing|ción", r"\bof the\b", "[0-9]{4}-[0-9]{2}", r"(?:AI|zebra)\b"]


def _index(s, d):
    """The kept index of a folder's articles."""
    source = postings.fingerprint(V.table(s, d, "documents"))
    return postings.kept(V.articles(s, d), f"{shared_folder(s)}/quaymark/text-index-{source}", source)


def _index_counts(s, d):
    index = _index(s, d)
    each = [index.count(T.build_pattern(p)).select(F.lit(k).alias("pattern"), "matches", "total", "share_pct") for k, p in enumerate(PATTERNS)]
    dated = index.count(T.build_pattern(PATTERNS[1]), start="2016", end="2018", month=5).select(F.lit(len(PATTERNS)).alias("pattern"), "matches", "total", "share_pct")
    return reduce(DataFrame.union, [*each, dated])


def _counted(k: int, pattern: str, where: str = "true") -> str:
    """The engine of the SQL knows only ASCII's words, so edges are spelled out."""
    spelled = re.sub(r"\\b(?=\w)", lambda _: f"(^|{T.EDGE})", pattern)
    spelled = re.sub(r"(?<=[\w)])\\b", lambda _: f"({T.EDGE}|$)", spelled)
    hit = f"regexp_matches(blob, '{spelled}', 'i') AND {where}"
    return f"SELECT {k} AS pattern, count(*) FILTER ({hit}) AS matches, count(*) AS total, round(100.0 * count(*) FILTER ({hit}) / count(*), 4) AS share_pct FROM articles"


register("text_index_patterns", _A + " UNION ALL ".join([*(_counted(k, p) for k, p in enumerate(PATTERNS)), _counted(len(PATTERNS), PATTERNS[1], "coalesce(year(publication) BETWEEN 2016 AND 2018 AND month(publication) = 5, false)")]))(_index_counts)
register("text_pattern_case", _share("regexp_matches(blob, 'interest rates?|cash rate|\\bTHE\\b', 'i')"))(lambda s, d: T.count(V.articles(s, d), T.build_pattern(r"interest rates?|cash rate|\bTHE\b")))
register("text_pattern_regex", _share("regexp_matches(blob, 'th[a-z]+ing|ci[óo]n')"))(lambda s, d: T.count(V.articles(s, d), T.build_pattern("th[a-z]+ing|ci[óo]n")))

_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
register("headline_exact", _A + f", w AS (SELECT text AS wanted, {_NORM.format('string_split(text, chr(10))[1]')} AS want FROM documents WHERE doc_id = 3) SELECT article_id, publication FROM articles, w WHERE {_NORM.format('headline')} = want")(
    lambda s, d: (lambda a: a.join(F.broadcast(a.where("article_id = 3").select(T.normalise_headline(F.col("headline")).alias("want"))), T.normalise_headline(F.col("headline")) == F.col("want")).select("article_id", "publication"))(V.articles(s, d))
)


def _asked(s, d):
    """Every headline on its own day, on a wrong day, and its first word on its day."""
    first = F.regexp_extract("headline", "^[A-Za-z]+", 0)
    asked = [F.struct(wanted.alias("wanted"), day.alias("day")) for wanted, day in ((F.col("headline"), F.col("publication")), (F.col("headline"), F.date_add("publication", 1)), (first, F.col("publication")))]
    return V.articles(s, d).where("publication is not null").select(F.inline(F.array(*asked))).where(T.normalise_headline(F.col("wanted")) != "").distinct()


register("headline_cascade", _A + f""", h AS (SELECT DISTINCT headline, publication FROM articles WHERE publication IS NOT NULL),
q AS (SELECT DISTINCT wanted, day, {_NORM.format('wanted')} AS want FROM (SELECT headline AS wanted, publication AS day FROM h UNION SELECT headline, publication + 1 FROM h UNION SELECT regexp_extract(headline, '^[A-Za-z]+'), publication FROM h WHERE regexp_extract(headline, '^[A-Za-z]+') <> '') WHERE {_NORM.format('wanted')} <> ''),
n AS (SELECT article_id, publication, {_NORM.format('headline')} AS norm FROM articles),
e AS (SELECT wanted, day, CASE WHEN publication IS NOT DISTINCT FROM day THEN 1 ELSE 2 END AS stage, article_id, publication FROM q JOIN n ON norm = want
 UNION SELECT wanted, day, 3, article_id, publication FROM q JOIN n ON publication = day AND contains(norm, want))
SELECT wanted, day, stage, article_id, publication FROM e QUALIFY stage = min(stage) OVER (PARTITION BY wanted, day)""")(lambda s, d: T.find_headline(V.articles(s, d), _asked(s, d)))


def _retrieve(where: str) -> str:
    return _A + f"SELECT article_id, publication, (SELECT count(*) FROM articles WHERE {where}) AS total, substr(blob, 1, 300) AS snippet, length(blob) > 300 AS truncated FROM articles WHERE {where} ORDER BY article_id LIMIT 5"


register("retrieve_pattern", _retrieve(_HIT))(lambda s, d: T.retrieve(V.articles(s, d), WHOLE, max_chars=300))
register("retrieve_by_date", _retrieve(f"publication = DATE '{DAY}'"))(lambda s, d: T.retrieve(V.articles(s, d), day=DAY, max_chars=300))
register("text_index_equals_scan", _A + r"SELECT article_id FROM articles WHERE (regexp_matches(blob, '(^|[^a-z0-9])the([^a-z0-9]|$)') AND regexp_matches(blob, '(^|[^a-z0-9])and([^a-z0-9]|$)')) OR regexp_matches(blob, '(^|[^a-z0-9])que([^a-z0-9]|$)')")(lambda s, d: T.by_index(V.articles(s, d), [["the", "and"], ["que"]]))
