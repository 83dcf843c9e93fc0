"""Counting and finding articles (article_id, headline, blob, publication) by pattern; each article counts once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.functions import dates
from quaymark.operators.patterns import EDGE, from_terms, literals, translate


def build_pattern(pattern: str | None = None, terms: Sequence[str] | str | None = None, whole_word: bool = True) -> str:
    """The engine's regular expression from exactly one of a pattern (Python's syntax, case ignored) and terms; terms are escaped and, if wanted, must stand alone."""
    if (pattern is None) == (terms is None):
        raise ValueError("give either a pattern or terms")
    return translate(pattern) if pattern is not None else from_terms(terms, whole_word)


def matches(pattern: str, blob: str = "blob") -> Column:
    """Whether a blob matches. Literals that a match must hold are looked for first: a scan for bytes is cheaper than the expression."""
    found = F.col(blob).rlike(pattern)
    held = literals(pattern)
    if not held:
        return found
    any_of = F.contains(blob, F.lit(held[0]))
    for word in held[1:]:
        any_of = any_of | F.contains(blob, F.lit(word))
    return any_of & found


def _inside(year: int | None = None, month: int | None = None, start: str | None = None, end: str | None = None) -> Column:
    """Whether an article is of a year, a month (of any year, if none is named) and a closed window; undated ones are only if nothing is asked."""
    day, (low, high) = F.col("publication"), dates.window(start, end)
    test = F.lit(True)
    for wanted, asked in ((year, F.year(day) == year), (month, F.month(day) == month), (low, day >= F.lit(low)), (high, day <= F.lit(high))):
        if wanted is not None:
            test = test & F.coalesce(asked, F.lit(False))
    return test


def dated(articles: DataFrame, **asked) -> DataFrame:
    return articles.where(_inside(**asked))


def coverage(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("total"), F.count("publication").alias("dated"), (F.count("*") - F.count("publication")).alias("undated"), F.min("publication").alias("first_day"), F.max("publication").alias("last_day"))


def count(articles: DataFrame, pattern: str, **filters) -> DataFrame:
    """Matches within the filters, and their share of the whole corpus, filtered or not."""
    inside = _inside(**filters)
    return articles.agg(F.count_if(inside & matches(pattern)).alias("matches"), F.count("*").alias("total")).select("matches", "total", F.round(100.0 * F.col("matches") / F.nullif("total", F.lit(0)), 4).alias("share_pct"))


def share(articles: DataFrame, pattern: str, year: int | None = None) -> DataFrame:
    """Matches and their share of the corpus, or of the year's dated articles."""
    return count(dated(articles, year=year), pattern)


def by_year(articles: DataFrame, pattern: str) -> DataFrame:
    """Matches by year, the peak marked; of equal years the earliest."""
    years = articles.where(F.col("publication").isNotNull() & matches(pattern)).groupBy(F.year("publication").alias("year")).agg(F.count("*").alias("matches"))
    return years.withColumn("peak", F.row_number().over(Window.orderBy(F.desc("matches"), "year")) == 1)


def by_month(articles: DataFrame, pattern: str) -> DataFrame:
    """Matches by month, the peak marked; of equal months the latest."""
    months = articles.where(F.col("publication").isNotNull() & matches(pattern)).groupBy(F.date_format("publication", "yyyy-MM").alias("month")).agg(F.count("*").alias("matches"))
    return months.withColumn("peak", F.row_number().over(Window.orderBy(F.desc("matches"), F.desc("month"))) == 1)


def normalise_headline(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def find_headline(articles: DataFrame, requests: DataFrame) -> DataFrame:
    """Articles for requests (wanted, day): exact normalised headline on the day, else on any day, else of those that hold it on the day; the first stage that finds some wins.

    A stage is given only the requests that the ones before left open, and what it finds is final: rows of the result, which
    grow with the square of a group of equal headlines, are neither shuffled nor stored. Requests and headlines meet by headline
    and day, by headline, and by day."""
    # A row an article; several headlines of one are lines, which nothing wanted can span.
    named = articles.select("article_id", "publication", normalise_headline(F.col("headline")).alias("norm")).where("norm is not null")
    named = named.groupBy("article_id", "publication").agg(F.array_join(F.collect_set("norm"), "\n").alias("norms"))
    each = named.select("article_id", "publication", F.explode(F.split("norms", "\n")).alias("norm"))
    asked = requests.select("wanted", "day").distinct().withColumn("want", normalise_headline(F.col("wanted"))).where("want is not null")
    same, on_day = F.col("want") == F.col("norm"), F.col("day").eqNullSafe(F.col("publication"))
    other = asked.join(each, same & on_day, "left_anti")
    open_ = other.join(each, same, "left_anti")
    # Said of the pair, not of one side before the join: then the stages' shuffles are the same and are made once.
    held = on_day & F.contains("norms", F.when(F.col("day").isNotNull() & (F.col("want") != ""), F.col("want")))
    stages = [asked.join(each, same & on_day), other.join(each, same), named.join(open_, held)]
    return reduce(DataFrame.union, [found.select("wanted", "day", F.lit(k).alias("stage"), "article_id", "publication") for k, found in enumerate(stages, 1)])


def retrieve(articles: DataFrame, pattern: str | None = None, day: str | None = None, limit: int = 5, max_chars: int = 1000) -> DataFrame:
    """Up to limit articles (a feature: total says how many there are), texts cut to max_chars within 200 to 20,000."""
    if pattern is None and day is None:
        raise ValueError("give a pattern or a day")
    chars = max(200, min(20_000, max_chars))
    found = articles if pattern is None else articles.where(matches(pattern))
    found = found if day is None else found.where(F.col("publication") == F.lit(dates.bound(day, upper=True)))
    total = found.agg(F.count("*").alias("total"))
    top = found.orderBy("article_id").limit(max(1, limit))
    return top.join(F.broadcast(total), F.lit(True)).select("article_id", "publication", "total", F.substring("blob", 1, chars).alias("snippet"), (F.length("blob") > chars).alias("truncated"))


def postings(articles: DataFrame) -> DataFrame:
    """(token, article_id): an index that prefilters rare tokens."""
    return articles.select(F.explode(F.array_distinct(F.regexp_extract_all("blob", F.lit("[a-z0-9]+"), F.lit(0)))).alias("token"), "article_id")


def by_index(articles: DataFrame, groups: Sequence[Sequence[str]]) -> DataFrame:
    """Ids of the articles that hold every token of any group."""
    wanted = sorted({t for g in groups for t in g})
    held = postings(articles).where(F.col("token").isin(wanted)).groupBy("article_id").agg(F.collect_set("token").alias("tokens"))
    any_of = F.lit(False)
    for g in groups:
        any_of = any_of | (F.size(F.array_intersect("tokens", F.array(*[F.lit(t) for t in g]))) == len(set(g)))
    return held.where(any_of).select("article_id")
