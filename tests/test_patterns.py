import datetime
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaymark.operators import intervals, postings, prices, ranks
from quaymark.operators import text as T
from quaymark.operators.patterns import literals, read, translate

ASKED = [r"\bRBA\b", r"interest rates?|cash rate|rate cut|\bRBA\b", "Data", r"\bthe\b|\bLa\b", r"\bof the\b", r"(?:ai|zebra)\b", "th[a-z]+ing", r"\bpre", r"(?P<x>ab)(?P=x)", "a{,2}b", r"foo\Z", "x{y}", "[[&x]", r"\d+(\.\d+)?%", r"É\w+", "a(bc|d)+e", r"^the|end$", ".", r"no-such-word\b", r"(un)?known facts?", r"(?=a)bc|de", r"one\s+two", r"x_y"]
TEXTS = ["The RBA raised the cash rate.", "interest rates fall", "prorate cuts", "databases", "the data", "là the", "thé", "of the", "of  the", "an ai zebra", "zebras", "thinking", "th ing", "prefix", "abab", "aab", "foo\n", "foo", "x{y}", "&x", "3.5%", "élan", "abcde", "adde", "the end", "known fact", "unknown facts", "de", "one \n two", "x_y", "", "RBA's", "arba", "_rba_", "a b"]


@pytest.fixture(scope="module")
def articles(spark):
    day = datetime.date(2020, 5, 1)
    return spark.createDataFrame([(k * 977, t, t.lower(), None if k % 5 == 0 else day.replace(year=2018 + k % 4)) for k, t in enumerate(TEXTS)] + [(None, "the", "the", day)], "article_id bigint, headline string, blob string, publication date")


@pytest.fixture(scope="module")
def index(articles, tmp_path_factory):
    return postings.build(articles, f"file://{tmp_path_factory.mktemp('index')}/i")


@pytest.mark.parametrize("pattern", ASKED)
def test_scan_and_index_as_python_reads_a_pattern(articles, index, pattern):
    want = {k * 977 for k, t in enumerate(TEXTS) if re.search(pattern, t.lower(), re.IGNORECASE)}
    built = T.build_pattern(pattern)
    known = articles.where("article_id is not null")
    assert {r.article_id for r in known.where(T.matches(built)).collect()} == want
    assert {r.article_id for r in index.match(built).collect()} == want
    assert index.count(built).first()[:2] == (len(want), len(TEXTS))
    assert index.count(built, year=2019).first()[:] == T.count(known, built, year=2019).first()[:]


def test_what_is_not_taken():
    for bad in ("(", "(?(1)a|b)(c)", "(?#x)a", "(?x)a b", "(?a)b", r"[\b]", "(?<!ab*)c"):
        with pytest.raises(ValueError):
            translate(bad)


def test_readings():
    whole = lambda p: [sorted((x.text, x.begins, x.ends) for x in a) for a in read(translate(p)).alternatives]
    assert whole(r"\bRBA\b|cash rate") == [[("rba", True, True)], [("cash", False, True), ("rate", True, False)]]
    assert read(translate(r"\bRBA\b|\bASX\b")).exact and read(translate("data")).exact and not read(translate("cash rate")).exact
    assert read(translate("a?")).alternatives is None and read(translate("[ab]c|.")).alternatives is None
    assert read(T.build_pattern(terms=["the", "la"])).exact and literals(T.build_pattern(terms="Bank")) == ["bank"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", " ", "ab", r"\b", "-", "(a|b)", "(?:ab|c )", "a?", "b+", "[ab]", r"\s", "|", "é"]), min_size=1, max_size=7), st.text("ab -cé", max_size=12))
def test_a_match_holds_its_pieces(parts, text):
    pattern = "".join(parts)
    try:
        if not re.search(pattern, text):
            return
    except re.error:
        return
    words = re.findall(r"\w+", text)
    reading = read(translate(pattern))
    fits = lambda p: any(w == p.text if p.whole else w.startswith(p.text) if p.begins else w.endswith(p.text) if p.ends else p.text in w for w in words)
    assert reading.alternatives is None or any(all(map(fits, a)) for a in reading.alternatives)
    held = literals(translate(pattern))
    assert held is None or any(x in text for x in held)


def test_index_is_kept_and_made_anew(spark, articles, tmp_path):
    folder = f"file://{tmp_path}/i"
    first = postings.kept(articles, folder, "one")
    assert first.total == len(TEXTS)
    assert postings.kept(articles.limit(0), folder, "one").total == len(TEXTS)  # not read again
    assert postings.kept(articles.where("article_id < 977"), folder, "two").total == 1
    empty = postings.build(articles.limit(0), f"file://{tmp_path}/e")
    assert empty.count(T.build_pattern("data")).first()[:] == (0, 0, None) and empty.match(T.build_pattern(".")).count() == 0


def test_index_with_few_named_words(articles, index, monkeypatch):
    monkeypatch.setattr(postings, "NAMED_WORDS", 0)
    monkeypatch.setattr(postings, "SELECTIVE", 1.0)
    for pattern in ("Data", r"\bof the\b", "interest rates?|cash rate"):
        want = {k * 977 for k, t in enumerate(TEXTS) if re.search(pattern, t.lower(), re.IGNORECASE)}
        assert {r.article_id for r in index.match(T.build_pattern(pattern)).collect()} == want


def test_as_of_with_a_ticker_of_most_rows(spark):
    bars = spark.range(200).selectExpr("if(id % 2 = 0, 'A', 'B') as ticker", "date_add(date'2020-01-01', cast(id * 3 as int)) as day", "double(id) as close")
    asked = spark.range(40_000).selectExpr("if(id % 10 < 9, 'A', 'C') as ticker", "date_add(date'2019-12-01', cast(id % 800 as int)) as requested", "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small tasks are joined up
    try:
        got = prices.as_of_bars(asked, bars, "requested")
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 3 and sizes[-1] < 0.6 * 40_000
    held = {r.day: r.close for r in bars.where("ticker = 'A'").collect()}
    for r in got.where("id % 997 = 0").collect():
        days = [d for d in held if d <= r.requested]
        assert (r.bar.close if r.bar else None) == (held[max(days)] if days and r.ticker == "A" else None)
    assert got.count() == 40_000 and prices.as_of_bars(asked.limit(0), bars).count() == 0


def test_days_inside_windows(spark):
    points = spark.range(3000).selectExpr("date_add(date'2020-01-01', cast(if(id % 3 = 0, 10, id % 400) as int)) as at", "id as point")
    windows = spark.range(60).selectExpr("date_add(date'2019-12-20', cast(id * 7 as int)) as start", "date_add(date'2019-12-20', cast(id * 7 + id % 40 as int)) as end", "id as window")
    odd = windows.unionByName(spark.sql("select cast(null as date) as start, date'2020-02-02' as end, 90L as window union all select date'2020-03-03', date'2020-01-01', 91L"))
    got = {(r.point, r.window) for r in intervals.inside(points, odd, "at", bin_rows=50).collect()}
    p, w = points.collect(), windows.collect()
    assert got == {(a.point, b.window) for a in p for b in w if b.start < a.at < b.end}
    assert intervals.inside(points.limit(0), odd, "at").count() == 0 and intervals.inside(points, odd.limit(0), "at").count() == 0
    with pytest.raises(ValueError):
        intervals.inside(points.withColumnRenamed("point", "START"), windows, "at")


def test_quantiles_of_many_groups_and_of_one(spark):
    rows = spark.range(20_000).selectExpr("if(id % 4 = 0, id, null) as g", "cast(pmod(id * 7919, 1009) as double) as v")
    found = {r.g: r[:] for r in ranks.quantiles(rows, ["g"], "v", p50=50, p95=95).collect()}
    groups: dict = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append(r.v)
    assert len(found) == 5001
    for g, v in groups.items():
        v.sort()
        assert found[g] == (g, len(v), v[0], v[len(v) // 2], v[len(v) * 95 // 100], v[-1])
    assert ranks.quantiles(rows.limit(0), ["g"], "v", p50=50).count() == 0
