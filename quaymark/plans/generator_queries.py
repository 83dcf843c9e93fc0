"""Training examples by category (category, question, answer), made from the metrics; each has its SQL."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymark.functions import scalars as S
from quaymark.functions import subsets
from quaymark.operators import prices as P
from quaymark.operators import rates as R
from quaymark.operators import text as T
from quaymark.plans.catalogue import register
from quaymark.sources import views as V

EVENT_SESSIONS, WORST = 5, 3
TERM = T.build_pattern(terms=["the"])


def _example(rows: DataFrame, category: str, question: Column, answer: Column) -> DataFrame:
    return rows.select(F.lit(category).alias("category"), question.alias("question"), answer.alias("answer"))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def rate_counts(decisions: DataFrame) -> DataFrame:
    c = F.col
    answer = _text(c("changes"), " changes: ", c("increases"), " up, ", c("decreases"), " down, net ", S.signed_points(c("net_points")))
    return _example(R.changes_by_year(decisions), "rba_counts", _text("How often did the rate change in ", c("year"), "?"), answer)


def coverages(decisions: DataFrame, bars: DataFrame, articles: DataFrame) -> DataFrame:
    spans = [("rate decisions", R.coverage(decisions), "first_date", "last_date"), ("prices", P.coverage(bars), "first_day", "last_day"), ("articles", T.coverage(articles), "first_day", "last_day")]
    made = [_example(rows, "coverage", _text(f"What period do the {name} cover?"), _text(S.reference_day(F.col(a)), " to ", S.reference_day(F.col(b)))) for name, rows, a, b in spans]
    return reduce(DataFrame.union, made)


def volumes(bars: DataFrame) -> DataFrame:
    c = F.col
    return _example(P.volume_stats(bars), "asx_volume", _text("What is the average daily volume of ", c("ticker"), "?"), _text(S.volume_text(c("mean_volume")), " shares, rank ", c("rank")))


def drawdowns(bars: DataFrame) -> DataFrame:
    """One example with the worst few, in order: WORST rows are listed."""
    worst = P.max_drawdown(bars, top=WORST).agg(F.array_sort(F.collect_list(F.struct("rank", _text(F.col("ticker"), " ", F.format_string("%.4f%%", "drawdown_pct")).alias("line")))).alias("rows"))
    return _example(worst, "asx_drawdown", _text(f"Rank the {WORST} worst drawdowns."), S.ranking(F.transform("rows", lambda r: r["line"])))


def text_counts(articles: DataFrame) -> DataFrame:
    c = F.col
    return _example(T.by_year(articles, TERM), "afr_counts", _text("How many articles of ", c("year"), " hold the word?"), _text(S.thousands(c("matches")), F.when(c("peak"), ", the most of all years").otherwise("")))


def rate_events(decisions: DataFrame, bars: DataFrame) -> DataFrame:
    changes = R.list_changes(decisions).select("effective", "target")
    windows = P.session_windows(bars, changes.select(F.col("effective").alias("event_day")), EVENT_SESSIONS)
    moved = P.basket_of(P.window_returns(bars, windows)).join(F.broadcast(changes), F.col("key") == F.col("effective"))  # changes are a dimension
    question = _text("What did the basket do in the sessions after ", S.reference_day(F.col("effective")), "?")
    return _example(moved, "rba_asx_event", question, _text("the target moved to ", S.rate_percent(F.col("target")), "; the basket went ", F.col("direction"), " ", F.format_string("%+.4f%%", "basket_pct")))


def composites(decisions: DataFrame, bars: DataFrame) -> DataFrame:
    both = R.changes_by_year(decisions).join(P.basket_returns(bars), "year")
    return _example(both, "composite", _text("For ", F.col("year"), ", report rate changes and the basket's return."), _text(F.col("changes"), " changes; ", F.format_string("%+.4f%%", "basket_pct")))


def refusals(bars: DataFrame) -> DataFrame:
    """Years behind the last session have no answer."""
    last = P.coverage(bars).select("last_day", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("ahead"))
    return _example(last, "refusal", _text("What did the basket return in ", F.year("last_day") + F.col("ahead"), "?"), _text("The prices end on ", S.reference_day(F.col("last_day")), ", so this can't be answered from them."))


_ALL = V.with_(V.BARS, V.DECISIONS, V.ARTICLES)
_YEARS = "yr AS (SELECT year(effective) AS year, count(*) AS changes, count(*) FILTER (change_bp > 0) AS up, count(*) FILTER (change_bp < 0) AS down, sum(change_bp) AS net FROM decisions WHERE change_bp <> 0 GROUP BY 1)"
_BASKET = "ann AS (SELECT ticker, year(day) AS year, round((arg_max(close, day) / arg_min(close, day) - 1) * 100, 4) AS r FROM bars GROUP BY 1, 2 HAVING count(*) >= 2), bk AS (SELECT year, round(avg(r), 4) AS pct FROM ann GROUP BY 1)"
_DAY = "strftime({0}, '%-d %b %Y')"

register("gen_rba_counts", _ALL + f", {_YEARS} SELECT 'rba_counts' AS category, 'How often did the rate change in ' || year || '?' AS question, changes || ' changes: ' || up || ' up, ' || down || ' down, net ' || printf('%+.2f percentage points', net / 100.0) AS answer FROM yr")(lambda s, d: rate_counts(V.decisions(s, d)))
register("gen_coverage", _ALL + ", x AS (SELECT 'rate decisions' AS name, min(effective) AS a, max(effective) AS b FROM decisions UNION ALL SELECT 'prices', min(day), max(day) FROM bars UNION ALL SELECT 'articles', min(publication), max(publication) FROM articles) SELECT 'coverage' AS category, 'What period do the ' || name || ' cover?' AS question, " + _DAY.format("a") + " || ' to ' || " + _DAY.format("b") + " AS answer FROM x")(lambda s, d: coverages(V.decisions(s, d), V.bars(s, d), V.articles(s, d)))
register("gen_asx_volume", _ALL + ", v AS (SELECT ticker, round(avg(volume), 2) AS m FROM bars GROUP BY 1) SELECT 'asx_volume' AS category, 'What is the average daily volume of ' || ticker || '?' AS question, format('{:,.2f}', m) || ' shares, rank ' || row_number() OVER (ORDER BY m DESC, ticker) AS answer FROM v")(lambda s, d: volumes(V.bars(s, d)))
register("gen_asx_drawdown", _ALL + """, p AS (SELECT ticker, day, close, max(close) OVER (PARTITION BY ticker ORDER BY day) AS peak FROM bars), w AS (SELECT ticker, round(min(least(0.0, (close / peak - 1) * 100)), 4) AS fall FROM p GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT *, row_number() OVER (ORDER BY fall, ticker) AS rank FROM w QUALIFY rank <= 3)
SELECT 'asx_drawdown' AS category, 'Rank the 3 worst drawdowns.' AS question, string_agg(rank || ') ' || ticker || ' ' || printf('%.4f%%', fall), '; ' ORDER BY rank) AS answer FROM r""")(lambda s, d: drawdowns(V.bars(s, d)))
register("gen_afr_counts", _ALL + f", y AS (SELECT year(publication) AS year, count(*) AS n FROM articles WHERE publication IS NOT NULL AND regexp_matches(blob, '{TERM}') GROUP BY 1) SELECT 'afr_counts' AS category, 'How many articles of ' || year || ' hold the word?' AS question, format('{{:,}}', n) || CASE WHEN row_number() OVER (ORDER BY n DESC, year) = 1 THEN ', the most of all years' ELSE '' END AS answer FROM y")(lambda s, d: text_counts(V.articles(s, d)))
register("gen_rba_asx_event", _ALL + f""", s AS (SELECT day, row_number() OVER (ORDER BY day) AS seq FROM (SELECT DISTINCT day FROM bars)),
e AS (SELECT effective, target_bp, (SELECT min(seq) FROM s WHERE day > effective) AS nxt FROM decisions WHERE change_bp <> 0 AND effective >= (SELECT min(day) FROM s)),
w AS (SELECT effective, target_bp, s.day AS stop FROM e JOIN s ON s.seq = nxt + {EVENT_SESSIONS - 1}),
a AS (SELECT w.effective, ticker, arg_max(close, day) AS c FROM w JOIN bars ON day <= w.effective GROUP BY 1, 2), b AS (SELECT w.effective, ticker, arg_max(close, day) AS c FROM w JOIN bars ON day <= stop GROUP BY 1, 2),
m AS (SELECT effective, round(avg(round((b.c / a.c - 1) * 100, 4)), 4) AS pct FROM a JOIN b USING (effective, ticker) GROUP BY 1)
SELECT 'rba_asx_event' AS category, 'What did the basket do in the sessions after ' || {_DAY.format("effective")} || '?' AS question, 'the target moved to ' || printf('%.2f%%', target_bp / 100.0) || '; the basket went ' || CASE WHEN pct > 0 THEN 'up' WHEN pct < 0 THEN 'down' ELSE 'flat' END || ' ' || printf('%+.4f%%', pct) AS answer FROM m JOIN w USING (effective)""")(lambda s, d: rate_events(V.decisions(s, d), V.bars(s, d)))
register("gen_composite", _ALL + f", {_YEARS}, {_BASKET} SELECT 'composite' AS category, 'For ' || year || ', report rate changes and the basket''s return.' AS question, changes || ' changes; ' || printf('%+.4f%%', pct) AS answer FROM yr JOIN bk USING (year)")(lambda s, d: composites(V.decisions(s, d), V.bars(s, d)))
register("gen_refusal", _ALL + ", l AS (SELECT max(day) AS last FROM bars) SELECT 'refusal' AS category, 'What did the basket return in ' || (year(last) + k) || '?' AS question, 'The prices end on ' || " + _DAY.format("last") + " || ', so this can''t be answered from them.' AS answer FROM l, (SELECT unnest([1, 2, 3]) AS k)")(lambda s, d: refusals(V.bars(s, d)))


#: Components of a drawn question: forty, so that their subsets can't be listed.
COMPONENTS, DRAWS = [f"c{k:02d}" for k in range(40)], 3


def _drawn_subsets(s, d):
    """For each item three different subsets of one to three of forty components."""
    sets = subsets.drawn(F.array(*map(F.lit, COMPONENTS)), 1, 3, F.col("item_id") * 1_000_003, DRAWS)
    return V.table(s, d, "benchmark").select("item_id", F.posexplode(sets).alias("draw", "members")).select("item_id", "draw", F.array_join("members", ",").alias("members"))


register("gen_subsets", f"""WITH c AS (SELECT k, printf('c%02d', k) AS name FROM range(40) t(k)),
u AS (SELECT 1 AS size, a.k AS x, -1 AS y, -1 AS z, a.name AS members FROM c a UNION ALL SELECT 2, a.k, b.k, -1, a.name || ',' || b.name FROM c a JOIN c b ON a.k < b.k
UNION ALL SELECT 3, a.k, b.k, e.k, a.name || ',' || b.name || ',' || e.name FROM c a JOIN c b ON a.k < b.k JOIN c e ON b.k < e.k),
n AS (SELECT members, row_number() OVER (ORDER BY size, x, y, z) - 1 AS number, count(*) OVER () AS total FROM u)
SELECT item_id, CAST(j AS INTEGER) AS draw, members FROM benchmark, range({DRAWS}) r(j) JOIN n ON n.number = (item_id * 1000003 + j * {subsets.STRIDE}) % n.total""")(_drawn_subsets)


def _drawn_returns(s, d):
    """For each ticker and year two questions that ask for drawn components of its return, answered in the order asked."""
    rows = P.rank_annual_returns(V.bars(s, d))
    told = F.array(*[F.concat(F.lit(name + "="), value) for name, value in (("return", F.format_string("%+.4f%%", "return_pct")), ("rank", F.col("rank").cast("string")), ("place", F.col("place")))])
    sets = subsets.drawn(told, 1, 2, F.col("year").cast("bigint") * 31 + F.length("ticker"), 2)
    asked = rows.select("ticker", "year", F.posexplode(sets).alias("draw", "members"))
    names = F.transform("members", lambda m: F.substring_index(m, "=", 1))
    return asked.select(F.lit("asx_return").alias("category"), _text("For ", F.col("ticker"), " in ", F.col("year"), ", report its ", S.oxford(names), ".").alias("question"), S.ranking(F.transform("members", lambda m: F.substring_index(m, "=", -1))).alias("answer"))


register("gen_drawn_returns", _ALL + """, a AS (SELECT ticker, year(day) AS year, round((arg_max(close, day) / arg_min(close, day) - 1) * 100, 4) AS r FROM bars GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY r DESC, ticker) AS rank, count(*) OVER (PARTITION BY year) AS n FROM a),
t AS (SELECT ticker, year, printf('%+.4f%%', r) AS r, CAST(rank AS VARCHAR) AS k, CASE WHEN rank = 1 THEN 'best' WHEN rank = n THEN 'worst' ELSE 'between' END AS p FROM k),
q AS (SELECT *, (CAST(year AS BIGINT) * 31 + length(ticker) + j * 2147483647) % 6 AS x FROM t, range(2) v(j))
SELECT 'asx_return' AS category, 'For ' || ticker || ' in ' || year || ', report its ' || ['return', 'rank', 'place', 'return and rank', 'return and place', 'rank and place'][x + 1] || '.' AS question,
 CASE x WHEN 0 THEN '1) ' || r WHEN 1 THEN '1) ' || k WHEN 2 THEN '1) ' || p WHEN 3 THEN '1) ' || r || '; 2) ' || k WHEN 4 THEN '1) ' || r || '; 2) ' || p ELSE '1) ' || k || '; 2) ' || p END AS answer FROM q""")(_drawn_returns)


#: A drawn window begins with any year and holds one to LONGEST years, by its first year.
LONGEST = 4
WORDS = ("the", "of", "in")


def _length(start: Column) -> Column:
    return F.pmod(start * 7, F.lit(LONGEST)) + 1


def _windows(years: DataFrame) -> DataFrame:
    """Each row of a year once for each drawn window that holds the year, so that windows are groups and need no range join."""
    inside = years.select("*", F.explode(F.sequence(F.col("year") - (LONGEST - 1), F.col("year"))).alias("start"))
    return inside.where(F.col("start") + _length(F.col("start")) > F.col("year"))


def _asked(rows: DataFrame, category: str, stem: Column, components: dict[str, Column], seed: Column, most: int, draws: int) -> DataFrame:
    """Questions for drawn subsets of one to `most` components, each answered in the order asked. No component's value is null."""
    told = F.array(*[F.struct(F.lit(name).alias("name"), value.alias("value")) for name, value in components.items()])
    places = subsets.drawn(F.array(*[F.lit(str(k + 1)) for k in range(len(components))]), 1, most, seed.cast("bigint"), draws)
    asked = rows.select(stem.alias("stem"), told.alias("told"), F.explode(places).alias("places"))
    part = lambda field: F.transform("places", lambda k: F.element_at(F.col("told"), k.cast("int"))[field])
    return _example(asked, category, _text(F.col("stem"), ", report ", S.oxford(part("name")), "."), S.ranking(part("value")))


def _asked_sql(rows: str, category: str, stem: str, components: dict[str, str], seed: str, most: int, draws: int) -> str:
    """The same from a list of all subsets."""
    sets = [list(c) for k in range(1, most + 1) for c in combinations(range(1, len(components) + 1), k)]
    values = ", ".join(components.values())
    return f"""{rows}, a_ AS (SELECT {stem} AS stem, [{values}] AS v, ({sets})[({seed} + j * {subsets.STRIDE}) % {len(sets)} + 1] AS s FROM rows_, range({draws}) r(j)), n_ AS (SELECT *, list_transform(s, lambda k: ({list(components)})[k]) AS n FROM a_)
SELECT '{category}' AS category, stem || ', report ' || CASE WHEN len(n) < 3 THEN array_to_string(n, ' and ') ELSE array_to_string(n[1:len(n) - 1], ', ') || ', and ' || n[len(n)] END || '.' AS question, array_to_string(list_transform(s, lambda k, i: i || ') ' || v[k]), '; ') AS answer FROM n_"""


def _hundredths(part: str, whole: str, of: int) -> Column:
    """of * part / whole, rounded half up to two places in whole numbers, as text."""
    q = F.expr(f"({200 * of} * {part} + {whole}) div (2 * {whole})")
    return _text(S.thousands(F.floor(q / 100)), ".", F.lpad((q % 100).cast("string"), 2, "0"))


def _hundredths_sql(part: str, whole: str, of: int) -> str:
    q = f"(({200 * of} * {part} + {whole}) // (2 * {whole}))"
    return f"format('{{:,}}', {q} // 100) || '.' || lpad(CAST({q} % 100 AS VARCHAR), 2, '0')"


_IN = "CASE WHEN (start * 7) % 4 = 0 THEN 'In ' || start ELSE 'From ' || start || ' to ' || (start + (start * 7) % 4) END"
_SPREAD = "(SELECT {0}.*, unnest(range({0}.year - 3, {0}.year + 1)) AS start FROM {0}) WHERE start + (start * 7) % 4 + 1 > year"


def _period() -> Column:
    more = _length(F.col("start")) - 1
    return F.when(more == 0, _text("In ", F.col("start"))).otherwise(_text("From ", F.col("start"), " to ", F.col("start") + more))


def drawn_rates(decisions: DataFrame) -> DataFrame:
    """Changes of the rate in drawn windows."""
    c = F.col
    change = c("change_bp")
    years = decisions.where(change != 0).groupBy(F.year("effective").alias("year")).agg(F.count("*").alias("n"), F.count_if(change > 0).alias("up"), F.count_if(change < 0).alias("down"), F.sum(change).alias("net"))
    found = _windows(years).groupBy("start").agg(*[F.sum(x).cast("bigint").alias(x) for x in ("n", "up", "down", "net")])
    parts = {"all changes": S.thousands(c("n")), "increases": S.thousands(c("up")), "decreases": S.thousands(c("down")), "the net move": F.concat(c("net").cast("string"), F.lit(" basis points"))}
    return _asked(found, "rba_counts", _period(), parts, c("start") * 13, 3, 2)


def drawn_volumes(bars: DataFrame) -> DataFrame:
    """Volumes of tickers in drawn windows, summed by year first."""
    c = F.col
    years = bars.groupBy("ticker", F.year("day").alias("year")).agg(F.sum("volume").cast("bigint").alias("total"), F.count("*").alias("days"), F.max("volume").cast("bigint").alias("top"))
    found = _windows(years).groupBy("ticker", "start").agg(F.sum("total").alias("total"), F.sum("days").alias("days"), F.max("top").alias("top"))
    parts = {"sessions": S.thousands(c("days")), "the volume": S.thousands(c("total")), "its daily average": _hundredths("total", "days", 1), "its peak": S.thousands(c("top"))}
    return _asked(found, "asx_volume", _text(_period(), ", for ", c("ticker")), parts, c("start") * 17 + F.length("ticker"), 4, 3)


def drawn_counts(articles: DataFrame) -> DataFrame:
    """Articles of drawn windows that hold a drawn word; all words are counted in one scan."""
    c = F.col
    years = articles.where("publication is not null").groupBy(F.year("publication").alias("year")).agg(F.count("*").alias("n"), *[F.count_if(F.contains("blob", F.lit(w)) & c("blob").rlike(T.build_pattern(terms=[w]))).alias(f"n_{w}") for w in WORDS])
    found = _windows(years).groupBy("start").agg(F.sum("n").alias("n"), *[F.sum(f"n_{w}").alias(f"n_{w}") for w in WORDS])
    place = F.pmod(c("start"), F.lit(len(WORDS))) + 1
    named = found.select("start", "n", F.element_at(F.array(*[F.lit(w) for w in WORDS]), place.cast("int")).alias("word"), F.element_at(F.array(*[c(f"n_{w}") for w in WORDS]), place.cast("int")).alias("m"))
    parts = {"articles that hold it": S.thousands(c("m")), "their share": F.concat(_hundredths("m", "n", 100), F.lit("%")), "all articles": S.thousands(c("n"))}
    return _asked(named, "afr_counts", _text(_period(), ', of the word "', c("word"), '"'), parts, c("start") * 19, 2, 2)


def drawn_composites(decisions: DataFrame, bars: DataFrame) -> DataFrame:
    """Changes of the rate in drawn windows beside what the basket returned in each window's first year."""
    c = F.col
    years = decisions.where("change_bp <> 0").groupBy(F.year("effective").alias("year")).agg(F.count("*").alias("n"), F.sum("change_bp").alias("net"))
    windows = _windows(years).groupBy("start").agg(F.sum("n").alias("n"), F.sum("net").cast("bigint").alias("net"))
    found = windows.join(P.basket_returns(bars).select(c("year").alias("start"), "basket_pct"), "start")
    parts = {"rate changes": S.thousands(c("n")), "the net move": F.concat(c("net").cast("string"), F.lit(" basis points")), "the basket in the first year": F.format_string("%+.4f%%", "basket_pct")}
    return _asked(found, "composite", _period(), parts, c("start") * 23, 3, 2)


_CHANGED = "y AS (SELECT year(effective) AS year, count(*) AS n, count(*) FILTER (change_bp > 0) AS up, count(*) FILTER (change_bp < 0) AS down, sum(change_bp) AS net FROM decisions WHERE change_bp <> 0 GROUP BY 1), g AS (SELECT start, sum(n) AS n, sum(up) AS up, sum(down) AS down, sum(net) AS net FROM " + _SPREAD.format("y") + " GROUP BY 1)"
_COMMAS = "format('{{:,}}', CAST({} AS BIGINT))"
register("gen_drawn_rates", _asked_sql(_ALL + f", {_CHANGED}, rows_ AS (SELECT * FROM g)", "rba_counts", _IN, {"all changes": _COMMAS.format("n"), "increases": _COMMAS.format("up"), "decreases": _COMMAS.format("down"), "the net move": "CAST(net AS BIGINT) || ' basis points'"}, "start * 13", 3, 2))(lambda s, d: drawn_rates(V.decisions(s, d)))
register("gen_drawn_volumes", _asked_sql(_ALL + ", y AS (SELECT ticker, year(day) AS year, CAST(volume AS BIGINT) AS v FROM bars), rows_ AS (SELECT ticker, start, CAST(sum(v) AS BIGINT) AS total, count(*) AS days, max(v) AS top FROM " + _SPREAD.format("y") + " GROUP BY 1, 2)", "asx_volume", _IN + " || ', for ' || ticker", {"sessions": _COMMAS.format("days"), "the volume": _COMMAS.format("total"), "its daily average": _hundredths_sql("total", "days", 1), "its peak": _COMMAS.format("top")}, "start * 17 + length(ticker)", 4, 3))(lambda s, d: drawn_volumes(V.bars(s, d)))
_WORD = f"{list(WORDS)}[start % 3 + 1]"
register("gen_drawn_counts", _asked_sql(_ALL + f", y AS (SELECT year(publication) AS year, blob FROM articles WHERE publication IS NOT NULL), rows_ AS (SELECT start, CAST(count(*) AS BIGINT) AS n, count(*) FILTER (regexp_matches(blob, '(^|[^\\pL\\pM\\pN_])' || ({_WORD}) || '($|[^\\pL\\pM\\pN_])')) AS m FROM " + _SPREAD.format("y") + " GROUP BY 1)", "afr_counts", _IN + f""" || ', of the word "' || ({_WORD}) || '"'""", {"articles that hold it": _COMMAS.format("m"), "their share": _hundredths_sql("m", "n", 100) + " || '%'", "all articles": _COMMAS.format("n")}, "start * 19", 2, 2))(lambda s, d: drawn_counts(V.articles(s, d)))
register("gen_drawn_composites", _asked_sql(_ALL + f", {_CHANGED}, {_BASKET}, rows_ AS (SELECT g.*, pct FROM g JOIN bk ON bk.year = g.start)", "composite", _IN, {"rate changes": _COMMAS.format("n"), "the net move": "CAST(net AS BIGINT) || ' basis points'", "the basket in the first year": "printf('%+.4f%%', pct)"}, "start * 23", 3, 2))(lambda s, d: drawn_composites(V.decisions(s, d), V.bars(s, d)))
