"""Price questions over daily bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quaymark.operators import intervals
from quaymark.operators import prices as P
from quaymark.operators import rates as R
from quaymark.plans.catalogue import register
from quaymark.sources import views as V

FROM, TO, DAY = "1997-03-03", "1999-06-30", "1998-07-05"
LEFT_OUT = ("5-LOW",)
_B = V.with_(V.BARS)
_ALL = "ticker, day, open, high, low, close, volume"

register("bars", _B + f"SELECT {_ALL} FROM bars")(V.bars)
register("bars_intraday", V.with_(V.BARS_INTRADAY) + f"SELECT {_ALL} FROM bars_intraday")(V.bars_intraday)
register("sessions", _B + "SELECT DISTINCT day FROM bars")(lambda s, d: P.sessions(V.bars(s, d)))
register("price_coverage", _B + ", e AS (SELECT ticker, count(*) AS n, min(day) AS f, max(day) AS l FROM bars GROUP BY 1) SELECT count(*) AS tickers, min(n) AS min_rows, max(n) AS max_rows, max(f) AS common_start, min(l) AS common_end, min(f) AS first_day, max(l) AS last_day FROM e")(lambda s, d: P.coverage(V.bars(s, d)))

_RET = """, ret AS (SELECT * FROM (SELECT ticker, day, (close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1) * 100 AS ret FROM bars) WHERE ret IS NOT NULL)"""
register("daily_returns", _B + _RET + " SELECT ticker, day, round(ret, 6) AS ret FROM ret")(lambda s, d: P.daily_returns(V.bars(s, d)).withColumn("ret", F.round("ret", 6)))

_ANN = """, ann AS (SELECT ticker, year, n_bars, round((l / f - 1) * 100, 4) AS return_pct FROM (SELECT ticker, year(day) AS year, count(*) AS n_bars, arg_min(close, day) AS f, arg_max(close, day) AS l FROM bars GROUP BY 1, 2) WHERE n_bars >= 2)"""
register("annual_return", _B + _ANN + " SELECT * FROM ann")(lambda s, d: P.annual_returns(V.bars(s, d)))
_RANK = _ANN + """, r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY return_pct DESC, ticker) AS rank FROM ann)
SELECT *, CASE WHEN rank = 1 THEN 'best' WHEN rank = max(rank) OVER (PARTITION BY year) THEN 'worst' ELSE 'between' END AS place FROM r"""
register("rank_annual_returns", _B + _RANK)(lambda s, d: P.rank_annual_returns(V.bars(s, d)))
register("basket_exclude", _B.replace("FROM orders", "FROM orders WHERE o_orderpriority <> '5-LOW'") + _RANK)(lambda s, d: P.rank_annual_returns(P.universe(V.bars(s, d), exclude=LEFT_OUT)))
register("basket_tickers", _B + "SELECT DISTINCT ticker FROM bars WHERE ticker <> '5-LOW'")(lambda s, d: P.universe(V.bars(s, d), exclude=LEFT_OUT).select("ticker").distinct())
register("price_window_words", _B + "SELECT ticker, count(*) AS days FROM bars WHERE day BETWEEN DATE '1996-01-01' AND DATE '1997-03-31' GROUP BY 1")(lambda s, d: P.within(V.bars(s, d), "1996", "Mar 1997").groupBy("ticker").agg(F.count("*").alias("days")))
register("full_sample_return", _B + """, f AS (SELECT ticker, n_bars, round((l / f - 1) * 100, 4) AS return_pct FROM (SELECT ticker, count(*) AS n_bars, arg_min(close, day) AS f, arg_max(close, day) AS l FROM bars GROUP BY 1) WHERE n_bars >= 2)
SELECT *, row_number() OVER (ORDER BY return_pct DESC, ticker) AS rank FROM f""")(lambda s, d: P.full_sample_returns(V.bars(s, d)))
register("basket_return", _B + _ANN + " SELECT year, count(*) AS constituents, round(avg(return_pct), 4) AS basket_pct FROM ann GROUP BY 1")(lambda s, d: P.basket_returns(V.bars(s, d)))


def _volume(where: str = "") -> str:
    return _B + f"SELECT *, row_number() OVER (ORDER BY mean_volume DESC, ticker) AS rank FROM (SELECT ticker, count(*) AS days, round(avg(volume), 2) AS mean_volume, round(sum(volume), 2) AS total_volume FROM bars {where} GROUP BY 1)"


_WIN = f"WHERE day BETWEEN DATE '{FROM}' AND DATE '{TO}'"
register("avg_volume", _volume())(lambda s, d: P.volume_stats(V.bars(s, d)))
register("avg_volume_window", _volume(_WIN))(lambda s, d: P.volume_stats(V.bars(s, d), FROM, TO))
register("volatility", _B + ", b AS (SELECT ticker, (close / lag(close) OVER (PARTITION BY ticker ORDER BY day) - 1) * 100 AS ret FROM bars WHERE year(day) = 1998) SELECT ticker, count(ret) + 1 AS n_bars, round(stddev_samp(ret) * sqrt(252), 4) AS volatility_pct FROM b GROUP BY 1 HAVING count(ret) >= 2")(lambda s, d: P.volatility(V.bars(s, d), 1998))
register("volatility_full", _B + _RET + " SELECT ticker, count(ret) + 1 AS n_bars, round(stddev_samp(ret), 4) AS volatility_pct FROM ret GROUP BY 1 HAVING count(ret) >= 2")(lambda s, d: P.volatility(V.bars(s, d), annualised=False))
register("correlation", _B.replace("GROUP BY 1, 2)", f"GROUP BY 1, 2 HAVING CAST(o_orderdate AS DATE) BETWEEN DATE '{FROM}' AND DATE '{TO}')") + _RET + " SELECT count(*) AS shared_days, CASE WHEN count(*) >= 3 THEN round(corr(a.ret, b.ret), 6) END AS correlation FROM ret a JOIN ret b USING (day) WHERE a.ticker = '1-URGENT' AND b.ticker = '2-HIGH'")(lambda s, d: P.correlation(V.bars(s, d), "1-URGENT", "2-HIGH", FROM, TO))
register("shared_days_intersect", _B + "SELECT day FROM bars WHERE ticker = '1-URGENT' INTERSECT SELECT day FROM bars WHERE ticker = '2-HIGH'")(lambda s, d: (lambda b: b.where("ticker = '1-URGENT'").select("day").intersect(b.where("ticker = '2-HIGH'").select("day")))(V.bars(s, d)))

_PEAK = """, pk AS (SELECT ticker, day, close, arg_max(close, (close, -epoch(day))) OVER w AS peak_close, arg_max(day, (close, -epoch(day))) OVER w AS peak_day FROM {0} WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS UNBOUNDED PRECEDING))"""
register("running_peak", _B + _PEAK.format("bars") + " SELECT * FROM pk")(lambda s, d: P.running_peak(V.bars(s, d)))


def _fall(where: str = "", last: str = "") -> str:
    return _B + f", w AS (SELECT * FROM bars {where})" + _PEAK.format("w") + f""", x AS (SELECT ticker, day, peak_day, least(0.0, (close / peak_close - 1) * 100) AS fall FROM pk),
y AS (SELECT ticker, count(*) AS n, min((fall, day, peak_day)) AS w FROM x GROUP BY 1 HAVING count(*) >= 2),
z AS (SELECT ticker, round(w[1], 4) AS drawdown_pct, w[3] AS peak_day, w[2] AS trough_day FROM y),
r AS (SELECT *, row_number() OVER (ORDER BY drawdown_pct, ticker) AS rank FROM z) SELECT * FROM r {last}"""


register("max_drawdown", _fall())(lambda s, d: P.max_drawdown(V.bars(s, d)))
register("max_drawdown_window", _fall(_WIN))(lambda s, d: P.max_drawdown(V.bars(s, d), FROM, TO))
register("drawdown_top3", _fall("", "WHERE rank <= 3"))(lambda s, d: P.max_drawdown(V.bars(s, d), top=3))


def _requests(s, d):
    """Every ticker at every order date, and at one before all."""
    b = V.bars(s, d)
    return b.select("ticker").distinct().join(P.sessions(b).union(s.sql("select date'1990-01-01'")).withColumnRenamed("day", "requested"), F.lit(True))


_REQ = ", q AS (SELECT ticker, requested FROM (SELECT DISTINCT ticker FROM bars), (SELECT DISTINCT day AS requested FROM bars UNION ALL SELECT DATE '1990-01-01'))"
register("close_asof", _B + _REQ + " SELECT q.ticker, requested, close, day AS used_day, day = requested AS exact FROM q ASOF LEFT JOIN bars b ON q.ticker = b.ticker AND requested >= day")(lambda s, d: P.close_as_of(_requests(s, d), V.bars(s, d)))


def _line_requests(s, d):
    """Every line's ship date; nine of ten orders ask for one ticker."""
    return V.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 10 < 9, "1-URGENT").otherwise("5-LOW").alias("ticker"), F.col("l_shipdate").cast("date").alias("requested"))


register("asof_lines", _B + " SELECT l_orderkey, l_linenumber, q.ticker, requested, day AS used_day, close FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 < 9 THEN '1-URGENT' ELSE '5-LOW' END AS ticker, CAST(l_shipdate AS DATE) AS requested FROM lineitem) q ASOF LEFT JOIN bars b ON q.ticker = b.ticker AND requested >= day")(
    lambda s, d: P.as_of_bars(_line_requests(s, d), V.bars(s, d)).select("l_orderkey", "l_linenumber", "ticker", "requested", F.col("bar.day").alias("used_day"), F.col("bar.close").alias("close"))
)


def _gaps(s, d):
    """Every customer's gaps between days of orders."""
    days = V.table(s, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("start")).distinct()
    return days.withColumn("end", F.lead("start").over(Window.partitionBy("o_custkey").orderBy("start"))).where("end is not null")


def _inside_gaps(s, d):
    moved = V.decisions(s, d).where("change_bp <> 0").select("effective", "change_bp")
    return intervals.inside(moved, _gaps(s, d), "effective").groupBy("o_custkey", "start", "end").agg(F.count("*").alias("changes"), F.sum("change_bp").alias("net_bp"))


register("changes_inside_gaps", V.with_(V.DECISIONS) + """, g AS (SELECT o_custkey, start, lead(start) OVER (PARTITION BY o_custkey ORDER BY start) AS "end" FROM (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS start FROM orders))
SELECT o_custkey, start, "end", count(*) AS changes, CAST(sum(change_bp) AS BIGINT) AS net_bp FROM g JOIN decisions ON change_bp <> 0 AND effective > start AND effective < "end" GROUP BY ALL""")(_inside_gaps)
register("price_on_date", _B + f"SELECT ticker, max(day) AS used_day, arg_max(open, day) AS open, arg_max(high, day) AS high, arg_max(low, day) AS low, arg_max(close, day) AS close, arg_max(volume, day) AS volume, max(day) = DATE '{DAY}' AS exact FROM bars WHERE day <= DATE '{DAY}' GROUP BY 1")(lambda s, d: P.price_on_date(V.bars(s, d), DAY))

_WR = """, t AS (SELECT DISTINCT ticker FROM bars),
ea AS (SELECT q.key, q.ticker, b.close AS a, b.day AS start_day FROM (SELECT key, start, ticker FROM win, t) q ASOF JOIN bars b ON q.ticker = b.ticker AND q.start >= b.day),
eb AS (SELECT q.key, q.ticker, b.close AS b, b.day AS end_day FROM (SELECT key, "end" AS e, ticker FROM win, t) q ASOF JOIN bars b ON q.ticker = b.ticker AND q.e >= b.day),
wr AS (SELECT key, ticker, start_day, end_day, round((b / a - 1) * 100, 4) AS return_pct FROM ea JOIN eb USING (key, ticker))
"""
_ONE = f", win AS (SELECT 'w' AS key, DATE '{FROM}' AS start, DATE '{TO}' AS \"end\")"
register("window_return", _B + _ONE + _WR + "SELECT * FROM wr")(lambda s, d: P.window_returns(V.bars(s, d), s.sql(f"select 'w' as key, date'{FROM}' as start, date'{TO}' as end")))
_EVENTS = ", ev AS (SELECT effective AS event_day FROM decisions WHERE change_bp <> 0)"
_BD = V.with_(V.BARS, V.DECISIONS) + _EVENTS
_SW = """, n AS (SELECT day, row_number() OVER (ORDER BY day) AS seq FROM (SELECT DISTINCT day FROM bars)),
nx AS (SELECT event_day, min(seq) AS nxt FROM ev JOIN n ON n.day > event_day WHERE event_day >= (SELECT min(day) FROM bars) GROUP BY 1),
win AS (SELECT event_day AS key, event_day AS start, n.day AS "end" FROM nx JOIN n ON n.seq = nxt + 4)"""
_CW = """, win AS (SELECT event_day AS key, event_day AS start, event_day + 7 AS "end" FROM ev WHERE event_day >= (SELECT min(day) FROM bars) AND event_day + 7 <= (SELECT max(day) FROM bars))"""


def _events(s, d):
    return V.decisions(s, d).where("change_bp <> 0").select(F.col("effective").alias("event_day"))


register("event_window_sessions", _BD + _SW + _WR + "SELECT * FROM wr")(lambda s, d: P.window_returns(V.bars(s, d), P.session_windows(V.bars(s, d), _events(s, d), 5)))
register("event_window_calendar", _BD + _CW + """ SELECT key, count(*) AS sessions FROM win JOIN (SELECT DISTINCT day FROM bars) ON day > start AND day <= "end" GROUP BY 1""")(lambda s, d: P.sessions_inside(V.bars(s, d), P.calendar_windows(V.bars(s, d), _events(s, d), 7)))
register("event_study", _BD + _CW + _WR + ", bk AS (SELECT key, count(*) AS constituents, round(avg(return_pct), 4) AS basket_pct FROM wr GROUP BY 1) SELECT *, CASE WHEN basket_pct > 0 THEN 'up' WHEN basket_pct < 0 THEN 'down' ELSE 'flat' END AS direction FROM bk")(lambda s, d: P.basket_of(P.window_returns(V.bars(s, d), P.calendar_windows(V.bars(s, d), _events(s, d), 7))))

register("ticker_normalise", "SELECT c_custkey, CASE WHEN ends_with(upper(trim(c_name)), '.AX') THEN upper(trim(c_name)) ELSE upper(trim(c_name)) || '.AX' END AS ticker FROM customer")(lambda s, d: V.table(s, d, "customer").select("c_custkey", P.normalise_ticker(F.col("c_name")).alias("ticker")))


def _alias(s, d):
    nation = V.table(s, d, "nation")
    aliases = nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"), F.lit(".AX")).alias("ticker"), F.lower("n_name").alias("company"))
    asked = nation.select(F.upper("n_name").alias("name")).union(nation.select(F.concat(F.lit(" n"), F.col("n_nationkey").cast("string"), F.lit(".ax")))).union(s.sql("select 'nobody'"))
    return P.resolve(asked, aliases)


register("ticker_alias", "WITH a AS (SELECT 'N' || n_nationkey || '.AX' AS ticker, lower(n_name) AS company FROM nation), q AS (SELECT upper(n_name) AS name FROM nation UNION ALL SELECT ' n' || n_nationkey || '.ax' FROM nation UNION ALL SELECT 'nobody') SELECT name, coalesce(x.ticker, y.ticker) AS ticker FROM q LEFT JOIN a x ON lower(x.ticker) = lower(trim(name)) LEFT JOIN a y ON y.company = lower(trim(name))")(_alias)


def _span(df, name, day):
    return df.agg(F.lit(name).alias("dataset"), F.count("*").alias("records"), F.min(day).alias("start"), F.max(day).alias("end"))


register("coverage_overlap", V.with_(V.BARS, V.DECISIONS, V.ARTICLES) + "SELECT count(*) AS datasets, CAST(sum(n) AS BIGINT) AS records, max(a) AS overlap_start, min(b) AS overlap_end, max(a) <= min(b) AS valid FROM (SELECT count(*) AS n, min(day) AS a, max(day) AS b FROM bars UNION ALL SELECT count(*), min(effective), max(effective) FROM decisions UNION ALL SELECT count(*), min(publication), max(publication) FROM articles)")(
    lambda s, d: P.overlap([_span(V.bars(s, d), "prices", "day"), _span(V.decisions(s, d), "rates", "effective"), _span(V.articles(s, d), "text", "publication")])
)


def _composite(s, d):
    """By year: rate changes, articles and the basket's return, whichever there are."""
    rates = R.changes_by_year(V.decisions(s, d)).select("year", "changes", "net_points")
    text = V.articles(s, d).where("publication is not null").groupBy(F.year("publication").alias("year")).agg(F.count("*").alias("articles"))
    basket = P.basket_returns(V.bars(s, d)).select("year", "basket_pct")
    return rates.join(text, "year", "full").join(basket, "year", "full")


register("composite_year", V.with_(V.BARS, V.DECISIONS, V.ARTICLES) + _ANN.replace(", ann", ", ann", 1) + """, x AS (SELECT year(effective) AS year, count(*) AS changes, round(sum(change_bp) / 100.0, 2) AS net_points FROM decisions WHERE change_bp <> 0 GROUP BY 1),
y AS (SELECT year(publication) AS year, count(*) AS articles FROM articles WHERE publication IS NOT NULL GROUP BY 1),
z AS (SELECT year, round(avg(return_pct), 4) AS basket_pct FROM ann GROUP BY 1)
SELECT year, changes, net_points, articles, basket_pct FROM x FULL JOIN y USING (year) FULL JOIN z USING (year)""")(_composite)
