"""Metrics as SQL table functions: SELECT * FROM rates_count(start => '2019').

One function a metric, since each has its own columns. They are SQL, so Catalyst puts a call's arguments into the plan and
drops the conditions of those that aren't given; an argument that a metric doesn't take, or a name that there is none of,
is an analysis error. A call may be LATERAL to a table of arguments: each different row of arguments is then set against
the metric's table, so keep that to decisions and bars. SHOW USER FUNCTIONS lists them, DESCRIBE FUNCTION tells what they take.

Tickers that no bar has are left out (no error, as with IN). A pattern is a regular expression of the engine, case ignored.
A null argument counts as not given; of a required one, nothing is found.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from quaymark.operators import prices as P
from quaymark.operators import rates as R
from quaymark.operators import text as T
from quaymark.operators.patterns import EDGE
from quaymark.sources import views as V

_WINDOW = "start STRING DEFAULT NULL COMMENT 'day, month or year; its first day counts', `end` STRING DEFAULT NULL COMMENT 'day, month or year; its last day counts'"
_NEEDED_WINDOW = _WINDOW.replace(" DEFAULT NULL", "")
_TICKERS = "tickers ARRAY<STRING> DEFAULT NULL COMMENT 'all, if not given', exclude ARRAY<STRING> DEFAULT NULL COMMENT 'tickers to leave out'"
_YEAR = "year INT COMMENT 'four digits'"
_WORDS = "pattern STRING DEFAULT NULL COMMENT 'regular expression; or give terms', terms ARRAY<STRING> DEFAULT NULL COMMENT 'any of these', whole_word BOOLEAN DEFAULT true COMMENT 'terms stand alone'"
_PCT = "round((try_divide({0}, {1}) - 1) * 100, 4)"
_ON_DATE = """SELECT ticker, {0}, bar.day = period_end({1}.day) FROM (SELECT b.ticker, max_by(struct(b.day, b.open, b.high, b.low, b.close, b.volume), b.day) AS bar FROM quaymark_bars b
WHERE b.day <= period_end({1}.day) AND in_universe(b.ticker, {1}.tickers, {1}.exclude) GROUP BY b.ticker)"""  # table functions can't call each other
_TOTALS = """count_if(change_bp <> 0) AS changes, count_if(change_bp > 0) AS increases, count_if(change_bp < 0) AS decreases,
round(coalesce(sum(change_bp), 0) / 100.0D, 2) AS net_points, round(coalesce(sum(greatest(change_bp, 0)), 0) / 100.0D, 2) AS up_points, round(coalesce(sum(least(change_bp, 0)), 0) / 100.0D, 2) AS down_points"""
_TOTAL_COLUMNS = "changes BIGINT, increases BIGINT, decreases BIGINT, net_points DOUBLE, up_points DOUBLE, down_points DOUBLE"

#: Scalar helpers: name -> (arguments, type, expression).
SCALARS = {
    "period_start": ("raw STRING", "DATE", r"""CASE WHEN raw IS NULL THEN NULL ELSE coalesce(
        CASE WHEN trim(raw) RLIKE r'^\d{4}$' THEN try_to_date(trim(raw) || '-01-01', 'yyyy-MM-dd') END,
        CASE WHEN trim(raw) RLIKE r'^\d{4}-\d{1,2}$' THEN try_to_date(trim(raw) || '-1', 'yyyy-M-d') END,
        CASE WHEN trim(raw) RLIKE r'^[A-Za-z]{3,9} \d{4}$' THEN try_to_date('1 ' || left(trim(raw), 3) || right(trim(raw), 5), 'd MMM yyyy') END,
        CASE WHEN trim(raw) RLIKE r'^\d{4}-\d{1,2}-\d{1,2}$' THEN try_to_date(trim(raw), 'yyyy-M-d') END,
        CASE WHEN trim(raw) RLIKE r'^\d{1,2} [A-Za-z]{3} \d{4}$' THEN try_to_date(trim(raw), 'd MMM yyyy') END,
        raise_error(raw || ' is no date; write 2019-06-05, 5 Jun 2019, 2019-06, Jun 2019 or 2019')) END"""),
    "period_end": ("raw STRING", "DATE", r"""CASE WHEN trim(raw) RLIKE r'^\d{4}$' THEN date_sub(add_months(period_start(raw), 12), 1)
        WHEN trim(raw) RLIKE r'^\d{4}-\d{1,2}$' OR trim(raw) RLIKE r'^[A-Za-z]{3,9} \d{4}$' THEN last_day(period_start(raw)) ELSE period_start(raw) END"""),
    "in_window": ("day DATE, start STRING, `end` STRING", "BOOLEAN", """CASE WHEN period_start(start) > period_end(`end`) THEN raise_error('the window begins at ' || start || ', after its end ' || `end`)
        ELSE (start IS NULL OR day >= period_start(start)) AND (`end` IS NULL OR day <= period_end(`end`)) END"""),
    "in_universe": ("ticker STRING, tickers ARRAY<STRING>, exclude ARRAY<STRING>", "BOOLEAN", "(tickers IS NULL OR array_contains(tickers, ticker)) AND (exclude IS NULL OR NOT array_contains(exclude, ticker))"),
    "rate_stance": ("net BIGINT", "STRING", "CASE WHEN net > 0 THEN 'net tightening' WHEN net < 0 THEN 'net easing' ELSE 'no net change' END"),
    # Without lambdas, so that the pattern is a constant of the plan: terms are joined by a control character, escaped in one go, and parted again.
    "escaped_terms": ("terms ARRAY<STRING>", "STRING", r"""regexp_replace(regexp_replace(regexp_replace(lower(trim(concat_ws(char(1), terms))), r'\s*(\x01\s*)+', char(1)), r'^\x01|\x01$', ''), r'([^\p{L}\p{N}_ \x01])', r'\\$1')"""),
    "wanted_pattern": ("pattern STRING, terms ARRAY<STRING>, whole_word BOOLEAN", "STRING", rf"""CASE WHEN (pattern IS NULL) = (terms IS NULL) THEN raise_error('give either a pattern or terms') WHEN pattern IS NOT NULL THEN '(?iu)' || pattern
        WHEN escaped_terms(terms) = '' THEN raise_error('no term is left') WHEN whole_word THEN r'(^|{EDGE})(' || replace(escaped_terms(terms), char(1), '|') || r')({EDGE}|$)' ELSE replace(escaped_terms(terms), char(1), '|') END"""),
}

#: Table functions: name -> (what it answers, arguments, columns, body). Arguments are named with their function, so that no column hides them.
TABLES = {
    "rates_coverage": ("How many decisions there are, from when to when.", "", "records BIGINT, first_date DATE, last_date DATE, first_target DOUBLE, last_target DOUBLE", "SELECT * FROM quaymark_rates_coverage"),
    "rates_count": ("Decisions of a window.", _WINDOW, "records BIGINT", "SELECT count(*) FROM quaymark_decisions WHERE in_window(effective, rates_count.start, rates_count.`end`)"),
    "rates_count_changes": ("Changes of a window: how many, up, down, and by how much.", _WINDOW, f"records BIGINT, {_TOTAL_COLUMNS}", f"SELECT count(*) AS records, {_TOTALS} FROM quaymark_decisions WHERE in_window(effective, rates_count_changes.start, rates_count_changes.`end`)"),
    "rates_changes_by_year": ("Changes of a window by year.", _WINDOW, f"year INT, {_TOTAL_COLUMNS}", f"SELECT year(effective) AS year, {_TOTALS} FROM quaymark_decisions WHERE change_bp <> 0 AND in_window(effective, rates_changes_by_year.start, rates_changes_by_year.`end`) GROUP BY year(effective)"),
    "rates_list_changes": ("Every change of a window.", _WINDOW, "effective DATE, change DOUBLE, target DOUBLE, direction STRING", "SELECT * FROM quaymark_changes WHERE in_window(effective, rates_list_changes.start, rates_list_changes.`end`)"),
    "rates_extremes": ("The highest and the lowest target.", "", "extreme STRING, target DOUBLE, records BIGINT, first_date DATE, last_date DATE", "SELECT * FROM quaymark_extremes"),
    "rates_max_hold_streak": ("Gaps between changes, the longest first.", "top INT DEFAULT NULL COMMENT 'ranks up to this'", "rank INT, days INT, start DATE, `end` DATE, held_rate DOUBLE, rate_after DOUBLE, end_change_bp INT, holds INT", "SELECT * FROM quaymark_streaks WHERE rates_max_hold_streak.top IS NULL OR rank <= rates_max_hold_streak.top"),
    "rates_open_streak": ("From the last change to the last decision.", "", "start DATE, `end` DATE, days INT, held_rate DOUBLE", "SELECT * FROM quaymark_open_streak"),
    "rates_lookup_rate": ("The rate in force on a day.", "day STRING COMMENT 'day, month or year; its last day counts'", "requested DATE, effective DATE, target DOUBLE", """SELECT period_end(rates_lookup_rate.day), held.effective, held.target FROM (SELECT max(effective) AS effective, max_by(round(target_bp / 100.0D, 2), effective) AS target FROM quaymark_decisions WHERE effective <= period_end(rates_lookup_rate.day)) held"""),
    "rates_next_change": ("The first change after a day.", "day STRING COMMENT 'day, month or year; its last day counts'", "requested DATE, next_effective DATE, next_change_bp INT", "SELECT period_end(rates_next_change.day), ahead.* FROM (SELECT min(effective), min_by(change_bp, effective) FROM quaymark_decisions WHERE change_bp <> 0 AND effective > period_end(rates_next_change.day)) ahead"),
    "rates_period_summary": ("Changes of a window, and the rate before and after them.", _NEEDED_WINDOW, "records BIGINT, changes BIGINT, increases BIGINT, decreases BIGINT, net_points DOUBLE, first_change DATE, last_change DATE, rate_before DOUBLE, rate_end DOUBLE", """SELECT count_if(inside), count_if(inside AND change_bp <> 0), count_if(inside AND change_bp > 0), count_if(inside AND change_bp < 0), round(coalesce(sum(change_bp) FILTER (WHERE inside), 0) / 100.0D, 2),
        min(effective) FILTER (WHERE inside AND change_bp <> 0), max(effective) FILTER (WHERE inside AND change_bp <> 0), round(max_by(target_bp, effective) FILTER (WHERE effective < edge) / 100.0D, 2), round(max_by(target_bp, effective) FILTER (WHERE begun) / 100.0D, 2)
        FROM (SELECT *, coalesce(min(CASE WHEN inside AND change_bp <> 0 THEN effective END) OVER (), low) AS edge FROM
        (SELECT d.*, in_window(d.effective, rates_period_summary.start, rates_period_summary.`end`) AS inside, period_start(rates_period_summary.start) AS low, d.effective <= period_end(rates_period_summary.`end`) AS begun FROM quaymark_decisions d))"""),
    "rates_compare_periods": ("Changes of two windows side by side.", _NEEDED_WINDOW + ", compare_start STRING COMMENT 'as start', compare_end STRING COMMENT 'as end'", "one_changes BIGINT, one_points DOUBLE, one_stance STRING, other_changes BIGINT, other_points DOUBLE, other_stance STRING, difference_bp BIGINT", """SELECT one_n, round(one_bp / 100.0D, 2), rate_stance(one_bp), other_n, round(other_bp / 100.0D, 2), rate_stance(other_bp), one_bp - other_bp
        FROM (SELECT count_if(one AND change_bp <> 0) AS one_n, coalesce(sum(change_bp) FILTER (WHERE one), 0) AS one_bp, count_if(other AND change_bp <> 0) AS other_n, coalesce(sum(change_bp) FILTER (WHERE other), 0) AS other_bp FROM
        (SELECT change_bp, in_window(effective, rates_compare_periods.start, rates_compare_periods.`end`) AS one, in_window(effective, rates_compare_periods.compare_start, rates_compare_periods.compare_end) AS other FROM quaymark_decisions))"""),
    "prices_coverage": ("Tickers and days that have bars.", "", "tickers BIGINT, min_rows BIGINT, max_rows BIGINT, common_start DATE, common_end DATE, first_day DATE, last_day DATE", "SELECT * FROM quaymark_prices_coverage"),
    "prices_annual_return": ("Return of each ticker in a year.", f"{_YEAR}, {_TICKERS}", "ticker STRING, year INT, n_bars BIGINT, return_pct DOUBLE", "SELECT * FROM quaymark_annual a WHERE a.year = prices_annual_return.year AND in_universe(a.ticker, prices_annual_return.tickers, prices_annual_return.exclude)"),
    "prices_rank_annual_returns": ("A year's tickers by return.", f"{_YEAR}, {_TICKERS}", "ticker STRING, year INT, n_bars BIGINT, return_pct DOUBLE, rank INT, place STRING", """SELECT *, CASE WHEN rank = 1 THEN 'best' WHEN rank = max(rank) OVER () THEN 'worst' ELSE 'between' END AS place
        FROM (SELECT a.*, row_number() OVER (ORDER BY a.return_pct DESC, a.ticker) AS rank FROM quaymark_annual a WHERE a.year = prices_rank_annual_returns.year AND in_universe(a.ticker, prices_rank_annual_returns.tickers, prices_rank_annual_returns.exclude))"""),
    "prices_full_sample_return": ("Tickers by their return over all days.", _TICKERS, "ticker STRING, n_bars BIGINT, return_pct DOUBLE, rank INT", "SELECT ticker, n_bars, return_pct, row_number() OVER (ORDER BY return_pct DESC, ticker) FROM quaymark_full_sample f WHERE in_universe(f.ticker, prices_full_sample_return.tickers, prices_full_sample_return.exclude)"),
    "prices_avg_volume": ("Tickers by their mean volume in a window.", f"{_TICKERS}, {_WINDOW}", "ticker STRING, days BIGINT, mean_volume DOUBLE, total_volume DOUBLE, rank INT", """SELECT *, row_number() OVER (ORDER BY mean_volume DESC, ticker) FROM (SELECT b.ticker, count(*) AS days, round(avg(b.volume), 2) AS mean_volume, round(sum(b.volume), 2) AS total_volume FROM quaymark_bars b
        WHERE in_universe(b.ticker, prices_avg_volume.tickers, prices_avg_volume.exclude) AND in_window(b.day, prices_avg_volume.start, prices_avg_volume.`end`) GROUP BY b.ticker)"""),
    "prices_max_drawdown": ("Tickers by their deepest fall below the peak so far in a window.", f"{_TICKERS}, {_WINDOW}, top INT DEFAULT NULL COMMENT 'ranks up to this'", "ticker STRING, drawdown_pct DOUBLE, peak_day DATE, trough_day DATE, rank INT", """SELECT * FROM (SELECT ticker, round(w.fall, 4) AS drawdown_pct, w.peak_day AS peak_day, w.day AS trough_day, row_number() OVER (ORDER BY round(w.fall, 4), ticker) AS rank FROM
        (SELECT ticker, min(struct(least(0.0D, (try_divide(close, peak.close) - 1) * 100) AS fall, day, date_from_unix_date(-peak.since) AS peak_day)) AS w FROM
        (SELECT b.*, max(struct(b.close AS close, -unix_date(b.day) AS since)) OVER (PARTITION BY b.ticker ORDER BY b.day) AS peak FROM quaymark_bars b
        WHERE in_universe(b.ticker, prices_max_drawdown.tickers, prices_max_drawdown.exclude) AND in_window(b.day, prices_max_drawdown.start, prices_max_drawdown.`end`)) GROUP BY ticker HAVING count(*) >= 2))
        WHERE prices_max_drawdown.top IS NULL OR rank <= prices_max_drawdown.top"""),
    "prices_volatility": ("Deviation of daily returns.", f"{_TICKERS}, year INT DEFAULT NULL COMMENT 'four digits', annualised BOOLEAN DEFAULT true COMMENT 'times the root of a year of sessions'", "ticker STRING, n_bars BIGINT, volatility_pct DOUBLE", f"""SELECT ticker, count(ret) + 1, round(stddev_samp(ret) * CASE WHEN prices_volatility.annualised THEN sqrt({P.SESSIONS_A_YEAR}.0D) ELSE 1.0D END, 4) FROM
        (SELECT b.ticker, (try_divide(b.close, lag(b.close) OVER (PARTITION BY b.ticker ORDER BY b.day)) - 1) * 100 AS ret FROM quaymark_bars b WHERE in_universe(b.ticker, prices_volatility.tickers, prices_volatility.exclude) AND (prices_volatility.year IS NULL OR year(b.day) = prices_volatility.year))
        GROUP BY ticker HAVING count(ret) >= 2"""),
    "prices_correlation": ("Pearson's correlation of two tickers' daily returns.", f"one STRING COMMENT 'ticker', other STRING COMMENT 'another ticker', {_WINDOW}", "shared_days BIGINT, correlation DOUBLE", f"""SELECT count(*), CASE WHEN count(*) >= 3 THEN round(corr(a, b), 6) END FROM (SELECT max(ret) FILTER (WHERE is_one) AS a, max(ret) FILTER (WHERE NOT is_one) AS b FROM
        (SELECT b.ticker = prices_correlation.one AS is_one, b.day, (try_divide(b.close, lag(b.close) OVER (PARTITION BY b.ticker ORDER BY b.day)) - 1) * 100 AS ret FROM quaymark_bars b WHERE b.ticker IN (prices_correlation.one, prices_correlation.other) AND in_window(b.day, prices_correlation.start, prices_correlation.`end`))
        GROUP BY day) WHERE a IS NOT NULL AND b IS NOT NULL"""),
    "prices_price_on_date": ("Each ticker's bar of a day, or else the last one before.", f"day STRING COMMENT 'day, month or year; its last day counts', {_TICKERS}", "ticker STRING, used_day DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE, exact BOOLEAN", _ON_DATE.format("bar.*", "prices_price_on_date")),
    "prices_close_on": ("Each ticker's close of a day, or else the last one before.", f"day STRING COMMENT 'day, month or year; its last day counts', {_TICKERS}", "ticker STRING, close DOUBLE, used_day DATE, exact BOOLEAN", _ON_DATE.format("bar.close, bar.day", "prices_close_on")),
    "prices_event_window": ("Return from a day to some sessions, or some calendar days, after it.", f"day STRING COMMENT 'day, month or year; its last day counts', sessions INT DEFAULT NULL COMMENT 'or give days', days INT DEFAULT NULL COMMENT 'or give sessions', {_TICKERS}", "ticker STRING, start_day DATE, end_day DATE, return_pct DOUBLE", f"""SELECT ticker, start_day, end_day, {_PCT.format('b', 'a')} FROM
        (SELECT b.ticker, max_by(b.close, b.day) FILTER (WHERE b.day <= w.event) AS a, max(b.day) FILTER (WHERE b.day <= w.event) AS start_day, max_by(b.close, b.day) AS b, max(b.day) AS end_day FROM
        (SELECT * FROM quaymark_bars q WHERE in_universe(q.ticker, prices_event_window.tickers, prices_event_window.exclude)) b JOIN
        (SELECT event, CASE WHEN (sessions IS NULL) = (days IS NULL) THEN raise_error('give either sessions or days') WHEN event < low THEN NULL WHEN days IS NULL THEN nth_day WHEN date_add(event, days) <= high THEN date_add(event, days) END AS until FROM
        (SELECT event, sessions, days, min(day) AS low, max(day) AS high, min(CASE WHEN nth = sessions THEN day END) AS nth_day FROM
        (SELECT s.day, s.event, s.sessions, s.days, count_if(s.day > s.event) OVER (ORDER BY s.day) AS nth FROM (SELECT t.day, period_end(prices_event_window.day) AS event, prices_event_window.sessions AS sessions, prices_event_window.days AS days FROM quaymark_sessions t) s) GROUP BY event, sessions, days)) w
        ON b.day <= w.until GROUP BY b.ticker) WHERE a IS NOT NULL"""),
    "prices_window_return": ("Return between the closes in force at both ends of a window.", f"{_NEEDED_WINDOW}, {_TICKERS}", "ticker STRING, start_day DATE, end_day DATE, return_pct DOUBLE", f"""SELECT ticker, start_day, end_day, {_PCT.format('b', 'a')} FROM (SELECT ticker,
        max_by(close, day) FILTER (WHERE early) AS a, max(day) FILTER (WHERE early) AS start_day, max_by(close, day) AS b, max(day) AS end_day FROM (SELECT b.*, b.day <= period_start(prices_window_return.start) AS early FROM quaymark_bars b
        WHERE in_window(b.day, CASE WHEN period_start(prices_window_return.start) >= period_end(prices_window_return.`end`) THEN raise_error('a window must begin before it ends') END, prices_window_return.`end`) AND in_universe(b.ticker, prices_window_return.tickers, prices_window_return.exclude)) GROUP BY ticker) WHERE a IS NOT NULL"""),
    "prices_basket_tickers": ("The tickers that have bars, without those that a basket leaves out.", "exclude ARRAY<STRING> DEFAULT NULL COMMENT 'tickers to leave out'", "ticker STRING", "SELECT b.ticker FROM quaymark_basket b WHERE in_universe(b.ticker, NULL, prices_basket_tickers.exclude)"),
    "text_coverage": ("Articles, dated or not.", "", "total BIGINT, dated BIGINT, undated BIGINT, first_day DATE, last_day DATE", "SELECT * FROM quaymark_text_coverage"),
    "text_count": ("Articles that match, and their share of all.", f"{_WORDS}, year INT DEFAULT NULL COMMENT 'four digits', month INT DEFAULT NULL COMMENT '1 to 12', {_WINDOW}", "matches BIGINT, total BIGINT, share_pct DOUBLE", """SELECT matches, total, round(100.0D * matches / nullif(total, 0), 4) FROM (SELECT count_if(found) AS matches, count(*) AS total FROM (SELECT (text_count.year IS NULL OR year(publication) = text_count.year) AND (text_count.month IS NULL OR month(publication) = text_count.month)
        AND in_window(publication, text_count.start, text_count.`end`) AND blob RLIKE wanted_pattern(text_count.pattern, text_count.terms, text_count.whole_word) AS found FROM quaymark_articles))"""),
    "text_share": ("Articles that match, and their share of all or of a year's.", f"{_WORDS}, year INT DEFAULT NULL COMMENT 'four digits'", "matches BIGINT, total BIGINT, share_pct DOUBLE", """SELECT matches, total, round(100.0D * matches / nullif(total, 0), 4) FROM (SELECT count_if(found) AS matches, count(*) AS total
        FROM (SELECT blob RLIKE wanted_pattern(text_share.pattern, text_share.terms, text_share.whole_word) AS found FROM quaymark_articles WHERE text_share.year IS NULL OR year(publication) = text_share.year))"""),
    "text_count_by_year": ("Articles that match by year, the peak marked.", _WORDS, "year INT, matches BIGINT, peak BOOLEAN", """SELECT year, matches, row_number() OVER (ORDER BY matches DESC, year) = 1 FROM (SELECT year(publication) AS year, count(*) AS matches FROM quaymark_articles
        WHERE publication IS NOT NULL AND blob RLIKE wanted_pattern(text_count_by_year.pattern, text_count_by_year.terms, text_count_by_year.whole_word) GROUP BY year(publication))"""),
    "text_count_by_month": ("Articles that match by month, the peak marked.", f"{_WORDS}, year INT DEFAULT NULL COMMENT 'four digits'", "month STRING, matches BIGINT, peak BOOLEAN", """SELECT month, matches, row_number() OVER (ORDER BY matches DESC, month DESC) = 1 FROM (SELECT date_format(publication, 'yyyy-MM') AS month, count(*) AS matches FROM quaymark_articles
        WHERE publication IS NOT NULL AND (text_count_by_month.year IS NULL OR year(publication) = text_count_by_month.year) AND blob RLIKE wanted_pattern(text_count_by_month.pattern, text_count_by_month.terms, text_count_by_month.whole_word) GROUP BY date_format(publication, 'yyyy-MM'))"""),
}


def register(spark: SparkSession, sf_dir: str, left_out: Sequence[str] = ("5-LOW",)) -> list[str]:
    """Make the functions of this session answer from a folder of tables, and return the names of those that give tables. Registering again, for another folder, leaves DataFrames that are already made as they are. left_out: tickers that a basket leaves out."""
    decisions, bars, articles = V.decisions(spark, sf_dir), V.bars(spark, sf_dir), V.articles(spark, sf_dir)
    views = {
        "decisions": decisions, "bars": bars, "articles": articles, "rates_coverage": R.coverage(decisions), "changes": R.list_changes(decisions), "extremes": R.extremes(decisions), "streaks": R.hold_streaks(decisions),
        "open_streak": R.open_streak(decisions), "prices_coverage": P.coverage(bars), "annual": P.annual_returns(bars), "full_sample": P.full_sample_returns(bars).drop("rank"), "text_coverage": T.coverage(articles),
        "sessions": P.sessions(bars), "basket": P.universe(bars, None, left_out).select("ticker").distinct(),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(f"quaymark_{name}")
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    for name, (about, arguments, columns, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE ({columns}) COMMENT '{about.replace(chr(39), chr(39) * 2)}' RETURN {body}")
    return sorted(TABLES)
