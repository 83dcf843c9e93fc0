"""Rate questions over monthly decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymark.operators import rates as R
from quaymark.plans.catalogue import register
from quaymark.sources import views as V

FROM, TO = "1997-02-01", "1999-10-31"
ONE, OTHER = ("1996-01-01", "1997-12-31"), ("1998-01-01", "1999-12-31")
_TOTALS = """count(*) FILTER (change_bp <> 0) AS changes, count(*) FILTER (change_bp > 0) AS increases, count(*) FILTER (change_bp < 0) AS decreases,
 round(coalesce(sum(change_bp), 0) / 100.0, 2) AS net_points, round(coalesce(sum(greatest(change_bp, 0)), 0) / 100.0, 2) AS up_points, round(coalesce(sum(least(change_bp, 0)), 0) / 100.0, 2) AS down_points"""
_D = V.with_(V.DECISIONS)
_IN = f"effective BETWEEN DATE '{FROM}' AND DATE '{TO}'"


def _ask(spark, sf_dir):
    """Requested dates: every day on which an order was placed, and one before all."""
    days = V.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("requested")).distinct()
    return days.union(spark.sql("select date'1990-01-01' as requested"))


_ASK = "ask AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS requested FROM orders UNION ALL SELECT DATE '1990-01-01')"

register("rate_coverage", _D + "SELECT count(*) AS records, min(effective) AS first_date, max(effective) AS last_date, round(arg_min(target_bp, effective) / 100.0, 2) AS first_target, round(arg_max(target_bp, effective) / 100.0, 2) AS last_target FROM decisions")(lambda s, d: R.coverage(V.decisions(s, d)))
register("rate_count", _D + f"SELECT count(*) AS records FROM decisions WHERE {_IN}")(lambda s, d: R.count(V.decisions(s, d), FROM, TO))
register("rate_changes", _D + f"SELECT count(*) AS records, {_TOTALS} FROM decisions WHERE {_IN}")(lambda s, d: R.changes(V.decisions(s, d), FROM, TO))
register("rate_changes_by_year", _D + f"SELECT year(effective) AS year, {_TOTALS} FROM decisions WHERE change_bp <> 0 GROUP BY 1")(lambda s, d: R.changes_by_year(V.decisions(s, d)))
register("rate_increases", _D + f"SELECT increases, up_points FROM (SELECT {_TOTALS} FROM decisions)")(lambda s, d: R.changes(V.decisions(s, d)).select("increases", "up_points"))
register("rate_decreases", _D + f"SELECT decreases, down_points FROM (SELECT {_TOTALS} FROM decisions)")(lambda s, d: R.changes(V.decisions(s, d)).select("decreases", "down_points"))
register("rate_list_changes", _D + f"SELECT effective, round(change_bp / 100.0, 2) AS change, round(target_bp / 100.0, 2) AS target, CASE WHEN change_bp > 0 THEN 'up' ELSE 'down' END AS direction FROM decisions WHERE change_bp <> 0 AND {_IN}")(lambda s, d: R.list_changes(V.decisions(s, d), FROM, TO))
register("rate_extremes", _D + "SELECT extreme, round(target_bp / 100.0, 2) AS target, count(*) AS records, min(effective) AS first_date, max(effective) AS last_date FROM (SELECT 'highest' AS extreme, * FROM decisions WHERE target_bp = (SELECT max(target_bp) FROM decisions) UNION ALL SELECT 'lowest', * FROM decisions WHERE target_bp = (SELECT min(target_bp) FROM decisions)) GROUP BY extreme, target_bp")(lambda s, d: R.extremes(V.decisions(s, d)))

_STREAKS = (
    _D
    + """, n AS (SELECT *, row_number() OVER (ORDER BY effective) AS seen FROM decisions),
m AS (SELECT effective AS start, lead(effective) OVER w AS "end", target_bp, lead(target_bp) OVER w AS after_bp, lead(change_bp) OVER w AS end_change_bp, lead(seen) OVER w - seen - 1 AS holds FROM n WHERE change_bp <> 0 WINDOW w AS (ORDER BY effective)),
r AS (SELECT row_number() OVER (ORDER BY "end" - start DESC, start) AS rank, CAST("end" - start AS INTEGER) AS days, start, "end", round(target_bp / 100.0, 2) AS held_rate, round(after_bp / 100.0, 2) AS rate_after, end_change_bp, holds FROM m WHERE "end" IS NOT NULL)
SELECT * FROM r"""
)
register("hold_streaks", _STREAKS)(lambda s, d: R.hold_streaks(V.decisions(s, d)))
register("hold_streaks_top3", _STREAKS + " WHERE rank <= 3")(lambda s, d: R.hold_streaks(V.decisions(s, d), 3))
register("hold_open_streak", _D + """SELECT max(effective) FILTER (change_bp <> 0) AS start, max(effective) AS "end", CAST(max(effective) - max(effective) FILTER (change_bp <> 0) AS INTEGER) AS days, round(arg_max(target_bp, effective) / 100.0, 2) AS held_rate FROM decisions""")(lambda s, d: R.open_streak(V.decisions(s, d)))
register("asof_rate", V.with_(V.DECISIONS, _ASK) + "SELECT requested, effective, round(target_bp / 100.0, 2) AS target FROM ask ASOF LEFT JOIN decisions ON requested >= effective")(lambda s, d: R.as_of(_ask(s, d), V.decisions(s, d)))
register("asof_next_change", V.with_(V.DECISIONS, _ASK) + "SELECT requested, effective AS next_effective, change_bp AS next_change_bp FROM ask ASOF LEFT JOIN (SELECT * FROM decisions WHERE change_bp <> 0) c ON requested < c.effective")(lambda s, d: R.next_change(_ask(s, d), V.decisions(s, d)))
register("rate_period_summary", _D + f""", f AS (SELECT min(effective) AS first_change, max(effective) AS last_change FROM decisions WHERE change_bp <> 0 AND {_IN}),
t AS (SELECT count(*) AS records, {_TOTALS} FROM decisions WHERE {_IN})
SELECT records, changes, increases, decreases, net_points, first_change, last_change,
 (SELECT round(arg_max(target_bp, effective) / 100.0, 2) FROM decisions WHERE effective < coalesce(first_change, DATE '{FROM}')) AS rate_before,
 (SELECT round(arg_max(target_bp, effective) / 100.0, 2) FROM decisions WHERE effective <= DATE '{TO}') AS rate_end FROM t, f""")(lambda s, d: R.period_summary(V.decisions(s, d), FROM, TO))


def _side(name: str, window: tuple[str, str]) -> str:
    return f"SELECT count(*) FILTER (change_bp <> 0) AS {name}_changes, round(coalesce(sum(change_bp), 0) / 100.0, 2) AS {name}_points, CASE WHEN sum(change_bp) > 0 THEN 'net tightening' WHEN sum(change_bp) < 0 THEN 'net easing' ELSE 'no net change' END AS {name}_stance, coalesce(sum(change_bp), 0) AS {name}_bp FROM decisions WHERE effective BETWEEN DATE '{window[0]}' AND DATE '{window[1]}'"


register("rate_compare_periods", _D + f"SELECT one_changes, one_points, one_stance, other_changes, other_points, other_stance, CAST(one_bp - other_bp AS BIGINT) AS difference_bp FROM ({_side('one', ONE)}), ({_side('other', OTHER)})")(lambda s, d: R.compare_periods(V.decisions(s, d), ONE, OTHER))


# Date words stand for their whole periods; the SQL spells them out.
register("rate_count_words", _D + """SELECT 'year' AS asked, count(*) AS records FROM decisions WHERE effective BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' UNION ALL SELECT 'month', count(*) FROM decisions WHERE effective BETWEEN DATE '1997-06-01' AND DATE '1997-06-30'
UNION ALL SELECT 'months', count(*) FROM decisions WHERE effective BETWEEN DATE '1996-02-01' AND DATE '1997-06-30' UNION ALL SELECT 'days', count(*) FROM decisions WHERE effective BETWEEN DATE '1996-02-01' AND DATE '1997-06-01'""")(
    lambda s, d: (lambda x: R.count(x, "1996", "1996").select(F.lit("year").alias("asked"), "records").union(R.count(x, "Jun 1997", "June 1997").select(F.lit("month"), "records")).union(R.count(x, "1996-02", "Jun. 1997").select(F.lit("months"), "records")).union(R.count(x, "1 Feb 1996", "June 1, 1997").select(F.lit("days"), "records")))(V.decisions(s, d))
)
