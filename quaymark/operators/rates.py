"""Questions about a step-function series of rate decisions (effective, target_bp, change_bp)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quaymark.functions import dates


def _by_date() -> WindowSpec:
    return Window.orderBy("effective")  # decisions are a dimension: a row a month


def points(bp: Column) -> Column:
    """Basis points as percentage points."""
    return F.round(bp / 100.0, 2)


def within(decisions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the closed window, whose bounds may be days, months or years; a bound that is missing doesn't bind."""
    low, high = dates.window(start, end)
    kept = decisions if low is None else decisions.where(F.col("effective") >= F.lit(low))
    return kept if high is None else kept.where(F.col("effective") <= F.lit(high))


def coverage(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count("*").alias("records"), F.min("effective").alias("first_date"), F.max("effective").alias("last_date"), points(F.min_by("target_bp", "effective")).alias("first_target"), points(F.max_by("target_bp", "effective")).alias("last_target"))


def count(decisions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return within(decisions, start, end).agg(F.count("*").alias("records"))


def _totals() -> list[Column]:
    bp = F.col("change_bp")
    return [
        F.count_if(bp != 0).alias("changes"), F.count_if(bp > 0).alias("increases"), F.count_if(bp < 0).alias("decreases"),
        points(F.coalesce(F.sum(bp), F.lit(0))).alias("net_points"), points(F.coalesce(F.sum(F.greatest(bp, F.lit(0))), F.lit(0))).alias("up_points"), points(F.coalesce(F.sum(F.least(bp, F.lit(0))), F.lit(0))).alias("down_points"),
    ]


def changes(decisions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return within(decisions, start, end).agg(F.count("*").alias("records"), *_totals())


def changes_by_year(decisions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return within(decisions, start, end).where("change_bp <> 0").groupBy(F.year("effective").alias("year")).agg(*_totals()).orderBy("year")


def list_changes(decisions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    direction = F.when(F.col("change_bp") > 0, "up").otherwise("down")
    return within(decisions, start, end).where("change_bp <> 0").select("effective", points(F.col("change_bp")).alias("change"), points(F.col("target_bp")).alias("target"), direction.alias("direction"))


def extremes(decisions: DataFrame) -> DataFrame:
    """The highest and the lowest target, how many rows stand at it, the first and the last date."""
    each = decisions.groupBy("target_bp").agg(F.count("*").alias("records"), F.min("effective").alias("first_date"), F.max("effective").alias("last_date"))
    ends = decisions.agg(F.max("target_bp").alias("highest"), F.min("target_bp").alias("lowest"))
    sides = ends.select(F.explode(F.array(F.struct(F.lit("highest").alias("extreme"), F.col("highest").alias("target_bp")), F.struct(F.lit("lowest").alias("extreme"), F.col("lowest").alias("target_bp")))).alias("x")).select("x.extreme", "x.target_bp")
    return sides.join(each, "target_bp").select("extreme", points(F.col("target_bp")).alias("target"), "records", "first_date", "last_date")


def hold_streaks(decisions: DataFrame, top: int | None = None) -> DataFrame:
    """Gaps between consecutive changes, longest first, earliest among equals; holds are the decisions within."""
    numbered = decisions.withColumn("seen", F.row_number().over(_by_date()))
    moved = numbered.where("change_bp <> 0")
    ahead = moved.select(F.col("effective").alias("start"), F.lead("effective").over(_by_date()).alias("end"), F.col("target_bp"), F.lead("target_bp").over(_by_date()).alias("after_bp"), F.lead("change_bp").over(_by_date()).alias("end_change_bp"), (F.lead("seen").over(_by_date()) - F.col("seen") - 1).alias("holds"))
    gaps = ahead.where("end is not null").withColumn("days", F.datediff("end", "start"))
    ranked = gaps.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("days"), "start")))
    kept = ranked if top is None else ranked.where(F.col("rank") <= top)
    return kept.select("rank", "days", "start", "end", points(F.col("target_bp")).alias("held_rate"), points(F.col("after_bp")).alias("rate_after"), "end_change_bp", "holds")


def open_streak(decisions: DataFrame) -> DataFrame:
    """From the last change to the last row; never ranked."""
    last = decisions.agg(F.max(F.when(F.col("change_bp") != 0, F.col("effective"))).alias("start"), F.max("effective").alias("end"), F.max_by("target_bp", "effective").alias("bp"))
    return last.select("start", "end", F.datediff("end", "start").alias("days"), points(F.col("bp")).alias("held_rate"))


def as_of(requests: DataFrame, decisions: DataFrame, date_col: str = "requested") -> DataFrame:
    """Requests with the decision in force: the last one on or before the date, never a later one; null before the first. Decisions are a dimension: their spans go to the requests, however many these are."""
    spans = decisions.select("effective", points(F.col("target_bp")).alias("target"), F.lead("effective").over(_by_date()).alias("until"))
    held = (F.col(date_col) >= F.col("effective")) & (F.col("until").isNull() | (F.col(date_col) < F.col("until")))
    return requests.select(date_col).join(F.broadcast(spans), held, "left").select(date_col, "effective", "target")


def next_change(requests: DataFrame, decisions: DataFrame, date_col: str = "requested") -> DataFrame:
    """Requests with the first change after the date."""
    moved = decisions.where("change_bp <> 0")
    spans = moved.select(F.col("effective").alias("next_effective"), F.col("change_bp").alias("next_change_bp"), F.lag("effective").over(_by_date()).alias("since"))
    ahead = (F.col(date_col) < F.col("next_effective")) & (F.col("since").isNull() | (F.col(date_col) >= F.col("since")))
    return requests.select(date_col).join(F.broadcast(spans), ahead, "left").select(date_col, "next_effective", "next_change_bp")


def period_summary(decisions: DataFrame, start: str, end: str) -> DataFrame:
    """Counts of the window, the rate before its first change (before its begin if it has none), at its end, and its first and last change."""
    first = within(decisions, start, end).where("change_bp <> 0").agg(F.min("effective").alias("first_change"), F.max("effective").alias("last_change"))
    total = within(decisions, start, end).agg(F.count("*").alias("records"), *_totals())
    edge = F.coalesce("first_change", F.lit(dates.bound(start)))
    levels = decisions.join(F.broadcast(first), F.lit(True)).groupBy("first_change", "last_change").agg(F.max_by("target_bp", F.when(F.col("effective") < edge, F.col("effective"))).alias("before_bp"), F.max_by("target_bp", F.when(F.col("effective") <= F.lit(dates.bound(end, upper=True)), F.col("effective"))).alias("end_bp"))
    return total.join(levels, F.lit(True)).select("records", "changes", "increases", "decreases", "net_points", "first_change", "last_change", points(F.col("before_bp")).alias("rate_before"), points(F.col("end_bp")).alias("rate_end"))


def stance(net: Column) -> Column:
    return F.when(net > 0, "net tightening").when(net < 0, "net easing").otherwise("no net change")


def compare_periods(decisions: DataFrame, one: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    def side(window: tuple[str, str], name: str) -> DataFrame:
        got = within(decisions, *window).agg(F.coalesce(F.sum("change_bp"), F.lit(0)).alias("bp"), F.count_if(F.col("change_bp") != 0).alias("n"))
        return got.select(F.col("n").alias(f"{name}_changes"), points(F.col("bp")).alias(f"{name}_points"), stance(F.col("bp")).alias(f"{name}_stance"), F.col("bp").alias(f"{name}_bp"))

    both = side(one, "one").join(side(other, "other"), F.lit(True))  # one row each
    return both.withColumn("difference_bp", F.col("one_bp") - F.col("other_bp")).drop("one_bp", "other_bp")
