"""Questions about daily bars (ticker, day, open, high, low, close, volume)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quaymark.functions import dates
from quaymark.operators import ranks

SESSIONS_A_YEAR = 252


def _by_day() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("day")


def pct(new: Column, old: Column) -> Column:
    return (F.try_divide(new, old) - 1) * 100


def within(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the closed window, whose bounds may be days, months or years."""
    low, high = dates.window(start, end)
    kept = bars if low is None else bars.where(F.col("day") >= F.lit(low))
    return kept if high is None else kept.where(F.col("day") <= F.lit(high))


def universe(bars: DataFrame, tickers: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """Bars of the tickers that are wanted; names that are excluded in vain do no harm."""
    kept = bars if not tickers else bars.where(F.col("ticker").isin(list(tickers)))
    return kept.where(~F.col("ticker").isin(list(exclude))) if exclude else kept


def coverage(bars: DataFrame) -> DataFrame:
    each = bars.groupBy("ticker").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))
    return each.agg(F.count("*").alias("tickers"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.max("first").alias("common_start"), F.min("last").alias("common_end"), F.min("first").alias("first_day"), F.max("last").alias("last_day"))


def sessions(bars: DataFrame) -> DataFrame:
    return bars.select("day").distinct()


def daily_returns(bars: DataFrame) -> DataFrame:
    before = F.lag("close").over(_by_day())
    return bars.select("ticker", "day", pct(F.col("close"), before).alias("ret")).where("ret is not null")


def _first_to_last(bars: DataFrame, *keys: str) -> DataFrame:
    """Return in percent from the first to the last close of each group; groups of one bar have none."""
    both = bars.groupBy("ticker", *keys).agg(F.count("*").alias("n_bars"), F.min_by("close", "day").alias("first_close"), F.max_by("close", "day").alias("last_close"))
    return both.where("n_bars >= 2").select("ticker", *keys, "n_bars", F.round(pct(F.col("last_close"), F.col("first_close")), 4).alias("return_pct"))


def annual_returns(bars: DataFrame) -> DataFrame:
    return _first_to_last(bars.withColumn("year", F.year("day")), "year")


def ranked(returns: DataFrame, value: str, *keys: str, ascending: bool = False) -> DataFrame:
    """Rank by the rounded value, 1 to n; ties stay in ticker order."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    return returns.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order, "ticker")))


def rank_annual_returns(bars: DataFrame) -> DataFrame:
    """Every year's tickers by return, the best and the worst marked."""
    rows = ranked(annual_returns(bars), "return_pct", "year")
    last = F.max("rank").over(Window.partitionBy("year"))
    return rows.withColumn("place", F.when(F.col("rank") == 1, "best").when(F.col("rank") == last, "worst").otherwise("between"))


def full_sample_returns(bars: DataFrame) -> DataFrame:
    return ranked(_first_to_last(bars), "return_pct")


def basket_returns(bars: DataFrame) -> DataFrame:
    """The mean, by year, of the constituents' returns as rounded."""
    return annual_returns(bars).groupBy("year").agg(F.count("*").alias("constituents"), F.round(F.avg("return_pct"), 4).alias("basket_pct"))


def volume_stats(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    stats = within(bars, start, end).groupBy("ticker").agg(F.count("*").alias("days"), F.round(F.avg("volume"), 2).alias("mean_volume"), F.round(F.sum("volume"), 2).alias("total_volume"))
    return ranked(stats, "mean_volume")


def volatility(bars: DataFrame, year: int | None = None, annualised: bool = True) -> DataFrame:
    """Sample deviation of daily returns; a year is cut out before returns are taken, so its first bar has none."""
    kept = bars if year is None else bars.where(F.year("day") == year)
    spread = daily_returns(kept).groupBy("ticker").agg((F.count("*") + 1).alias("n_bars"), F.stddev_samp("ret").alias("sd")).where("n_bars >= 3")
    return spread.select("ticker", "n_bars", F.round(F.col("sd") * (SESSIONS_A_YEAR**0.5 if annualised else 1.0), 4).alias("volatility_pct"))


def correlation(bars: DataFrame, one: str, other: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Pearson's, over the days that both tickers have returns of; null below three."""
    kept = daily_returns(within(bars, start, end))
    pair = kept.where(F.col("ticker") == one).select("day", F.col("ret").alias("a")).join(kept.where(F.col("ticker") == other).select("day", F.col("ret").alias("b")), "day")
    return pair.agg(F.count("*").alias("shared_days"), F.when(F.count("*") >= 3, F.round(F.corr("a", "b"), 6)).alias("correlation"))


def running_peak(bars: DataFrame) -> DataFrame:
    """Each bar with the highest close so far; of equal peaks the earliest day counts."""
    so_far = _by_day().rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(F.struct("close", -F.unix_date("day"))).over(so_far)
    return bars.withColumn("peak", peak).select("ticker", "day", "close", F.col("peak.close").alias("peak_close"), F.date_from_unix_date(-F.col("peak")["col2"]).alias("peak_day"))


def max_drawdown(bars: DataFrame, start: str | None = None, end: str | None = None, top: int | None = None) -> DataFrame:
    """The deepest fall below the peak so far; the earliest of equal troughs; 0 at the first day if there was none. Tickers of one bar are left out."""
    falls = running_peak(within(bars, start, end)).withColumn("fall", F.least(F.lit(0.0), pct(F.col("close"), F.col("peak_close"))))
    worst = falls.groupBy("ticker").agg(F.count("*").alias("n"), F.min(F.struct("fall", "day", "peak_day")).alias("w")).where("n >= 2")
    rows = ranked(worst.select("ticker", F.round("w.fall", 4).alias("drawdown_pct"), F.col("w.peak_day").alias("peak_day"), F.col("w.day").alias("trough_day")), "drawdown_pct", ascending=True)
    return rows if top is None else rows.where(F.col("rank") <= top)


def as_of_bars(requests: DataFrame, bars: DataFrame, date_col: str = "requested") -> DataFrame:
    """Requests (ticker, date, ...) with the bar of that day or else the last one before, as a struct `bar`. Both sides may be large, and a ticker may hold most of either."""
    extra = [c for c in requests.columns if c not in ("ticker", date_col)]
    known = bars.select("ticker", F.col("day").alias("at"), F.lit(0).alias("side"), F.struct(*[c for c in bars.columns if c != "ticker"]).alias("own"), F.lit(None).cast("date").alias(date_col), *[F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in extra])
    asked = requests.select("ticker", F.col(date_col).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(known.schema["own"].dataType).alias("own"), date_col, *extra)
    found = ranks.last_known(known.union(asked), ["ticker"], ["at", "side"], "own", "bar")
    return found.where("side = 1").select("ticker", date_col, *extra, "bar")


def close_as_of(requests: DataFrame, bars: DataFrame, date_col: str = "requested") -> DataFrame:
    found = as_of_bars(requests, bars, date_col)
    return found.select("ticker", date_col, F.col("bar.close").alias("close"), F.col("bar.day").alias("used_day"), (F.col("bar.day") == F.col(date_col)).alias("exact"))


def price_on_date(bars: DataFrame, day: str) -> DataFrame:
    """Every ticker's bar of a day, or the last one before; tickers with none are left out."""
    last = within(bars, end=day).groupBy("ticker").agg(F.max_by(F.struct("day", "open", "high", "low", "close", "volume"), "day").alias("bar"))
    return last.select("ticker", "bar.*").withColumn("exact", F.col("day") == F.lit(dates.bound(day, upper=True))).withColumnRenamed("day", "used_day")


def window_returns(bars: DataFrame, windows: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Per window (key, start, end) and ticker the return between the closes in force at both ends. Both ends may fall on one bar, which gives 0."""
    tickers = bars.select("ticker").distinct()
    ends = windows.select("key", F.explode(F.array(F.struct(F.lit("a").alias("which"), F.col(start).alias("requested")), F.struct(F.lit("b").alias("which"), F.col(end).alias("requested")))).alias("x")).select("key", "x.which", "x.requested")
    # Some tickers times some windows: both are dimensions.
    found = as_of_bars(tickers.join(ends, F.lit(True)), bars, "requested")
    both = found.groupBy("key", "ticker").agg(F.max(F.when(F.col("which") == "a", F.col("bar.close"))).alias("a"), F.max(F.when(F.col("which") == "b", F.col("bar.close"))).alias("b"), F.max(F.when(F.col("which") == "a", F.col("bar.day"))).alias("start_day"), F.max(F.when(F.col("which") == "b", F.col("bar.day"))).alias("end_day"))
    return both.where("a is not null").select("key", "ticker", "start_day", "end_day", F.round(pct(F.col("b"), F.col("a")), 4).alias("return_pct"))


def direction(value: Column) -> Column:
    return F.when(value > 0, "up").when(value < 0, "down").otherwise("flat")


def basket_of(windows: DataFrame) -> DataFrame:
    """Mean of the rounded returns of each window, and its direction."""
    mean = windows.groupBy("key").agg(F.count("*").alias("constituents"), F.round(F.avg("return_pct"), 4).alias("basket_pct"))
    return mean.withColumn("direction", direction(F.col("basket_pct")))


def session_windows(bars: DataFrame, events: DataFrame, n: int) -> DataFrame:
    """Events (event_day) with the n-th session after each; events with too few sessions left or outside the data go."""
    numbered = sessions(bars).withColumn("seq", F.row_number().over(Window.orderBy("day")))  # a row a session: a dimension
    after = events.join(F.broadcast(numbered), F.col("day") > F.col("event_day")).groupBy("event_day").agg(F.min("seq").alias("next"))
    first = numbered.agg(F.min("day").alias("first_day"))
    ends = numbered.select((F.col("seq") - n + 1).alias("next"), F.col("day").alias("end"))
    kept = after.join(ends, "next").join(F.broadcast(first), F.col("event_day") >= F.col("first_day"))
    return kept.select(F.col("event_day").alias("key"), F.col("event_day").alias("start"), "end")


def calendar_windows(bars: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """Events with the date some calendar days on; those that end past the last session or begin before the first go."""
    ends = bars.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    rows = events.select(F.col("event_day").alias("key"), F.col("event_day").alias("start"), F.date_add("event_day", days).alias("end"))
    return rows.join(F.broadcast(ends), (F.col("end") <= F.col("last_day")) & (F.col("start") >= F.col("first_day"))).select("key", "start", "end")


def sessions_inside(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """How many sessions each window holds after its begin."""
    return windows.join(F.broadcast(sessions(bars)), (F.col("day") > F.col("start")) & (F.col("day") <= F.col("end"))).groupBy("key").agg(F.count("*").alias("sessions"))


def normalise_ticker(raw: Column, suffix: str = ".AX") -> Column:
    up = F.upper(F.trim(raw))
    return F.when(up.endswith(suffix), up).otherwise(F.concat(up, F.lit(suffix)))


def resolve(requests: DataFrame, aliases: DataFrame, name_col: str = "name") -> DataFrame:
    """Requests with their ticker: by symbol first, then by lower-cased company name; null if neither is known."""
    key = F.lower(F.trim(F.col(name_col)))
    by_symbol = aliases.select(F.lower("ticker").alias("symbol"), F.col("ticker").alias("t1"))
    by_name = aliases.select(F.lower("company").alias("called"), F.col("ticker").alias("t2"))
    both = requests.join(by_symbol, key == F.col("symbol"), "left").join(by_name, key == F.col("called"), "left")
    return both.select(name_col, F.coalesce("t1", "t2").alias("ticker"))


def overlap(spans: Sequence[DataFrame]) -> DataFrame:
    """Of coverages (dataset, records, start, end): one row that says whether all of them share a span."""
    every = reduce(DataFrame.unionByName, spans)
    return every.agg(F.count("*").alias("datasets"), F.sum("records").alias("records"), F.max("start").alias("overlap_start"), F.min("end").alias("overlap_end"), (F.max("start") <= F.min("end")).alias("valid"))
