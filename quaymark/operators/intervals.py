"""Joins of days with windows that hold them, both sides large."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of one bin that meet in a task, and bins whose counts are broadcast (some MB).
BIN_ROWS, SHIPPED_BINS = 100_000, 100_000


def inside(points: DataFrame, windows: DataFrame, at: str, start: str = "start", end: str = "end", bin_rows: int = BIN_ROWS) -> DataFrame:
    """All columns of both, for each point whose day lies strictly inside a window. Days that are null, and windows without an end, match nothing.

    Days are dealt to bins about as wide as a window, a window to the bins that it touches. A bin with more than bin_rows points
    is split, and windows go to each of its splits; bins without points take no windows."""
    taken = {c.lower() for c in points.columns} & {c.lower() for c in windows.columns}
    if taken:
        raise ValueError(f"both sides have {', '.join(sorted(taken))}")
    whole = windows.where(F.datediff(end, start) > 1)
    width = max(1, round(whole.agg(F.avg(F.datediff(end, start))).first()[0] or 1))
    bin_of = lambda day: F.floor(F.unix_date(day) / width)
    dealt = points.where(F.col(at).isNotNull()).withColumn("quaymark_bin", bin_of(F.col(at)))
    bins = dealt.groupBy("quaymark_bin").agg(F.ceil(F.count("*") / bin_rows).cast("int").alias("quaymark_splits"))
    if bins.limit(SHIPPED_BINS + 1).count() <= SHIPPED_BINS:
        bins = F.broadcast(bins)
    days = dealt.join(bins, "quaymark_bin").withColumn("quaymark_split", F.pmod(F.xxhash64(*points.columns, F.spark_partition_id()), F.col("quaymark_splits")).cast("int")).drop("quaymark_splits")
    # Only days after the first and before the last are inside.
    touched = whole.withColumn("quaymark_bin", F.explode(F.sequence(bin_of(F.date_add(start, 1)), bin_of(F.date_sub(end, 1)))))
    spread = touched.join(bins, "quaymark_bin").withColumn("quaymark_split", F.explode(F.sequence(F.lit(0), F.col("quaymark_splits") - 1))).drop("quaymark_splits")
    met = days.join(spread.hint("merge"), ["quaymark_bin", "quaymark_split"]).where((F.col(at) > F.col(start)) & (F.col(at) < F.col(end)))
    return met.select(*points.columns, *windows.columns)
