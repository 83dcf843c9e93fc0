"""Running sums and last known values within groups of any size, without a window that holds a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.session import stored


def running(rows: DataFrame, keys: list[str], order: list[Column | str], name: str, value: str | None = None) -> DataFrame:
    """rows with the sum of value (or the number of rows) up to and with each, in the order within the keys, as the column name.

    Rows are dealt to ranges of (keys, order), so a group may spread over many tasks; each adds up its own part of a group,
    and the totals of the parts, of which there are as many as ranges and groups, give what lies before a part.
    The order must leave no ties."""
    placed = rows.select("*", (F.lit(1) if value is None else F.col(value)).cast("bigint").alias("quaymark_value"), *[(F.col(o) if isinstance(o, str) else o).alias(f"quaymark_o{k}") for k, o in enumerate(order)])
    by = [F.col(k) for k in keys] + [F.col(f"quaymark_o{k}") for k in range(len(order))]
    placed = stored(placed.repartitionByRange(*by).withColumn("quaymark_part", F.spark_partition_id()), "ranges")
    parts = placed.groupBy(*keys, "quaymark_part").agg(F.sum("quaymark_value").alias("quaymark_sum"))
    before = F.sum("quaymark_sum").over(Window.partitionBy(*keys).orderBy("quaymark_part").rowsBetween(Window.unboundedPreceding, -1))
    known = parts.select(*[F.col(k).alias(f"quaymark_k_{k}") for k in keys], F.col("quaymark_part").alias("quaymark_p"), F.coalesce(before, F.lit(0)).alias("quaymark_before"))
    same = F.col("quaymark_part") == F.col("quaymark_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"quaymark_k_{k}"))
    own = F.sum("quaymark_value").over(Window.partitionBy(*keys, "quaymark_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("quaymark_own", own).join(known, same).select(*rows.columns, (F.col("quaymark_own") + F.col("quaymark_before")).alias(name))


def last_known(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str) -> DataFrame:
    """rows with the last value that isn't null up to and with each, in the order within the keys, as the column name.

    Rows are dealt to ranges of (keys, order) as in running(). A range knows its own values; what it had last of each group
    is carried to the group's later ranges, a row for each range and group."""
    placed = rows.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(f"quaymark_o{k}") for k, o in enumerate(order)])
    by = [F.col(k) for k in keys] + [F.col(f"quaymark_o{k}") for k in range(len(order))]
    placed = stored(placed.repartitionByRange(*by).withColumn("quaymark_part", F.spark_partition_id()), "ranges")
    at = F.struct(*[f"quaymark_o{k}" for k in range(len(order))])
    parts = placed.groupBy(*keys, "quaymark_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias("quaymark_last"))
    before = F.last("quaymark_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("quaymark_part").rowsBetween(Window.unboundedPreceding, -1))
    known = parts.select(*[F.col(k).alias(f"quaymark_k_{k}") for k in keys], F.col("quaymark_part").alias("quaymark_p"), before.alias("quaymark_before"))
    same = F.col("quaymark_part") == F.col("quaymark_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"quaymark_k_{k}"))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "quaymark_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("quaymark_own", own).join(known, same).select(*rows.columns, F.coalesce("quaymark_own", "quaymark_before").alias(name))


def quantiles(rows: DataFrame, keys: list[str], value: str, **hundredths: int) -> DataFrame:
    """(keys, n, least, the named ones, most) of each group: a quantile of h hundredths is sorted[n * h // 100]. Nulls count as no value. Equal values are counted first, then the counts are added up over ranges, so neither a large group nor many groups gather."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("quaymark_v")).agg(F.count("*").alias("quaymark_c"))
    upto = stored(running(counts, keys, ["quaymark_v"], "quaymark_upto", "quaymark_c"), "quantiles")
    totals = upto.groupBy(*keys).agg(F.max("quaymark_upto").alias("n"), F.min("quaymark_v").alias("least"), F.max("quaymark_v").alias("most"))
    total = totals.select(*[F.col(k).alias(f"quaymark_k_{k}") for k in keys], "n", "least", "most")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"quaymark_k_{k}"))
    at = [F.min(F.when(F.col("quaymark_upto") > F.floor(F.col("n") * h / 100), F.col("quaymark_v"))).alias(name) for name, h in hundredths.items()]
    return upto.join(total, same).groupBy(*keys).agg(F.first("n").alias("n"), F.first("least").alias("least"), *at, F.first("most").alias("most"))
