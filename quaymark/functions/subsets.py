"""Subsets by number: the n-th of all subsets of some sizes, without a list of them (combinatorial number system)."""

from __future__ import annotations

import json
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items that counts of subsets are kept for: more would not fit into 64 bits.
MOST_ITEMS = 60
#: A prime: numbers that are this far apart, around a circle of fewer, are all different. No number of subsets that is a multiple of it is of use here.
STRIDE = 2**31 - 1
_PASCAL = json.dumps([[comb(a, b) for b in range(MOST_ITEMS + 1)] for a in range(MOST_ITEMS + 1)])


def _ways(n: Column, k: Column) -> Column:
    """n over k, 0 where k is negative."""
    # One text, which the optimizer reads once: thousands of literals would each be a node of the plan.
    table = F.from_json(F.lit(_PASCAL), "array<array<bigint>>")
    return F.when((k < 0) | (k > n), F.lit(0).cast("bigint")).otherwise(F.element_at(F.element_at(table, n.cast("int") + 1), k.cast("int") + 1))


def _checked(items: Column) -> Column:
    n = F.size(items)
    return F.when(n > MOST_ITEMS, F.raise_error(F.concat(F.lit("too many items for subsets: "), n.cast("string"))).cast("int")).otherwise(n)


def subset_count(items: Column, low: int, high: int) -> Column:
    """How many subsets of low to high items there are."""
    n = _checked(items)
    return sum((_ways(n, F.lit(k)) for k in range(low, high + 1)), F.lit(0).cast("bigint"))


def unranked(items: Column, size: Column, rank: Column) -> Column:
    """The subset of so many items with the rank, from 0, in the order of their positions."""
    n = _checked(items)
    start = F.struct(rank.cast("bigint").alias("rank"), size.cast("int").alias("left"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, i: Column) -> Column:
        with_it = _ways(n - 1 - i, acc["left"] - 1)
        take = acc["rank"] < with_it
        return F.when(take, F.struct(acc["rank"].alias("rank"), (acc["left"] - 1).alias("left"), F.concat(acc["taken"], F.array(i)).alias("taken"))).otherwise(F.struct((acc["rank"] - with_it).alias("rank"), acc["left"].alias("left"), acc["taken"].alias("taken")))

    places = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), start, step)["taken"]
    return F.transform(F.filter(places, lambda i: i < n), lambda i: F.element_at(items, i + 1))


def subset_at(items: Column, low: int, high: int, number: Column) -> Column:
    """The subset of low to high items with the number, from 0: smaller sizes first."""
    n = _checked(items)
    start = F.struct(number.cast("bigint").alias("rest"), F.lit(0).alias("size"))

    def step(acc: Column, k: Column) -> Column:
        ways = _ways(n, k)
        here = (acc["size"] == 0) & (acc["rest"] < ways)
        return F.when(here, F.struct(acc["rest"].alias("rest"), k.alias("size"))).when(acc["size"] > 0, acc).otherwise(F.struct((acc["rest"] - ways).alias("rest"), F.lit(0).alias("size")))

    found = F.aggregate(F.sequence(F.lit(low), F.lit(high)), start, step)
    return unranked(items, found["size"], found["rest"])


def drawn(items: Column, low: int, high: int, seed: Column, count: int) -> Column:
    """count different subsets of low to high items (all, if there are fewer), by a seed: an array of arrays."""
    total = subset_count(items, low, high)
    turns = F.sequence(F.lit(0).cast("bigint"), F.least(total, F.lit(count).cast("bigint")) - 1)
    some = F.transform(turns, lambda j: subset_at(items, low, high, F.pmod(seed + j * STRIDE, total)))
    return F.when(total > 0, some).otherwise(F.array().cast("array<array<string>>"))
