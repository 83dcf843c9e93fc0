"""Scores of answers, and paired comparisons of two arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.operators.corpus import mixed


def question_scores(points: DataFrame) -> DataFrame:
    """(qid, arm, earned, components) from points at component grain."""
    return points.groupBy("qid", "arm").agg(F.sum("points").alias("earned"), F.count("*").alias("components"))


def paired(points: DataFrame, base: str = "base", other: str = "tuned") -> DataFrame:
    """(qid, diff): of the questions that both arms answered, the second's mean score less the first's, in points of 100."""
    each = question_scores(points).select("qid", "arm", F.round(F.col("earned") / F.col("components"), 4).alias("score"))
    a, b = each.where(F.col("arm") == base).select("qid", F.col("score").alias("a")), each.where(F.col("arm") == other).select("qid", F.col("score").alias("b"))
    return a.join(b, "qid").select("qid", "a", "b", F.round(F.col("b") - F.col("a"), 4).alias("diff"))


def compare(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("questions"), F.round(F.avg("a"), 4).alias("mean_base"), F.round(F.avg("b"), 4).alias("mean_other"), F.round(F.avg("diff"), 4).alias("delta"), F.count_if(F.col("diff") > 0).alias("wins"), F.count_if(F.col("diff") < 0).alias("losses"), F.count_if(F.col("diff") == 0).alias("ties"))


def bootstrap(pairs: DataFrame, resamples: int = 2000, seed: int = 3) -> DataFrame:
    """Interval of the mean difference over resamples of questions; picks come from a portable scramble. Pairs are a row a question."""
    numbered = pairs.select("diff", (F.expr("row_number() over (order by qid)") - 1).alias("nth"))
    n = pairs.agg(F.count("*").alias("n"))
    draws = pairs.sparkSession.range(resamples).withColumnRenamed("id", "r").join(F.broadcast(n), F.lit(True)).select("r", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    draws = draws.withColumn("nth", F.pmod(F.floor(mixed(F.col("r") * 7919 + F.col("k") * 104729, seed) / 65536), F.col("n")))
    means = draws.join(F.broadcast(numbered), "nth").groupBy("r").agg(F.round(F.avg("diff"), 6).alias("mean"))
    order = F.expr("row_number() over (order by mean, r)") - 1
    placed = means.select("mean", order.alias("place"))
    return placed.agg(F.max(F.when(F.col("place") == int(0.025 * resamples), F.col("mean"))).alias("low"), F.max(F.when(F.col("place") == int(0.975 * resamples), F.col("mean"))).alias("high"))


def sign_flip(pairs: DataFrame, most: int = 20, trials: int = 20_000) -> DataFrame:
    """Share of the sign patterns whose mean is at least as far from 0 as the one seen; all patterns up to `most` questions that differ, else scrambled ones."""
    diffs = pairs.where("diff <> 0").select("diff", (F.expr("row_number() over (order by qid)") - 1).cast("int").alias("nth"))
    n = diffs.count()  # questions that differ
    if n <= most:
        masks = pairs.sparkSession.range(1 << n).withColumnRenamed("id", "mask")
        bit = lambda: F.pmod(F.floor(F.col("mask") / F.pow(F.lit(2.0), F.col("nth"))), F.lit(2))
    else:
        masks = pairs.sparkSession.range(trials).withColumnRenamed("id", "mask")
        bit = lambda: F.pmod(F.floor(mixed(F.col("mask") * 7919 + F.col("nth") * 104729, 11) / 65536), F.lit(2))
    seen = diffs.agg(F.abs(F.sum("diff")).alias("seen"))
    sums = masks.join(F.broadcast(diffs), F.lit(True)).groupBy("mask").agg(F.abs(F.sum(F.when(bit() == 1, -F.col("diff")).otherwise(F.col("diff")))).alias("sum"))
    share = sums.join(F.broadcast(seen), F.lit(True)).agg(F.count("*").alias("patterns"), F.round(F.avg((F.col("sum") >= F.col("seen") - 1e-9).cast("double")), 6).alias("p"))
    return share if n else pairs.sparkSession.sql("select 1L as patterns, 1.0D as p")


def agreement(cases: DataFrame, gate: float = 0.95) -> DataFrame:
    """Of labelled cases (expected, verdict): the share that agrees, and whether it passes with no miss."""
    share = F.avg((F.col("expected") == F.col("verdict")).cast("double"))
    misses = F.count_if(F.col("expected") & ~F.col("verdict"))
    return cases.agg(F.count("*").alias("cases"), F.round(share, 6).alias("agreement"), misses.alias("misses"), ((share >= gate) & (misses == 0)).alias("passes"))


def yes_probability(logprobs: Column) -> Column:
    """P(yes) among the yes and no tokens of an array of (token, logprob)."""
    of = lambda word: F.aggregate(F.filter(logprobs, lambda x: F.lower(F.trim(x["token"])) == word), F.lit(0.0), lambda s, x: s + F.exp(x["logprob"]))
    return F.try_divide(of("yes"), of("yes") + of("no"))


def grid(answers: DataFrame) -> DataFrame:
    """A row for each arm and condition of answers (arm, condition, earned, components, words, hedged, ungrounded, leaked, misformatted, empty): scores and rates, and the median and the most of the words."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    cells = answers.groupBy("arm", "condition").agg(F.count("*").alias("n"), F.round(F.sum("earned") / F.sum("components"), 4).alias("score"), *[rate(c).alias(f"{c}_rate") for c in ("hedged", "ungrounded", "leaked", "misformatted", "empty")], F.max("words").alias("words_max"))
    # sorted[n // 2], from counts of equal values.
    counts = answers.groupBy("arm", "condition", "words").agg(F.count("*").alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("arm", "condition").orderBy("words").rowsBetween(Window.unboundedPreceding, 0)))
    middle = upto.join(F.broadcast(cells.select("arm", "condition", "n")), ["arm", "condition"]).where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("arm", "condition").agg(F.min("words").alias("words_p50"))
    return cells.join(middle, ["arm", "condition"])


def comparison(pairs: DataFrame) -> DataFrame:
    """One row: the paired comparison with the interval of its mean difference and the sign-flip p; it is significant if the interval leaves out 0."""
    both = compare(pairs).join(bootstrap(pairs), F.lit(True)).join(sign_flip(pairs).select("p"), F.lit(True))  # one row each
    return both.withColumn("significant", F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)))


def applied(answers: DataFrame, base: str = "base") -> DataFrame:
    """Of each other arm of answers (qid, arm, answer): how many answers are the base arm's, how many aren't (a question that the base arm hasn't answered counts so), and whether the arm was applied at all. Answers meet as digests."""
    told = answers.select("qid", "arm", F.sha2(F.coalesce("answer", F.lit("")), 256).alias("print"))
    first = told.where(F.col("arm") == base).groupBy("qid").agg(F.min("print").alias("base_print"))
    each = told.where(F.col("arm") != base).join(first, "qid", "left")
    same = F.coalesce(F.col("print") == F.col("base_print"), F.lit(False))
    counts = each.groupBy("arm").agg(F.count_if(same).alias("identical"), F.count_if(~same).alias("differing"))
    return counts.withColumn("verdict", F.when(F.col("differing") > 0, "APPLIED").otherwise("NOT APPLIED"))
