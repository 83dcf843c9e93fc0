"""Filter interaction audit: what each of several filters removes, alone, in every order and on average over all orders.

Documents are counted by part and by the set of filters that they fail (a mask). The number that a set S of filters removes
is a game over the filters; its multilinear extension is the removal polynomial

    F(x) = sum over masks m of n(m) * (1 - product over i in m of (1 - x_i)),

kept by its coefficients over products of distinct x_i. A corner of the unit cube is a set of filters: F there is what the set
removes, so differences of corners give each step of each order, and the survivors. Shapley's value of filter i is the
integral over t of dF/dx_i at (t, ..., t); a coefficient c of a product of d factors gives c / d of it, exactly.

Cases: null texts count as empty; they and empty texts are equal. A null part is the part of the empty string. Null ids never
copy an earlier row, and no row copies them; rows that tie in id aren't earlier than each other. Rows that repeat count each.
A document without labels or with a null id has neither; of several label rows the largest counts. Texts of any length are counted by
expressions of the engine. An empty table gives no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import discard, joined, read, written

#: The filters' letters, by bit of the mask.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, DISTINCT_PCT, UPPER_PCT, SIGNS = 200, 50, 2, "[#$%&*|]"


def text_failures(text: Column) -> Column:
    """The mask of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, distinct, upper = F.size(words), F.size(F.array_distinct(words)), F.length(text) - F.length(F.translate(text, UPPER, ""))
    tests = [n < MIN_WORDS, 100 * distinct.cast("bigint") < DISTINCT_PCT * n, 100 * upper.cast("bigint") > UPPER_PCT * F.length(text), text.rlike(SIGNS)]
    return sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, with those labelled good and toxic.

    Copies are found by digest: a count and the least id of each digest, and rows of digests that repeat meet them, hot ones by
    broadcast. Their rows then move from one mask to another, by signed counts that are added up before they are shuffled."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body, 256)).alias("digest"), text_failures(body).alias("mask"))
    rows = written(rows, "masks")
    groups = written(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null"), "copies")
    later = joined(rows, groups, ["digest"], "copies").where("id > first").select("id", "part", "mask")
    copy = 1 << FILTERS.index("E")
    signed = rows.select("id", "part", "mask", F.lit(1).alias("n")).union(later.select("id", "part", "mask", F.explode(F.array(F.lit(-1), F.lit(1))).alias("n")).select("id", "part", F.when(F.col("n") > 0, F.col("mask").bitwiseOR(F.lit(copy))).otherwise(F.col("mask")).alias("mask"), "n"))
    each = signed.groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).where("n > 0")
    known = labels.groupBy(F.col(id_col).alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = each.join(known, F.col("id") == F.col("label_id"), "left")
    of = lambda c: F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c)
    counts = written(marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic")), "mask-counts")
    discard(rows, groups)
    return counts


def removal_polynomial(counts: dict[int, int], n_filters: int) -> dict[int, int]:
    """Coefficients of the removal polynomial, by the set of its factors (a mask)."""
    sign = lambda t: 1 if t.bit_count() % 2 else -1
    return {t: sign(t) * sum(n for m, n in counts.items() if m & t == t) for t in range(1, 1 << n_filters)}


def corner(polynomial: dict[int, int], filters: int) -> int:
    """The polynomial where the filters' variables are 1 and the others 0: what those filters remove together."""
    return sum(c for t, c in polynomial.items() if t & filters == t)


def shapley(polynomial: dict[int, int], bit: int) -> Fraction:
    """The integral from 0 to 1 of the derivative by one variable along the diagonal."""
    return sum((Fraction(c, t.bit_count()) for t, c in polynomial.items() if t & bit), Fraction(0))


AUDIT = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit(counts: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row for each part, order of the filters and step, from (part, mask, n, good, toxic). A part has at most a row for each mask."""
    bits = {letter: 1 << k for k, letter in enumerate(filters)}
    orders, every = factorial(len(bits)), (1 << len(bits)) - 1

    def run(found: pd.DataFrame) -> pd.DataFrame:
        of = {c: removal_polynomial(dict(zip(found["mask"].tolist(), found[c].tolist(), strict=True)), len(bits)) for c in ("n", "good", "toxic")}
        at = {c: [corner(p, s) for s in range(every + 1)] for c, p in of.items()}
        total, removed = int(found["n"].sum()), at["n"]
        average = {letter: int(orders * shapley(of["n"], bit)) for letter, bit in bits.items()}
        rows = []
        for order in permutations(bits):
            before = 0
            for step, letter in enumerate(order, 1):
                bit = bits[letter]
                after = before | bit
                here = {c: at[c][after] - at[c][before] for c in at}
                rows.append((found["part"].iat[0], "".join(order), step, total - removed[after], here["n"], removed[bit] - here["n"], removed[every] - removed[every ^ bit], here["good"], here["toxic"], average[letter]))
                before = after
        return pd.DataFrame(rows, columns=[c.split()[0] for c in AUDIT.split(", ")])

    return counts.select("part", "mask", "n", "good", "toxic").groupBy("part").applyInPandas(run, AUDIT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_counts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


SQL = r"""
WITH RECURSIVE orders(o) AS (SELECT '' UNION ALL SELECT o || l FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(l) WHERE NOT contains(o, l)),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * len(body) AS c, regexp_matches(body, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false) AS e
  FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
         count(*) AS n, count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(toxic, false)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
s AS (SELECT o AS filter_order, step::INT AS step, substr(o, step, 1) AS letter, substr(o, 1, step - 1) AS earlier FROM orders, range(1, 6) r(step) WHERE length(o) = 5),
x AS (SELECT *, contains(fails, letter) AS bad, length(translate(fails, earlier, '')) < length(fails) AS gone FROM m, s)
SELECT part, filter_order, step,
       CAST(coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS BIGINT) AS kept,
       CAST(coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS BIGINT) AS removed,
       CAST(coalesce(sum(n) FILTER (bad AND gone), 0) AS BIGINT) AS redundant,
       CAST(coalesce(sum(n) FILTER (fails = letter), 0) AS BIGINT) AS unique_fails,
       CAST(coalesce(sum(good) FILTER (bad AND NOT gone), 0) AS BIGINT) AS good_lost,
       CAST(coalesce(sum(toxic) FILTER (bad AND NOT gone), 0) AS BIGINT) AS toxic_lost,
       CAST(coalesce(sum(n * 120 // greatest(length(fails), 1)) FILTER (bad), 0) AS BIGINT) AS shapley
FROM x GROUP BY part, filter_order, step
"""
