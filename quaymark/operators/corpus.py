"""Building a training corpus from examples (example_id, category, gold_key, question, answer, tokens)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaymark.operators import ranks
from quaymark.operators.ranks import running
from quaymark.session import stored


def mixed(key: Column, seed: int) -> Column:
    """A portable scramble of an integer key: any engine gets the same order from it."""
    return F.pmod(F.pmod(key, F.lit(2147483647)) * 1103515245 + seed, F.lit(2147483647))


def token_gate(examples: DataFrame, budget: int) -> DataFrame:
    return examples.withColumn("kept", F.col("tokens") <= budget)


def keep_first(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in the given order. Only ids meet, so that a key with a third of all rows is pre-aggregated, not gathered."""
    keyed = rows.withColumn("quaymark_key", key)
    first = keyed.groupBy("quaymark_key").agg(F.min(F.struct(*order)).alias("first")).select("first.*")
    return rows.join(first, list(order), "left_semi")


def first_per_bucket(rows: DataFrame, k: int, buckets: list[str], order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*buckets).orderBy(order))).where(F.col("n") <= k)


def interleave(examples: DataFrame) -> DataFrame:
    """Round robin: each category by tokens, categories by size, one of each in turn."""
    short = stored(examples.select("example_id", "category", "tokens"), "examples")  # without texts
    sizes = short.groupBy("category").agg(F.count("*").alias("size"))
    turns = running(short, ["category"], ["tokens", "example_id"], "turn")
    rows = turns.join(F.broadcast(sizes), "category")
    return rows.withColumn("seat", F.row_number().over(Window.partitionBy("turn").orderBy(F.desc("size"), "category"))).select("example_id", "category", "turn", "seat")


def split_by_group(examples: DataFrame, val_rows: int, most: float = 0.2) -> DataFrame:
    """Whole groups go to validation, in a scrambled order of their keys, until val_rows or the fraction is reached."""
    groups = examples.groupBy("gold_key").agg(F.count("*").alias("n"), F.min("example_id").alias("lead"))
    upto = running(groups, [], [mixed(F.col("lead"), 17), "gold_key"], "upto", "n")
    total = groups.agg(F.sum("n").alias("total"))
    placed = upto.withColumn("before", F.col("upto") - F.col("n")).join(F.broadcast(total), F.lit(True))
    chosen = placed.select("gold_key", F.when(F.col("before") < F.least(F.lit(float(val_rows)), F.col("total") * most), "val").otherwise("train").alias("split"))
    return examples.join(chosen, "gold_key").select("example_id", "gold_key", "split")


def quotas(have: dict[str, int], target: int, shares: dict[str, float]) -> dict[str, int]:
    """How many of each category to take: its share, and where others lack some, more of the largest shares, up to 1.5 times their quota."""
    quota = {c: round(target * s) for c, s in shares.items()}
    take = {c: min(q, have.get(c, 0)) for c, q in quota.items()}
    short = target - sum(take.values())
    for c in sorted(quota, key=lambda c: (-shares[c], c)):
        more = max(0, min(short, have.get(c, 0) - take[c], int(1.5 * quota[c]) - take[c]))
        take[c] += more
        short -= more
    return take


def stratify(examples: DataFrame, target: int, shares: dict[str, float]) -> DataFrame:
    """A scrambled sample by quota; what a category lacks is refilled by the largest shares, up to 1.5 times their quota."""
    wanted = examples.where(F.col("category").isin(*shares))
    have = {r.category: r.n for r in wanted.groupBy("category").agg(F.count("*").alias("n")).collect()}  # a row a share
    table = examples.sparkSession.createDataFrame(list(quotas(have, target, shares).items()), "category string, quota int")
    rows = running(wanted.select("example_id", "category"), ["category"], [mixed(F.col("example_id"), 41), "example_id"], "nth")
    return rows.join(F.broadcast(table), "category").where("nth <= quota").select("example_id", "category", "nth")


def perturbation(key: Column, rate: int = 35) -> Column:
    """Which perturbation an example gets, if any: shares 30, 25, 20, 15 and 10 of those that get one."""
    pick = F.pmod(mixed(key, 99), F.lit(100))
    kind = F.when(pick < 30, "coverage_probe").when(pick < 55, "distractor").when(pick < 75, "shuffle").when(pick < 90, "contradictory_duplicate").otherwise("truncate")
    return F.when(F.pmod(mixed(key, 7), F.lit(100)) < rate, kind).otherwise("none")


def perturb(calls: Column, kind: Column, probe: Column, distractor: Column, cut: int = 40) -> Column:
    """A list of evidence blocks as the perturbation leaves it."""
    return (
        F.when(kind == "coverage_probe", F.concat(F.array(probe), calls))
        .when(kind == "distractor", F.concat(calls, F.array(distractor)))
        .when(kind == "shuffle", F.reverse(calls))
        .when(kind == "contradictory_duplicate", F.concat(calls, F.array(F.concat(F.element_at(calls, 1), F.lit(" (revised)")))))
        .when(kind == "truncate", F.transform(calls, lambda c: F.substring(c, 1, cut)))
        .otherwise(calls)
    )


def drop_component(examples: DataFrame, blocks: str, components: str, key: str) -> DataFrame:
    """Negatives: a scrambled pick of the blocks and the last component go; examples with fewer than two of either have none."""
    pick = F.pmod(mixed(F.col(key), 5), F.size(blocks)).cast("int")
    fit = examples.where((F.size(blocks) >= 2) & (F.size(components) >= 2)).withColumn("pick", pick)
    return fit.withColumn(blocks, F.filter(blocks, lambda b, i: i != F.col("pick"))).withColumn(components, F.slice(components, F.lit(1), F.size(components) - 1))


#: What an example says that has no evidence at all.
NO_EVIDENCE = "The supplied data does not contain the evidence needed to answer this question, so no grounded answer can be given."


def empty_trace(examples: DataFrame, blocks: str, components: str) -> DataFrame:
    """Negatives without any evidence: no block, one component that says so, and that answer."""
    return examples.withColumns({blocks: F.array().cast("array<string>"), components: F.array(F.lit("no grounded answer can be given")), "answer": F.lit(NO_EVIDENCE)})


#: Fixed pattern of what a paraphrase must keep: years and tickers. And what tells that something is left out.
HARD_TOKENS, LEFT_OUT = r"\b(?:19|20)\d{2}\b|\b[A-Z]{2,4}\.AX\b", "xclud"


def hard_tokens(original: Column) -> Column:
    return F.regexp_extract_all(original, F.lit(HARD_TOKENS), F.lit(0))


def plausible(variant: Column, original: Column, low: int = 15, high: int = 400, excluded: Sequence[str] = (), hard: Column | None = None) -> Column:
    """A paraphrase must have a fair length, keep every year and ticker of the original, and where that excludes something say so too, or name one of `excluded`."""
    hard = hard_tokens(original) if hard is None else hard
    says = reduce(lambda a, b: a | b, [F.contains(variant, F.lit(w)) for w in (LEFT_OUT, *excluded)])
    return F.length(variant).between(low, high) & F.forall(hard, lambda h: F.contains(variant, h)) & (~F.contains(original, F.lit(LEFT_OUT)) | says)


def variants(reply: Column, question: Column, n: int = 2, excluded: Sequence[str] = ()) -> Column:
    """Of a model's reply, one variant a line, the first n that are plausible and aren't the question, without bullets, numbers and quotes around them. A null reply has none."""
    blanks = F.lit(" \t\r\n\f\v")
    bare = lambda line: F.btrim(F.btrim(F.ltrim(F.btrim(line, blanks), F.lit("-*0123456789. ")), blanks), F.lit('"'))
    lines = F.split(F.coalesce(reply, F.lit("")), r"\r\n|\r|\n", -1)

    def first(hard: Column) -> Column:
        fit = lambda v: (v != "") & (v != question) & plausible(v, question, excluded=excluded, hard=hard)
        return F.aggregate(lines, F.array().cast("array<string>"), lambda got, line: F.when(F.size(got) >= n, got).otherwise(F.concat(got, F.filter(F.array(bare(line)), fit))))

    return F.element_at(F.transform(F.array(hard_tokens(question)), first), 1)  # the question is read once, not for each line


def paraphrased(examples: DataFrame, n: int = 2, excluded: Sequence[str] = ()) -> DataFrame:
    """Up to n further examples for each of examples (template_id, question, perturbations, reply, ...), the originals not among them: another question and template, all else (answer, components, gold key) as it was, so that a group stays on one side of a split."""
    told = examples.withColumn("reply", variants(F.col("reply"), F.col("question"), n, excluded))
    # The outer form, for the other one's test of emptiness would read every reply twice.
    each = told.select("*", F.posexplode_outer("reply").alias("quaymark_nth", "quaymark_variant")).where("quaymark_variant is not null")
    new = {"template_id": F.concat(F.col("template_id").cast("string"), F.lit(".p"), (F.col("quaymark_nth") + 1).cast("string")), "question": F.col("quaymark_variant"), "perturbations": F.concat(F.coalesce("perturbations", F.array().cast("array<string>")), F.array(F.lit("paraphrase")))}
    return each.select(*[new[c].alias(c) if c in new else c for c in examples.columns if c != "reply"])


def user_prompt(question: Column, evidence: Column) -> Column:
    """What a model is asked: the question and its evidence, in a fixed form."""
    return F.concat(F.lit("Question:\n"), question, F.lit("\n\nVerified tool results:\n"), evidence, F.lit("\n\nWrite the final answer."))


def prompt_gates(captures: DataFrame, system: str) -> DataFrame:
    """Per set of captured prompts (set, system, prompt, rendered, steps): how many have a trace, whether each of those is what is rendered (none to check is a failure), and whether every system prompt is the one that is served."""
    checked = F.col("steps") > 0
    unlike = F.count_if(checked & ~F.col("prompt").eqNullSafe(F.col("rendered")))
    return captures.groupBy("set").agg(F.count_if(checked).alias("checked"), ((F.count_if(checked) > 0) & (unlike == 0)).alias("parity"), (F.count_if(~F.col("system").eqNullSafe(F.lit(system))) == 0).alias("identity"))


def grounded(span: Column, snippet: Column) -> Column:
    return F.contains(F.lower(snippet), F.substring(F.lower(span), 1, 60))


def gates(split: DataFrame, examples: DataFrame, budget: int, prefix: int, least: int) -> DataFrame:
    """One row of booleans: no group on both sides, balance of the first rows, tokens within budget, answers not empty."""
    sides = split.groupBy("gold_key").agg(F.count_distinct("split").alias("n")).agg((F.max("n") <= 1).alias("no_leak"))
    front = interleave(examples).where(F.col("turn") <= prefix).groupBy("category").agg(F.count("*").alias("n")).agg((F.min("n") >= least).alias("balanced"))
    rest = examples.agg((F.max("tokens") <= budget).alias("within_budget"), (F.count_if(F.length(F.trim("answer")) == 0) == 0).alias("answered"))
    return sides.join(front, F.lit(True)).join(rest, F.lit(True))


def holdout_gates(held: DataFrame, least: int) -> DataFrame:
    """One row of booleans on rows (gold_key, split, category, answer): enough held-out rows, none of a group that is trained on, every category, and no empty answer."""
    val = F.col("split") == "val"
    groups = held.groupBy("gold_key").agg(F.count_distinct("split").alias("sides")).agg((F.max("sides") <= 1).alias("unseen"))
    rows = held.agg((F.count_if(val) >= least).alias("enough"), (F.count_distinct(F.when(val, F.col("category"))) == F.count_distinct("category")).alias("every_category"), (F.count_if(val & (F.trim("answer") == "")) == 0).alias("answered"))
    return rows.join(groups, F.lit(True)).select("enough", "unseen", "every_category", "answered")


def question_gates(components: DataFrame, trained: DataFrame, total: float = 10.0, slack: float = 0.05) -> DataFrame:
    """Per set of questions booleans on rows (set, qid, gold_key, component_id, points), with one row of nulls for a question without components: no question's key is trained on, every question has components, and each one's points sum to the total."""
    each = components.groupBy("set", "qid", "gold_key").agg(F.count("component_id").alias("parts"), F.coalesce(F.sum("points"), F.lit(0.0)).alias("points"))
    told = each.join(trained.select("gold_key", F.lit(True).alias("trained")).distinct(), "gold_key", "left")
    return told.groupBy("set").agg((F.count("trained") == 0).alias("unseen"), (F.min("parts") > 0).alias("has_components"), (F.max(F.abs(F.col("points") - total)) <= slack).alias("full_points"))


def collisions(split: DataFrame, *content: str) -> DataFrame:
    """One row: how many validation rows equal a training row in all of the content; contents meet by hash, counted before they are shuffled."""
    print_of = F.sha2(F.concat_ws("\0", *[F.coalesce(c, F.lit("")) for c in content]), 256)
    each = split.groupBy(print_of.alias("print")).agg(F.count_if(F.col("split") == "val").alias("val"), F.count_if(F.col("split") == "train").alias("train"))
    return each.agg(F.coalesce(F.sum(F.when(F.col("train") > 0, F.col("val"))), F.lit(0)).alias("identical"))


def quantiles(examples: DataFrame, value: str = "tokens") -> DataFrame:
    """Least, sorted[n // 2], sorted[0.95 n] and most, exact: one row, of nulls if there is no value."""
    rows = examples.select(F.lit(0).alias("quaymark_one"), F.col(value))
    found = ranks.quantiles(rows, ["quaymark_one"], value, p50=50, p95=95)
    return found.agg(*[F.max(c).alias(c) for c in ("least", "p50", "p95", "most")])  # of one row, or none


def vote(votes: DataFrame, key: str) -> DataFrame:
    """Of each key's votes (position, label, coarse): a label if there are three votes of one coarse class; most common first, first seen among equals."""
    each = votes.groupBy(key, "label").agg(F.count("*").alias("n"), F.min("position").alias("seen"), F.min("coarse").alias("coarse"))
    return each.groupBy(key).agg(F.sum("n").alias("votes"), F.count_distinct("coarse").alias("classes"), F.max_by("label", F.struct("n", -F.col("seen"))).alias("label")).where("votes >= 3 and classes = 1").select(key, "label", "votes")
