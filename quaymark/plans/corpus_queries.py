"""Corpus building over examples, conversations and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymark.functions import scalars as S
from quaymark.operators import corpus as C
from quaymark.operators import ranks
from quaymark.operators import prices as P
from quaymark.plans.catalogue import register
from quaymark.sources import views as V

BUDGET, VAL_ROWS, STRATIFIED = 1024, 150, 400
SHARES = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
_E = V.with_(V.EXAMPLES)
_MIX = "((({0}) % 2147483647) * 1103515245 + {1}) % 2147483647"


def _x(s, d):
    return V.examples(s, d)


register("corpus_pool", _E + "SELECT example_id, category, tokens, 'positive' AS kind FROM examples UNION ALL SELECT example_id, category, 12, 'negative' FROM examples WHERE tokens > 1024")(
    lambda s, d: _x(s, d).select("example_id", "category", "tokens", F.lit("positive").alias("kind")).unionByName(_x(s, d).where("tokens > 1024").select("example_id", "category", F.lit(12).cast("bigint").alias("tokens"), F.lit("negative").alias("kind")))
)
register("corpus_mix", _E + "SELECT category, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM examples GROUP BY 1")(lambda s, d: _x(s, d).groupBy("category").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")))
register("corpus_token_quantiles", _E + ", l AS (SELECT list(tokens ORDER BY tokens) AS t, count(*) AS n FROM examples) SELECT t[1] AS least, t[n // 2 + 1] AS p50, t[(n * 95) // 100 + 1] AS p95, t[n] AS most FROM l")(lambda s, d: C.quantiles(_x(s, d)))
register("price_quantiles", "WITH l AS (SELECT l_suppkey, l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS t, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_suppkey, l_returnflag, n, t[1] AS least, t[n // 2 + 1] AS p50, t[(n * 95) // 100 + 1] AS p95, t[n] AS most FROM l")(
    lambda s, d: ranks.quantiles(V.table(s, d, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice", p50=50, p95=95)
)
register("token_gate", _E + f"SELECT example_id, tokens, tokens <= {BUDGET} AS kept FROM examples")(lambda s, d: C.token_gate(_x(s, d), BUDGET).select("example_id", "tokens", "kept"))
register("dedupe_keep_first", _E + "SELECT example_id FROM examples QUALIFY row_number() OVER (PARTITION BY sha1(question || chr(0) || answer) ORDER BY example_id) = 1")(lambda s, d: C.keep_first(_x(s, d), F.sha1(F.concat_ws("\0", "question", "answer")), "example_id").select("example_id"))
register("corpus_interleave", _E + ", t AS (SELECT example_id, category, row_number() OVER (PARTITION BY category ORDER BY tokens, example_id) AS turn, count(*) OVER (PARTITION BY category) AS size FROM examples) SELECT example_id, category, turn, row_number() OVER (PARTITION BY turn ORDER BY size DESC, category) AS seat FROM t")(lambda s, d: C.interleave(_x(s, d)))
register("holdout_sample", _E + ", t AS (SELECT example_id, category, row_number() OVER (PARTITION BY category ORDER BY tokens, example_id) AS turn FROM examples) SELECT example_id, category FROM t WHERE turn <= 5")(lambda s, d: C.interleave(_x(s, d)).where("turn <= 5").select("example_id", "category"))
register("candidates_stratified", _E + ", c AS (SELECT *, row_number() OVER (PARTITION BY category, example_id % 7 ORDER BY example_id) AS n FROM examples WHERE length(answer) BETWEEN 800 AND 8000) SELECT example_id, category, n FROM c WHERE n <= 3")(
    lambda s, d: C.first_per_bucket(_x(s, d).where(F.length("answer").between(800, 8000)).withColumn("year", F.col("example_id") % 7), 3, ["category", "year"], "example_id").select("example_id", "category", "n")
)
_SPLIT = _E + f""", g AS (SELECT gold_key, count(*) AS n, min(example_id) AS lead FROM examples GROUP BY 1),
o AS (SELECT gold_key, coalesce(sum(n) OVER (ORDER BY {_MIX.format('lead', 17)}, gold_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g),
sp AS (SELECT example_id, gold_key, CASE WHEN before < least({VAL_ROWS}, (SELECT count(*) FROM examples) * 0.2) THEN 'val' ELSE 'train' END AS split FROM examples JOIN o USING (gold_key))
"""
register("split_by_group", _SPLIT + "SELECT * FROM sp")(lambda s, d: C.split_by_group(_x(s, d), VAL_ROWS))
register("leakage_check", _SPLIT + "SELECT count(*) AS shared FROM (SELECT gold_key FROM sp WHERE split = 'train' INTERSECT SELECT gold_key FROM sp WHERE split = 'val')")(
    lambda s, d: (lambda x: x.where("split = 'train'").select("gold_key").intersect(x.where("split = 'val'").select("gold_key")).agg(F.count("*").alias("shared")))(C.split_by_group(_x(s, d), VAL_ROWS))
)
register("holdout_antijoin", _SPLIT + "SELECT example_id FROM sp a WHERE split = 'val' AND NOT EXISTS (SELECT 1 FROM sp b WHERE b.split = 'train' AND b.gold_key = a.gold_key)")(
    lambda s, d: (lambda x: x.where("split = 'val'").join(x.where("split = 'train'").select("gold_key"), "gold_key", "left_anti").select("example_id"))(C.split_by_group(_x(s, d), VAL_ROWS))
)
register("corpus_stratify", _E + f""", q AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {v})" for c, v in SHARES.items())}) x(category, share)),
h AS (SELECT category, share, CAST(round({STRATIFIED} * share) AS BIGINT) AS quota, (SELECT count(*) FROM examples e WHERE e.category = q.category) AS have FROM q),
t AS (SELECT category, share, least(quota, have) AS take, greatest(0, least(have, CAST(floor(1.5 * quota) AS BIGINT)) - least(quota, have)) AS room FROM h),
f AS (SELECT category, take + greatest(0, least(room, {STRATIFIED} - sum(take) OVER () - coalesce(sum(room) OVER (ORDER BY share DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS quota FROM t),
r AS (SELECT example_id, category, row_number() OVER (PARTITION BY category ORDER BY {_MIX.format('example_id', 41)}, example_id) AS nth FROM examples)
SELECT example_id, category, nth FROM r JOIN f USING (category) WHERE nth <= quota""")(lambda s, d: C.stratify(_x(s, d), STRATIFIED, SHARES))
register("corpus_prefix_balance", _E + ", t AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY tokens, example_id) AS turn FROM examples) SELECT category, count(*) AS n FROM t WHERE turn <= 40 GROUP BY 1")(lambda s, d: C.interleave(_x(s, d)).where("turn <= 40").groupBy("category").agg(F.count("*").alias("n")))
register("corpus_gates", _SPLIT + ", t AS (SELECT category, row_number() OVER (PARTITION BY category ORDER BY tokens, example_id) AS turn FROM examples) SELECT (SELECT max(n) <= 1 FROM (SELECT count(DISTINCT split) AS n FROM sp GROUP BY gold_key)) AS no_leak, (SELECT min(n) >= 6 FROM (SELECT count(*) AS n FROM t WHERE turn <= 40 GROUP BY category)) AS balanced, max(tokens) <= 1024 AS within_budget, count(*) FILTER (length(trim(answer)) = 0) = 0 AS answered FROM examples")(
    lambda s, d: C.gates(C.split_by_group(_x(s, d), VAL_ROWS), _x(s, d), BUDGET, 40, 6)
)
register("holdout_gates", _SPLIT + """, h AS (SELECT example_id, gold_key, split, category, answer FROM sp JOIN (SELECT example_id, category, answer FROM examples) USING (example_id))
SELECT count(*) FILTER (split = 'val') >= 100 AS enough, (SELECT count(*) FROM (SELECT gold_key FROM h WHERE split = 'val' INTERSECT SELECT gold_key FROM h WHERE split = 'train')) = 0 AS unseen, count(DISTINCT category) FILTER (split = 'val') = count(DISTINCT category) AS every_category, count(*) FILTER (split = 'val' AND trim(answer) = '') = 0 AS answered FROM h""")(
    lambda s, d: C.holdout_gates(C.split_by_group(_x(s, d), VAL_ROWS).join(_x(s, d).select("example_id", "category", "answer"), "example_id"), 100)
)
register("split_collisions", _SPLIT + ", h AS (SELECT split, question, answer FROM sp JOIN (SELECT example_id, question, answer FROM examples) USING (example_id)) SELECT count(*) AS identical FROM h a WHERE split = 'val' AND EXISTS (SELECT 1 FROM h b WHERE b.split = 'train' AND b.question = a.question AND b.answer = a.answer)")(
    lambda s, d: C.collisions(C.split_by_group(_x(s, d), VAL_ROWS).join(_x(s, d).select("example_id", "question", "answer"), "example_id"), "question", "answer")
)


def _question_sets(s, d):
    """Five items to a question, in three sets: one right, one in which some questions have no components, one whose points are too many and whose keys are trained on."""
    qid = F.floor(F.col("item_id") / 5)
    has = (qid % 3 != 1) | (qid % 2 != 0)
    points = F.when(qid % 3 == 2, 2 + F.col("item_id") % 5 * 0.02).otherwise(2 + (F.col("item_id") % 5 - 2) * 0.005).cast("double")
    rows = V.table(s, d, "benchmark").select(F.element_at(F.array(F.lit("heldout"), F.lit("probe"), F.lit("faulty")), (qid % 3 + 1).cast("int")).alias("set"), qid.alias("qid"), F.concat(F.lit("q"), qid.cast("string")).alias("gold_key"), F.when(has, F.col("item_id")).alias("component_id"), F.when(has, points).alias("points"))
    trained = V.table(s, d, "documents").where("doc_id % 3 = 2").select(F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("gold_key"))
    return C.question_gates(rows, trained)


register("question_gates", """WITH q AS (SELECT item_id // 5 AS qid, count(*) AS parts FROM benchmark GROUP BY 1),
g AS (SELECT qid, ['heldout', 'probe', 'faulty'][qid % 3 + 1] AS name, CASE WHEN qid % 3 = 1 AND qid % 2 = 0 THEN 0 ELSE parts END AS parts, parts AS items FROM q)
SELECT name AS "set", count(*) FILTER (qid % 3 = 2 AND qid IN (SELECT doc_id FROM documents)) = 0 AS unseen, min(parts) > 0 AS has_components, bool_and(parts = 5 AND name <> 'faulty') AS full_points FROM g GROUP BY 1""")(_question_sets)
register("holdout_params", V.with_(V.BARS) + "SELECT ticker, year(day) AS year, ticker = '5-LOW' OR year(day) = 1999 AS held_out, count(*) AS n FROM bars GROUP BY ALL")(lambda s, d: V.bars(s, d).groupBy("ticker", F.year("day").alias("year")).agg(F.count("*").alias("n")).withColumn("held_out", (F.col("ticker") == "5-LOW") | (F.col("year") == 1999)))
register("perturb_mix", _E + f", p AS (SELECT {_MIX.format('example_id', 99)} % 100 AS pick, {_MIX.format('example_id', 7)} % 100 AS gate FROM examples) SELECT CASE WHEN gate >= 35 THEN 'none' WHEN pick < 30 THEN 'coverage_probe' WHEN pick < 55 THEN 'distractor' WHEN pick < 75 THEN 'shuffle' WHEN pick < 90 THEN 'contradictory_duplicate' ELSE 'truncate' END AS kind, count(*) AS n FROM p GROUP BY 1")(lambda s, d: _x(s, d).groupBy(C.perturbation(F.col("example_id")).alias("kind")).agg(F.count("*").alias("n")))


def _blocks(s, d):
    """Conversations as examples with a list of evidence blocks; ids and texts of their turns in order."""
    turns = V.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))).alias("blocks"), F.transform("t", lambda x: F.coalesce(x["role"], F.lit(""))).alias("components"))


_BL = "bl AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, role, text) AS blocks, list(coalesce(role, '') ORDER BY turn, role, text) AS components FROM conversations GROUP BY 1)"
register("negatives", "WITH " + _BL + f", p AS (SELECT *, {_MIX.format('conv_id', 5)} % len(blocks) AS pick FROM bl WHERE len(blocks) >= 2) SELECT conv_id, sha256(array_to_string(list_concat(blocks[1:pick], blocks[pick + 2:]), '|')) AS blocks, array_to_string(components[1:len(components) - 1], '|') AS components FROM p")(
    lambda s, d: C.drop_component(_blocks(s, d), "blocks", "components", "conv_id").select("conv_id", F.sha2(F.array_join("blocks", "|"), 256).alias("blocks"), F.array_join("components", "|").alias("components"))
)
register("perturb_blocks", "WITH " + _BL + f""", p AS (SELECT *, {_MIX.format('conv_id', 99)} % 100 AS pick, {_MIX.format('conv_id', 7)} % 100 AS gate FROM bl)
SELECT conv_id, sha256(array_to_string(CASE WHEN gate >= 35 THEN blocks WHEN pick < 30 THEN list_concat(['coverage'], blocks) WHEN pick < 55 THEN list_concat(blocks, ['distractor']) WHEN pick < 75 THEN list_reverse(blocks) WHEN pick < 90 THEN list_concat(blocks, [blocks[1] || ' (revised)']) ELSE list_transform(blocks, lambda b: substr(b, 1, 40)) END, '|')) AS blocks FROM p""")(
    lambda s, d: _blocks(s, d).select("conv_id", F.sha2(F.array_join(C.perturb(F.col("blocks"), C.perturbation(F.col("conv_id")), F.lit("coverage"), F.lit("distractor")), "|"), 256).alias("blocks"))
)
register("evidence_conditions", "WITH " + _BL + ", c AS (SELECT conv_id, 'clean' AS condition, blocks FROM bl UNION ALL SELECT conv_id, 'noisy', list_concat(['noise'], blocks) FROM bl UNION ALL SELECT conv_id, 'insufficient', blocks[1:len(blocks) - 1] FROM bl UNION ALL SELECT conv_id, 'shuffled', list_reverse(blocks) FROM bl) SELECT conv_id, condition, sha256(array_to_string(blocks, '|')) AS blocks FROM c")(
    lambda s, d: _blocks(s, d).select("conv_id", F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.sha2(F.array_join(e, "|"), 256).alias("blocks")) for n, e in (("clean", F.col("blocks")), ("noisy", F.concat(F.array(F.lit("noise")), "blocks")), ("insufficient", F.slice("blocks", F.lit(1), F.size("blocks") - 1)), ("shuffled", F.reverse("blocks")))])).alias("x")).select("conv_id", "x.*")
)
register("corpus_records", "SELECT conv_id, sha256(array_to_string(list(coalesce(role, '') || ': ' || coalesce(text, '') ORDER BY turn, role, text), chr(10))) AS record_sha256, count(*) AS messages FROM conversations GROUP BY 1")(
    lambda s, d: V.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t")).select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: F.concat(F.coalesce(x["role"], F.lit("")), F.lit(": "), F.coalesce(x["text"], F.lit("")))), "\n"), 256).alias("record_sha256"), F.size("t").cast("bigint").alias("messages"))
)
register("corpus_io", _E + "SELECT example_id, question AS input, sha256(answer) AS output_sha256 FROM examples")(lambda s, d: _x(s, d).select("example_id", F.col("question").alias("input"), F.sha2("answer", 256).alias("output_sha256")))


def _generated(s, d):
    """Examples from a metric: every year's basket as a question with one or two components."""
    rows = P.rank_annual_returns(V.bars(s, d)).where("place <> 'between'")
    each = rows.groupBy("year").agg(F.max(F.when(F.col("place") == "best", F.concat_ws(" ", "ticker", F.format_string("%.4f", "return_pct")))).alias("best"), F.max(F.when(F.col("place") == "worst", F.concat_ws(" ", "ticker", F.format_string("%.4f", "return_pct")))).alias("worst"))
    sets = S.combinations(F.array(F.lit("best"), F.lit("worst")), 1, 2)
    exploded = each.select("year", "best", "worst", F.explode(sets).alias("asked"))
    answer = F.array_join(F.transform("asked", lambda a: F.when(a == "best", F.col("best")).otherwise(F.col("worst"))), "; ")
    return exploded.select("year", F.concat(F.lit("Which ticker was "), F.array_join("asked", " and "), F.lit(" in "), F.col("year").cast("string"), F.lit("?")).alias("question"), answer.alias("answer"))


register("gen_examples", V.with_(V.BARS) + """, ann AS (SELECT ticker, year, round((l / f - 1) * 100, 4) AS return_pct FROM (SELECT ticker, year(day) AS year, count(*) AS n, arg_min(close, day) AS f, arg_max(close, day) AS l FROM bars GROUP BY 1, 2) WHERE n >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY return_pct DESC, ticker) AS u, row_number() OVER (PARTITION BY year ORDER BY return_pct, ticker DESC) AS v FROM ann),
e AS (SELECT year, max(CASE WHEN u = 1 THEN printf('%s %.4f', ticker, return_pct) END) AS best, max(CASE WHEN v = 1 THEN printf('%s %.4f', ticker, return_pct) END) AS worst FROM r GROUP BY 1)
SELECT year, 'Which ticker was best in ' || year || '?' AS question, best AS answer FROM e UNION ALL SELECT year, 'Which ticker was worst in ' || year || '?', worst FROM e UNION ALL SELECT year, 'Which ticker was best and worst in ' || year || '?', best || '; ' || worst FROM e""")(_generated)
register("negatives_empty", "SELECT conv_id, '' AS blocks, 'no grounded answer can be given' AS components, 'The supplied data does not contain the evidence needed to answer this question, so no grounded answer can be given.' AS answer FROM conversations GROUP BY 1")(
    lambda s, d: C.empty_trace(_blocks(s, d), "blocks", "components").select("conv_id", F.array_join("blocks", "|").alias("blocks"), F.array_join("components", "|").alias("components"), "answer")
)


def _paraphrases(s, d):
    """A question and a variant of it that keeps the year, loses it, changes it, or is too short."""
    year = (F.lit(1990) + F.col("example_id") % 30).cast("string")
    variants = [F.concat(F.lit("Tell me what the basket did in "), year), F.lit("Tell me what the basket did"), F.concat(F.lit("Tell me what the basket did in "), (F.lit(1991) + F.col("example_id") % 30).cast("string")), F.concat(year, F.lit("?"))]
    variant = F.coalesce(*[F.when(F.col("example_id") % 4 == k, v) for k, v in enumerate(variants)])
    return _x(s, d).select("example_id", C.plausible(variant, F.concat(F.lit("What happened to the basket in "), year, F.lit("?"))).alias("plausible"))


register("paraphrase_plausible", "SELECT doc_id AS example_id, doc_id % 4 = 0 AS plausible FROM documents")(_paraphrases)
register("paraphrase_expand", _E + r""", v AS (SELECT example_id, gold_key, answer, list_filter(list_transform(string_split_regex(answer, '\r\n|\r|\n'), lambda l: regexp_replace(regexp_replace(l, '^\s*[-*0-9. ]*\s*"*', ''), '"*\s*$', '')),
 lambda l: l <> '' AND l <> question AND length(l) BETWEEN 15 AND 400 AND len(list_filter(regexp_extract_all(question, '\b(?:19|20)\d{2}\b|\b[A-Z]{2,4}\.AX\b'), lambda h: NOT contains(l, h))) = 0 AND (NOT contains(question, 'xclud') OR contains(l, 'xclud'))) AS found FROM examples),
k AS (SELECT *, unnest([1, 2]) AS nth FROM v) SELECT example_id, example_id || '.p' || nth AS template_id, found[nth] AS question, gold_key, sha256(answer) AS answer_sha256, 'paraphrase' AS perturbations FROM k WHERE nth <= len(found)""")(
    # The lines of an answer stand in for a model's reply.
    lambda s, d: C.paraphrased(_x(s, d).select("example_id", F.col("example_id").alias("template_id"), "question", "gold_key", F.sha2("answer", 256).alias("answer_sha256"), F.lit(None).cast("array<string>").alias("perturbations"), F.col("answer").alias("reply"))).withColumn("perturbations", F.array_join("perturbations", ","))
)
register("span_grounded", _E + ", x AS (SELECT example_id, answer, CASE WHEN example_id % 3 = 0 THEN '' ELSE string_split(answer, chr(10))[-1] END || CASE WHEN example_id % 5 = 0 THEN ' #' ELSE '' END AS span FROM examples) SELECT example_id, contains(lower(answer), substr(lower(span), 1, 60)) AS grounded FROM x")(
    lambda s, d: _x(s, d).select("example_id", C.grounded(F.concat(F.when(F.col("example_id") % 3 == 0, "").otherwise(F.element_at(F.split("answer", "\n", -1), -1)), F.when(F.col("example_id") % 5 == 0, " #").otherwise("")), F.col("answer")).alias("grounded"))
)

LABELS = ("strong_positive", "positive", "mixed", "negative", "strong_negative")


def _votes(s, d):
    rows = V.table(s, d, "documents").select("doc_id")
    names = F.array(*[F.lit(x) for x in LABELS])
    votes = rows.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("position")).withColumn("label", F.get(names, F.pmod(F.floor(F.col("doc_id") / 3) + F.pmod(F.col("doc_id") * (F.col("position") + 1), F.lit(3)) % 2, F.lit(5)).cast("int")))
    return votes.withColumn("coarse", S.coarse(F.col("label")))


register("label_vote", """WITH v AS (SELECT doc_id, p AS position, ['strong_positive', 'positive', 'mixed', 'negative', 'strong_negative'][1 + (doc_id // 3 + ((doc_id * (p + 1)) % 3) % 2) % 5] AS label FROM documents, (SELECT unnest([0, 1, 2]) AS p)),
w AS (SELECT *, CASE WHEN label IN ('strong_positive', 'positive') THEN 'pos' WHEN label IN ('negative', 'strong_negative') THEN 'neg' ELSE 'mix' END AS coarse FROM v),
e AS (SELECT doc_id, label, count(*) AS n, min(position) AS seen FROM w GROUP BY ALL)
SELECT doc_id, arg_max(label, (n, -seen)) AS label, CAST(sum(n) AS BIGINT) AS votes FROM e GROUP BY 1 HAVING sum(n) >= 3 AND doc_id IN (SELECT doc_id FROM w GROUP BY 1 HAVING count(DISTINCT coarse) = 1)""")(lambda s, d: C.vote(_votes(s, d), "doc_id"))
