"""Scoring and comparison queries over the question bank and transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaymark.functions import compact
from quaymark.functions import grading as G
from quaymark.functions import scalars as S
from quaymark.operators import corpus as C
from quaymark.operators import evaluation as E
from quaymark.operators import prices as P
from quaymark.plans.catalogue import register
from quaymark.sources import files
from quaymark.sources import views as V

_A = V.with_(V.ARMS)
_Q = _A + ", q AS (SELECT qid, arm, CAST(sum(points) AS BIGINT) AS earned, count(*) AS components FROM arms GROUP BY 1, 2)"
_P = _Q + ", s AS (SELECT qid, arm, round(earned / components, 4) AS score FROM q), pr AS (SELECT a.qid, a.score AS a, b.score AS b, round(b.score - a.score, 4) AS diff FROM s a JOIN s b ON a.qid = b.qid AND a.arm = 'base' AND b.arm = 'tuned')"


NOTE = "Counts and RBA values are exact; returns +/- 0.02; correlations allow +/- 0.001; closes allow +/- 0.0001; volume allows +/- 1 share."


def _facts(s, d):
    """A fact, an answer and a tolerance note for each item, of six kinds of numbers: the answer is off by so many steps of the kind, sometimes hedged, sometimes without the date, and every seventh note declares nothing."""
    i = F.col("item_id")
    kind, off = i % 6, F.pmod(i * 13, F.lit(7)) - 3
    value = F.pmod(i * 37, F.lit(1000)) / 10.0 + 1
    day = F.date_add(F.lit("2019-01-01").cast("date"), F.pmod(i * 11, F.lit(365)).cast("int"))
    steps = {0: (0.015, "the basket's return was %.3f%%"), 1: (0.0007, "a correlation of %.4f"), 2: (0.00007, "the closing price of %.5f"), 3: (0.7, "an average volume of %,.2f shares"), 4: (1.0, "%.0f changes in all"), 5: (0.01, "a cash rate of %.2f%%")}
    said = lambda shift: F.coalesce(*[F.when(kind == k, F.format_string(text, (F.floor(value) if k == 4 else value) + shift * step)) for k, (step, text) in steps.items()])
    dated = F.when(i % 4 == 1, F.concat(F.lit(" in "), F.date_format(day, "MMM yyyy"))).otherwise(F.concat(F.lit(" on "), F.date_format(day, "d MMM yyyy")))
    answer = F.concat(F.when(i % 5 == 0, "roughly, ").otherwise("it was "), said(off), F.when(F.floor(i / 6) % 5 == 0, "").otherwise(F.concat(F.lit(" on "), F.date_format(day, "yyyy-MM-dd"))))
    note = F.when(i % 7 == 0, "").otherwise(NOTE)
    return V.table(s, d, "benchmark").select("item_id", (i % 12).alias("qid"), F.concat(said(F.lit(0)), dated).alias("fact"), answer.alias("answer"), note.alias("note"), (F.pmod(i * 7, F.lit(10)) < 8).alias("judged"))


# What the rules say of those answers, without reading them: steps of a kind within its tolerance, a date that is named, a hedge.
_F = """f AS (SELECT item_id, item_id % 12 AS qid, item_id % 6 AS kind, (item_id * 13) % 7 - 3 AS off, (item_id * 7) % 10 < 8 AS judged FROM benchmark),
c AS (SELECT item_id, qid, judged, CASE WHEN (item_id // 6) % 5 = 0 THEN 'FAIL' WHEN off = 0 THEN 'PASS' WHEN item_id % 7 = 0 OR kind IN (4, 5) THEN 'FAIL' WHEN abs(off) <= 1 THEN 'PASS' ELSE 'FAIL' END AS numeric, item_id % 5 = 0 AS hedged FROM f),
graded AS (SELECT *, judged AND numeric <> 'FAIL' AS strict, judged <> (numeric = 'PASS') AS disagree FROM c)
"""


def _graded(s, d):
    rows = _facts(s, d).select("item_id", "qid", "judged", G.numeric_check(F.col("fact"), F.col("answer"), F.col("note")).alias("numeric"), G.hedged(F.col("answer")).alias("hedged"))
    return rows.select("*", (F.col("judged") & (F.col("numeric") != "FAIL")).alias("strict"), ((F.col("numeric") != "N/A") & (F.col("judged") != (F.col("numeric") == "PASS"))).alias("disagree"))


register("score_components", "WITH " + _F + "SELECT * FROM graded")(_graded)
register("score_aggregate", "WITH " + _F + "SELECT count(*) AS components, count(*) FILTER (judged) AS yes, count(*) FILTER (strict) AS strict_yes, round(avg(CAST(judged AS INTEGER)), 4) AS score, round(avg(CAST(strict AS INTEGER)), 4) AS strict_score, round(avg(CAST(disagree AS INTEGER)), 4) AS disagreement, count(*) FILTER (hedged) AS hedged FROM graded")(
    lambda s, d: _graded(s, d).agg(F.count("*").alias("components"), F.count_if("judged").alias("yes"), F.count_if("strict").alias("strict_yes"), F.round(F.avg(F.col("judged").cast("int")), 4).alias("score"), F.round(F.avg(F.col("strict").cast("int")), 4).alias("strict_score"), F.round(F.avg(F.col("disagree").cast("int")), 4).alias("disagreement"), F.count_if("hedged").alias("hedged"))
)
register("score_question", _Q + " SELECT qid, arm, earned, components FROM q")(lambda s, d: E.question_scores(V.arms(s, d)))


def _grouped(s, d):
    """Two independent groupings of one pass."""
    rows = _graded(s, d).select("judged", F.when(F.col("qid") % 3 == 0, "easy").when(F.col("qid") % 3 == 1, "medium").otherwise("hard").alias("difficulty"), F.when(F.col("qid") % 2 == 0, "single").otherwise("cross").alias("scope"))
    sets = rows.groupingSets([[F.col("difficulty")], [F.col("scope")]], "difficulty", "scope").agg(F.count("*").alias("components"), F.count_if("judged").alias("yes"))
    return sets.select("difficulty", "scope", "components", "yes")


register("score_by_group", "WITH " + _F + ", h AS (SELECT judged, CASE qid % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty, CASE qid % 2 WHEN 0 THEN 'single' ELSE 'cross' END AS scope FROM graded) SELECT difficulty, scope, count(*) AS components, count(*) FILTER (judged) AS yes FROM h GROUP BY GROUPING SETS ((difficulty), (scope))")(_grouped)
register("paired_delta", _P + " SELECT count(*) AS questions, round(avg(a), 4) AS mean_base, round(avg(b), 4) AS mean_other, round(avg(diff), 4) AS delta, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff = 0) AS ties FROM pr")(lambda s, d: E.compare(E.paired(V.arms(s, d))))
register("paired_bootstrap", _P + """, num AS (SELECT diff, row_number() OVER (ORDER BY qid) - 1 AS nth FROM pr), m AS (SELECT count(*) AS n FROM pr),
dr AS (SELECT r, ((((r * 7919 + k * 104729) % 2147483647) * 1103515245 + 3) % 2147483647 // 65536) % n AS nth FROM m, range(2000) t(r), range(1000) u(k) WHERE k < n),
me AS (SELECT r, round(avg(diff), 6) AS mean FROM dr JOIN num USING (nth) GROUP BY 1), pl AS (SELECT mean, row_number() OVER (ORDER BY mean, r) - 1 AS place FROM me)
SELECT max(mean) FILTER (place = 50) AS low, max(mean) FILTER (place = 1950) AS high FROM pl""")(lambda s, d: E.bootstrap(E.paired(V.arms(s, d))))
register("sign_flip_p", _P + """, num AS (SELECT diff, CAST(row_number() OVER (ORDER BY qid) - 1 AS INTEGER) AS nth FROM pr WHERE diff <> 0),
mk AS (SELECT mask FROM range(1048576) t(mask) WHERE mask < (SELECT pow(2, count(*)) FROM num)),
su AS (SELECT mask, abs(sum(CASE WHEN (mask >> nth) & 1 = 1 THEN -diff ELSE diff END)) AS sum FROM mk, num GROUP BY 1)
SELECT count(*) AS patterns, round(avg(CAST(sum >= (SELECT abs(sum(diff)) FROM num) - 1e-9 AS INTEGER)), 6) AS p FROM su""")(lambda s, d: E.sign_flip(E.paired(V.arms(s, d))))
register("arm_diff", _A + " SELECT count(*) AS items, count(*) FILTER (a.points <> b.points) AS differing FROM arms a JOIN arms b USING (item_id) WHERE a.arm = 'base' AND b.arm = 'tuned'")(
    lambda s, d: (lambda x: x.where("arm = 'base'").select("item_id", F.col("points").alias("p")).join(x.where("arm = 'tuned'"), "item_id").agg(F.count("*").alias("items"), F.count_if(F.col("p") != F.col("points")).alias("differing")))(V.arms(s, d))
)
register("judge_agreement", "SELECT count(*) AS cases, round(avg(CAST((quality > 0) = (toxic = 0) AS INTEGER)), 6) AS agreement, count(*) FILTER (quality > 0 AND toxic <> 0) AS misses, avg(CAST((quality > 0) = (toxic = 0) AS INTEGER)) >= 0.95 AND count(*) FILTER (quality > 0 AND toxic <> 0) = 0 AS passes FROM labels")(
    lambda s, d: E.agreement(V.table(s, d, "labels").select((F.col("quality") > 0).alias("expected"), (F.col("toxic") == 0).alias("verdict")))
)


def _logprobs(s, d):
    pair = F.array(F.struct(F.lit("Yes").alias("token"), (-(F.col("item_id") % 5 + 1) / 4.0).alias("logprob")), F.struct(F.lit(" no").alias("token"), (-(F.col("item_id") % 3 + 1) / 4.0).alias("logprob")), F.struct(F.lit("maybe").alias("token"), F.nullif(F.lit(-0.1), F.lit(0.0)).alias("logprob")))
    p = E.yes_probability(pair)
    return V.table(s, d, "benchmark").select("item_id", F.round(p, 6).alias("p_yes"), (p >= 0.5).alias("verdict"))


register("verdict_from_logprobs", "WITH p AS (SELECT item_id, exp(-(item_id % 5 + 1) / 4.0) AS y, exp(-(item_id % 3 + 1) / 4.0) AS n FROM benchmark) SELECT item_id, round(y / (y + n), 6) AS p_yes, y / (y + n) >= 0.5 AS verdict FROM p")(_logprobs)


def _traces(s, d):
    each = V.table(s, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("calls"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    middle = C.quantiles(each, "chars").select(F.col("p50").alias("p50_chars"), F.col("most").alias("max_chars"))
    return each.agg(F.count("*").alias("traces"), F.round(F.avg("calls"), 4).alias("mean_calls")).join(middle, F.lit(True))


register("trace_stats", "WITH e AS (SELECT conv_id, count(*) AS calls, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM conversations GROUP BY 1), l AS (SELECT list(chars ORDER BY chars) AS c FROM e) SELECT count(*) AS traces, round(avg(calls), 4) AS mean_calls, (SELECT c[len(c) // 2 + 1] FROM l) AS p50_chars, max(chars) AS max_chars FROM e")(_traces)


def _telemetry(s, d):
    last = V.table(s, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).withColumn("nth", F.expr("row_number() over (order by ts desc, event_id desc)"))
    return last.agg(F.count("*").alias("requests"), F.round(F.avg("value"), 4).alias("mean_value"), F.round(F.max("value"), 4).alias("max_value"), F.count_if((F.col("nth") <= 20) & (F.col("value") > 50)).alias("slow_of_20"))


register("recent_telemetry", "WITH l AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS nth FROM events QUALIFY nth <= 50) SELECT count(*) AS requests, round(avg(value), 4) AS mean_value, round(max(value), 4) AS max_value, count(*) FILTER (nth <= 20 AND value > 50) AS slow_of_20 FROM l")(_telemetry)
register("answer_metrics_summary", V.with_(V.EXAMPLES) + r"""SELECT category, count(*) AS n, round(avg(CAST(length(trim(answer)) = 0 AS INTEGER)), 4) AS empty_rate, round(avg(CAST(regexp_matches(answer, '(?i)<think>') AS INTEGER)), 4) AS leaked_rate, max(length(answer)) AS max_chars FROM examples GROUP BY 1""")(
    lambda s, d: V.examples(s, d).groupBy("category").agg(F.count("*").alias("n"), F.round(F.avg((F.length(F.trim("answer")) == 0).cast("int")), 4).alias("empty_rate"), F.round(F.avg(F.col("answer").rlike("(?i)<think>").cast("int")), 4).alias("leaked_rate"), F.max(F.length("answer")).cast("bigint").alias("max_chars"))
)


def _dialogues(s, d):
    """Of each conversation the last turn as an answer, and all others as its evidence."""
    turns = V.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    texts = F.transform("t", lambda x: F.coalesce(x["text"], F.lit("")))
    return turns.select("conv_id", texts.alias("texts")).select("conv_id", F.concat(F.lit("1) "), F.element_at("texts", -1), (F.col("conv_id") % 3).cast("string"), F.lit(".250 of 1,0"), F.lpad((F.col("conv_id") % 100).cast("string"), 2, "0")).alias("answer"), F.slice("texts", F.lit(1), F.size("texts") - 1).alias("evidence"))


_NORMAL = "CASE WHEN replace({0}, ',', '') = '' THEN '0' WHEN contains({0}, '.') THEN regexp_replace(regexp_replace(ltrim(replace({0}, ',', ''), '+-'), '0+$', ''), '\\.$', '') ELSE ltrim(replace({0}, ',', ''), '+-') END"
_DIALOGUES = r"""t AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, role, text) AS texts FROM conversations GROUP BY 1),
dl AS (SELECT conv_id, '1) ' || texts[len(texts)] || (conv_id % 3) || '.250 of 1,0' || lpad(CAST(conv_id % 100 AS VARCHAR), 2, '0') AS answer, texts[1:len(texts) - 1] AS evidence FROM t),
ev AS (SELECT DISTINCT conv_id, """ + _NORMAL.format("tok") + r""" AS n FROM (SELECT conv_id, unnest(regexp_extract_all(body, '[-+]?\d[\d,]*(?:\.\d+)?')) AS tok FROM (SELECT conv_id, unnest(evidence) AS body FROM dl))),
kn AS (SELECT conv_id, n FROM ev UNION SELECT conv_id, """ + _NORMAL.format("v") + r""" FROM (SELECT conv_id, unnest([printf('%.0f', CAST(n AS DOUBLE)), printf('%.1f', CAST(n AS DOUBLE)), printf('%.2f', CAST(n AS DOUBLE)), printf('%.3f', CAST(n AS DOUBLE)), printf('%.4f', CAST(n AS DOUBLE))]) AS v FROM ev)),
tk AS (SELECT conv_id, answer, raw, """ + _NORMAL.format("raw") + r""" AS n FROM (SELECT conv_id, answer, unnest(regexp_extract_all(answer, '[-+]?\d[\d,]*(?:\.\d+)?')) AS raw FROM dl)),
un AS (SELECT conv_id, count(*) AS ungrounded FROM tk WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.conv_id = tk.conv_id AND kn.n = tk.n) AND NOT (n IN ('1', '2', '3', '4', '5') AND regexp_matches(answer, '(?m)(?:^|[;\s])' || regexp_escape(raw) || '[).:]\s')) GROUP BY 1)
"""
register("numbers_missing", "WITH " + _DIALOGUES + "SELECT conv_id, CAST(coalesce(ungrounded, 0) AS BIGINT) AS ungrounded FROM dl LEFT JOIN un USING (conv_id)")(
    lambda s, d: _dialogues(s, d).select("conv_id", F.size(G.ungrounded(F.col("answer"), F.col("evidence"))).cast("bigint").alias("ungrounded"))
)
_BEGINS = ("<think>so", "Okay, so", "Use ```", '{ "a": 1', "Hmm. tool_trace", "about 5")
_FLAGS = f"""SELECT conv_id, turn, {V.leaked_sql('body')} AS leaked, {V.misformatted_sql('body')} AS misformatted
FROM (SELECT conv_id, turn, CASE conv_id % 7 WHEN 0 THEN '<think>so' WHEN 1 THEN 'Okay, so' WHEN 2 THEN 'Use ```' WHEN 3 THEN '{{ "a": 1' WHEN 4 THEN 'Hmm. tool_trace' WHEN 5 THEN 'about 5' ELSE '' END || ' ' || coalesce(text, '') AS body FROM conversations)"""
register("answer_flags", _FLAGS)(
    lambda s, d: V.table(s, d, "conversations").withColumn("body", F.concat_ws(" ", F.coalesce(*[F.when(F.col("conv_id") % 7 == k, F.lit(b)) for k, b in enumerate(_BEGINS)], F.lit("")), F.coalesce("text", F.lit("")))).select("conv_id", "turn", G.leaked(F.col("body")).alias("leaked"), G.misformatted(F.col("body")).alias("misformatted"))
)


def _cells(s, d):
    """Answers of two arms under four conditions, with their signals."""
    text = F.col("answer")
    rows = _dialogues(s, d).withColumn("answer", F.when(F.col("conv_id") % 11 == 0, " ").otherwise(text))
    return rows.select(
        F.when(F.col("conv_id") % 2 == 0, "base").otherwise("tuned").alias("arm"), F.element_at(F.array(*[F.lit(c) for c in ("clean", "noisy", "insufficient", "shuffled")]), (F.floor(F.col("conv_id") / 2) % 4 + 1).cast("int")).alias("condition"),
        (F.col("conv_id") % 4).alias("earned"), F.lit(3).alias("components"), F.regexp_count(text, F.lit(r"\S+")).cast("bigint").alias("words"), G.hedged(text).alias("hedged"), (F.size(G.ungrounded(text, F.col("evidence"))) > 0).alias("ungrounded"),
        G.leaked(text).alias("leaked"), G.misformatted(text).alias("misformatted"), (F.trim(text) == "").alias("empty"),
    )


register("arm_condition_grid", "WITH " + _DIALOGUES + r""", a AS (SELECT conv_id, CASE WHEN conv_id % 11 = 0 THEN ' ' ELSE answer END AS answer, CASE WHEN conv_id % 11 = 0 THEN 0 ELSE coalesce(ungrounded, 0) END AS ung FROM dl LEFT JOIN un USING (conv_id)),
x AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS arm, ['clean', 'noisy', 'insufficient', 'shuffled'][conv_id // 2 % 4 + 1] AS condition, conv_id % 4 AS earned, len(regexp_extract_all(answer, '\S+')) AS words, ung > 0 AS u, trim(answer) = '' AS e,
 """ + f"{V.hedged_sql('answer')} AS h, {V.leaked_sql('answer')} AS l, {V.misformatted_sql('answer')} AS m " + """FROM a)
SELECT arm, condition, count(*) AS n, round(sum(earned) / (3 * count(*)), 4) AS score, round(avg(CAST(h AS INTEGER)), 4) AS hedged_rate, round(avg(CAST(u AS INTEGER)), 4) AS ungrounded_rate, round(avg(CAST(l AS INTEGER)), 4) AS leaked_rate, round(avg(CAST(m AS INTEGER)), 4) AS misformatted_rate, round(avg(CAST(e AS INTEGER)), 4) AS empty_rate, max(words) AS words_max, list(words ORDER BY words)[count(*) // 2 + 1] AS words_p50 FROM x GROUP BY 1, 2""")(lambda s, d: E.grid(_cells(s, d)))


def _screened(s, d):
    """Days and months are written as in the fact for the screening, where the answer has a date; every second answer of two kinds says it in other words."""
    i = F.col("item_id")
    dated = F.when(F.floor(i / 6) % 5 == 0, "").otherwise(F.regexp_extract("fact", r" (?:on|in)( (?:\d+ )?\w+ \d+)$", 1))
    answer = F.concat(F.when(F.floor(i / 6) % 2 == 0, F.regexp_replace(F.regexp_replace("answer", "return", "gain"), "volume", "turnover")).otherwise(F.col("answer")), dated)
    x = G.screened(F.col("fact"), answer)
    return _facts(s, d).select("item_id", x.alias("x")).select("item_id", (F.size("x.missing") == 0).alias("numbers_told"), "x.coverage", "x.likely")


# A whole number is also told by a day of the month that is the same.
register("component_screen", """WITH f AS (SELECT item_id, (item_id * 13) % 7 - 3 AS off, item_id % 6 AS kind, (item_id // 6) % 5 = 0 AS undated, (item_id // 6) % 2 = 0 AS reworded, floor((item_id * 37) % 1000 / 10.0 + 1) AS whole, day(DATE '2019-01-01' + CAST((item_id * 11) % 365 AS INTEGER)) AS of_month FROM benchmark),
t AS (SELECT *, NOT undated AND (off = 0 OR kind = 4 AND item_id % 4 <> 1 AND whole = of_month) AS numbers_told FROM f)
SELECT item_id, numbers_told, CAST(CASE WHEN NOT reworded THEN 1 WHEN kind = 0 THEN 0.5 WHEN kind = 3 THEN 0.67 ELSE 1 END AS DOUBLE) AS coverage, numbers_told AS likely FROM t""")(_screened)


def _lines_screened(s, d):
    """Whether what follows a document's first line says that line again."""
    text = F.coalesce("text", F.lit(""))
    fact = F.element_at(F.split(text, "\n", -1), 1)
    parts = V.table(s, d, "documents").select("doc_id", fact.alias("fact"), F.substr(text, F.length(fact) + 2).alias("rest"))
    x = G.screened(F.col("fact"), F.col("rest"))
    return parts.select("doc_id", x.alias("x")).select("doc_id", F.size("x.missing").cast("bigint").alias("missing"), "x.coverage", "x.likely")


_TOLD = r"list_distinct(list_transform(regexp_extract_all({}, '-?[0-9]+(?:[.,][0-9]+)*'), lambda n: replace(n, ',', '')))"
register("screen_documents", r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, string_split(t, chr(10))[1] AS fact, lower(substr(t, length(string_split(t, chr(10))[1]) + 2)) AS rest FROM t),
m AS (SELECT doc_id, rest, """ + _TOLD.format("fact") + " AS asked, " + _TOLD.format("rest") + r""" AS told, list_filter(regexp_extract_all(lower(fact), '[a-z]{4,}'), lambda w: NOT list_contains(['the', 'and', 'with', 'that', 'from', 'were', 'this'], w)) AS words FROM p),
c AS (SELECT doc_id, len(list_filter(asked, lambda n: NOT list_contains(told, n))) AS missing, len(words) AS n, len(list_filter(words, lambda w: contains(rest, w))) AS hits FROM m)
SELECT doc_id, missing, CASE WHEN n > 0 THEN (200 * hits + n) // (2 * n) / 100.0 END AS coverage, missing = 0 AND (n = 0 OR hits >= greatest(1, n // 3)) AS likely FROM c""")(_lines_screened)
register("lookup_missing", "SELECT doc_id, 'found' AS status FROM documents JOIN labels USING (doc_id) UNION ALL SELECT DISTINCT doc_id, 'missing' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(
    lambda s, d: (lambda found, missing: found.select("doc_id", F.lit("found").alias("status")).union(missing.select("doc_id", F.lit("missing"))))(*files.lookup(V.table(s, d, "documents").select("doc_id"), V.table(s, d, "labels"), "doc_id", "doc_id"))
)


def _stats(s, d):
    b = V.bars(s, d)
    each = b.groupBy("ticker").agg(F.count("*").alias("n"))
    spread = each.agg(F.array_join(F.transform(F.array_sort(F.collect_set("n")), lambda x: x.cast("string")), ",").alias("rows_by_ticker"))
    return b.agg(F.count("*").alias("records"), F.min("day").alias("first_day"), F.max("day").alias("last_day")).join(spread, F.lit(True))


register("load_stats", V.with_(V.BARS) + "SELECT count(*) AS records, min(day) AS first_day, max(day) AS last_day, (SELECT array_to_string(list_sort(list(DISTINCT n)), ',') FROM (SELECT count(*) AS n FROM bars GROUP BY ticker)) AS rows_by_ticker FROM bars")(_stats)
register("scan_reconcile", "WITH e AS (SELECT source, count(*) AS expected FROM documents SEMI JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY 1 UNION ALL SELECT 'a source without rows', 7), l AS (SELECT source, count(*) AS loaded FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT source, coalesce(loaded, 0) AS loaded, coalesce(expected, 0) AS expected, coalesce(loaded, 0) = coalesce(expected, 0) AS agrees FROM e FULL JOIN l USING (source)")(
    # The labelled rows of each source stand in for a summary of what should have been loaded.
    lambda s, d: (lambda docs: files.reconcile(docs, docs.join(V.table(s, d, "labels").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("rows")).union(s.createDataFrame([("a source without rows", 7)], "source string, rows bigint")), "source"))(V.table(s, d, "documents").where("source is not null"))
)


def _compact(s, d):
    """The ranked volumes as text, a column that never changes named once; a row a ticker comes to the driver."""
    rows = P.volume_stats(V.bars(s, d)).orderBy("rank").select("rank", "ticker", F.col("total_volume").cast("bigint").alias("total"), F.lit("shares").alias("counted_in"))
    return s.createDataFrame([(compact.table("volume", [r.asDict() for r in rows.collect()]),)], "rendered string")


register("compact_render", V.with_(V.BARS) + ", v AS (SELECT ticker, CAST(round(sum(volume), 2) AS BIGINT) AS total, round(avg(volume), 2) AS m FROM bars GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY m DESC, ticker) AS rank FROM v) SELECT 'volume: ' || count(*) || ' rows; counted_in = shares' || chr(10) || 'rank' || chr(9) || 'ticker' || chr(9) || 'total' || chr(10) || string_agg(rank || chr(9) || ticker || chr(9) || total, chr(10) ORDER BY rank) AS rendered FROM r")(_compact)
register("constant_columns", V.with_(V.BARS) + """, b AS (SELECT ticker, day, volume, 'shares' AS unit FROM bars)
SELECT name, value FROM (SELECT 'ticker' AS name, min(ticker) AS value, count(DISTINCT ticker) AS n FROM b UNION ALL SELECT 'day', CAST(min(day) AS VARCHAR), count(DISTINCT day) FROM b UNION ALL SELECT 'volume', CAST(min(volume) AS VARCHAR), count(DISTINCT volume) FROM b UNION ALL SELECT 'unit', min(unit), count(DISTINCT unit) FROM b UNION ALL SELECT 'note', NULL, 1) WHERE n = 1 AND (SELECT count(*) FROM b) > 1""")(
    lambda s, d: compact.constants(V.bars(s, d).select("ticker", "day", "volume", F.lit("shares").alias("unit"), F.lit(None).cast("string").alias("note"), F.array("ticker").alias("listed")))
)


def _traces(s, d):
    """The turns of a conversation as a trace: every second one has a compact form, and conversations of one turn have no trace."""
    turns = V.table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    step = lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("tool"), F.concat(F.lit('{"turn": '), x["turn"].cast("string"), F.lit("}")).alias("args"), F.when(x["turn"] % 2 == 0, F.concat(F.lit("n = "), F.length(F.coalesce(x["text"], F.lit(""))).cast("string"))).otherwise("").alias("compact"), x["text"].alias("result"))
    trace = F.when(F.size("t") > 1, F.transform("t", step))
    return turns.select("conv_id", trace.alias("trace"))


def _evidence(s, d):
    return _traces(s, d).select("conv_id", F.sha2(S.evidence_text(F.col("trace")), 256).alias("evidence_sha256"))


register("evidence_text", """WITH t AS (SELECT conv_id, list({'r': coalesce(role, ''), 'n': turn, 'x': coalesce(text, '')} ORDER BY turn, role, text) AS t FROM conversations GROUP BY 1)
SELECT conv_id, sha256(CASE WHEN len(t) > 1 THEN array_to_string(list_transform(t, lambda e, i: '[' || i || '] ' || e.r || '({"turn": ' || e.n || '})' || chr(10) || CASE WHEN e.n % 2 = 0 THEN 'n = ' || length(e.x) ELSE e.x END), chr(10) || chr(10)) ELSE 'No tool results were gathered.' END) AS evidence_sha256 FROM t""")(_evidence)


register("arm_comparison", _P + """, num AS (SELECT diff, CAST(row_number() OVER (ORDER BY qid) - 1 AS INTEGER) AS nth FROM pr), m AS (SELECT count(*) AS n FROM pr),
dr AS (SELECT r, ((((r * 7919 + k * 104729) % 2147483647) * 1103515245 + 3) % 2147483647 // 65536) % n AS nth FROM m, range(2000) t(r), range(1000) u(k) WHERE k < n),
me AS (SELECT r, round(avg(diff), 6) AS mean FROM dr JOIN num USING (nth) GROUP BY 1), pl AS (SELECT mean, row_number() OVER (ORDER BY mean, r) - 1 AS place FROM me),
ci AS (SELECT max(mean) FILTER (place = 50) AS low, max(mean) FILTER (place = 1950) AS high FROM pl),
nz AS (SELECT diff, CAST(row_number() OVER (ORDER BY qid) - 1 AS INTEGER) AS nth FROM pr WHERE diff <> 0),
su AS (SELECT mask, abs(sum(CASE WHEN (mask >> nth) & 1 = 1 THEN -diff ELSE diff END)) AS sum FROM range(1048576) t(mask), nz WHERE mask < (SELECT pow(2, count(*)) FROM nz) GROUP BY 1),
p AS (SELECT round(avg(CAST(sum >= (SELECT abs(sum(diff)) FROM nz) - 1e-9 AS INTEGER)), 6) AS p FROM su),
c AS (SELECT count(*) AS questions, round(avg(a), 4) AS mean_base, round(avg(b), 4) AS mean_other, round(avg(diff), 4) AS delta, count(*) FILTER (diff > 0) AS wins, count(*) FILTER (diff < 0) AS losses, count(*) FILTER (diff = 0) AS ties FROM pr)
SELECT *, low > 0 OR high < 0 AS significant FROM c, ci, p""")(lambda s, d: E.comparison(E.paired(V.arms(s, d))))


def _answers(s, d):
    """Last turns as answers of three arms: one repeats the base's, one changes those of every third conversation."""
    last = V.table(s, d, "conversations").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "role", "text")).alias("answer"))
    other = F.when(F.col("conv_id") % 3 == 0, F.concat_ws("", "answer", F.lit("."))).otherwise(F.col("answer"))
    arms = F.array(*[F.struct(F.lit(arm).alias("arm"), text.alias("answer")) for arm, text in (("base", F.col("answer")), ("copy", F.col("answer")), ("tuned", other))])
    return last.select(F.col("conv_id").alias("qid"), F.inline(arms))


register("arm_applied", "WITH n AS (SELECT count(DISTINCT conv_id) AS n, count(DISTINCT conv_id) FILTER (conv_id % 3 = 0) AS k FROM conversations) SELECT 'copy' AS arm, n AS identical, 0 AS differing, 'NOT APPLIED' AS verdict FROM n UNION ALL SELECT 'tuned', n - k, k, CASE WHEN k > 0 THEN 'APPLIED' ELSE 'NOT APPLIED' END FROM n")(lambda s, d: E.applied(_answers(s, d)))
register("fn_hedge_words", V.with_(V.EXAMPLES) + "SELECT example_id, len(list_filter(['approximately', 'roughly', 'about', 'around', 'circa', 'approx', 'nearly', 'an estimated', 'in the region of', 'or so', '~'], lambda w: strpos(lower(answer || CASE WHEN example_id % 4 = 0 THEN ' Or so.' ELSE '' END), w) > 0)) > 0 AS hedged FROM examples")(
    lambda s, d: V.examples(s, d).select("example_id", G.hedge_words(F.concat("answer", F.when(F.col("example_id") % 4 == 0, " Or so.").otherwise(""))).alias("hedged"))
)


def _trace_numbers(s, d):
    """Numbers of conversations as traces: a turn's text is a result, its number and length are arguments."""
    turns = V.table(s, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.lit(None).cast("string").alias("compact"), F.col("text").alias("result"), F.to_json(F.struct("turn", F.format_number(F.length(F.coalesce("text", F.lit(""))) * 1000, 0).alias("chars"))).alias("args"))).alias("trace"))
    return turns.select("conv_id", F.array_join(F.array_sort(G.trace_numbers(F.col("trace"))), " ").alias("numbers"))


register("trace_numbers", r"""WITH b AS (SELECT conv_id, unnest([coalesce(text, ''), CAST(turn AS VARCHAR), format('{:,}', length(coalesce(text, '')) * 1000)]) AS body FROM conversations),
k AS (SELECT conv_id, unnest(regexp_extract_all(body, '[-+]?\d[\d,]*(?:\.\d+)?')) AS tok FROM b),
n AS (SELECT DISTINCT conv_id, """ + _NORMAL.format("tok") + r""" AS n FROM k) SELECT c.conv_id, coalesce(string_agg(n, ' ' ORDER BY n), '') AS numbers FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n USING (conv_id) GROUP BY 1""")(_trace_numbers)


SERVED = "Answer from the evidence."


def _captures(s, d):
    """Prompts as they were served, and once more, cut after 200 characters and under another system prompt where the id is odd."""
    rendered = C.user_prompt(F.concat(F.lit("What was said in "), F.col("conv_id").cast("string"), F.lit("?")), S.evidence_text(F.col("trace")))
    rows = _traces(s, d).select("conv_id", rendered.alias("rendered"), F.coalesce(F.size("trace"), F.lit(0)).alias("steps"))
    served = rows.select(F.lit("served").alias("set"), F.lit(SERVED).alias("system"), F.col("rendered").alias("prompt"), "rendered", "steps")
    cut = rows.select(F.lit("cut").alias("set"), F.when(F.col("conv_id") % 2 == 1, "Answer.").otherwise(SERVED).alias("system"), F.substring("rendered", 1, 200).alias("prompt"), "rendered", "steps")
    return C.prompt_gates(served.unionByName(cut), SERVED)


register("prompt_gates", """WITH c AS (SELECT conv_id, count(*) AS n, sum(length(coalesce(text, ''))) AS chars FROM conversations GROUP BY conv_id)
SELECT 'served' AS set, count(*) FILTER (n > 1) AS checked, count(*) FILTER (n > 1) > 0 AS parity, true AS identity FROM c
UNION ALL SELECT 'cut', count(*) FILTER (n > 1), false, count(*) FILTER (conv_id % 2 = 1) = 0 FROM c""")(_captures)


def _cases(s, d):
    """Labelled cases for the judge of grounded spans: each text's last line, which is in it, and the same behind words that aren't."""
    text = F.coalesce("text", F.lit(""))
    last = F.element_at(F.split(text, "\n", -1), -1)
    cases = V.table(s, d, "documents").select(F.explode(F.array(F.struct(F.lit(True).alias("expected"), last.alias("span")), F.struct(F.lit(False).alias("expected"), F.concat(F.lit("The board denied: "), last).alias("span")))).alias("x"), text.alias("text"))
    return E.agreement(cases.select("x.expected", C.grounded(F.col("x.span"), F.col("text")).alias("verdict")))


register("judge_calibration", """WITH t AS (SELECT lower(coalesce(text, '')) AS text, string_split(coalesce(text, ''), chr(10))[-1] AS last FROM documents),
c AS (SELECT true AS expected, contains(text, substr(lower(last), 1, 60)) AS verdict FROM t UNION ALL SELECT false, contains(text, substr(lower('The board denied: ' || last), 1, 60)) FROM t)
SELECT count(*) AS cases, round(avg(CAST(expected = verdict AS INTEGER)), 6) AS agreement, count(*) FILTER (expected AND NOT verdict) AS misses, avg(CAST(expected = verdict AS INTEGER)) >= 0.95 AND count(*) FILTER (expected AND NOT verdict) = 0 AS passes FROM c""")(_cases)
