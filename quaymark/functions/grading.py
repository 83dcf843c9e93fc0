"""Deterministic signals of an answer, as column expressions: numbers and dates within declared tolerances, numbers that no
evidence holds, hedges, leaked reasoning, format faults, and a cheap screening of expected components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerance classes and how a note declares them.
TOLERANCES = {"pct_like": (0.02, r"\+/-\s*0\.02"), "correlation": (0.001, r"correlations?\s+allow\s*\+/-\s*0\.001"), "close": (0.0001, r"closes?\s+allow\s*\+/-\s*0\.0001"), "volume": (1.0, r"volume\s+allows?\s*\+/-\s*1\s+share")}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
# Fixed patterns: dates, and numbers with or without groups of thousands.
DAY_FIRST = r"\b(\d{1,2})\s+([A-Za-z]{3,9})\.?\s+(\d{4})\b"
MONTH_FIRST = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})\b"
ISO = r"\b(\d{4})-(\d{2})(?:-(\d{2}))?\b"
MONTH_YEAR = r"\b([A-Za-z]{3,9})\.?\s+(\d{4})\b"
NUMBER = r"[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?|[+-]?\d+(?:\.\d+)?"
LOOSE_NUMBER = r"[-+]?\d[\d,]*(?:\.\d+)?"
CONTEXT = 45
# Fixed word list: hedges.
HEDGES = ("approximately", "roughly", "about", "around", "circa", "some", "nearly", "almost", "just over", "just under", "in the region of", "or so", "give or take", "ballpark", "estimated", "an estimated", "close to", "upwards of", "north of", "south of")
# Fixed patterns: reasoning that leaked into an answer, and faults of its format.
LEAKS = r"(?im)<think>|</think>|thinking process|let me (?:think|check|work|see)|^\s*(?:step \d|first,? i|okay,? so|hmm)|i need to (?:find|check|look)|the user (?:is asking|wants)|based on the tool results?,? i"
FAULTS = r"(?im)DOMAIN_PREDICT_MODE|mock-fallback|tool_trace|query_data\(|dataset_coverage\(|\[\d+\]\s+(?:query_data|retrieve|dataset_coverage)|```|^\s*\{\s*[\"']|Verified tool results"
# Fixed word list: words that say nothing of a fact.
STOP_WORDS = ("the", "and", "with", "that", "from", "were", "this")


def profile(note: Column) -> Column:
    """The tolerances that a note declares: a struct of pct_like, correlation, close and volume, 0 where it declares none."""
    text = F.lower(F.coalesce(note, F.lit("")))
    return F.struct(*[F.when(text.rlike(pattern), width).otherwise(0.0).alias(name) for name, (width, pattern) in TOLERANCES.items()])


def _all(text: Column, pattern: str, build) -> Column:
    """What build makes of the groups of every match, without nulls."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = lambda m, k: F.regexp_extract(m, pattern, k)
    return F.array_compact(F.transform(found, lambda m: build(lambda k: group(m, k))))


def _month(name: Column) -> Column:
    place = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(place > 0, F.lpad(place.cast("string"), 2, "0"))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat(year, F.lit("-"), _month(month), F.lit("-"), F.lpad(day, 2, "0"))


def dates(text: Column) -> Column:
    """Days as yyyy-mm-dd and months as yyyy-mm that a text names, sorted; a month that only dates a day isn't told by itself."""
    days = F.concat(_all(text, DAY_FIRST, lambda g: _day(g(3), g(2), g(1))), _all(text, MONTH_FIRST, lambda g: _day(g(3), g(1), g(2))))
    iso = _all(text, ISO, lambda g: F.concat_ws("-", g(1), g(2), F.nullif(g(3), F.lit(""))))
    full = F.concat(days, iso)
    months = F.filter(_all(text, MONTH_YEAR, lambda g: F.concat(g(2), F.lit("-"), _month(g(1)))), lambda m: ~F.exists(full, lambda d: F.startswith(d, F.concat(m, F.lit("-")))))
    return F.array_sort(F.array_distinct(F.concat(full, months)))


def without_dates(text: Column) -> Column:
    for pattern in (DAY_FIRST, MONTH_FIRST, ISO, MONTH_YEAR):
        text = F.regexp_replace(text, pattern, " ")
    return text


def numbers(text: Column) -> Column:
    """(value, context) of the numbers outside dates, the context reaching CONTEXT characters to each side."""
    bare = without_dates(text)
    found, gaps = F.regexp_extract_all(bare, F.lit(NUMBER), F.lit(0)), F.split(bare, NUMBER, -1)
    upto = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))

    def one(raw: Column, k: Column) -> Column:
        start = upto(gaps, k + 1) + upto(found, k)
        low = F.greatest(start - CONTEXT, F.lit(0))
        context = F.substr(bare, low + 1, start + F.length(raw) + CONTEXT - low)
        return F.struct(F.regexp_replace(raw, "[,+]", "").cast("double").alias("value"), context.alias("context"))

    return F.transform(found, one)


def tolerance(context: Column, declared: Column) -> Column:
    """The tolerance of a number by the words around it. Counts, years, rates and percentage points stay exact."""
    low = F.lower(context)
    percent = F.contains(context, F.lit("%")) | F.contains(low, F.lit("per cent"))
    rate = F.contains(low, F.lit("percentage point")) | low.rlike(r"\b(cash[- ]rate|target|rate)\b")
    return (
        F.when(F.contains(low, F.lit("correlation")), declared["correlation"])
        .when(low.rlike(r"\bclos(e|ing)\b"), declared["close"])
        .when(low.rlike(r"\b(share|volume)s?\b") & ~F.contains(low, F.lit("percentage")), declared["volume"])
        .when(percent & ~rate, declared["pct_like"])
        .otherwise(0.0)
    )


def numeric_check(expected: Column, answer: Column, note: Column) -> Column:
    """PASS if the answer names every date and number that is expected, numbers within what the note allows them; a month is also named by any of its days. N/A if none is expected."""
    want, have, declared = numbers(expected), numbers(answer), profile(note)
    days, told = dates(expected), dates(answer)
    named = F.forall(days, lambda d: F.exists(told, lambda t: (t == d) | ((F.length(d) == 7) & F.startswith(t, F.concat(d, F.lit("-"))))))
    near = F.forall(want, lambda w: F.exists(have, lambda h: F.abs(w["value"] - h["value"]) <= tolerance(w["context"], declared)))
    return F.when((F.size(want) == 0) & (F.size(days) == 0), "N/A").when(named & near, "PASS").otherwise("FAIL")


def normal(token: Column) -> Column:
    """A number without separators, sign and trailing zeros."""
    bare = F.regexp_replace(F.regexp_replace(token, ",", ""), r"^[+-]+", "")
    short = F.when(F.contains(bare, F.lit(".")), F.regexp_replace(F.regexp_replace(bare, "0+$", ""), r"\.$", "")).otherwise(bare)
    return F.when(short == "", "0").otherwise(short)


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LOOSE_NUMBER), F.lit(0))


def evidence_numbers(texts: Column) -> Column:
    """The normal forms of all numbers of a list of texts, and those at 0 to 4 places, which an answer may print."""
    tokens = F.array_distinct(F.transform(F.flatten(F.transform(texts, number_tokens)), normal))
    rounded = F.transform(tokens, lambda t: F.array(*[normal(F.format_string(f"%.{k}f", t.cast("double"))) for k in range(5)]))
    return F.array_distinct(F.concat(tokens, F.flatten(rounded)))


def ungrounded(answer: Column, texts: Column) -> Column:
    """The numbers of an answer, as written, that none of the texts (evidence and question) holds; the marks of a list up to five are no claims."""
    known = evidence_numbers(texts)
    mark = lambda raw: normal(raw).isin("1", "2", "3", "4", "5") & F.regexp_like(answer, F.concat(F.lit(r"(?m)(?:^|[;\s])"), F.regexp_replace(raw, r"([+.])", r"\\$1"), F.lit(r"[).:]\s")))
    return F.filter(number_tokens(answer), lambda raw: ~F.array_contains(known, normal(raw)) & ~mark(raw))


def hedged(answer: Column) -> Column:
    """A hedge with a number within 40 characters behind it."""
    return answer.rlike(rf"(?is)(?:{'|'.join(HEDGES)})(?=.{{0,39}}\d)")


#: Words that make an answer a hedged one wherever they stand.
HEDGE_WORDS = ("approximately", "roughly", "about", "around", "circa", "approx", "nearly", "an estimated", "in the region of", "or so", "~")


def hedge_words(answer: Column) -> Column:
    """Whether an answer holds a hedge, with a number near or without."""
    low = F.lower(answer)
    return F.exists(F.array(*map(F.lit, HEDGE_WORDS)), lambda w: F.contains(low, w))


def trace_numbers(trace: Column) -> Column:
    """The normal forms of all numbers of a trace (compact, result and args, the latter two as JSON text): what was asked may be quoted as what was found may."""
    parts = F.flatten(F.transform(trace, lambda t: F.array(t["compact"], t["result"], t["args"])))
    return F.array_distinct(F.transform(F.flatten(F.transform(parts, number_tokens)), normal))


def leaked(answer: Column) -> Column:
    return answer.rlike(LEAKS)


def misformatted(answer: Column) -> Column:
    return answer.rlike(FAULTS)


def screened(fact: Column, answer: Column) -> Column:
    """A cheap proxy of a judge: (missing numbers, share of the fact's words that the answer has, whether it likely passes)."""
    tokens = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(r"-?\d+(?:[.,]\d+)*"), F.lit(0)), lambda n: F.regexp_replace(n, ",", "")))
    missing = F.array_sort(F.array_except(tokens(fact), tokens(answer)))
    words = F.filter(F.regexp_extract_all(F.lower(fact), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))
    hits = F.element_at(F.transform(F.array(F.lower(answer)), lambda low: F.size(F.filter(words, lambda w: F.contains(low, w)))), 1)  # lower-cased once, not once a word
    n = F.size(words)
    passes = (F.size(missing) == 0) & ((n == 0) | (hits >= F.greatest(F.lit(1), F.floor(n / 3))))
    return F.struct(missing.alias("missing"), F.when(n > 0, F.round(hits / n, 2)).alias("coverage"), passes.alias("likely"))
