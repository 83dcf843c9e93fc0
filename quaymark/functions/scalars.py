"""Scalar functions over columns: dates, numbers, texts. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed date formats, most specific first.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy")
NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


def flexible_date(raw: Column) -> Column:
    """A date written in any of the known ways; null if none fits."""
    text = F.trim(F.regexp_replace(raw, ",", ""))
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    return F.coalesce(compact, *[F.when(text.rlike(r"\D"), F.try_to_date(text, f)) for f in DATE_FORMATS])


def bound(raw: Column, upper: bool) -> Column:
    """A day, month or year as the begin (or, upper, the end) of what it names."""
    text = F.trim(raw)
    year = F.when(text.rlike(r"^\d{4}$"), F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd"))
    month = F.when(text.rlike(r"^\d{4}-\d{1,2}$"), F.try_to_date(F.concat(text, F.lit("-1")), "yyyy-M-d"))
    named = F.when(text.rlike(r"^[A-Za-z]{3,9} \d{4}$"), F.try_to_date(F.concat(F.lit("1 "), F.substring(text, 1, 3), F.right(text, F.lit(5))), "d MMM yyyy"))
    if upper:
        year, month, named = F.date_sub(F.add_months(year, 12), 1), F.last_day(month), F.last_day(named)
    return F.coalesce(year, month, named, flexible_date(text))


def reference_day(d: Column) -> Column:
    return F.date_format(d, "d MMM yyyy")


def reference_month(d: Column) -> Column:
    return F.date_format(d, "MMM yyyy")


def signed_percent(x: Column) -> Column:
    return F.format_string("%+.2f%%", x)


def normal_number(token: Column) -> Column:
    """Commas, signs and trailing zeros go."""
    bare = F.regexp_replace(token, r"[,+-]", "")
    return F.when(F.contains(bare, F.lit(".")), F.regexp_replace(F.regexp_replace(bare, "0+$", ""), r"\.$", "")).otherwise(bare)


def numbers(text: Column) -> Column:
    """The normalised numbers of a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), normal_number)


def without_reasoning(text: Column) -> Column:
    """What stands between think tags goes, from the text's begin if the opening one is missing."""
    closed = F.regexp_replace(text, r"(?is)<think>.*?</think>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)^.*?</think>", ""))


def tool_calls(text: Column) -> Column:
    """Names and arguments of calls written as JSON between tool_call tags, the last of which may be open."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*(?:</tool_call>|$)"), F.lit(1))
    return F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))


def cut_at_sentence(text: Column, budget: int, marker: str = " [truncated]") -> Column:
    """At most budget characters, up to the last end of a sentence in their second half: full stops before a space first, then ! and ?, then line ends."""
    head = F.substring(text, 1, budget)
    cut = F
    for stop in (r"\. ", "! ", r"\? ", "\n"):
        upto = F.regexp_extract(head, rf"(?s)^(.*){stop}", 1)  # greedy: the last one
        cut = cut.when(F.length(upto) > budget * 0.5, F.substr(head, F.lit(1), F.length(upto) + 1))
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.regexp_replace(cut.otherwise(head), r"\s+$", ""), F.lit(marker)))


def oxford(items: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(items)
    return F.when(n <= 2, F.array_join(items, " and ")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(", and "), F.element_at(items, -1)))


def ranking(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(") "), x)), "; ")


#: Items of which combinations() makes subsets, at most: 65,536 masks.
MOST_ITEMS = 16


def combinations(items: Column, low: int = 1, high: int = 4) -> Column:
    """Subsets of low to high items by bit mask; more than MOST_ITEMS items are an error."""
    n = F.size(items)
    n = F.when(n > MOST_ITEMS, F.raise_error(F.concat(F.lit("too many items for subsets: "), n.cast("string"))).cast("int")).otherwise(n)
    last = F.pow(F.lit(2), n).cast("int") - 1
    masks = F.filter(F.when(last > 0, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>")), lambda m: F.bit_count(m).between(low, high))
    return F.transform(masks, lambda m: F.filter(items, lambda x, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)) == 1))


def gold_key(category: Column, params: Column, components: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", category, params, F.array_join(F.array_sort(components), "|"))), 1, 16)


def token_estimate(text: Column, messages: int = 1) -> Column:
    """Words and marks, 4 for each message and 8 besides; a stand-in for a tokenizer."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]")) + 4 * messages + 8


def rounding_variants(x: Column) -> Column:
    """A value at 0 to 4 places, as texts."""
    return F.array_distinct(F.array(*[F.format_string(f"%.{n}f", x) for n in range(5)]))


# Sectors and their words, in the order in which they are tried, and words of headlines that move markets.
SECTORS = {
    "travel": "travel|airline|qantas|tourism|flight|holiday",
    "energy": "energy|oil|gas|petrol|crude|coal",
    "banks": "bank|banks|banking|cba|nab|anz|westpac|lender",
    "miners": "mining|miner|iron ore|bhp|rio tinto|resources",
    "property": "property|housing|reit|real estate|mortgage",
    "retail": "retail|consumer|shopper|sales",
    "tech": "tech|technology|telco|telecom|nbn|software",
}
MARKET = "shares?|stocks?|market|asx|rally|slump|surge|plunge|investors?|profit|earnings|outlook|rates?|rba|dividend|guidance|forecast|selloff|rebound"


def _whole(words: str, ascii_words: bool) -> str:
    """A pattern of whole words in any case. Letters and digits of all scripts are parts of words; with ascii_words only ASCII's are, as for DuckDB. What \\b means differs between versions of Java, so edges are spelled out."""
    flags, part = ("i", "[A-Za-z0-9_]") if ascii_words else ("iu", r"[\p{L}\p{N}_]")
    return rf"(?{flags})(?<!{part})({words})(?!{part})"


def sector(headline: Column, ascii_words: bool = False) -> Column:
    """The first sector of which the headline holds a whole word."""
    found = F
    for name, words in SECTORS.items():
        found = found.when(headline.rlike(_whole(words, ascii_words)), name)
    return found.otherwise("broad")


def market_relevant(headline: Column, ascii_words: bool = False) -> Column:
    return headline.rlike(_whole(MARKET, ascii_words))


def coarse(label: Column) -> Column:
    return F.when(label.isin("strong_positive", "positive"), "pos").when(label.isin("strong_negative", "negative"), "neg").otherwise("mix")


def latency_factor(seconds: Column) -> Column:
    """What a response time leaves of the points: all up to a minute or where none was taken, four fifths up to five minutes, then none."""
    return F.when(seconds.isNull() | (seconds <= 60), 1.0).when(seconds <= 300, 0.8).otherwise(0.0)


def rate_percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x)


def signed_points(x: Column) -> Column:
    return F.format_string("%+.2f percentage points", x)


def thousands(x: Column) -> Column:
    return F.format_number(x.cast("bigint"), 0)


def volume_text(x: Column) -> Column:
    return F.format_string("%,.2f", x)


def correlation_text(x: Column) -> Column:
    return F.format_string("%.3f", x)


def close_text(x: Column) -> Column:
    return F.format_string("%.4f", x)


def evidence_text(trace: Column) -> Column:
    """A trace (array of structs tool, args, compact, result, all texts) as numbered blocks: the call, then its compact result, or the result itself where there is none."""
    body = lambda t: F.coalesce(F.nullif(t["compact"], F.lit("")), t["result"], F.lit(""))
    blocks = F.transform(trace, lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(t["tool"], F.lit("None")), F.lit("("), F.coalesce(t["args"], F.lit("{}")), F.lit(")\n"), body(t)))
    return F.when(F.coalesce(F.size(trace), F.lit(0)) <= 0, "No tool results were gathered.").otherwise(F.array_join(blocks, "\n\n"))
