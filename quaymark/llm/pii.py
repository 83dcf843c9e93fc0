"""Information-theoretic sanitisation of personal data, in DataFrame operations only.

Protected entities are the values that fixed patterns find (email, ip, card, phone). The corpus says how strongly other
terms reveal them: of a term t and an entity e, both counted over all texts, PMI(t; e) = log(p(e|t) / p(e)), where p(e|t)
is the share of t's occurrences that stand within a few words of e; the entity's own information is -log p(e). A term
whose PMI reaches GENERALISE of that information discloses the entity and is generalised where it stands beside it; from
REMOVE on it is removed. A term must have been seen beside the entity in MIN_CONTEXTS different contexts: the words of
one context, however often it is copied, are no evidence.

Spans are code-point offsets. Base spans are leftmost and don't overlap within a kind; disclosing terms are kind `term`
and don't overlap base spans.

Cases: null texts count as empty and have no spans; they stay null in sanitised output. Texts of any length are read
whole. Repeated rows each give a row. An empty table gives an empty result. Other columns, whatever their names, are
passed on by sanitise().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.llm.common import fresh, joined, read, written

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns. Runs are taken possessively and begin where no run is under way, so that long runs take linear time; the matches are the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = "term"
_TERM = r"[\p{L}\p{N}]+"
#: A context: at most so many characters on each side of an entity, and so many terms of them.
WINDOW_CHARS, WINDOW_TERMS = 100, 6
MIN_CONTEXTS = 3
GENERALISE, REMOVE = 0.9, 0.95
#: Candidate terms up to which they are sent to every executor (8 bytes each); beyond it, they are joined by a shuffle.
MAX_SHIPPED_TERMS = 200_000


def _valid(kind: Column, value: Column) -> Column:
    part = F.split(value, r"\.", -1)
    small = F.forall(part, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.length(digits)
    places = F.split(F.reverse(digits), "")
    doubled = lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2)
    luhn = F.aggregate(F.transform(F.filter(places, lambda c: c != ""), lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda a, x: a + x) % 10 == 0
    return F.when(kind == 0, True).when(kind == 1, small).when(kind == 2, size.between(16, 19) & luhn).otherwise(size.between(8, 15))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table of the shared folder with a row for each of docs: (row, id, th, found), found holding the raw pattern matches with the text around them."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    none = F.array().cast("array<string>")
    has = {k: F.lit(True) if NEEDS[k] is None else F.contains(text, F.lit(NEEDS[k])) for k in KINDS}
    df = df.select("*", *[F.when(has[k], F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"f_{k}") for k in KINDS])
    df = df.select("id", "th", *[f"f_{k}" for k in KINDS], *[F.when(F.size(f"f_{k}") > 0, F.split(text, PATTERNS[k], -1)).otherwise(none).alias(f"g_{k}") for k in KINDS])
    for k in KINDS:
        df = df.withColumn(f"n_{k}", F.slice(f"g_{k}", 2, F.greatest(F.size(f"f_{k}"), F.lit(1))))

    def placed(n: int, k: str) -> Column:
        zipped = F.slice(F.arrays_zip(f"f_{k}", f"g_{k}", f"n_{k}"), F.lit(1), F.size(f"f_{k}"))
        tell = lambda x, i: F.struct(
            F.lit(n).alias("kind"), i.alias("pos"), x[f"f_{k}"].alias("value"), F.length(x[f"g_{k}"]).alias("gap"),
            F.right(x[f"g_{k}"], F.lit(WINDOW_CHARS)).alias("before"), F.left(x[f"n_{k}"], F.lit(WINDOW_CHARS)).alias("after"), (F.length(x[f"n_{k}"]) > WINDOW_CHARS).alias("cut"),
        )
        return F.transform(zipped, tell)

    found = [placed(n, k) for n, k in enumerate(KINDS)]
    return written(df.select(F.monotonically_increasing_id().alias("row"), "id", "th", F.concat(*found).alias("found")), "pii-matches")


def base_spans(found: DataFrame) -> DataFrame:
    """(row, kind, start, stop, value, gap, before, after, cut) of the matches that are valid."""
    each = found.select("row", F.inline("found"))
    ends = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    placed = each.withColumn("stop", ends.cast("bigint")).withColumn("start", F.col("stop") - F.length("value"))
    return placed.where(_valid(F.col("kind"), F.col("value")))


def _terms(side: str, cut: Column) -> Column:
    """Expression: (term, from, to) of the terms of one side, offsets from the side's begin; terms that its edge may have cut are left out."""
    words, gaps = F.col(f"{side}_words"), F.col(f"{side}_gaps")
    length = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    placed = F.transform(words, lambda w, i: F.struct(F.lower(w).alias("term"), (length(F.slice(gaps, 1, i + 1)) + length(F.slice(words, 1, i))).alias("from"), F.length(w).alias("n")))
    n = F.size(words)
    if side == "before":
        first = F.when(cut & (n > 0), 1).otherwise(0)
        return F.slice(placed, F.greatest(first, n - WINDOW_TERMS) + 1, F.lit(WINDOW_TERMS))
    whole = F.when(cut & (n > 0), n - 1).otherwise(n)
    return F.slice(placed, F.lit(1), F.least(whole, F.lit(WINDOW_TERMS)))


def contexts(base: DataFrame) -> DataFrame:
    """(row, entity, context, term, start, stop): the terms around each base span that overlap none."""
    split = base.select("row", "start", "stop", F.concat_ws(":", "kind", F.lower("value")).alias("entity"), F.xxhash64("before", "after").alias("context"), "gap", "cut", F.length("before").alias("width"), *[f(F.col(s)).alias(f"{s}_{n}") for s in ("before", "after") for n, f in (("words", lambda c: F.regexp_extract_all(c, F.lit(_TERM), F.lit(0))), ("gaps", lambda c: F.split(c, _TERM, -1)))])
    left = F.transform(_terms("before", F.col("gap") > WINDOW_CHARS), lambda t: F.struct(t["term"].alias("term"), (F.col("start") - F.col("width") + t["from"]).alias("start"), (F.col("start") - F.col("width") + t["from"] + t["n"]).alias("stop")))
    right = F.transform(_terms("after", F.col("cut")), lambda t: F.struct(t["term"].alias("term"), (F.col("stop") + t["from"]).alias("start"), (F.col("stop") + t["from"] + t["n"]).alias("stop")))
    around = split.select("row", "entity", "context", F.concat(left, right).alias("terms"))
    terms = around.select("row", "entity", "context", F.inline("terms"))
    # Sorted by where they begin, a term overlaps a base span if one that begins no later ends behind its begin, or the next one begins before its end.
    none = F.lit(None).cast("bigint")
    both = terms.withColumns({"ends": none, "begins": none}).unionByName(base.select("row", F.lit(None).cast("string").alias("entity"), none.alias("context"), F.lit(None).cast("string").alias("term"), "start", "stop", F.col("stop").alias("ends"), F.col("start").alias("begins")))
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.desc("start")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("reach", F.max("ends").over(up)).withColumn("next", F.min("begins").over(down))
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("stop")))
    return seen.where(F.col("entity").isNotNull() & free).select("row", "entity", "context", "term", "start", "stop")


def disclosures(docs: DataFrame, base: DataFrame, around: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, ratio, beside): the terms that reveal an entity, PMI over the entity's information, and how often they stand beside it."""
    times = around.groupBy("entity", "term", "context").agg(F.count("*").alias("n"))
    beside = written(times.groupBy("entity", "term").agg(F.sum("n").alias("beside"), F.count("*").alias("contexts")).where(F.col("contexts") >= MIN_CONTEXTS), "pii-beside")
    wanted = written(beside.select(F.xxhash64("term").alias("word")).distinct(), "pii-terms")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(_TERM), F.lit(0))).alias("term")).select(F.xxhash64("term").alias("word"))
    few = wanted.count()
    if few <= MAX_SHIPPED_TERMS:
        counted = words.join(F.broadcast(wanted), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n_term"))
    else:
        counted = words.groupBy("word").agg(F.count("*").alias("n_term")).join(wanted, "word", "left_semi")
    total = docs.select(F.sum(F.regexp_count(text_col, F.lit(_TERM))).alias("n")).first().n if few else 0
    entities = base.select(F.concat_ws(":", "kind", F.lower("value")).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    p = F.least(F.lit(0.5), F.col("n_entity") * (2.0 * WINDOW_TERMS) / F.lit(float(max(total or 0, 1))))
    share = F.least(F.lit(1.0), F.col("beside") / F.col("n_term"))
    ratio = (F.log(share) - F.log(p)) / -F.log(p)
    scored = beside.withColumn("word", F.xxhash64("term")).join(counted, "word").join(entities, "entity").select("entity", "term", ratio.alias("ratio"), "beside")
    return scored.where(F.col("ratio") >= GENERALISE)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows of docs as (row, id, th), and their spans as (row, kind, start, stop, ratio); kind counts the kinds, terms last, and ratio is null for base spans."""
    found = matches(docs, id_col, text_col)
    base = written(base_spans(found), "pii-base")
    around = written(contexts(base), "pii-contexts")
    told = written(disclosures(docs, base, around, text_col), "pii-told")
    terms = joined(around, told, ["entity", "term"], "beside").groupBy("row", "start", "stop").agg(F.max("ratio").alias("ratio"))
    every = base.select("row", "kind", "start", "stop", F.lit(None).cast("double").alias("ratio")).union(terms.select("row", F.lit(len(KINDS)), "start", "stop", "ratio"))
    return found.select("row", "id", "th"), every


def _listed(items: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: the id, counts by kind, and spans (an array of kind, start, stop, ratio by kind and start)."""
    rows, every = spans(docs, id_col, text_col)
    listed = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop", "ratio"))).alias("spans"))  # those of one document
    joined = rows.join(listed, "row", "left").withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<kind:int,start:bigint,stop:bigint,ratio:double>>)")))
    of_kind = lambda n: F.filter("spans", lambda s: s["kind"] == n)
    counts = [F.size(of_kind(n)).cast("bigint").alias(f"n_{k}") for n, k in enumerate((*KINDS, TERM))]
    return joined.select(F.col("id").alias(id_col), *counts, "spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with entities replaced by the name of their kind, disclosing terms generalised to what they look like or removed. Overlapping spans are replaced as one, by their first one's kind."""
    rows, every = spans(docs, id_col, text_col)
    by_start = Window.partitionBy("row").orderBy("start", F.desc("stop"), "kind")
    marked = every.withColumn("new", F.coalesce((F.col("start") >= F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    grouped = marked.withColumn("part", F.sum("new").over(by_start)).groupBy("row", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct("start", "kind", "ratio")).alias("head"))
    cuts = grouped.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "head.kind", "head.ratio"))).alias("cuts"))
    th, key_id, key_th, cut = fresh(docs, "quaymark_th", "quaymark_id", "quaymark_key", "quaymark_cuts")
    keyed = rows.join(cuts, "row").select(F.col("id").alias(key_id), F.col("th").alias(key_th), F.col("cuts").alias(cut)).dropDuplicates([key_id, key_th])
    joined = docs.withColumn(th, F.xxhash64(text_col)).join(keyed, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(th) == F.col(key_th)), "left")
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text, all_cuts = F.col(text_col), F.col(cut)
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(all_cuts, lambda c: c["stop"]))
    pieces = F.zip_with(
        begins,
        all_cuts,
        lambda a, c: F.concat(
            F.substr(text, (a + 1).cast("int"), F.when(c.isNull(), F.length(text)).otherwise(c["start"] - a).cast("int")),
            F.when(c.isNull() | (F.coalesce(c["ratio"], F.lit(0.0)) >= REMOVE), "")
            .when(c["kind"] < len(KINDS), F.get(labels, c["kind"]))
            .when(F.substr(text, (c["start"] + 1).cast("int"), (c["stop"] - c["start"]).cast("int")).rlike(r"\p{N}"), "[CODE]")
            .when(F.substr(text, (c["start"] + 1).cast("int"), F.lit(1)).rlike(r"\p{Lu}"), "[NAME]")
            .otherwise("[WORD]"),
        ),
    )
    clean = F.when(all_cuts.isNull(), text).otherwise(F.array_join(pieces, ""))
    return joined.select(*[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns])
