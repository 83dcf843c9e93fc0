"""Line dedup by a suffix array over line ids, in DataFrame operations only.

Every line with a word is one letter; equal lines have equal ids. Suffixes are ordered by prefix doubling: the rank of a
suffix by its first 2h lines follows from the ranks, by h lines, of itself and of the suffix h lines on. Ranks come from
sorting the distinct pairs over range partitions. A suffix whose rank is its own is settled and takes no further part,
and doubling ends once prefixes reach `min_words` lines, for no shorter run needs more lines than words.

Suffixes that have m lines in common are neighbours in that order: an LCP interval, whose longest common prefix is m lines
at least. For any m it is named by the two ranks, by the largest power of two up to m, of the first and the last such part
of these lines. An interval of two places or more, with m lines of `min_words` words, is a repeated passage. Places of
intervals that follow each other line by line, and copy the same earlier text line by line, make up a maximal run.

A run of lines counts as a repeated passage if it has at least `min_words` words and occurs more than once. Of a passage,
the first occurrence by (id, text hash, line) stays; the lines of all later ones are deleted. A line lies in a repeated
run with enough words exactly if the shortest such window that begins, or that ends, somewhere around it is repeated, so
the intervals of these windows give all runs. Lines without a word go with the line before them.

Cases: null texts stay null, empty ones empty. Rows equal in id and text are one document: they don't count as copies of
each other and all get the same text. Repeats within a text are deleted too. Ties don't occur among different lines. Null
ids sort first. An empty table gives an empty result. Other columns, whatever their names, are passed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.llm.common import discard, fresh, joined, read, written

MIN_WORDS = 50


def _line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """A row for each line with a word, and one behind the last: its place, hash, and the shortest windows of min_words words that begin at it (till_seq, till_raw) and end before it (from_seq, from_raw)."""
    texts = docs.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    lines = texts.select("row", "id", "th", F.posexplode(F.concat(F.split("text", "\n", -1), F.array(F.lit(None).cast("string")))).alias("raw", "line"))
    words = F.least(F.coalesce(F.regexp_count("line", F.lit(r"\S+")), F.lit(0)), F.lit(min_words))  # longer lines are windows by themselves
    lines = lines.select("row", "id", "th", "raw", words.alias("words"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.col("line").isNull().alias("end")).where("end or words > 0")
    by_line = Window.partitionBy("row").orderBy("raw")
    lines = lines.withColumns({"seq": F.row_number().over(by_line) - 1, "before": F.coalesce(F.sum("words").over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    by_words = Window.partitionBy("row").orderBy("before")
    ahead, behind = by_words.rangeBetween(min_words, 2 * min_words - 1), by_words.rangeBetween(1 - 2 * min_words, -min_words)
    return lines.select("row", "id", "th", "raw", "seq", "h1", "h2", "end", F.min("seq").over(ahead).alias("till_seq"), F.min("raw").over(ahead).alias("till_raw"), F.max("seq").over(behind).alias("from_seq"), F.max("raw").over(behind).alias("from_raw"))


def _ranked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs, a table, with the rank of (a, b) in the order of all that occur more than once; the others go."""
    repeated = pairs.select(a, b).groupBy(a, b).agg(F.count("*").alias("n")).where("n > 1")
    ranks = written(repeated.repartitionByRange(a, b).sortWithinPartitions(a, b).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    out = written(joined(pairs, ranks, [a, b], "n").select("row", "seq", "rank"), "suffixes")
    discard(ranks)
    return out


def _double(suffixes: DataFrame, h: int) -> DataFrame:
    """(row, seq, rank) by 2h lines of the suffixes that still share their rank, from the ranks by h lines."""
    on = suffixes.select("row", (F.col("seq") - h).alias("seq"), F.col("rank").alias("next"))
    pairs = written(suffixes.join(on, ["row", "seq"]).select("row", "seq", F.col("rank").alias("first"), "next"), "pairs")
    out = _ranked(pairs, "first", "next")
    discard(pairs)
    return out


def _windows(lines: DataFrame) -> DataFrame:
    """(row, id, th, seq, m, start, stop): the shortest windows, by first line and number of lines, and as raw lines."""
    begin = lines.where("till_seq is not null and not end").select("row", "id", "th", "seq", (F.col("till_seq") - F.col("seq")).alias("m"), F.col("raw").alias("start"), F.col("till_raw").alias("stop"))
    finish = lines.where("from_seq is not null").select("row", "id", "th", F.col("from_seq").alias("seq"), (F.col("seq") - F.col("from_seq")).alias("m"), F.col("from_raw").alias("start"), F.col("raw").alias("stop"))
    return begin.union(finish)


def intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, seq, m, start, stop, first): the places of all LCP intervals of the shortest windows that occur more than once, with the interval's first place (id, th, seq); start and stop are raw lines."""
    lines = written(_line_table(docs, id_col, text_col, min_words), "lines")
    windows = _windows(lines)
    most = windows.agg(F.max("m")).first()[0] or 0
    suffixes = _ranked(lines.where("not end"), "h1", "h2")
    levels, h = [], 1
    while h <= most and not suffixes.isEmpty():
        levels.append(suffixes.withColumn("h", F.lit(h)))
        if 2 * h <= most:
            suffixes = _double(suffixes, h)
        h *= 2
    place = F.struct("id", "th", "seq")
    if not levels:
        return lines.select("id", "th", "seq", F.col("seq").alias("m"), F.col("raw").alias("start"), F.col("raw").alias("stop"), place.alias("first")).limit(0)
    ranks = reduce(DataFrame.union, levels)
    here = windows.withColumn("h", F.expr("shiftleft(1, length(bin(m)) - 1)"))
    named = here.join(ranks.withColumnRenamed("rank", "head"), ["row", "seq", "h"]).withColumn("tail_seq", F.col("seq") + F.col("m") - F.col("h"))
    named = named.join(ranks.select("row", F.col("seq").alias("tail_seq"), "h", F.col("rank").alias("tail")), ["row", "tail_seq", "h"])
    named = written(named.select("m", "head", "tail", place.alias("place"), "start", "stop").distinct(), "windows")
    first = named.groupBy("m", "head", "tail").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("n")).where("first != last")
    found = joined(named, written(first.drop("last"), "intervals"), ["m", "head", "tail"], "n")
    return found.select("place.*", "m", "start", "stop", "first")


def _merged(rows: DataFrame, keys: list[str], begin: str, end: str, *more: Column) -> DataFrame:
    """(keys, begin, end, more) of the unions of the overlapping or adjoining ranges [begin, end) of each key."""
    by = Window.partitionBy(*keys).orderBy(begin, end)
    marked = rows.withColumn("fresh", F.coalesce((F.col(begin) > F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1)))
    numbered = marked.withColumn("run", F.sum("fresh").over(by))
    return numbered.groupBy(*keys, "run").agg(F.min(begin).alias(begin), F.max(end).alias(end), *more).drop("run")


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, start, stop, first_id, first_th, first_seq): the maximal runs of raw lines [start, stop) that copy an earlier run line by line, and where that one begins."""
    later = intervals(docs, id_col, text_col, min_words).where(F.struct("id", "th", "seq") != F.col("first"))
    moved = later.select("id", "th", "seq", (F.col("seq") + F.col("m")).alias("upto"), "start", "stop", F.col("first.id").alias("first_id"), F.col("first.th").alias("first_th"), (F.col("seq") - F.col("first.seq")).alias("shift"))
    # All runs of a text lie in one partition, as those of doomed_runs() do, so texts are shuffled once.
    runs = _merged(moved.repartition("id", "th"), ["id", "th", "first_id", "first_th", "shift"], "seq", "upto", F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.select("id", "th", "start", "stop", "first_id", "first_th", (F.col("seq") - F.col("shift")).alias("first_seq"))


def doomed_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, runs): of each text the runs [start, stop) of lines to delete, merged and in order."""
    runs = _merged(repeated_runs(docs, id_col, text_col, min_words).select("id", "th", "start", "stop"), ["id", "th"], "start", "stop")
    # One list for each text, no longer than its lines.
    return runs.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def _without(text: Column, runs: Column) -> Column:
    """The text without the runs of lines: the slices between them, joined again."""
    lines = F.split(text, "\n", -1)
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["stop"]))
    stops = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    between = F.zip_with(starts, stops, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.array_join(F.flatten(F.transform(between, lambda x: F.slice(lines, x["a"] + 1, F.greatest(F.lit(0), x["b"] - x["a"])))), "\n")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs, texts without the later copies of repeated passages, and n_lines, n_removed (underscores are added where docs has such names)."""
    lines_name, removed_name = fresh(docs, "n_lines", "n_removed")
    own = docs.columns
    th, key_id, key_th, runs = fresh(docs.withColumns({lines_name: F.lit(0), removed_name: F.lit(0)}), "quaymark_th", "quaymark_id", "quaymark_key", "quaymark_runs")
    doomed = doomed_runs(docs, id_col, text_col, min_words).select(F.col("id").alias(key_id), F.col("th").alias(key_th), F.col("runs").alias(runs))
    rows = docs.withColumn(th, F.xxhash64(text_col))
    joined = rows.join(doomed, F.col(id_col).eqNullSafe(F.col(key_id)) & (F.col(th) == F.col(key_th)), "left")
    gone = F.col(runs).isNotNull()
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n", -1)))
    removed = F.when(gone, F.aggregate(runs, F.lit(0), lambda n, r: n + r["stop"] - r["start"])).otherwise(0)
    text = F.when(gone, _without(F.col(text_col), F.col(runs))).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in own], n_lines.cast("bigint").alias(lines_name), removed.cast("bigint").alias(removed_name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = """
WITH l AS (
  SELECT doc_id, raw, row_number() OVER (PARTITION BY doc_id ORDER BY raw) AS seq, line, n
  FROM (SELECT doc_id, raw, line, len(regexp_extract_all(line, '\\S+')) AS n
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS raw FROM documents WHERE text IS NOT NULL))
  WHERE n > 0),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM l),
r AS (SELECT doc_id, list(line ORDER BY seq) AS lines, list(raw ORDER BY seq) AS raws, any_value(total) AS total
      FROM (SELECT l.*, len(string_split(d.text, chr(10))) AS total FROM l JOIN documents d USING (doc_id)) GROUP BY doc_id),
w AS (
  SELECT a.doc_id, a.seq AS s, min(b.seq) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.upto - a.upto + a.n >= 50 GROUP BY a.doc_id, a.seq
  UNION
  SELECT b.doc_id, max(a.seq) AS s, b.seq AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.seq >= a.seq AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.seq),
k AS (SELECT w.doc_id, s, e, array_to_string(lines[s : e], chr(10)) AS body, raws[s] AS start, coalesce(raws[e + 1], total + 1) AS stop FROM w JOIN r USING (doc_id)),
x AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS raw FROM x WHERE nth > 1),
kept AS (
  SELECT a.doc_id, count(*) AS n_lines, count(gone.raw) AS n_removed, coalesce(string_agg(a.line, chr(10) ORDER BY a.raw) FILTER (gone.raw IS NULL), '') AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS raw FROM documents WHERE text IS NOT NULL) a
  LEFT JOIN gone ON a.doc_id = gone.doc_id AND a.raw = gone.raw GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(k.text, d.text) AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
