"""Benchmark decontamination by a distributed positional inverted index.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A benchmark item's windows are its runs of 13
words, or all of its words if it has fewer. Corpus frequencies of the items' words pick the two rarest of each window;
posting lists (document, position, and the words around it) are stored for these anchors, the only lists that a window
needs. A window's two lists are intersected with their offsets adjusted, starting from the rarer, and the words around
the meeting point say how far the exact phrase runs. Nearby meetings that miss the offset are proximity matches.

Sets of terms reach the executors as a bitmap of fixed size; words that it lets through by chance are dropped by the
joins. The lists of a frequent term are dealt to several tasks by document.

Cases: null and wordless texts have no words and no hits; null and wordless items have no windows; an item id that
several items share counts once, a null item id counts as `null`. Equally rare words rank by their place in the window.
Repeated rows each give a row. A table without rows, or a benchmark without rows, gives rows without hits. Only the named
columns are read; an output column that would have the id's name gets an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.llm.common import HOT_PARTS, fresh, outputs, read, sliced, word_hashes, written

WINDOW = 13
REACH = WINDOW - 1
#: Bits of the bitmap that stands for a set of terms: 8 MB, whatever the set.
BITS = 1 << 26
#: Terms that a task counts before it passes its counts on.
COUNTED = 500_000


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words, key): the hashed words of every item that has any; each different item has a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words = [word_hashes(t).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64()))], names=["item", "words"])

    named = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "item string, words array<bigint>").where("size(words) > 0").distinct().withColumn("key", F.monotonically_increasing_id())


def _shipped(spark: SparkSession, terms: DataFrame):
    """A bitmap of the terms on every executor."""
    spot = F.pmod("term", F.lit(BITS))
    each = terms.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / 64).cast("int").alias("word"))
    words = each.agg(F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 as int))")).alias("bits")).toArrow()  # BITS / 64 rows at most
    bitmap = np.zeros(BITS // 64, dtype=np.int64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bitmap.view(np.uint64))


def _among(words: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """The places of the words that the bitmap holds."""
    spot = words.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return np.flatnonzero(bitmap[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1))


def term_counts(docs: DataFrame, terms: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n): how often words occur in all the texts, the terms among them. Every task adds up its own before anything is shuffled."""
    shipped = _shipped(docs.sparkSession, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shipped.value
        held, sums = np.empty(0, np.int64), np.empty(0, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], names=["term", "n"])

        for batch in sliced(batches):
            found = [np.empty(0, np.int64)]
            for text in batch.column(0):
                words = word_hashes(text.as_py()).view(np.int64)
                found.append(words[_among(words, bitmap)])
            some, n = np.unique(np.concatenate(found), return_counts=True)
            held, at = np.unique(np.concatenate([held, some]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, n]), minlength=len(held)).astype(np.int64)
            if len(held) > COUNTED:
                yield told()
                held, sums = held[:0], sums[:0]
        yield told()

    return docs.select(text_col).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def anchors(bench: DataFrame, counts: DataFrame) -> DataFrame:
    """(item, term, other, step, around, need, n): of each window the rarest word and the next, the steps between them, the item's words around the first, the words that a hit needs, and the first's frequency. Each word of an item takes part in the lists of its own place only."""
    words = bench.select("item", "key", F.size("words").alias("size"), F.posexplode("words").alias("spot", "term"))
    placed = words.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by = Window.partitionBy("key").orderBy("spot")
    ahead, before, after = by.rowsBetween(0, REACH), by.rowsBetween(-REACH, -1), by.rowsBetween(0, REACH)
    ranked = F.array_sort(F.collect_list(F.struct("n", "spot", "term")).over(ahead))  # 13 at most
    left, right = F.collect_list("term").over(before), F.collect_list("term").over(after)
    # Words outside the item are 1, which no document's word is taken for.
    none = lambda n: F.array_repeat(F.lit(1).cast("bigint"), n)
    around = F.concat(none(F.lit(REACH) - F.size(left)), left, right, none(F.lit(REACH + 1) - F.size(right)))
    placed = placed.select("item", "key", "size", "spot", ranked.alias("by"), around.alias("around"))
    rare, next_ = F.element_at("by", 1), F.when(F.size("by") > 1, F.element_at("by", 2)).otherwise(F.element_at("by", 1))
    windows = placed.where(F.col("spot") <= F.greatest(F.col("size") - WINDOW, F.lit(0)))
    windows = windows.select("key", "item", F.least("size", F.lit(WINDOW)).alias("need"), rare.alias("rare"), next_.alias("next")).where("rare.n > 0")
    windows = windows.select("key", "item", "need", F.col("rare.spot").alias("spot"), F.col("rare.term").alias("term"), F.col("rare.n").alias("n"), F.col("next.term").alias("other"), (F.col("next.spot") - F.col("rare.spot")).alias("step")).distinct()
    return windows.join(placed.select("key", "spot", "around"), ["key", "spot"]).select("item", "term", "other", "step", "around", "need", "n").distinct()


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, as a table of the shared folder: for each row of docs (row, id, n_words, lists), lists holding (term, at, around) for every occurrence of one of the terms."""
    shipped = _shipped(docs.sparkSession, terms)
    width = 2 * REACH + 1
    span = np.arange(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, ats, found, around = [], [], [], []
            for text in batch.column(1):
                words = word_hashes(text.as_py()).view(np.int64)
                sizes.append(len(words))
                at = _among(words, shipped.value)
                ats.append(at)
                found.append(words[at])
                wide = np.concatenate([np.zeros(REACH, np.int64), words, np.zeros(REACH, np.int64)])
                around.append(wide[at[:, None] + span].ravel())
            ends = np.concatenate([[0], np.cumsum([len(a) for a in ats])]).astype(np.int32)
            words_around = pa.ListArray.from_arrays(pa.array(np.arange(ends[-1] + 1, dtype=np.int32) * width), pa.array(np.concatenate(around)))
            each = pa.StructArray.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(ats).astype(np.int32)), words_around], names=["term", "at", "around"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), each)], names=["id", "n_words", "lists"])

    kind = docs.schema[id_col].dataType.simpleString()
    table = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_words bigint, lists array<struct<term:bigint,at:int,around:array<bigint>>>")
    return written(table.withColumn("row", F.monotonically_increasing_id()), "postings")


def _lists(index: DataFrame) -> DataFrame:
    return index.select("row", F.inline("lists"))


def _dealt(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The lists with their anchors. A term that has more than one of HOT_PARTS parts of all postings is dealt to several tasks by document, its anchors to each of them; there are fewer such terms than parts."""
    terms = found.groupBy("term").agg(F.first("n").alias("n"))
    total = terms.agg(F.sum("n")).first()[0] or 0
    hot = terms.where(F.col("n") * HOT_PARTS > F.lit(total)).select("term", F.ceil(F.col("n") * HOT_PARTS / F.lit(max(total, 1))).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    rows = lists.join(F.broadcast(hot), "term", "left").withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")).drop("parts")
    side = found.join(F.broadcast(hot), "term", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts", "n")
    return rows.join(side, ["term", "part"]).drop("part")


def phrases(index: DataFrame, found: DataFrame) -> DataFrame:
    """(row, item, first, last): exact runs of an item's words, as word positions of the document."""
    rare = _dealt(_lists(index).withColumnRenamed("around", "here"), found)
    rare = rare.withColumn("meets", F.col("at") + F.col("step"))
    others = _lists(index).select("row", F.col("term").alias("other"), F.col("at").alias("meets"))
    both = rare.join(others, ["row", "other", "meets"], "left_semi")
    same = F.zip_with("here", "around", lambda a, b: a == b)
    run = lambda part: F.when(F.array_position(part, False) == 0, F.lit(REACH)).otherwise(F.array_position(part, False) - 1).cast("int")
    both = both.select("row", "item", "at", "need", run(F.reverse(F.slice(same, 1, REACH))).alias("before"), run(F.slice(same, REACH + 2, REACH)).alias("after"))
    return both.where("before + after + 1 >= need").select("row", "item", (F.col("at") - F.col("before")).alias("first"), (F.col("at") + F.col("after")).alias("last")).distinct()


def proximity(index: DataFrame, found: DataFrame, slack: int = 5) -> DataFrame:
    """(row, item, at, meets): places where an item's two rarest words of a window stand close, up to slack words off their offset in the item. Places meet by stretches of slack words, so a frequent pair costs what it matches."""
    rare = _dealt(_lists(index).select("row", "term", "at"), found.where("step <> 0").select("item", "term", "other", "step", "n").distinct())
    stretch = lambda at: F.floor(at / F.lit(slack))
    due = F.col("at") + F.col("step")
    rare = rare.withColumn("stretch", F.explode(F.sequence(stretch(due - slack), stretch(due + slack))))
    others = _lists(index).select("row", F.col("term").alias("other"), F.col("at").alias("meets"), stretch(F.col("at")).alias("stretch"))
    off = F.abs(F.col("meets") - due)
    return rare.join(others, ["row", "other", "stretch"]).where(off.between(1, slack)).select("row", "item", "at", "meets").distinct()


def build(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index of docs for a benchmark, and its anchors."""
    bench = written(items(benchmark), "items")
    vocabulary = bench.select(F.explode("words").alias("term")).distinct()
    found = written(anchors(bench, term_counts(docs, vocabulary, text_col)), "anchors")
    terms = found.select("term").union(found.select("other")).distinct()
    return postings(docs, terms, id_col, text_col), found


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_words, n_hit, items (sorted ids as strings), contaminated."""
    index, found = build(docs, benchmark, id_col, text_col)
    hits = written(phrases(index, found), "phrases")
    before = Window.partitionBy("row").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("row", "first", "last").distinct().withColumn("done", F.coalesce(F.max("last").over(before), F.lit(-1)))
    lengths = spans.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.col("done") + 1) + 1)).alias("n_hit"))
    names = hits.select("row", "item").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = index.select("row", "id", "n_words").join(lengths.join(names, "row"), "row", "left")
    rows = rows.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    rows = rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return rows.toDF(id_col, *outputs(id_col, "n_words", "n_hit", "items", "contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated. Rows are matched by id, nulls too; an id goes only as often as a row of it with those words is contaminated."""
    key, hit = fresh(docs, "quaymark_key", "quaymark_hit")
    tagged = docs.withColumn(key, F.xxhash64(F.lit(0), text_col))
    (text_key,) = fresh(tagged, "quaymark_text")
    keyed = tagged.select(F.struct(id_col, key).alias(text_key), text_col)
    bad = report(keyed, benchmark, text_key, text_col).where("contaminated").select(F.col(text_key)[id_col].alias(hit), F.col(text_key)[key].alias(text_key)).distinct()
    return tagged.join(bad, F.col(id_col).eqNullSafe(F.col(hit)) & (F.col(key) == F.col(text_key)), "left_anti").select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(13, len(w)) AS k, array_to_string(w[f + 1 : f + least(13, len(w))], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS f FROM i WHERE len(w) > 0)),
dwin AS (
  SELECT r, k, f, array_to_string(w[f + 1 : f + k], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(0, len(w) - k + 1)) AS f FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, item, f, dwin.k AS k FROM dwin JOIN win ON dwin.s = win.s AND dwin.k = win.k),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(f, f + k)) AS p FROM hit) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN g USING (r)
"""
