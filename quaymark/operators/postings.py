"""A stored index of articles: which words are in which articles, kept as files and asked by pattern.

The folder holds
    postings/bucket=b   (word, segment, n, places) sorted by word: the articles of a segment that hold the word; a segment is a
                        range of SEGMENT ids, so no list is longer than that, and a place is an id less the range's first
    words               (word, n): the vocabulary
    articles/segment=s  (article_id, publication, blob)
    about               what it was made of; written last, so a folder without it isn't an index

A pattern is read for what a match must hold: alternatives of pieces of words. A piece that is a whole word names one
bucket, others are looked up in the vocabulary. Lists are met segment by segment; where the rarest words are few,
segments without them aren't read further. What is left is read from the segments' articles and matched, unless the pattern
asks for pieces of words only: then the lists are the answer. A pattern of which nothing is known, or whose rarest words are in
more than a SELECTIVE part of all articles, is matched against all articles: that reads them once, in order.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.operators import text as T
from quaymark.operators.patterns import Piece, Reading, read

WORD = r"[\p{L}\p{N}_]+"
SEGMENT, BUCKETS = 4096, 64
#: Segments whose lists a file of postings holds.
FILE_SEGMENTS = 256
SELECTIVE = 0.1
#: Bytes of a row group of postings, so that few are read for a word.
ROW_GROUP = 1 << 20
#: So many words of the vocabulary are named in the scan of postings, more are joined with it.
NAMED_WORDS = 1000
#: Of the files' layout; an index of another one is made anew.
LAYOUT = "1"
#: With so many articles of the rarest words at most, their segments (as many at most) are broadcast to the other lists.
FEW = 100_000

_POSTINGS = "word string, segment bigint, n int, places array<smallint>, bucket int"
_WORDS = "word string, n bigint"
_ARTICLES = "article_id bigint, publication date, blob string, segment bigint"


def _segment(ids: Column) -> Column:
    return F.floor(ids / SEGMENT).cast("bigint")


def _bucket(word: Column) -> Column:
    return (F.crc32(word.cast("binary")) % BUCKETS).cast("int")


def build(articles: DataFrame, folder: str, source: str = "") -> Index:
    """Make the index of articles (article_id, blob, publication) in a folder that all executors reach. Null ids are left out of it."""
    spark = articles.sparkSession
    known = articles.where("article_id is not null").select("article_id", "publication", "blob", _segment(F.col("article_id")).alias("segment"))
    known.repartition("segment").sortWithinPartitions("segment", "article_id").write.mode("overwrite").partitionBy("segment").parquet(f"{folder}/articles")
    stored = spark.read.schema(_ARTICLES).parquet(f"{folder}/articles")
    about = stored.agg(F.count("*").alias("articles"), F.count_distinct("segment").alias("segments")).first()
    place = (F.col("article_id") - F.col("segment") * SEGMENT).cast("smallint")
    words = stored.select(F.explode(F.array_distinct(F.regexp_extract_all("blob", F.lit(WORD), F.lit(0)))).alias("word"), "segment", place.alias("place"))
    lists = words.groupBy("word", "segment").agg(F.array_distinct(F.array_sort(F.collect_list("place"))).alias("places"))  # SEGMENT places at most
    lists = lists.select("word", "segment", F.size("places").alias("n"), "places", _bucket(F.col("word")).alias("bucket"))
    # A file holds a bucket's words of some segments, so its size doesn't grow with the number of articles.
    strip = F.floor(F.col("segment") * max(1, about.segments // FILE_SEGMENTS) / max(1, about.segments))
    dealt = lists.repartition(F.col("bucket"), strip).sortWithinPartitions("bucket", "word", "segment")
    # Sorted numbers and words are stored as differences by the file format itself.
    dealt.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{folder}/postings")
    postings = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings")
    postings.groupBy("word").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/words")
    spark.createDataFrame([(about.articles, source)], "articles bigint, source string").write.mode("overwrite").parquet(f"{folder}/about")
    return Index(spark, folder)


def kept(articles: DataFrame, folder: str, source: str) -> Index:
    """The index of the folder if it was made of the same source in the same layout, a new one else."""
    source = f"{LAYOUT}-{SEGMENT}-{BUCKETS}-{source}"
    spark = articles.sparkSession
    about = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/about/_SUCCESS")
    if about.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(about):
        index = Index(spark, folder)
        if index.source == source:
            return index
    return build(articles, folder, source)


def fingerprint(table: DataFrame) -> str:
    """The names, lengths and times of a table's files, hashed."""
    spark, told = table.sparkSession, []
    for name in sorted(table.inputFiles()):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
        told.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return f"{zlib.crc32(chr(10).join(told).encode()):08x}-{len(told)}"


class Index:
    """A folder that build() made, opened; its files are listed once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.postings = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings")
        self.words = spark.read.schema(_WORDS).parquet(f"{folder}/words")
        self.articles = spark.read.schema(_ARTICLES).parquet(f"{folder}/articles")
        about = spark.read.schema("articles bigint, source string").parquet(f"{folder}/about").first()
        self.total, self.source = about.articles, about.source

    def _named(self, pieces: list[Piece]) -> DataFrame:
        """(word, bucket, piece, n): the words of the vocabulary that have each piece."""
        tests = [F.col("word") == p.text if p.whole else F.startswith("word", F.lit(p.text)) if p.begins else F.endswith("word", F.lit(p.text)) if p.ends else F.contains("word", F.lit(p.text)) for p in pieces]
        fit = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in enumerate(tests)]), lambda x: x.isNotNull())
        return self.words.select("word", _bucket(F.col("word")).alias("bucket"), F.explode(fit).alias("piece"), "n")

    def _lists(self, pieces: list[Piece], words: dict[str, list[int]] | None = None) -> DataFrame:
        """(segment, piece, n, places) of each piece. Whole words, and those of the vocabulary that are named, are looked for in their buckets only."""
        if all(p.whole for p in pieces):
            words = {p.text: [k] for k, p in enumerate(pieces)}
        if words is None:
            return self.postings.join(self._named(pieces).drop("n"), ["bucket", "word"]).select("segment", "piece", "n", "places")
        here = self.postings.where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})) & F.col("word").isin(sorted(words)))
        named = F.create_map(*[x for w, at in words.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])
        return here.select("segment", F.explode(named[F.col("word")]).alias("piece"), "n", "places")

    def _plan(self, reading: Reading) -> tuple[list[frozenset[Piece]], dict[Piece, int] | None] | None:
        """The alternatives that some article may hold, and in how many articles at most each piece is; without counts where they aren't needed. None: all articles had better be read."""
        if reading.alternatives is None:
            return None
        pieces = sorted({p for a in reading.alternatives for p in a}, key=str)
        if reading.exact and all(p.whole for p in pieces):
            return list(reading.alternatives), None
        found = self._named(pieces).groupBy("piece").agg(F.sum("n").alias("n")).collect()  # a row for each piece of the pattern
        counts = dict.fromkeys(pieces, 0) | {pieces[r.piece]: r.n for r in found}
        open_ = [a for a in reading.alternatives if all(counts[p] for p in a)]
        if not reading.exact and sum(min(counts[p] for p in a) for a in open_) > SELECTIVE * self.total:
            return None
        return open_, counts

    def _held(self, alternatives: list[frozenset[Piece]], counts: dict[Piece, int] | None) -> DataFrame:
        """(segment, places): by segment the articles that hold all pieces of any alternative."""
        pieces = sorted({p for a in alternatives for p in a}, key=str)
        number = {p: k for k, p in enumerate(pieces)}
        words: dict[str, list[int]] | None = None
        if counts:
            found = self._named(pieces).select("word", "piece").limit(NAMED_WORDS + 1).collect()
            if len(found) <= NAMED_WORDS:
                words = {}
                for r in found:
                    words.setdefault(r.word, []).append(r.piece)
        lists = self._lists(pieces, words)
        if counts:
            rarest = {min(a, key=lambda p: counts[p]) for a in alternatives}
            if len(rarest) < len(pieces) and sum(counts[p] for p in rarest) <= FEW:
                few = lists.where(F.col("piece").isin([number[p] for p in rarest])).select("segment").distinct()
                lists = lists.join(F.broadcast(few), "segment", "left_semi")
        merged = lambda k: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("piece") == k, F.col("places"))))).alias(f"p{k}")
        rows = lists.groupBy("segment").agg(*[merged(k) for k in range(len(pieces))])
        every = [reduce(F.array_intersect, [F.col(f"p{number[p]}") for p in sorted(a, key=str)]) for a in alternatives]
        return rows.select("segment", reduce(F.array_union, every).alias("places")).where(F.size("places") > 0)

    def match(self, pattern: str) -> DataFrame:
        """(article_id, publication) of the articles that match an engine's pattern."""
        reading = read(pattern)
        plan = self._plan(reading)
        if plan is None:
            return self.articles.where(T.matches(pattern)).select("article_id", "publication")
        if not plan[0]:
            return self.articles.limit(0).select("article_id", "publication")
        found = self._held(*plan).select("segment", F.explode("places").alias("place")).select("segment", (F.col("place") + F.col("segment") * SEGMENT).alias("article_id"))
        near = self.articles.join(found, ["segment", "article_id"], "left_semi")
        return (near if reading.exact else near.where(T.matches(pattern))).select("article_id", "publication")

    def count(self, pattern: str, **filters) -> DataFrame:
        """As text.count(): matches within the filters, and their share of all articles."""
        reading = read(pattern)
        zero = F.lit(0).cast("bigint")
        if any(v is not None for v in filters.values()) or not reading.exact:
            matches = T.dated(self.match(pattern), **filters).agg(F.count("*").alias("matches"))
        elif all(p.whole for a in reading.alternatives for p in a) and len(reading.alternatives) == 1:
            matches = self._lists(list(reading.alternatives[0])).agg(F.coalesce(F.sum("n"), zero).alias("matches"))
        elif (plan := self._plan(reading))[0]:
            matches = self._held(*plan).agg(F.coalesce(F.sum(F.size("places")), zero).alias("matches"))
        else:
            matches = self.spark.range(1).select(zero.alias("matches"))
        return matches.select("matches", F.lit(self.total).cast("bigint").alias("total"), F.round(100.0 * F.col("matches") / F.nullif(F.lit(self.total), F.lit(0)), 4).alias("share_pct"))
