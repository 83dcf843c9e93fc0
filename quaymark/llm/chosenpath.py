"""Near-duplicate join on the Jaccard similarity of word 5-grams, by chosen paths.

Every distinct set of hashed 5-grams is embedded as a row of min-hashes, so that two sets agree in a coordinate with
their similarity's probability. A run splits all sets by the value of a sampled coordinate; a bucket that is still large
is split again by coordinates sampled by its path, and so on; a pair of similarity s stays together in a path with the
product of its chances, and dissimilar sets part. Small buckets are compared by brute force. A bucket that splitting does
not shrink is full of similar sets, and it, as one that is still large at the deepest level, is compared by brute force
too, in pairs of blocks, so that no task holds more than two blocks. Runs repeat until a pair at the threshold is missed
with a chance below 1 - recall.

Brute force has two steps. Min-hashes are compared first: pairs that agree in fewer coordinates than a pair at the
threshold does but for a chance of 1 - recall, or whose sizes rule the threshold out, are no candidates. Only sets that
have a candidate are read again, and compared exactly, on whole sets.

A pair may meet in several buckets; it counts in the first bucket, by path, that holds both. A bucket gives its sets'
numbers of links and the components that they form, never its pairs.

Cases: null texts count as empty. Equal texts are one text, texts with equal sets one set with one representative; texts
of one set are linked with each other. Texts without a word have no links; those of fewer than five words are one gram.
Rows that repeat an id and text each get a row of the result. The class is the least id of the component, null if all its
ids are null. An empty table gives an empty result. Only the named columns are read; an output column that would have the
id's name gets an underscore.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import discard, fresh, joined, mixed, outputs, read, shingle_hashes, sliced, word_hashes, written
from quaymark.llm.components import components

THRESHOLD = 0.8
WORDS = 5
#: Min-hashes of a set, at least; as many as there are runs where those are more.
COORDINATES = 32
#: Sets up to which a bucket is compared as it is, and of a block of a larger one; a block's grams are fewer than BLOCK_GRAMS on average.
SMALL, BLOCK, BLOCK_GRAMS = 64, 512, 2_000_000
DEPTH = 4
#: A bucket whose largest part keeps this share of it is no longer split.
STUCK = 0.7


def runs_for(threshold: float, recall: float, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold, even if its buckets are split to the depth, is missed with a chance of at most 1 - recall."""
    found = 1.0
    for _ in range(depth - 1):
        found = 1 - (1 - threshold * found) ** 2  # two sampled coordinates at each deeper node
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold * found)))


def agreeing(threshold: float, recall: float, width: int) -> int:
    """The most coordinates of width that a pair at the threshold agrees in with a chance of at least recall."""
    below = 0.0
    for k in range(width + 1):
        below += math.comb(width, k) * threshold**k * (1 - threshold) ** (width - k)
        if below > 1 - recall:
            return k
    return width


@functools.cache
def _coordinates(width: int) -> tuple[np.ndarray, np.ndarray]:
    xor = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return xor, mixed(xor + np.uint64(77)) | np.uint64(1)


def min_hashes(grams: np.ndarray, width: int = COORDINATES) -> np.ndarray:
    xor, odd = _coordinates(width)
    out = np.full(width, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 4096):
        np.minimum(out, ((grams[at : at + 4096, None] ^ xor) * odd).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(docs: DataFrame, words: int, width: int) -> DataFrame:
    """(id, k1, k2, g1, g2, size, mh) of every row of docs (id, text): two hashes of its text, two of its set, the set's size, and its min-hashes (null without a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets, k1, k2 = [], *(batch.column(k).to_numpy() for k in (1, 2))
            keys, sizes, rows = np.stack([k1, k2]), [], []
            for k, text in enumerate(batch.column(3)):
                g = shingle_hashes(word_hashes(text.as_py()), words)
                sizes.append(len(g))
                rows.append(min_hashes(g, width) if len(g) else None)
                if len(g):
                    keys[:, k] = np.array([g.sum(), mixed(g + np.uint64(1)).sum()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys[0]), pa.array(keys[1]), pa.array(sizes, pa.int64()), pa.array(rows, pa.list_(pa.int32()))], names=["id", "k1", "k2", "g1", "g2", "size", "mh"])

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, k1 bigint, k2 bigint, g1 bigint, g2 bigint, size bigint, mh array<int>")


def _sized(rows: DataFrame) -> DataFrame:
    """rows with the size n of their bucket, without buckets of one."""
    return rows.join(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path")


def buckets(sets: DataFrame, runs: int, small: int = SMALL, depth: int = DEPTH, width: int = COORDINATES) -> DataFrame:
    """(path, set): the buckets to compare, from sets (set, mh), as a table of the shared folder."""
    sketches = sets.select("set", "mh").where("mh is not null")
    first = sketches.select("set", F.explode(F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda i: F.xxhash64(i, F.element_at("mh", i + 1)))).alias("path"))
    level = written(_sized(first).select("path", "set", "n"), "paths")
    ready, big, scratch = [level.where(F.col("n") <= small)], level.where(F.col("n") > small), [level]
    for k in range(2, depth + 1):
        if big.isEmpty():
            break
        one = F.pmod(F.xxhash64("path", F.lit(k)), F.lit(width)).cast("int")
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("path", F.lit(-k)), F.lit(width - 1)).cast("int"), F.lit(width))
        rows = big.join(sketches, "set").select("set", "path", "n", F.explode(F.transform(F.array(one, two), lambda i: F.xxhash64("path", i, F.element_at("mh", i + 1)))).alias("part"))
        parts = written(rows.groupBy("path", "n", "part").agg(F.count("*").alias("m")), "parts")
        stuck = parts.groupBy("path", "n").agg(F.max("m").alias("most")).where(F.col("most") >= STUCK * F.col("n")).select("path")
        ready.append(big.join(stuck, "path", "left_semi"))
        kept = parts.where("m > 1").join(stuck, "path", "left_anti").select("part", F.col("m"))
        level = written(rows.select("set", "part").join(kept, "part").select(F.col("part").alias("path"), "set", F.col("m").alias("n")), "paths")
        scratch += [parts, level]
        ready.append(level.where(F.col("n") <= small))
        big = level.where(F.col("n") > small)
    every = reduce(DataFrame.unionByName, [*ready, big]).select("path", "set")
    # Near copies meet in run after run: of the buckets that hold the same sets, one is enough.
    each = every.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set")).alias("y"))
    kept = each.groupBy("n", "x", "y").agg(F.min("path").alias("path")).select("path")
    out = written(every.join(kept, "path", "left_semi"), "buckets")
    discard(*scratch)
    return out


def _blocks(rows: DataFrame, n) -> DataFrame:
    """rows (path, set, ...) dealt to the pairs (low, high) of the n blocks of their bucket: a set meets each block of its bucket once."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("set"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return own.select("path", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *[c for c in own.columns if c not in ("path", "other")])


def _each_block(rows: DataFrame, compare, schema: str, names: list[str]) -> DataFrame:
    """What compare makes of the rows of each pair of blocks: it is given path, whether the two are one, and columns own, set, and all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def done() -> list[tuple]:
            return compare(key[0], key[1] == key[2], *(list(c) for c in zip(*held.values(), strict=True))) if len(held) > 1 else []

        def told(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

        for batch in sliced(batches):
            out = []
            for path, low, high, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (path, low, high) != key:
                    out += done()
                    key, held = (path, low, high), {}
                held[rest[1]] = rest
            yield told(out)
        yield told(done())

    kinds = [pa.list_(pa.int64()) if "array" in part else pa.int64() for part in schema.split(",")]
    return rows.repartition("path", "low", "high").sortWithinPartitions("path", "low", "high").mapInArrow(run, schema)


def _here(linked: np.ndarray, path: int, same_block: bool, side: list[int], paths: list[list[int]]) -> np.ndarray:
    """The linked pairs that count here: of two blocks only those across, and none that an earlier bucket holds as well."""
    np.fill_diagonal(linked, False)
    if not same_block:
        side = np.array(side)
        linked &= side[:, None] != side[None, :]
    earlier: dict[int, list[int]] = {}
    for k in np.flatnonzero(linked.any(axis=1)).tolist():
        for p in paths[k]:
            if p < path:
                earlier.setdefault(p, []).append(k)
    for members in earlier.values():
        if len(members) > 1:
            linked[np.ix_(members, members)] = False
    return linked


def candidates(found: DataFrame, sets: DataFrame, threshold: float, least: int, block: int) -> DataFrame:
    """(path, set, size, paths): of each bucket the sets that have a candidate which counts there."""
    # The paths of a set are at most runs times two to the depth.
    members = found.groupBy("set").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    known = sets.where("size > 0").select("set", "size", "mh").hint("merge").join(members, "set")
    counts = found.groupBy("path").agg(F.count("*").alias("n"))
    rows = found.join(known.hint("merge"), "set").join(counts.hint("merge"), "path")
    rows = _blocks(rows, F.ceil(F.col("n") / (4 * block)).cast("int")).drop("n")

    def compare(path: int, same_block: bool, side: list, names: list, size: list, mh: list, paths: list) -> list[tuple]:
        mh, size = np.array(mh, dtype=np.int32), np.array(size)
        agree = np.zeros((len(names), len(names)), dtype=np.int16)
        for column in mh.T:
            agree += column[:, None] == column[None, :]
        linked = (agree >= least) & (np.minimum(size[:, None], size[None, :]) >= threshold * np.maximum(size[:, None], size[None, :]) - 1e-6)
        linked = _here(linked, path, same_block, side, paths)
        return [(path, names[k], int(size[k]), paths[k]) for k in np.flatnonzero(linked.any(axis=1)).tolist()]

    rows = rows.select("path", "low", "high", "own", "set", "size", "mh", "paths")
    met = _each_block(rows, compare, "path bigint, set bigint, size bigint, paths array<bigint>", ["path", "set", "size", "paths"])
    return met.groupBy("path", "set", "size", "paths").agg(F.lit(1).alias("one")).drop("one")  # once for each pair of blocks before


def links(docs: DataFrame, sets: DataFrame, met: DataFrame, threshold: float, words: int, block: int) -> DataFrame:
    """(set, links, root): of each set that has some, in each bucket, its links with texts of other sets and its component there; from docs (id, text) and the candidates met."""
    wanted = sets.join(met.select("set").distinct(), "set").select("set", "texts", F.col("rep.id").alias("rep"), F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"))
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("id", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    texts = texts.hint("merge").join(wanted, F.col("id").eqNullSafe(F.col("rep")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select("set", "texts", "text")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = [shingle_hashes(word_hashes(t.as_py()), words).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["set", "texts", "grams"])

    sizes = met.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("grams_of"))
    rows = met.join(sizes, "path").select("path", "set", "paths", F.ceil(F.greatest(F.col("n") / block, F.least(F.col("n") / 2, F.col("grams_of") / BLOCK_GRAMS))).cast("int").alias("blocks"))
    rows = rows.hint("merge").join(texts.mapInArrow(grams, "set bigint, texts bigint, grams binary"), "set")

    def compare(path: int, same_block: bool, side: list, names: list, paths: list, texts: list, grams: list) -> list[tuple]:
        n, grams = len(names), [np.frombuffer(g, dtype=np.uint64) for g in grams]
        sizes = np.array([len(g) for g in grams])
        values, at = np.unique(np.concatenate(grams), return_inverse=True)
        times = np.bincount(at)
        shared = np.cumsum(times > 1) - 1
        owner = np.repeat(np.arange(n), sizes)
        keep = times[at] > 1
        owner, at = owner[keep], shared[at[keep]]
        both = np.zeros((n, n), dtype=np.float32)
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for low in range(0, int(at[-1]) + 1 if len(at) else 0, 4096):
            a, b = np.searchsorted(at, [low, low + 4096])
            m = np.zeros((n, 4096), dtype=np.float32)
            m[owner[a:b], at[a:b] - low] = 1
            both += m @ m.T
        union = sizes[:, None] + sizes[None, :] - both
        linked = _here(both >= threshold * union - 1e-6, path, same_block, side, paths)
        some = np.flatnonzero(linked.any(axis=1))
        if not len(some):
            return []
        linked, label = linked[np.ix_(some, some)], np.array(names, dtype=np.int64)[some]
        own, count = label.copy(), linked @ np.array(texts, dtype=np.int64)[some]
        far = np.iinfo(np.int64).max
        while True:
            low = np.minimum(label, np.where(linked, label[None, :], far).min(axis=1))
            if (low == label).all():
                break
            label = low
        return list(zip(own.tolist(), count.tolist(), label.tolist(), strict=True))

    rows = _blocks(rows, F.col("blocks")).select("path", "low", "high", "own", "set", "paths", "texts", "grams")
    return _each_block(rows, compare, "set bigint, links bigint, root bigint", ["set", "links", "root"])


def _labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, recall: float = 0.99999, small: int = SMALL, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """(id, k1, k2, label, class_id, n_links) of each row; label is the component, which tells apart components of one least id."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    runs = runs_for(threshold, recall, depth)
    width = max(COORDINATES, runs)
    rows = written(_sketches(docs, words, width), "sketches")
    texts = rows.groupBy("k1", "k2", "g1", "g2", "size", "mh").agg(F.min("id").alias("id"), F.count("*").alias("times"))
    # The representative of a set is any of its texts, with that text's least id.
    sets = texts.groupBy("g1", "g2", "size", "mh").agg(F.min(F.struct("k1", "k2", "id")).alias("rep"), F.min("id").alias("id"), F.count("*").alias("texts"), F.sum("times").alias("times"))
    sets = written(sets.withColumn("set", F.monotonically_increasing_id()), "sets")
    found = buckets(sets, runs, small, depth, width)
    met = written(candidates(found, sets, threshold, agreeing(threshold, recall, width), block), "candidates")
    discard(found)
    linked = written(links(docs, sets, met, threshold, words, block), "links")
    discard(met)
    counts = linked.groupBy("set").agg(F.sum("links").alias("links"))
    groups = components(linked.select(F.col("set").alias("a"), F.col("root").alias("b")))
    marked = sets.select("set", "id", "g1", "g2", "size", "texts", "times").join(groups.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = marked.groupBy("label").agg(F.min("id").alias("class_id"))
    own = F.when(F.col("size") > 0, F.col("texts") - 1).otherwise(0)  # texts with the same set
    told = marked.join(least, "label").join(counts, "set", "left").select("g1", "g2", "times", "label", "class_id", (F.coalesce("links", F.lit(0)) + own).alias("n_links"))
    told = written(told, "classes")
    discard(sets, linked, groups)
    return joined(rows.select("id", "k1", "k2", "g1", "g2"), told, ["g1", "g2"], "times").drop("g1", "g2")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row of docs: id, k1, k2 (its text's hashes), class_id (the least id of its component), n_links (different texts that are similar to its own)."""
    names = outputs(id_col, "k1", "k2", "class_id", "n_links")
    return _labelled(docs, id_col, text_col, **options).drop("label").toDF(id_col, *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each component of near duplicates: that with the least id, null only if all are, and of these the least text hash; of rows equal in id and text, any one."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    times = _labelled(docs, id_col, text_col, **options).groupBy("label", "id", "k1", "k2").agg(F.count("*").alias("times"))
    least = times.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2", "times")).alias("one"))
    c, h1, h2, m1, m2 = fresh(docs, "quaymark_id", "quaymark_k1", "quaymark_k2", "quaymark_h1", "quaymark_h2")
    keep = written(least.select(F.col("one.id").alias(c), F.col("one.k1").alias(h1), F.col("one.k2").alias(h2), "one.times"), "kept")
    marked = docs.withColumn(m1, F.xxhash64(text)).withColumn(m2, F.xxhash64(F.lit(1), text))

    def of(kept: DataFrame) -> DataFrame:
        return marked.join(kept.drop("times"), F.col(id_col).eqNullSafe(F.col(c)) & (F.col(m1) == F.col(h1)) & (F.col(m2) == F.col(h2)), "left_semi")

    once = of(keep.where("times = 1"))
    repeated = keep.where("times > 1")
    if not repeated.isEmpty():  # only rows that repeat an id and text are shuffled once more
        once = once.unionByName(of(repeated).dropDuplicates([m1, m2]))
    return once.select(*docs.columns)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS body, {_WORDS} AS w FROM documents),
t AS (SELECT body, min(doc_id) AS rep, any_value(w) AS w FROM d GROUP BY body),
s AS (SELECT DISTINCT rep, g FROM (SELECT rep, unnest(list_transform(range(0, greatest(len(w) - 4, least(len(w), 1))), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS g FROM t)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep),
e AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.rep JOIN n y ON p.b = y.rep WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach(a, b) AS (SELECT rep, rep FROM t UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
cls AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, cls.class_id, CAST(coalesce(deg.n_links, 0) AS BIGINT) AS n_links
FROM d JOIN t USING (body) JOIN cls USING (rep) LEFT JOIN deg USING (rep)
"""
