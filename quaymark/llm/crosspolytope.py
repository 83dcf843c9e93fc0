"""Nearest neighbours by cosine through cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the signed axis that is nearest to what comes
out is its hash, and a bucket of a table is the hash of one or several such pseudo-rotations. Every vector lies in one bucket of
each table; a query looks into several, best first by how near its rotated vector is to their axes. Buckets that are looked
into are compared exactly, in double precision, and the best of all buckets are merged.

How many buckets a query looks into is fitted: for a bounded sample of queries (fit_queries) the true neighbours are found by
brute force over all vectors, and the number of probes is the least at which the sample finds a share of `recall` of them; at
all buckets of a table the search is exact. The number of pseudo-rotations to a bucket grows with the number of vectors, so
that buckets hold some thousand of them. A query that finds fewer than k others is compared with all vectors, in blocks.

Equal vectors are one vector with a number of ids, so a group of copies is hashed and compared once. A bucket with more
vectors or queries than a block holds is compared in pairs of blocks: no task holds more than two blocks, and none is left out.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, take no part. Shorter
vectors count as padded with zeros. Rows that repeat an id and a vector count once; if an id has several vectors each is a
query, and none of the id's rows is found for it. Nearness ties go to the smaller id. Where fewer than k others exist all are
found. There are no texts here, so their length doesn't matter. An empty table, or one without queries, gives no rows. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaymark.llm.common import discard, joined, read, sliced, small_batches, written

TABLES, RECALL, FIT_QUERIES, SEED = 4, 0.96, 256, 11
#: Vectors and queries of a block; buckets hold BLOCK vectors on average at most.
BLOCK, QUERY_BLOCK = 4096, 1024
#: A table of buckets of so many rows (some 5 MB) is broadcast, a larger one is joined by a shuffle, its hot keys apart.
SHIPPED_BUCKETS = 100_000
#: Candidates whose scores by matrix product are this near to the last one kept are scored again.
SLACK = 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, size = x.shape
    h = 1
    while h < size:
        pairs = x.reshape(n, size // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        h *= 2
    return x / np.sqrt(size)


def matrix(vectors: pa.Array, size: int) -> np.ndarray:
    """A list column as rows of doubles, padded with zeros and scaled by a power of two (exact), so that squares neither overflow nor vanish."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(lengths.sum())).to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(lengths), size))
    out[np.arange(size)[None, :] < lengths[:, None]] = flat
    return np.ldexp(out, -np.frexp(np.abs(out).max(axis=1, initial=0))[1][:, None])


class Hashes:
    """The buckets of vectors: tables of `depth` pseudo-rotations of `size` components each."""

    def __init__(self, size: int, depth: int, tables: int = TABLES, seed: int = SEED):
        self.size, self.depth, self.tables = size, depth, tables
        self.signs = np.random.default_rng(seed).integers(0, 2, (tables, depth, 3, size)) * 2.0 - 1

    def axes(self, x: np.ndarray, table: int, level: int) -> np.ndarray:
        """How near rotated rows are to each signed axis."""
        for signs in self.signs[table, level]:
            x = hadamard(x * signs)
        return np.concatenate([x, -x], axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each row in each table."""
        out = np.zeros((len(x), self.tables), dtype=np.int64)
        for table, level in product(range(self.tables), range(self.depth)):
            out[:, table] = out[:, table] * 2 * self.size + self.axes(x, table, level).argmax(axis=1)
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """The best `count` buckets of each row in each table, best first. A bucket is among the best only if the product of its axes' ranks, from 1, is."""
        x = x / np.linalg.norm(x, axis=1)[:, None]
        width = 2 * self.size
        ranks = np.zeros((1, 0), dtype=np.int64)
        for _ in range(self.depth):
            ranks = np.array([(*r, k) for r in ranks.tolist() for k in range(min(width, count // int(np.prod(np.array(r) + 1, dtype=np.int64))))], dtype=np.int64)
        out = np.empty((len(x), self.tables, count), dtype=np.int64)
        for table in range(self.tables):
            total, code = np.zeros((len(x), len(ranks))), np.zeros((len(x), len(ranks)), dtype=np.int64)
            for level in range(self.depth):
                near = self.axes(x, table, level)
                best = np.argsort(-near, axis=1, kind="stable")[:, : ranks[:, level].max() + 1][:, ranks[:, level]]
                total += np.take_along_axis(near, best, axis=1)
                code = code * width + best
            out[:, table] = np.take_along_axis(code, np.argsort(-total, axis=1, kind="stable")[:, :count], axis=1)
        return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows with rows, each by itself: equal pairs get equal scores wherever they meet."""
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def best_of(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k nearest rows, ties to the smaller id."""
    close = (queries / np.linalg.norm(queries, axis=1)[:, None]) @ (rows / np.linalg.norm(rows, axis=1)[:, None]).T
    k = min(k, len(rows))
    last = np.partition(close, len(rows) - k, axis=1)[:, len(rows) - k]
    q, r = np.nonzero(close >= last[:, None] - SLACK)
    exact = np.concatenate([scores(queries[q[i : i + BLOCK]], rows[r[i : i + BLOCK]]) for i in range(0, len(q), BLOCK)] or [np.empty(0)])
    order = np.lexsort((ids[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[kept], r[kept], exact[kept]


def _clean(vectors: DataFrame, id_col: str, vector_col: str, is_query) -> DataFrame:
    """(id, vec, asks): rows that take part, each once."""
    vec = F.col(vector_col)
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & vec.isNotNull() & F.coalesce(fine, F.lit(False))).groupBy(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).agg(F.max(F.coalesce(is_query, F.lit(False))).alias("asks"))


def _nearest_in_groups(rows: DataFrame, size: int, k: int) -> DataFrame:
    """(asker, vid, lead, score): the k nearest vectors of each query of a group (table, code, row block, query block); rows are dealt by group, queries (kind 0) first."""
    keys = ["table", "code", "row_block", "query_block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        group = None

        def done() -> Iterator[pa.RecordBatch]:
            if held[0] and held[1]:
                (askers, _, asking), (vids, leads, there) = [tuple(np.concatenate(x) for x in zip(*held[kind], strict=True)) for kind in (0, 1)]
                q, r, exact = best_of(asking, there, leads, k)
                yield pa.RecordBatch.from_arrays([pa.array(askers[q]), pa.array(vids[r]), pa.array(leads[r]), pa.array(exact)], names=["asker", "vid", "lead", "score"])
            held[0], held[1] = [], []

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "kind")], axis=1)
            vids, leads, vecs = batch.column("vid").to_numpy(), batch.column("lead").to_numpy(), matrix(batch.column("vec"), size)
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(marks)], strict=True):
                if (now := tuple(marks[a, :4].tolist())) != group:
                    yield from done()
                    group = now
                held[int(marks[a, 4])].append((vids[a:b], leads[a:b], vecs[a:b]))
        yield from done()

    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "asker bigint, vid bigint, lead bigint, score double")


def _meet(there: DataFrame, asking: DataFrame, size: int, k: int) -> DataFrame:
    """(asker, vid, lead, score) of rows there and asking (table, code, vid, lead, vec), the k nearest of each group of blocks. Both are read twice."""
    load = there.groupBy("table", "code").agg(F.count("*").alias("n_rows")).join(asking.groupBy("table", "code").agg(F.count("*").alias("n_queries")), ["table", "code"])
    blocks = lambda n, size: F.ceil(F.col(n) / size).cast("int").alias(n + "_blocks")
    load = written(load.select("table", "code", "n_rows", "n_queries", blocks("n_rows", BLOCK), blocks("n_queries", QUERY_BLOCK)), "buckets")
    if load.count() <= SHIPPED_BUCKETS:
        with_load = lambda df, times: df.join(F.broadcast(load), ["table", "code"])
    else:
        with_load = lambda df, times: joined(df, load.withColumn("times", F.col(times)), ["table", "code"], "times")
    mine = lambda n: F.pmod(F.xxhash64("vid"), F.col(n + "_blocks")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n + "_blocks") - 1))
    columns = ["table", "code", "row_block", "query_block", "kind", "vid", "lead", "vec"]
    rows = with_load(there, "n_rows").withColumns({"row_block": mine("n_rows"), "kind": F.lit(1)}).withColumn("query_block", every("n_queries")).select(columns)
    queries = with_load(asking, "n_queries").withColumns({"query_block": mine("n_queries"), "kind": F.lit(0)}).withColumn("row_block", every("n_rows")).select(columns)
    return _nearest_in_groups(queries.unionByName(rows), size, k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best vectors of each asker; a pair that met in several buckets counts once."""
    pairs = found.groupBy("asker", "vid", "lead").agg(F.max("score").alias("score"))
    return pairs.withColumn("nth", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "lead"))).where(F.col("nth") <= k).drop("nth")


def fit_probes(distinct: DataFrame, hashes: Hashes, k: int, recall: float = RECALL, fit_queries: int = FIT_QUERIES) -> int:
    """The least number of probes a table at which a sample of the askers of distinct (vid, lead, vec, n_asking) finds `recall` of its k nearest other vectors, which brute force over all vectors finds."""
    size = hashes.size
    sample = distinct.where("n_asking > 0").orderBy(F.xxhash64("vid"), "vid").limit(fit_queries).select("vid", "vec").toArrow()  # fit_queries rows
    buckets = (2 * size) ** hashes.depth
    if not len(sample):
        return 1
    asking, names = matrix(sample.column("vec"), size), sample.column("vid").to_numpy()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the best so far of this task, for each of the sample
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, leads = matrix(batch.column("vec"), size), batch.column("lead").to_numpy()
            q, r, exact = best_of(asking, rows, leads, k + 1)
            new = [q, batch.column("vid").to_numpy()[r], leads[r], exact, rows[r]]
            kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
            order = np.lexsort((kept[2], -kept[3], kept[0]))
            kept = [x[order] for x in kept]
            best = np.arange(len(order)) - np.searchsorted(kept[0], kept[0]) < k + 1
            kept = [x[best] for x in kept]
        if kept is not None:
            vec = pa.FixedSizeListArray.from_arrays(pa.array(kept[4].ravel()), size).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(names[kept[0]]), *[pa.array(x) for x in kept[1:4]], vec], names=["asker", "vid", "lead", "score", "vec"])

    found = distinct.select("vid", "lead", "vec").mapInArrow(near, "asker bigint, vid bigint, lead bigint, score double, vec array<double>").where("asker != vid")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "lead"))).where(F.col("nth") <= k).toArrow()  # k rows for each of the sample
    if not len(found):
        return 1
    place = {v: n for n, v in enumerate(names.tolist())}
    asker = np.array([place[v] for v in found.column("asker").to_pylist()])
    codes = hashes.codes(matrix(found.column("vec"), size))
    count = 1
    while count < buckets:
        probes = hashes.probes(asking, count)
        hit = (probes[asker] == codes[:, :, None]).any(axis=(1, 2))
        if hit.mean() >= recall:
            break
        count = min(buckets, count + max(1, count // 4))
    return count


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, tables: int = TABLES, recall: float = RECALL, fit_queries: int = FIT_QUERIES) -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows of each row for which the Column is_query holds."""
    small_batches(vectors.sparkSession)
    rows = written(_clean(vectors, id_col, vector_col, is_query), "vectors")
    groups = rows.groupBy("vec").agg(F.count("*").alias("n"), F.count_if("asks").alias("n_asking"), F.min("id").alias("lead"))
    distinct = written(groups.withColumn("vid", F.monotonically_increasing_id()), "distinct")
    about = distinct.agg(F.count("*").alias("n"), F.sum("n").alias("ids"), F.max(F.size("vec")).alias("length")).first()
    size = 2 ** max(1, int(np.ceil(np.log2(max(2, about.length or 0)))))
    depth = 1
    while about.n > BLOCK * (2 * size) ** depth and (2 * size) ** (depth + 1) < 2**62:
        depth += 1
    hashes = Hashes(size, depth, tables)
    probes = fit_probes(distinct, hashes, k, recall, fit_queries)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"), size)
                asks = np.flatnonzero(batch.column("n_asking").to_numpy() > 0)
                sought: list = [None] * batch.num_rows
                for n, p in zip(asks.tolist(), hashes.probes(x[asks], probes) if len(asks) else [], strict=True):
                    sought[n] = p.tolist()
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("vid", "lead", "vec", "n_asking")], pa.array(hashes.codes(x).tolist(), pa.list_(pa.int64())), pa.array(sought, pa.list_(pa.list_(pa.int64())))], names=["vid", "lead", "vec", "n_asking", "codes", "probes"])

    kind = distinct.schema["vec"].dataType.simpleString()
    hashed = written(distinct.select("vid", "lead", "vec", "n_asking").mapInArrow(coded, f"vid bigint, lead bigint, vec {kind}, n_asking bigint, codes array<bigint>, probes array<array<bigint>>"), "hashed")
    there = hashed.select("vid", "lead", "vec", F.posexplode("codes").alias("table", "code"))
    asking = hashed.where("n_asking > 0").select("vid", "lead", "vec", F.posexplode("probes").alias("table", "sought")).withColumn("code", F.explode("sought")).drop("sought")
    found = written(_merged(_meet(there, asking, size, k + 1), k + 1), "nearest")

    # Ids of vectors that several rows have: the least of them for what is found, all that ask for the queries.
    copies = written(joined(rows, distinct.where("n > 1").select("vec", "vid", "n", "lead"), ["vec"], "n").select("vid", "id", "asks"), "copies")
    nth = F.row_number().over(Window.partitionBy("vid").orderBy("id"))
    least = copies.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("vid").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    def with_ids(found: DataFrame) -> DataFrame:
        """(asker, near): the k + 1 nearest ids of each asker, in order."""
        each = found.join(least, "vid", "left").select("asker", "score", F.explode(F.coalesce("ids", F.array("lead"))).alias("id"))
        each = each.withColumn("nth", F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k + 1)
        return each.groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("nth", "id", "score"))).alias("near"))

    near = written(with_ids(found), "near")
    wanted = min(k + 1, about.ids or 0)
    short = hashed.where("n_asking > 0").join(near.where(F.size("near") >= wanted), F.col("vid") == F.col("asker"), "left_anti")
    if not short.isEmpty():  # their buckets hold too few: these are compared with all vectors
        whole = {"table": F.lit(0), "code": F.lit(0).cast("bigint")}
        other = written(_merged(_meet(hashed.select("vid", "lead", "vec").withColumns(whole), written(short.select("vid", "lead", "vec").withColumns(whole), "short"), size, k + 1), k + 1), "nearest")
        near = written(near.where(F.size("near") >= wanted).union(with_ids(other)), "near")
    asked = distinct.where("n_asking > 0").select(F.col("vid").alias("asker"), "n", "n_asking", "lead")
    lists = written(near.join(asked, "asker"), "lists")
    discard(hashed, found, rows)
    # A vector that asks under many ids meets its list like a hot key.
    many = joined(copies.where("asks").select(F.col("vid").alias("asker"), F.col("id").alias("query_id")), lists.where("n > 1").select("asker", "near", "n_asking"), ["asker"], "n_asking")
    one = lists.where("n = 1").select(F.col("lead").alias("query_id"), "near")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = one.union(many.select("query_id", "near")).select("query_id", F.posexplode(others).alias("place", "one"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("one.id").alias("id"), F.col("one.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.withColumnRenamed("id", "vec_id")
