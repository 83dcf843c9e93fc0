"""Language identification by nearest centroid.

Method: a text is a normalised TF-IDF vector of its letter n-grams (1 to 3, word borders marked); every language
has several centroids, found by spherical k-means; the centroid of highest cosine gives the language. A text whose
distance from the nearest centroid is beyond what its length allows is rejected.

What is learned: document frequencies of n-grams are counted over all learnable rows, in one pass that leaves a
count per n-gram bucket and task; only the centroids are fitted on a bounded sample (fit_docs_per_lang), each language's
in a task of its own. Every bucket that occurs is a feature, so a rare language keeps its own letters; vectors and
centroids are sparse.
lang is read in learning alone; source and ids are never inputs of a prediction.

Cases: null texts, texts without a letter and those that share no n-gram with a centroid are `und`, score 0, rejected. Rows with a null lang or id are
predicted but not learned from. Repeated rows each give a row. Ties go to the first language in alphabetical
order. If nothing can be learned, every text is `und`. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import fresh, read, sliced, small_batches

BITS = 18
UNKNOWN = "und"
_SPACE = np.uint32(32)
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTERS


def gram_buckets(text: str | None) -> np.ndarray:
    """Buckets of a text's n-grams, with repeats; empty if it has no letter."""
    if not text:
        return np.empty(0, dtype=np.uint32)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.where(letters()[c], c, _SPACE)
    c = np.concatenate([[_SPACE], c, [_SPACE]]).astype(np.uint32)
    c = c[np.concatenate([[True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)])]
    if len(c) < 3:
        return np.empty(0, dtype=np.uint32)
    a, b = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77)
    one = (a[1:-1] ^ np.uint32(0x1234567))[c[1:-1] != _SPACE]
    two = (a[:-1] + (b[1:] ^ np.uint32(0x7ED55D16))) * np.uint32(0xC2B2AE3D)
    three = ((a[:-2] ^ (b[1:-1] >> np.uint32(3))) * np.uint32(0x27D4EB2F) + b[2:]) * np.uint32(0x165667B1)
    return np.concatenate([one * np.uint32(0x2545F491), two, three]) >> np.uint32(32 - BITS)


@dataclass
class Model:
    place: np.ndarray  #: of each bucket, its feature, or the number of features if unknown
    idf: np.ndarray
    idf_unknown: float
    starts: np.ndarray  #: of each feature, where its postings begin; one more at the end
    which: np.ndarray  #: of each posting, its centroid
    weight: np.ndarray  #: of each posting, the centroid's value
    of: np.ndarray  #: of each centroid, its language
    langs: list[str]
    floor: np.ndarray  #: of each centroid, the lowest cosine of a text of full length that is still accepted

    @property
    def centroids(self) -> np.ndarray:
        """The centroids as dense rows."""
        out = np.zeros((len(self.of), len(self.idf)), dtype=np.float32)
        out[self.which, np.repeat(np.arange(len(self.idf)), np.diff(self.starts))] = self.weight
        return out

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Features and values of a text's normalised vector, and its number of n-grams."""
        buckets = gram_buckets(text)
        n = len(self.idf)
        found, counts = np.unique(buckets, return_counts=True)
        at = self.place[found]
        known = at < n
        unknown = float(counts[~known].sum())
        at = at[known]
        v = np.log1p(counts[known]).astype(np.float32) * self.idf[at]
        norm = float(v @ v) + np.log1p(unknown) ** 2 * self.idf_unknown**2
        return at, v / np.float32(np.sqrt(norm)) if norm > 0 else v, len(buckets)

    def cosines(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Of a vector, the cosine with each centroid."""
        begin, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        posts = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        return np.bincount(self.which[posts], weights=self.weight[posts] * np.repeat(v, n), minlength=len(self.of))

    def nearest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        langs, top, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        for k, text in enumerate(texts if self.langs else []):
            at, v, size = self.vector(text)
            cosines = self.cosines(at, v)
            best = int(cosines.argmax())
            if cosines[best] > 0:
                langs[k], top[k] = self.langs[self.of[best]], min(1.0, cosines[best])
                # A short text shares few n-grams with any centroid: less is asked of it.
                rejected[k] = top[k] < self.floor[best] * min(1.0, np.sqrt(size / FULL_GRAMS))
        return langs, top, rejected


#: Languages that a model may have; more values than that are an error.
MAX_LANGS = 10_000
#: N-grams from which a text counts as of full length for rejection.
FULL_GRAMS = 1500


def _learnable(docs: DataFrame, id_col: str, text_col: str, lang_col: str, fold: int, held: int) -> DataFrame:
    rest = F.crc32(F.col(id_col).cast("string")) % fold
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where((rest != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 4, held: int = 2, features: int | None = None, clusters: int = 3, fit_docs_per_lang: int = 400, reject: float = 0.2) -> Model:
    """A model from rows whose crc32(id) mod fold is not held. Of each language about fit_docs_per_lang texts, picked by hash, give the centroids. With `features`, only the buckets of that many highest frequencies are features, which costs rare languages theirs."""
    small_batches(docs.sparkSession)
    rows = _learnable(docs, id_col, text_col, lang_col, fold, held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                df[np.unique(gram_buckets(text))] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["bucket", "df"])

    counted = rows.select("text").mapInArrow(count, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df"))
    # A row for each bucket at most comes to the driver; bucket -1 holds the number of texts.
    got = counted.toArrow()
    bucket, df = got.column("bucket").to_numpy(), got.column("df").to_numpy()
    texts = int(df[bucket < 0].sum())
    order = np.lexsort((bucket, -df))
    order = order[bucket[order] >= 0][:features]
    bucket, df, n = bucket[order], df[order], len(order)
    place = np.full(1 << BITS, n, dtype=np.int32)
    place[bucket] = np.arange(n)
    idf = (np.log((1 + texts) / (1 + df)) + 0.1).astype(np.float32)
    idf_unknown = float(np.log(1 + texts) + 0.1)
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}  # a row for each language
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"{lang_col} has more than {MAX_LANGS} values; it can't be a language")
    empty = Model(place, idf, idf_unknown, np.zeros(n + 1, int), np.zeros(0, int), np.zeros(0, np.float32), np.zeros(0, int), [], np.zeros(0))
    if not sizes or not n:
        return empty
    shares = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, fit_docs_per_lang / n))])
    drawn = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000)) / 1_000_000.0
    shipped = docs.sparkSession.sparkContext.broadcast(empty)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in sliced(batches):
            found = [model.vector(t) for t in batch.column(1).to_pylist()]
            keep = [k for k, (at, _, _) in enumerate(found) if len(at)]
            columns = [batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 2)]
            columns += [pa.array([found[k][c].tobytes() for k in keep], pa.binary()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([found[k][2] for k in keep], pa.int64())], names=["lang", "h", "at", "v", "n"])

    def centre(texts: pa.Table) -> pa.Table:
        texts = texts.sort_by([("h", "ascending"), ("n", "ascending")])
        at = [np.frombuffer(b, dtype=np.int32) for b in texts.column("at").to_pylist()]
        v = [np.frombuffer(b, dtype=np.float32) for b in texts.column("v").to_pylist()]
        full = np.minimum(1.0, np.sqrt(texts.column("n").to_numpy() / FULL_GRAMS))
        made = []
        for c, members, near in _kmeans(at, v, n, clusters):
            some = np.flatnonzero(c)
            made.append((some.astype(np.int32).tobytes(), c[some].astype(np.float32).tobytes(), reject * float(np.median(near / full[members]))))
        return pa.table([pa.array([texts.column("lang")[0].as_py()] * len(made), pa.string()), pa.array(range(len(made)), pa.int32()), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.float64())))], names=["lang", "k", "at", "v", "floor"])

    sample = rows.where(drawn < F.try_element_at(shares, F.col("lang"))).select("lang", "text", F.xxhash64("id", "text").alias("h"))
    sample = sample.mapInArrow(vectors, "lang string, h bigint, at binary, v binary, n bigint")
    # `clusters` rows of each language come to the driver.
    got = sorted(sample.groupBy("lang").applyInArrow(centre, "lang string, k int, at binary, v binary, floor double").collect(), key=lambda r: (r.lang, r.k))
    langs = sorted({r.lang for r in got})
    at = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r.at, dtype=np.int32) for r in got)])
    weight = np.concatenate([np.zeros(0, np.float32), *(np.frombuffer(r.v, dtype=np.float32) for r in got)])
    which = np.repeat(np.arange(len(got), dtype=np.int32), [len(r.at) // 4 for r in got])
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(n + 1))
    return Model(place, idf, idf_unknown, starts, which[order], weight[order], np.array([langs.index(r.lang) for r in got], dtype=int), langs, np.array([r.floor for r in got]))


def _kmeans(at: list[np.ndarray], v: list[np.ndarray], features: int, clusters: int, rounds: int = 12) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Unit centroids of sparse rows by spherical k-means, each with its members and their cosines; it begins with the mean and the rows farthest from those chosen."""
    sizes = np.array([len(a) for a in at])
    at, v, first = np.concatenate(at), np.concatenate(v), np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)

    def centre(mine: np.ndarray) -> np.ndarray:
        keep = mine[owner]
        c = np.bincount(at[keep], weights=v[keep], minlength=features)
        return c / (np.linalg.norm(c) or 1)

    def cosines(c: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([np.add.reduceat(v * x[at], first) for x in c])

    c = [centre(np.ones(len(sizes), dtype=bool))]
    while len(c) < min(clusters, len(sizes)):
        far = int(np.argmin(cosines(c).max(axis=1)))
        c.append(centre(np.arange(len(sizes)) == far))
    for _ in range(rounds):
        near = cosines(c).argmax(axis=1)
        c = [centre(near == k) if (near == k).any() else x for k, x in enumerate(c)]
    found = cosines(c)
    near = found.argmax(axis=1)
    return [(x, near == k, found[near == k, k]) for k, x in enumerate(c) if (near == k).any()]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred, score (the cosine) and rejected; where docs has such names, underscores are added to these."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a few MB for each language at most
    names = fresh(docs, "lang_pred", "score", "rejected")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in sliced(batches):
            langs, score, rejected = model.nearest(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, *names])

    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known; rejected ones go."""
    found = predict(docs, model, text_col=text_col)
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)
