"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE_WORDS words. Every passage is encoded: its characters' classes and their
bigrams, the lengths and repetition of its words, then a learned hidden layer. Gated attention, tanh(V h) * sigmoid(U h),
weighs the passages; the weighted sum is the document's representation, and its logistic score the quality. Labels are of
documents only, so the attention learns by itself which passages tell.

Fitted on a bounded sample of labelled texts (fit_docs), whose passages' features come to the driver; all passages of all
texts are scored. labels, lang, source and ids are never inputs of a score.

Cases: null, empty and wordless texts are a bag of one passage without features and get a score like any other. Rows with
a null id or label aren't learned from. Repeated rows each give a row and equal texts equal scores. Without labels of both
classes every score is the share of ones, or 0.5. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import outputs, read, sliced, small_batches
from quaymark.llm.labelled import held_out, sample

PASSAGE_WORDS = 64
CLASSES = 10
FEATURES = CLASSES + CLASSES * CLASSES + 6
HIDDEN, GATE = 24, 12
_TABLE: np.ndarray | None = None
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _class_of(c: int) -> int:
    """0 blank, 1 line end, 2 small and 3 capital letter, 4 other letter or mark, 5 digit, 6 full stop or comma, 7 ! or ?, 8 other punctuation, 9 anything else."""
    ch = chr(c)
    if ch == "\n":
        return 1
    if ch.isspace():
        return 0
    kind = unicodedata.category(ch)
    if kind == "Ll":
        return 2
    if kind == "Lu":
        return 3
    if kind[0] in "LM":
        return 4
    if kind[0] == "N":
        return 5
    if ch in ".,":
        return 6
    if ch in "!?":
        return 7
    return 8 if ch in "'\"()-:;" or kind in ("Pi", "Pf", "Pd") else 9


def classes() -> np.ndarray:
    """Class of every code point."""
    global _TABLE
    if _TABLE is None:
        _TABLE = np.fromiter((_class_of(c) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    return _TABLE


def passages(text: str | None) -> np.ndarray:
    """A row of features for each passage of a text, one row at least."""
    c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = classes()[c]
    inside = kind > 1
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.zeros((1, FEATURES), dtype=np.float32)
    n = -(-len(starts) // PASSAGE_WORDS)
    # A character belongs to the passage of the word before it.
    passage = np.zeros(len(c), dtype=np.int64)
    passage[starts[PASSAGE_WORDS::PASSAGE_WORDS]] = 1
    np.cumsum(passage, out=passage)
    one = np.bincount(passage * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    pair = kind[:-1].astype(np.int64) * CLASSES + kind[1:]
    two = np.bincount(passage[1:] * (CLASSES * CLASSES) + pair, minlength=n * CLASSES * CLASSES).reshape(n, CLASSES * CLASSES)
    size = np.maximum(one.sum(axis=1, keepdims=True), 1)
    # Words: their lengths and hashes.
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    length = ends - starts
    place = np.arange(len(c), dtype=np.uint64)
    place -= np.repeat(place[starts], np.diff(np.append(starts, len(c)))) if starts[0] == 0 else np.repeat(place[np.append(0, starts)], np.diff(np.concatenate([[0], starts, [len(c)]])))
    mixed = (c + np.uint64(7)) * (place * np.uint64(2) + np.uint64(1)) * _BASE
    upto = np.concatenate([[np.uint64(0)], np.cumsum(mixed ^ (mixed >> np.uint64(29)), dtype=np.uint64)])
    word = upto[ends] - upto[starts]
    of = np.arange(len(starts)) // PASSAGE_WORDS
    words = np.bincount(of, minlength=n)
    mean = np.bincount(of, length, minlength=n) / words
    spread = np.sqrt(np.maximum(0, np.bincount(of, length.astype(np.float64) ** 2, minlength=n) / words - mean**2))
    same = np.concatenate([[False], word[1:] == word[:-1]])
    first = np.zeros(len(word), dtype=bool)
    first[np.unique(word, return_index=True)[1]] = True
    own = _distinct(of, word)
    share = lambda x: np.bincount(of, x, minlength=n) / words
    rest = np.stack([np.log1p(mean), np.log1p(spread), share(same), share(first), np.bincount(own, minlength=n) / words, np.log1p(size[:, 0]) / 10], axis=1)
    return np.concatenate([np.sqrt(one / size), np.sqrt(two / size), rest], axis=1).astype(np.float32)


def _distinct(of: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The passage of each word that differs from those before it in its passage."""
    order = np.lexsort((word, of))
    a, b = of[order], word[order]
    return a[np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    params: dict[str, np.ndarray]
    constant: float | None = None  #: the score of every text if nothing could be learned

    def forward(self, x: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
        """Of passages x, in bags that begin at the given rows: hidden layer, gates, attention and score."""
        p = self.params
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.maximum(0, x @ p["W"] + p["w0"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["a"]
        sizes = np.diff(np.append(begins, len(x)))
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, begins), sizes))
        a = e / np.repeat(np.add.reduceat(e, begins), sizes)
        z = np.add.reduceat(a[:, None] * h, begins)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "sizes": sizes, "score": _sigmoid(z @ p["c"] + p["b"][0])}

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Scores, and each text's attention over its passages."""
        if not texts:
            return np.zeros(0), []
        bags = [passages(t) for t in texts]
        sizes = np.array([len(b) for b in bags])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        if self.constant is not None:
            return np.full(len(texts), self.constant), [np.full(k, 1 / k) for k in sizes]
        out = self.forward(np.concatenate(bags), begins)
        return out["score"], np.split(out["a"], begins[1:])


def train(bags: list[np.ndarray], y: np.ndarray, rounds: int = 120, rate: float = 0.01, decay: float = 1e-4) -> Model:
    """Adam over all bags at once; the gradient of the mean cross-entropy is written out below."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), {}, float(y.mean()) if len(y) else 0.5)
    x = np.concatenate(bags).astype(np.float32)
    begins = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    r = np.random.default_rng(7)
    draw = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    rate_of_ones = float(np.log(y.mean() / (1 - y.mean())))
    params = {"W": draw(FEATURES, HIDDEN), "w0": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE, 1)[:, 0], "c": draw(HIDDEN, 1)[:, 0], "b": np.array([rate_of_ones], np.float32)}
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-3, params)
    m1, m2 = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        f = model.forward(x, begins)
        d = ((f["score"] - y) / len(y)).astype(np.float32)
        grad = {"c": f["z"].T @ d, "b": np.array([d.sum()])}
        dz = np.repeat(d[:, None] * params["c"], f["sizes"], axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, begins), f["sizes"]))
        dt, dg = de[:, None] * params["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * params["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ params["V"].T + dg @ params["U"].T) * (f["h"] > 0)
        grad |= {"a": (f["t"] * f["g"]).T @ de, "V": f["h"].T @ dt, "U": f["h"].T @ dg, "W": f["x"].T @ dh, "w0": dh.sum(axis=0)}
        for k, v in params.items():
            g = grad[k] + decay * v
            m1[k] += 0.1 * (g - m1[k])
            m2[k] += 0.001 * (g**2 - m2[k])
            v -= (rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def _spread(bag: np.ndarray, most: int) -> np.ndarray:
    return bag if len(bag) <= most else bag[np.arange(most) * len(bag) // most]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: int = 4, held: int = 2, fit_docs: int = 4_000, fit_passages: int = 64, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from about fit_docs labelled texts at most, none of them held out, and of each at most fit_passages passages, evenly spread; scores read all."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            bags = [_spread(passages(t), fit_passages).astype(np.float16).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(bags, pa.binary())], names=["id", "y", "bag"])

    rows = sample(docs, labels, label, fold, held, fit_docs, id_col, text_col).mapInArrow(encode, "id string, y int, bag binary")
    got = sorted(rows.collect(), key=lambda r: r.id)  # fit_docs bags of fit_passages passages of 232 bytes at most: 60 MB
    bags = [np.frombuffer(r.bag, dtype=np.float16).reshape(-1, FEATURES) for r in got]
    return train(bags, np.array([r.y > 0 for r in got], dtype=np.float64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, attention): of every text its score, and the weights of its passages in order."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # some 20 kB, whatever the corpus
    names = outputs(id_col, "score", "attention")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in sliced(batches, 64):
            found, weights = model.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.float64)), pa.array([w.astype(np.float32) for w in weights], pa.list_(pa.float32()))], names=[id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {names[0]} double, {names[1]} array<float>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("attention").alias("n_passages"))
