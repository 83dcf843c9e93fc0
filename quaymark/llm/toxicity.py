"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target (subject or object), speaker, negation, report, or other; an insult that
stands after a different insult word of the text is a further one. One transducer reads a clause backwards and marks
hits that a target follows closely. Three read it forwards and are composed into one machine: negation marks hits shortly
behind a negation, report marks hits behind a verb of speech, and aiming names each hit's pattern:

    aimed     an insult within AIM words of a target, on either side, in its clause
    threat    a threat word with a target as its object, shortly behind it or between it and a speaker before
    piled     a further insult without a target; the first one then counts as well
    negated, reported   any of these behind a negation or a verb of speech

Other hits match nothing: an isolated word, or a threat word without an object, scores as if it weren't there. Of each
pattern a clause gives its strongest hit, once for each word of the text, and a document's score is the logistic of what
its clauses add up to by pattern.

The lexicon's weights are log odds: word beginnings that are far more frequent in toxic texts than in others, counted over
a bounded sample of labelled texts (fit_docs), join a short fixed list as insults. Pattern weights are fitted on another
part of that sample, held towards the fixed ones, and are never negative.

Cases: null, empty and wordless texts have no clause and get the score of the absence of any. Rows with a null id or
label aren't learned from. Repeated rows each give a row. Texts of any length are read whole. Of two hits that begin at
one place the heavier counts. Without labels, the fixed list and weights hold. An empty table gives an empty result. Only
the named columns are read; an output column that would have the id's name gets an underscore.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.common import outputs, read, sliced, small_batches, written
from quaymark.llm.labelled import held_out, sample

# Fixed words of the grammar, in English, German, French and Spanish.
INSULTS = "idiot moron loser scum trash stupid worthless pathetic disgusting clown dumb vermin idiota imbécile salaud abruti estúpido basura dummkopf abschaum".split()
THREATS = "kill murder hurt beat destroy stab shoot töten töte umbringen tuer tue frapper matar matarte golpear golpearte".split()
SUBJECTS = "your you're u he she they his their du er tu t' il elle ils él ella ellos".split()
OBJECTS = "you him her them dich dir euch ihn ihr sie te toi vous lui les ti usted".split()
SPEAKERS = "i i'll i'm we we'll ich wir je nous yo nosotros voy vamos".split()
NEGATIONS = "not no never none nobody isn't aren't don't doesn't won't nicht kein keine nie pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say told wrote writes claimed quoted quote reported sagte schrieb behauptete dit écrit déclaré dijo escribió afirmó".split()
#: Threat words that hold their object.
WITH_OBJECT = "matarte golpearte".split()

OTHER, INSULT, MORE, THREAT, SUBJECT, OBJECT, SPEAKER, NEGATION, REPORT = range(9)
HITS = (INSULT, MORE, THREAT)
PATTERNS = ("aimed", "negated", "reported", "threat", "piled")
AIMED, NEGATED, REPORTED, THREATENED, PILED = range(5)
PRIOR = np.array([1.2, 0.1, 0.1, 1.2, 1.0])
PRIOR_BIAS, LISTED = -3.0, 4.0
#: Words within which a negation reaches, a target makes an insult aimed, and an object makes a threat.
REACH, AIM, NEAR = 3, 6, 3
_CLASS = {w: c for c, words in ((SUBJECT, SUBJECTS), (OBJECT, OBJECTS), (SPEAKER, SPEAKERS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
_CLAUSE_END = regex.compile(r"[.!?;\n|]")
#: Words end at an apostrophe, where a hit may begin; only listed contractions stay whole, and the elided t' (te, tu).
_CONTRACTED = "|".join(sorted((w.replace("'", "['’]") for w in _CLASS if "'" in w[:-1]), key=len, reverse=True))
_WORD = regex.compile(rf"(?:{_CONTRACTED})(?![\p{{L}}\p{{N}}])|(?<!['’])t['’](?=\p{{L}})|[\p{{L}}\p{{N}}]+")
_WORDS = regex.compile(r"\p{L}+")
#: Lengths of word beginnings that may become stems, the support and the G2 that they need, and how many at most.
STEM_CHARS, MIN_DOCS, MIN_G2, MIN_ODDS, MAX_STEMS = range(4, 11), 7, 30.0, 4.0, 20_000
#: Word beginnings that a task counts before it passes its counts on.
COUNTED = 400_000


@dataclass
class Transducer:
    """Deterministic: (state, symbol) -> (state, symbol). State 0 is the start."""

    arcs: dict[tuple[int, object], tuple[int, object]]

    @staticmethod
    def of(start: object, step: Callable[[object, object], tuple[object, object]], inputs: list) -> Transducer:
        """The machine of the states that can be reached from start."""
        number, todo, arcs = {start: 0}, [start], {}
        while todo:
            state = todo.pop()
            for s in inputs:
                after, out = step(state, s)
                if after not in number:
                    number[after] = len(number)
                    todo.append(after)
                arcs[number[state], s] = number[after], out
        return Transducer(arcs)

    def then(self, other: Transducer) -> Transducer:
        """The composition: this one's output is the other's input."""

        def step(state: tuple[int, int], s: object) -> tuple[tuple[int, int], object]:
            a, mid = self.arcs[state[0], s]
            b, out = other.arcs[state[1], mid]
            return (a, b), out

        return Transducer.of((0, 0), step, list(dict.fromkeys(s for _, s in self.arcs)))

    def outputs(self) -> list:
        return list(dict.fromkeys(out for _, out in self.arcs.values()))


def coming() -> Transducer:
    """Reads a clause backwards: insults that a target follows within AIM words, and threats that an object follows within NEAR, become ('to', hit)."""

    def step(state: tuple[int, int], s: int) -> tuple[tuple[int, int], object]:
        target, thing = state
        met = thing if s == THREAT else target if s in HITS else 0
        after = AIM if s in (SUBJECT, OBJECT) else max(0, target - 1), NEAR if s == OBJECT else max(0, thing - 1)
        return after, ("to", s) if met else s

    return Transducer.of((0, 0), step, list(range(9)))


def _is_hit(s: object) -> bool:
    return s in HITS if isinstance(s, int) else s[0] in ("to", "not")


def negation(inputs: list) -> Transducer:
    """Hits up to REACH words behind a negation become ('not', hit)."""
    return Transducer.of(0, lambda left, s: (REACH if s == NEGATION else max(0, left - 1), ("not", s) if left and _is_hit(s) else s), inputs)


def reporting(inputs: list) -> Transducer:
    """Hits behind a verb of speech become ('said', hit), up to the clause's end."""
    return Transducer.of(False, lambda said, s: (said or s == REPORT, ("said", s) if said and _is_hit(s) else s), inputs)


def aiming(inputs: list) -> Transducer:
    """Names each hit's pattern; None for other words and for hits that match none."""

    def step(state: tuple[int, int], s: object) -> tuple[tuple[int, int], object]:
        target, frame = state  # frame: 1 behind a speaker, 2 behind a speaker and an object
        marks = []
        while not isinstance(s, int):
            marks.append(s[0])
            s = s[1]
        pattern = None
        if s == THREAT:
            pattern = THREATENED if "to" in marks or frame == 2 else None
        elif s in HITS:
            pattern = AIMED if "to" in marks or target else PILED if s == MORE else None
        if pattern is not None and len(marks) > marks.count("to"):
            pattern = REPORTED if "said" in marks else NEGATED
        after = AIM if s in (SUBJECT, OBJECT) else max(0, target - 1), max(frame, 1) if s == SPEAKER else 2 if s == OBJECT and frame else frame
        return after, pattern

    return Transducer.of((0, 0), step, inputs)


BACKWARD = coming()
_NEGATION = negation(BACKWARD.outputs())
_REPORTING = reporting(_NEGATION.outputs())
FORWARD = _NEGATION.then(_REPORTING).then(aiming(_REPORTING.outputs()))


@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = PRIOR_BIAS

    def machine(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for w in THREATS:
            found.add_word(w, (len(w), THREAT, LISTED, True))
        for w in INSULTS:
            found.add_word(w, (len(w), INSULT, LISTED, False))
        for w, weight in self.stems.items():
            found.add_word(w, (len(w), INSULT, weight, False))
        found.make_automaton()
        return found


class Scorer:
    def __init__(self, model: Model):
        self.model, self.machine = model, model.machine()

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, int, float, str]]:
        """(begin, end, pattern, weight, word) of the clauses' matched hits, offsets in the lower-cased text."""
        if not text:
            return
        low = text.lower()
        hits: dict[int, tuple[int, float]] = {}
        for end, (n, symbol, weight, whole) in self.machine.iter(low):
            at = end - n + 1
            if (at == 0 or not low[at - 1].isalnum()) and not (whole and end + 1 < len(low) and low[end + 1].isalnum()) and weight > hits.get(at, (0, 0.0))[1]:
                hits[at] = symbol, weight
        order, k, first, alone = sorted(hits), 0, None, None
        ends = [-1, *(m.start() for m in _CLAUSE_END.finditer(low)), len(low)] if order else []
        while k < len(order):
            after = bisect.bisect_left(ends, order[k])
            begin, end = ends[after - 1] + 1, ends[after]
            words, symbols = [], []
            for m in _WORD.finditer(low, begin, end):
                symbol, weight = hits.get(m.start()) or (_CLASS.get(m[0].replace("’", "'"), OTHER), 0.0)
                if symbol == INSULT:
                    first = first or m[0]
                    symbol = INSULT if m[0] == first else MORE
                words.append((m[0], weight))
                symbols.append(symbol)
            state = 0
            for at in range(len(symbols) - 1, -1, -1):
                state, symbols[at] = BACKWARD.arcs[state, symbols[at]]
            state = 0
            for symbol, (word, weight) in zip(symbols, words, strict=True):
                if symbol == THREAT and word in WITH_OBJECT:
                    symbol = "to", THREAT
                state, pattern = FORWARD.arcs[state, symbol]
                if pattern == PILED and alone:
                    yield alone
                    alone = None
                if pattern is not None:
                    yield begin, end, pattern, weight, word
                elif weight and symbol == INSULT and word == first:
                    alone = begin, end, PILED, weight, word
            while k < len(order) and order[k] < end:
                k += 1

    def features(self, text: str | None) -> np.ndarray:
        """Of each pattern, what the clauses give: their strongest hit whose word the pattern hasn't counted in the text."""
        out, best, seen = np.zeros(len(PATTERNS)), {}, set()
        for begin, _, pattern, weight, word in self.clauses(text):
            if (weight, word) > best.get((begin, pattern), (0.0, "")):
                best[begin, pattern] = weight, word
        # Clauses come in order: a word counts in the first clause of which it is the strongest.
        for (_, pattern), (weight, word) in best.items():
            if (pattern, word) not in seen:
                seen.add((pattern, word))
                out[pattern] += weight
        return out

    def score(self, text: str | None) -> float:
        z = self.model.bias + float(self.model.weights @ self.features(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _part(id_col: str = "id"):
    """Three quarters of the sample give stems, the rest pattern weights."""
    return F.pmod(F.xxhash64(id_col, F.lit("part")), F.lit(4)) > 0


def _stems(rows: DataFrame) -> dict[str, float]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            keys = list(counts)
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[k][y] for k in keys], pa.int64()) for y in (0, 1))], names=["stem", "clean", "toxic"])
            counts.clear()
            return made

        for batch in sliced(batches, 64):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(_WORDS.findall((text or "").lower()))
                for s in {w[:n] for w in words for n in STEM_CHARS if n <= len(w)}:
                    counts.setdefault(s, [0, 0])[1 if y else 0] += 1
            if len(counts) > COUNTED:
                yield out()
        yield out()

    n = {bool(r.y): r.n for r in rows.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    clean, toxic = n.get(False, 0), n.get(True, 0)
    if not clean or not toxic:
        return {}
    counts = rows.select("text", "y").mapInArrow(count, "stem string, clean bigint, toxic bigint").groupBy("stem").agg(F.sum("clean").alias("b"), F.sum("toxic").alias("a"))
    odds = ((F.col("a") + 0.5) / (toxic + 1)) / ((F.col("b") + 0.5) / (clean + 1))
    a, b, base = F.col("a"), F.col("b"), toxic / (toxic + clean)
    rest = F.when(b > 0, b * F.log(b / ((a + b) * (1 - base)))).otherwise(0.0)
    g2 = 2 * (F.when(a > 0, a * F.log(a / ((a + b) * base))).otherwise(0.0) + rest)
    good = counts.where(a >= MIN_DOCS).select("stem", F.log(odds).alias("w"), g2.alias("g2")).where((F.col("g2") >= MIN_G2) & (F.col("w") >= math.log(MIN_ODDS)))
    kept: dict[str, float] = {}
    for r in sorted(good.orderBy(F.desc("g2"), "stem").limit(MAX_STEMS).collect(), key=lambda r: (len(r.stem), r.stem)):
        if not any(kept.get(r.stem[:k], -1.0) >= r.w - 0.3 for k in range(STEM_CHARS[0], len(r.stem))):
            kept[r.stem] = r.w
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, bias: float, pull: float = 2.0) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method, held towards the prior."""
    x1, w, want = np.column_stack([x, np.ones(len(x))]), np.append(prior, bias), np.append(prior, bias)
    hold = np.append(np.full(len(prior), pull), 0.1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1.T * (p * (1 - p))) @ x1 + np.diag(hold), x1.T @ (y - p) - hold * (w - want))
        before = w.copy()
        w += np.clip(step, -1, 1)
        w[:-1] = np.maximum(w[:-1], 0.0)
        step = w - before
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: int = 5, held: int = 0, fit_docs: int = 16_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from about fit_docs labelled texts at most, none of them held out."""
    rows = written(sample(docs, labels, label, fold, held, fit_docs, id_col, text_col), "toxicity-sample")
    model = Model(_stems(rows.where(_part())))
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in sliced(batches):
            x = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist() for v in x], pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = rows.where(~_part()).select("text", "y").mapInArrow(features, "x array<double>, y int").toArrow()  # fit_docs rows at most
    if got.num_rows:
        x = np.array(got.column("x").to_pylist()).reshape(-1, len(PATTERNS))
        y = np.array(got.column("y").to_pylist(), dtype=float) > 0
        model.weights, model.bias = _logistic(x, y.astype(float), PRIOR, PRIOR_BIAS)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, clauses): of every text its score, and its matched clauses as (begin, end, pattern, weight)."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # MAX_STEMS stems at most
    told_as, listed_as = outputs(id_col, "score", "clauses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("weight", pa.float64())]))
        for batch in sliced(batches):
            scores, told = [], []
            for text in batch.column(1):
                text = text.as_py()
                scores.append(scorer.score(text))
                told.append([{"begin": a, "end": b, "pattern": PATTERNS[p], "weight": w} for a, b, p, w, _ in scorer.clauses(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(told, kind)], names=[id_col, told_as, listed_as])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {told_as} double, {listed_as} array<struct<begin:int,end:int,pattern:string,weight:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("clauses").alias("n_clauses"))
