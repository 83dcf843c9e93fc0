import itertools
import re
import zlib

import numpy as np
import pytest

from quaymark.llm import toxicity as T

DATA = "/root/testdata/sf0.01"


def named(symbols):
    """Patterns of a clause's symbols, straight from the rules."""
    out = []
    for k, s in enumerate(symbols):
        near = lambda kinds, a, b: any(x in kinds for x in symbols[max(0, a) : b])  # noqa: E731, B023
        pattern = None
        if s in (T.INSULT, T.MORE):
            if near((T.SUBJECT, T.OBJECT), k - T.AIM, k) or near((T.SUBJECT, T.OBJECT), k + 1, k + 1 + T.AIM):
                pattern = T.AIMED
            elif s == T.MORE:
                pattern = T.PILED
        elif s == T.THREAT:
            before = symbols[:k]
            spoken = T.SPEAKER in before and T.OBJECT in before[before.index(T.SPEAKER) :]
            if spoken or near((T.OBJECT,), k + 1, k + 1 + T.NEAR):
                pattern = T.THREATENED
        if pattern is not None and T.REPORT in symbols[:k]:
            pattern = T.REPORTED
        elif pattern is not None and near((T.NEGATION,), k - T.REACH, k):
            pattern = T.NEGATED
        out.append(pattern)
    return out


def through(symbols):
    state, marked = 0, list(symbols)
    for k in reversed(range(len(marked))):
        state, marked[k] = T.BACKWARD.arcs[state, marked[k]]
    state, out = 0, []
    for s in marked:
        state, pattern = T.FORWARD.arcs[state, s]
        out.append(pattern)
    return out


def test_machines_against_rules():
    for symbols in itertools.product(range(9), repeat=4):
        assert through(symbols) == named(symbols)
    r = np.random.default_rng(1)
    for _ in range(5000):
        symbols = r.choice([T.OTHER] * 6 + list(range(9)), size=int(r.integers(5, 25))).tolist()
        assert through(symbols) == named(symbols)


class Naive:
    """The scorer without automata or transducers: every word against every list, clause by clause."""

    def __init__(self, model):
        self.model = model
        self.lists = [(w, T.THREAT, T.LISTED) for w in T.THREATS] + [(w, T.INSULT, T.LISTED) for w in T.INSULTS] + [(w, T.INSULT, x) for w, x in model.stems.items()]
        self.starts = {}
        for w, symbol, x in self.lists:
            self.starts.setdefault(w[0], []).append((w, symbol, x))

    def hit(self, rest):
        best = (0.0, None)
        for w, symbol, x in self.starts.get(rest[:1], []):
            if rest.startswith(w) and not (symbol == T.THREAT and rest[len(w) : len(w) + 1].isalnum()) and x > best[0]:
                best = (x, symbol)
        return best

    def score(self, text):
        low, first, alone, found = (text or "").lower(), None, None, []
        for n, clause in enumerate(re.split(r"[.!?;\n|]", low)):
            words, symbols = [], []
            for m in T._WORD.finditer(clause):
                weight, symbol = self.hit(clause[m.start() :])
                if symbol is None:
                    symbol = T._CLASS.get(m[0].replace("’", "'"), T.OTHER)
                if symbol == T.INSULT:
                    first = first or m[0]
                    symbol = T.INSULT if m[0] == first else T.MORE
                words.append((m[0], weight))
                symbols.append(symbol)
            for s, (word, weight), pattern in zip(symbols, words, named(symbols), strict=True):
                if pattern == T.PILED and alone:
                    found.append(alone)
                    alone = None
                if pattern is not None:
                    found.append((n, pattern, weight, word))
                elif s == T.INSULT:
                    alone = (n, T.PILED, weight, word)
        x = np.zeros(len(T.PATTERNS))
        best = {}
        for n, pattern, weight, word in found:
            best[n, pattern] = max(best.get((n, pattern), (0.0, "")), (weight, word))
        counted = set()
        for (_, pattern), (weight, word) in best.items():
            if (pattern, word) not in counted:
                counted.add((pattern, word))
                x[pattern] += weight
        return 1 / (1 + np.exp(-np.clip(self.model.bias + self.model.weights @ x, -30, 30)))


def test_every_text_against_naive(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = T.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    naive = Naive(model)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert set(got) == set(texts)
    for k, text in texts.items():
        assert got[k] == pytest.approx(naive.score(text), abs=1e-12)


@pytest.mark.parametrize(
    ("text", "pattern", "toxic"),
    [
        ("I will kill you", "threat", True), ("We will murder them all", "threat", True), ("Ich werde dich töten", "threat", True), ("je vais te tuer", "threat", True), ("voy a matarte", "threat", True),
        ("Do you kill weeds?", None, False), ("you will kill time", None, False), ("stupid weather", None, False), ("stupid, stupid weather", None, False),
        ("idiot, you are wrong", "aimed", True), ("You are an idiot", "aimed", True), ("t’es abruti", "aimed", True), ("Tas de scum et d'idiots", "piled", True),
        ("you are not an idiot", "negated", False), ("he said you are an idiot", "reported", False), ("She said: you idiot", "reported", False), ("I will not kill you", "negated", False),
        (None, None, False), ("", None, False), ("... !", None, False),
    ],
)
def test_clauses(text, pattern, toxic):
    scorer = T.Scorer(T.Model())
    assert {T.PATTERNS[p] for _, _, p, _, _ in scorer.clauses(text)} == ({pattern} if pattern else set())
    assert (scorer.score(text) >= 0.5) == toxic


def test_long_and_repeated():
    scorer = T.Scorer(T.Model())
    assert 0 <= scorer.score("you idiot " * 200_000) <= 1
    assert scorer.score("you idiot. " * 50) == scorer.score("you idiot.")
    assert scorer.score("ok " * 300_000) == scorer.score(None)


def test_query(spark):
    rows = T.query(spark, DATA).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert sum(b for a, b in held if not a) <= 1


def test_stems_are_learned(spark):
    docs = spark.createDataFrame([(k, ("grumbolin" + "abcdefgh"[k % 8] + " and grumbolinz" if k % 4 == 0 else "plain") + " " + " ".join(f"w{(k * 7919 + j * j) % 997}" for j in range(30)), "z") for k in range(400)], "doc_id bigint, text string, y string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = T.fit(docs, labels)
    assert any("grumbolin".startswith(s) for s in model.stems)
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 4 == 0) for k in got)
    assert T.score(docs.limit(0), model).count() == 0
    assert T.fit(docs, labels.limit(0)).stems == {}


def test_nulls_repeats_and_names(spark):
    rows = [(1, None), (None, "You idiot"), (1, None), (2, ""), (None, "You idiot"), (3, "I will kill you")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "score bigint, text string, clauses string")
    out = T.score(docs, T.Model(), id_col="score")
    assert out.columns == ["score", "score_", "clauses"]
    assert sorted([(r["score"], r["score_"] > 0.5) for r in out.collect()], key=str) == sorted([(i, bool(t)) for i, t in rows], key=str)
