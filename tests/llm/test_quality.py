import zlib

import numpy as np

from quaymark.llm import quality as Q

DATA = "/root/testdata/sf0.01"


def test_features_against_brute_force():
    text = "Ab ab ab, x1!!\n" * 40 + " tail"
    words = text.split()
    got = Q.passages(text)
    assert got.shape == (-(-len(words) // Q.PASSAGE_WORDS), Q.FEATURES)
    for k in range(len(got)):
        mine = words[k * Q.PASSAGE_WORDS : (k + 1) * Q.PASSAGE_WORDS]
        assert np.isclose(got[k, -6], np.log1p(np.mean([len(w) for w in mine])))
        assert np.isclose(got[k, -2], len(set(mine)) / len(mine))
    for odd in (None, "", " \n ", "a", "　" * 5 + "é", "x" * 100_000):
        assert Q.passages(odd).shape == (1, Q.FEATURES)


def test_one_telling_passage_of_five_is_learned():
    r = np.random.default_rng(1)
    bags, y = [], []
    for k in range(900):
        bag = r.standard_normal((5, Q.FEATURES))
        if k % 2:
            bag[r.integers(5), :30] += 3
        bags.append(bag)
        y.append(float(k % 2))
    model = Q.train(bags[:700], np.array(y[:700]))
    out = model.forward(np.concatenate(bags[700:]).astype(np.float32), np.arange(0, 1000, 5))
    assert ((out["score"] > 0.5) == np.array(y[700:])).mean() > 0.9
    assert np.allclose(np.add.reduceat(out["a"], np.arange(0, 1000, 5)), 1)


def test_query(spark):
    rows = Q.query(spark, DATA).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert len(rows) == 1000
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "b"), (2, "x", "c"), (2, "x", "c")], "doc_id bigint, text string, score string")
    nothing = spark.createDataFrame([], "doc_id bigint, quality int")
    model = Q.fit(docs, nothing)
    assert [r.score for r in Q.score(docs, model).collect()] == [0.5] * 4
    assert Q.score(docs.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id bigint, quality int")
    assert Q.fit(docs, one).constant in (1.0, 0.5)


def naive_score(text, model):
    """Encoding, attention and score of a text in plain loops."""
    text = text or ""
    kinds = [Q._class_of(ord(c)) for c in text]
    words, at = [], 0
    while at < len(text):
        if kinds[at] > 1:
            begin = at
            while at < len(text) and kinds[at] > 1:
                at += 1
            words.append((begin, text[begin:at]))
        else:
            at += 1
    bag = []
    seen_all, before = set(), None
    for first in range(0, max(1, len(words)), Q.PASSAGE_WORDS):
        mine = words[first : first + Q.PASSAGE_WORDS]
        x = [0.0] * Q.FEATURES
        if mine:
            begin = mine[0][0] if first else 0
            end = words[first + Q.PASSAGE_WORDS][0] if first + Q.PASSAGE_WORDS < len(words) else len(text)
            for k in range(begin, end):
                x[kinds[k]] += 1
                if k and k > 0:
                    x[Q.CLASSES + kinds[k - 1] * Q.CLASSES + kinds[k]] += 1
            size = end - begin
            x = [(v / size) ** 0.5 for v in x]
            lengths = [len(w) for _, w in mine]
            mean = sum(lengths) / len(lengths)
            same = new = 0
            for _, w in mine:
                same += w == before
                new += w not in seen_all
                seen_all.add(w)
                before = w
            spread = max(0.0, sum(n * n for n in lengths) / len(lengths) - mean**2) ** 0.5
            x[-6:] = [np.log1p(mean), np.log1p(spread), same / len(mine), new / len(mine), len({w for _, w in mine}) / len(mine), np.log1p(size) / 10]
        bag.append(x)
    p = model.params
    hs, es = [], []
    for x in bag:
        x = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(x, model.mean, model.scale)]
        h = [max(0.0, sum(a * b for a, b in zip(x, p["W"][:, k])) + p["w0"][k]) for k in range(Q.HIDDEN)]
        t = [np.tanh(sum(a * b for a, b in zip(h, p["V"][:, k]))) for k in range(Q.GATE)]
        g = [1 / (1 + np.exp(-sum(a * b for a, b in zip(h, p["U"][:, k])))) for k in range(Q.GATE)]
        hs.append(h)
        es.append(sum(a * b * c for a, b, c in zip(t, g, p["a"])))
    top = [np.exp(e - max(es)) for e in es]
    z = [sum(w / sum(top) * h[k] for w, h in zip(top, hs)) for k in range(Q.HIDDEN)]
    return 1 / (1 + np.exp(-(sum(a * b for a, b in zip(z, p["c"])) + p["b"][0])))


def test_scores_against_naive(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = Q.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    some = docs.where("length(text) < 6000").limit(60)
    texts = {r.doc_id: r.text for r in some.collect()} | {-1: None, -2: " \n ", -3: "a", -4: "word " * 64, -5: "Word! " * 65 + "\n\n"}
    df = spark.createDataFrame(list(texts.items()), "score bigint, text string")
    got = Q.score(df, model, id_col="score")
    assert got.columns == ["score", "score_", "attention"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r["score_"] - naive_score(texts[r["score"]], model)) < 1e-4, texts[r["score"]]


def test_fit_bounds_passages(spark):
    assert len(Q._spread(np.zeros((1000, 3)), 64)) == 64 and len(Q._spread(np.zeros((5, 3)), 64)) == 5
    docs = spark.createDataFrame([(k, ("good text here. " if k % 2 else "!!! $$$ ") * 2000) for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id bigint, quality int")
    model = Q.fit(docs.withColumn("text", Q.F.concat("text", Q.F.col("doc_id").cast("string"))), labels, fit_passages=3)
    assert model.constant is None
