import random
import re

from quaymark.llm import chosenpath as C

DATA = "/root/testdata/sf0.001"


def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    texts = {}
    for d, t in docs:
        texts.setdefault(t or "", []).append(d)
    keys = list(texts)
    sets = [grams(t) for t in keys]
    root, links = list(range(len(keys))), [0] * len(keys)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 5 * c >= 4 * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                root[top(a)] = top(b)
    least = {}
    for k, t in enumerate(keys):
        for d in texts[t]:
            if d is not None:
                least[top(k)] = min(least.get(top(k), d), d)
    return sorted([(d, least.get(top(keys.index(t or ""))), links[keys.index(t or "")]) for d, t in docs], key=str)


def test_query_against_sql(spark, same):
    same(C.query(spark, DATA), C.SQL)


def test_against_brute_force_with_forced_splits(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    docs, n = [], 0
    common = " ".join(r.choices(vocab, k=30))
    for _ in range(12):
        base = r.choices(vocab, k=120)
        for _ in range(r.choice([1, 2, 12])):
            w = list(base)
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            docs.append((n, common + " " + " ".join(w)))
            n += 1
    docs += [(500, None), (501, ""), (502, "--"), (503, "one two"), (504, "One, two!"), (None, docs[0][1]), (None, "alone and null but of six words"), (505, docs[3][1]), (505, docs[3][1]), (506, "x " * 5000), (507, "x " * 4000)]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id bigint, text string, class_id string")
    want = brute(docs)
    for small, block in ((64, 512), (3, 4)):
        got = sorted([(x.doc_id, x.class_id, x.n_links) for x in C.near_duplicates(df, small=small, block=block).collect()], key=str)
        assert got == want
    kept = C.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted([x.doc_id for x in kept.collect()], key=str)
    classes = {w[1] for w in want}
    assert sorted(set(ids), key=str) == sorted(classes, key=str)


def test_runs_and_empty(spark):
    assert C.runs_for(0.8, 0.99999) >= 7
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    assert C.near_duplicates(docs.limit(0)).count() == 0
    assert [tuple(x)[0] for x in C.keep_one(docs).collect()] == [1]


def test_keep_one_by_component(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    docs = [(None, a), (None, a + " end"), (None, b), (5, c), (9, c + " end"), (5, d), (7, d + " end"), (11, "alone"), (11, "alone"), (12, None), (12, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id bigint, text string, row int")
    kept = {r.row: r for r in C.keep_one(df).collect()}
    assert len(kept) == 6
    groups = [{0, 1}, {2}, {3}, {5}, {7, 8}, {9, 10}]
    assert all(len(g & set(kept)) == 1 for g in groups)
    assert all((r.doc_id, r.text) == docs[k] for k, r in kept.items())


def test_low_thresholds_and_names(spark):
    r = random.Random(9)
    docs = []
    for k in range(30):
        base = [f"v{k}_{j}" for j in range(60)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: r.choice([20, 30, 40, 50])] + [f"u{k}_{j}" for j in range(15)]))]
    for threshold in (0.5, 0.3):
        df = spark.createDataFrame(docs, "k1 bigint, text string")
        got = C.near_duplicates(df, id_col="k1", threshold=threshold)
        assert got.columns == ["k1", "k1_", "k2", "class_id", "n_links"]
        sets = [grams(t) for _, t in docs]
        want = {}
        for k, (d, _) in enumerate(docs):
            other = sets[k ^ 1]
            near = len(sets[k] & other) >= threshold * len(sets[k] | other)
            want[d] = (d & ~1 if near else d, int(near))
        assert {x["k1"]: (x.class_id, x.n_links) for x in got.collect()} == want
    kept = C.keep_one(spark.createDataFrame(docs[:2] + [(9, docs[0][1])], "class_id bigint, text string"), id_col="class_id", threshold=0.2)
    assert [x.class_id for x in kept.collect()] == [0]


def test_recall_is_measured(spark):
    """Near the threshold, over pairs made to lie between 0.8 and 0.85, with large buckets split."""
    r = random.Random(4)
    docs, common = [], [f"c{j}" for j in range(40)]
    for k in range(400):
        base = common + [f"b{k}x{j}" for j in range(60)]
        cut = r.choice([10, 9, 8])
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[:-cut] + [f"e{k}x{j}" for j in range(cut)]))]
    sets = [grams(t) for _, t in docs]
    pairs = {2 * k for k in range(400) if 5 * len(sets[2 * k] & sets[2 * k + 1]) >= 4 * len(sets[2 * k] | sets[2 * k + 1])}
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {x.doc_id: x.n_links for x in C.near_duplicates(df).collect()}
    assert len(pairs) > 200
    assert sum(got[d] > 0 for d in pairs) / len(pairs) >= 0.99
    assert not any(n for d, n in got.items() if d & ~1 not in pairs)


def test_agreeing():
    assert C.agreeing(0.8, 0.99999, 32) in range(10, 18) and C.agreeing(1.0, 0.99999, 32) == 32
