import random
import re

from quaymark.llm import decontaminate as D

DATA = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in bench:
            v = words(t)
            k = min(13, len(v))
            for f in range(max(1, len(v) - 12) if v else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == v[f : f + k]:
                        hit.update(range(p, p + k))
                        names.add("null" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_query_against_sql(spark, same):
    same(D.query(spark, DATA), D.SQL)


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = ["a", "B", "c", "é", "dd", "7"]
    say = lambda n: " ".join(r.choices(vocab, k=n))
    bench = [(k, say(n)) for k, n in enumerate([13, 14, 30, 40, 12, 3, 1, 20])] + [(None, say(15)), (3, say(16)), (9, None), (10, "..."), (11, "zz zz zz"), (12, "a a a a a a a a a a a a a a a a a")]
    docs = [(k, say(60) + ", " + r.choice(bench)[1].__str__() + ". " + say(5)) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "--"), (None, bench[2][1].upper()), (103, "a " * 3000), (103, "a " * 3000), (104, " ".join(bench[3][1].split()[5:18])), (104, "other")]
    bench_df = spark.createDataFrame(bench, "item_id bigint, text string")
    docs_df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, n_hit string")
    got = sorted([(x.doc_id, x.n_words, x.n_hit, list(x["items"]), x.contaminated) for x in D.report(docs_df, bench_df).collect()], key=str)
    want = brute(docs, bench)
    assert got == want
    clean = D.keep_clean(docs_df, bench_df)
    assert clean.columns == docs_df.columns
    assert sorted([x.doc_id for x in clean.collect()], key=str) == sorted([w[0] for w in want if not w[4]], key=str)


def test_proximity_and_empty(spark):
    bench = spark.createDataFrame([(1, "one rare thing and another odd thing")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x one rare thing and then another odd thing"), (2, "one y"), (3, "one rare thing and another odd thing")], "doc_id bigint, text string")
    index, found = D.build(docs, bench)
    near = D.proximity(index, found).join(index, "row")
    exact = D.phrases(index, found).join(index, "row")
    assert {r.id for r in exact.collect()} == {3}
    assert 3 not in {r.id for r in near.collect()}
    assert D.report(docs.limit(0), bench).count() == 0
    assert D.report(docs, bench.limit(0)).where("n_hit = 0 and size(items) = 0").count() == 3


def test_long_items_and_chance_terms(spark, monkeypatch):
    r = random.Random(2)
    body = [f"w{r.randrange(4000)}" for _ in range(10_000)]
    bench = spark.createDataFrame([(1, " ".join(body)), (2, "to be")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, " ".join(body[5000:5013])), (2, " ".join(body[100:112])), (3, "x " * 50 + " ".join(body)), (4, "to be " * 5000)], "doc_id bigint, text string")
    for bits in (D.BITS, 1 << 10):  # in the small bitmap nearly every word passes
        monkeypatch.setattr(D, "BITS", bits)
        got = {x.doc_id: (x.n_hit, list(x["items"])) for x in D.report(docs, bench).collect()}
        assert got == {1: (13, ["1"]), 2: (0, []), 3: (10_000, ["1"]), 4: (10_000, ["2"])}


def test_clashing_names(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = spark.createDataFrame([(7, "one two three"), (8, "no")], "n_hit bigint, text string")
    got = D.report(docs, bench, id_col="n_hit")
    assert got.columns == ["n_hit", "n_words", "n_hit_", "items", "contaminated"]
    assert {r["n_hit"]: r["n_hit_"] for r in got.collect()} == {7: 3, 8: 0}
    assert D.keep_clean(docs, bench, id_col="n_hit").first()[0] == 8
