import random

from quaymark.llm import linededup as L

DATA = "/root/testdata/sf0.001"


def brute(docs, min_words):
    """Longest earlier match of every line, then all matched runs of enough words."""
    rows = [d for d in docs if d[1] is not None]
    order = sorted({(d[0] is not None, d[0] or 0, d[1]) for d in rows})  # ids differ below, so hashes never decide
    seqs = {d: [x for x in d[2].split("\n") if x.split()] for d in order}
    gone = {d: set() for d in order}
    for n, d in enumerate(order):
        a = seqs[d]
        for m, e in enumerate(order[: n + 1]):
            b = seqs[e]
            for i in range(len(a)):
                for j in range(len(b)):
                    if (m, j) >= (n, i):
                        break
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    if sum(len(x.split()) for x in a[i : i + k]) >= min_words:
                        gone[d].update(range(i, i + k))
    out = []
    for d in docs:
        if d[1] is None:
            out.append((d[0], None))
            continue
        kept, seq, dead = [], -1, False
        for line in d[1].split("\n"):
            if line.split():
                seq += 1
                dead = seq in gone[d[0] is not None, d[0] or 0, d[1]]
            if not dead:
                kept.append(line)
        out.append((d[0], "\n".join(kept)))
    return sorted(out, key=str)


def test_query_against_sql(spark, same):
    same(L.query(spark, DATA), L.SQL)


def test_against_brute_force(spark):
    for seed in range(2):
        r = random.Random(seed)
        lines = ["a", "b b", "c c c", "d " * 7, "", "  ", "é é"]
        docs = [(k, "\n".join(r.choices(lines, k=r.randint(0, 25)))) for k in range(25)]
        docs += [(90, docs[3][1]), (91, docs[3][1] + "\nq"), (92, None), (93, ""), (None, docs[5][1]), (94, "z " * 400), (95, "y\n" + "z " * 400), (96, "a\n" * 300)]
        docs += [docs[4]]
        df = spark.createDataFrame([(*d, "keep") for d in docs], "doc_id bigint, text string, n_lines string")
        got = L.dedupe(df, min_words=8)
        assert got.columns == ["doc_id", "text", "n_lines", "n_lines_", "n_removed"]
        rows = got.collect()
        assert {x.n_lines for x in rows} == {"keep"}
        assert sorted([(x.doc_id, x.text) for x in rows], key=str) == brute(docs, 8)


def test_empty(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert L.dedupe(docs).collect()[0].text is None
    assert L.dedupe(docs.limit(0)).count() == 0


def test_runs_are_maximal(spark):
    body = [f"line {k} with some words" for k in range(12)]
    docs = [(1, "\n".join(["a b", *body, "z"])), (2, "\n".join(["c", "", *body[2:9], "d d"])), (3, "\n".join([*body[5:], *body[:3]])), (4, "\n".join(body[:2]))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = sorted((r.id, r.start, r.stop, r.first_id, r.first_seq) for r in L.repeated_runs(df, min_words=10).collect())
    assert got == [(2, 2, 9, 1, 3), (3, 0, 7, 1, 6), (3, 7, 10, 1, 1), (4, 0, 2, 1, 1)]


def test_one_line_everywhere(spark):
    docs = [(k, "\n".join(["the same line of seven words here"] * (k % 3 + 1) + [f"own {k}"])) for k in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in L.dedupe(df, min_words=14).collect()}
    assert got == dict(brute_fast(docs))


def brute_fast(docs):
    """Of these texts, runs of two lines and more are copies of the first such run, by order of ids."""
    seen = False
    for k, text in docs:
        lines = text.split("\n")
        if len(lines) < 3:
            yield k, text
        elif not seen:
            seen = True
            yield k, "\n".join(lines[:2] + lines[-1:]) if len(lines) > 3 else text
        else:
            yield k, lines[-1]
