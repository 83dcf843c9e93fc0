import random
import re
from itertools import permutations

from quaymark.llm import interaction as I

DATA = "/root/testdata/sf0.001"


def test_query_against_sql(spark, same):
    same(I.query(spark, DATA), I.SQL)


def brute(docs, labels):
    """Every order applied to every document, one filter after the other."""
    first, marks = {}, {}
    for k, text, _ in docs:
        if k is not None:
            first[text or ""] = min(first.get(text or "", k), k)
    for k, good, toxic in [x for x in labels if x[0] is not None]:
        old = marks.get(k, (0, 0))
        marks[k] = (max(old[0], good or 0), max(old[1], toxic or 0))
    parts = {}
    for k, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": k is not None and k > first[text]}
        parts.setdefault(part or "", []).append(({x for x, bad in fails.items() if bad}, *marks.get(k, (0, 0))))
    out = []
    for part, rows in parts.items():
        removed_in_all = dict.fromkeys("ABCDE", 0)
        found = []
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[0]]
                left = [r for r in left if x not in r[0]]
                removed_in_all[x] += len(gone)
                failing = sum(x in r[0] for r in rows)
                found.append(((part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[0] == {x} for r in rows), sum(r[1] == 1 for r in gone), sum(r[2] == 1 for r in gone)), x))
        out += [(*row, removed_in_all[x]) for row, x in found]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(4)
    words = ["alpha", "Beta", "GAMMA", "é", "日本", "x#y", "10%", " ", "a b"]
    docs = [(k, r.choice(["", " ", "\n"]).join(r.choices(words, k=r.choice([0, 1, 5, 199, 200, 201]))), r.choice(["web", "web", "", None, "日"])) for k in range(60)]
    many = " \t".join(f"w{k}" for k in range(400))
    docs += [(100, many, "web"), (101, many, "web"), (101, many, "web"), (None, many, "web"), (99, many, None), (None, None, "q"), (70, None, "web"), (71, "", "web"), (102, "W " * 300_000, "web"), (103, many + " " + many, "q"), (104, (many + " ") * 2 + "once", "q")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 104, 2)] + [(100, 1, 0), (100, 0, 1), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, source string, part string, mask int")
    known = spark.createDataFrame([(*x, "y") for x in labels], "doc_id bigint, quality int, toxic int, n string")
    got = [tuple(x) for x in I.audit(I.mask_counts(df, known)).collect()]
    assert sorted(got) == brute(docs, labels)
    assert I.audit(I.mask_counts(df.limit(0), known)).count() == 0
    none = I.audit(I.mask_counts(df, known.limit(0))).agg({"good_lost": "max", "toxic_lost": "max"}).first()
    assert tuple(none) == (0, 0)


def test_polynomials():
    r = random.Random(1)
    counts = {m: r.randint(0, 9) for m in range(16)}
    f = I.removal_polynomial(counts, 4)
    for s in range(16):
        assert I.corner(f, s) == sum(n for m, n in counts.items() if m & s)
    values = [I.shapley(f, 1 << k) for k in range(4)]
    assert sum(values) == I.corner(f, 15)
    assert values == [sum((I.Fraction(n, m.bit_count()) for m, n in counts.items() if m >> k & 1), I.Fraction(0)) for k in range(4)]
    assert I.removal_polynomial({}, 2) == {1: 0, 2: 0, 3: 0}


def test_other_filters(spark):
    counts = spark.createDataFrame([("p", 0, 3, 1, 0), ("p", 1, 2, 0, 1), ("p", 3, 4, 2, 0)], "part string, mask int, n bigint, good bigint, toxic bigint")
    got = sorted(tuple(x) for x in I.audit(counts, "XY").collect())
    assert got == [("p", "XY", 1, 3, 6, 0, 2, 2, 1, 8), ("p", "XY", 2, 3, 0, 4, 0, 0, 0, 4), ("p", "YX", 1, 5, 4, 0, 0, 2, 0, 4), ("p", "YX", 2, 3, 2, 4, 2, 0, 1, 8)]
