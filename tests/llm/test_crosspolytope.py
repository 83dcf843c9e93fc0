import numpy as np
from pyspark.sql import functions as F

from quaymark.llm import crosspolytope as C

DATA = "/root/testdata/sf0.01"
KIND = "vec_id bigint, embedding array<double>, score string"


def brute(rows, k):
    """query -> [(score, id)] nearest first, all rows against all."""
    fine = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v, dtype=float))]
    size = max((len(v) for _, v in fine), default=1)
    pad = lambda v: np.concatenate([v, np.zeros(size - len(v))])
    unit = lambda v: (s := pad(v) / np.abs(v).max()) / np.linalg.norm(s)
    ids = [i for i, _ in fine]
    m = np.array([unit(v) for _, v in fine]) if fine else np.zeros((0, size))
    out = {}
    for n, (i, _) in enumerate(fine):
        if i % 50 == 0:
            near = sorted({(-round(float(s), 12), j) for s, j in zip(m @ m[n], ids, strict=True) if j != i})
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def found(spark, rows, k=5, **more):
    df = spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], "x") for i, v in rows], KIND)
    got = {}
    for r in C.nearest(df, F.col("vec_id") % 50 == 0, k=k, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 12)))
        assert r.rank == len(got[r.query_id])
    return got


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = brute(rows, 5)
    df = C.query(spark, DATA)
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    got = {}
    for r in df.collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert sum(len({i for i, _ in want[q]} & set(got[q])) for q in want) >= 0.9 * 5 * len(want)


def test_clustered_vectors_recall_and_scores(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 24))
    rows = [(k, (centres[k % 20] + 0.3 * r.normal(size=24)).tolist()) for k in range(3000)]
    want, got = brute(rows, 5), found(spark, rows)
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.9 * 5 * len(want)
    exact = dict(((q, i), s) for q, near in brute(rows, 3000).items() for i, s in near)
    assert all(abs(exact[q, i] - s) < 1e-9 for q, near in got.items() for i, s in near)


def test_all_probes_equal_brute_force(spark, monkeypatch):
    """Exact at a recall of 1, with blocks so small that most buckets are split, and copies."""
    monkeypatch.setattr(C, "fit_probes", lambda distinct, hashes, *a: (2 * hashes.size) ** hashes.depth)
    r = np.random.default_rng(5)
    rows = [(k, r.normal(size=6).round(1).tolist()) for k in range(400)]
    rows += [(1000 + k, [1.0, 2, 3, 4, 5, 6]) for k in range(120)] + [(2000, [2.0, 4, 6, 8, 10, 12]), (2001, [-0.0, 0, 1, 0, 0, 0]), (2002, [0.0, 0, 1, 0, 0, 0])]
    assert found(spark, rows, tables=1) == brute(rows, 5)


def test_odd_rows(spark):
    assert found(spark, []) == {}
    assert found(spark, [(50, [1.0, 0])]) == {}
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0]), (1, [1.0, 0.9]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 1.0]), (8, [1.0]), (50, [1e300, 1e300]), (9, [2.0**-900, 0.0]), (0, [1.0, 1.0]), (100, [0.0, 0.0])]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, [(1, [1.0, 0]), (2, [1.0, 1.0])]) == {}


def test_a_third_are_copies_and_near_copies(spark):
    r = np.random.default_rng(7)
    base = r.normal(size=16)
    rows = [(k, base.tolist()) for k in range(700)] + [(1000 + k, (base + 1e-3 * r.normal(size=16)).tolist()) for k in range(700)] + [(3000 + k, r.normal(size=16).tolist()) for k in range(700)]
    got, want = found(spark, rows), brute(rows, 5)
    assert all(got[q] == want[q] for q in want if q < 700)
    assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.9 * 5 * len(want)
    assert all(len(v) == 5 for v in got.values())


def test_large_buckets_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)
    monkeypatch.setattr(C, "QUERY_BLOCK", 4)
    r = np.random.default_rng(8)
    base = r.normal(size=8)
    rows = [(k, (base + 0.01 * r.normal(size=8)).tolist()) for k in range(1500)]
    for shipped in (100_000, 0):  # buckets broadcast, then shuffled
        monkeypatch.setattr(C, "SHIPPED_BUCKETS", shipped)
        got, want = found(spark, rows), brute(rows, 5)
        assert sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_probes_are_the_best_buckets():
    h = C.Hashes(8, 2, tables=2)
    x = np.random.default_rng(1).normal(size=(5, 8))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for count in (1, 7, 40, 256):
        got = h.probes(x, count)
        for table in range(2):
            a, b = h.axes(unit, table, 0), h.axes(unit, table, 1)
            total = (a[:, :, None] + b[:, None, :]).reshape(5, -1)
            for n in range(5):
                assert len(set(got[n, table].tolist())) == count
                np.testing.assert_allclose(total[n][got[n, table]], np.sort(total[n])[::-1][:count])
    assert (h.probes(x, 1)[:, :, 0] == h.codes(x)).all()
    eye = np.eye(8)
    np.testing.assert_allclose(C.hadamard(eye) @ C.hadamard(eye).T, np.eye(8), atol=1e-12)
