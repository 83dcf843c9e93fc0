import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quaymark.llm import merkle as M

DATA = "/root/testdata/sf0.001"


def test_query_against_sql(spark, same):
    same(M.query(spark, DATA), M.SQL)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(digests, fanout=3):
    """Root, and for each leaf its siblings on either side, level by level."""
    sides, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for k, a in enumerate(at):
            start = a - a % fanout
            sides[k].append((digests[start:a], digests[a + 1 : start + fanout]))
            at[k] = a // fanout
        digests = [h(*digests[k : k + fanout]) for k in range(0, len(digests), fanout)]
    return digests[0], sides


def folded(digest, sides):
    for before, after in sides:
        digest = h(*before, digest, *after)
    return digest


def brute(docs):
    """One list a source in memory."""
    parts = {}
    for d in docs:
        parts.setdefault(d[1], []).append(d)
    names = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        parts[name].sort(key=lambda d: (d[0] is not None, d[0] or 0, bytes.fromhex(leaf(d))))
        trees[name] = climb([leaf(d) for d in parts[name]])
    root, above = climb([trees[n][0] for n in names])
    out = []
    for name, up in zip(names, above, strict=True):
        subroot, sides = trees[name]
        for d, own in zip(parts[name], sides, strict=True):
            text = d[4]
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            end = folded(leaf((*d[:4], text)), own + up)
            out.append((d[0], leaf(d), subroot, root, h(*["".join(b + a) for b, a in own + up]), end, end == root))
    return sorted(out, key=str)


def table(n, sources, seed):
    r = random.Random(seed)
    docs = [(k * 7, r.choice(sources), r.choice(["en", None, ""]), r.choice([None, 0, 12]), r.choice([None, "", "a\nb", "ünï\n日本", "plain", "1:-" * 9])) for k in range(n)]
    r.shuffle(docs)
    return docs


KIND = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def both(spark, docs, levels):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], KIND + ", leaf string, pos int")
    proved = M.manifest(M.document_leaves(df), levels=levels)
    end = M.fold(F.coalesce(F.lower(F.hex("other")), F.col("leaf")), F.col("path"))
    got = proved.select("id", "leaf", "subroot", "root", F.sha2(F.translate("path", "./", ""), 256), end, end == F.col("root"))
    return sorted([tuple(x) for x in got.collect()], key=str)


def test_against_brute_force(spark):
    for n, levels in ((1, 6), (3, 1), (60, 1), (243, 2), (244, 2)):
        docs = table(n, ["web"] * 6 + ["", None, "日", "b|c"], n)
        assert both(spark, docs, levels) == brute(docs), (n, levels)


def test_odd_rows(spark):
    docs = table(20, ["web", None], 1)
    docs += [docs[0], docs[0], (None, "web", None, None, None), (None, "web", None, None, "x\ny"), (5, "web", "en", 1, "z\n" * 300_000), (6, "only", "en", 1, "one"), (0, "web", "en", 2, "tie"), (0, "web", "en", 3, "tie")]
    docs += [(9000 + k, f"s{k}", None, None, "t\n") for k in range(11)]  # more parts than a superblock of one level
    assert both(spark, docs, 1) == brute(docs)
    assert both(spark, [], 2) == []


def test_blocks():
    digests = [h(str(k)) for k in range(9)]
    whole = M.collapse(digests, True, 3, 2)
    assert [len(x) for x in whole] == [9, 3, 1] and whole == M.collapse(digests, False, 3, 2)
    alone = M.collapse(digests[:1], False, 3, 2)
    assert alone == [[digests[0]], [h(digests[0])], [h(h(digests[0]))]]
    assert M.lower_paths(alone, 3, "") == ["./."] and M.lower_paths([digests[:1]], 3, "up") == ["up"]


def test_a_changed_path_is_found(spark):
    docs = spark.createDataFrame(table(40, ["web", "b"], 3), KIND)
    proved = M.manifest(M.document_leaves(docs), levels=2)
    ends = proved.select(M.fold(F.col("leaf"), F.col("path")).alias("a"), M.fold(F.lit(h("other")), F.col("path")).alias("b"), "root").collect()
    assert all(r.a == r.root and r.b != r.root for r in ends)
