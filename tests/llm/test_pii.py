import collections
import hashlib
import math
import re

import regex

from quaymark.llm import pii as P

DATA = "/root/testdata/sf0.001"
RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def brute(docs):
    base, raw = {}, {}
    for n, (_, t) in enumerate(docs):
        raw[n] = {k: [m for m in re.finditer(p, t or "")] for k, p in RAW.items()}
        base[n] = [(k, m.start(), m.end(), m[0]) for k in RAW for m in raw[n][k] if valid(k, m[0])]
    around, counts, total, entities = [], collections.Counter(), 0, collections.Counter()
    for n, (_, t) in enumerate(docs):
        words = [w.lower() for w in regex.findall(r"[\p{L}\p{N}]+", t or "")]
        counts.update(words)
        total += len(words)
        for k, a, b, v in base[n]:
            e = (k, v.lower())
            entities[e] += 1
            low = max([m.end() for m in raw[n][k] if m.end() <= a], default=0)
            high = min([m.start() for m in raw[n][k] if m.start() >= b], default=len(t))
            before, after = t[max(low, a - P.WINDOW_CHARS) : a], t[b : min(high, b + P.WINDOW_CHARS)]
            left = [(m[0].lower(), a - len(before) + m.start(), a - len(before) + m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", before)]
            right = [(m[0].lower(), b + m.start(), b + m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", after)]
            left = left[1:] if a - low > P.WINDOW_CHARS else left
            right = right[:-1] if high - b > P.WINDOW_CHARS else right
            for w, x, y in left[-P.WINDOW_TERMS :] + right[: P.WINDOW_TERMS]:
                if not any(s < y and x < z for _, s, z, _ in base[n]):
                    around.append((n, e, (before, after), w, x, y))
    beside, different = collections.Counter(), collections.defaultdict(set)
    for _, e, c, w, _, _ in around:
        beside[e, w] += 1
        different[e, w].add(c)
    out = []
    for n, (d, _) in enumerate(docs):
        terms = set()
        for m, e, _, w, x, y in around:
            if m == n and len(different[e, w]) >= P.MIN_CONTEXTS:
                p = min(0.5, entities[e] * 2 * P.WINDOW_TERMS / total)
                if 1 + math.log(min(1, beside[e, w] / counts[w])) / -math.log(p) >= P.GENERALISE:
                    terms.add((x, y))
        own = [f"{k}:{a}:{b}" for k, a, b, _ in base[n]]
        c = collections.Counter(k for k, *_ in base[n])
        out.append((d, *(c[k] for k in RAW), hashlib.sha256(",".join(own).encode()).hexdigest(), ",".join(own + [f"term:{x}:{y}" for x, y in sorted(terms)])))
    return sorted(out, key=str)


ODD = [
    "a@b.c_d@e.f x@y z@q..r 1.2.3.4.5.6.7.8 300.1.1.1 001.02.0003.255 999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112 +49 (0)30 1234-567 +1 2 3 +123456789012345678",
    "é" * 30 + " ünï@exämple.com me@host.example.org 10.0.0.1" + "9" * 6000 + " a" * 5,
    "x" * 30000 + "@" + "a." * 12000 + "b", "1." * 20000, "+1" + "(" * 20000, "a" * 60000,
    "", None, "@ . +", "😀 joe@x.example.com 😀",
    *[f"Write to Zebulon Quux at zeb@corp.example.com about case {i} or the weather in town {i * 7}, please." for i in range(5)],
    *["Write to Only Once at only@corp.example.com now."] * 4,
    *[f"the weather in town {i} is about the same, please write" for i in range(60)],
]


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted([tuple(r) for r in P.query(spark, DATA).collect()], key=str) == brute(docs)


def test_odd_cases(spark, tmp_path):
    docs = [(n, t) for n, t in enumerate(ODD)] + [(3, ODD[3]), (None, ODD[0])]
    spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id bigint, text string, found string, kind int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in P.query(spark, str(tmp_path)).collect()], key=str)
    assert got == brute(docs)
    assert any("term:" in r[-1] for r in got)
    clean = P.sanitise(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert clean.columns == ["doc_id", "text", "found", "kind"]
    texts = [r.text for r in clean.collect()]
    assert len(texts) == len(docs) and not any("zeb" in (t or "") or "Zebulon" in (t or "") for t in texts)
    assert any(t and t.startswith("Write to Only Once at [EMAIL] now") for t in texts) and None in texts and "" in texts


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.query(spark, str(tmp_path)).count() == 0


def test_many_addresses_in_one_text(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, " ".join(f"user 10.{k % 250}.{k // 250 % 250}.{k % 7} said" for k in range(n)))], "doc_id bigint, text string")
    assert P.report(docs).first().n_ip == n


def test_terms_joined_by_shuffle(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(P.report(docs).collect(), key=str)
    monkeypatch.setattr(P, "MAX_SHIPPED_TERMS", -1)
    assert sorted(P.report(docs).collect(), key=str) == want
