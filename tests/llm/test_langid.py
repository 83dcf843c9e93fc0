import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaymark.llm import langid

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.query(spark, DATA)
    assert got.count() == docs.count()
    right = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right[0] > 0.97 and right[1] > 100
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_cosine_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs, features=500, clusters=2)
    text = docs.where("doc_id = 3").first().text
    counts = {}
    for b in langid.gram_buckets(text):
        k = int(model.place[b])
        counts[k] = counts.get(k, 0) + 1
    v = np.zeros(500)
    for k, n in counts.items():
        if k < 500:
            v[k] = np.log1p(n) * model.idf[k]
    norm = np.sqrt((v**2).sum() + (np.log1p(counts.get(500, 0)) * model.idf_unknown) ** 2)
    best = max(float(v @ c) / norm for c in model.centroids)
    assert abs(model.nearest([text])[1][0] - best) < 1e-4


def test_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    rows = [(1, None, 1), (2, "", 1), (3, "123 !!", 1), (4, "Привет мир, как дела сегодня " * 20, 1), (5, docs.first().text * 30, 1), (5, docs.first().text * 30, 1), (None, docs.first().text, 1)]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = langid.predict(odd, model)
    assert got.columns == ["doc_id", "text", "score", "lang_pred", "score_", "rejected"]
    found = got.collect()
    assert [r.lang_pred for r in found if r.doc_id in (1, 2, 3)] == ["und"] * 3
    assert {r.doc_id: r.rejected for r in found} == {1: True, 2: True, 3: True, 4: True, 5: False, None: False}
    assert langid.keep_known(odd, model).count() == 3
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_rare_language_of_another_script(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    words = "собака река дерево молоко быстро зима город вечер письмо солнце дорога человек говорить белый чёрный окно хлеб".split()
    n = 40
    rare = spark.createDataFrame([(10**6 + k, " ".join(words[(k * 7 + j * (k % 5 + 1)) % len(words)] for j in range(60)), "ru") for k in range(n)], docs.schema)
    # 0.5 % of 8,000 texts.
    common = docs.crossJoin(spark.range(8).withColumnRenamed("id", "times")).select((F.col("doc_id") * 8 + F.col("times")).alias("doc_id"), "text", "lang")
    model = langid.fit(common.union(rare))
    got = langid.predict(rare, model).collect()
    assert len(got) == n and all(r.lang_pred == "ru" and r.score > 0.3 and not r.rejected for r in got)
    assert model.nearest(["日本語"])[0] == ["und"]


def test_every_text_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs)
    rows = docs.collect()
    learnable = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    df = collections.Counter(b for r in learnable for b in set(langid.gram_buckets(r.text).tolist()))
    assert {b for b in range(1 << langid.BITS) if model.place[b] < len(model.idf)} == set(df)
    idf = {b: float(np.log((1 + len(learnable)) / (1 + n)) + 0.1) for b, n in df.items()}
    assert all(abs(model.idf[model.place[b]] - x) < 1e-5 for b, x in idf.items())
    centroids = model.centroids
    got = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text"), model).collect()}
    for r in rows:
        counts = collections.Counter(langid.gram_buckets(r.text).tolist())
        if not counts:
            assert got[r.doc_id].lang_pred == "und"
            continue
        known = {b: np.log1p(n) * idf[b] for b, n in counts.items() if b in idf}
        rest = np.log1p(sum(n for b, n in counts.items() if b not in idf)) * model.idf_unknown
        norm = np.sqrt(sum(x * x for x in known.values()) + rest**2)
        cosines = [sum(x * c[model.place[b]] for b, x in known.items()) / norm for c in centroids]
        assert abs(got[r.doc_id].score - max(cosines)) < 1e-4
        near = [model.langs[model.of[k]] for k, c in enumerate(cosines) if c > max(cosines) - 1e-4]
        assert got[r.doc_id].lang_pred in near


def test_values_that_are_no_languages(spark):
    docs = spark.range(langid.MAX_LANGS + 8).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="can't be a language"):
        langid.fit(docs, fold=1, held=1)
