import itertools

import pytest
from pyspark.sql import functions as F

from quaymark.functions import calls, subsets
from quaymark.sources import evidence
from quaymark.sources.cache import Cache


def test_subsets_by_number(spark):
    items = list("abcdef")
    every = [list(c) for k in range(2, 5) for c in itertools.combinations(items, k)]
    df = spark.range(len(every))
    column = F.array(*map(F.lit, items))
    got = [r.s for r in df.select("id", subsets.subset_at(column, 2, 4, F.col("id")).alias("s")).orderBy("id").collect()]
    assert got == every
    assert df.select(subsets.subset_count(column, 2, 4)).first()[0] == len(every)


def test_drawn_subsets_of_many_items(spark):
    items = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: x.cast("string"))
    for r in spark.range(5).select(subsets.drawn(items, 1, 20, F.col("id") * 977, 50).alias("s")).collect():
        sets = {tuple(x) for x in r.s}
        assert len(sets) == 50 and all(1 <= len(x) <= 20 and len(set(x)) == len(x) and list(x) == sorted(x, key=int) for x in sets)
    few = spark.range(1).select(subsets.drawn(F.array(F.lit("a"), F.lit("b")), 1, 4, F.lit(5), 50).alias("s"), subsets.drawn(F.array().cast("array<string>"), 1, 4, F.lit(5), 50).alias("none")).first()
    assert sorted(few.s) == [["a"], ["a", "b"], ["b"]] and few.none == []
    with pytest.raises(Exception, match="too many items"):
        spark.range(1).select(subsets.subset_count(F.sequence(F.lit(1), F.lit(61)), 1, 2)).collect()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cache_computes_once(spark, tmp_path):
    cache = Cache(spark, f"file://{tmp_path}/c", "id bigint, text string", "id", buckets=3)
    asked = []

    def compute(keys):
        asked.append(sorted(r.id for r in keys.collect()))
        return keys.select("id", F.concat(F.lit("v"), "id").alias("text"))

    keys = lambda *x: spark.createDataFrame([(k,) for k in x], "id bigint")
    assert cache.get(keys(1)).count() == 0 and cache.version() == (0, [])
    assert rows(cache.get_or_compute(keys(1, 2, 2, None), compute)) == [(1, 1, "v1"), (2, 1, "v2")]
    assert rows(cache.get_or_compute(keys(2, 3), compute)) == [(2, 1, "v2"), (3, 2, "v3")]
    again = Cache(spark, f"file://{tmp_path}/c", "id bigint, text string", "id", buckets=3)
    assert rows(again.get_or_compute(keys(1, 2, 3), compute)) == [(1, 1, "v1"), (2, 1, "v2"), (3, 2, "v3")]
    assert asked == [[1, 2], [3]]
    assert again.compact() and again.version()[0] == 3 and len(again.version()[1]) == 1 and not again.compact()
    assert rows(cache.get(keys(3, 9))) == [(3, 2, "v3")]
    assert cache.get_or_compute(keys(1).limit(0), compute).count() == 0


def test_one_writer_wins(spark, tmp_path, monkeypatch):
    folder, keys = f"file://{tmp_path}/c", spark.createDataFrame([(1,), (2,)], "id bigint")
    one, other = (Cache(spark, folder, "id bigint, text string", "id") for _ in range(2))

    def slow(lacking):
        other.get_or_compute(keys.where("id = 1"), lambda k: k.select("id", F.lit("other").alias("text")))
        return lacking.select("id", F.lit("one").alias("text"))

    assert rows(one.get_or_compute(keys, slow))[1][2] == "one"
    assert one.version()[0] == 2 and len(one.version()[1]) == 2
    assert one.get(keys).count() == 2


def test_many_keys_are_joined(spark, tmp_path):
    cache, keys = Cache(spark, f"file://{tmp_path}/c", "id bigint, text string", "id"), spark.range(3000)
    cache.get_or_compute(keys, lambda k: k.select("id", F.lit("x").alias("text")))
    assert cache.get(keys).count() == 3000 and cache.get(keys.limit(10)).count() == 10


def test_evidence_folders(spark, tmp_path):
    for name, text in {"a/one.jsonl": '{"x": 1}\n\n[1]\r\n{"x": ', "b/two.jsonl": '﻿{"x": "é"}\n' * 3, "b/not.txt": "{}", "three.jsonl": "", "b/_hidden.jsonl": "{}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    evidence.register(spark)
    read = spark.read.format("evidence").option("path", f"file://{tmp_path}")
    got = sorted((r.file, r.line, r.record, r.error is not None) for r in read.load().collect())
    assert got == [("a/one.jsonl", 1, '{"x": 1}', False), ("a/one.jsonl", 3, None, True), ("a/one.jsonl", 4, None, True), *[("b/two.jsonl", k, '{"x": "é"}', False) for k in (1, 2, 3)]]
    assert read.load().rdd.getNumPartitions() == 3 and read.option("files", 1).load().count() == 3
    read = spark.read.format("evidence").option("path", f"file://{tmp_path}").option("include", "*.*")
    assert read.load().where("folder = 'b'").select("file").distinct().count() == 2
    assert read.load().where("file in ('three.jsonl', 'b/not.txt')").rdd.getNumPartitions() == 2


def test_call_arguments_that_cannot_be_read():
    wrapped = lambda x: f"<tool_call>{x}</tool_call>"
    assert calls.found(wrapped('{"name": "x", "arguments": "not json"}')) == [("x", {})] == calls.found(wrapped('{"name": "x", "arguments": [1, 2]}'))
    assert calls.found('{"name": "x", "arguments": {"a": 1}}') == []
    assert calls.found(wrapped('{"name": "x", "arguments": "oops"}') + wrapped('{"name": "y", "arguments": {"a": 1}}')) == [("x", {}), ("y", {"a": 1})]
    assert calls.found(wrapped('{"arguments": {}}')) == [] == calls.found(wrapped("[1]"))
