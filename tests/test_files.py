import json

import pytest
from pyspark.sql import functions as F

from quaymark.functions import calls, compact
from quaymark.sources import files as S


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_rates_csv(spark, tmp_path):
    path = put(tmp_path / "r.csv", "﻿Effective Date,Change % points,Cash rate target%\n3 Mar 2010,+0.25,4.00\n3 Feb 2010,0.00,3.75\n,,\n2010-04-07,-0.50,3.5\n")
    assert [(str(r.effective), r.target_bp, r.change_bp) for r in S.rates_csv(spark, path).collect()] == [("2010-02-03", 375, 0), ("2010-03-03", 400, 25), ("2010-04-07", 350, -50)]


def test_prices(spark, tmp_path):
    bar = {"ticker": "AAA.AX", "date": "2020-01-02", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5}
    put(tmp_path / "p/AAA-acme_corp.jsonl", json.dumps(bar) + "\n\n" + json.dumps(bar | {"date": "2020-01-03"}) + "\n")
    got = S.prices_jsonl(spark, str(tmp_path / "p")).collect()
    assert len(got) == 2 and {r.company for r in got} == {"acme corp"} and got[0].volume == 5.0
    put(tmp_path / "q/AAA-x.jsonl", json.dumps(bar | {"close": None}))
    with pytest.raises(Exception, match="incomplete price record"):
        S.prices_jsonl(spark, str(tmp_path / "q")).collect()


def test_articles_and_summary(spark, tmp_path):
    put(tmp_path / "a/N_1.jsonl", json.dumps({"HEADLINE": "Été", "TEXT": "B", "PUBLICATIONDATE": "20200102"}) + "\n\n" + json.dumps({"HEADLINE": None, "PUBLICATIONDATE": ""}) + "\n")
    put(tmp_path / "a/other.jsonl", json.dumps({"HEADLINE": "no"}))
    summary = put(tmp_path / "s.json", json.dumps({"perFile": [{"file": "x", "articles": 2}, {"file": "y", "articles": 1}]}, indent=1))
    got = S.articles_jsonl(spark, str(tmp_path / "a"), "N_*.jsonl").orderBy("headline").collect()
    assert [(r.headline, r.blob, r.publication and str(r.publication)) for r in got] == [("", "\n\n\n", None), ("Été", "été\n\n\nb", "2020-01-02")]
    loaded = spark.createDataFrame([("x",), ("x",), ("z",)], "file string")
    assert {r.file: (r.loaded, r.expected, r.agrees) for r in S.reconcile(loaded, S.corpus_summary(spark, summary), "file").collect()} == {"x": (2, 2, True), "y": (0, 1, False), "z": (1, 0, False)}


def test_sinks_cache_and_compact(spark, tmp_path):
    rows = spark.createDataFrame([("s", "é?", "a")], "system string, question string, answer string")
    S.write_flat(rows, str(tmp_path / "flat"))
    S.write_chat(rows, str(tmp_path / "chat"))
    assert spark.read.json(str(tmp_path / "flat")).first().asDict() == {"system": "s", "input": "é?", "output": "a"}
    assert [m.role for m in spark.read.json(str(tmp_path / "chat")).first().messages] == ["system", "user", "assistant"]
    wanted, cache = spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    got, fresh = S.computed(wanted, cache, "k", lambda d: d.withColumn("v", F.lit(7)))
    assert sorted((r.k, r.v) for r in got.collect()) == [("a", 1), ("a", 1), ("b", 7)] and fresh.count() == 1
    assert compact.payload({"unit": "x", "n": 2.50001, "rows": [{"a": 1, "b": None}, {"a": 1, "b": True}]}) == "n = 2.5\nrows: 2 rows; a = 1\nb\nnull\ntrue"
    long = compact.payload({"tickers": [f"T{k}" for k in range(1000)], "by": {str(k): k for k in range(1000)}})
    assert all(f'"T{k}"' in long and f'"{k}": {k}' in long for k in range(1000))
    assert compact.payload({}) == "" and compact.table("x", [{"a": 1.0}, {"b": "t"}]) == "x: 2 rows\na\tb\n1\tnull\nnull\tt"


def test_computed_once_lookup_and_report(spark, tmp_path):
    wanted, cache = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, v double")
    got, fresh = S.computed(wanted, cache, "k", lambda d: d.withColumn("v", F.rand()))
    assert {r.k: r.v for r in got.collect()} == {"a": 2.0, "b": fresh.first().v}
    found, missing = S.lookup(wanted, cache.withColumnRenamed("k", "name"), "k", "name")
    assert found.count() == 2 and [r.k for r in missing.collect()] == ["b"]
    S.write_report(spark.createDataFrame([("base", 0.5), ("tuned", None)], "arm string, score double"), str(tmp_path / "r"), "Arms")
    lines = [r.value for r in spark.read.text(str(tmp_path / "r/markdown")).collect()]
    assert lines == ["# Arms", "", "| arm | score |", "|---|---|", "| base | 0.5 |", "| tuned |  |"] and spark.read.json(str(tmp_path / "r/json")).count() == 2


def test_questions_and_evidence(spark, tmp_path):
    question = {"id": "q1", "difficulty": "easy", "dataset_scope": "rates", "grading": {"tolerance_note": "+/- 0.02", "components": [{"component_id": "a", "expected_fact": "f", "points": 2}, {"component_id": "b", "expected_fact": "g", "points": 1}]}}
    got = S.questions_jsonl(spark, put(tmp_path / "q.jsonl", json.dumps(question) + "\n")).collect()
    assert [(r.id, r.component_id, r.points, r.tolerance_note) for r in got] == [("q1", "a", 2.0, "+/- 0.02"), ("q1", "b", 1.0, "+/- 0.02")]
    put(tmp_path / "e/q1.clean.json", json.dumps({"qid": "q1", "prompt": "p", "tool_trace": [{"tool": "t", "args": {"year": "2019"}, "result": "r", "compact": "c", "ok": True}]}, indent=1))
    put(tmp_path / "e/q1.noisy.json", json.dumps({"qid": "q1", "prompt": "n"}))
    (row,) = S.frozen_evidence(spark, str(tmp_path / "e")).collect()
    assert (row.prompt, row.tool_trace[0].args) == ("p", {"year": "2019"})


def test_calls_in_text():
    call = "<function=count>\n<parameter=dataset>\nrates\n</parameter>\n<parameter=year>2018</parameter><parameter=exclude>[\"A\"]</parameter><parameter=flag>False</parameter><parameter=pattern>\\bword\\b</parameter>\n</function>"
    want = ("count", {"dataset": "rates", "year": 2018, "exclude": ["A"], "flag": False, "pattern": "\\bword\\b"})
    assert calls.found(call) == [want] == calls.found(f"so <tool_call>{call}</tool_call>")
    assert calls.found(f"<tool_call>{call}</tool_call> <tool_call>\n<function=coverage>\n</function></tool_call>") == [want, ("coverage", {})]
    assert calls.found('<tool_call>{"name": "r", "arguments": {"year": 2019}}</tool_call>') == [("r", {"year": 2019})] == calls.found('<tool_call>{"name": "r", "arguments": "{\\"year\\": 2019}"}')
    assert calls.found("<tool_call><function=x><parameter=a>\nb\n</parameter>") == [("x", {"a": "b"})]
    assert calls.found("All evidence is there.") == calls.found("") == calls.found(None) == calls.found("<tool_call>{broken</tool_call>") == []
    assert calls.evidence([]) == "No tool results were gathered."
    assert calls.evidence([{"tool": "t", "args": {"a": 1}, "compact": "x"}, {"tool": "u", "result": {"n": 2}}]) == '[1] t({"a": 1})\nx\n\n[2] u({})\nn = 2'
