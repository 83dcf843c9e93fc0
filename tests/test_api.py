import pytest

from quaymark import api

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return api.Engine(spark, DATA)


def test_every_metric_answers(engine):
    need = {"day": "1998-05-05", "start": "1997-01-01", "end": "1998-01-01", "compare_start": "1998-01-01", "compare_end": "1999-01-01", "year": 1998, "tickers": ["1-URGENT", "2-HIGH"]}
    for s in engine.schemas():
        given = {k: need[k] for k, v in s["arguments"].items() if v == "required"}
        if s["metric"] == "event_window":
            given["sessions"] = 3
        if s["dataset"] == "text" and s["metric"] != "coverage":
            given["terms"] = "the"
        found, ok = engine.execute("query_data", {"dataset": s["dataset"], "metric": s["metric"], **given})
        assert ok, (s, found)
        assert found["rows"], s


def test_checks(engine):
    with pytest.raises(api.MetricError, match="takes no year"):
        engine.query("rates", "extremes", year=2019)
    assert engine.query("News", "COVERAGE", chart="bar")["ignored"] == ["chart"]
    for bad in ({"dataset": "x", "metric": "y"}, {"dataset": "rates", "metric": "y"}, {"dataset": "prices", "metric": "annual_return"}, {"dataset": "prices", "metric": "annual_return", "year": 1998, "tickers": "ZZZ"}, {"dataset": "rates", "metric": "lookup_rate", "day": "never"}):
        found, ok = engine.execute("query_data", bad)
        assert not ok and "error" in found
    assert engine.execute("extremes", {})[1] and engine.execute("rates", {"metric": "count"})[1] and not engine.execute("coverage_of", {})[1]
    with pytest.raises(api.MetricError):
        engine.retrieve(chart=1, day="2016-01-01")


def test_schemas(engine):
    (one,) = [s for s in engine.schemas() if s["metric"] == "volatility"]
    assert one["types"] == {"tickers": "list of texts", "exclude": "list of texts", "year": "integer", "annualised": "boolean"} and one["arguments"]["year"] == "optional"


def test_loop(engine):
    calls = iter([[("extremes", {}), ("nonsense", {})], []])
    out = api.answer(engine, "?", lambda q, t: next(calls))
    assert out["steps"] == 2 and [t["ok"] for t in out["tool_trace"]] == [True, False] and "highest" in out["answer"]
    assert api.answer(engine, "?", lambda q, t: [("extremes", {})] * 3, steps=2)["steps"] == 2
    assert "no evidence" in api.answer(engine, "?", lambda q, t: [])["answer"]


def test_date_words_and_basket(engine):
    rows = lambda *a, **k: engine.query(*a, **k)["rows"]
    assert rows("rates", "count", start="1996", end="1996") == rows("rates", "count", start="1996-01-01", end="1996-12-31") != rows("rates", "count", start="1996-01-01", end="1996-01-01")
    assert rows("text", "count", terms="the", start="2016", end="Jun 2017") == rows("text", "count", terms="the", start="2016-01-01", end="2017-06-30")
    assert rows("rates", "lookup_rate", day="Jun 1997") == rows("rates", "lookup_rate", day="1997-06-30")
    every, basket = rows("prices", "full_sample_return", tickers="all"), rows("prices", "full_sample_return", tickers="basket")
    assert len(every) == len(basket) + 1 and {r["ticker"] for r in basket} == {r["ticker"] for r in rows("prices", "basket_tickers")} == {r["ticker"] for r in every} - {"5-LOW"}
    with pytest.raises(api.MetricError):
        engine.query("prices", "full_sample_return", tickers=["basket", "2-HIGH"])
    with pytest.raises(api.MetricError, match="is no date"):
        engine.query("rates", "count", start="soon")
    out = api.answer(engine, "?", lambda q, t: "" if t else "<function=extremes></function>")
    assert out["steps"] == 1 and out["tool_trace"][0]["ok"]


def test_command_line(capsys, monkeypatch):
    from quaymark import __main__ as cli

    assert cli.main([DATA, "query", "rates", "count", "start=1996", "end=1996"]) == 0 and '"records": 12' in capsys.readouterr().out
    assert cli.main([DATA, "retrieve", "terms=the", "limit=3"]) == 0 and capsys.readouterr().out.count("article_id") == 3
    assert cli.main([DATA, "query", "prices", "annual_return", "year=1998", "tickers=basket"]) == 0
    assert cli.main([DATA, "query", "rates", "count", "start=soon"]) == 2 and cli.main([]) == 2
