"""Table functions against the query surface: a call in SQL gives the rows that the metric of the same name gives."""

import datetime

import pytest
from pyspark.errors import AnalysisException

from quaymark import api
from quaymark.sources import metrics

DATA = "/root/testdata/sf0.001"
CALLS = [
    ("rates", "coverage", {}), ("rates", "count", {}), ("rates", "count", {"start": "1996", "end": "Jun 1997"}), ("rates", "count", {"start": "15 Jun 1996"}), ("rates", "count_changes", {"end": "1999-02"}), ("rates", "count_changes", {"start": "2030"}),
    ("rates", "changes_by_year", {"start": "1996-03"}), ("rates", "list_changes", {"start": "1997", "end": "1997"}), ("rates", "extremes", {}), ("rates", "max_hold_streak", {}), ("rates", "max_hold_streak", {"top": 3}), ("rates", "open_streak", {}),
    ("rates", "lookup_rate", {"day": "Jun 1997"}), ("rates", "lookup_rate", {"day": "1990"}), ("prices", "coverage", {}), ("prices", "annual_return", {"year": 1998}), ("prices", "annual_return", {"year": 1998, "tickers": ["1-URGENT", "5-LOW"], "exclude": ["5-LOW"]}),
    ("prices", "rank_annual_returns", {"year": 1998, "exclude": ["2-HIGH"]}), ("prices", "full_sample_return", {}), ("prices", "full_sample_return", {"exclude": ["1-URGENT"]}), ("prices", "avg_volume", {"start": "1996", "end": "1997-06"}), ("prices", "avg_volume", {"tickers": ["5-LOW"]}),
    ("prices", "max_drawdown", {}), ("prices", "max_drawdown", {"start": "1997", "top": 2}), ("prices", "volatility", {}), ("prices", "volatility", {"year": 1998, "annualised": False}), ("prices", "correlation", {"tickers": ["1-URGENT", "2-HIGH"]}), ("prices", "correlation", {"tickers": ["1-URGENT", "2-HIGH"], "end": "1995-03"}),
    ("prices", "price_on_date", {"day": "1998-05"}), ("prices", "price_on_date", {"day": "1990"}), ("prices", "window_return", {"start": "1997", "end": "Jun 1998", "exclude": ["5-LOW"]}), ("prices", "basket_tickers", {}), ("prices", "basket_tickers", {"exclude": ["5-LOW"]}),
    ("rates", "next_change", {"day": "Jun 1997"}), ("rates", "next_change", {"day": "2030"}), ("rates", "period_summary", {"start": "1997", "end": "Jun 1998"}), ("rates", "period_summary", {"start": "1997-01-05", "end": "1997-01-20"}), ("rates", "compare_periods", {"start": "1996", "end": "1997", "compare_start": "1998", "compare_end": "1999"}),
    ("prices", "close_on", {"day": "1998-05-05", "exclude": ["5-LOW"]}), ("prices", "event_window", {"day": "1998-05-05", "sessions": 3}), ("prices", "event_window", {"day": "1998-05-05", "days": 30, "tickers": ["2-HIGH"]}), ("prices", "event_window", {"day": "2001-07-30", "days": 30}), ("prices", "event_window", {"day": "1990", "sessions": 2}), ("prices", "event_window", {"day": "2001-07-30", "sessions": 300}),
    ("text", "coverage", {}), ("text", "count", {"terms": ["the", "c++"]}), ("text", "count", {"terms": ["he"], "whole_word": False, "year": 2016, "month": 3}), ("text", "count", {"pattern": r"\bTHE\b.*\bof\b", "start": "2016", "end": "2017"}), ("text", "count", {"terms": ["not there at all"]}), ("text", "count", {"terms": [" The ", "", "a|b", "of"]}),
    ("text", "share", {"terms": ["the"], "year": 2016}), ("text", "share", {"terms": ["the"], "year": 1900}), ("text", "count_by_year", {"pattern": "th?e"}), ("text", "count_by_month", {"terms": ["The"], "year": 2017}),
]


@pytest.fixture(scope="module")
def names(spark):
    return metrics.register(spark, DATA)


@pytest.fixture(scope="module")
def engine(spark):
    return api.Engine(spark, DATA)


def literal(v):
    if isinstance(v, list):
        return f"array({', '.join(map(literal, v))})"
    return str(v).lower() if isinstance(v, (bool, int)) else f"r'{v}'"


def rows(df, drop=()):
    order = sorted(c for c in df.columns if c not in drop)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return order, sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)


@pytest.mark.parametrize("dataset,metric,given", CALLS, ids=lambda x: str(x)[:40])
def test_same_as_surface(spark, names, engine, dataset, metric, given):
    asked = dict(given)
    if metric == "correlation":
        asked["one"], asked["other"] = asked.pop("tickers")
    got = spark.sql(f"SELECT * FROM {dataset}_{metric}({', '.join(f'`{k}` => {literal(v)}' for k, v in asked.items())})")
    assert rows(got) == rows(engine.frame(dataset, metric, **given)[0], drop=("key",))


def test_every_name_is_held_against_the_surface(names):
    assert set(names) == {f"{d}_{m}" for d, m, _ in CALLS}


def test_every_metric_of_the_surface_has_a_function(names, engine):
    assert set(names) == {f"{s['dataset']}_{s['metric']}" for s in engine.schemas()}


def test_what_cannot_be_asked(spark, names):
    for call in ("rates_extremes(year => 2019)", "prices_annual_return(chart => 'bar', year => 1998)", "prices_annual_return()", "rates_nothing()", "rates_count('1996', '1997', '1998')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {call}")
    for call, told in (("rates_count(start => 'soon')", "is no date"), ("rates_count('1998', '1997')", "after its end"), ("text_count()", "either a pattern or terms"), ("text_count(terms => array(' ', ''))", "no term is left"), ("text_count(pattern => 'a', terms => array('b'))", "either a pattern or terms"), ("prices_window_return('1998-01-01', '1998-01-01')", "begin before it ends"), ("prices_event_window('1998')", "either sessions or days"), ("prices_event_window('1998', 3, 3)", "either sessions or days")):
        with pytest.raises(Exception, match=told):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_nulls_and_unknown_tickers(spark, names):
    one = lambda call: [tuple(r) for r in spark.sql(f"SELECT * FROM {call}").collect()]
    assert one("rates_count(NULL, NULL)") == one("rates_count()")
    assert one("prices_annual_return(NULL)") == [] and one("prices_price_on_date(NULL)") == []
    assert one("prices_full_sample_return(tickers => array('nobody', NULL))") == []
    assert one("rates_lookup_rate(NULL)") == [(None, None, None)]


def test_lateral_and_pruned(spark, names):
    got = spark.sql("SELECT y, records FROM (SELECT explode(sequence(1995, 1997)) AS y), LATERAL rates_count(y, y) ORDER BY y").collect()
    assert [tuple(r) for r in got] == [(y, 12) for y in (1995, 1996, 1997)]
    plan = spark.sql("SELECT * FROM rates_count(start => '1996')")._jdf.queryExecution().executedPlan().toString()
    # The argument is in the scan's filter, the one that isn't given nowhere; no other column is read.
    assert "1996-01-01" in plan and "ReadSchema: struct<o_orderdate" in plan and "o_totalprice" not in plan and "Join" not in plan
    # Terms are a constant of the plan, compiled once.
    plan = spark.sql("SELECT * FROM text_count(terms => array('The', 'und'))")._jdf.queryExecution().executedPlan().toString()
    assert "transform" not in plan and "regexp_replace" not in plan and "(the|und)" in plan


def test_empty_tables_and_another_folder(spark, names, tmp_path):
    """Functions answer from the folder that was registered last; DataFrames that are made already stay."""
    before = spark.sql("SELECT * FROM rates_count()")
    for t in ("orders", "documents", "events"):
        spark.read.parquet(f"{DATA}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    try:
        metrics.register(spark, str(tmp_path))
        assert spark.sql("SELECT * FROM rates_count()").collect()[0][0] == 0 and before.collect()[0][0] == 80
        assert spark.sql("SELECT * FROM rates_count_changes()").collect()[0].net_points == 0
        assert spark.sql("SELECT * FROM text_count(terms => array('the'))").collect()[0] == (0, 0, None)
        assert spark.sql("SELECT * FROM prices_max_drawdown()").collect() == [] and spark.sql("SELECT * FROM rates_lookup_rate('1998')").collect()[0] == (datetime.date(1998, 12, 31), None, None)
    finally:
        metrics.register(spark, DATA)


def test_described(spark, names):
    told = "\n".join(r[0] for r in spark.sql("DESCRIBE FUNCTION EXTENDED text_count").collect())
    assert "Articles that match" in told and "whole_word" in told and "share_pct" in told
    listed = {r[0].split(".")[-1] for r in spark.sql("SHOW USER FUNCTIONS").collect()}
    assert set(names) <= listed
