"""The query surface: named metrics of three datasets, checked arguments, small results."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quaymark.functions import calls as tool_calls
from quaymark.functions import compact, dates
from quaymark.operators import prices as P
from quaymark.operators import rates as R
from quaymark.operators import text as T
from quaymark.sources import views as V


class MetricError(ValueError):
    """A question that can't be answered as it was put."""


#: Other names of datasets, and of metrics.
DATASETS = {"rates": "rates", "rate": "rates", "decisions": "rates", "prices": "prices", "price": "prices", "bars": "prices", "text": "text", "articles": "text", "news": "text"}
METRIC_ALIASES = {("rates", "list"): "list_changes", ("prices", "dimensions"): "coverage", ("prices", "rank_avg_volume"): "avg_volume"}
#: Arguments that narrow what a metric is about: one that it doesn't take is an error. Any other is ignored and told.
SCOPE = frozenset({"start", "end", "year", "month", "tickers", "exclude", "pattern", "terms", "whole_word", "day", "sessions", "days", "compare_start", "compare_end", "one", "other"})


#: What arguments hold; all others are texts.
TYPES = {k: "integer" for k in ("year", "month", "sessions", "days", "top", "limit", "max_chars")} | {k: "boolean" for k in ("whole_word", "annualised")} | {k: "list of texts" for k in ("tickers", "exclude", "terms")} | {k: "day, month or year" for k in ("start", "end", "day", "compare_start", "compare_end")}


class Engine:
    """Metrics over the canonical views of a folder of tables. Dates may be days, months or years."""

    def __init__(self, spark: SparkSession, sf_dir: str, left_out: Sequence[str] = ("5-LOW",)):
        """left_out: tickers that `basket` leaves out."""
        self.left_out = tuple(left_out)
        self.rates, self.prices, self.text = V.decisions(spark, sf_dir), V.bars(spark, sf_dir), V.articles(spark, sf_dir)
        self.spark = spark
        self.metrics: dict[str, dict[str, Callable[..., DataFrame]]] = {
            "rates": {
                "coverage": lambda: R.coverage(self.rates),
                "count": lambda start=None, end=None: R.count(self.rates, start, end),
                "count_changes": lambda start=None, end=None: R.changes(self.rates, start, end),
                "changes_by_year": lambda start=None, end=None: R.changes_by_year(self.rates, start, end),
                "extremes": lambda: R.extremes(self.rates),
                "max_hold_streak": lambda top=None: R.hold_streaks(self.rates, top),
                "open_streak": lambda: R.open_streak(self.rates),
                "lookup_rate": lambda day: R.as_of(self._day(day), self.rates),
                "next_change": lambda day: R.next_change(self._day(day), self.rates),
                "period_summary": lambda start, end: R.period_summary(self.rates, start, end),
                "list_changes": lambda start=None, end=None: R.list_changes(self.rates, start, end),
                "compare_periods": lambda start, end, compare_start, compare_end: R.compare_periods(self.rates, (start, end), (compare_start, compare_end)),
            },
            "prices": {
                "coverage": lambda: P.coverage(self.prices),
                "annual_return": lambda year, tickers=None, exclude=(): P.annual_returns(self._bars(tickers, exclude)).where(f"year = {int(year)}"),
                "rank_annual_returns": lambda year, tickers=None, exclude=(): P.rank_annual_returns(self._bars(tickers, exclude)).where(f"year = {int(year)}"),
                "full_sample_return": lambda tickers=None, exclude=(): P.full_sample_returns(self._bars(tickers, exclude)),
                "avg_volume": lambda tickers=None, exclude=(), start=None, end=None: P.volume_stats(self._bars(tickers, exclude), start, end),
                "max_drawdown": lambda tickers=None, exclude=(), start=None, end=None, top=None: P.max_drawdown(self._bars(tickers, exclude), start, end, top),
                "volatility": lambda tickers=None, exclude=(), year=None, annualised=True: P.volatility(self._bars(tickers, exclude), year, annualised),
                "correlation": lambda tickers, start=None, end=None: self._correlation(tickers, start, end),
                "close_on": lambda day, tickers=None, exclude=(): P.price_on_date(self._bars(tickers, exclude), day).select("ticker", "close", "used_day", "exact"),
                "price_on_date": lambda day, tickers=None, exclude=(): P.price_on_date(self._bars(tickers, exclude), day),
                "window_return": lambda start, end, tickers=None, exclude=(): self._window(start, end, tickers, exclude),
                "event_window": lambda day, sessions=None, days=None, tickers=None, exclude=(): self._event(day, sessions, days, tickers, exclude),
                "basket_tickers": lambda exclude=(): self._bars("basket", exclude).select("ticker").distinct(),
            },
            "text": {
                "coverage": lambda: T.coverage(self.text),
                "count": lambda pattern=None, terms=None, whole_word=True, year=None, month=None, start=None, end=None: T.count(self.text, T.build_pattern(pattern, terms, whole_word), year=year, month=month, start=start, end=end),
                "count_by_year": lambda pattern=None, terms=None, whole_word=True: T.by_year(self.text, T.build_pattern(pattern, terms, whole_word)),
                "count_by_month": lambda pattern=None, terms=None, whole_word=True, year=None: T.by_month(T.dated(self.text, year=year), T.build_pattern(pattern, terms, whole_word)),
                "share": lambda pattern=None, terms=None, whole_word=True, year=None: T.share(self.text, T.build_pattern(pattern, terms, whole_word), year),
            },
        }

    def _day(self, day: str) -> DataFrame:
        return self.spark.createDataFrame([(dates.bound(day, upper=True),)], "requested date")

    def _bars(self, tickers: Sequence[str] | str | None, exclude: Sequence[str] | str = ()) -> DataFrame:
        listed = lambda x: [t.strip() for t in x.split(",")] if isinstance(x, str) else list(x or ())
        wanted, without = listed(tickers), listed(exclude)
        # Shorthands for many tickers, each only by itself.
        if [w.lower() for w in wanted] in (["all"], ["*"], ["everything"]):
            wanted = []
        elif [w.lower() for w in wanted] == ["basket"]:
            wanted, without = [], [*without, *self.left_out]
        if wanted:
            known = {r.ticker for r in self.prices.select("ticker").distinct().collect()}  # the universe, a dimension
            unknown = [t for t in wanted if t not in known]
            if unknown:
                raise MetricError(f"unknown tickers: {', '.join(unknown)}")
            if not set(wanted) - set(without):
                raise MetricError("no ticker is left")
        return P.universe(self.prices, wanted or None, without)

    def _correlation(self, tickers: Sequence[str] | str, start: str | None, end: str | None) -> DataFrame:
        pair = [t.strip() for t in tickers.split(",")] if isinstance(tickers, str) else list(tickers)
        if len(set(pair)) != 2:
            raise MetricError("two different tickers are asked for")
        return P.correlation(self._bars(pair), *pair, start, end)

    def _window(self, start: str, end: str, tickers, exclude) -> DataFrame:
        low, high = dates.window(start, end)
        if low >= high:
            raise MetricError("a window must begin before it ends")
        one = self.spark.createDataFrame([("window", low, high)], "key string, start date, end date")
        return P.window_returns(self._bars(tickers, exclude), one)

    def _event(self, day: str, sessions: int | None, days: int | None, tickers, exclude) -> DataFrame:
        if (sessions is None) == (days is None):
            raise MetricError("give either sessions or days")
        bars = self._bars(tickers, exclude)
        event = self._day(day).withColumnRenamed("requested", "event_day")
        windows = P.session_windows(self.prices, event, sessions) if sessions is not None else P.calendar_windows(self.prices, event, days)
        return P.window_returns(bars, windows)

    def frame(self, dataset: str, metric: str, **arguments: Any) -> tuple[DataFrame, list[str]]:
        """The metric as a DataFrame, and the arguments that it ignores."""
        name = DATASETS.get(dataset.strip().lower())
        if name is None:
            raise MetricError(f"unknown dataset {dataset}; there are {', '.join(sorted(set(DATASETS.values())))}")
        called = METRIC_ALIASES.get((name, metric.strip().lower()), metric.strip().lower())
        if called not in self.metrics[name]:
            raise MetricError(f"unknown metric {metric}; {name} has {', '.join(self.metrics[name])}")
        given = {k: v for k, v in arguments.items() if v is not None}
        known = inspect.signature(self.metrics[name][called]).parameters
        strange = [k for k in given if k not in known]
        if refused := [k for k in strange if k in SCOPE]:
            raise MetricError(f"{called} takes no {', '.join(refused)}: leaving it out would answer another question")
        lacking = [k for k, p in known.items() if p.default is inspect.Parameter.empty and k not in given]
        if lacking:
            raise MetricError(f"{called} needs {', '.join(lacking)}")
        try:
            return self.metrics[name][called](**{k: v for k, v in given.items() if k in known}), strange
        except (ValueError, TypeError) as e:
            raise MetricError(str(e)) from e

    def query(self, dataset: str, metric: str, **arguments: Any) -> dict[str, Any]:
        df, ignored = self.frame(dataset, metric, **arguments)
        rows = [json.loads(r) for r in df.toJSON().collect()]  # a metric's table: some rows
        return {"dataset": dataset, "metric": metric, "rows": rows} | ({"ignored": ignored} if ignored else {})

    def retrieve(self, **arguments: Any) -> dict[str, Any]:
        """Articles by pattern, terms or day; an argument that isn't known is an error."""
        strange = set(arguments) - {"pattern", "terms", "whole_word", "day", "limit", "max_chars"}
        if strange:
            raise MetricError(f"retrieve takes no {', '.join(sorted(strange))}")
        pattern, terms = arguments.get("pattern"), arguments.get("terms")
        if pattern is None and terms is None and arguments.get("day") is None:
            raise MetricError("give a pattern, terms or a day")
        built = T.build_pattern(pattern, terms, arguments.get("whole_word", True)) if pattern or terms else None
        found = T.retrieve(self.text, built, arguments.get("day"), arguments.get("limit", 5), arguments.get("max_chars", 1000))
        return {"articles": [json.loads(r) for r in found.toJSON().collect()]}  # `limit` rows

    def coverage(self) -> dict[str, Any]:
        return {name: self.query(name, "coverage")["rows"] for name in self.metrics}

    def execute(self, tool: str, arguments: dict[str, Any]) -> tuple[dict[str, Any], bool]:
        """A call by name; never raises. The name of a dataset, or of a metric that one dataset has, also does."""
        try:
            if tool == "query_data":
                return self.query(**arguments), True
            if tool == "retrieve":
                return self.retrieve(**arguments), True
            if tool == "coverage":
                return self.coverage(), True
            if tool.lower() in DATASETS:
                return self.query(tool, **arguments), True
            owners = [d for d, m in self.metrics.items() if tool in m]
            if len(owners) == 1:
                return self.query(owners[0], tool, **arguments), True
            raise MetricError(f"unknown tool {tool}")
        except Exception as e:  # noqa: BLE001  the caller gets told, whatever it was
            return {"error": f"{type(e).__name__}: {e}"}, False

    def schemas(self) -> list[dict[str, Any]]:
        """What each metric takes and of what type, from its signature."""
        return [{"dataset": d, "metric": m, "arguments": {k: "required" if p.default is inspect.Parameter.empty else "optional" for k, p in inspect.signature(f).parameters.items()}, "types": {k: TYPES.get(k, "text") for k in inspect.signature(f).parameters}} for d, ms in self.metrics.items() for m, f in ms.items()]


def answer(engine: Engine, question: str, plan: Callable[[str, list[dict]], list[tuple[str, dict]] | str], steps: int = 8, word: Callable[[str, list[dict]], str] | None = None) -> dict[str, Any]:
    """A loop of planned calls and a worded answer. plan says the next calls, as pairs or as the text that a model wrote them into, none to end; only calls that went well are worded."""
    trace: list[dict[str, Any]] = []
    while len(trace) < steps and (planned := plan(question, trace)):
        calls = tool_calls.found(planned) if isinstance(planned, str) else planned
        if not calls:
            break
        for tool, arguments in calls[: steps - len(trace)]:
            found, ok = engine.execute(tool, arguments)
            trace.append({"tool": tool, "args": arguments, "result": found, "compact": compact.payload(found), "ok": ok})
    good = [t for t in trace if t["ok"]]
    template = lambda _, t: tool_calls.evidence(t) if t else "There is no evidence to answer from."
    return {"answer": (word or template)(question, good), "steps": len(trace), "tool_trace": trace}
