"""Ties, edges and misuse of the operators, on tables typed in by hand."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaymark.functions import dates, grading
from quaymark.functions import scalars as S
from quaymark.operators import corpus as C
from quaymark.operators import evaluation as E
from quaymark.operators import prices as P
from quaymark.operators import rates as R
from quaymark.operators import text as T

D = dt.date.fromisoformat


@pytest.fixture(scope="module")
def decisions(spark):
    rows = [("2019-01-02", 150, 0), ("2019-02-06", 175, 25), ("2019-03-06", 175, 0), ("2019-04-03", 150, -25), ("2019-05-01", 150, 0), ("2019-05-29", 175, 25), ("2019-07-03", 175, 0)]
    return spark.createDataFrame([(D(a), b, c) for a, b, c in rows], "effective date, target_bp int, change_bp int")


@pytest.fixture(scope="module")
def bars(spark):
    closes = {"AAA": [10, 12, 12, 6, 6, 9], "BBB": [1, 2, 3, 4, 5, 6], "CCC": [7]}
    rows = [(t, D(f"2020-01-{d:02d}"), float(c), float(c), float(c), float(c), 1.0) for t, cs in closes.items() for d, c in zip((2, 3, 6, 7, 8, 9), cs)]
    return spark.createDataFrame(rows, "ticker string, day date, open double, high double, low double, close double, volume double")


def test_rates(spark, decisions):
    assert R.changes(decisions).first()[:4] == (7, 3, 2, 1)
    assert R.changes(decisions, "2020-01-01").first()[:6] == (0, 0, 0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        R.count(decisions, "2020-01-01", "2019-01-01").collect()
    streaks = R.hold_streaks(decisions).collect()
    assert [(s.days, s.start, s.holds) for s in streaks] == [(56, D("2019-02-06"), 1), (56, D("2019-04-03"), 1)]
    assert R.open_streak(decisions).first()[:3] == (D("2019-05-29"), D("2019-07-03"), 35)
    asked = spark.createDataFrame([(D("2018-12-31"),), (D("2019-02-06"),), (D("2019-02-05"),), (D("2030-01-01"),)], "requested date")
    held = {r.requested: r.effective for r in R.as_of(asked, decisions).collect()}
    assert held == {D("2018-12-31"): None, D("2019-02-06"): D("2019-02-06"), D("2019-02-05"): D("2019-01-02"), D("2030-01-01"): D("2019-07-03")}
    coming = {r.requested: r.next_effective for r in R.next_change(asked, decisions).collect()}
    assert coming == {D("2018-12-31"): D("2019-02-06"), D("2019-02-06"): D("2019-04-03"), D("2019-02-05"): D("2019-02-06"), D("2030-01-01"): None}
    summary = R.period_summary(decisions, "2019-03-01", "2019-05-15").first()
    assert (summary.rate_before, summary.rate_end, summary.first_change) == (1.75, 1.5, D("2019-04-03"))
    assert [r.extreme for r in R.extremes(decisions).orderBy("extreme").collect()] == ["highest", "lowest"]


def test_prices(spark, bars):
    fall = {r.ticker: r for r in P.max_drawdown(bars).collect()}
    assert set(fall) == {"AAA", "BBB"}
    assert (fall["AAA"].drawdown_pct, fall["AAA"].peak_day, fall["AAA"].trough_day) == (-50.0, D("2020-01-03"), D("2020-01-07"))
    assert (fall["BBB"].drawdown_pct, fall["BBB"].trough_day) == (0.0, D("2020-01-02"))
    assert {r.ticker for r in P.annual_returns(bars).collect()} == {"AAA", "BBB"}
    assert {r.ticker for r in P.volatility(bars).collect()} == {"AAA", "BBB"}
    assert P.correlation(bars, "AAA", "CCC").first()[:] == (0, None)
    asked = spark.createDataFrame([("AAA", D("2020-01-05")), ("AAA", D("2019-01-01")), ("CCC", D("2020-01-02"))], "ticker string, requested date")
    got = {(r.ticker, r.requested): (r.used_day, r.exact) for r in P.close_as_of(asked, bars).collect()}
    assert got == {("AAA", D("2020-01-05")): (D("2020-01-03"), False), ("AAA", D("2019-01-01")): (None, None), ("CCC", D("2020-01-02")): (D("2020-01-02"), True)}
    same = spark.createDataFrame([("w", D("2020-01-03"), D("2020-01-05"))], "key string, start date, end date")
    assert {r.ticker: r.return_pct for r in P.window_returns(bars, same).collect()} == {"AAA": 0.0, "BBB": 0.0, "CCC": 0.0}
    event = spark.createDataFrame([(D("2020-01-03"),), (D("2020-01-08"),), (D("2019-12-01"),)], "event_day date")
    assert [(r.start, r.end) for r in P.session_windows(bars, event, 2).collect()] == [(D("2020-01-03"), D("2020-01-07"))]
    assert [(r.start, r.end) for r in P.calendar_windows(bars, event, 2).orderBy("start").collect()] == [(D("2020-01-03"), D("2020-01-05"))]
    ties = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "ticker string, v double")
    assert [r.ticker for r in P.ranked(ties, "v").orderBy("rank").collect()] == ["c", "a", "b"]


@pytest.fixture(scope="module")
def articles(spark):
    rows = [(1, "Über AI", "über ai\nplain", "2020-05-01"), (2, "ai.", "ai. the end", None), (3, "Maid", "maid said", "2021-05-02"), (4, "AI again", "ai again été", "2021-06-02"), (5, "été", "étéai", "2021-06-03"), (6, "", "", None)]
    return spark.createDataFrame([(a, b, c, d and D(d)) for a, b, c, d in rows], "article_id bigint, headline string, blob string, publication date")


def test_text(spark, articles):
    whole, part = T.build_pattern(terms="ai"), T.build_pattern(terms=["ai"], whole_word=False)
    assert T.count(articles, whole).first().matches == 3 and T.count(articles, part).first().matches == 5
    assert T.count(articles, whole, year=2021).first()[:2] == (1, 6) and T.share(articles, whole, 2021).first()[:2] == (1, 3)
    assert T.count(articles, part, month=5).first().matches == 2
    assert {r.year: r.peak for r in T.by_year(articles, whole).collect()} == {2020: True, 2021: False}
    assert {r.month: r.peak for r in T.by_month(articles, whole).collect()} == {"2020-05": False, "2021-06": True}
    for bad in ({}, {"pattern": "a", "terms": "b"}, {"terms": " , "}):
        with pytest.raises(ValueError):
            T.build_pattern(**bad)
    with pytest.raises(Exception):
        T.build_pattern("(")
    assert sorted(r.article_id for r in T.by_index(articles, [["ai", "plain"], ["maid"]]).collect()) == [1, 3]
    found = T.retrieve(articles, part, limit=0).collect()
    assert len(found) == 1 and found[0].total == 5
    asked = spark.createDataFrame([("AI AGAIN!", D("2021-06-02")), ("ai again", D("2000-01-01")), ("aga", D("2021-06-02")), ("aga", D("2000-01-01"))], "wanted string, day date")
    assert sorted((r.wanted, str(r.day), r.stage) for r in T.find_headline(articles, asked).collect()) == [("AI AGAIN!", "2021-06-02", 1), ("aga", "2021-06-02", 3), ("ai again", "2000-01-01", 2)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab|()[]\\.c", min_size=1, max_size=6), min_size=1, max_size=4))
def test_literals_are_in_every_match(words):
    import re

    pattern = T.build_pattern(terms=words, whole_word=False) if any(w.strip() for w in words) else "a"
    held = T.literals(pattern)
    for w in words:
        if w.strip():
            assert re.search(pattern, w.strip().lower())
            assert held is None or any(h in w.strip().lower() for h in held)


def test_corpus(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], f"g{k // 4}", "q", "same" if k % 3 else "other", k) for k in range(40)], "example_id bigint, category string, gold_key string, question string, answer string, tokens bigint")
    from pyspark.sql import functions as F

    assert sorted(r.example_id for r in C.keep_first(rows, F.col("answer"), "example_id").collect()) == [0, 1]
    split = C.split_by_group(rows, 5)
    assert split.groupBy("gold_key").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert 5 <= split.where("split = 'val'").count() <= 8
    assert C.quantiles(rows).first()[:] == (0, 20, 38, 39)
    with pytest.raises(Exception, match="too many items"):
        rows.select(S.combinations(F.array(*[F.lit(str(k)) for k in range(17)]))).collect()
    assert len(rows.select(S.combinations(F.array(*[F.lit(str(k)) for k in range(16)]), 1, 2).alias("c")).first().c) == 16 + 120
    assert rows.select(S.combinations(F.array().cast("array<string>")).alias("c")).first().c == []
    assert [r.n for r in C.stratify(rows, 30, {"a": 0.8, "b": 0.2}).groupBy("category").agg(F.count("*").alias("n")).orderBy("category").collect()] == [20, 9]
    votes = spark.createDataFrame([(1, 0, "x", "p"), (1, 1, "y", "p"), (1, 2, "y", "p"), (2, 0, "x", "p"), (2, 1, "z", "n"), (2, 2, "x", "p"), (3, 0, "x", "p")], "k int, position int, label string, coarse string")
    assert [tuple(r) for r in C.vote(votes, "k").collect()] == [(1, "y", 3)]


def test_paired(spark):
    ties = spark.createDataFrame([(k, 0.5, 0.5, 0.0) for k in range(3)], "qid bigint, a double, b double, diff double")
    assert E.sign_flip(ties).first()[:] == (1, 1.0)
    few = spark.createDataFrame([(k, 0.0, 1.0, 1.0) for k in range(4)], "qid bigint, a double, b double, diff double")
    assert E.sign_flip(few).first()[:] == (16, 0.125)
    many = spark.createDataFrame([(k, 0.0, 1.0, 1.0 if k % 2 else -1.0) for k in range(24)], "qid bigint, a double, b double, diff double")
    assert E.sign_flip(many, trials=500).first()[:] == (500, 1.0)
    assert E.bootstrap(few, 200).first()[:] == (1.0, 1.0)


def test_literals():
    whole = T.build_pattern(terms=["rate rise", "bank"])
    assert T.literals(whole) == ["rate rise", "bank"]
    assert T.literals("a(bc|d)efg[hi]") == ["efg"] and T.literals(r"ab\.c|x+yz") == ["ab.c", "yz"]
    assert T.literals("(a|b)") is None and T.literals("(?i)ABC") == ["abc"] and T.literals("ab|[cd]") is None and T.literals("(") is None


def test_running_sums_over_ranges(spark):
    from pyspark.sql import functions as F

    from quaymark.operators.ranks import running

    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("hot")).alias("k"), (F.col("id") * 7919 % 13).alias("v"))
    got = {r.id: r.upto for r in running(rows, ["k"], ["v", "id"], "upto", "v").collect()}
    want, sums = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (r.v, r.id)):
        want[r.id] = sums[r.k] = sums.get(r.k, 0) + r.v
    assert got == want
    assert running(rows.limit(0), ["k"], ["v", "id"], "upto").count() == 0


def test_stratify_against_brute_force(spark):
    from quaymark.plans.corpus_queries import SHARES
    from quaymark.sources import views as V

    examples = V.examples(spark, "/root/testdata/sf0.001").select("example_id", "category")
    got = sorted((r.category, r.nth, r.example_id) for r in C.stratify(examples, 150, SHARES).collect())
    by = {}
    for r in examples.collect():
        by.setdefault(r.category, []).append(r.example_id)
    quota = {c: round(150 * s) for c, s in SHARES.items()}
    take = {c: min(len(by.get(c, [])), quota[c]) for c in quota}
    for c in sorted(quota, key=lambda c: (-SHARES[c], c)):
        while sum(take.values()) < 150 and take[c] < len(by.get(c, [])) and take[c] < int(1.5 * quota[c]):
            take[c] += 1
    order = lambda k: ((k % 2147483647 * 1103515245 + 41) % 2147483647, k)
    assert got == sorted((c, n, k) for c in take for n, k in enumerate(sorted(by.get(c, []), key=order)[: take[c]], 1))


@pytest.mark.parametrize(("raw", "low", "high"), [("2019", "2019-01-01", "2019-12-31"), ("2020-2", "2020-02-01", "2020-02-29"), ("Feb. 2020", "2020-02-01", "2020-02-29"), ("September 2019", "2019-09-01", "2019-09-30"), ("5 Jun 2019", "2019-06-05", "2019-06-05"), ("Jun 5, 2019", "2019-06-05", "2019-06-05"), ("20190605", "2019-06-05", "2019-06-05"), ("05/06/2019", "2019-06-05", "2019-06-05"), (" 2019-6-5 ", "2019-06-05", "2019-06-05")])
def test_date_words(raw, low, high):
    assert (dates.bound(raw), dates.bound(raw, upper=True)) == (D(low), D(high))


def test_date_words_that_name_nothing():
    for bad in ("", "soon", "2019-13-01", "31 Feb 2019", "12", "201906"):
        with pytest.raises(ValueError):
            dates.bound(bad)
    with pytest.raises(ValueError):
        dates.window("2020", "2019")


def test_grading(spark):
    from pyspark.sql import functions as F

    note = "Returns +/- 0.02; correlations allow +/- 0.001; closes allow +/- 0.0001; volume allows +/- 1 share."
    cases = [
        ("returned 22.17% on 5 Jun 2019", "22.19 per cent, 2019-06-05", note, "PASS"), ("returned 22.17%", "22.20%", note, "FAIL"), ("returned 22.17%", "22.18%", "", "FAIL"),
        ("the cash rate is 1.50%", "1.51%", note, "FAIL"), ("up 0.25 percentage points", "0.26", note, "FAIL"), ("correlation of 0.5120", "0.5125", note, "PASS"), ("closing at 10.1234", "10.1236", note, "FAIL"),
        ("volume of 1,000,000 shares", "1000000.9", note, "PASS"), ("41 changes", "there were 41", note, "PASS"), ("41 changes", "42", note, "FAIL"), ("in Jun 2019", "on 7 June 2019", note, "PASS"), ("in 2019-06", "Jun 2019", note, "PASS"),
        ("on 7 Jun 2019", "in Jun 2019", note, "FAIL"), ("it rose", "yes 5", note, "N/A"), ("-3.5%", "-3.5", note, "PASS"), ("-3.5%", "3.5", note, "FAIL"),
    ]
    rows = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "k int, fact string, answer string, note string")
    got = {r.k: r.v for r in rows.select("k", grading.numeric_check(F.col("fact"), F.col("answer"), F.col("note")).alias("v")).collect()}
    assert got == {k: c[3] for k, c in enumerate(cases)}
    texts = [("1) A 12.30%; 2) B 1,774 and 0.5", ["12.2999", "1774 or 0.50"], []), ("it was 7, not 8.", ["7.0"], ["8"]), ("-82.45% of 5", ["-82.4531"], ["5"]), ("5) x", [], [])]
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(texts)], "k int, answer string, texts array<string>, want array<string>")
    assert all(r.got == r.want for r in rows.select("want", grading.ungrounded(F.col("answer"), F.col("texts")).alias("got")).collect())
    flags = spark.createDataFrame([("about 5", True, False, False), ("about " + "x" * 60 + " 5", False, False, False), ("Hmm, let me see", False, True, False), ("a ```b``` 3", False, False, True), ("the data", False, False, False)], "a string, h boolean, l boolean, m boolean")
    for r in flags.select("*", grading.hedged(F.col("a")).alias("h2"), grading.leaked(F.col("a")).alias("l2"), grading.misformatted(F.col("a")).alias("m2")).collect():
        assert (r.h, r.l, r.m) == (r.h2, r.l2, r.m2), r.a
    one = spark.createDataFrame([("BHP rose 5% in 2019", "bhp had 5 percent", "shares fell")], "f string, a string, b string")
    got = one.select(grading.screened(F.col("f"), F.col("a")).alias("x"), grading.screened(F.lit("the market rally"), F.col("b")).alias("y")).first()
    assert got.x.missing == ["2019"] and not got.x.likely and got.y.coverage == 0.0 and not got.y.likely
    assert [r.v for r in spark.createDataFrame([(None,), (60.0,), (61.0,), (301.0,)], "s double").select(S.latency_factor(F.col("s")).alias("v")).collect()] == [1.0, 1.0, 0.8, 0.0]


def test_paraphrases(spark):
    """Lines of a reply as variants: bullets and quotes go, hard tokens must stay, the first n count; odd replies have none."""
    q = "What did BHP.AX return in 2019, excluding CBA.AX?"
    good = ["How did BHP.AX do in 2019, CBA.AX excluded?", "In 2019, BHP.AX without CBA.AX, which is excluded?", "Tell me BHP.AX for 2019 excluding CBA.AX"]
    reply = "\n".join([f'1. "{good[0]}"', "- How did BHP.AX do in 2018, CBA.AX excluded?", "* How did BHP.AX do in 2019, CBA.AX apart?", q, "", "2019?", f"  2. {good[1]}  ", f"- {good[2]}"])
    rows = [(1, "t", q, "a", ["shuffle"], reply, "k"), (2, "t", q, "a", None, None, "k"), (3, None, "Why?", "a", None, "short\r\nA line that is long enough\n" + "x" * 100000, None), (3, None, "Why?", "a", None, "", None)]
    df = spark.createDataFrame(rows, "example_id int, template_id string, question string, answer string, perturbations array<string>, reply string, gold_key string")
    got = C.paraphrased(df, 2).collect()
    assert [(r.example_id, r.template_id, r.question, r.answer, r.perturbations, r.gold_key) for r in got] == [(1, "t.p1", good[0], "a", ["shuffle", "paraphrase"], "k"), (1, "t.p2", good[1], "a", ["shuffle", "paraphrase"], "k"), (3, None, "A line that is long enough", "a", ["paraphrase"], None)]
    assert C.paraphrased(df, 3).where("example_id = 1").count() == 3 and C.paraphrased(df.limit(0)).count() == 0
    named = C.paraphrased(df, 9, excluded=["apart"]).where("example_id = 1").count()
    assert named == 4 and "reply" not in C.paraphrased(df).columns


def test_prompt_gates(spark):
    rows = [("a", "S", "p", "p", 1), ("a", "S", "x", "p", 0), ("b", "S", "p ", "p", 2), ("c", "T", None, None, 0), ("d", None, None, "p", 1)]
    got = {r["set"]: tuple(r)[1:] for r in C.prompt_gates(spark.createDataFrame(rows, "set string, system string, prompt string, rendered string, steps int"), "S").collect()}
    assert got == {"a": (1, True, True), "b": (1, False, True), "c": (0, False, False), "d": (1, False, False)}


def test_signals_and_their_sql_agree_on_odd_answers(spark):
    """The patterns of the library and SQL that splits and searches, on texts at the edges of the rules."""
    import duckdb

    from quaymark.sources import views

    texts = ["", "about", "about" + "x" * 39 + "7", "about" + "x" * 40 + "7", "some about 5", "ABOUT\n5", "estimated over 3", "estimates 3", "a hmm", "\n \t hmm", "First I look", "first, i", "first,  i", "Step 1", "step x", "steps 1", "so\r\nOkay, so", "</THINK>", "Based on the tool results, I say", "[1] query_data", "[1]query_data", "[x] retrieve", "[] retrieve", "1] retrieve", "[[12]\n\tdataset_coverage", "[1][2] Retrieve", '{"a"', 'x {"a"', "\n{ \n 'a'", "{{'a'", "{\n{'a'", "{a'", "```", "query_data(", "query_data"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", grading.hedged(F.col("t")), grading.leaked(F.col("t")), grading.misformatted(F.col("t"))).orderBy("i").collect()
    con = duckdb.connect()
    con.execute("create table x (i int, t varchar)")
    con.executemany("insert into x values (?, ?)", list(enumerate(texts)))
    want = con.execute(f"select i, {views.hedged_sql('t')}, {views.leaked_sql('t')}, {views.misformatted_sql('t')} from x order by i").fetchall()
    assert [tuple(r) for r in got] == want
    assert [sum(column) for column in list(zip(*want))[1:]] == [4, 7, 8]


def test_screening_names_numbers_words_and_the_outcome(spark):
    cases = [("the market rally ended", "Market. Rally!"), ("the market rally ended", ""), ("up 1,250 or -3.5", "1250 and -3.5"), ("up 1,250 or 3", "1250"), ("", ""), ("with that", "")]
    got = spark.createDataFrame(cases, "f string, a string").select(grading.screened(F.col("f"), F.col("a")).alias("x")).select("x.*").collect()
    assert [(list(r.missing), r.coverage, r.likely) for r in got] == [([], 0.67, True), ([], 0.0, False), ([], None, True), (["3"], None, False), ([], None, True), ([], None, True)]


def _shuffled(spark):
    """Records that this session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_headlines_found_are_not_shuffled(spark):
    n, word = 300, "abcdefghij"
    day = [D("2020-01-01") + dt.timedelta(days=k) for k in range(n)]
    parts = [word[i:j] for i in range(len(word)) for j in range(i + 1, len(word) + 1)]
    rows = [(k, "The same", day[k]) for k in range(n)] + [(n + k, f"{word} {k}", D("2019-01-01")) for k in range(n)]
    articles = spark.createDataFrame(rows, "article_id bigint, headline string, publication date")
    asked = spark.createDataFrame([("the same", d) for d in day] + [("the same", D("2018-01-01"))] + [(p, D("2019-01-01")) for p in parts], "wanted string, day date")
    before = _shuffled(spark)
    found = T.find_headline(articles, asked).groupBy("stage").count().collect()
    assert {r.stage: r["count"] for r in found} == {1: n, 2: n, 3: n * len(parts)}
    assert _shuffled(spark) - before < 10 * (2 * n + n + 1 + len(parts))


def test_headlines_of_odd_articles_and_requests(spark):
    rows = [(1, "One, two", "2020-01-01"), (1, "One, two", "2020-01-01"), (1, "two; three", "2020-01-01"), (1, "two", "2020-01-02"), (2, "one TWO", None), (3, "", "2020-01-01"), (4, None, "2020-01-01"), (None, "twos", "2020-01-01"), (5, "—", None)]
    articles = spark.createDataFrame([(a, h, d and D(d)) for a, h, d in rows], "article_id bigint, headline string, publication date")
    wanted = [(w, d and D(d)) for w in ("one two", "One two!", "two", "wo", "two three one", "", "?", None) for d in ("2020-01-01", "2020-01-02", "2021-01-01", None)]
    norm = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip() if t is not None else None
    want = set()
    for w, d in wanted:
        named = [(a, norm(h), p and D(p)) for a, h, p in rows if h is not None and w is not None]
        exact = [(a, p) for a, h, p in named if h == norm(w)]
        held = [(a, p) for a, h, p in named if norm(w) and d and p == d and norm(w) in h]
        for stage, hits in ((1, [x for x in exact if x[1] == d]), (2, exact), (3, held)):
            if hits:
                want |= {(w, d, stage, *x) for x in hits}
                break
    asked = spark.createDataFrame([*wanted, *wanted], "wanted string, day date")
    got = [tuple(r) for r in T.find_headline(articles, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want
