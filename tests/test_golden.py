"""Values that the operators are known to give on small inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asofline.functions import temporal
from asofline.functions import text as X
from asofline.operators import cases, documents, evidence, gate, moves, snapshot, threads, upsert
from asofline.sources import parsers

UTC = dt.datetime


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("day, expected", [("2020-01-15", "2020-01-16 04:59:59"), ("2020-07-15", "2020-07-16 03:59:59"), ("2020-03-08", "2020-03-09 03:59:59"), ("2020-11-01", "2020-11-02 04:59:59"), ("2024-02-29", "2024-03-01 04:59:59")])
def test_instant_cutoff_follows_new_york(spark, day, expected):
    assert one(spark, c=F.date_format(temporal.instant_cutoff(day), "yyyy-MM-dd HH:mm:ss")).c == expected


def test_future_dates_are_refused_and_today_is_not():
    today = dt.date(2024, 5, 5)
    assert temporal.as_date("2024-05-05", today) == today
    with pytest.raises(ValueError):
        temporal.as_date("2024-05-06", today)


def test_news_known_by_the_day(spark):
    rows = [("cloud-ok", "GDELT Cloud via x", UTC(2026, 6, 1)), ("cloud-next", "GDELT Cloud via x", UTC(2026, 6, 2)), ("late", "Alpha Vantage", UTC(2026, 6, 2, 2)), ("after", "Alpha Vantage", UTC(2026, 6, 2, 4))]
    df = spark.createDataFrame(rows, "id string, source string, published_at timestamp")
    got = {r.id for r in df.where(temporal.knowable_news(F.col("published_at"), F.col("source"), "2026-06-01")).collect()}
    assert got == {"cloud-ok", "late"}


def spike_bars(spark):
    start = dt.date(2020, 1, 2)
    rows = []
    for i in range(40):
        close = 100.0 if i < 30 else 115.0
        high, low = (116.0, 99.0) if i == 30 else (close + 1, close - 1)
        rows.append(("X", start + dt.timedelta(i), close, high, low, close, 5000.0 if i == 30 else 1000.0))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_spike_is_the_top_move(spark):
    top = moves.top_moves(spike_bars(spark), temporal.column("2020-02-20")).where("rank = 1").first()
    assert top.date == dt.date(2020, 2, 1) and {"spike", "high-volume"} <= set(top.flags)
    assert top.daily_return_pct == 15.0 and top.volume_ratio == 5.0


def test_no_hindsight(spark):
    day = temporal.column("2020-02-05")
    bars = spike_bars(spark)
    later = bars.withColumn("close", F.when(F.col("date") > day, F.col("close") * 7).otherwise(F.col("close")))
    for f in (moves.scored, moves.window_summary, moves.regimes, moves.top_moves):
        assert sorted(map(str, f(bars, day).collect())) == sorted(map(str, f(later, day).collect()))


def test_thin_history_has_no_moves(spark):
    assert moves.scored(spike_bars(spark), temporal.column("2020-01-20")).count() == 0


def test_arrival_order_and_lags(spark):
    m = spark.createDataFrame([("X", dt.date(2020, 2, 1))], "symbol string, date date")
    f = spark.createDataFrame([("f1", "10-K", UTC(2020, 1, 28), "X")], "accession string, form_type string, filed_at timestamp, symbol string")
    n = spark.createDataFrame([("n1", UTC(2020, 1, 25, 12), "X")], "id string, published_at timestamp, symbol string")
    s = spark.createDataFrame([("s1", UTC(2020, 1, 29, 18), "X")], "id string, created_at timestamp, symbol string")
    got = [(r.layer, r.lag_hours) for r in evidence.arrivals(m, f, n, s).orderBy("position").collect()]
    assert got == [("news", 0.0), ("regulatory", 60.0), ("social", 102.0), ("market", 156.0)]
    silent = evidence.arrivals(m, f.where("false"), n.where("false"), s.where("false")).orderBy("position").collect()
    assert [(r.layer, r.state) for r in silent] == [("market", "observed"), ("regulatory", "silent"), ("news", "silent"), ("social", "silent")]


@pytest.mark.parametrize("days, tier", [(0, "very_close"), (1, "very_close"), (2, "recent"), (7, "recent"), (8, "older"), (30, "older"), (31, None), (-1, None)])
def test_filing_tiers(spark, days, tier):
    move = dt.date(2020, 3, 1)
    assert one(spark, t=evidence.tier(F.lit(str(move - dt.timedelta(days))).cast("timestamp"), temporal.column(str(move)))).t == tier


def test_uncertainty_without_evidence(spark):
    summary = spark.createDataFrame([("X", 30, 0.0, 0.0)], "symbol string, trading_days long, volatility double, max_drawdown_pct double")
    days = spark.createDataFrame([("X", 0, 0, 0)], "symbol string, regulatory_days long, news_days long, social_days long")
    none = spark.createDataFrame([], "symbol string, n_scored long, n_usable long, conflict double")
    got = evidence.uncertainty(summary, days, none).first()
    assert got.score == 40.4 and got.conflict is None and got.grade == "Medium"


def test_conflict_of_opposite_scores(spark):
    rows = spark.createDataFrame([("X", s, 1.0) for s in (1.0, -1.0, 1.0, -1.0)] + [("Y", 1.0, 0.5)], "symbol string, score double, confidence double")
    got = {r.symbol: r for r in evidence.conflict(rows).collect()}
    assert got["X"].conflict == 1.0 and got["Y"].conflict is None and got["Y"].n_scored == 1


@pytest.mark.parametrize("n, mean, ret, said", [(1, 0.9, 2.0, "unknown"), (2, 0.05, 2.0, "neutral"), (2, 0.5, 0.0, "neutral"), (2, 0.5, 1.0, "agree"), (2, 0.5, -1.0, "disagree")])
def test_divergence(spark, n, mean, ret, said):
    assert one(spark, d=evidence.divergence(F.lit(n), F.lit(mean), F.lit(ret))).d == said


def case_rows(spark, *rows):
    return spark.createDataFrame(rows, "case_id string, symbol string, peak date, reaction array<struct<day: date, close: double>>, fired array<string>")


def test_aftermath(spark):
    d = dt.date(2020, 1, 1)
    r = lambda a, b: [(d, float(a)), (d + dt.timedelta(1), float(b))]
    rows = case_rows(spark, *[(str(k), "X", d, x, ["s"]) for k, x in enumerate((r(100, 110), r(100, 120), r(200, 190)))], ("asks", "X", d, [], ["s"]))
    of = lambda rows: cases.aftermath(rows).where("case_id = 'asks'").first()[2:]
    assert of(rows) == (3, 10.0, 20.0, -5.0)
    assert of(rows.where("case_id <> '2'")) == (2, 15.0, 20.0, 10.0)
    assert of(rows.where("case_id = 'asks'")) == (0, None, None, None)


def test_supporters_never_come_from_the_future(spark):
    d = dt.date(2026, 6, 15)
    rows = case_rows(spark, ("SELF", "X", d, [], ["s"]), ("FUTURE", "X", d + dt.timedelta(1), [], ["s"]), ("PAST", "X", d - dt.timedelta(30), [], ["s"]), ("QUIET", "X", d - dt.timedelta(9), [], []))
    assert {r.case_id: r.n_supporters for r in cases.supporters(rows).collect()} == {"SELF": 1, "FUTURE": 2, "PAST": 0}


def test_average_linkage_doesnt_chain(spark):
    vectors = [[1.0, 0.0], [0.93969, 0.34202], [0.57358, 0.81915], [0.25882, 0.96593]]
    docs = spark.createDataFrame([("X", str(k), k + 1, v) for k, v in enumerate(vectors)], "symbol string, id string, pos long, vector array<double>")
    got = {r.id: r.cluster for r in threads.average_linkage(docs).collect()}
    assert got == {"0": 1, "1": 1, "2": 3, "3": 3}


@pytest.mark.parametrize("title, description, decision, category", [
    ("ACME beats on earnings", "", "RELEVANT", "FINANCIAL"), ("ACME opens a museum", "", "UNCERTAIN", "UNRELATED"), ("Inflation rises", "", "UNCERTAIN", "UNRELATED"),
    ("A quiet day", None, "IRRELEVANT", "UNRELATED"), ("Acme Global names new CEO", "", "RELEVANT", "MANAGEMENT"), (None, "acmeology of earnings", "UNCERTAIN", "UNRELATED"),
])
def test_rule_gate(spark, title, description, decision, category):
    v = one(spark, v=X.judge(F.lit(title).cast("string"), F.lit(description).cast("string"), F.lit("ACME"), F.lit("Acme Global Inc"))).v
    assert (v.decision, v.category) == (decision, category)


def test_gate_without_verdicts_passes_all(spark):
    news = spark.createDataFrame([("1", "X"), ("2", "X")], "id string, symbol string")
    verdicts = spark.createDataFrame([("1", "X", "RELEVANT")], "article_id string, symbol string, decision string")
    assert evidence.gated(news, verdicts.where("false")).count() == 2
    assert [r.id for r in evidence.gated(news, verdicts).collect()] == ["1"]


def test_user_verdicts_are_never_overwritten(spark):
    rows = [("1", "X", "USER_APPROVED", "USER", 1.0), ("2", "X", "UNCERTAIN", "RULE", 0.4)]
    kind = "article_id string, symbol string, decision string, decision_source string, confidence double"
    old = spark.createDataFrame(rows, kind)
    new = spark.createDataFrame([("1", "X", "IRRELEVANT", "AI", 0.9), ("2", "X", "RELEVANT", "AI", 0.9), ("3", "X", "RELEVANT", "AI", 0.9)], kind)
    got = {r.article_id: r.decision for r in upsert.verdicts(old, new).collect()}
    assert got == {"1": "USER_APPROVED", "2": "RELEVANT", "3": "RELEVANT"}
    twice = upsert.verdicts(upsert.verdicts(old, new), new)
    assert {r.article_id: r.decision for r in twice.collect()} == got


def test_normalised_verdicts(spark):
    v = spark.createDataFrame([("1", True, "RELEVANT", "NONSENSE", 0.9), ("2", True, "RELEVANT", "LEGAL", 0.6)], "article_id string, relevant boolean, decision string, category string, confidence double")
    got = {r.article_id: (r.decision, r.relevant, r.category) for r in gate.normalised(v).collect()}
    assert got == {"1": ("RELEVANT", True, "UNRELATED"), "2": ("UNCERTAIN", None, "UNRELATED")}


def test_requests():
    assert snapshot.symbols(" aapl, msft;aapl ") == ["AAPL", "MSFT"]
    assert snapshot.sections("News, prices") == ["news", "prices"] and snapshot.sections("") == list(snapshot.SECTIONS)
    assert snapshot.case_key("nflx:2026-06-15") == ("NFLX", "2026-06-15") and snapshot.case_key("nflx") is None and snapshot.case_key("a:b") is None
    for bad in (lambda: snapshot.symbols(""), lambda: snapshot.sections("x")):
        with pytest.raises(ValueError):
            bad()


def test_payload_edges(spark):
    raw = spark.createDataFrame([("X", '{"Time Series (Daily)": {"2020-01-02": {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": "1.5", "5. volume": "9"}, "bad": {}, "2020-01-03": {"1. open": "x"}}}'), ("Y", "{broken")], "symbol string, body string")
    assert [(r.symbol, r.close) for r in parsers.daily_prices(raw, temporal.column("2020-02-01"), 10).collect()] == [("X", 1.5)]
    feed = spark.createDataFrame([('{"feed": [{"url": "u", "title": "t", "time_published": "20240102T030405", "overall_sentiment_score": "1.5"}, {"url": "v", "title": "t", "time_published": "never", "overall_sentiment_score": "0.1"}]}',)], "body string")
    got = parsers.feed_sentiment(feed).collect()
    assert len(got) == 1 and got[0].sentiment_score is None and got[0].published_at == UTC(2024, 1, 2, 3, 4, 5)
    names = F.array(*map(F.lit, ["0001-index.htm", "R2.htm", "main.HTM", "a.txt"]))
    assert one(spark, p=parsers.primary_document(names)).p == "main.HTM"
    social = spark.createDataFrame([('{"data": [{"id": "1", "subreddit": "s", "title": "t", "selftext": "' + "z" * 400 + '", "created_utc": 1000.0, "score": 3}, {"id": "1", "subreddit": "s", "title": "t", "selftext": "", "created_utc": 1000.0, "score": 2}]}',)], "body string")
    post = parsers.posts(social, F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(2000))).collect()
    assert len(post) == 1 and post[0].score == 3 and len(post[0].excerpt) == 301
    story = spark.createDataFrame([("X", '{"entity": {"tickers": ["x"]}, "stories": [{"date": "2024-01-01", "top_articles": [{"url": "u", "title": "a"}]}]}'), ("Z", '{"entity": {"tickers": ["x"]}, "stories": []}')], "symbol string, body string")
    assert [r.symbol for r in parsers.entity_stories(story).collect()] == ["X"]
    book = spark.createDataFrame([('{"aapl": {"name": "Apple", "cik": "320193"}}',)], "body string")
    assert tuple(parsers.directory(book).first()) == ("AAPL", "Apple", "0000320193")


def test_long_texts(spark):
    d = spark.createDataFrame([(1, "intro\nItem 1. Business\nabc\nITEM 2 Risk\ndef"), (2, "plain text"), (3, None)], "k long, text string")
    assert [(r.k, r.heading, r.body) for r in documents.sections(d, "k", "text").orderBy("k", "n").collect()] == [(1, "ITEM 1 — Business", "Item 1. Business\nabc"), (1, "ITEM 2 — Risk", "ITEM 2 Risk\ndef"), (2, "FULL TEXT", "plain text")]
    t = spark.createDataFrame([(1, 1, "a" * 70), (1, 2, "b" * 40), (1, 3, "c" * 200), (1, 4, "d")], "k long, turn long, text string")
    assert [(r.turn, r.batch) for r in documents.batches(t, "k", "turn", "text", 100).orderBy("turn").collect()] == [(1, 0), (2, 1), (3, 2), (4, 3)]
    assert one(spark, h=X.strip_html(F.lit("<script>x</script><p>a &amp; b</p><!-- c -->"))).h == "a & b"
    assert one(spark, a=X.accession_of(F.lit("https://x/000119312520000001/"))).a == "0001193125-20-000001"
