"""Queries of whole answers: threads of two symbols, sector rows, snapshots with their outcome and messages, searches, and the tail of jobs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import column, sql_cutoff
from ..operators import across, cases, documents, snapshot
from ..sources import tables as T
from ..streaming import tail
from . import casebook, news
from .registry import query

DAY, D = news.DAY, news.D
VIEWS, CASES = casebook.VIEWS, casebook.CASES
_N = "substr(symbol, 7)::INT"
#: Links and near clusters of the sample, whose vectors are further apart than real ones.
LINK, NEAR = 0.2, 0.1


def _number():
    return F.substring("symbol", 7, 2).cast("int")


def _requests(spark, sf_dir):
    """Each symbol with the one after it."""
    after = W.partitionBy(F.lit(0)).orderBy("symbol")  # the directory, a row a symbol
    rows = T.companies(spark, sf_dir).select(F.col("symbol").alias("a"), F.lead("symbol").over(after).alias("b")).where("b is not null")
    return rows.select(F.concat_ws("|", "a", "b").alias("request"), "a", "b")


def clustered_articles(spark, sf_dir):
    v = T.vectors(spark, sf_dir).withColumnRenamed("article_id", "id")
    return news.known(spark, sf_dir).select("symbol", "id", "title", "description", "url", "published_at").join(v, "id")


@query()
def j17_cluster_pairs(spark, sf_dir):
    """Near pairs of clusters of the newest articles that two symbols had as of a date, with cohesion, shared terms and members; merge order has no SQL form."""
    found = across.near_clusters(clustered_articles(spark, sf_dir), _requests(spark, sf_dir), LINK, NEAR)
    rows = found.select("request", "duplicates", F.explode_outer("pairs").alias("p"))
    ids = lambda c: F.array_join(F.transform(c, lambda m: m["id"]), ",")
    return rows.select("request", "duplicates", "p.rank", "p.a_title", "p.b_title", "p.similarity", "p.mean", "p.a_cohesion", "p.b_cohesion", F.array_join("p.shared", ",").alias("shared"), ids(F.col("p.a_members")).alias("a_members"), ids(F.col("p.b_members")).alias("b_members"))


SECTOR = ("Brand#1", "Brand#4", "Brand#7", "Brand#13", "Brand#22", "Brand#99")


@query(T.oracle(*VIEWS, "companies", **CASES, **casebook.LIBRARY, w=f"SELECT unnest({list(SECTOR)}) AS symbol",
    pk="SELECT sg.symbol, sg.peak, sg.ret_pct, sg.score, sg.flags, sg.case_id, unnest(CASE WHEN len(fired) = 0 THEN [NULL] ELSE fired END) AS signal FROM sg") + f"""
SELECT w.symbol, c.name, CASE WHEN pk.symbol IS NOT NULL THEN NULL WHEN c.name IS NOT NULL THEN w.symbol || '{snapshot.MESSAGES["no moves"].removeprefix("{symbol}")}' ELSE w.symbol || '{snapshot.MESSAGES["unknown"].removeprefix("{symbol}")}' END AS reason,
  pk.peak, round_even(pk.ret_pct, 2) AS daily_return_pct, round_even(pk.score, 4) AS score, pk.flags, pk.signal, coalesce(t.n_supporters, 0) AS n_supporters, coalesce(t.n, 0) AS n_after, t.median
FROM w LEFT JOIN companies c USING (symbol) LEFT JOIN pk ON pk.symbol = w.symbol LEFT JOIN aft t ON t.case_id = pk.case_id AND t.signal = pk.signal""")
def h22_sector_rows(spark, sf_dir):
    """Asked symbols as of one date with their peaks and what fires in each; a row without peaks says why, and breaks no other."""
    library = casebook.registry(spark, sf_dir)
    after = cases.aftermath(library).select("case_id", "signal", F.col("n").alias("n_after"), "median")
    told = cases.supporters(library).join(after, ["case_id", "signal"]).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("signal", "n_supporters", "n_after", "median"))).alias("signals"))  # six signals at most
    case = library.where("own").select("case_id", "symbol", "peak", "daily_return_pct", "score", F.array_join("flags", ",").alias("flags")).join(told, "case_id", "left").drop("case_id")
    asked = spark.createDataFrame([(s,) for s in SECTOR], "symbol string")
    rows = snapshot.sector_rows(asked, T.companies(spark, sf_dir), case).select("symbol", "name", "reason", F.explode_outer("peaks").alias("p"))
    rows = rows.select("symbol", "name", "reason", "p.peak", F.bround("p.daily_return_pct", 2).alias("daily_return_pct"), F.bround("p.score", 4).alias("score"), "p.flags", F.explode_outer("p.signals").alias("s"))
    return rows.select("symbol", "name", "reason", "peak", "daily_return_pct", "score", "flags", "s.signal", F.coalesce("s.n_supporters", F.lit(0)).alias("n_supporters"), F.coalesce("s.n_after", F.lit(0)).alias("n_after"), "s.median")


@query(T.oracle("bars", "filings", "companies", p=f"SELECT symbol, count(*) AS n, min(date) AS s, max(date) AS e, arg_max(close, date) AS c FROM bars WHERE date > {D} AND date <= {D} + INTERVAL 30 DAY GROUP BY symbol",
    f=f"SELECT symbol, count(*) AS n, min(filed_at) AS s, max(filed_at) AS e FROM filings WHERE filed_at >= {D} + INTERVAL 1 DAY AND filed_at <= {sql_cutoff(D + ' + INTERVAL 30 DAY')} GROUP BY symbol") + """
SELECT c.symbol, coalesce(p.n, 0) AS n_prices, p.s AS first_day, p.e AS last_day, round_even(p.c, 8) AS outcome_price, coalesce(f.n, 0) AS n_filings, f.s AS first_filed, f.e AS last_filed FROM companies c LEFT JOIN p USING (symbol) LEFT JOIN f USING (symbol)""")
def h27_outcome(spark, sf_dir):
    """What followed in thirty days, kept apart from what was known."""
    out = snapshot.outcome(T.companies(spark, sf_dir), T.bars(spark, sf_dir), T.filings(spark, sf_dir), column(DAY))
    ends = lambda c, field: (F.get(c, F.lit(0))[field], F.get(c, F.size(c) - 1)[field])
    (s, e), (fs, fe) = ends("outcome_prices", "date"), ends("outcome_filings", "filed_at")
    return out.select("symbol", F.size("outcome_prices").cast("long").alias("n_prices"), s.alias("first_day"), e.alias("last_day"), F.bround("outcome_price", 8).alias("outcome_price"), F.size("outcome_filings").cast("long").alias("n_filings"), fs.alias("first_filed"), fe.alias("last_filed"))


_TOLD = {k: v.replace("{symbol}", "' || c.symbol || '").replace("{day}", f"' || strftime({D}, '%B %-d, %Y') || '").replace("{last}", "' || strftime(p.d, '%B %-d, %Y') || '").replace("{source}", "GDELT") for k, v in snapshot.MESSAGES.items()}


@query(T.oracle("bars", "filings", "news", "companies", known=news.KNOWN, p=f"SELECT symbol, max(date) AS d FROM bars WHERE date <= {D} AND {_N} % 5 <> 0 GROUP BY symbol", f=f"SELECT DISTINCT symbol FROM filings WHERE filed_at < {D} + INTERVAL 1 DAY AND {_N} % 4 <> 0", n=f"SELECT DISTINCT symbol FROM known WHERE {_N} % 7 <> 0") + f"""
SELECT c.symbol, array_to_string(list_filter([CASE WHEN p.d IS NULL THEN '{_TOLD["no prices"]}' WHEN p.d < {D} THEN '{_TOLD["market closed"]}' END, CASE WHEN f.symbol IS NULL THEN '{_TOLD["no filings"]}' END,
  CASE WHEN substr(c.symbol, 7)::INT % 4 = 0 THEN '{_TOLD["partial"]}' END, CASE WHEN n.symbol IS NULL THEN '{_TOLD["no news"]}' END], lambda x: x IS NOT NULL), ' ') AS warnings
FROM companies c LEFT JOIN p ON p.symbol = c.symbol LEFT JOIN f ON f.symbol = c.symbol LEFT JOIN n ON n.symbol = c.symbol""")
def p17_messages(spark, sf_dir):
    """What a snapshot warns of; prices of every fifth symbol and news of every seventh are missing, and the filings of every fourth failed."""
    k, day = _number(), column(DAY)
    rows = snapshot.assemble(T.companies(spark, sf_dir), T.bars(spark, sf_dir).where(k % 5 != 0), T.filings(spark, sf_dir).where(k % 4 != 0), news.known(spark, sf_dir).where(k % 7 != 0), day)
    rows = rows.withColumn("failed", F.when(k % 4 == 0, F.array(F.lit("filings"))))
    return snapshot.messages(rows, day, "GDELT").select("symbol", F.array_join("warnings", " ").alias("warnings"))


#: Keyword variations that the sample's words have, and the days back, more than the feature's seven as the sample's articles are few.
VARIED, BACK = ["than", "thing", "erent", "oui"], 365


@query(T.oracle("news", "relevance", "companies", known=news.KNOWN, **news.RULES, v=f"SELECT unnest({VARIED}) AS variation",
    h=f"SELECT n.symbol, v.variation, n.id, row_number() OVER (PARTITION BY n.symbol, v.variation ORDER BY n.published_at DESC, n.id) AS k FROM known n JOIN v ON contains(lower(concat_ws(' ', n.title, n.description)), v.variation) WHERE n.published_at >= {D} - {BACK} AND NOT (substr(n.symbol, 7)::INT % 6 = 0 AND v.variation = 'thing')",
    t="SELECT DISTINCT symbol, id FROM h WHERE k <= 20", x="SELECT t.symbol, t.id, rv.decision FROM t LEFT JOIN rv ON rv.id = t.id WHERE NOT EXISTS (SELECT 1 FROM relevance r WHERE r.article_id = t.id AND r.symbol = t.symbol)") + f"""
SELECT c.symbol, 4 - ({_N} % 6 = 0)::INT AS queries, count(x.id) AS candidates, count(x.id) FILTER (x.decision = 'RELEVANT') AS relevant, CASE WHEN {_N} % 6 = 0 THEN symbol || ' thing' ELSE '' END AS failed FROM companies c LEFT JOIN x USING (symbol) GROUP BY c.symbol""")
def a24_expansion_tally(spark, sf_dir):
    """Queries run, new candidates, and the relevant of them by the rules; one query of every sixth symbol has no answer."""
    rows, verdict = news._planted(spark, sf_dir)
    failed = T.companies(spark, sf_dir).where(_number() % 6 == 0).select("symbol", F.lit("thing").alias("variation"))
    out = documents.expansion_tally(T.companies(spark, sf_dir), news.known(spark, sf_dir), T.relevance(spark, sf_dir), rows.select("id", verdict["decision"].alias("decision")), failed, VARIED, F.date_sub(column(DAY), BACK).cast("timestamp"))
    return out.withColumn("failed", F.array_join("failed", ","))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id::VARCHAR AS id, count(*) AS n_entries, min(ts)::TIMESTAMP AS first_at, max(ts)::TIMESTAMP AS last_at, max(CASE WHEN back = 1 AND user_id % 3 <> 0 THEN 'complete' END) AS terminal FROM e GROUP BY user_id""")
def k10_job_tail(spark, sf_dir):
    """The log of jobs, written in three batches, as the tail sends it; a user's events are a job's entries, two thirds of the jobs have ended."""
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = T.table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"), "ts", F.col("event_type").alias("stage"))
    rows = rows.withColumn("seq", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(W.partitionBy("user_id")))
    last = (F.col("seq") == F.col("_n") - 1) & (F.col("user_id") % 3 != 0)
    entries = rows.select(F.col("user_id").cast("string").alias("id"), "seq", F.when(last, "complete").otherwise("stage").alias("kind"), "stage", "at", (F.col("event_id") % 3).alias("batch"))
    sent = tail.resent(entries, 3)
    return sent.groupBy("id").agg(F.count("*").alias("n_entries"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.max(F.when(F.col("kind").isin(*tail.TERMINAL), F.col("kind"))).alias("terminal"))
