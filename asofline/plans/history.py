"""Queries of the case registry, its index, composed signals, stored jobs, and the remaining payloads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.temporal import column
from ..operators import cases, documents, records, snapshot, threads, upsert
from ..sources import parsers, recorded
from ..sources import tables as T
from ..sinks import stores
from ..storage import kept, new_path
from . import casebook, lookups, news, topics
from .registry import query

VIEWS, CASES = casebook.VIEWS, casebook.CASES
_ID = "symbol || ':' || strftime(date, '%Y-%m-%d')"


@query(T.oracle(*VIEWS, "social", **CASES) + f"""SELECT {_ID} AS case_id, 'news' AS kind, k.id AS ref, k.published_at AS at, CASE WHEN trim(coalesce(description, '')) = '' THEN '' ELSE substr(description, 1, 500) END AS text FROM m JOIN admitted k USING (symbol) WHERE k.published_at::DATE <= m.date
UNION ALL SELECT {_ID}, 'filing', accession, filed_at, form_type FROM m JOIN filings USING (symbol) WHERE filed_at::DATE BETWEEN date - 30 AND date
UNION ALL SELECT {_ID}, 'social', id, created_at, community FROM m JOIN social USING (symbol) WHERE created_at::DATE BETWEEN date - 7 AND date""")
def h1_evidence_items(spark, sf_dir):
    """H1: what each case is frozen with, one row an item; texts are stored up to 500 characters."""
    return cases.evidence_items(news.top(spark, sf_dir), news.admitted(spark, sf_dir), T.filings(spark, sf_dir), T.social(spark, sf_dir))


CASE_SCHEMA = (
    "struct<daily_return_pct: double, score: double, flags: array<string>, sentiment_direction: string, sentiment_mean: double, threads: array<struct<thread: string, category: string, n_articles: bigint, dated: boolean>>, "
    "regime_path: array<struct<day: date, regime: string>>, reaction: array<struct<day: date, close: double>>, news_count: bigint, n_8k: bigint, n_10: bigint, n_filings: bigint, events: array<string>, relevance: double, "
    "filing_sentiment: double, projection: string, _broken: string>"
)


def _registry(spark, sf_dir):
    """Cases as JSON rows; those of every fifth symbol are broken or blank, those of every seventh of an older projection."""
    case = casebook.frozen(spark, sf_dir)
    k = F.substring("symbol", 7, 2).cast("int")
    old = case.withColumn("projection", F.when(k % 7 == 0, "hcp-v0").otherwise(F.col("projection")))
    return cases.to_registry(old).withColumn("body", F.when(k % 10 == 0, " ").when(k % 5 == 0, "{not json").otherwise(F.col("body")))


_K = "substr(symbol, 7)::INT"


@query(T.oracle(*VIEWS, **CASES) + f"SELECT case_id, n_threads, len(path) AS n_days, news_count FROM cs WHERE {_K} % 5 <> 0")
def h3_registry_read(spark, sf_dir):
    """H3: cases of stored JSON; a row that can't be read is none."""
    return cases.from_registry(_registry(spark, sf_dir), CASE_SCHEMA).select("case_id", F.size("threads").alias("n_threads"), F.size("regime_path").alias("n_days"), "news_count")


@query(T.oracle(*VIEWS, **CASES) + f"SELECT case_id, {_K} % 5 <> 0 AND {_K} % 7 <> 0 AS matches FROM cs")
def p14_frozen_and_live(spark, sf_dir):
    """Whether a recomputed case is the stored one."""
    return cases.matches_frozen(cases.from_registry(_registry(spark, sf_dir), CASE_SCHEMA), casebook.frozen(spark, sf_dir))


@query(T.oracle(*VIEWS, **CASES) + f"SELECT {_ID} AS case_id, {_K} % 2 = 1 AND {_K} % 3 <> 0 AND count(*) FILTER (filed_at::DATE < date - 30) = 0 AS clean FROM m LEFT JOIN filings USING (symbol) WHERE filed_at IS NULL OR filed_at::DATE BETWEEN date - 40 AND date GROUP BY symbol, date")
def p15_regulatory_clean(spark, sf_dir):
    """Filings of forty days (ten too many) against the window; every second symbol has the current method, every third but two tiers."""
    f = T.filings(spark, sf_dir).select("symbol", "filed_at")
    rows = news.top(spark, sf_dir).select("symbol", F.col("date").alias("peak")).join(f, "symbol", "left").where((F.col("filed_at").isNull()) | F.to_date("filed_at").between(F.date_sub("peak", 40), F.col("peak")))
    k = F.substring("symbol", 7, 2).cast("int")
    three = F.array(F.lit("very_close"), F.lit("recent"), F.lit("older"))
    rows = rows.select(F.concat_ws(":", "symbol", F.date_format("peak", "yyyy-MM-dd")).alias("case_id"), "filed_at", "peak", F.when(k % 2 == 1, cases.METHOD).otherwise("").alias("methodology"), F.when(k % 3 == 0, F.slice(three, 1, 2)).otherwise(three).alias("tiers"))
    return cases.regulatory_clean(rows, F.col("methodology"), F.col("tiers"))


_GUID = lambda x: f"(substr(md5({x}), 7, 2) || substr(md5({x}), 5, 2) || substr(md5({x}), 3, 2) || substr(md5({x}), 1, 2) || '-' || substr(md5({x}), 11, 2) || substr(md5({x}), 9, 2) || '-' || substr(md5({x}), 15, 2) || substr(md5({x}), 13, 2) || '-' || substr(md5({x}), 17, 4) || '-' || substr(md5({x}), 21, 12))"


@query(T.oracle("vectors") + f"SELECT {_GUID("'hype-threads|' || article_id")} AS point, article_id AS ref, 64::INT AS n FROM vectors WHERE article_id::INT % 10 <> 0")
def k9_vector_points(spark, sf_dir):
    """K9: points with fixed ids, written twice; every tenth vector has a dimension too few and is left out."""
    v = T.vectors(spark, sf_dir)
    rows = v.select(F.col("article_id").alias("ref"), F.when(F.col("article_id").cast("int") % 10 == 0, F.slice("vector", 1, 63)).otherwise(F.col("vector")).alias("vector"))
    once = upsert.vector_points(rows, "hype-threads", 64)
    return upsert.latest_wins(once, once, ["point"], ["ref"]).select("point", "ref", F.size("vector").alias("n"))


@query(T.oracle(*VIEWS, "vectors", **CASES, **casebook._HYB, **casebook._NARR) + f"""SELECT 'thread' AS kind, {_GUID("'hype-threads|' || id")} AS point, 64::INT AS n FROM (SELECT DISTINCT id FROM lib JOIN vectors ON article_id = id)
UNION ALL SELECT 'case', {_GUID("'hype-cases|' || case_id")}, len(v)::INT FROM hyb UNION ALL SELECT 'structural', {_GUID("'hype-structural|' || case_id")}, 96::INT FROM vec WHERE len(v) = 96""")
def h20_index(spark, sf_dir):
    """What is written for all cases: the vectors of all their threads' articles, and of each case, pooled from its qualified articles alone."""
    case = kept(cases.structural(cases.signals(casebook.frozen(spark, sf_dir))), "structural")
    articles_of = kept(casebook._case_articles(spark, sf_dir, case), "case_articles")
    ids = articles_of.select("id").distinct()
    articles = ids.join(T.vectors(spark, sf_dir).withColumnRenamed("article_id", "id"), "id").select(F.col("id").alias("ref"), "vector")
    whole = cases.hybrid(case, casebook._content(articles_of, T.vectors(spark, sf_dir))).select(F.col("case_id").alias("ref"), "vector")
    point = lambda rows, kind, prefix, n: upsert.vector_points(rows, prefix, n).select(F.lit(kind).alias("kind"), "point", F.size("vector").alias("n"))
    full, bare = point(whole, "case", "hype-cases", 160), point(whole, "case", "hype-cases", 96)
    return point(articles, "thread", "hype-threads", 64).unionByName(full).unionByName(bare).unionByName(point(case.select(F.col("case_id").alias("ref"), "vector"), "structural", "hype-structural", 96))


#: What each signal of the sample's cases asks with: all articles of the threads that trigger it, or where no thread does, those up to the peak.
_BY = "CASE f.signal " + " ".join(f"WHEN '{s}' THEN l.category IN ({', '.join(map(repr, c))})" + (" AND l.n_articles > 1" if s == "regulatory-overhang" else "") for s, c in casebook.TRIGGERS.items()) + " ELSE l.d <= l.peak END"
_ASKED = casebook.merged_sql("SELECT case_id || '|' || signal AS q, case_id FROM fi WHERE own", f"SELECT DISTINCT f.case_id || '|' || f.signal AS q, l.id FROM fi f JOIN libt l ON l.case_id = f.case_id WHERE f.own AND {_BY}")
_SIGNALS = {
    "libt": casebook._NARR["lib"].replace("SELECT DISTINCT ", "SELECT DISTINCT t.category, t.n_articles, ", 1), **_ASKED,
    "best": "SELECT q, case_id AS best_case, similarity AS best_similarity, kind AS best_kind FROM res QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank) = 1", "found": "SELECT q, count(*) AS n_resembling FROM res GROUP BY q",
    "told": "SELECT a.case_id, a.symbol, a.signal, aft.n_supporters, aft.n AS n_after, aft.median, best_case, best_similarity, best_kind, coalesce(n_resembling, 0) AS n_resembling FROM fi a JOIN aft ON aft.case_id = a.case_id AND aft.signal = a.signal LEFT JOIN best ON best.q = a.case_id || '|' || a.signal LEFT JOIN found ON found.q = a.case_id || '|' || a.signal WHERE a.own",
}
_EVIDENCE = {
    "ctx": "SELECT m.symbol || ':' || strftime(m.date, '%Y-%m-%d') AS case_id, t.thread, t.category, t.n_articles FROM m JOIN thr t ON m.symbol = t.symbol AND (t.undated OR t.e >= m.date - 20 AND t.s <= m.date)",
    "tns": "SELECT m.symbol || ':' || strftime(m.date, '%Y-%m-%d') AS case_id, count(*) AS n, min(r.date) AS s, max(r.date) AS e FROM m JOIN regimes r ON m.symbol = r.symbol AND r.date BETWEEN m.date - 20 AND m.date WHERE r.regime = 'tense' GROUP BY ALL",
    "ev": f"""SELECT f.case_id, f.signal, l.category || ' thread: ' || l.thread AS text, l.n_articles AS size FROM fi f JOIN ctx l ON l.case_id = f.case_id WHERE f.own AND {_BY.replace("ELSE l.d <= l.peak END", "ELSE false END")}
      UNION ALL SELECT f.case_id, signal, 'tense regime on ' || n || ' pre-peak days (' || strftime(s, '%Y-%m-%d') || '→' || strftime(e, '%Y-%m-%d') || ')', 0 FROM fi f JOIN tns USING (case_id) WHERE own AND signal = 'regulatory-overhang'
      UNION ALL SELECT f.case_id, signal, unnest(['peak flags: ' || array_to_string(string_split(flags, ','), ', '), 'only ' || news_count || ' pre-peak news item(s) in move evidence']), 0 FROM fi f JOIN sg ON sg.case_id = f.case_id WHERE signal = 'volume-first-divergence'
      UNION ALL SELECT case_id, signal, 'scored pre-peak news leans against the price move (contrarian divergence)', 0 FROM fi WHERE own AND signal = 'sentiment-split'
      UNION ALL SELECT case_id, signal, 'regime path shifts warming→tense inside the pre-peak window', 0 FROM fi WHERE own AND signal = 'supply-tremor'""",
}


def composed(spark, sf_dir):
    """case_id, symbol, signal, n_supporters, n_after, median, best_case, best_similarity, best_kind, n_resembling of every case and signal that fires in it.

    Supporters, aftermath and resemblance are of the registry; resemblance is asked with the articles of the threads that trigger the signal,
    as their thread lists them, or where no thread does, with all articles up to the peak.
    """
    library = casebook.registry(spark, sf_dir)
    fired = kept(library.where("own").select("case_id", "symbol", "peak", F.explode("fired").alias("signal")).withColumn("q", F.concat_ws("|", "case_id", "signal")), "fired")
    articles = kept(casebook._case_articles(spark, sf_dir, library.where("own")), "case_articles")
    wanted = fired.select("q", "case_id", "signal").join(articles, "case_id").where(cases.triggers(F.col("signal"), F.col("category"), F.col("n_articles"), F.col("day") <= F.col("peak"), casebook.TRIGGERS)).select("q", "id")
    hits = kept(casebook.resemblance(spark, sf_dir, library, fired.select("q", "case_id"), articles, wanted), "hits")
    best = hits.groupBy("q").agg(F.min_by(F.struct("case_id", "similarity", "kind"), "rank").alias("_b"), F.count("*").alias("n_resembling"))
    best = best.select("q", F.col("_b.case_id").alias("best_case"), F.col("_b.similarity").alias("best_similarity"), F.col("_b.kind").alias("best_kind"), "n_resembling")
    after = cases.aftermath(library).select("case_id", "signal", F.col("n").alias("n_after"), "median")
    out = fired.join(cases.supporters(library), ["case_id", "signal"]).join(after, ["case_id", "signal"]).join(best, "q", "left")
    return out.select("case_id", "symbol", "signal", "n_supporters", "n_after", "median", "best_case", "best_similarity", "best_kind", F.coalesce("n_resembling", F.lit(0)).alias("n_resembling"))


_LIBRARY = casebook._LVEC | casebook._HYB | casebook._NARR


@query(T.oracle(*VIEWS, "vectors", **CASES, **_LIBRARY, **_SIGNALS) + "SELECT * EXCLUDE (symbol) FROM told")
def h21_signals(spark, sf_dir):
    """Moves, topics, cases, signals, supporters, aftermath and resemblance of all peaks at once."""
    return composed(spark, sf_dir).drop("symbol")


@query(T.oracle(*VIEWS, **CASES, **casebook.LIBRARY, **_EVIDENCE) + "SELECT * FROM ev")
def h21_trigger_evidence(spark, sf_dir):
    """What each signal that fires is told with: its threads (their name stands for the title) with their size, or the numbers behind it."""
    return cases.trigger_evidence(cases.signals(casebook.frozen(spark, sf_dir)), casebook.TRIGGERS)


@query(T.oracle(*VIEWS, **CASES) + f"SELECT case_id, CASE WHEN {_K} % 5 <> 0 AND {_K} % 7 <> 0 THEN '' ELSE 'Recomputed now — may differ from frozen registry record.' END AS note FROM cs WHERE {_K} % 3 <> 0 UNION ALL SELECT case_id, '' FROM cs WHERE {_K} % 3 = 0")
def h21_recomputed_notes(spark, sf_dir):
    """A case whose frozen row differs says so; where there is no row, as of every third symbol, nothing is said.  A row that can't be read differs."""
    rows = _registry(spark, sf_dir).where(F.substring("symbol", 7, 2).cast("int") % 3 != 0)
    return cases.recomputed_notes(rows, cases.from_registry(rows, CASE_SCHEMA), casebook.frozen(spark, sf_dir))


SWEPT = ("Brand#1", "Brand#4", "Brand#7", "Brand#13", "Brand#22", "NONE")


@query(T.oracle(*VIEWS, **CASES, w=f"SELECT unnest({list(SWEPT)}) AS symbol") + "SELECT w.symbol, CASE WHEN count(sg.case_id) > 0 THEN 'ok' ELSE 'no moves' END AS status, count(sg.case_id) AS n_cases, coalesce(sum(len(fired)), 0)::BIGINT AS n_fired FROM w LEFT JOIN sg ON sg.symbol = w.symbol GROUP BY w.symbol")
def h22_sweep(spark, sf_dir):
    """Up to eight asked symbols as of one date; a symbol without data has a row that says so, and breaks no other."""
    asked = spark.createDataFrame([(s,) for s in snapshot.symbols(",".join(SWEPT))], "_s string")
    case = cases.signals(casebook.frozen(spark, sf_dir)).groupBy(F.upper("symbol").alias("_s")).agg(F.first("symbol").alias("symbol"), F.count("*").alias("n_cases"), F.sum(F.size("fired")).alias("n_fired"))
    name = F.coalesce("symbol", F.when(F.col("_s") == "NONE", "NONE").otherwise(F.initcap("_s")))
    return asked.join(case, "_s", "left").select(name.alias("symbol"), F.when(F.col("n_cases") > 0, "ok").otherwise("no moves").alias("status"), F.coalesce("n_cases", F.lit(0)).alias("n_cases"), F.coalesce("n_fired", F.lit(0)).alias("n_fired"))


_TEN = {k: v.replace("rank <= 5", "rank <= 10") for k, v in CASES.items()}


@query(T.oracle(*VIEWS, **_TEN) + "SELECT case_id, peak, len(fired) AS n_fired, n_threads FROM sg")
def h23_harvest(spark, sf_dir):
    """Ten peaks a symbol instead of five, frozen all."""
    return cases.signals(casebook.frozen(spark, sf_dir, 10)).select("case_id", "peak", F.size("fired").alias("n_fired"), F.size("threads").alias("n_threads"))


@query(T.oracle(*VIEWS, **CASES, **casebook._VEC) + f"SELECT case_id, count(*) AS n, round_even(sum(x), 6) AS total FROM (SELECT case_id, unnest(v) AS x FROM vec WHERE {_K} % 5 <> 0) WHERE x <> 0 GROUP BY case_id")
def h25_reindex(spark, sf_dir):
    """Vectors made again from the registry's rows; those that can't be read are passed over."""
    v = cases.structural(cases.signals(cases.from_registry(_registry(spark, sf_dir), CASE_SCHEMA)))
    return v.select("case_id", F.explode("vector").alias("x")).where("x <> 0").groupBy("case_id").agg(F.count("*").alias("n"), F.bround(F.sum("x"), 6).alias("total"))


@query(T.oracle(*VIEWS, **CASES, j="SELECT symbol, date, count(*) AS n, bool_and(accession IN (SELECT accession FROM fsum)) AS every FROM m JOIN filings USING (symbol) WHERE filed_at::DATE BETWEEN date - 30 AND date GROUP BY symbol, date") + f"SELECT {_ID} AS case_id, CASE WHEN j.n IS NULL THEN 0 WHEN j.every THEN j.n END::DOUBLE AS n_reused FROM m LEFT JOIN j USING (symbol, date)")
def h30_stored_summaries(spark, sf_dir):
    """Stored summaries of a case's filings are used only if there is one for each; a case without filings needs none."""
    items = cases.evidence_items(news.top(spark, sf_dir), parsers.no_news(spark), T.filings(spark, sf_dir), T.social(spark, sf_dir).where("false")).select("case_id", F.col("ref").alias("accession"))
    known = lookups.summaries(spark, sf_dir).select("accession", F.lit(True).alias("_known"))
    both = items.join(known, "accession", "left").groupBy("case_id").agg(F.count("*").alias("_n"), F.every(F.coalesce("_known", F.lit(False))).alias("_every"))
    all_ = news.top(spark, sf_dir).select(F.concat_ws(":", "symbol", F.date_format("date", "yyyy-MM-dd")).alias("case_id"))
    return all_.join(both, "case_id", "left").select("case_id", F.when(F.col("_n").isNull(), F.lit(0).cast("long")).when(F.col("_every"), F.col("_n")).cast("double").alias("n_reused"))


_WHITE = [c for c in T.CATEGORIES if c != "REPUTATIONAL"]


@query(T.oracle("news", "relevance", mem=topics.MEMBERS, tc=CASES["tc"]) + f"SELECT symbol, thread, category FROM tc WHERE category IN ({', '.join(repr(c) for c in _WHITE)})")
def p8_brief_threads(spark, sf_dir):
    """Threads that a brief may tell of, by their main category."""
    return records.brief_threads(threads.main_category(topics.members(spark, sf_dir)).withColumnRenamed("top_category", "category"))


@query()
def p8_brief_news(spark, sf_dir):
    """Articles that the rules call relevant; the company's name, and two terms in every third, are planted, and the whole title and description are judged."""
    rows = T.news(spark, sf_dir).join(T.companies(spark, sf_dir).select("symbol", "name"), "symbol")
    judged = X.judge(F.concat(F.col("name"), F.when(F.col("id").cast("int") % 3 == 0, " take over and Revenue ").otherwise(" "), F.coalesce("title", F.lit(""))), F.col("description"), F.col("symbol"), F.col("name"))
    return rows.select("id", judged.alias("v")).where("v.decision = 'RELEVANT'").select("id", "v.category", "v.term")


# Payloads


def _directory(spark, sf_dir):
    c = T.companies(spark, sf_dir)
    entry = F.struct(F.lower("symbol").alias("key"), F.struct("name", "cik").alias("value"))
    part = c.groupBy(F.expr("left(lpad(cik, 10, '0'), 8)").alias("_part"))  # objects of at most a hundred numbers each
    return parsers.directory(part.agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("body")).select("body"))


@query(T.oracle("companies") + "SELECT upper(symbol) AS symbol, name, lpad(cik, 10, '0') AS cik FROM companies")
def s10_directory(spark, sf_dir):
    """The directory object as rows."""
    return _directory(spark, sf_dir)


@query(T.oracle("companies", d="SELECT upper(symbol) AS symbol, name, 0 AS o FROM companies WHERE substr(symbol, 7)::INT % 2 = 0 AND (contains(lower(symbol), '1') OR contains(lower(name), '1')) ORDER BY symbol LIMIT 10",
    s="SELECT upper(symbol) AS symbol, 'Stored ' || name AS name, 1 AS o FROM companies WHERE contains(lower(symbol), '1') OR contains(lower('Stored ' || name), '1')", u="SELECT * FROM d UNION ALL SELECT * FROM s", k="SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY o) = 1") + "SELECT symbol, name FROM k QUALIFY row_number() OVER (ORDER BY o, symbol) <= 10")
def s11_federated_search(spark, sf_dir):
    """The directory's hits before the stored companies', each symbol once, ten."""
    d = _directory(spark, sf_dir).where(F.substring("symbol", 7, 2).cast("int") % 2 == 0).select("symbol", "name")
    stored = T.companies(spark, sf_dir).select(F.upper("symbol").alias("symbol"), F.concat(F.lit("Stored "), "name").alias("name"))
    return snapshot.federated(d, stored, "1").select("symbol", "name")


@query(T.oracle("companies") + "SELECT symbol, name FROM companies WHERE cik = '0000000012'")
def s9_by_number(spark, sf_dir):
    """A company by its number, given without the leading zeros."""
    return snapshot.by_number(T.companies(spark, sf_dir), "12").select("symbol", "name")


@query(T.oracle("companies") + "SELECT upper(symbol) AS symbol, name, cik, exchange, sector FROM companies WHERE substr(symbol, 7)::INT % 4 <> 0")
def s16_company_profile(spark, sf_dir):
    """filers' records; every fourth has no ticker and is none."""
    c = T.companies(spark, sf_dir)
    tickers = F.when(F.substring("symbol", 7, 2).cast("int") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lower("symbol"), F.lit("other")))
    body = F.to_json(F.struct("name", tickers.alias("tickers"), F.array("exchange").alias("exchanges"), F.col("sector").alias("sicDescription")))
    return parsers.company_profile(c.select(F.ltrim(F.col("cik"), F.lit("0")).alias("cik"), body.alias("body")))


@query(T.oracle("companies") + "SELECT upper(symbol) AS symbol, name, cik, exchange, '' AS industry FROM companies WHERE substr(symbol, 7)::INT % 3 <> 0")
def s16b_fallback_profile(spark, sf_dir):
    """The second provider's records; an unknown symbol's is an empty object."""
    c = T.companies(spark, sf_dir)
    body = F.when(F.substring("symbol", 7, 2).cast("int") % 3 == 0, "{}").otherwise(F.to_json(F.struct("name", "exchange", "cik")))
    return parsers.fallback_profile(c.select(F.concat(F.lit(" "), F.lower("symbol")).alias("symbol"), body.alias("body")))



@query(T.oracle("news") + "SELECT symbol, 'gdc-' || substr(sha256(lower(trim(url))), 1, 32) AS id, published_at::DATE::TIMESTAMP AS published_at FROM news WHERE substr(symbol, 7)::INT % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY symbol, published_at::DATE ORDER BY url) <= 100")
def s19_entity_stories(spark, sf_dir):
    """The articles of each day's stories, dated by the day; where the entity has another ticker there are none."""
    n = T.news(spark, sf_dir).withColumn("day", F.date_format("published_at", "yyyy-MM-dd"))
    stories = n.groupBy("symbol", "day").agg(F.struct("day", F.collect_list(F.struct("url", "title")).alias("top_articles")).alias("_s"))  # a story of a day
    ticker = F.when(F.substring("symbol", 7, 2).cast("int") % 4 == 0, "OTHER").otherwise(F.lower("symbol"))
    body = F.to_json(F.struct(F.struct(F.array(ticker).alias("tickers")).alias("entity"), F.array(F.struct(F.col("_s.day").alias("date"), F.col("_s.top_articles").alias("top_articles"))).alias("stories")))
    return parsers.entity_stories(stories.select("symbol", body.alias("body"))).select("symbol", "id", "published_at")


@query(T.oracle("news", f="SELECT *, row_number() OVER (PARTITION BY symbol, published_at::DATE ORDER BY published_at, id) AS k, (id::INT * 37 % 301 - 150) / 100 AS x FROM news") + "SELECT 'avnews-' || substr(sha256(lower(trim(url))), 1, 32) AS id, published_at, CASE WHEN x BETWEEN -1 AND 1 THEN round_even(x, 4) END AS sentiment_score FROM f WHERE k <= 50")
def s21_feed_sentiment(spark, sf_dir):
    """Scores as text, kept from -1 to 1; of each payload the first 50 entries, the feature's limit."""
    n = T.news(spark, sf_dir)
    score = F.format_string("%.2f", (F.col("id").cast("int") * 37 % 301 - 150) / 100)
    item = F.struct("published_at", "id", F.struct("url", "title", F.date_format("published_at", "yyyyMMdd'T'HHmmss").alias("time_published"), score.alias("overall_sentiment_score")).alias("e"))
    lists = n.groupBy("symbol", F.to_date("published_at").alias("day")).agg(F.sort_array(F.collect_list(item)).alias("_x"))
    raw = lists.select(F.to_json(F.struct(F.transform("_x", lambda x: x["e"]).alias("feed"))).alias("body"))
    return parsers.feed_sentiment(raw, 50).select("id", "published_at", F.bround("sentiment_score", 4).alias("sentiment_score"))


@query(T.oracle("social") + "SELECT id, community, created_at, score FROM social WHERE created_at BETWEEN TIMESTAMP '1998-01-05' AND TIMESTAMP '1998-01-20' QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 6")
def s22_posts(spark, sf_dir):
    """The six posts of the highest score in a range of time; payloads of a community and hour."""
    s = T.social(spark, sf_dir)
    item = F.struct("id", F.col("community").alias("subreddit"), F.lit("t").alias("title"), F.lit("").alias("selftext"), F.unix_micros("created_at").cast("double").alias("_m"), "score")
    lists = s.groupBy("community", F.date_trunc("hour", "created_at").alias("_h")).agg(F.collect_list(item).alias("_x"))
    raw = lists.select(F.to_json(F.struct(F.transform("_x", lambda x: F.struct(x["id"].alias("id"), x["subreddit"].alias("subreddit"), x["title"].alias("title"), x["selftext"].alias("selftext"), (x["_m"] / 1e6).alias("created_utc"), x["score"].alias("score"))).alias("data"))).alias("body"))
    return parsers.posts(raw, F.lit("1998-01-05").cast("timestamp"), F.lit("1998-01-20").cast("timestamp")).select("id", "community", "created_at", "score")


_FOLDER = "CASE page_id % 4 WHEN 0 THEN ['index.htm', 'R1.htm', 'main-' || page_id || '.htm', 'other.htm'] WHEN 1 THEN ['nav.html', 'index.txt', 'full-' || page_id || '.txt'] WHEN 2 THEN ['data.xml'] ELSE NULL END"


def _folders(spark, sf_dir):
    """Folder listings for the sample's pages; every fourth can't be read."""
    p = T.table(spark, sf_dir, "pages")
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    page, text = F.concat(F.lit("main-"), n, F.lit(".htm")), F.concat(F.lit("full-"), n, F.lit(".txt"))
    names = F.when(k == 0, F.array(F.lit("index.htm"), F.lit("R1.htm"), page, F.lit("other.htm"))).when(k == 1, F.array(F.lit("nav.html"), F.lit("index.txt"), text)).otherwise(F.array(F.lit("data.xml")))
    body = F.when(k == 3, "{broken").otherwise(F.to_json(F.struct(F.struct(F.transform(names, lambda x: F.struct(x.alias("name"))).alias("item")).alias("directory"))))
    return p.select(n.alias("accession"), body.alias("body"), F.when(k == 0, page).otherwise(text).alias("_file"), "html")


@query("SELECT page_id::VARCHAR AS accession, CASE page_id % 4 WHEN 0 THEN 'main-' || page_id || '.htm' WHEN 1 THEN 'full-' || page_id || '.txt' END AS name FROM pages")
def s26_primary_document(spark, sf_dir):
    """The main document of each folder listing; null where there is none or the listing can't be read."""
    return _folders(spark, sf_dir).select("accession", parsers.primary_document(parsers.folder_names(F.col("body"))).alias("name"))


@query(f"SELECT page_id::VARCHAR AS accession, CASE page_id % 4 WHEN 0 THEN 'main-' || page_id || '.htm' ELSE 'full-' || page_id || '.txt' END AS name, {topics._STRIP} AS text FROM pages WHERE page_id % 4 < 2")
def s25_filing_documents(spark, sf_dir):
    """Each filing's main document without markup (pages stand in); the feature's limit is 1,500,000 characters."""
    f = _folders(spark, sf_dir)
    return parsers.filing_documents(f.select("accession", "body"), f.select("accession", F.col("_file").alias("name"), "html"))


@query(T.oracle("news") + "SELECT id, symbol FROM news")
def s27_null_source(spark, sf_dir):
    """A source that isn't configured beside a fixed one."""
    return parsers.no_news(spark).unionByName(T.news(spark, sf_dir)).select("id", "symbol")


@query(T.oracle("news") + "SELECT 'gdelt-' || substr(sha256(lower(trim(url))), 1, 32) AS id, published_at FROM news WHERE published_at::DATE BETWEEN DATE '1998-02-01' AND DATE '1998-02-08' QUALIFY row_number() OVER (PARTITION BY published_at::DATE ORDER BY 'gdelt-' || substr(sha256(lower(trim(url))), 1, 32)) <= 20")
def s17_daily_limit(spark, sf_dir):
    """At most twenty articles a day, the feature's own limit."""
    n = T.news(spark, sf_dir)
    item = F.struct("url", "title", F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.lit("x").alias("domain"))
    raw = n.groupBy("symbol", F.to_date("published_at").alias("day")).agg(F.to_json(F.struct(F.collect_list(item).alias("articles"))).alias("body"))
    return parsers.keyword_articles(raw, column("1998-02-08"), most=20).select("id", "published_at")


#: Slices of the sample's recorded answers, in SQL: pages of two articles, every ninth day's first page broken, every seventh day not recorded.
_SLICES = {
    "rec": "SELECT symbol, published_at::DATE AS day, id, url, title, published_at, row_number() OVER (PARTITION BY symbol, published_at::DATE ORDER BY published_at, id) - 1 AS k FROM news WHERE published_at::DATE BETWEEN DATE '1998-01-20' AND DATE '1998-02-08' AND dayofyear(published_at) % 7 <> 0",
    "ask": "SELECT symbol, d::DATE AS day FROM (SELECT DISTINCT symbol FROM companies), range(DATE '1998-01-20', DATE '1998-02-09', INTERVAL 1 DAY) t(d)",
    "sl": "SELECT symbol, day, count(*) AS n, dayofyear(day) % 9 = 0 AS broken FROM rec GROUP BY ALL",
}


def _recorded(spark, sf_dir):
    """The sample's articles as answers of a provider, recorded in a folder: pages of two articles, each day."""
    path = new_path(spark, "recorded")
    n = T.news(spark, sf_dir).withColumn("day", F.to_date("published_at")).where(F.dayofyear("day") % 7 != 0)
    place = F.row_number().over(W.partitionBy("symbol", "day").orderBy("published_at", "id")) - 1
    item = F.struct("url", "title", F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"))
    pages = n.withColumn("_k", place).groupBy("symbol", "day", F.floor(F.col("_k") / 2).cast("int").alias("page")).agg(F.sort_array(F.collect_list(F.struct("_k", item.alias("e")))).alias("_x"))
    body = F.to_json(F.struct(F.transform("_x", lambda x: x["e"]).alias("articles")))
    recorded.record(pages.select("symbol", "day", "page", F.when((F.col("page") == 0) & (F.dayofyear("day") % 9 == 0), "{broken").otherwise(body).alias("body")), path)
    return path


@query(T.oracle("news", "companies", **_SLICES) + "SELECT a.symbol, a.day, CASE WHEN sl.n IS NULL THEN 'missing' WHEN broken THEN 'failed' ELSE 'ok' END AS status, CASE WHEN sl.n IS NULL OR broken THEN 0 ELSE least(n, 20) END AS n_articles FROM ask a LEFT JOIN sl ON sl.symbol = a.symbol AND sl.day = a.day")
def s17_slice_status(spark, sf_dir):
    """How each slice of an interval went, for all symbols: days that weren't recorded are missing, and one with a broken page fails by itself."""
    names = [r.symbol for r in T.companies(spark, sf_dir).select("symbol").collect()]  # the symbols of the request
    return recorded.traversed(spark, _recorded(spark, sf_dir), recorded.KEYWORDS, names, "1998-02-08", 19)[1]


@query(T.oracle("news", "companies", **_SLICES) + "SELECT rec.symbol, 'gdelt-' || substr(sha256(lower(trim(url))), 1, 32) AS id, published_at FROM rec JOIN sl ON sl.symbol = rec.symbol AND sl.day = rec.day WHERE NOT broken AND k < 20")
def s17_traversed(spark, sf_dir):
    """The articles of the good slices, up to twenty each."""
    names = [r.symbol for r in T.companies(spark, sf_dir).select("symbol").collect()]
    return recorded.traversed(spark, _recorded(spark, sf_dir), recorded.KEYWORDS, names, "1998-02-08", 19)[0].select("symbol", "id", "published_at")


# Stored rows

_JOB = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'running' ELSE 'completed' END AS status, ts::TIMESTAMP AS created, ts::TIMESTAMP + INTERVAL 30 MINUTE AS updated FROM events"


@query(f"WITH j AS ({_JOB}), s AS (SELECT event_id, unnest([10, 20, 40]) AS k FROM events), l AS (SELECT j.event_id, string_agg('stage ' || k, ',' ORDER BY k) AS stages FROM j JOIN s USING (event_id) WHERE status = 'running' OR k <= 30 GROUP BY j.event_id) SELECT event_id AS id, status, updated, stages, CASE WHEN status <> 'running' THEN 'payload 2' END AS payload FROM j JOIN l USING (event_id)")
def s13_jobs(spark, sf_dir):
    """Jobs with their stages and payload; a stage after the end isn't appended, a running job keeps no payload."""
    e = T.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created"))
    jobs = e.select("id", F.when(F.col("id") % 3 == 0, "running").otherwise("completed").alias("status"), "created", (F.col("created") + F.expr("interval 30 minutes")).alias("updated"))
    stages = e.select("id", "created", F.explode(F.array(F.lit(10), F.lit(20), F.lit(40))).alias("_k")).select("id", F.timestamp_micros(F.unix_micros("created") + F.col("_k").cast("long") * 60_000_000).alias("at"), F.concat(F.lit("stage "), F.col("_k").cast("string")).alias("stage"))
    told = e.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("_k"), "created").select("id", F.timestamp_micros(F.unix_micros("created") + F.col("_k").cast("long") * 1_000_000).alias("at"), F.concat(F.lit("payload "), F.col("_k").cast("string")).alias("payload"))
    out = upsert.with_payload(upsert.with_stages(jobs, stages), told)
    return out.select("id", "status", "updated", F.array_join("stages", ",").alias("stages"), "payload")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN 'renamed' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 5 <> 2 UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 50 = 0""")
def k12_person_changes(spark, sf_dir):
    """Persons added, updated and deleted; the last change of a key counts, an update of an unknown one does nothing."""
    c = T.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey") % 5
    change = lambda rows, op, at, name: rows.select("c_custkey", F.lit(name).alias("c_name"), F.lit(op).alias("op"), F.lit(at).alias("at"))
    other = c.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    told = change(c.where(k == 1), "update", 2, "renamed").unionByName(change(c.where(k == 1), "delete", 1, "")).unionByName(change(c.where(k == 2), "delete", 1, "")).unionByName(change(other, "add", 1, "new"))
    told = told.unionByName(change(other.withColumn("c_custkey", F.col("c_custkey") + 1), "update", 1, "nobody")).unionByName(change(c.where(k == 3), "add", 1, "known already"))
    return upsert.applied(c, told, "c_custkey")


@query("WITH r AS (SELECT CASE WHEN event_id % 2 = 0 THEN lower(event_type) ELSE upper(event_type) END AS symbol, ts::DATE AS day, ts::TIMESTAMP AS \"at\", event_id AS id FROM events WHERE event_id % 9 <> 0) SELECT upper(symbol) AS symbol, day, \"at\" FROM r QUALIFY row_number() OVER (PARTITION BY upper(symbol), day ORDER BY \"at\" DESC) = 1 ORDER BY \"at\" DESC LIMIT 12")
def k14_recent(spark, sf_dir):
    """The newest investigations, each symbol, date and source once."""
    e = T.table(spark, sf_dir, "events")
    n = F.col("event_id")
    symbol = F.when(n % 9 == 0, "").when(n % 2 == 0, F.lower("event_type")).otherwise(F.upper("event_type"))
    rows = e.select(symbol.alias("symbol"), F.to_date("ts").alias("date"), F.lit("gdelt").alias("source"), F.col("ts").cast("timestamp").alias("at"))
    return upsert.recent(rows).select(F.upper("symbol").alias("symbol"), F.col("date").alias("day"), "at")


@query(T.oracle("news", f="SELECT id, title FROM news WHERE id::INT % 2 = 0", i="SELECT id, 'again' AS title FROM news WHERE id::INT % 3 = 0") + "SELECT * FROM f UNION ALL SELECT * FROM i WHERE id NOT IN (SELECT id FROM f)")
def k2_insert_news(spark, sf_dir):
    """K2: articles are inserted by id; a known one stays as it is, and one of a blank id isn't taken."""
    n = T.news(spark, sf_dir).select("id", "title")
    k = F.col("id").cast("int")
    inc = n.where(k % 3 == 0).withColumn("title", F.lit("again"))
    blank = inc.limit(1).withColumn("id", F.lit(""))
    return upsert.insert_new(n.where(k % 2 == 0), inc.unionByName(blank), ["id"], ["title"])


@query(T.oracle("sentiment") + "SELECT article_id, CASE WHEN article_id::INT % 3 = 0 THEN 0.5 ELSE score END AS score FROM sentiment")
def k6_sentiment_upsert(spark, sf_dir):
    """K6: scores by article, the last one wins."""
    s = T.sentiment(spark, sf_dir).select("article_id", "score", F.lit(0).alias("at"))
    inc = s.where(F.col("article_id").cast("int") % 3 == 0).withColumns({"score": F.lit(0.5), "at": F.lit(2)})
    return upsert.latest_wins(s, inc.unionByName(inc.withColumns({"score": F.lit(0.1), "at": F.lit(1)})), ["article_id"], ["at"]).select("article_id", "score")


@query(T.oracle("vectors") + "SELECT article_id, CASE WHEN article_id::INT % 4 = 0 THEN 2 ELSE 64 END::INT AS n FROM vectors")
def k7_vector_cache(spark, sf_dir):
    """K3: cached vectors by article, the last one wins."""
    v = T.vectors(spark, sf_dir).withColumn("at", F.lit(0))
    inc = v.where(F.col("article_id").cast("int") % 4 == 0).withColumns({"vector": F.slice("vector", 1, 2), "at": F.lit(1)})
    return upsert.latest_wins(v, inc, ["article_id"], ["at"]).select("article_id", F.size("vector").alias("n"))


_SAVED = {"m5": f"SELECT {_ID} AS case_id, symbol, date AS peak, round_even(daily_return_pct, 2) AS r, {_K} AS k FROM m"}


def _stored_cases(spark, sf_dir):
    """The store of the sample's cases, saved one after another: first all, then those of every second symbol again, with other values under another symbol, twice."""
    store = stores.cases(spark, new_path(spark, "case_store"))
    k = F.substring("symbol", 7, 2).cast("int")
    first = news.top(spark, sf_dir).select(
        F.concat_ws(":", "symbol", F.date_format("date", "yyyy-MM-dd")).alias("case_id"), "symbol", F.col("date").alias("peak"), F.timestamp_add("MINUTE", k, F.col("date").cast("timestamp")).alias("created_at"), F.lit(casebook.DAY).cast("date").alias("decision_date"),
        F.lit("gdelt").alias("news_source"), F.lit(1.0).alias("score"), F.col("daily_return_pct").cast("double").alias("daily_return_pct"), F.lit("").alias("flags"), F.lit("unknown").alias("sentiment_direction"), F.lit("partial").alias("completeness"), F.lit("{}").alias("body"), k.alias("_k"),
    )
    first = kept(first, "cases")
    store.write(first.drop("_k"), "first")
    again = first.where("_k % 2 = 0").drop("_k").withColumns({"symbol": F.lit("OTHER"), "peak": F.date_add("peak", 1), "created_at": F.timestamp_add("DAY", F.lit(1), F.col("created_at")), "score": F.lit(2.0), "completeness": F.lit("full")})
    store.write(again, "again")
    store.write(again.withColumn("score", F.lit(3.0)), "again")  # the same write, tried again: nothing happens
    return store.read()


@query(T.oracle("bars", **news.MOVES, **_SAVED) + "SELECT case_id, symbol, peak, CASE WHEN k % 2 = 0 THEN 2.0 ELSE 1.0 END AS score, CASE WHEN k % 2 = 0 THEN 'full' ELSE 'partial' END AS completeness, peak + to_minutes(k) AS created_at FROM m5")
def k7_case_upsert(spark, sf_dir):
    """K7: a case that is saved again keeps its symbol, its peak and when it was made; written through the versioned store."""
    return _stored_cases(spark, sf_dir).select("case_id", "symbol", "peak", "score", "completeness", "created_at")


@query(T.oracle("bars", **news.MOVES, **_SAVED) + "SELECT case_id, peak + to_minutes(k) AS created_at FROM m5 ORDER BY created_at DESC, case_id LIMIT 50")
def s12_recent_cases(spark, sf_dir):
    """The fifty cases that were made last, from the store."""
    return stores.recent_cases(_stored_cases(spark, sf_dir)).select("case_id", "created_at")


@query(T.oracle("filings", fsum=lookups.SUMMARIES) + "SELECT accession, event_type, CASE WHEN accession::BIGINT % 3 = 0 THEN 0.25 ELSE relevance END AS relevance FROM fsum")
def k6_filing_summaries(spark, sf_dir):
    """K6: structured summaries by filing number, the last one wins; written through the versioned store."""
    store = stores.filing_summaries(spark, new_path(spark, "summary_store"))
    at = lambda day: F.lit(day).cast("timestamp").alias("at")
    rows = kept(lookups.summaries(spark, sf_dir).select("accession", "event_type", F.col("relevance").cast("double").alias("relevance"), F.col("sentiment").cast("double").alias("sentiment"), at("2026-01-01")), "summaries")
    store.write(rows)
    new = rows.where(F.col("accession").cast("bigint") % 3 == 0).withColumns({"relevance": F.lit(0.25), "at": F.lit("2026-01-03").cast("timestamp")})
    store.write(new.unionByName(new.withColumns({"relevance": F.lit(0.75), "at": F.lit("2026-01-02").cast("timestamp")})))
    return store.read().select("accession", "event_type", "relevance")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 30")
def l11_dynamic_sort(spark, sf_dir):
    """The order that a request names; the first thirty."""
    c = T.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return snapshot.ordered_by(c, "c_acctbal", True, ("c_name", "c_acctbal", "c_mktsegment"), "c_custkey").limit(30)


@query(T.oracle("news", "relevance", m=topics.MEMBERS, t="SELECT symbol, thread, count(*) AS n FROM m GROUP BY ALL HAVING count(*) > 1", r="SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, thread) AS rank FROM t") + """
SELECT r.symbol, r.thread, rank, m.id, row_number() OVER (PARTITION BY m.symbol, m.thread ORDER BY published_at DESC, m.id) AS place FROM r JOIN m USING (symbol, thread) WHERE rank <= 8 QUALIFY place <= 5""")
def l4_brief_limits(spark, sf_dir):
    """L4: briefs tell of the eight largest threads of several articles, by five articles each."""
    return records.brief_articles(topics.members(spark, sf_dir))


@query(T.oracle("news") + "SELECT id, greatest(1.0, length(concat_ws(' ', title, description)) / 4.0) AS tokens FROM news")
def f_estimated_tokens(spark, sf_dir):
    """F: what a text counts for against a model's budget."""
    return T.news(spark, sf_dir).select("id", X.estimated_tokens(T.wording()).alias("tokens"))


@query(T.oracle("news") + "SELECT symbol, round_even(sum(sentiment_score)::DOUBLE, 4) AS total, round_even(max(sentiment_score)::DOUBLE, 4) AS most FROM news GROUP BY symbol")
def f_decimal_scores(spark, sf_dir):
    """F: scores as decimals of four digits, summed without loss."""
    return T.news(spark, sf_dir).groupBy("symbol").agg(F.sum("sentiment_score").cast("double").alias("total"), F.max("sentiment_score").cast("double").alias("most"))


@query(T.oracle("bars", **news.MOVES) + f"SELECT count(*) AS n, count(DISTINCT symbol) AS symbols, (SELECT max(date) FROM m WHERE {_ID} = (SELECT max({_ID}) FROM m)) AS last_peak FROM m")
def s12_case_counts(spark, sf_dir):
    """How many cases are stored, and one of them by its id."""
    m = news.top(spark, sf_dir).select(F.concat_ws(":", "symbol", F.date_format("date", "yyyy-MM-dd")).alias("case_id"), "symbol", "date")
    return m.agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("symbols"), F.max_by("date", "case_id").alias("last_peak"))
