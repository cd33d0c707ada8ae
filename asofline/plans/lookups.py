"""Queries of stored records."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import column
from ..operators import records
from ..sources import tables as T
from . import news, topics
from .registry import query

DAY, D = news.DAY, news.D


@query(T.oracle("news", "relevance", "vectors") + "SELECT n.id, r.decision, v.article_id IS NOT NULL AS has_vector FROM news n LEFT JOIN relevance r ON n.id = r.article_id AND n.symbol = r.symbol LEFT JOIN vectors v ON n.id = v.article_id")
def s7_point_lookups(spark, sf_dir):
    """Stored verdicts and vectors of articles, by key."""
    r = T.relevance(spark, sf_dir).select(F.col("article_id").alias("id"), "symbol", "decision")
    v = T.vectors(spark, sf_dir).select(F.col("article_id").alias("id"), F.lit(True).alias("has_vector"))
    out = T.news(spark, sf_dir).select("id", "symbol").join(r, ["id", "symbol"], "left").join(v, "id", "left")
    return out.select("id", "decision", F.coalesce("has_vector", F.lit(False)).alias("has_vector"))


@query(T.oracle("news", "sentiment") + "SELECT n.id, CASE WHEN n.id::INT % 5 <> 0 THEN s.score END AS score FROM news n LEFT JOIN sentiment s ON n.id = s.article_id")
def j8_bound_sentiment(spark, sf_dir):
    """A score counts for the text it was made of; every fifth text has changed since."""
    n = T.news(spark, sf_dir)
    made = n.withColumn("title", F.when(F.col("id").cast("int") % 5 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    scores = made.select(F.col("id").alias("article_id"), F.lit("m").alias("model"), records.text_hash(F.col("title"), F.col("description")).alias("text_hash")).join(T.sentiment(spark, sf_dir), "article_id")
    return records.bound_sentiment(n, scores, "m").select("id", "score")


@query(T.oracle("news", "relevance", a="SELECT symbol AS request, list_concat(list(id ORDER BY id DESC), ['none']) AS ids FROM news GROUP BY symbol", x="SELECT request, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM a") + """
SELECT x.request, x.pos::INT AS pos, n.id, n.published_at, r.decision FROM x JOIN news n USING (id) LEFT JOIN relevance r ON n.id = r.article_id AND n.symbol = r.symbol WHERE x.pos < 500""")
def j11_thread_members(spark, sf_dir):
    """Members in the order of the request, unknown ids skipped."""
    n = T.news(spark, sf_dir)
    ids = F.sort_array(F.collect_list("id"), asc=False)  # as many as a request may name
    first = n.select("symbol", "id", F.row_number().over(W.partitionBy("symbol").orderBy(F.col("id").desc())).alias("_k")).where("_k <= 500")
    asked = first.groupBy(F.col("symbol").alias("request")).agg(F.concat(ids, F.array(F.lit("none"))).alias("ids"))
    return records.thread_members(asked, n, T.relevance(spark, sf_dir)).select("request", "pos", "id", "published_at", "decision")


@query(T.oracle("filings") + """SELECT accession, CASE WHEN accession::BIGINT % 4 = 0 THEN substr(accession, 1, 10) || '-' || substr(accession, 11, 2) || '-' || substr(accession, 13, 6) ELSE accession END AS number,
  CASE WHEN accession::BIGINT % 2 = 0 THEN 'event ' || (accession::BIGINT % 5) END AS event FROM filings""")
def j12_filings_with_summaries(spark, sf_dir):
    """Every fourth filing has a blank number; its URL has it."""
    f = T.filings(spark, sf_dir).withColumn("own", F.col("accession"))
    k = F.col("own").cast("bigint")
    dashed = F.concat_ws("-", F.substring("own", 1, 10), F.substring("own", 11, 2), F.substring("own", 13, 6))
    summaries = f.where(k % 2 == 0).select(F.when(k % 4 == 0, dashed).otherwise(F.col("own")).alias("accession"), F.concat(F.lit("event "), (k % 5).cast("string")).alias("event"))
    blank = f.withColumn("accession", F.when(k % 4 == 0, "").otherwise(F.col("accession")))
    return records.filings_with_summaries(blank, summaries).select(F.col("own").alias("accession"), "number", "event")


@query(T.oracle("companies", "news", s="SELECT DISTINCT symbol FROM news") + """SELECT s.symbol, CASE WHEN substr(s.symbol, 7)::INT % 2 = 0 THEN c.name WHEN substr(s.symbol, 7)::INT % 3 = 0 THEN 'Directory ' || s.symbol ELSE upper(s.symbol) END AS name,
  CASE WHEN substr(s.symbol, 7)::INT % 2 = 0 THEN 0 WHEN substr(s.symbol, 7)::INT % 3 = 0 THEN 1 ELSE -1 END AS origin FROM s JOIN companies c USING (symbol)""".replace("SELECT s.symbol,", "SELECT upper(s.symbol) AS symbol,").replace("'Directory ' || s.symbol", "'Directory ' || upper(s.symbol)"))
def j19_company_resolution(spark, sf_dir):
    """The repository, then the directory, then a stub."""
    c = T.companies(spark, sf_dir).withColumn("symbol", F.upper("symbol"))
    k = F.substring("symbol", 7, 2).cast("int")
    directory = c.where(k % 3 == 0).select("symbol", F.concat(F.lit("Directory "), "symbol").alias("name"))
    return records.resolved(T.news(spark, sf_dir), c.where(k % 2 == 0).select("symbol", "name"), directory)


@query(T.oracle("bars") + f"""SELECT symbol, date, round_even(close, 8) AS close, 'history' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM bars WHERE date <= {D}) WHERE k <= 30
UNION ALL SELECT symbol, {D}, NULL, 'marker' FROM (SELECT DISTINCT symbol FROM bars) WHERE symbol NOT IN (SELECT symbol FROM bars WHERE date = {D})
UNION ALL SELECT symbol, date, round_even(close, 8), 'outcome' FROM bars WHERE date > {D} AND date <= {D} + 30""")
def l8_temporal_ruler(spark, sf_dir):
    return records.ruler(T.bars(spark, sf_dir), column(DAY), 30, 30).withColumn("close", F.bround("close", 8))


@query(T.oracle("bars", "news", "relevance", **news.MOVES, mem=topics.MEMBERS) + """SELECT m.symbol, m.date AS peak, string_agg(x.id, ',' ORDER BY x.published_at::DATE, x.id) AS ids FROM m JOIN mem x ON m.symbol = x.symbol AND x.published_at::DATE <= m.date GROUP BY m.symbol, m.date""")
def p10_qualified_ids(spark, sf_dir):
    out = records.qualified_ids(topics.members(spark, sf_dir), news.top(spark, sf_dir))
    return out.select("symbol", "peak", F.array_join("ids", ",").alias("ids"))


@query(T.oracle("bars", "news", "relevance", **news.MOVES, mem=topics.MEMBERS, g="SELECT m.symbol, m.date AS peak, x.thread, min(x.published_at)::DATE AS lo, max(x.published_at)::DATE AS hi FROM m JOIN mem x ON m.symbol = x.symbol GROUP BY ALL",
    h="SELECT *, CASE WHEN hi <= peak THEN 0 WHEN lo > peak THEN 1 ELSE 2 END AS k, CASE WHEN hi <= peak THEN hi WHEN lo > peak THEN lo END AS dated FROM g") + """
SELECT symbol, peak, thread, dated, ['at-event', 'post-peak', 'undated'][k + 1] AS "group", row_number() OVER (PARTITION BY symbol, peak ORDER BY k, dated NULLS LAST, thread) AS number FROM h""")
def h29_brief_groups(spark, sf_dir):
    return records.brief_groups(topics.members(spark, sf_dir), news.top(spark, sf_dir))


_BASIS = {
    "mem": topics.MEMBERS, "x": "SELECT mem.*, r.relevant, r.decision_source AS src, CASE WHEN r.decision_source = 'RULE' AND r.article_id::INT % 3 <> 0 THEN lower(r.category) END AS term FROM mem JOIN relevance r ON mem.id = r.article_id AND mem.symbol = r.symbol WHERE r.relevant IS NOT NULL",
    "tc": "SELECT symbol, thread, max({'n': n, 'p': p, 'c': category}).c AS top FROM (SELECT symbol, thread, category, count(*) AS n, max(published_at) AS p FROM x WHERE relevant GROUP BY ALL) GROUP BY ALL",
    "vt": "SELECT x.* FROM x JOIN tc ON x.symbol = tc.symbol AND x.thread = tc.thread AND x.relevant AND x.category = tc.top",
    "bs": "SELECT symbol, thread, max({'n': n, 'p': p, 's': src}).s AS basis FROM (SELECT symbol, thread, src, count(*) AS n, max(published_at) AS p FROM vt GROUP BY ALL) GROUP BY ALL",
    "q": "SELECT symbol, thread, count(*) AS voters, arg_max(term, published_at) FILTER (term IS NOT NULL) AS term FROM vt GROUP BY ALL", "n": "SELECT symbol, thread, count(*) AS total FROM x GROUP BY ALL",
    "l": """SELECT n.symbol, n.thread, total, voters, top, basis, chr(39) || term || chr(39) AS quoted, CASE WHEN voters IS NULL THEN '' WHEN basis = 'RULE' AND term IS NOT NULL THEN 'rule:keyword ' || quoted WHEN basis = 'RULE' THEN 'rule:keyword'
      WHEN basis = 'AI' THEN 'ai:gemini-verdict' WHEN basis = 'USER' THEN 'user-admitted' ELSE 'mixed' END AS label FROM n LEFT JOIN tc USING (symbol, thread) LEFT JOIN bs USING (symbol, thread) LEFT JOIN q USING (symbol, thread)""",
}


@query(T.oracle("news", "relevance", **_BASIS) + """SELECT symbol, thread, label AS basis, CASE WHEN voters IS NULL THEN '' ELSE voters || ' of ' || total || ' rated members classified ' || top
  || CASE WHEN basis = 'RULE' AND quoted IS NOT NULL THEN ' by keyword rule (matched ' || quoted || ')' WHEN basis = 'AI' THEN ' by AI verdicts' ELSE ' (' || label || ')' END END AS rationale FROM l""")
def a14_category_basis(spark, sf_dir):
    """Where the votes for a thread's main category come from, and the reason that is told (two thirds of the rule's reasons quote a term)."""
    quoted = F.concat(F.lit('matched "'), F.lower("category"), F.lit('"'))
    r = T.relevance(spark, sf_dir).select(F.col("article_id").alias("id"), "symbol", "relevant", "decision_source", F.when((F.col("decision_source") == "RULE") & (F.col("article_id").cast("int") % 3 != 0), quoted).otherwise("no term").alias("reason"))
    return records.category_basis(topics.members(spark, sf_dir).join(r, ["id", "symbol"]))


SUMMARIES = "SELECT accession, ['acquisition', 'other', 'regulatory'][accession::BIGINT % 3 + 1] AS event_type, [1.0, 0.5, 0.0, 0.0][accession::BIGINT % 4 + 1]::DOUBLE AS relevance, [1.0, -1.0][accession::BIGINT % 2 + 1]::DOUBLE AS sentiment FROM filings WHERE accession::BIGINT % 5 <> 0"


def summaries(spark, sf_dir):
    """Structured summaries of the sample's filings; every fifth has no text and makes no row."""
    f = T.filings(spark, sf_dir)
    k = F.col("accession").cast("bigint")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (k % len(xs) + 1).cast("int"))
    body = F.struct(pick(["Acquisition", "surprise", "REGULATORY"]).alias("event_type"), pick(["high", "medium", "low", "?"]).alias("relevance"), pick(["positive", "negative"]).alias("sentiment"), F.when(k % 5 != 0, "text").otherwise(" ").alias("summary"), F.array(F.lit("r")).alias("risks"))
    return records.filing_summary(f.select("accession", F.to_json(body).alias("body"))).select("accession", "event_type", "relevance", "sentiment")


@query(T.oracle("filings") + SUMMARIES)
def h13_filing_summaries(spark, sf_dir):
    """Unknown words count as other or nothing."""
    return summaries(spark, sf_dir)


@query(T.oracle("bars", **news.MOVES) + "SELECT symbol || ':' || strftime(date, '%Y-%m-%d') AS case_id, date AS peak FROM m WHERE symbol = 'Brand#7'")
def s12_case_registry(spark, sf_dir):
    """A symbol's cases, the latest peaks first."""
    m = news.top(spark, sf_dir).select(F.concat_ws(":", "symbol", F.date_format("date", "yyyy-MM-dd")).alias("case_id"), "symbol", F.col("date").alias("peak"))
    return records.registry(m, "Brand#7", 20).select("case_id", "peak")
