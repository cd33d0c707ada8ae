"""Queries of news, verdicts, evidence and uncertainty."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.temporal import column, from_source, knowable_news, sql_cutoff, sql_knowable_news
from ..operators import evidence, gate, moves
from ..sources import tables as T
from .registry import query

DAY = "1998-02-28"
D = f"DATE '{DAY}'"


def _t():
    return column(DAY)

MOVES = moves.sql(D, moves.SQL_SLICED, moves.SQL_SCORED) | {"m": "SELECT symbol, date, round_even(ret * 100, 2) AS daily_return_pct FROM moves WHERE rank <= 5"}
KNOWN = f"SELECT * FROM news WHERE {sql_knowable_news(D)}"
ADMITTED = "SELECT k.* FROM known k JOIN (SELECT DISTINCT article_id, symbol FROM relevance WHERE decision IN ('RELEVANT', 'USER_APPROVED')) r ON k.id = r.article_id AND k.symbol = r.symbol"


def top(spark, sf_dir):
    return moves.top_moves(T.bars(spark, sf_dir), _t()).select("symbol", "date", "daily_return_pct")


def known(spark, sf_dir):
    return T.news(spark, sf_dir).where(knowable_news(F.col("published_at"), F.col("source"), _t()))


def admitted(spark, sf_dir):
    return evidence.gated(known(spark, sf_dir), T.relevance(spark, sf_dir))


@query(T.oracle("news", known=KNOWN) + "SELECT id, symbol, source, published_at FROM known")
def s6_news_as_of(spark, sf_dir):
    """The instant cutoff, and the end of the day for the source dated by days."""
    return known(spark, sf_dir).select("id", "symbol", "source", "published_at")


@query(T.oracle("news", known=KNOWN) + "SELECT id, source FROM known WHERE lower(coalesce(source, '')) LIKE '%gdelt%'")
def p2_source_membership(spark, sf_dir):
    """An unknown provider means gdelt."""
    return known(spark, sf_dir).where(from_source(F.col("source"), "unknown")).select("id", "source")


@query(T.oracle("relevance", "news") + f"""SELECT article_id, r.symbol, confidence, published_at FROM relevance r JOIN news n ON n.id = r.article_id
  WHERE decision = 'UNCERTAIN' AND published_at <= {sql_cutoff(D)}""")
def s8_uncertain_review(spark, sf_dir):
    """Undecided verdicts of articles known by the instant cutoff alone."""
    n = T.news(spark, sf_dir).where(F.col("published_at") <= evidence_cutoff()).select(F.col("id").alias("article_id"), "published_at")
    return T.relevance(spark, sf_dir).where("decision = 'UNCERTAIN'").join(n, "article_id").select("article_id", "symbol", "confidence", "published_at")


def evidence_cutoff():
    from ..functions.temporal import instant_cutoff

    return instant_cutoff(_t())


@query(T.oracle("filings") + """SELECT form_type, upper(form_type) IN ('8-K', '8-K/A') AS material, CASE WHEN upper(trim(form_type)) LIKE '8-K%' THEN '8-K' WHEN upper(trim(form_type)) LIKE '10-Q%' THEN '10-Q'
  WHEN upper(trim(form_type)) LIKE '10-K%' THEN '10-K' ELSE 'other' END AS family, count(*) AS n FROM filings GROUP BY 1, 2, 3""")
def p4_form_families(spark, sf_dir):
    """P3, P4."""
    f = F.upper(F.trim("form_type"))
    family = F.when(f.startswith("8-K"), "8-K").when(f.startswith("10-Q"), "10-Q").when(f.startswith("10-K"), "10-K").otherwise("other")
    return T.filings(spark, sf_dir).groupBy("form_type", F.upper("form_type").isin("8-K", "8-K/A").alias("material"), family.alias("family")).agg(F.count("*").alias("n"))


_NAMED = "contains(lower(coalesce(n.title, '')), 'than') OR contains(lower(coalesce(n.title, '')), 'thing') OR contains(lower(coalesce(n.title, '')), 'thing of ereaned')"


@query(T.oracle("news", known=KNOWN) + f"SELECT id, published_at, ({_NAMED}) AS named, row_number() OVER (PARTITION BY symbol ORDER BY ({_NAMED}) DESC, published_at DESC, id) AS position FROM known n ")
def l1_order_by_mention(spark, sf_dir):
    """The articles of every symbol, those whose title names the company first (the test is of the title), then the newest."""
    rows = known(spark, sf_dir).withColumn("named", X.names_company(F.col("title"), F.lit("than"), F.lit("thing of ereaned")))
    order = W.partitionBy("symbol").orderBy(F.col("named").desc(), F.col("published_at").desc(), "id")
    return rows.withColumn("position", F.row_number().over(order)).select("id", "published_at", "named", "position")


def _terms_sql(terms) -> str:
    return "regexp_matches(x, '\\b(?:" + "|".join(t.replace("-", "\\-") for t in terms) + ")\\b')"


#: Rule verdicts of the sample in SQL, with their reasons.
RULES = {
    "j": "SELECT id, lower(coalesce(title, '') || chr(10) || coalesce(description, '') || ' ' || CASE id::INT % 4 WHEN 0 THEN 'the CEO resigns' WHEN 1 THEN 'record sales growth' WHEN 2 THEN 'interest rates' ELSE '' END) AS x FROM news",
    "g": "SELECT id, regexp_matches(x, '\\bidiot\\b') OR contains(x, 'thing co') OR regexp_matches(x, '\\bthing\\b') AS mentioned, CASE " + " ".join(f"WHEN {_terms_sql(t)} THEN '{c}'" for c, t in X.MATERIAL_TERMS.items()) + f" END AS c, {_terms_sql(X.INDUSTRY_TERMS)} OR {_terms_sql(X.MACRO_TERMS)} AS near, CASE " + " ".join(f"WHEN {_terms_sql([t])} THEN '{t}'" for ts in X.MATERIAL_TERMS.values() for t in ts) + " END AS term FROM j",
    "rv": f"""SELECT id, CASE WHEN mentioned AND c IS NOT NULL THEN 'RELEVANT' WHEN mentioned OR near OR c IS NOT NULL THEN 'UNCERTAIN' ELSE 'IRRELEVANT' END AS decision, CASE WHEN mentioned AND c IS NOT NULL THEN c ELSE 'UNRELATED' END AS category,
  CASE WHEN mentioned AND c IS NOT NULL THEN 0.6 WHEN mentioned THEN 0.4 WHEN near OR c IS NOT NULL THEN 0.45 ELSE 0.7 END AS confidence, CASE WHEN mentioned AND c IS NOT NULL THEN '{X.REASON_MATERIAL[0]}' || lower(c) || '{X.REASON_MATERIAL[1]}' || term || '{X.REASON_MATERIAL[2]}'
  WHEN mentioned THEN '{X.REASON_MENTIONED}' WHEN near OR c IS NOT NULL THEN '{X.REASON_NEAR}' ELSE '{X.REASON_NOTHING}' END AS reason FROM g""",
}


def _planted(spark, sf_dir):
    """The sample's articles with a phrase that stands in for a headline, and their rule verdict."""
    n = F.col("id").cast("int") % 4
    extra = F.when(n == 0, "the CEO resigns").when(n == 1, "record sales growth").when(n == 2, "interest rates").otherwise("")
    rows = T.news(spark, sf_dir).withColumn("description", F.concat_ws(" ", F.coalesce("description", F.lit("")), extra))
    return rows, X.judge(F.col("title"), F.col("description"), F.lit("idiot"), F.lit("thing co"))


@query(T.oracle("news", **RULES) + "SELECT id, decision, category, confidence FROM rv")
def p7_rule_judge(spark, sf_dir):
    """The rule gate (a planted phrase stands in for headlines)."""
    rows, verdict = _planted(spark, sf_dir)
    return rows.select("id", verdict.alias("v")).select("id", "v.decision", "v.category", "v.confidence")


@query(T.oracle("news", **RULES) + "SELECT id, reason FROM rv")
def p7_rule_reasons(spark, sf_dir):
    """What each rule verdict says of itself."""
    rows, verdict = _planted(spark, sf_dir)
    return rows.select("id", verdict.alias("v")).select("id", X.rule_reason(F.col("v")).alias("reason"))


@query(T.oracle("news", "relevance", **RULES, a="SELECT article_id AS id, quality_of AS relevant, CASE WHEN article_id::INT % 5 = 0 THEN 'NONSENSE' ELSE category END AS category, least(greatest((article_id::INT % 140 - 20) / 100, 0), 1) AS confidence FROM (SELECT *, coalesce(relevant, false) AS quality_of FROM relevance) WHERE article_id::INT % 6 <> 0") + """
SELECT rv.id, CASE WHEN a.id IS NULL THEN CASE rv.decision WHEN 'RELEVANT' THEN true WHEN 'IRRELEVANT' THEN false END WHEN a.confidence >= 0.65 THEN a.relevant END AS relevant, CASE WHEN a.id IS NULL THEN rv.decision WHEN a.confidence < 0.65 THEN 'UNCERTAIN' WHEN a.relevant THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS decision,
  CASE WHEN a.id IS NULL THEN 'RULE' ELSE 'AI' END AS decision_source, CASE WHEN a.id IS NULL THEN rv.category WHEN a.confidence < 0.65 OR a.category = 'NONSENSE' THEN 'UNRELATED' ELSE a.category END AS category, coalesce(a.confidence, rv.confidence)::DOUBLE AS confidence,
  CASE WHEN a.id IS NULL THEN rv.reason ELSE substr(repeat('because ', 100), 1, 500) END AS reason FROM rv LEFT JOIN a USING (id)""")
def g2_batch_verdicts(spark, sf_dir):
    """A batch as it is stored: the model's answers normalised, the first of two, long reasons cut; articles that it left out have the rule's verdict, answers for articles that weren't asked go."""
    rows, verdict = _planted(spark, sf_dir)
    n = F.col("article_id").cast("int")
    told = T.relevance(spark, sf_dir).where(n % 6 != 0).select(
        F.col("article_id").alias("id"), F.lit(0).alias("place"), F.coalesce("relevant", F.lit(False)).alias("relevant"), F.when(n % 5 == 0, "nonsense").otherwise(F.lower("category")).alias("category"), ((n % 140 - 20) / 100).alias("confidence"), F.repeat(F.lit("because "), 100).alias("reason"),
    )
    again = told.withColumns({"place": F.lit(1), "confidence": F.lit(1.0), "category": F.lit("LEGAL")})
    return gate.classified(rows, told.unionByName(again).unionByName(told.withColumn("id", F.concat(F.lit("x"), "id"))), verdict)


@query(T.oracle("news", "relevance", known=KNOWN) + """SELECT n.symbol, count(*) FILTER (r.decision = 'RELEVANT') AS relevant, count(*) FILTER (r.decision = 'IRRELEVANT') AS irrelevant,
  count(*) FILTER (coalesce(r.decision, 'UNCERTAIN') = 'UNCERTAIN') AS uncertain FROM known n LEFT JOIN relevance r ON n.id = r.article_id AND n.symbol = r.symbol GROUP BY n.symbol""")
def a4_verdict_census(spark, sf_dir):
    """Articles without a verdict are uncertain."""
    return gate.census(known(spark, sf_dir), T.relevance(spark, sf_dir))


@query(T.oracle("news", "relevance", known=KNOWN, admitted=ADMITTED) + "SELECT id, symbol FROM admitted")
def g4_gate(spark, sf_dir):
    """P5, G4."""
    return admitted(spark, sf_dir).select("id", "symbol")


@query(T.oracle("relevance", ai="SELECT *, doc_id % 5 = 0 AS stale FROM (SELECT *, article_id::INT AS doc_id FROM relevance)") + """
SELECT article_id, symbol, CASE WHEN decision_source = 'USER' THEN decision WHEN decision_source = 'AI' AND NOT stale THEN decision ELSE 'UNCERTAIN' END AS decision,
  CASE WHEN decision_source = 'USER' THEN 'USER' WHEN decision_source = 'AI' AND NOT stale THEN 'AI' ELSE 'REJUDGED' END AS provenance FROM ai""")
def g1_verdict_precedence(spark, sf_dir):
    """G1: a user's verdict is final, a current model's stands, others are judged again."""
    cached = T.relevance(spark, sf_dir).withColumn("current", F.col("article_id").cast("int") % 5 != 0)
    fresh = cached.select("article_id", "symbol", F.lit("UNCERTAIN").alias("decision"))
    return gate.by_precedence(cached, fresh)


@query(T.oracle("relevance") + """SELECT article_id, CASE WHEN confidence < 0.65 THEN 'UNCERTAIN' ELSE decision END AS decision, CASE WHEN confidence >= 0.65 THEN relevant END AS relevant,
  CASE WHEN confidence < 0.65 THEN 'UNRELATED' ELSE category END AS category FROM relevance""")
def g2_normalised_verdicts(spark, sf_dir):
    return gate.normalised(T.relevance(spark, sf_dir)).select("article_id", "decision", "relevant", "category")


@query(T.oracle("bars", "filings", **MOVES) + """SELECT m.symbol, m.date, count(*) FILTER (d BETWEEN 0 AND 1) AS very_close, count(*) FILTER (d BETWEEN 2 AND 7) AS recent, count(*) FILTER (d BETWEEN 8 AND 30) AS older
  FROM m LEFT JOIN (SELECT symbol, filed_at::DATE AS day FROM filings) f ON m.symbol = f.symbol AND f.day BETWEEN m.date - 30 AND m.date, LATERAL (SELECT m.date - f.day AS d) GROUP BY m.symbol, m.date""")
def a5_filing_tiers(spark, sf_dir):
    """A5, J3."""
    return evidence.tier_counts(top(spark, sf_dir), T.filings(spark, sf_dir))


@query(T.oracle("bars", "filings", **MOVES) + "SELECT m.symbol, m.date, f.accession, f.filed_at, CASE WHEN m.date - f.filed_at::DATE <= 1 THEN 'very_close' WHEN m.date - f.filed_at::DATE <= 7 THEN 'recent' ELSE 'older' END AS tier FROM m JOIN filings f ON m.symbol = f.symbol AND f.filed_at::DATE BETWEEN m.date - 30 AND m.date")
def j3_move_filings(spark, sf_dir):
    return evidence.with_filings(top(spark, sf_dir), T.filings(spark, sf_dir)).select("symbol", "date", "accession", "filed_at", "tier")


@query(T.oracle("bars", "social", **MOVES) + """SELECT symbol, date, id, score, rank FROM (SELECT m.symbol, m.date, s.id, s.score, row_number() OVER (PARTITION BY m.symbol, m.date ORDER BY s.score DESC, s.id) AS rank
  FROM m JOIN social s ON m.symbol = s.symbol AND s.created_at::DATE BETWEEN m.date - 7 AND m.date) WHERE rank <= 6""")
def j4_move_social(spark, sf_dir):
    """The six posts of the highest score in the week before each move."""
    s = T.social(spark, sf_dir).withColumnRenamed("symbol", "_s")
    day = F.to_date("created_at")
    rows = top(spark, sf_dir).join(s, (F.col("symbol") == F.col("_s")) & (day >= F.date_sub("date", evidence.SOCIAL_DAYS)) & (day <= F.col("date")))
    best = W.partitionBy("symbol", "date").orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(best)).where("rank <= 6").select("symbol", "date", "id", "score", "rank")


@query(T.oracle("bars", "news", "relevance", known=KNOWN, admitted=ADMITTED, **MOVES) + "SELECT m.symbol, m.date, count(a.id) AS n_news, max(a.published_at) AS newest FROM m LEFT JOIN admitted a ON m.symbol = a.symbol AND a.published_at::DATE <= m.date GROUP BY m.symbol, m.date")
def j5_move_news(spark, sf_dir):
    """Everything admitted and known by each move."""
    return evidence.move_news(top(spark, sf_dir), admitted(spark, sf_dir))


@query(T.oracle("bars", "filings", "news", "social", known=KNOWN, **MOVES, seen="""
  SELECT m.symbol, m.date, 'regulatory' AS layer, 0 AS r, min(f.filed_at) AS seen FROM m LEFT JOIN filings f ON m.symbol = f.symbol AND f.filed_at::DATE BETWEEN m.date - 30 AND m.date GROUP BY ALL
  UNION ALL SELECT m.symbol, m.date, 'news', 1, min(n.published_at) FROM m LEFT JOIN known n ON m.symbol = n.symbol AND n.published_at::DATE <= m.date GROUP BY ALL
  UNION ALL SELECT m.symbol, m.date, 'social', 2, min(s.created_at) FROM m LEFT JOIN social s ON m.symbol = s.symbol AND s.created_at::DATE BETWEEN m.date - 7 AND m.date GROUP BY ALL
  UNION ALL SELECT symbol, date, 'market', 3, date::TIMESTAMP FROM m""") + """
SELECT symbol, date, layer, seen AS first_seen, CASE WHEN seen IS NULL THEN 'silent' ELSE 'observed' END AS state, round_even((epoch_us(seen) - min(epoch_us(seen)) OVER (PARTITION BY symbol, date)) / 3.6e9, 1) AS lag_hours,
  row_number() OVER (PARTITION BY symbol, date ORDER BY seen NULLS LAST, r) AS position FROM seen""")
def a6_arrival_map(spark, sf_dir):
    return evidence.arrivals(top(spark, sf_dir), T.filings(spark, sf_dir), known(spark, sf_dir), T.social(spark, sf_dir))


_SCORES = "SELECT k.symbol, k.id, k.published_at, coalesce(k.sentiment_score::DOUBLE, CASE WHEN s.confidence >= 0.6 THEN s.score END) AS v FROM known k LEFT JOIN sentiment s ON k.id = s.article_id"


@query(T.oracle("news", "sentiment", known=KNOWN, v=_SCORES) + "SELECT id, v AS score FROM v")
def j9_score_fallback(spark, sf_dir):
    """The provider's score, else the model's where it is sure."""
    s = T.sentiment(spark, sf_dir).select(F.col("article_id").alias("id"), F.when(F.col("confidence") >= evidence.USABLE, F.col("score")).alias("_m"))
    return known(spark, sf_dir).join(s, "id", "left").select("id", F.coalesce(F.col("sentiment_score").cast("double"), "_m").alias("score"))


@query(T.oracle("bars", "news", "sentiment", known=KNOWN, v=_SCORES, **MOVES, g="SELECT m.symbol, m.date, m.daily_return_pct AS r, count(v.v) AS n_scored, avg(v.v) AS mean FROM m LEFT JOIN v ON m.symbol = v.symbol AND v.published_at::DATE <= m.date GROUP BY ALL") + """
SELECT symbol, date, n_scored, CASE WHEN n_scored >= 2 THEN round_even(mean, 4) END AS sentiment_mean, CASE WHEN n_scored < 2 THEN 'unknown' WHEN abs(round_even(mean, 10)) < 0.1 OR r = 0 THEN 'neutral'
  WHEN (mean > 0) = (r > 0) THEN 'agree' ELSE 'disagree' END AS sentiment_direction FROM g""")
def a10_divergence(spark, sf_dir):
    """A10, A11."""
    return evidence.move_sentiment(top(spark, sf_dir), known(spark, sf_dir), T.sentiment(spark, sf_dir))


_DAYS = """SELECT x.symbol, coalesce(f.d, 0) AS regulatory_days, coalesce(n.d, 0) AS news_days, coalesce(s.d, 0) AS social_days FROM (SELECT DISTINCT symbol FROM m) x
  LEFT JOIN (SELECT m.symbol, count(DISTINCT f.filed_at::DATE) AS d FROM m JOIN filings f ON m.symbol = f.symbol AND f.filed_at::DATE BETWEEN m.date - 30 AND m.date GROUP BY ALL) f ON x.symbol = f.symbol
  LEFT JOIN (SELECT m.symbol, count(DISTINCT k.published_at::DATE) AS d FROM m JOIN known k ON m.symbol = k.symbol AND k.published_at::DATE <= m.date GROUP BY ALL) n ON x.symbol = n.symbol
  LEFT JOIN (SELECT m.symbol, count(DISTINCT s.created_at::DATE) AS d FROM m JOIN social s ON m.symbol = s.symbol AND s.created_at::DATE BETWEEN m.date - 7 AND m.date GROUP BY ALL) s ON x.symbol = s.symbol"""


@query(T.oracle("bars", "filings", "news", "social", known=KNOWN, **MOVES, days=_DAYS) + "SELECT * FROM days")
def a7_layer_days(spark, sf_dir):
    return evidence.layer_days(top(spark, sf_dir), T.filings(spark, sf_dir), known(spark, sf_dir), T.social(spark, sf_dir))


_CONFLICT = {
    "sc": "SELECT k.symbol, s.score, CASE WHEN s.confidence >= 0.6 THEN s.confidence END AS w FROM known k JOIN sentiment s ON k.id = s.article_id",
    "mu": "SELECT *, sum(w * score) OVER (PARTITION BY symbol) / sum(w) OVER (PARTITION BY symbol) AS mean FROM sc",
    "conf": "SELECT symbol, count(score) AS n_scored, count(w) AS n_usable, CASE WHEN count(w) >= 3 THEN least(greatest(sum(w * (score - mean) ^ 2) / sum(w), 0), 1) END AS conflict FROM mu GROUP BY symbol",
}


def _conflicts(spark, sf_dir):
    return evidence.conflict(known(spark, sf_dir).select("symbol", F.col("id").alias("article_id")).join(T.sentiment(spark, sf_dir), "article_id"))


@query(T.oracle("news", "sentiment", known=KNOWN, **_CONFLICT) + "SELECT symbol, n_scored, n_usable, round_even(conflict, 6) AS conflict FROM conf")
def a8_conflict(spark, sf_dir):
    return _conflicts(spark, sf_dir).withColumn("conflict", F.bround("conflict", 6))


@query(T.oracle("bars", "filings", "news", "social", "sentiment", known=KNOWN, **MOVES, days=_DAYS, **_CONFLICT, dd="SELECT *, (close - max(close) OVER (PARTITION BY symbol ORDER BY date)) / max(close) OVER (PARTITION BY symbol ORDER BY date) * 100 AS dd FROM slice",
    sm="SELECT symbol, count(*) AS n, round_even(stddev_samp(ret) * sqrt(252) * 100, 2) AS vol, round_even(least(min(dd), 0), 2) AS dd FROM dd GROUP BY symbol",
    p="""SELECT sm.symbol, 1 - (coalesce(regulatory_days, 0) / n + coalesce(news_days, 0) / n + coalesce(social_days, 0) / n + 1) / 4 AS coverage, conflict, coalesce(n_scored, 0) AS ns, coalesce(n_usable, 0) AS nu,
      0.6 * least(abs(vol) / 50, 1) + 0.4 * least(abs(dd) / 25, 1) AS inst FROM sm LEFT JOIN days USING (symbol) LEFT JOIN conf USING (symbol)""") + """
SELECT symbol, round_even(coverage, 6) AS coverage, round_even(conflict, 6) AS conflict, round_even(inst, 6) AS instability,
  round_even((0.35 * coverage + 0.35 * coalesce(conflict, 0) + 0.30 * inst) / (0.65 + CASE WHEN ns > 0 THEN 0.35 ELSE 0 END) * 100, 1) AS score, CASE WHEN ns > 0 AND nu >= 10 THEN 'High' ELSE 'Medium' END AS grade FROM p""")
def a9_uncertainty(spark, sf_dir):
    m = top(spark, sf_dir)
    days = evidence.layer_days(m, T.filings(spark, sf_dir), known(spark, sf_dir), T.social(spark, sf_dir))
    return evidence.uncertainty(moves.window_summary(T.bars(spark, sf_dir), _t()), days, _conflicts(spark, sf_dir))


@query(T.oracle("news") + f"SELECT symbol, max(published_at) AS newest, max(published_at) < {D} - INTERVAL 7 DAY AS stale FROM news WHERE published_at <= {sql_cutoff(D)} GROUP BY symbol")
def a23_staleness(spark, sf_dir):
    rows = T.news(spark, sf_dir).where(F.col("published_at") <= evidence_cutoff())
    return rows.groupBy("symbol").agg(F.max("published_at").alias("newest")).withColumn("stale", F.col("newest") < F.date_sub(_t(), 7).cast("timestamp"))


@query(T.oracle("news", days=f"SELECT symbol, unnest(generate_series({D} - INTERVAL 7 DAY, {D}, INTERVAL 1 DAY))::DATE AS day FROM (SELECT DISTINCT symbol FROM news)") + "SELECT symbol, day FROM days d WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.symbol = d.symbol AND n.published_at::DATE = d.day)")
def a25_missing_days(spark, sf_dir):
    """Days of the last week without an article of the symbol."""
    n = T.news(spark, sf_dir)
    days = n.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.date_sub(_t(), 7), _t())).alias("day"))
    return days.join(n.select("symbol", F.to_date("published_at").alias("day")), ["symbol", "day"], "left_anti")


@query(T.oracle("news", "filings", known=KNOWN) + f"""SELECT kind, ref, symbol, seen_at FROM (SELECT CASE WHEN form_type IN ('8-K', '8-K/A') THEN 'disclosure' ELSE 'filing' END AS kind, accession AS ref, symbol, filed_at AS seen_at FROM filings
  WHERE filed_at < {D} + INTERVAL 1 DAY UNION ALL SELECT 'news', id, symbol, published_at FROM known)""")
def l7_evidence_stream(spark, sf_dir):
    """Filings, disclosures and news of every symbol, the newest first."""
    from ..functions.temporal import knowable_filing

    f = T.filings(spark, sf_dir).where(knowable_filing(F.col("filed_at"), _t())).select(F.when(F.col("form_type").isin("8-K", "8-K/A"), "disclosure").otherwise("filing").alias("kind"), F.col("accession").alias("ref"), "symbol", F.col("filed_at").alias("seen_at"))
    n = known(spark, sf_dir).select(F.lit("news").alias("kind"), F.col("id").alias("ref"), "symbol", F.col("published_at").alias("seen_at"))
    return f.unionByName(n).orderBy("symbol", F.col("seen_at").desc(), "ref")


@query(T.oracle("news") + "SELECT symbol, published_at::DATE AS day, count(*) AS n, CASE WHEN day <= DATE '1998-02-01' THEN 'at-event' ELSE 'post-peak' END AS timing FROM news GROUP BY symbol, day")
def h28_news_timing(spark, sf_dir):
    day = F.to_date("published_at")
    out = T.news(spark, sf_dir).groupBy("symbol", day.alias("day")).agg(F.count("*").alias("n"))
    return out.withColumn("timing", F.when(F.col("day") <= column("1998-02-01"), "at-event").otherwise("post-peak"))


@query(T.oracle("news", "sentiment", known=KNOWN, d="SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, id) AS n FROM known") + "SELECT symbol, id, n FROM d WHERE n <= 100")
def l3_scoring_budget(spark, sf_dir):
    """L2, L3: the newest articles of each symbol within the feature's budget of 100."""
    newest = W.partitionBy("symbol").orderBy(F.col("published_at").desc(), "id")
    return known(spark, sf_dir).withColumn("n", F.row_number().over(newest)).where("n <= 100").select("symbol", "id", "n")
