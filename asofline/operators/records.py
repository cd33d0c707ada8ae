"""Lookups and joins of stored records: verdicts, sentiment bound to a text, thread members, filing summaries, companies, the case registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import accession_of
from ..sources.tables import CATEGORIES

#: Event types of a structured filing summary, and what its words count for.
EVENT_TYPES = ("management_change", "acquisition", "earnings_warning", "regulatory", "other")
RELEVANCE = {"high": 1.0, "medium": 0.5, "low": 0.0}
SENTIMENT = {"positive": 1.0, "negative": -1.0, "neutral": 0.0}
MEMBERS = 500


def text_hash(title: Column, description: Column) -> Column:
    """The hash that binds a score to the text it was made of."""
    return F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit(""))), 256)


def bound_sentiment(news: DataFrame, scores: DataFrame, model: str) -> DataFrame:
    """news with score, confidence of the model where they were made of this very text (scores: article_id, model, text_hash, score, confidence)."""
    s = scores.where(F.col("model") == model).select(F.col("article_id").alias("id"), F.col("text_hash").alias("_h"), "score", "confidence")
    both = news.withColumn("_own", text_hash(F.col("title"), F.col("description"))).join(s, "id", "left")
    same = F.col("_own") == F.col("_h")
    return both.withColumns({"score": F.when(same, F.col("score")), "confidence": F.when(same, F.col("confidence"))}).drop("_own", "_h")


def thread_members(asked: DataFrame, news: DataFrame, verdicts: DataFrame, most: int = MEMBERS) -> DataFrame:
    """The articles of each request (request, ids array) in its order, each once, with their verdicts; ids that aren't stored are skipped."""
    ids = asked.select("request", F.posexplode(F.slice(F.array_distinct("ids"), 1, most)).alias("pos", "id"))
    v = verdicts.select(F.col("article_id").alias("id"), "symbol", "decision", "category")
    return ids.join(news.select("id", "symbol", "title", "published_at"), "id").join(v, ["id", "symbol"], "left")


def filings_with_summaries(filings: DataFrame, summaries: DataFrame) -> DataFrame:
    """Filings (accession, url, ...) with the summary of their number, which comes from the URL where it is blank."""
    number = F.when(F.trim(F.coalesce("accession", F.lit(""))) != "", F.col("accession")).otherwise(accession_of(F.col("url")))
    return filings.withColumn("number", number).join(summaries.withColumnRenamed("accession", "number"), "number", "left")


def resolved(asked: DataFrame, *directories: DataFrame) -> DataFrame:
    """symbol, name, origin: a company by the first directory (symbol, name) that knows it, else a stub with its symbol."""
    out = asked.select(F.upper(F.trim("symbol")).alias("symbol")).distinct()
    names = []
    for k, d in enumerate(directories):
        out = out.join(d.groupBy("symbol").agg(F.min("name").alias(f"_n{k}")), "symbol", "left")
        names.append(F.when(F.col(f"_n{k}").isNotNull() & (F.col(f"_n{k}") != ""), F.struct(F.col(f"_n{k}").alias("name"), F.lit(k).alias("origin"))))
    best = F.coalesce(*names, F.struct(F.col("symbol").alias("name"), F.lit(-1).alias("origin")))
    return out.select("symbol", best.alias("_b")).select("symbol", "_b.name", "_b.origin")


def ruler(bars: DataFrame, day: Column, before: int, after: int) -> DataFrame:
    """symbol, date, close, kind: history, a marker row for the day where it has no bar, and what came after."""
    past = bars.where(F.col("date") <= day).withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy(F.col("date").desc()))).where(F.col("_k") <= before)
    later = bars.where((F.col("date") > day) & (F.col("date") <= F.date_add(day, after)))
    marked = bars.where(F.col("date") == day).select("symbol")
    marker = bars.select("symbol").distinct().join(marked, "symbol", "left_anti").select("symbol", day.alias("date"), F.lit(None).cast("double").alias("close"), F.lit("marker").alias("kind"))
    return past.select("symbol", "date", "close", F.lit("history").alias("kind")).unionByName(marker).unionByName(later.select("symbol", "date", "close", F.lit("outcome").alias("kind")))


def qualified_ids(members: DataFrame, peaks: DataFrame) -> DataFrame:
    """symbol, peak, ids: articles up to the peak (or undated) of the threads that have one, by date and id (members: symbol, thread, id, published_at)."""
    m = members.select("symbol", "thread", "id", F.to_date("published_at").alias("_d"))
    both = peaks.select("symbol", F.col("date").alias("peak")).join(m, "symbol").where(F.col("_d").isNull() | (F.col("_d") <= F.col("peak")))
    return both.groupBy("symbol", "peak").agg(F.transform(F.array_sort(F.collect_set(F.struct("_d", "id"))), lambda x: x["id"]).alias("ids"))


def brief_groups(members: DataFrame, peaks: DataFrame) -> DataFrame:
    """symbol, peak, thread, dated, group, number: threads dated by their newest article when all are up to the peak, by the oldest when all are later, undated when mixed; numbered over the groups."""
    m = members.select("symbol", "thread", F.to_date("published_at").alias("_d"))
    both = peaks.select("symbol", F.col("date").alias("peak")).join(m, "symbol").groupBy("symbol", "peak", "thread").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    group = F.when(F.col("_hi") <= F.col("peak"), "at-event").when(F.col("_lo") > F.col("peak"), "post-peak").otherwise("undated")
    out = both.withColumn("group", group).withColumn("dated", F.when(F.col("group") == "at-event", F.col("_hi")).when(F.col("group") == "post-peak", F.col("_lo")))
    order = W.partitionBy("symbol", "peak").orderBy(F.when(F.col("group") == "at-event", 0).when(F.col("group") == "post-peak", 1).otherwise(2), F.col("dated").asc_nulls_last(), "thread")
    return out.select("symbol", "peak", "thread", "dated", "group", F.row_number().over(order).alias("number"))


def category_basis(members: DataFrame) -> DataFrame:
    """symbol, thread, basis, rationale: where most votes for a thread's main category come from, and how that is told; empty where nobody voted.

    members: symbol, thread, id, published_at, category, relevant (null where unrated), decision_source, reason (a rule quotes its term).
    Of sources with as many votes, and of terms, that of the newest article counts.
    """
    key = ["symbol", "thread"]
    rated = members.where("relevant is not null")
    seen = F.struct("published_at", (-F.col("id").cast("long")).alias("k"))
    votes = rated.where("relevant and category <> 'UNRELATED'").groupBy(*key, "category").agg(F.count("*").alias("_n"), F.max(seen).alias("_seen"))
    top = votes.groupBy(*key).agg(F.max_by("category", F.struct("_n", "_seen")).alias("_top"))
    voters = rated.join(top, key).where("relevant and category = _top").withColumn("_term", F.nullif(F.regexp_extract(F.coalesce("reason", F.lit("")), '"([^"]+)"', 1), F.lit("")))
    sources = voters.groupBy(*key, "decision_source").agg(F.count("*").alias("_n"), F.max(seen).alias("_seen")).groupBy(*key).agg(F.max_by("decision_source", F.struct("_n", "_seen")).alias("_src"))
    told = voters.groupBy(*key).agg(F.count("*").alias("_voters"), F.max_by("_term", F.when(F.col("_term").isNotNull(), seen)).alias("_term"))
    total = rated.groupBy(*key).agg(F.count("*").alias("_total"))
    rows = total.join(top, key, "left").join(sources, key, "left").join(told, key, "left")
    quoted = F.concat(F.lit("'"), "_term", F.lit("'"))
    rule, term = F.col("_src") == "RULE", F.col("_term").isNotNull()
    label = F.when(F.col("_voters").isNull(), "").when(rule & term, F.concat(F.lit("rule:keyword "), quoted)).when(rule, "rule:keyword").when(F.col("_src") == "AI", "ai:gemini-verdict").when(F.col("_src") == "USER", "user-admitted").otherwise("mixed")
    rows = rows.withColumn("basis", label)
    head = F.concat(F.col("_voters").cast("string"), F.lit(" of "), F.col("_total").cast("string"), F.lit(" rated members classified "), "_top")
    tail = F.when(rule & term, F.concat(F.lit(" by keyword rule (matched "), quoted, F.lit(")"))).when(F.col("_src") == "AI", " by AI verdicts").otherwise(F.concat(F.lit(" ("), "basis", F.lit(")")))
    return rows.select(*key, "basis", F.when(F.col("_voters").isNull(), "").otherwise(F.concat(head, tail)).alias("rationale"))


def filing_summary(raw: DataFrame) -> DataFrame:
    """accession, event_type, relevance, sentiment, summary, risks of structured summaries (accession, body); known words only, texts cut to their limits, no row without a summary."""
    b = F.from_json("body", "struct<event_type: string, relevance: string, sentiment: string, summary: string, risks: array<string>>")
    word = lambda c: F.lower(F.trim(c))
    value = lambda c, table: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[word(c)], F.lit(0.0))
    rows = raw.select("accession", b.alias("_b")).where(F.trim(F.coalesce("_b.summary", F.lit(""))) != "")
    return rows.select(
        "accession", F.when(word(F.col("_b.event_type")).isin(*EVENT_TYPES), word(F.col("_b.event_type"))).otherwise("other").alias("event_type"), value(F.col("_b.relevance"), RELEVANCE).alias("relevance"),
        value(F.col("_b.sentiment"), SENTIMENT).alias("sentiment"), F.substring("_b.summary", 1, 2000).alias("summary"), F.transform(F.slice(F.coalesce("_b.risks", F.array()), 1, 10), lambda r: F.substring(r, 1, 64)).alias("risks"),
    )


def registry(cases: DataFrame, symbol: str | None = None, most: int = 50) -> DataFrame:
    """Cases of a symbol, the latest peaks first, or of all symbols by symbol and peak."""
    if symbol:
        return cases.where(F.col("symbol") == symbol).orderBy(F.col("peak").desc(), "case_id").limit(most)
    return cases.orderBy("symbol", "peak").limit(most)


#: Fixed value: a category that isn't told of in briefs.
UNTOLD = "REPUTATIONAL"


def brief_threads(threads: DataFrame) -> DataFrame:
    """Threads (..., category) of a material category; unrelated ones and those of image alone aren't told."""
    return threads.where(F.col("category").isin(*[c for c in CATEGORIES if c != UNTOLD]))


def brief_articles(members: DataFrame, most_threads: int = 8, most_articles: int = 5) -> DataFrame:
    """symbol, thread, rank, id, place: the largest threads of several articles of each symbol, and the newest articles of each."""
    size = members.groupBy("symbol", "thread").agg(F.count("*").alias("_n")).where("_n > 1")
    ranked = size.withColumn("rank", F.row_number().over(W.partitionBy("symbol").orderBy(F.col("_n").desc(), "thread"))).where(F.col("rank") <= most_threads)
    newest = W.partitionBy("symbol", "thread").orderBy(F.col("published_at").desc(), "id")
    return ranked.join(members, ["symbol", "thread"]).withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most_articles).select("symbol", "thread", "rank", "id", "place")
