"""Evidence of moves: filings by nearness, first appearances by layer, gated news, and the uncertainty of a window.

Moves are few for each symbol (MOVES at most), so evidence is joined by symbol and aggregated right after;
the joins carry ids and times, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import joins

LOOKBACK, SOCIAL_DAYS, REACTION_DAYS = 30, 7, 5
#: Weights of the uncertainty index, the confidence that makes a score usable, and how many are needed.
COVERAGE, CONFLICT, INSTABILITY = 0.35, 0.35, 0.30
USABLE, LEAST_SCORED, HIGH_SCORED = 0.6, 3, 10


def tier(filed_at: Column, move: Column, lookback: int = LOOKBACK) -> Column:
    """very_close, recent or older by calendar days before the move; null outside the window."""
    days = F.datediff(move, F.to_date(filed_at))
    return F.when((days < 0) | (days > lookback), None).when(days <= 1, "very_close").when(days <= 7, "recent").otherwise("older")


def with_filings(moves: DataFrame, filings: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """symbol, date, accession, filed_at, tier of the filings in each move's window."""
    f = filings.select(F.col("symbol").alias("_s"), "accession", "form_type", "filed_at")
    day = F.to_date("filed_at")
    return moves.select("symbol", "date").join(f, (F.col("symbol") == F.col("_s")) & (day >= F.date_sub("date", lookback)) & (day <= F.col("date"))).drop("_s").withColumn("tier", tier(F.col("filed_at"), F.col("date"), lookback))


def tier_counts(moves: DataFrame, filings: DataFrame) -> DataFrame:
    """symbol, date, very_close, recent, older of every move."""
    n = lambda t: F.count_if(F.col("tier") == t).alias(t)
    got = with_filings(moves, filings).groupBy("symbol", "date").agg(n("very_close"), n("recent"), n("older"))
    return moves.select("symbol", "date").join(got, ["symbol", "date"], "left").fillna(0, ["very_close", "recent", "older"])


def gated(news: DataFrame, verdicts: DataFrame) -> DataFrame:
    """News that a verdict admits; without any verdict at all, all news."""
    admitted = verdicts.where(F.col("decision").isin("RELEVANT", "USER_APPROVED")).select(F.col("article_id").alias("id"), "symbol").distinct()
    some = verdicts.select(F.lit(1).alias("_some")).limit(1)
    judged = news.join(F.broadcast(some), F.lit(True), "left")  # one row at most
    return judged.join(admitted.withColumn("_ok", F.lit(True)), ["id", "symbol"], "left").where("_some is null or _ok").drop("_some", "_ok")


def arrivals(moves: DataFrame, filings: DataFrame, news: DataFrame, social: DataFrame) -> DataFrame:
    """symbol, date, layer, first_seen, state, lag_hours, position: when each layer was first seen before each move.

    news holds what is knowable; rows later than a move don't count for it.  Layers without a row are silent and last.
    """
    m = moves.select("symbol", "date")
    first = lambda rows, at, low, layer, rank: (
        m.join(rows.select(F.col("symbol").alias("_s"), F.col(at).alias("_at")), (F.col("symbol") == F.col("_s")) & low & (F.to_date("_at") <= F.col("date")))
        .groupBy("symbol", "date").agg(F.min("_at").alias("first_seen")).select("symbol", "date", F.lit(layer).alias("layer"), F.lit(rank).alias("_rank"), "first_seen")
    )
    day = F.to_date("_at")
    seen = first(filings, "filed_at", day >= F.date_sub("date", LOOKBACK), "regulatory", 0)
    earliest = news.groupBy("symbol").agg(F.min("published_at").alias("published_at"))  # news have no lower bound: what was first of all was first for each move
    seen = seen.unionByName(first(earliest, "published_at", F.lit(True), "news", 1)).unionByName(first(social, "created_at", day >= F.date_sub("date", SOCIAL_DAYS), "social", 2))
    layers = m.select("symbol", "date", F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.lit(k).alias("_rank")) for k, n in enumerate(("regulatory", "news", "social", "market"))])).alias("_l")).select("symbol", "date", "_l.*")
    out = layers.join(seen.drop("_rank"), ["symbol", "date", "layer"], "left").withColumn("first_seen", F.when(F.col("layer") == "market", F.col("date").cast("timestamp")).otherwise(F.col("first_seen")))
    move = W.partitionBy("symbol", "date")
    lag = (F.unix_micros("first_seen") - F.unix_micros(F.min("first_seen").over(move))) / 3.6e9
    position = F.row_number().over(move.orderBy(F.col("first_seen").asc_nulls_last(), "_rank"))
    return out.select("symbol", "date", "layer", "first_seen", F.when(F.col("first_seen").isNull(), "silent").otherwise("observed").alias("state"), F.bround(lag, 1).alias("lag_hours"), position.alias("position"))


def divergence(n_scored: Column, mean: Column, daily_return: Column) -> Column:
    """agree, disagree, neutral or unknown: whether the mean score and the move have one direction."""
    return F.when(n_scored < 2, "unknown").when((F.abs(mean) < 0.1) | (daily_return == 0), "neutral").when((mean > 0) == (daily_return > 0), "agree").otherwise("disagree")


def move_sentiment(moves: DataFrame, news: DataFrame, sentiment: DataFrame) -> DataFrame:
    """symbol, date, n_scored, sentiment_mean, sentiment_direction over the news up to each move: the provider's score, else a usable model score."""
    s = sentiment.select(F.col("article_id").alias("id"), F.when(F.col("confidence") >= USABLE, F.col("score")).alias("_model"))
    rows = news.join(s, "id", "left").select("symbol", F.to_date("published_at").alias("_day"), F.coalesce(F.col("sentiment_score").cast("double"), F.col("_model")).alias("_v"))
    out = joins.upto(moves.select("symbol", "date", "daily_return_pct"), rows, "symbol", "date", {"n_scored": F.count("_v"), "_total": F.coalesce(F.sum("_v"), F.lit(0.0))})
    out = out.withColumn("_mean", F.when(F.col("n_scored") > 0, F.col("_total") / F.col("n_scored")))
    return out.select("symbol", "date", "n_scored", F.when(F.col("n_scored") >= 2, F.bround("_mean", 4)).alias("sentiment_mean"), divergence(F.col("n_scored"), F.bround("_mean", 10), F.col("daily_return_pct")).alias("sentiment_direction"))


def move_news(moves: DataFrame, news: DataFrame) -> DataFrame:
    """symbol, date, n_news, newest: how many articles there are up to each move, and when the last of them appeared."""
    rows = news.select("symbol", F.to_date("published_at").alias("_day"), "published_at")
    counted = joins.upto(moves.select("symbol", "date"), rows, "symbol", "date", {"n_news": F.count("*")})
    newest = rows.groupBy("symbol", "_day").agg(F.max("published_at").alias("newest"))
    return joins.as_of_join(counted, newest, "symbol", "date", "_day", ["newest"], "year").select("symbol", "date", "n_news", F.col("newest_as_of").alias("newest"))


def layer_days(moves: DataFrame, filings: DataFrame, news: DataFrame, social: DataFrame) -> DataFrame:
    """symbol, regulatory_days, news_days, social_days: distinct days with evidence of any move.

    Evidence is brought down to its distinct days before it meets the moves; news, which have no lower bound, meet the last move alone.
    """
    m = moves.select("symbol", "date")
    last = m.groupBy("symbol").agg(F.max("date").alias("date"))

    def days(rows, at, within, name):
        own = rows.select(F.col("symbol").alias("_s"), F.to_date(at).alias("_day")).distinct()
        low = F.lit(True) if within is None else F.col("_day") >= F.date_sub("date", within)
        both = (last if within is None else m).join(own, (F.col("symbol") == F.col("_s")) & low & (F.col("_day") <= F.col("date")))
        return both.groupBy("symbol").agg(F.count_distinct("_day").alias(name))

    out = last.select("symbol")
    for rows, at, within, name in ((filings, "filed_at", LOOKBACK, "regulatory_days"), (news, "published_at", None, "news_days"), (social, "created_at", SOCIAL_DAYS, "social_days")):
        out = out.join(days(rows, at, within, name), "symbol", "left")
    return out.fillna(0)


def conflict(scored: DataFrame) -> DataFrame:
    """symbol, n_scored, n_usable, conflict: confidence-weighted variance of the usable scores (two passes), null with fewer than LEAST_SCORED."""
    rows = scored.select("symbol", "score", F.when(F.col("confidence") >= USABLE, F.col("confidence")).alias("_w"))
    mean = rows.groupBy("symbol").agg((F.sum(F.col("_w") * F.col("score")) / F.sum("_w")).alias("_m"))
    out = rows.join(mean, "symbol").groupBy("symbol").agg(F.count("score").alias("n_scored"), F.count("_w").alias("n_usable"), (F.sum(F.col("_w") * (F.col("score") - F.col("_m")) ** 2) / F.sum("_w")).alias("_v"))
    return out.select("symbol", "n_scored", "n_usable", F.when(F.col("n_usable") >= LEAST_SCORED, F.least(F.greatest("_v", F.lit(0.0)), F.lit(1.0))).alias("conflict"))


def uncertainty(summary: DataFrame, days: DataFrame, conflicts: DataFrame) -> DataFrame:
    """symbol, coverage, conflict, instability, score, grade: the index over what is measured.

    Too few scores stay in the average with value 0; without any score the conflict leaves it.
    """
    rows = summary.join(days, "symbol", "left").join(conflicts, "symbol", "left").fillna(0, ["regulatory_days", "news_days", "social_days", "n_scored", "n_usable"])
    n = F.col("trading_days")
    coverage = 1 - (F.col("regulatory_days") / n + F.col("news_days") / n + F.col("social_days") / n + 1) / 4
    calm = lambda c, most: F.least(F.abs(c) / most, F.lit(1.0))
    instability = 0.6 * calm(F.col("volatility"), 50) + 0.4 * calm(F.col("max_drawdown_pct"), 25)
    weight = F.lit(COVERAGE + INSTABILITY) + F.when(F.col("n_scored") > 0, CONFLICT).otherwise(0.0)
    score = (COVERAGE * F.col("coverage") + CONFLICT * F.coalesce("conflict", F.lit(0.0)) + INSTABILITY * F.col("instability")) / weight * 100
    grade = F.when((F.col("n_scored") > 0) & (F.col("n_usable") >= HIGH_SCORED), "High").otherwise("Medium")
    rows = rows.where("trading_days > 0").withColumns({"coverage": coverage, "instability": instability})
    return rows.select("symbol", F.bround("coverage", 6).alias("coverage"), F.bround("conflict", 6).alias("conflict"), F.bround("instability", 6).alias("instability"), F.bround(score, 1).alias("score"), grade.alias("grade"))
