"""Relevance verdicts: precedence, normalisation, decisions and census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a model's verdict below this confidence is uncertain.
SURE = 0.65
#: Fixed value: characters of a stored reason.
MAX_REASON = 500


def census(news: DataFrame, verdicts: DataFrame) -> DataFrame:
    """symbol, relevant, irrelevant, uncertain: articles by verdict; those without one are uncertain."""
    v = verdicts.select(F.col("article_id").alias("id"), "symbol", "decision")
    d = F.coalesce("decision", F.lit("UNCERTAIN"))
    n = lambda x: F.count_if(d == x).alias(x.lower())
    return news.join(v, ["id", "symbol"], "left").groupBy("symbol").agg(n("RELEVANT"), n("IRRELEVANT"), n("UNCERTAIN"))


def by_precedence(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """article_id, symbol, decision, provenance: USER verdicts are final, AI ones stand while their model is current, else the fresh one counts."""
    f = fresh.select("article_id", "symbol", F.col("decision").alias("_fresh"))
    stands = F.when(F.col("decision_source") == "USER", "USER").when((F.col("decision_source") == "AI") & F.col("current"), "AI")
    both = cached.join(f, ["article_id", "symbol"], "full_outer").withColumn("_s", stands)
    return both.select("article_id", "symbol", F.when(F.col("_s").isNotNull(), F.col("decision")).otherwise(F.coalesce("_fresh", "decision")).alias("decision"), F.coalesce("_s", F.lit("REJUDGED")).alias("provenance"))


def normalised(verdicts: DataFrame) -> DataFrame:
    """Verdicts of a model as they are stored: unknown categories are UNRELATED, unsure ones uncertain."""
    from ..sources.tables import CATEGORIES

    sure = F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) >= SURE
    category = F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("UNRELATED")
    return verdicts.withColumns({"decision": F.when(sure, F.col("decision")).otherwise("UNCERTAIN"), "relevant": F.when(sure, F.col("relevant")), "category": F.when(sure, category).otherwise("UNRELATED")})


def classified(batch: DataFrame, answers: DataFrame, rule: Column) -> DataFrame:
    """id, relevant, decision, decision_source, category, confidence, reason of each article of a batch: the model's answer as it is stored, or the rule's verdict where the model left the article out.

    answers: id, place, relevant, category, confidence, reason; of several for one article the first counts, those of other articles don't.
    rule: the verdict of functions.text.judge over the batch's columns.
    """
    from ..functions.text import rule_reason
    from ..sources.tables import CATEGORIES

    first = answers.groupBy("id").agg(F.min_by(F.struct("relevant", "category", "confidence", "reason"), "place").alias("_a"))
    both = batch.select("id", rule.alias("_r")).join(first, "id", "left")
    told, category = F.col("_a").isNotNull(), F.upper(F.coalesce("_a.category", F.lit("")))
    confidence = F.least(F.greatest(F.col("_a.confidence"), F.lit(0.0)), F.lit(1.0))
    sure = confidence >= SURE
    ai = F.struct(
        F.when(sure, F.col("_a.relevant")).alias("relevant"), F.when(~sure, "UNCERTAIN").when(F.col("_a.relevant"), "RELEVANT").otherwise("IRRELEVANT").alias("decision"), F.lit("AI").alias("decision_source"),
        F.when(sure & category.isin(*CATEGORIES), category).otherwise("UNRELATED").alias("category"), confidence.alias("confidence"), F.substring("_a.reason", 1, MAX_REASON).alias("reason"),
    )
    r = F.col("_r")
    by_rule = F.struct(r["relevant"].alias("relevant"), r["decision"].alias("decision"), F.lit("RULE").alias("decision_source"), r["category"].alias("category"), r["confidence"].cast("double").alias("confidence"), rule_reason(r).alias("reason"))
    return both.select("id", F.when(told, ai).otherwise(by_rule).alias("_v")).select("id", "_v.*")


def decide(verdicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """verdicts with a user's decisions (article_id, symbol, approve) applied; those of unknown articles have no effect."""
    d = decisions.groupBy("article_id", "symbol").agg(F.max("approve").alias("_a"))
    both = verdicts.join(d, ["article_id", "symbol"], "left")
    told = F.col("_a").isNotNull()
    return both.withColumns({
        "decision": F.when(told, F.when(F.col("_a"), "USER_APPROVED").otherwise("IRRELEVANT")).otherwise(F.col("decision")),
        "relevant": F.when(told, F.col("_a")).otherwise(F.col("relevant")), "decision_source": F.when(told, "USER").otherwise(F.col("decision_source")),
    }).drop("_a")
