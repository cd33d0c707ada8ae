"""The domain's stores: what a batch of each kind does to the rows that are stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import upsert
from .versioned import VersionedTable

#: Columns of a stored case that a second save leaves as they are.
CASE_KEPT = ("symbol", "peak", "created_at")


def _table(spark: SparkSession, path: str, ddl: str, keys: list[str], merge) -> VersionedTable:
    return VersionedTable(spark, path, StructType.fromDDL(ddl), keys, merge)


def filings(spark: SparkSession, path: str) -> VersionedTable:
    """K1: filings by number; what is known stays, rows without a number aren't taken, symbols are in upper case."""
    return _table(spark, path, "accession string, form_type string, filed_at timestamp, symbol string, url string", ["accession"], lambda old, new: upsert.insert_new(old, new.withColumn("symbol", F.upper("symbol")), ["accession"], ["filed_at", "form_type"]))


def prices(spark: SparkSession, path: str) -> VersionedTable:
    """K1: bars by symbol and day; what is known stays.  Symbols are put in upper case before they are dealt."""
    return _table(spark, path, "symbol string, date date, open double, high double, low double, close double, volume double", ["symbol", "date"], lambda old, new: upsert.insert_new(old, new, ["symbol", "date"], ["close", "volume"]))


def news(spark: SparkSession, path: str) -> VersionedTable:
    """K2: articles by id, whatever their symbol: the first that brings one owns it."""
    return _table(spark, path, "id string, title string, description string, source string, published_at timestamp, symbol string, url string", ["id"], lambda old, new: upsert.insert_new(old, new.withColumn("symbol", F.upper("symbol")), ["id"], ["published_at", "symbol", "title"]))


def sentiments(spark: SparkSession, path: str) -> VersionedTable:
    """K6: scores by article; the last one wins (column at)."""
    return _table(spark, path, "article_id string, score double, at timestamp", ["article_id"], lambda old, new: upsert.latest_wins(old, new, ["article_id"], ["at"]))


def filing_summaries(spark: SparkSession, path: str) -> VersionedTable:
    """K6: structured summaries by filing number; the last one wins."""
    return _table(spark, path, "accession string, event_type string, relevance double, sentiment double, at timestamp", ["accession"], lambda old, new: upsert.latest_wins(old, new, ["accession"], ["at"]))


def verdicts(spark: SparkSession, path: str) -> VersionedTable:
    """K4: verdicts by article and symbol; the later one wins, but those of users stay."""
    ddl = "article_id string, symbol string, relevant boolean, decision string, decision_source string, category string, confidence double, arrival long"
    return _table(spark, path, ddl, ["article_id", "symbol"], upsert.verdicts)


def cases(spark: SparkSession, path: str) -> VersionedTable:
    """K7: cases by id; a second save changes all but the symbol, the peak and when the case was made."""
    ddl = "case_id string, symbol string, peak date, created_at timestamp, decision_date date, news_source string, score double, daily_return_pct double, flags string, sentiment_direction string, completeness string, body string"

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        return upsert.latest_wins(old, new, ["case_id"], ["created_at", "body"], keep=list(CASE_KEPT))

    return _table(spark, path, ddl, ["case_id"], merge)


def recent_cases(rows: DataFrame, most: int = 50) -> DataFrame:
    """The cases that were made last."""
    return rows.orderBy(F.col("created_at").desc(), "case_id").limit(max(1, most))


def cases_of(rows: DataFrame, symbol: str, most: int = 20) -> DataFrame:
    """A symbol's cases, the latest peak first."""
    return rows.where(F.col("symbol") == symbol.strip().upper()).orderBy(F.col("peak").desc()).limit(max(1, most))


def case_by(rows: DataFrame, symbol: str, peak: str) -> DataFrame:
    """The case of a symbol and peak."""
    return rows.where(F.col("case_id") == f"{symbol.strip().upper()}:{peak}")
