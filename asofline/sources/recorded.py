"""Connectors over recorded payloads: a folder of a provider's answers, laid out by day.

An interval is read a slice at a time, a slice being a symbol's day.  Slices that weren't asked for aren't opened: the day
is a partition of the folder, so Spark prunes it, and the symbol is pushed down into the files.  A slice may have several pages;
its entries are taken in their order up to a cap.  A slice with a page that can't be read fails by itself: it is told in the
status and gives no entry, and the other slices are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import parsers

SCHEMA = "symbol string, page int, body string, day date"


def record(payloads: DataFrame, path: str) -> None:
    """Add payloads (symbol, day, page, body) to a folder; a day's are one file, whatever its number of symbols, split where it is large."""
    payloads.select("symbol", "page", "body", "day").repartition("day").sortWithinPartitions("day", "symbol", "page").write.mode("append").partitionBy("day").parquet(path)


@dataclass(frozen=True)
class Provider:
    """Prefix of a provider's article ids, the schema of an entry, where the entries are in its body, and how many a slice gives at most."""

    prefix: str
    entries: str
    entry: str
    published: str
    most: int


#: Fields and daily limits of the providers.
KEYWORDS = Provider("gdelt", "articles", "struct<url: string, title: string, seendate: string>", "seendate", 20)
ENTITIES = Provider("mux", "data", "struct<url: string, title: string, published_at: string>", "published_at", 20)


def asked(spark: SparkSession, symbols: list[str], last: str, days_back: int = 7) -> DataFrame:
    """symbol, day of the slices of an interval that ends with a day; a row for each, as the request names them."""
    names = spark.createDataFrame([(s,) for s in dict.fromkeys(symbols)], "symbol string")
    day = F.lit(last).cast("date")
    return names.withColumn("day", F.explode(F.sequence(F.date_sub(day, days_back), day)))


def traversed(spark: SparkSession, path: str, provider: Provider, symbols: list[str], last: str, days_back: int = 7) -> tuple[DataFrame, DataFrame]:
    """(symbol, id, title, url, published_at of the articles, each once, and symbol, day, status, n_articles of every slice) of an interval.

    Status: ok, empty (an answer without entries), failed (a page can't be read) or missing (nothing was recorded).  Articles are
    told that appeared up to the end of the last day.
    """
    day, wanted = F.lit(last).cast("date"), list(dict.fromkeys(symbols))
    raw = spark.read.schema(SCHEMA).parquet(path).where(F.col("day").between(F.date_sub(day, days_back), day) & F.col("symbol").isin(wanted))
    body = F.from_json("body", f"struct<`{provider.entries}`: array<{provider.entry}>>")
    pages = raw.select("symbol", "day", "page", body[provider.entries].alias("_e"))
    slices = pages.groupBy("symbol", "day").agg(F.count_if(F.col("_e").isNull()).alias("_broken"), F.sum(F.size("_e")).alias("_n"))
    good = pages.join(slices.where("_broken = 0").select("symbol", "day"), ["symbol", "day"], "left_semi").select("symbol", "day", "page", F.posexplode("_e").alias("_k", "_x"))
    place = W.partitionBy("symbol", "day").orderBy("page", "_k")
    taken = good.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= provider.most)
    rows = taken.select("symbol", "day", "_place", parsers.article_id(provider.prefix, F.col("_x.url")).alias("id"), F.col("_x.title").alias("title"), F.col("_x.url").alias("url"), parsers.instant(F.col(f"_x.{provider.published}")).alias("published_at"))
    rows = rows.where(F.to_date("published_at") <= day)
    once = rows.groupBy("symbol", "id").agg(F.min(F.struct("day", "_place", "title", "url", "published_at")).alias("_f")).select("symbol", "id", "_f.title", "_f.url", "_f.published_at")
    counts = rows.groupBy("symbol", "day").agg(F.count("*").alias("n_articles"))
    status = F.when(F.col("_broken").isNull(), "missing").when(F.col("_broken") > 0, "failed").when(F.col("_n") == 0, "empty").otherwise("ok")
    told = asked(spark, wanted, last, days_back).join(slices, ["symbol", "day"], "left").join(counts, ["symbol", "day"], "left")
    return once, told.select("symbol", "day", status.alias("status"), F.coalesce("n_articles", F.lit(0)).alias("n_articles"))
