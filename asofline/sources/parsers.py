"""Parsers of provider payloads: a column of JSON text becomes typed rows; what can't be read is dropped, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip_html

FILING_FORMS = ("10-K", "10-Q", "8-K", "10-K/A", "10-Q/A", "8-K/A")
#: Timestamp formats, in the order they are tried.
FORMATS = ("yyyyMMdd'T'HHmmss'Z'", "yyyyMMdd'T'HHmmss", "yyyyMMddHHmmss", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def instant(text: Column) -> Column:
    """A UTC timestamp from the first format that reads the text; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in FORMATS])


def article_id(prefix: str, url: Column) -> Column:
    """Id of an article from its URL, whatever the case and the blanks around it."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.lower(F.trim(url)), 256), 1, 32))


def daily_prices(raw: DataFrame, as_of: Column, days: int) -> DataFrame:
    """symbol, date, open, high, low, close, volume, newest first up to `days` rows a symbol; raw: symbol, body."""
    bars = F.from_json("body", "struct<`Time Series (Daily)`: map<string, struct<`1. open`: string, `2. high`: string, `3. low`: string, `4. close`: string, `5. volume`: string>>>")["Time Series (Daily)"]
    rows = raw.select("symbol", F.explode(bars).alias("_d", "_b"))
    number = lambda n: F.expr(f"try_cast(_b.`{n}` as double)")
    out = rows.select("symbol", F.expr("try_cast(_d as date)").alias("date"), number("1. open").alias("open"), number("2. high").alias("high"), number("3. low").alias("low"), number("4. close").alias("close"), number("5. volume").alias("volume"))
    good = out.dropna().where(F.col("date") <= as_of)
    return good.withColumn("n", F.row_number().over(W.partitionBy("symbol").orderBy(F.col("date").desc()))).where(F.col("n") <= days).drop("n")


def columnar_filings(raw: DataFrame) -> DataFrame:
    """symbol, accession, form_type, filed_at, url of the known forms; raw: symbol, cik, body with arrays of equal length."""
    recent = F.from_json("body", "struct<filings: struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, primaryDocument: array<string>>>>")["filings"]["recent"]
    zipped = F.arrays_zip(recent["accessionNumber"].alias("a"), recent["form"].alias("f"), recent["filingDate"].alias("d"))
    rows = raw.select("symbol", "cik", F.explode(zipped).alias("_z")).select("symbol", "cik", F.col("_z.a").alias("accession"), F.col("_z.f").alias("form_type"), F.expr("try_cast(_z.d as timestamp)").alias("filed_at"))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.ltrim(F.col("cik"), F.lit("0")), F.lit("/"), F.replace(F.col("accession"), F.lit("-"), F.lit("")), F.lit("/"))
    return rows.where(F.col("form_type").isin(*FILING_FORMS) & F.col("filed_at").isNotNull()).select("symbol", "accession", "form_type", "filed_at", url.alias("url"))


def keyword_articles(raw: DataFrame, as_of: Column, days: int = 7, most: int | None = None) -> DataFrame:
    """id, title, url, published_at of the articles of the last days, each once, `most` a day where that is named (the first by id); raw: body with articles[]."""
    a = F.from_json("body", "struct<articles: array<struct<url: string, title: string, seendate: string, domain: string>>>")["articles"]
    rows = raw.select(F.explode(a).alias("_a")).select(article_id("gdelt", F.col("_a.url")).alias("id"), F.col("_a.title").alias("title"), F.col("_a.url").alias("url"), instant(F.col("_a.seendate")).alias("published_at"))
    good = rows.where(F.to_date("published_at").between(F.date_sub(as_of, days), as_of))
    once = good.groupBy("id").agg(F.min(F.struct("published_at", "title", "url")).alias("_x")).select("id", "_x.title", "_x.url", "_x.published_at")
    if most is None:
        return once
    return once.withColumn("_k", F.row_number().over(W.partitionBy(F.to_date("published_at")).orderBy("id"))).where(F.col("_k") <= most).drop("_k")


def entity_stories(raw: DataFrame, most: int = 100) -> DataFrame:
    """symbol, id, title, published_at (by the day) of the top articles of an entity's stories, where the entity has the ticker; `most` a day; raw: symbol, body."""
    body = F.from_json("body", "struct<entity: struct<tickers: array<string>>, stories: array<struct<date: string, top_articles: array<struct<url: string, title: string>>>>>")
    rows = raw.select("symbol", body.alias("_b")).where(F.exists("_b.entity.tickers", lambda t: F.upper(t) == F.upper("symbol")))
    s = rows.select("symbol", F.explode("_b.stories").alias("_s")).select("symbol", F.col("_s.date").alias("_d"), F.explode("_s.top_articles").alias("_a"))
    place = F.row_number().over(W.partitionBy("symbol", "_d").orderBy("_a.url"))
    s = s.withColumn("_k", place).where(F.col("_k") <= most)
    return s.select("symbol", article_id("gdc", F.col("_a.url")).alias("id"), F.col("_a.title").alias("title"), F.expr("try_cast(_d as timestamp)").alias("published_at")).dropna(subset=["published_at"])


def entity_sentiment(raw: DataFrame) -> DataFrame:
    """symbol, id, title, published_at, sentiment_score (of the symbol's own entity, four digits); raw: symbol, body with data[]."""
    d = F.from_json("body", "struct<data: array<struct<url: string, title: string, published_at: string, entities: array<struct<symbol: string, sentiment_score: double>>>>>")["data"]
    rows = raw.select("symbol", F.explode(d).alias("_a"))
    own = F.try_element_at(F.filter("_a.entities", lambda e: F.upper(e["symbol"]) == F.upper("symbol")), F.lit(1))["sentiment_score"]
    return rows.select("symbol", article_id("mux", F.col("_a.url")).alias("id"), F.col("_a.title").alias("title"), instant(F.col("_a.published_at")).alias("published_at"), F.bround(own, 4).alias("sentiment_score")).dropna(subset=["published_at"])


def feed_sentiment(raw: DataFrame, most: int = 50) -> DataFrame:
    """id, title, published_at, sentiment_score (text, kept from -1 to 1) of the first `most` entries of each payload; raw: body with feed[]."""
    f = F.from_json("body", "struct<feed: array<struct<url: string, title: string, time_published: string, overall_sentiment_score: string>>>")["feed"]
    rows = raw.select(F.explode(F.slice(f, 1, most)).alias("_a"))
    score = F.expr("try_cast(_a.overall_sentiment_score as double)")
    return rows.select(article_id("avnews", F.col("_a.url")).alias("id"), F.col("_a.title").alias("title"), instant(F.col("_a.time_published")).alias("published_at"), F.when(score.between(-1, 1), score).alias("sentiment_score")).dropna(subset=["published_at"])


def posts(raw: DataFrame, since: Column, until: Column, most: int = 6) -> DataFrame:
    """id, community, title, excerpt, created_at, score: the posts of the highest score in a range of time; raw: body with data[]."""
    d = F.from_json("body", "struct<data: array<struct<id: string, subreddit: string, title: string, selftext: string, created_utc: double, score: int>>>")["data"]
    rows = raw.select(F.explode(d).alias("_p")).select("_p.id", F.col("_p.subreddit").alias("community"), "_p.title", F.when(F.length("_p.selftext") > 300, F.concat(F.substring("_p.selftext", 1, 300), F.lit("…"))).otherwise(F.col("_p.selftext")).alias("excerpt"), F.timestamp_seconds("_p.created_utc").alias("created_at"), F.col("_p.score").alias("score"))
    once = rows.where(F.col("created_at").between(since, until)).groupBy("id").agg(F.max(F.struct("score", "community", "title", "excerpt", "created_at")).alias("_x")).select("id", "_x.*")
    return once.orderBy(F.col("score").desc(), "id").limit(most)


def primary_document(names: Column) -> Column:
    """The main document of a filing's folder (array of file names): the first page that is no index, report part or markup data, else the first text."""
    low = lambda n: F.lower(n)
    page = F.filter(names, lambda n: low(n).rlike(r"\.html?$") & ~low(n).rlike(r"index|^r\d+\.htm|nav|financial_report|\.xml"))
    text = F.filter(names, lambda n: low(n).endswith(".txt") & ~low(n).contains("index"))
    return F.coalesce(F.try_element_at(page, F.lit(1)), F.try_element_at(text, F.lit(1)))


def directory(raw: DataFrame) -> DataFrame:
    """symbol, name, cik of a directory object; raw: body."""
    entries = F.from_json("body", "map<string, struct<name: string, cik: string>>")
    return raw.select(F.explode(entries).alias("_k", "_v")).select(F.upper(F.trim("_k")).alias("symbol"), "_v.name", F.lpad(F.regexp_replace("_v.cik", r"\D", ""), 10, "0").alias("cik"))


def company_profile(raw: DataFrame) -> DataFrame:
    """symbol, name, cik, exchange, sector of a filer's record: its first ticker and exchange, its industry as the sector; one without a ticker is none; raw: cik, body."""
    b = F.from_json("body", "struct<name: string, tickers: array<string>, exchanges: array<string>, sicDescription: string>")
    rows = raw.select(F.lpad(F.regexp_replace("cik", r"\D", ""), 10, "0").alias("cik"), b.alias("_b"))
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    out = rows.select(F.upper(first(F.col("_b.tickers"))).alias("symbol"), F.coalesce("_b.name", F.lit("")).alias("name"), "cik", first(F.col("_b.exchanges")).alias("exchange"), F.coalesce("_b.sicDescription", F.lit("")).alias("sector"))
    return out.where("symbol <> ''")


def fallback_profile(raw: DataFrame) -> DataFrame:
    """symbol, name, cik, exchange, industry of the second provider's record; an unknown symbol, which has no name, is none; raw: symbol, body."""
    b = F.from_json("body", "struct<name: string, exchange: string, finnhubIndustry: string, cik: string>")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = raw.select(F.upper(F.trim("symbol")).alias("symbol"), b.alias("_b"))
    return rows.select("symbol", text("_b.name").alias("name"), text("_b.cik").alias("cik"), text("_b.exchange").alias("exchange"), text("_b.finnhubIndustry").alias("industry")).where("name <> '' and symbol <> ''")


def folder_names(body: Column) -> Column:
    """File names of a filing's folder listing; null where it can't be read."""
    items = F.from_json(body, "struct<directory: struct<item: array<struct<name: string>>>>")["directory"]["item"]
    return F.transform(items, lambda i: i["name"])


def filing_documents(folders: DataFrame, files: DataFrame, most: int = 1_500_000) -> DataFrame:
    """accession, name, text of each filing's main document without markup, up to `most` characters; folders: accession, body (its listing); files: accession, name, html."""
    main = folders.select("accession", primary_document(folder_names(F.col("body"))).alias("name")).where("name is not null")
    return main.join(files, ["accession", "name"]).select("accession", "name", F.substring(strip_html(F.col("html")), 1, most).alias("text"))


def no_news(spark: SparkSession) -> DataFrame:
    """The source of a provider that isn't configured: no rows, with the columns of news."""
    return spark.createDataFrame([], "id string, title string, description string, source string, published_at timestamp, symbol string, url string, sentiment_score decimal(18,4)")
