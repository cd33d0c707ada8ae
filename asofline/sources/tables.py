"""Domain views of point-in-time market data over the sample tables.

Every view is a plain DataFrame of its table; none is cached or collected.  ORACLE has the same views as SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SYMBOLS = 25
#: Minutes between two published articles, and when the first one is published.
NEWS_STEP, NEWS_START = 97, "1998-01-01 00:00:00"
#: Display names of the news sources.
SOURCES = ("GDELT 2.0 DOC API", "GDELT Cloud", "Alpha Vantage", "MarketAux")
#: Categories of relevance, in their canonical order.
CATEGORIES = (
    "FINANCIAL", "MARKET", "PRODUCT", "OPERATIONS", "SUPPLY_CHAIN", "MANAGEMENT", "STRATEGY", "LEGAL", "REGULATORY", "TECHNOLOGY",
    "CUSTOMER_DEMAND", "COMPETITIVE", "MACROECONOMIC", "GEOPOLITICAL", "REPUTATIONAL", "LABOR", "OTHER_MATERIAL",
)
FORMS = {"1": "8-K", "2": "8-K/A", "3": "10-Q", "4": "10-K", "5": "10-K/A"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(number):
    """The symbol that an integer column stands for: Brand#1 to Brand#25."""
    return F.concat(F.lit("Brand#"), (F.pmod(number, F.lit(SYMBOLS)) + 1).cast("int").cast("string"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume: daily bars of a part's brand."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("date"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    tick = F.struct((F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("k"), price.alias("p"))
    day = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", "date")
    out = day.agg(F.min(tick).alias("_o"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(tick).alias("_c"), F.sum("l_quantity").alias("volume"))
    return out.select("symbol", "date", F.col("_o.p").alias("open"), "high", "low", F.col("_c.p").alias("close"), "volume")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, form_type, filed_at (midnight), symbol, url: filings are known by the day."""
    o = table(spark, sf_dir, "orders")
    form = F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv])[F.substring("o_orderpriority", 1, 1)]
    accession = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    return o.select(
        accession.alias("accession"), form.alias("form_type"), F.col("o_orderdate").cast("timestamp").alias("filed_at"), symbol_of(F.col("o_orderkey")).alias("symbol"),
        F.concat(F.lit("https://filings.example/data/"), accession, F.lit("/")).alias("url"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, description, source, published_at, symbol, url, sentiment_score; title and description are the whole text."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (n % 4 + 1).cast("int"))
    return d.select(
        n.cast("string").alias("id"), F.substring("text", 1, 120).alias("title"), F.expr("substring(text, 121)").alias("description"), source.alias("source"),
        F.timestamp_seconds(F.unix_timestamp(F.lit(NEWS_START)) + n * NEWS_STEP * 60).alias("published_at"), symbol_of(n).alias("symbol"),
        F.concat(F.lit("HTTPS://News.Example/"), n.cast("string"), F.lit(" ")).alias("url"),
        F.when(n % 3 == 0, ((n * 37 % 201 - 100) / 100).cast("decimal(18,4)")).alias("sentiment_score"),
    )


def wording() -> Column:
    """Title and description of an article, which is what words are counted in."""
    return F.concat_ws(" ", "title", "description")


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, symbol, relevant, decision, decision_source, category, confidence: verdicts of some articles."""
    n = F.col("doc_id")
    decision = F.when(n % 11 == 0, "UNCERTAIN").when(F.col("quality") == 1, "RELEVANT").otherwise("IRRELEVANT")
    category = F.when(F.col("toxic") == 1, "LEGAL").otherwise(F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (n % len(CATEGORIES) + 1).cast("int")))
    return table(spark, sf_dir, "labels").select(
        n.cast("string").alias("article_id"), symbol_of(n).alias("symbol"), F.when(decision != "UNCERTAIN", decision == "RELEVANT").alias("relevant"), decision.alias("decision"),
        F.when(n % 7 == 0, "USER").when(n % 2 == 0, "AI").otherwise("RULE").alias("decision_source"), category.alias("category"), (n % 100 / 100).alias("confidence"),
    )


def social(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, community, created_at, score, symbol: posts."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("community"), (F.col("ts").cast("timestamp") - F.expr("interval 26 years")).alias("created_at"),
        F.col("value").cast("int").alias("score"), symbol_of(F.col("user_id")).alias("symbol"),
    )


def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, score, confidence: model scores of all articles (integers stand in for a model)."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(n.cast("string").alias("article_id"), ((n * 37 % 201 - 100) / 100).alias("score"), (n * 13 % 100 / 100).alias("confidence"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """article_id, vector."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("article_id"), F.col("embedding").alias("vector"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, name, cik, exchange, sector: the directory of symbols."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct()
    k = F.substring("symbol", 7, 2).cast("int")
    return p.select(
        "symbol", F.concat(F.lit("Maker "), F.substring("symbol", 7, 2), F.lit(" Holdings Inc")).alias("name"), F.lpad(k.cast("string"), 10, "0").alias("cik"),
        F.when(k % 3 == 0, "New York Stock Exchange Arca").when(k % 3 == 1, "Nasdaq Global Select").otherwise("otc markets").alias("exchange"), F.concat(F.lit("Sector "), (k % 5).cast("string")).alias("sector"),
    )


#: The same in SQL.
WORDING = "concat_ws(' ', title, description)"
_SYM = "'Brand#' || ({0} % 25 + 1)"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
ORACLE = {
    "bars": """SELECT symbol, date, min({'k': k, 'p': p}).p AS open, max(p) AS high, min(p) AS low, max({'k': k, 'p': p}).p AS close, sum(l_quantity) AS volume FROM (
  SELECT p_brand AS symbol, l_shipdate::DATE AS date, l_orderkey * 1000000000 + l_partkey * 1000 + l_linenumber AS k, l_extendedprice / l_quantity AS p, l_quantity
  FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY symbol, date""",
    "filings": f"""SELECT lpad(o_orderkey::VARCHAR, 18, '0') AS accession, {_LIST(FORMS.values())}[substr(o_orderpriority, 1, 1)::INT] AS form_type, o_orderdate::TIMESTAMP AS filed_at,
  {_SYM.format('o_orderkey')} AS symbol, 'https://filings.example/data/' || lpad(o_orderkey::VARCHAR, 18, '0') || '/' AS url FROM orders""",
    "news": f"""SELECT doc_id::VARCHAR AS id, substr(text, 1, 120) AS title, substr(text, 121) AS description, {_LIST(SOURCES)}[doc_id % 4 + 1] AS source,
  TIMESTAMP '{NEWS_START}' + to_minutes(doc_id * {NEWS_STEP}) AS published_at, {_SYM.format('doc_id')} AS symbol, 'HTTPS://News.Example/' || doc_id || ' ' AS url,
  CASE WHEN doc_id % 3 = 0 THEN ((doc_id * 37 % 201 - 100) / 100)::DECIMAL(18, 4) END AS sentiment_score FROM documents""",
    "relevance": f"""SELECT doc_id::VARCHAR AS article_id, {_SYM.format('doc_id')} AS symbol, CASE WHEN doc_id % 11 <> 0 THEN quality = 1 END AS relevant,
  CASE WHEN doc_id % 11 = 0 THEN 'UNCERTAIN' WHEN quality = 1 THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS decision,
  CASE WHEN doc_id % 7 = 0 THEN 'USER' WHEN doc_id % 2 = 0 THEN 'AI' ELSE 'RULE' END AS decision_source,
  CASE WHEN toxic = 1 THEN 'LEGAL' ELSE {_LIST(CATEGORIES)}[doc_id % 17 + 1] END AS category, doc_id % 100 / 100 AS confidence FROM labels""",
    "social": f"SELECT event_id::VARCHAR AS id, event_type AS community, ts::TIMESTAMP - INTERVAL 26 YEAR AS created_at, trunc(value)::INT AS score, {_SYM.format('user_id')} AS symbol FROM events",
    "sentiment": "SELECT doc_id::VARCHAR AS article_id, (doc_id * 37 % 201 - 100) / 100 AS score, doc_id * 13 % 100 / 100 AS confidence FROM documents",
    "vectors": "SELECT vec_id::VARCHAR AS article_id, embedding AS vector FROM embeddings",
    "companies": """SELECT DISTINCT p_brand AS symbol, 'Maker ' || substr(p_brand, 7, 2) || ' Holdings Inc' AS name, lpad(substr(p_brand, 7, 2), 10, '0') AS cik,
  CASE substr(p_brand, 7, 2)::INT % 3 WHEN 0 THEN 'New York Stock Exchange Arca' WHEN 1 THEN 'Nasdaq Global Select' ELSE 'otc markets' END AS exchange,
  'Sector ' || (substr(p_brand, 7, 2)::INT % 5) AS sector FROM part""",
}


def oracle(*names: str, **more: str) -> str:
    """WITH clause of views, then of the given named queries."""
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in [*((n, ORACLE[n]) for n in names), *more.items()]) + "\n"
