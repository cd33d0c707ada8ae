"""Edges of words beside letters that aren't ASCII, and character references that aren't finished."""

import duckdb
import pytest
from pyspark.sql import functions as F
from sqlcheck import ordered

from asofline.functions import text as X
from asofline.operators import documents
from asofline.plans import catalog


def sql_rows(sql, folder, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c.sql(sql).fetchdf()


@pytest.mark.parametrize("name", ["p7_rule_judge", "p7_rule_reasons"])
def test_words_end_at_letters_that_are_not_ascii(spark, tmp_path, name):
    texts = ["das éthingñ suesóñar dá", "íta suesórr", "über Übans", "SUES", "suesa", "thing_ sues", "idiotß bans", "gdpé", None, "xthing", "x" * 119 + " sued on"]
    spark.createDataFrame(list(enumerate(texts * 4)), "doc_id long, text string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    expected = ordered(sql_rows(catalog.SQL[name], tmp_path, "documents"))
    assert ordered(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == expected


def test_batch_verdicts_beside_letters_that_are_not_ascii(spark, tmp_path):
    texts = ["das éthingñ suesóñar dá", "íta suesórr", "SUES", "thing sues", None] * 7
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(0, 35, 4)], "doc_id long, quality int, toxic int").toPandas().to_parquet(f"{tmp_path}/labels.parquet")
    expected = ordered(sql_rows(catalog.SQL["g2_batch_verdicts"], tmp_path, "documents", "labels"))
    assert ordered(catalog.QUERIES["g2_batch_verdicts"](spark, str(tmp_path)).toPandas()) == expected


PAGES = ["<p>the&amp des&amp; &ampx; &lt b &copy</p>", "<b>a &amp;amp; &amp;lt; &nbsp;b</b>&&&amp", "the théthe ñthe THE", None, "x" * 2997 + "&amp the"]


@pytest.mark.parametrize("name", ["t16_html_strip", "s25_filing_documents", "t14_term_frequency"])
def test_pages_with_unfinished_references(spark, tmp_path, name):
    spark.createDataFrame([(k, p) for k, p in enumerate(p for p in PAGES for _ in range(4))], "page_id long, html string").toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    expected = ordered(sql_rows(catalog.SQL[name], tmp_path, "pages"))
    assert ordered(catalog.QUERIES[name](spark, str(tmp_path)).toPandas()) == expected


def test_hits_end_at_letters_that_are_not_ascii(spark):
    assert spark.range(1).select(documents._hits(F.lit("The théthe ñthe, xthe"), ("the",)).alias("n")).first().n == 3


def test_references_of_all_kinds(spark):
    texts = ["&eacute;&#233;&#xE9;", "&notit; &not; &not", "&amp;#233;", "&;&#;&#x;"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.decoded(F.col("t")).alias("v")).collect()]
    assert got == ["ééé", "&notit; ¬ &not", "&#233;", "&;&#;&#x;"]
