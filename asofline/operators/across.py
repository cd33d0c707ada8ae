"""Threads of two symbols compared: clusters of each one's newest articles, and the pairs of clusters that are near.

A request names two symbols.  Each side has at most MAX_DOCS articles, the feature's limit, so a request is at most that many
squared pairs of articles, and requests are independent keys.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..storage import kept
from . import threads

#: Articles of a symbol, cosines of near and of equal clusters, pairs of a request, and label terms.
MAX_DOCS, NEAR, EQUAL, MAX_PAIRS, TERMS = 30, 0.70, 0.999, 10, 6


def clusters(docs: DataFrame, link: float = threads.VECTOR_LINK) -> DataFrame:
    """symbol, id, cluster, place: clusters numbered from the largest, of equal ones the one of the newer first article, and the members in the order in which they were merged."""

    def parts(docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("pos")
        ids, symbol = docs["id"].tolist(), docs["symbol"].iloc[0]
        found = sorted(threads._merges(docs["vector"].tolist(), link)[0], key=len, reverse=True)
        rows = [(symbol, ids[k], c, p) for c, members in enumerate(found) for p, k in enumerate(members)]
        return pd.DataFrame(rows, columns=["symbol", "id", "cluster", "place"])

    return docs.select("symbol", "id", "pos", "vector").groupBy("symbol").applyInPandas(parts, "symbol string, id string, cluster long, place long")


def described(members: DataFrame) -> DataFrame:
    """symbol, cluster, title (the longest, of equal ones the first), terms, cohesion (mean cosine of its pairs, null for one article), members in their order."""
    key = ["symbol", "cluster"]
    title = F.coalesce("title", F.lit(""))
    rows = members.groupBy(*key).agg(
        F.max_by(title, F.struct(F.length(title).alias("n"), (-F.col("place")).alias("k"))).alias("title"),
        F.transform(F.sort_array(F.collect_list(F.struct("place", "id", title.alias("title"), F.coalesce("url", F.lit("")).alias("url")))), lambda m: m.dropFields("place")).alias("members"),
    )
    top = threads.top_terms(members.withColumn("thread", F.col("cluster")), TERMS).withColumnRenamed("thread", "cluster")
    top = top.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("terms"))
    other = members.select(*key, F.col("place").alias("_p"), F.col("vector").alias("_v"))
    inside = members.select(*key, "place", "vector").join(other, key).where("place < _p").groupBy(*key).agg(F.bround(F.avg(cosine(F.col("vector"), F.col("_v"))), 3).alias("cohesion"))
    return rows.join(top, key, "left").join(inside, key, "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def near_clusters(docs: DataFrame, requests: DataFrame, link: float = threads.VECTOR_LINK, near: float = NEAR) -> DataFrame:
    """request, duplicates, pairs: a row for each request (request, a, b); docs: symbol, id, title, description, url, published_at, vector.

    A pair tells both clusters' titles, cohesion and members, the best and the mean cosine of their articles, and the label terms
    they share in a's order.  An article that both symbols have proves nothing.  A pair whose best is EQUAL or more is the same
    content twice: it is counted in duplicates and left out.  Pairs are the MAX_PAIRS of the highest rounded best of `near` and more,
    of equal ones that of the lower clusters.  A request of one symbol twice, or of one without articles, has no pairs and no duplicates.
    """
    newest = threads.newest(docs.where(F.col("vector").isNotNull()), MAX_DOCS)
    newest = kept(newest.select("symbol", "id", "pos", "title", "description", "url", F.col("vector").cast("array<double>").alias("vector")), "newest")
    members = kept(newest.join(clusters(newest, link), ["symbol", "id"]), "clustered")
    told = described(members)
    asked = requests.where("a <> b")

    side = lambda s: members.select(F.col("symbol").alias(s), F.col("cluster").alias(f"c{s}"), F.col("id").alias(f"_i{s}"), F.col("vector").alias(f"_v{s}"))
    both = asked.join(side("a"), "a").join(side("b"), "b").where("_ia <> _ib").select("request", "a", "b", "ca", "cb", cosine(F.col("_va"), F.col("_vb")).alias("_s"))
    best = both.groupBy("request", "a", "b", "ca", "cb").agg(F.greatest(F.max("_s"), F.lit(0.0)).alias("_best"), F.avg("_s").alias("_mean"))
    best = kept(best.withColumn("similarity", F.bround("_best", 3)), "cluster_pairs")
    twice = best.where(F.col("_best") >= EQUAL).groupBy("request").agg(F.count("*").alias("duplicates"))
    place = W.partitionBy("request").orderBy(F.col("similarity").desc(), "ca", "cb")
    first = best.where((F.col("_best") >= near) & (F.col("_best") < EQUAL)).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= MAX_PAIRS)

    of = lambda s: told.select(F.col("symbol").alias(s), F.col("cluster").alias(f"c{s}"), *[F.col(c).alias(f"{s}_{c}") for c in ("title", "cohesion", "members", "terms")])
    full = first.join(of("a"), ["a", "ca"]).join(of("b"), ["b", "cb"])
    shared = F.slice(F.filter("a_terms", lambda t: F.array_contains("b_terms", t)), 1, TERMS)
    pair = F.struct("rank", F.col("a").alias("a_symbol"), "a_title", F.col("b").alias("b_symbol"), "b_title", "similarity", F.bround("_mean", 3).alias("mean"), "a_cohesion", "b_cohesion", shared.alias("shared"), "a_members", "b_members")
    pairs = full.groupBy("request").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))  # MAX_PAIRS at most
    out = requests.select("request").join(twice, "request", "left").join(pairs, "request", "left")
    return out.select("request", F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("pairs", F.array().cast(pairs.schema["pairs"].dataType)).alias("pairs"))
