"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, component (smallest node reachable) of every node with an edge to another.

    Nodes are longs; null ends and loops don't count; repeated edges count once.  A step aggregates the
    smallest neighbour of each node, partly before the shuffle, and joins it back, so a node with many
    neighbours is no group of one task.  Both stars of a round are one job, which reads the large one's exchange twice.  The job that writes a round's edges also sums them up; rounds end
    when these are the same as before.
    """
    e = edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).where(f"{u} is not null and {v} is not null and a > b").distinct()
    e = saved(e, "edges")  # each step looks at it several times
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation("edges")
        now = small.unionByName(least.withColumnRenamed("m", "b")).distinct()
        e = saved(now.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")), "stars")
        told = seen.get
        if told == before or not told.get("n"):
            roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return saved(e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "labels")
        before = told


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after more links (u, v): only the components that the links join are worked on."""
    u, v = (labels.select(F.col("node").alias(c), F.col("component").alias(f"_c{c}")) for c in "uv")
    between = links.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("_cu", "u").alias("u"), F.coalesce("_cv", "v").alias("v"))
    merged = components(between)
    ends = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).distinct().join(labels, "node", "left_anti")
    everyone = labels.unionByName(ends.select("node", F.col("node").alias("component")))
    renamed = merged.select(F.col("node").alias("component"), F.col("component").alias("_new"))
    return saved(everyone.join(renamed, "component", "left").select("node", F.coalesce("_new", "component").alias("component")), "labels")
