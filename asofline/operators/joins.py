"""As-of and interval joins on symbols.

An as-of join is one union sorted by time inside each period of a symbol, in which the last row of the right side is
carried forward; what earlier periods end with comes from one row a period.  So it makes no pairs, and a symbol with
many rows is as many groups as it has periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, values: list[str], period: str = "month") -> DataFrame:
    """left with the values of right's latest row at or before left_time, null where there is none; rows of right without a time don't count."""
    names = left.columns
    l = left.select(F.struct(*names).alias("_row"), F.col(by).alias("_by"), F.col(left_time).alias("_t"), F.lit(None).cast(right.select(F.struct(right_time, *values).alias("x")).schema["x"].dataType).alias("_v"), F.lit(1).alias("_side"))
    r = right.where(F.col(right_time).isNotNull()).select(F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(by).alias("_by"), F.col(right_time).alias("_t"), F.struct(right_time, *values).alias("_v"), F.lit(0).alias("_side"))
    both = l.unionByName(r).withColumn("_period", F.date_trunc(period, F.col("_t").cast("timestamp")))
    ends = both.groupBy("_by", "_period").agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    earlier = W.partitionBy("_by").orderBy("_period").rowsBetween(W.unboundedPreceding, -1)  # a row a period
    before = ends.select("_by", "_period", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    w = W.partitionBy("_by", "_period").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").join(before, ["_by", "_period"], "left").withColumn("_v", F.coalesce("_v", "_before"))
    return found.select("_row.*", F.col(f"_v.{right_time}").alias(f"{right_time}_as_of"), *(F.col(f"_v.{v}").alias(f"{v}_as_of") for v in values))


def interval_join(left: DataFrame, right: DataFrame, by: str, low: Column, day: Column, high: Column, how: str = "inner") -> DataFrame:
    """Rows of equal `by` whose day lies between low and high; neither bound names a column of both sides."""
    renamed = right.withColumnRenamed(by, "_by")
    return left.join(renamed, (left[by] == F.col("_by")) & (day >= low) & (day <= high), how).drop("_by")


def upto(left: DataFrame, rows: DataFrame, by: str, day: str, sums: dict[str, Column]) -> DataFrame:
    """left (by, day) with running totals of rows (by, _day): each of `sums`, an aggregate of counts or sums, over all rows up to the day of left; 0 where there are none.

    Rows are summed by day first and the days of a key added up, a row a day; left looks up one of them, so no row of left meets rows.
    """
    daily = rows.groupBy(by, "_day").agg(*[c.alias(n) for n, c in sums.items()])
    so_far = W.partitionBy(by).orderBy("_day")
    running = daily.select(by, "_day", *[F.sum(n).over(so_far).alias(n) for n in sums])
    found = as_of_join(left, running, by, day, "_day", list(sums), "year")
    return found.select(*left.columns, *[F.coalesce(f"{n}_as_of", F.lit(0)).alias(n) for n in sums])
