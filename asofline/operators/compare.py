"""Comparison across symbols, and simulated holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def common_days(rows: DataFrame, symbols: list[str]) -> DataFrame:
    """The days on which all the symbols have a bar, each close as an index of 100 at the first of them, and the days dropped."""
    picked = rows.where(F.col("symbol").isin(symbols)).select("symbol", "date", "close")
    day, sym = W.partitionBy("date"), W.partitionBy("symbol").orderBy("date")
    counted = picked.withColumn("_n", F.count("*").over(day))
    all_days = counted.withColumn("dropped_days", F.sum((F.col("_n") < len(symbols)).cast("int")).over(W.partitionBy("symbol")))
    kept = all_days.where(F.col("_n") == len(symbols))
    return kept.select("symbol", "date", F.bround(F.col("close") / F.first("close").over(sym) * 100, 4).alias("indexed"), "dropped_days")


def shared_moves(moves: DataFrame) -> DataFrame:
    """date, n_symbols, symbols of the days on which two symbols and more have a key move."""
    out = moves.groupBy("date").agg(F.count_distinct("symbol").alias("n_symbols"), F.array_join(F.array_sort(F.collect_set("symbol")), ",").alias("symbols"))
    return out.where("n_symbols >= 2")


def regime_agreement(labels: DataFrame, symbols: list[str]) -> DataFrame:
    """common_days and the share of them on which all symbols have one regime."""
    picked = labels.where(F.col("symbol").isin(symbols)).groupBy("date").agg(F.count("*").alias("n"), F.count_distinct("regime").alias("kinds"))
    return picked.where(F.col("n") == len(symbols)).agg(F.count("*").alias("common_days"), F.bround(F.avg((F.col("kinds") == 1).cast("double")), 6).alias("agreement"))


def simulate(bars: DataFrame, entry, exit_, amount: float) -> DataFrame:
    """What an amount put into each symbol at the bar of the entry date is worth at the bar of the exit date."""
    if amount <= 0:
        raise ValueError("the amount must be greater than zero")
    last = lambda day, n: F.max_by(n, F.when(F.col("date") <= day, F.col("date")))
    both = bars.groupBy("symbol").agg(last(entry, "date").alias("entry_bar"), last(entry, "close").alias("entry_price"), last(exit_, "date").alias("exit_bar"), last(exit_, "close").alias("exit_price"))
    ok = both.where("entry_price > 0 and exit_price > 0").withColumn("_v", F.lit(float(amount)) / F.col("entry_price") * F.col("exit_price"))
    return ok.select(
        "symbol", "entry_bar", F.bround("entry_price", 8).alias("entry_price"), "exit_bar", F.bround("exit_price", 8).alias("exit_price"), F.bround(F.lit(float(amount)) / F.col("entry_price"), 6).alias("shares"),
        F.bround("_v", 4).alias("final_value"), F.bround((F.col("_v") - amount) / amount * 100, 2).alias("return_pct"),
    )
