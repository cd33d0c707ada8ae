"""Rolling-window scores of daily bars, window summaries and volatility regimes.

All windows run inside a symbol's last FETCH bars as of the date, cut out before any lag is taken, so that
no older bar leaks in and warm-up positions count from the cut.  Every window of an operator has one
specification, so a plan has one exchange and one sort by symbol and date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FETCH, SLICE, ROLLING, LEAST_BARS, WARM = 130, 100, 20, 30, 10
STD_FLOOR = 0.0005
YEAR = 252


def _by():
    return W.partitionBy("symbol").orderBy("date")



def as_of(bars: DataFrame, day: Column, rows: int) -> DataFrame:
    """The last `rows` bars of every symbol up to a day, newest first by n = 1, 2, ..."""
    newest = W.partitionBy("symbol").orderBy(F.col("date").desc())
    return bars.where(F.col("date") <= day).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= rows)


def fetched(bars: DataFrame, day: Column) -> DataFrame:
    """The bars of a window: i counts from 0 at the oldest of FETCH bars, n is the symbol's number of bars."""
    cut = as_of(bars, day, FETCH).drop("n")
    everything = W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return cut.withColumn("i", F.row_number().over(_by()) - 1).withColumn("n", F.count("*").over(everything)).where(F.col("n") >= LEAST_BARS)


def daily_return() -> Column:
    before = F.lag("close").over(_by())
    return F.when(before.isNull(), None).when(before == 0, 0.0).otherwise((F.col("close") - before) / before)


def scored(bars: DataFrame, day: Column) -> DataFrame:
    """Score, its parts and flags of every bar of the slice that has a full baseline; bars of score 0 have no row."""
    w = _by().rowsBetween(-ROLLING, -1)
    rows = fetched(bars, day).withColumn("ret", daily_return())
    rows = rows.withColumns({
        "_mean": F.avg("ret").over(w), "_std": F.greatest(F.coalesce(F.stddev_samp("ret").over(w), F.lit(0.0)), F.lit(STD_FLOOR)),
        "_median": F.percentile("volume", 0.5).over(w), "_hi": F.max("high").over(w), "_lo": F.min("low").over(w), "_base": F.lag("close", 5).over(_by()),
    })
    rows = rows.where((F.col("i") >= F.greatest(F.lit(ROLLING + 1), F.col("n") - SLICE)))
    c = F.col("close")
    rows = rows.withColumns({
        "z": (F.col("ret") - F.col("_mean")) / F.col("_std"), "volume_ratio": F.when(F.col("_median") <= 0, 1.0).otherwise(F.col("volume") / F.col("_median")),
        "momentum5": F.when(F.col("_base") == 0, 0.0).otherwise((c - F.col("_base")) / F.col("_base")),
        "range_break": F.when((c > F.col("_hi")) & (F.col("_hi") > 0), (c - F.col("_hi")) / F.col("_hi")).when((c < F.col("_lo")) & (F.col("_lo") > 0), (F.col("_lo") - c) / F.col("_lo")).otherwise(0.0),
    })
    score = 0.5 * F.least(F.abs("z") / 3, F.lit(1.0)) + 0.3 * F.least(F.greatest(F.col("volume_ratio") - 1, F.lit(0.0)) / 4, F.lit(1.0)) + 0.2 * F.least(F.col("range_break") * 20, F.lit(1.0))
    flags = [(F.col("z") > 2, "spike"), (F.col("z") < -2, "plunge"), (F.col("volume_ratio") > 2.5, "high-volume"), (c > F.col("_hi"), "breakout"), (c < F.col("_lo"), "breakdown")]
    rows = rows.withColumn("score", score).where("score > 0").withColumn("flags", F.array_compact(F.array(*[F.when(test, name) for test, name in flags])))
    return rows.drop("_mean", "_std", "_median", "_hi", "_lo", "_base")


def top_moves(bars: DataFrame, day: Column, take: int = 5) -> DataFrame:
    """The highest scores of every symbol: rank, and the figures as they are shown."""
    order = W.partitionBy("symbol").orderBy(F.col("score").desc(), F.col("date").desc(), F.abs("ret").desc())
    rows = scored(bars, day).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= take)
    return rows.select(
        "symbol", "date", "rank", "close", F.bround(F.col("ret") * 100, 2).alias("daily_return_pct"), F.bround("z", 2).alias("z_score"), F.bround("volume_ratio", 2).alias("volume_ratio"),
        F.bround(F.col("momentum5") * 100, 2).alias("momentum5_pct"), F.bround("score", 4).alias("score"), "flags",
    )


def sliced(bars: DataFrame, day: Column) -> DataFrame:
    """The last SLICE bars of the fetched ones; i counts from 0 again, ret is null at its first bar."""
    rows = fetched(bars, day).where(F.col("i") >= F.col("n") - SLICE).drop("n")
    return rows.withColumn("i", F.row_number().over(_by()) - 1).withColumn("ret", daily_return())


def drawdowns(rows: DataFrame) -> DataFrame:
    """rows (symbol, date, close) with drawdown_pct below the highest close so far."""
    peak = F.max("close").over(_by().rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("drawdown_pct", F.when(peak == 0, 0.0).otherwise((F.col("close") - peak) / peak * 100))


def window_summary(bars: DataFrame, day: Column) -> DataFrame:
    """One row a symbol: days, return, volatility, drawdown, best and worst day (of equal ones the first)."""
    rows = drawdowns(sliced(bars, day))
    age = F.datediff(F.lit("1900-01-01"), "date")
    best, worst = F.struct("ret", age.alias("a")), F.struct((-F.col("ret")).alias("r"), age.alias("a"))
    some = F.col("ret").isNotNull()
    out = rows.groupBy("symbol").agg(
        F.count("*").alias("trading_days"), F.min_by("close", "date").alias("_f"), F.max_by("close", "date").alias("_l"), F.stddev_samp("ret").alias("_s"), F.min("drawdown_pct").alias("_d"),
        F.max_by("date", F.when(some, best)).alias("best_day"), F.max("ret").alias("_b"), F.max_by("date", F.when(some, worst)).alias("worst_day"), F.min("ret").alias("_w"),
    )
    pct = lambda c: F.bround(F.coalesce(c, F.lit(0.0)), 2)
    return out.select(
        "symbol", "trading_days", pct(F.when(F.col("_f") != 0, (F.col("_l") - F.col("_f")) / F.col("_f") * 100)).alias("cumulative_return_pct"),
        pct(F.col("_s") * F.sqrt(F.lit(YEAR)) * 100).alias("volatility"), pct(F.least("_d", F.lit(0.0))).alias("max_drawdown_pct"),
        "best_day", pct(F.col("_b") * 100).alias("best_day_return_pct"), "worst_day", pct(F.col("_w") * 100).alias("worst_day_return_pct"),
    )


def regimes(bars: DataFrame, day: Column) -> DataFrame:
    """symbol, date, i, volatility, regime: thirds of the window's own volatilities; its first days are warming."""
    rows = sliced(bars, day)
    rows = rows.withColumn("volatility", F.when(F.col("i") >= WARM, F.coalesce(F.stddev_samp("ret").over(_by().rowsBetween(-ROLLING + 1, 0)), F.lit(0.0)) * F.sqrt(F.lit(YEAR)) * 100))
    measured = W.partitionBy("symbol")
    rows = rows.withColumn("_n", F.count("volatility").over(measured)).withColumn("_r", F.row_number().over(measured.orderBy(F.col("volatility").asc_nulls_last())) - 1)
    cut = lambda k: F.max(F.when(F.col("_r") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * k / 3)), F.col("volatility"))).over(measured)
    rows = rows.withColumn("_c1", cut(1)).withColumn("_c2", cut(2))
    label = F.when(F.col("volatility").isNull(), "warming").when(F.col("volatility") <= F.col("_c1"), "calm").when(F.col("volatility") <= F.col("_c2"), "normal").otherwise("tense")
    return rows.select("symbol", "date", "i", "close", F.bround("volatility", 6).alias("volatility"), label.alias("regime"))


def tense_runs(labels: DataFrame) -> DataFrame:
    """symbol, run_start, run_end, days of every run of tense days (labels: symbol, date, i, regime)."""
    tense = labels.where("regime = 'tense'").withColumn("_run", F.col("i") - F.row_number().over(_by()))
    return tense.groupBy("symbol", "_run").agg(F.min("date").alias("run_start"), F.max("date").alias("run_end"), F.count("*").alias("days")).drop("_run")


def bigrams(labels: DataFrame) -> DataFrame:
    """symbol, from_regime, to_regime, pairs, share of all pairs of neighbouring days."""
    pairs = labels.withColumn("to_regime", F.lead("regime").over(_by())).where("to_regime is not null")
    n = F.sum("pairs").over(W.partitionBy("symbol"))
    out = pairs.groupBy("symbol", F.col("regime").alias("from_regime"), "to_regime").agg(F.count("*").alias("pairs"))
    return out.withColumn("share", F.bround(F.col("pairs") / n, 6))


def transitions(labels: DataFrame) -> DataFrame:
    """symbol, warming_to_tense: whether a tense day follows the first warming one."""
    d = lambda label, f: f(F.when(F.col("regime") == label, F.col("date")))
    return labels.groupBy("symbol").agg(F.coalesce(d("warming", F.min) < d("tense", F.max), F.lit(False)).alias("warming_to_tense"))


#: The same operators as SQL over the view bars; {day} is a date literal.
SQL_SLICED = {
    "newest": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars WHERE date <= {day}",
    "fetched": f"""SELECT symbol, date, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n
  FROM newest WHERE back <= {FETCH} QUALIFY n >= {LEAST_BARS}""",
    "rets": "SELECT *, CASE WHEN lag(close) OVER w = 0 THEN 0 ELSE (close - lag(close) OVER w) / lag(close) OVER w END AS ret FROM fetched WINDOW w AS (PARTITION BY symbol ORDER BY date)",
    "slice0": f"SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM fetched WHERE i >= n - {SLICE}",
    "slice": "SELECT *, CASE WHEN lag(close) OVER w = 0 THEN 0 ELSE (close - lag(close) OVER w) / lag(close) OVER w END AS ret FROM slice0 WINDOW w AS (PARTITION BY symbol ORDER BY date)",
}
SQL_SCORED = {
    "roll": f"""SELECT *, avg(ret) OVER w AS mean, greatest(coalesce(stddev_samp(ret) OVER w, 0), {STD_FLOOR}) AS std, quantile_cont(volume, 0.5) OVER w AS med,
  max(high) OVER w AS hi, min(low) OVER w AS lo, lag(close, 5) OVER (PARTITION BY symbol ORDER BY date) AS base
  FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {ROLLING} PRECEDING AND 1 PRECEDING)""",
    "parts": f"""SELECT *, (ret - mean) / std AS z, CASE WHEN med <= 0 THEN 1 ELSE volume / med END AS vr, CASE WHEN base = 0 THEN 0 ELSE (close - base) / base END AS mom,
  CASE WHEN close > hi AND hi > 0 THEN (close - hi) / hi WHEN close < lo AND lo > 0 THEN (lo - close) / lo ELSE 0 END AS rb FROM roll WHERE i >= greatest({ROLLING + 1}, n - {SLICE})""",
    "scored": "SELECT * FROM (SELECT *, 0.5 * least(abs(z) / 3, 1) + 0.3 * least(greatest(vr - 1, 0) / 4, 1) + 0.2 * least(rb * 20, 1) AS score FROM parts) WHERE score > 0",
    "moves": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY score DESC, date DESC, abs(ret) DESC) AS rank,
  array_to_string(list_filter([CASE WHEN z > 2 THEN 'spike' END, CASE WHEN z < -2 THEN 'plunge' END, CASE WHEN vr > 2.5 THEN 'high-volume' END,
    CASE WHEN close > hi THEN 'breakout' END, CASE WHEN close < lo THEN 'breakdown' END], lambda x: x IS NOT NULL), ',') AS flags FROM scored""",
}
SQL_REGIMES = {
    "vols": f"""SELECT *, CASE WHEN i >= {WARM} THEN coalesce(stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {ROLLING - 1} PRECEDING AND CURRENT ROW), 0) * sqrt({YEAR}) * 100 END AS vol FROM slice""",
    "ranked": "SELECT *, count(vol) OVER (PARTITION BY symbol) AS m, row_number() OVER (PARTITION BY symbol ORDER BY vol NULLS LAST) - 1 AS r FROM vols",
    "cuts": "SELECT *, max(CASE WHEN r = least(m - 1, floor(m * 1 / 3)) THEN vol END) OVER (PARTITION BY symbol) AS c1, max(CASE WHEN r = least(m - 1, floor(m * 2 / 3)) THEN vol END) OVER (PARTITION BY symbol) AS c2 FROM ranked",
    "regimes": "SELECT symbol, date, i, close, round_even(vol, 6) AS volatility, CASE WHEN vol IS NULL THEN 'warming' WHEN vol <= c1 THEN 'calm' WHEN vol <= c2 THEN 'normal' ELSE 'tense' END AS regime FROM cuts",
}


def sql(day: str, *parts: dict[str, str]) -> dict[str, str]:
    return {n: q.replace("{day}", day) for part in parts for n, q in part.items()}
