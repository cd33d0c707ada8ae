"""Queries of bars: scans, scores, regimes, comparison and simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.temporal import column, day_after, instant_cutoff, sql_cutoff
from ..operators import compare, moves
from ..operators.joins import as_of_join, interval_join
from ..sources import tables as T
from .registry import query

DAY = "2000-03-15"
D = f"DATE '{DAY}'"
PICKS = ["Brand#11", "Brand#23", "Brand#2"]
IN = "('" + "','".join(PICKS) + "')"


def _t():
    return column(DAY)



@query(T.oracle("bars") + f"""SELECT symbol, date, round_even(close, 8) AS close, volume, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars WHERE date <= {D} QUALIFY n <= 30""")
def s1_bars_as_of(spark, sf_dir):
    return moves.as_of(T.bars(spark, sf_dir), _t(), 30).select("symbol", "date", F.bround("close", 8).alias("close"), "volume", "n")


@query(T.oracle("bars") + f"SELECT symbol, date, round_even(close, 8) AS close FROM bars WHERE date > {D} AND date <= {D} + INTERVAL 30 DAY")
def s2_bars_forward(spark, sf_dir):
    return T.bars(spark, sf_dir).where((F.col("date") > _t()) & (F.col("date") <= F.date_add(_t(), 30))).select("symbol", "date", F.bround("close", 8).alias("close"))


@query(T.oracle("bars") + "SELECT symbol, date, round_even(open, 8) AS open, round_even(high, 8) AS high, round_even(low, 8) AS low, round_even(close, 8) AS close, volume FROM bars WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-03-31'")
def s3_bars_range(spark, sf_dir):
    rows = T.bars(spark, sf_dir).where(F.col("date").between(column("1999-01-01"), column("1999-03-31")))
    return rows.select("symbol", "date", *(F.bround(c, 8).alias(c) for c in ("open", "high", "low", "close")), "volume")


@query(T.oracle("filings") + f"SELECT accession, form_type, filed_at, symbol, upper(form_type) IN ('8-K', '8-K/A') AS material FROM filings WHERE filed_at < {D} + INTERVAL 1 DAY")
def s4_filings_as_of(spark, sf_dir):
    rows = T.filings(spark, sf_dir).where(F.col("filed_at") < day_after(_t()))
    return rows.select("accession", "form_type", "filed_at", "symbol", F.upper("form_type").isin("8-K", "8-K/A").alias("material"))


@query(T.oracle("filings") + f"SELECT accession, form_type, filed_at, symbol FROM filings WHERE filed_at >= {D} + INTERVAL 1 DAY AND filed_at <= {sql_cutoff(D + ' + INTERVAL 30 DAY')}")
def s5_filings_forward(spark, sf_dir):
    """From the day after to the New York end of day 30, which admits a row dated midnight of day 31."""
    at = F.col("filed_at")
    return T.filings(spark, sf_dir).where((at >= day_after(_t())) & (at <= instant_cutoff(F.date_add(_t(), 30)))).select("accession", "form_type", "filed_at", "symbol")


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED, moves.SQL_SCORED)) + """SELECT symbol, date, rank, round_even(close, 8) AS close, round_even(ret * 100, 2) AS daily_return_pct, round_even(z, 2) AS z_score,
  round_even(vr, 2) AS volume_ratio, round_even(mom * 100, 2) AS momentum5_pct, round_even(score, 4) AS score, flags FROM moves WHERE rank <= 5""")
def moves_top(spark, sf_dir):
    """The five highest scores of every symbol."""
    return moves.top_moves(T.bars(spark, sf_dir), _t()).withColumn("flags", F.array_join("flags", ",")).withColumn("close", F.bround("close", 8))


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED, moves.SQL_SCORED)) + "SELECT symbol, date, i, round_even(ret, 6) AS ret, round_even(z, 4) AS z, round_even(vr, 4) AS volume_ratio, round_even(mom, 6) AS momentum5, round_even(rb, 6) AS range_break, round_even(score, 6) AS score FROM scored")
def w_scores(spark, sf_dir):
    """Every scored bar."""
    r = lambda c, n: F.bround(c, n).alias(c)
    return moves.scored(T.bars(spark, sf_dir), _t()).select("symbol", "date", "i", r("ret", 6), r("z", 4), r("volume_ratio", 4), r("momentum5", 6), r("range_break", 6), r("score", 6))


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED), dd="SELECT *, (close - max(close) OVER (PARTITION BY symbol ORDER BY date)) / max(close) OVER (PARTITION BY symbol ORDER BY date) * 100 AS dd FROM slice") + """
SELECT symbol, count(*) AS trading_days, round_even((arg_max(close, date) - arg_min(close, date)) / arg_min(close, date) * 100, 2) AS cumulative_return_pct,
  round_even(stddev_samp(ret) * sqrt(252) * 100, 2) AS volatility, round_even(least(min(dd), 0), 2) AS max_drawdown_pct,
  max({'r': ret, 'a': DATE '1900-01-01' - date, 'd': date}).d AS best_day, round_even(max(ret) * 100, 2) AS best_day_return_pct,
  max({'r': -ret, 'a': DATE '1900-01-01' - date, 'd': date}) FILTER (ret IS NOT NULL).d AS worst_day, round_even(min(ret) * 100, 2) AS worst_day_return_pct FROM dd GROUP BY symbol""".replace("max({'r': ret,", "max(CASE WHEN ret IS NOT NULL THEN {'r': ret,").replace("'d': date}).d AS best", "'d': date} END).d AS best").replace("max({'r': -ret,", "max(CASE WHEN ret IS NOT NULL THEN {'r': -ret,").replace("'d': date}) FILTER (ret IS NOT NULL).d", "'d': date} END).d"))
def a1_window_summary(spark, sf_dir):
    """A1-A3, W12."""
    return moves.window_summary(T.bars(spark, sf_dir), _t())


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED)) + "SELECT symbol, date, round_even((close - max(close) OVER w) / max(close) OVER w * 100, 6) AS drawdown_pct FROM slice WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def a2_drawdown(spark, sf_dir):
    return moves.drawdowns(moves.sliced(T.bars(spark, sf_dir), _t())).select("symbol", "date", F.bround("drawdown_pct", 6).alias("drawdown_pct"))


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED, moves.SQL_REGIMES)) + "SELECT symbol, date, i, volatility, regime FROM regimes")
def w10_regimes(spark, sf_dir):
    """W10, W11."""
    return moves.regimes(T.bars(spark, sf_dir), _t()).drop("close")


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED, moves.SQL_REGIMES)) + """SELECT symbol, min(date) AS run_start, max(date) AS run_end, count(*) AS days FROM (
  SELECT symbol, date, i - row_number() OVER (PARTITION BY symbol ORDER BY date) AS run FROM regimes WHERE regime = 'tense') GROUP BY symbol, run""")
def a27_tense_runs(spark, sf_dir):
    return moves.tense_runs(moves.regimes(T.bars(spark, sf_dir), _t()))


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED, moves.SQL_REGIMES)) + "SELECT symbol, coalesce(min(date) FILTER (regime = 'warming') < max(date) FILTER (regime = 'tense'), false) AS warming_to_tense FROM regimes GROUP BY symbol")
def w13_transition(spark, sf_dir):
    return moves.transitions(moves.regimes(T.bars(spark, sf_dir), _t()))


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED, moves.SQL_REGIMES)) + """SELECT symbol, regime AS from_regime, nxt AS to_regime, count(*) AS pairs, round_even(count(*) / sum(count(*)) OVER (PARTITION BY symbol), 6) AS share FROM (
  SELECT symbol, regime, lead(regime) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM regimes) WHERE nxt IS NOT NULL GROUP BY symbol, regime, nxt""")
def w14_bigrams(spark, sf_dir):
    return moves.bigrams(moves.regimes(T.bars(spark, sf_dir), _t()))


@query(T.oracle("bars", "filings") + "SELECT f.accession, f.symbol, f.filed_at::DATE AS filed_on, b.date AS bar_date, round_even(b.close, 8) AS close FROM filings f ASOF LEFT JOIN bars b ON f.symbol = b.symbol AND f.filed_at::DATE >= b.date")
def j1_as_of_join(spark, sf_dir):
    """The latest bar at or before each filing."""
    f = T.filings(spark, sf_dir).select("accession", "symbol", F.to_date("filed_at").alias("filed_on"))
    out = as_of_join(f, T.bars(spark, sf_dir).select("symbol", "date", "close"), "symbol", "filed_on", "date", ["close"])
    return out.select("accession", "symbol", "filed_on", F.col("date_as_of").alias("bar_date"), F.bround("close_as_of", 8).alias("close"))


_SIM = """SELECT symbol, max(date) FILTER (date <= DATE '1998-06-30') AS entry_bar, arg_max(close, date) FILTER (date <= DATE '1998-06-30') AS en,
  max(date) FILTER (date <= {0}) AS exit_bar, arg_max(close, date) FILTER (date <= {0}) AS ex FROM bars GROUP BY symbol"""


@query(T.oracle("bars", s=_SIM.format(D)) + """SELECT symbol, entry_bar, round_even(en, 8) AS entry_price, exit_bar, round_even(ex, 8) AS exit_price, round_even(10000 / en, 6) AS shares,
  round_even(10000 / en * ex, 4) AS final_value, round_even((10000 / en * ex - 10000) / 10000 * 100, 2) AS return_pct FROM s WHERE en > 0 AND ex > 0""")
def h26_simulation(spark, sf_dir):
    """J2, H26."""
    return compare.simulate(T.bars(spark, sf_dir), column("1998-06-30"), _t(), 10_000)


@query(T.oracle("bars", c=f"SELECT symbol, date, close, count(*) OVER (PARTITION BY date) AS n FROM bars WHERE symbol IN {IN}", d="SELECT *, count(*) FILTER (n < 3) OVER (PARTITION BY symbol) AS dropped FROM c") + "SELECT symbol, date, round_even(close / first_value(close) OVER (PARTITION BY symbol ORDER BY date) * 100, 4) AS indexed, dropped AS dropped_days FROM d WHERE n = 3")
def j20_common_days(spark, sf_dir):
    return compare.common_days(T.bars(spark, sf_dir), PICKS)


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED, moves.SQL_SCORED)) + "SELECT date, count(DISTINCT symbol) AS n_symbols, string_agg(DISTINCT symbol, ',' ORDER BY symbol) AS symbols FROM moves WHERE rank <= 5 GROUP BY date HAVING n_symbols >= 2")
def j21_shared_moves(spark, sf_dir):
    return compare.shared_moves(moves.top_moves(T.bars(spark, sf_dir), _t()))


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED, moves.SQL_REGIMES), g=f"SELECT date, count(*) AS n, count(DISTINCT regime) AS k FROM regimes WHERE symbol IN {IN} GROUP BY date") + "SELECT count(*) AS common_days, round_even(avg((k = 1)::INT), 6) AS agreement FROM g WHERE n = 3")
def j22_regime_agreement(spark, sf_dir):
    return compare.regime_agreement(moves.regimes(T.bars(spark, sf_dir), _t()), PICKS)


@query(T.oracle("bars", **moves.sql(D, moves.SQL_SLICED, moves.SQL_SCORED)) + """SELECT m.symbol, m.date, count(b.date) AS n_reactions, round_even(arg_min(b.close, b.date), 8) AS first_close, round_even(arg_max(b.close, b.date), 8) AS last_close
  FROM moves m LEFT JOIN bars b ON m.symbol = b.symbol AND b.date > m.date AND b.date <= m.date + 5 WHERE m.rank <= 5 GROUP BY m.symbol, m.date""")
def j6_reactions(spark, sf_dir):
    """Bars of the five calendar days after each move."""
    bars = T.bars(spark, sf_dir)
    m = moves.top_moves(bars, _t()).select("symbol", "date")
    after = bars.select("symbol", F.col("date").alias("_d"), F.col("close").alias("_c"))
    out = interval_join(m, after, "symbol", F.date_add("date", 1), F.col("_d"), F.date_add("date", 5), "left").groupBy("symbol", "date")
    return out.agg(F.count("_d").alias("n_reactions"), F.bround(F.min_by("_c", "_d"), 8).alias("first_close"), F.bround(F.max_by("_c", "_d"), 8).alias("last_close"))
