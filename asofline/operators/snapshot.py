"""The snapshot of a symbol as of a date, and small reports of registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.temporal import day_after, instant_cutoff
from .moves import as_of

PRICES, FILINGS = 30, 10
SECTIONS = ("prices", "filings", "outcome", "news")
#: What a reader is told; a name in braces is filled in.
MESSAGES = {
    "no prices": "Historical market data is not available for {symbol} on {day}. Try a nearby date.",
    "market closed": "Markets were closed on {day}. Showing data as of the previous trading day, {last}.",
    "no filings": "SEC filing data is unavailable for this company and date.",
    "partial": "Some sections of this investigation are unavailable.",
    "no news": "No historical {source} news was found for this period. This does not mean nothing happened — our sources do not have full coverage for this company and date.",
    "no moves": "{symbol} returned no key moves for this window — price history too thin or no significant moves. Try another date.",
    "unknown": "{symbol} is not a known symbol — check the ticker. No investigation ran for this row.",
}


def message(kind: str, **names: Column) -> Column:
    """A message with its names filled in."""
    import re

    parts = re.split(r"\{(\w+)\}", MESSAGES[kind])
    return F.concat(*[names[x] if k % 2 else F.lit(x) for k, x in enumerate(parts)])


def sections(asked: str | None) -> list[str]:
    """The sections that a comma list names; all of them where it is empty; an unknown one is an error."""
    names = [x.strip().lower() for x in (asked or "").split(",") if x.strip()]
    if unknown := [n for n in names if n not in SECTIONS]:
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    return list(dict.fromkeys(names)) or list(SECTIONS)


def symbols(asked: str, most: int = 8) -> list[str]:
    """Symbols of a request: split, trimmed, in upper case, each once; one to `most`."""
    import re

    found = list(dict.fromkeys(x.upper() for x in re.split(r"[,;\s]+", asked) if x))
    if not 1 <= len(found) <= most:
        raise ValueError(f"one to {most} symbols are needed")
    return found


def case_key(text: str) -> tuple[str, str] | None:
    """Symbol and peak of a case id SYMBOL:yyyy-MM-dd; None where it isn't one."""
    import datetime as dt

    parts = text.split(":")
    try:
        return (parts[0].upper(), str(dt.date.fromisoformat(parts[1]))) if len(parts) == 2 and parts[0] else None
    except ValueError:
        return None


def assemble(companies: DataFrame, bars: DataFrame, filings: DataFrame, news: DataFrame, day: Column) -> DataFrame:
    """One nested row a company: last prices and filings, number of news, latest close, warnings; news hold what is knowable."""
    p = as_of(bars, day, PRICES).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "close", "volume")), asc=False).alias("prices"), F.max("date").alias("as_of_date"), F.max_by("close", "date").alias("as_of_close"))
    newest = W.partitionBy("symbol").orderBy(F.col("filed_at").desc(), "accession")
    f = filings.where(F.col("filed_at") < F.date_add(day, 1).cast("timestamp")).withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= FILINGS)
    f = f.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("filed_at", "accession", "form_type")), asc=False).alias("filings"))
    n = news.groupBy("symbol").agg(F.count("*").alias("n_news"))
    out = companies.join(p, "symbol", "left").join(f, "symbol", "left").join(n, "symbol", "left")
    warnings = [(F.col("prices").isNull(), "no prices"), (F.col("as_of_date") < day, "market closed"), (F.col("filings").isNull(), "no filings"), (F.col("n_news").isNull(), "no news")]
    out = out.withColumn("warnings", F.array_compact(F.array(*[F.when(t, w) for t, w in warnings])))
    return out.withColumns({"prices": F.coalesce("prices", F.array()), "filings": F.coalesce("filings", F.array()), "n_news": F.coalesce("n_news", F.lit(0))})


def outcome(companies: DataFrame, bars: DataFrame, filings: DataFrame, day: Column, days: int = 30) -> DataFrame:
    """symbol, outcome_prices, outcome_price (their last close), outcome_filings: what came in the days after a date, oldest first; nothing of it is known as of the date.

    Filings count from the day after to the New York end of the last day.  The interval bounds both lists.
    """
    p = bars.where((F.col("date") > day) & (F.col("date") <= F.date_add(day, days))).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "close", "volume"))).alias("outcome_prices"), F.max_by("close", "date").alias("outcome_price"))
    at = F.col("filed_at")
    f = filings.where((at >= day_after(day)) & (at <= instant_cutoff(F.date_add(day, days)))).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("filed_at", "accession", "form_type"))).alias("outcome_filings"))
    out = companies.select("symbol").join(p, "symbol", "left").join(f, "symbol", "left")
    return out.select("symbol", F.coalesce("outcome_prices", F.array()).alias("outcome_prices"), "outcome_price", F.coalesce("outcome_filings", F.array()).alias("outcome_filings"))


def messages(rows: DataFrame, day: Column, source: str, asked: str | None = None) -> DataFrame:
    """rows of assemble() (with a column failed: names of sections whose source failed) with warnings as they are told, of the asked sections alone."""
    wanted, on = sections(asked), lambda d: F.date_format(d, "MMMM d, yyyy")
    closed = F.when(F.col("as_of_date") < day, message("market closed", day=on(day), last=on(F.col("as_of_date"))))
    told = {
        "prices": F.when(F.size("prices") == 0, message("no prices", symbol=F.col("symbol"), day=on(day))).otherwise(closed),
        "filings": F.when(F.size("filings") == 0, message("no filings")),
        "partial": F.when(F.size(F.coalesce("failed", F.array().cast("array<string>"))) > 0, message("partial")),
        "news": F.when(F.col("n_news") == 0, message("no news", source=F.lit(source))),
    }
    return rows.withColumn("warnings", F.array_compact(F.array(*[told[k] for k in told if k == "partial" or k in wanted])))


def sector_rows(asked: DataFrame, companies: DataFrame, peaks: DataFrame) -> DataFrame:
    """symbol, name, reason, peaks: a row for each asked symbol (symbol), each by itself; peaks: symbol, peak and whatever a peak is told with.

    A symbol without peaks has an empty list and a reason: it isn't known, or its history shows no move.
    """
    rest = [c for c in peaks.columns if c not in ("symbol", "peak")]
    found = peaks.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("peak", *rest))).alias("peaks"))  # a symbol's key moves, five or ten
    rows = asked.join(companies.select("symbol", "name"), "symbol", "left").join(found, "symbol", "left")
    symbol = F.col("symbol")
    reason = F.when(F.col("peaks").isNotNull(), F.lit(None)).when(F.col("name").isNotNull(), message("no moves", symbol=symbol)).otherwise(message("unknown", symbol=symbol))
    return rows.select("symbol", "name", reason.alias("reason"), F.coalesce("peaks", F.array().cast(found.schema["peaks"].dataType)).alias("peaks"))


def search(companies: DataFrame, asked: str, most: int = 10) -> DataFrame:
    """Companies whose symbol or name has the text, whatever its case; the first by symbol."""
    has = lambda c: F.lower(c).contains(asked.strip().lower())
    return companies.where(has("symbol") | has("name")).orderBy("symbol").limit(most)


def quantiles(rows: DataFrame, value: str, parts: int = 1000) -> DataFrame:
    """n, least, p25, median, p75, most of a column; a quantile is the value at the place floor(q * n) in order.

    Exact in two steps: counts of `parts` ranges tell the range that holds a place, and only that range's values are put in order.
    """
    ends = rows.agg(F.count(value).alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / parts, F.lit(1e-300))
    ranged = rows.where(F.col(value).isNotNull()).join(F.broadcast(ends), F.lit(True)).withColumn("_r", F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(parts - 1)).cast("int"))  # one row
    counts = ranged.groupBy("_r").agg(F.count("*").alias("_c"))
    upto = counts.select("_r", F.coalesce(F.sum("_c").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), "_c")  # `parts` rows
    place = lambda q: F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
    holds = lambda q: (F.col("_before") <= place(q)) & (place(q) < F.col("_before") + F.col("_c"))
    some = ranged.join(F.broadcast(upto), "_r").where(holds(0.25) | holds(0.5) | holds(0.75))
    values = some.groupBy("_r", "_before", "_n", value).agg(F.count("*").alias("_k"))
    ordered = values.withColumn("_u", F.col("_before") + F.sum("_k").over(W.partitionBy("_r").orderBy(value)))
    inside = lambda q: (F.col("_u") > place(q)) & (F.col("_u") - F.col("_k") <= place(q))
    at = lambda q: F.bround(F.min(F.when(inside(q), F.col(value))), 4)
    picked = ordered.agg(at(0.25).alias("p25"), at(0.5).alias("median"), at(0.75).alias("p75"))
    return ends.join(F.broadcast(picked), F.lit(True)).select(F.col("_n").alias("n"), F.bround("_lo", 4).alias("least"), "p25", "median", "p75", F.bround("_hi", 4).alias("most"))


def histogram(rows: DataFrame, value: str, buckets: int = 10) -> DataFrame:
    """bucket, n: counts of a share in equal ranges from 0 to 1; 1 is in the last."""
    at = F.greatest(F.least(F.floor(F.col(value) * buckets), F.lit(buckets - 1)), F.lit(0)).cast("int")
    return rows.groupBy(at.alias("bucket")).agg(F.count("*").alias("n"))


def federated(directory: DataFrame, stored: DataFrame, asked: str, most: int = 10) -> DataFrame:
    """The first hits of a search: the directory's before the stored companies, each symbol once."""
    hits = search(directory, asked, most).withColumn("_o", F.lit(0)).unionByName(search(stored, asked, 2 * most).withColumn("_o", F.lit(1)))
    once = W.partitionBy(F.upper("symbol")).orderBy("_o")
    return hits.withColumn("_k", F.row_number().over(once)).where("_k = 1").orderBy("_o", "symbol").limit(most).drop("_k")


def by_number(companies: DataFrame, cik: str) -> DataFrame:
    """The company of a number, as it is given or filled up to ten digits."""
    digits = "".join(c for c in cik if c.isdigit())
    return companies.where(F.col("cik").isin(cik, digits.zfill(10)))


def ordered_by(rows: DataFrame, column: str, descending: bool, allowed: tuple[str, ...], tie: str) -> DataFrame:
    """rows in the order that a request names; an unknown column leaves them as they come."""
    if column not in allowed:
        return rows
    return rows.orderBy(F.col(column).desc() if descending else F.col(column).asc(), tie)
