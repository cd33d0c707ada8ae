"""Frozen cases of key moves: nested evidence before the peak, signals, vectors and support from earlier cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import CATEGORIES
from . import ranks

BEFORE, REACTION_DAYS, EXCLUDED_DAYS = 20, 5, 30
SIGNALS = ("earnings-chatter", "regulatory-overhang", "volume-first-divergence", "leadership-turbulence", "sentiment-split", "supply-tremor")
REGIMES = ("calm", "normal", "tense", "warming")
DIRECTIONS = ("agree", "disagree", "neutral", "unknown")
STRUCTURAL = 96
CONTENT_WEIGHT = 4.0
#: Versions that are stamped on cases, characters of a frozen text, signals that ask for structural matches.
PROJECTION, METHOD, MAX_TEXT = "hcp-v1", "reg-v1", 500
STRUCTURAL_SIGNALS = ("regulatory-overhang", "leadership-turbulence", "volume-first-divergence")
#: Event types of filings, in the order of their dimensions.
EVENTS = ("management_change", "acquisition", "earnings_warning", "regulatory", "other")


def freeze(peaks: DataFrame, threads: DataFrame, regimes: DataFrame, evidence: DataFrame, bars: DataFrame) -> DataFrame:
    """One nested row a peak: threads whose span meets the window before it, its regime path, evidence counts and reaction.

    A thread without a span can't be placed: it rides along, undated.  Items of evidence are rows of their own (evidence_items).
    peaks: symbol, date, daily_return_pct, score, flags, sentiment_direction, sentiment_mean; threads: symbol, thread, category,
    n_articles, span_start, span_end; evidence: symbol, date, news_count, n_8k, n_10, n_filings, events, relevance, filing_sentiment.
    """
    key = ["symbol", "date"]
    k = peaks.select(*key)
    of = lambda rows: k.join(rows.withColumnRenamed("symbol", "_s"), F.col("symbol") == F.col("_s"))
    undated = F.col("span_start").isNull() | F.col("span_end").isNull()
    span = of(threads).where(undated | ((F.to_date("span_end") >= F.date_sub("date", BEFORE)) & (F.to_date("span_start") <= F.col("date"))))
    t = span.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("thread", F.coalesce("category", F.lit("")).alias("category"), "n_articles", (~undated).alias("dated")))).alias("threads"))
    path = of(regimes.select("symbol", F.col("date").alias("_d"), "regime")).where(F.col("_d").between(F.date_sub("date", BEFORE), F.col("date")))
    r = path.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("_d").alias("day"), "regime"))).alias("regime_path"))
    after = of(bars.select("symbol", F.col("date").alias("_d"), "close")).where((F.col("_d") > F.col("date")) & (F.col("_d") <= F.date_add("date", REACTION_DAYS)))
    x = after.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("_d").alias("day"), "close"))).alias("reaction"))
    out = peaks.join(t, key, "left").join(r, key, "left").join(evidence, key, "left").join(x, key, "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(
        F.concat_ws(":", "symbol", F.date_format("date", "yyyy-MM-dd")).alias("case_id"), "symbol", F.col("date").alias("peak"), "daily_return_pct", "score", "flags", "sentiment_direction", "sentiment_mean",
        empty("threads", "array<struct<thread:string,category:string,n_articles:bigint,dated:boolean>>"), empty("regime_path", "array<struct<day:date,regime:string>>"), empty("reaction", "array<struct<day:date,close:double>>"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("news_count", "n_8k", "n_10", "n_filings")), empty("events", "array<string>"), "relevance", "filing_sentiment", F.lit(PROJECTION).alias("projection"),
    )


def clip(text: Column, most: int = MAX_TEXT) -> Column:
    """Text of a frozen item: nothing for blank texts, else its first characters (the stored field's limit)."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "").otherwise(F.substring(text, 1, most))


def evidence_items(peaks: DataFrame, news: DataFrame, filings: DataFrame, social: DataFrame, social_days: int = 7, lookback: int = 30) -> DataFrame:
    """case_id, kind, ref, at, text: each item of evidence that a case is frozen with; one row an item, so a case of many is no row of its own."""
    p = peaks.select("symbol", "date", F.concat_ws(":", "symbol", F.date_format("date", "yyyy-MM-dd")).alias("case_id"))
    day = F.to_date("at")
    rows = lambda df, kind, ref, at, text: df.select(F.col("symbol").alias("_s"), F.lit(kind).alias("kind"), F.col(ref).alias("ref"), F.col(at).alias("at"), text.alias("text"))
    upto = lambda r, low: p.join(r, (F.col("symbol") == F.col("_s")) & low & (day <= F.col("date"))).select("case_id", "kind", "ref", "at", "text")
    n = upto(rows(news, "news", "id", "published_at", clip(F.col("description"))), F.lit(True))
    f = upto(rows(filings, "filing", "accession", "filed_at", F.col("form_type")), day >= F.date_sub("date", lookback))
    s = upto(rows(social, "social", "id", "created_at", F.col("community")), day >= F.date_sub("date", social_days))
    return n.unionByName(f).unionByName(s)


def completeness(case: DataFrame) -> DataFrame:
    """case with completeness, a map by area, and overall: full, partial or missing; threads are partial with an undated one, evidence without any item."""
    some = lambda test: F.when(test, "full").otherwise("missing")
    areas = {
        "threads": F.when(F.size("threads") == 0, "missing").when(F.exists("threads", lambda t: ~t["dated"]), "partial").otherwise("full"), "regimes": some(F.size("regime_path") > 0),
        "evidence": F.when((F.col("news_count") > 0) | (F.col("n_filings") > 0), "full").otherwise("partial"), "sentiment": some(F.col("sentiment_direction") != "unknown"),
        "reaction": F.when(F.size("reaction") >= 3, "full").when(F.size("reaction") > 0, "partial").otherwise("missing"),
    }
    out = case.withColumn("completeness", F.map_from_arrays(F.array(*map(F.lit, areas)), F.array(*areas.values())))
    v = F.map_values("completeness")
    return out.withColumn("overall", F.when(F.forall(v, lambda a: a == "full"), "full").when(F.forall(v, lambda a: a == "missing"), "missing").otherwise("partial"))


def matches_frozen(frozen: DataFrame, live: DataFrame) -> DataFrame:
    """case_id, matches: whether a recomputed case is the frozen one: both of the current projection, with as many threads; false where one is missing."""
    f, v = (d.select("case_id", F.col("projection").alias(f"_p{k}"), F.size("threads").alias(f"_n{k}")) for k, d in enumerate((frozen, live)))
    same = (F.col("_p0") == PROJECTION) & (F.col("_p1") == PROJECTION) & (F.col("_n0") == F.col("_n1"))
    return f.join(v, "case_id", "full_outer").select("case_id", F.coalesce(same, F.lit(False)).alias("matches"))


def regulatory_clean(items: DataFrame, methodology: Column, tiers: Column) -> DataFrame:
    """case_id, clean: made by the current method, with all three tiers, and without a filing outside the window (items: case_id, filed_at, peak, methodology, tiers)."""
    days = F.datediff("peak", F.to_date("filed_at"))
    inside = F.col("filed_at").isNull() | days.between(0, 30)
    return items.groupBy("case_id").agg((F.min(methodology == METHOD) & (F.min(F.size(tiers)) == 3) & F.min(inside)).alias("clean"))


def to_registry(case: DataFrame) -> DataFrame:
    """case_id, symbol, peak, body: cases as JSON rows."""
    return case.select("case_id", "symbol", "peak", F.to_json(F.struct(*[c for c in case.columns if c not in ("case_id", "symbol", "peak")])).alias("body"))


def from_registry(rows: DataFrame, schema: str) -> DataFrame:
    """Cases of JSON rows; a blank or broken one is no case, and no error."""
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = rows.where(F.trim(F.coalesce("body", F.lit(""))) != "").withColumn("_c", parsed)
    return out.where("_c is not null and _c._broken is null").select("case_id", "symbol", "peak", "_c.*").drop("_broken")


def in_category(*names: str, voting: bool = False) -> Column:
    return F.size(F.filter("threads", lambda t: t["category"].isin(*names) & ((t["n_articles"] > 1) if voting else F.lit(True))))


def tense_days() -> Column:
    return F.size(F.filter("regime_path", lambda r: r["regime"] == "tense"))


def warming_to_tense() -> Column:
    """A tense day after the first warming one, in the order of days."""
    first = F.array_min(F.transform(F.filter("regime_path", lambda r: r["regime"] == "warming"), lambda r: r["day"]))
    last = F.array_max(F.transform(F.filter("regime_path", lambda r: r["regime"] == "tense"), lambda r: r["day"]))
    return F.coalesce(first < last, F.lit(False))


def signals(case: DataFrame) -> DataFrame:
    """case with fired, the names of its signals in their order."""
    flag = lambda n: F.array_contains("flags", n)
    second = (tense_days() > 0) | (F.col("sentiment_direction") == "disagree") | flag("high-volume")
    tests = [
        in_category("FINANCIAL") >= 2,
        (in_category("LEGAL", "REGULATORY", voting=True) >= 1) & (tense_days() >= 3),
        ((F.col("news_count") > 0) | (F.col("n_filings") > 0)) & flag("high-volume") & (flag("spike") | flag("plunge")) & (F.col("news_count") <= 2),
        (in_category("MANAGEMENT") >= 2) | ((in_category("MANAGEMENT") == 1) & second),
        F.col("sentiment_direction") == "disagree",
        ((in_category("SUPPLY_CHAIN") >= 2) | ((in_category("SUPPLY_CHAIN") == 1) & second)) & warming_to_tense(),
    ]
    return case.withColumn("fired", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in zip(SIGNALS, tests)])))


def triggers(signal: Column, category: Column, n_articles: Column, otherwise: Column, categories: dict[str, tuple[str, ...]]) -> Column:
    """Whether a thread triggers a signal (by its category; the regulatory one by threads of several articles alone); `otherwise` for signals that no thread triggers."""
    test = F
    for name, of in categories.items():
        votes = category.isin(*of) & ((n_articles > 1) if name == "regulatory-overhang" else F.lit(True))
        test = test.when(signal == name, votes)
    return test.otherwise(otherwise)


def trigger_evidence(case: DataFrame, categories: dict[str, tuple[str, ...]]) -> DataFrame:
    """case_id, signal, text, size: what each fired signal is told with; size is that of a thread."""
    fired = case.select("*", F.explode("fired").alias("signal"))
    tense = F.array_sort(F.transform(F.filter("regime_path", lambda r: r["regime"] == "tense"), lambda r: F.date_format(r["day"], "yyyy-MM-dd")))
    item = lambda text, size: F.struct(text.alias("text"), size.cast("long").alias("size"))  # noqa: E731  what isn't a thread has size 0
    of_threads = F.transform(
        F.filter("threads", lambda t: triggers(F.col("signal"), t["category"], t["n_articles"], F.lit(False), categories)),
        lambda t: item(F.concat(t["category"], F.lit(" thread: "), t["thread"]), t["n_articles"]),
    )
    told = lambda *texts: F.array(*[item(x, F.lit(0)) for x in texts])
    days = F.concat(F.lit("tense regime on "), F.size(tense).cast("string"), F.lit(" pre-peak days ("), F.try_element_at(tense, F.lit(1)), F.lit("→"), F.try_element_at(tense, F.lit(-1)), F.lit(")"))
    numbers = (
        F.when(F.col("signal") == "regulatory-overhang", told(days))
        .when(F.col("signal") == "volume-first-divergence", told(F.concat(F.lit("peak flags: "), F.array_join("flags", ", ")), F.concat(F.lit("only "), F.col("news_count").cast("string"), F.lit(" pre-peak news item(s) in move evidence"))))
        .when(F.col("signal") == "sentiment-split", told(F.lit("scored pre-peak news leans against the price move (contrarian divergence)")))
        .when(F.col("signal") == "supply-tremor", told(F.lit("regime path shifts warming→tense inside the pre-peak window"))).otherwise(F.array().cast("array<struct<text:string,size:bigint>>"))
    )
    return fired.select("case_id", "signal", F.explode(F.concat(of_threads, numbers)).alias("_e")).select("case_id", "signal", "_e.text", "_e.size")


#: Fixed value: what a case says whose frozen row differs.
RECOMPUTED = "Recomputed now — may differ from frozen registry record."


def recomputed_notes(rows: DataFrame, frozen: DataFrame, live: DataFrame) -> DataFrame:
    """case_id, note of each live case: RECOMPUTED where its registry row (rows: case_id) differs from it or can't be read (frozen: what could be), nothing where there is no row."""
    same = matches_frozen(frozen, live)
    there = rows.select("case_id").distinct().withColumn("_there", F.lit(True))
    out = live.select("case_id").join(there, "case_id", "left").join(same, "case_id", "left")
    return out.select("case_id", F.when(F.col("_there") & ~F.coalesce("matches", F.lit(False)), RECOMPUTED).otherwise("").alias("note"))


def structural(case: DataFrame) -> DataFrame:
    """case with vector: 96 dimensions of unit length (all zero where nothing is measured); the places are fixed values.

    Groups of dimensions are arrays made by one function over their names, so the expression stays small.
    """
    n_path, n_threads = F.size("regime_path"), F.size("threads")
    clamp = lambda c, low: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(low)), F.lit(1.0))  # noqa: E731  what isn't known is 0
    each = lambda names, f: F.transform(F.array(*[F.lit(n) for n in names]), f)
    share = lambda part, whole: F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))
    fires = lambda n: F.array_contains("fired", n)
    days = lambda label: F.size(F.filter("regime_path", lambda r: r["regime"] == label))
    labels = F.transform("regime_path", lambda r: r["regime"])
    pairs = F.when(n_path > 1, F.zip_with(F.slice(labels, 1, F.greatest(n_path - 1, F.lit(1))), F.slice(labels, 2, F.greatest(n_path - 1, F.lit(1))), lambda x, y: F.concat_ws(">", x, y))).otherwise(F.array().cast("array<string>"))
    counts = each(CATEGORIES, lambda c: F.size(F.filter("threads", lambda t: t["category"] == c)))
    raw = case.withColumns({"_pairs": pairs, "_counts": counts})
    both = F.array(*[F.array(F.lit(x), F.lit(y)) for i, x in enumerate(SIGNALS) for y in SIGNALS[i + 1 :]])
    ret = F.col("daily_return_pct")
    groups = [
        each(SIGNALS, lambda n: F.when(fires(n), 3.0).otherwise(0.0)),
        each(REGIMES, lambda label: share(days(label), n_path)),
        F.array(F.when(warming_to_tense(), 2.0).otherwise(0.0), share(tense_days(), n_path) * 2),
        each(DIRECTIONS, lambda d: F.when(F.col("sentiment_direction") == d, 2.0).otherwise(0.0)),
        F.flatten(F.transform("_counts", lambda n: F.array(share(n, n_threads), F.least(n / 10, F.lit(1.0))))),
        F.transform(both, lambda p: F.when(fires(p[0]) & fires(p[1]), 2.0).otherwise(0.0)),
        F.array(*[F.least(c / 3, F.lit(1.0)) * 0.5 for c in (F.col("n_8k"), F.col("n_10"), F.greatest(F.col("n_filings") - F.col("n_8k") - F.col("n_10"), F.lit(0)))]),
        F.array(*[F.least(F.greatest(r, F.lit(0.0)), F.lit(10.0)) / 10 * 0.5 for r in (ret, -ret)], clamp("score", 0.0), F.least(F.col("news_count") / 5, F.lit(1.0)), clamp("sentiment_mean", -1.0) * 2),
        each([f"{x}>{y}" for x in REGIMES for y in REGIMES], lambda p: F.size(F.filter("_pairs", lambda q: q == p)) / F.greatest(n_path - 1, F.lit(1))),
        each(EVENTS, lambda e: F.when(F.array_contains("events", e), 2.0).otherwise(0.0)),  # filings without a structured summary add nothing
        F.array(clamp("relevance", 0.0) * 2, clamp("filing_sentiment", -1.0) * 2),
    ]
    whole = F.concat(*[g.cast("array<double>") for g in groups])
    return raw.withColumn("vector", unit(whole)).drop("_pairs", "_counts")


def unit(v: Column) -> Column:
    """An array of unit length; all zero where it has none.  The array is bound once, whatever its expression."""
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    scaled = F.transform(F.array(v), lambda a: F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0])
    return scaled[0]


def hybrid(case: DataFrame, content: DataFrame) -> DataFrame:
    """case_id, vector: structural dimensions (as from structural()) and the unit mean of the case's articles times CONTENT_WEIGHT, of unit length.

    content: case_id, mean (array of unit length); a case without one has no content dimensions.
    """
    both = case.join(content, "case_id", "left")
    raw = F.when(F.col("mean").isNull(), F.col("vector")).otherwise(F.concat("vector", F.transform("mean", lambda x: x * CONTENT_WEIGHT)))
    return both.select("case_id", "symbol", "peak", unit(raw).alias("vector"))


def supporters(case: DataFrame) -> DataFrame:
    """case_id, signal, n_supporters: other cases with the signal that peaked no later; running sums of counts by day, so a signal's cases are no group."""
    fired = case.select("case_id", "peak", F.explode("fired").alias("signal"))
    days = fired.groupBy("signal", "peak").agg(F.count("*").alias("_c"))
    upto = W.partitionBy("signal").orderBy("peak")
    running = days.select("signal", "peak", F.sum("_c").over(upto).alias("_upto"))
    return fired.join(running, ["signal", "peak"]).select("case_id", "signal", (F.col("_upto") - 1).alias("n_supporters"))


def aftermath(case: DataFrame) -> DataFrame:
    """case_id, signal, n, median, high, low of the moves, from the first to the last reaction close, of the case's supporters: other cases with the signal that peaked no later.

    The order statistics of all cases up to a day are taken once for each signal and day; a case that is itself among
    them is left out by place: what isn't below its own move is one place further.  No case meets another.
    """
    first, last = F.col("reaction")[0]["close"], F.element_at("reaction", -1)["close"]
    move = F.when((F.size("reaction") >= 2) & (first != 0), (last - first) / first * 100)
    fired = case.select("case_id", "peak", move.alias("_m"), F.explode("fired").alias("signal"))
    upto = W.partitionBy("signal").orderBy("peak")
    days = fired.groupBy("signal", "peak").agg(F.count("_m").alias("_c")).withColumn("_n", F.sum("_c").over(upto))
    n = F.col("_n")
    places = F.array(F.lit(0), F.lit(1), n - 2, n - 1, *[F.floor((n - 2) / 2) + k for k in range(3)])
    asked = days.select(F.col("signal").alias("key"), F.col("peak").alias("at"), F.explode(F.array_distinct(places)).alias("k"), "_n").where("k >= 0 and k < _n")
    found = ranks.order_statistics(fired.select(F.col("signal").alias("key"), F.col("peak").alias("at"), F.col("_m").alias("value")), asked)
    known = found.groupBy(F.col("key").alias("signal"), F.col("at").alias("peak")).agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("_v"))  # seven places at most
    rows = fired.join(days.select("signal", "peak", "_n"), ["signal", "peak"]).join(known, ["signal", "peak"], "left")
    rows = rows.withColumn("n", F.col("_n") - F.col("_m").isNotNull().cast("long"))
    at = lambda k: F.try_element_at("_v", k.cast("long"))
    pick = lambda k: F.when(F.col("_m").isNotNull() & (at(k) >= F.col("_m")), at(k + 1)).otherwise(at(k))
    half = F.floor(F.col("n") / 2)
    median = F.when(F.col("n") % 2 == 1, pick(half)).otherwise((pick(half - 1) + pick(half)) / 2)
    some = lambda c: F.when(F.col("n") > 0, F.bround(c, 2))
    return rows.select("case_id", "signal", "n", some(median).alias("median"), some(pick(F.col("n") - 1)).alias("high"), some(pick(F.lit(0))).alias("low"))


def display(similarity: Column) -> Column:
    """A similarity as it is shown: three digits, and below one."""
    return F.least(F.bround(similarity, 3), F.lit(0.999))


def similar_cases(vectors: DataFrame, pairs: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """q, case_id, similarity: pairs (q, id, similarity) of cases, without those of one symbol whose peaks are EXCLUDED_DAYS apart at most.

    vectors: case_id, symbol, peak of the cases; asked: the same of q, where it isn't a case's id itself.
    """
    mine = vectors.withColumn("q", F.col("case_id")) if asked is None else asked
    at = lambda rows, name, c: rows.select(F.col(name), F.col("symbol").alias(f"_s{c}"), F.col("peak").alias(f"_p{c}"))
    both = pairs.withColumnRenamed("id", "case_id").join(at(mine, "q", 0), "q").join(at(vectors, "case_id", 1), "case_id")
    return both.where(~((F.col("_s0") == F.col("_s1")) & (F.abs(F.datediff("_p0", "_p1")) <= EXCLUDED_DAYS))).select("q", "case_id", "similarity")


def best_pairs(asked: DataFrame, articles: DataFrame, links: DataFrame) -> DataFrame:
    """q, case_id, similarity: the best similarity of two different articles of what is asked and of another case.

    asked: q, own (the case that asks), id and articles: case_id, id (articles of the cases); links: q, id, similarity of different articles.
    """
    a = asked.select(F.col("q").alias("_q"), "own", F.col("id").alias("q"))
    both = links.join(a, "q").join(articles.select("case_id", "id"), "id").where(F.col("case_id") != F.col("own"))
    return both.groupBy(F.col("_q").alias("q"), "case_id").agg(F.max("similarity").alias("similarity"))


def stamped(hits: DataFrame, registry: DataFrame) -> DataFrame:
    """hits with news_source of their case's registry row (case_id, news_source), empty where there is none."""
    source = registry.groupBy("case_id").agg(F.max("news_source").alias("_src"))
    return hits.join(source, "case_id", "left").withColumn("news_source", F.coalesce("_src", F.lit(""))).drop("_src")


def merged(structural_hits: DataFrame, hybrid_hits: DataFrame, narrative_hits: DataFrame, peaks: DataFrame, asked: DataFrame | None = None, lead: int = 3, most: int = 5) -> DataFrame:
    """q, case_id, kind, similarity, rank: strong hits (in both lists), up to `lead` structural ones, then hybrid and narrative ones; `most` are taken, then later peaks are dropped.

    The hits have q, case_id, similarity; peaks: case_id, peak; asked: q, peak, where q isn't a case's id itself.
    """
    s, h, n = (d.select("q", "case_id", F.col("similarity").alias(f"_{k}")) for k, d in zip("shn", (structural_hits, hybrid_hits, narrative_hits)))
    both = s.join(h, ["q", "case_id"], "full_outer").join(n, ["q", "case_id"], "full_outer")
    kind = F.when(F.col("_s").isNotNull() & F.col("_h").isNotNull(), "strong").when(F.col("_s").isNotNull(), "pattern").otherwise("narrative")
    rows = both.withColumn("kind", kind).withColumn("similarity", F.when(F.col("kind") == "strong", display(F.greatest("_s", "_h"))).otherwise(display(F.coalesce("_s", "_h", "_n"))))
    rows = rows.withColumn("_g", F.when(F.col("kind") == "strong", 0).when(F.col("kind") == "pattern", 1).otherwise(2))
    group = W.partitionBy("q", "_g").orderBy(F.col("similarity").desc(), "case_id")
    rows = rows.withColumn("_k", F.row_number().over(group)).where((F.col("_g") != 1) | (F.col("_k") <= lead))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy("_g", "_k"))).where(F.col("rank") <= most)
    own = (peaks.withColumn("q", F.col("case_id")) if asked is None else asked).select("q", F.col("peak").alias("_qp"))
    return rows.join(own, "q").join(peaks, "case_id").where("peak <= _qp").select("q", "case_id", "kind", "similarity", "rank")
