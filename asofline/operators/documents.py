"""Operators on long texts: sections, sentences, picks and batches; and joins of threads across symbols."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import EDGE, cosine, tokens
from ..sources.tables import wording

#: Fixed value: a line that begins a section.
HEADING = r"(?imd)^[^\S\n]{0,8}ITEM\s+(\d+[A-Z]?)\.?\s*([^\n]{0,120})"
#: Fixed value: the blanks between two sentences.
SENTENCE = r'(?<=[.!?])\s+(?=[A-Z0-9"“(\[])'


#: Fixed value: characters of a page.
PAGE = 3000


def _section_list(text: Column) -> Column:
    """Array of (heading, body) of a text: what lies from each heading to the next, trimmed; a text without one is FULL TEXT, a blank one has none."""
    mark = "\ue000"  # of private use; stands before each heading, which the pattern finds one after the other
    parts = F.split(F.regexp_replace(F.replace(text, F.lit(mark), F.lit(" ")), f"({HEADING})".replace("((?imd)", "(?imd)("), mark + "$1"), mark)
    number, words = (lambda p, k: F.regexp_extract(p, HEADING, k)), F.trim
    title = lambda p: F.concat(F.lit("ITEM "), F.upper(number(p, 1)), F.when(words(number(p, 2)) != "", F.concat(F.lit(" — "), words(number(p, 2)))).otherwise(""))
    headed = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.struct(title(p).alias("heading"), F.regexp_replace(p, r"^\s+|\s+$", "").alias("body")))
    whole = F.array(F.struct(F.lit("FULL TEXT").alias("heading"), text.alias("body")))
    none = F.array().cast("array<struct<heading: string, body: string>>")
    return F.when(F.coalesce(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit("")) == "", none).when(F.size(parts) > 1, headed).otherwise(whole)


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, heading, body: the sections of each text in their order."""
    return docs.select(key, F.posexplode(_section_list(F.col(text))).alias("n", "_s")).select(key, "n", "_s.heading", "_s.body")


def _sentences(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE), lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: F.length(s).between(40, 800))


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(_sentences(F.col(text))).alias("n", "sentence"))


def _hits(text: Column, terms: tuple[str, ...]) -> Column:
    """Whole-word hits of terms of three letters and more, whatever their case."""
    known = [t.strip().lower() for t in terms if len(t.strip()) >= 3]
    return sum((F.regexp_count(F.lower(text), F.lit(EDGE + re.escape(t) + EDGE)) for t in known), F.lit(0))


def extractive(docs: DataFrame, key: str, text: str, terms: tuple[str, ...], most: int) -> DataFrame:
    """key, n, sentence: a text's sentences with most whole-word hits, in its own order."""
    scored = F.transform(_sentences(F.col(text)), lambda s, n: F.struct((-_hits(s, terms)).alias("hits"), n.alias("n"), s.alias("sentence")))
    best = F.slice(F.array_sort(scored), 1, most)
    return docs.select(key, F.explode(F.array_sort(F.transform(best, lambda x: F.struct(x["n"].alias("n"), x["sentence"].alias("sentence"))))).alias("_x")).select(key, "_x.*")


def sized(docs: DataFrame, key: str, text: str, terms: tuple[str, ...], full: int = 15, by_section: int = 100, budget: int = 40_000, most: int = 60) -> DataFrame:
    """key, pages, way, feeding: what of a long text is read on: all of it (up to the budget) with fewer than `full` pages, its sections with
    most hits while they fit the budget up to `by_section` pages, else the `most` sentences with most hits in the text's order.

    The budget is the feature's own; a text whose best section doesn't fit, or without sentences, gives its beginning.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    pages = F.ceil(F.length(t) / PAGE).cast("long")
    start = F.substring(t, 1, budget)
    ranked = F.array_sort(F.transform(_section_list(t), lambda s, n: F.struct((-_hits(F.concat(s["heading"], F.lit("\n"), s["body"]), terms)).alias("hits"), n.alias("n"), s["heading"].alias("h"), s["body"].alias("b"))))
    empty = F.struct(F.lit("").alias("out"), F.lit(False).alias("over"))

    def fit(acc, s):
        over = acc["over"] | (F.length(acc["out"]) + F.length(s["b"]) + F.length(s["h"]) + 16 > budget)
        return F.struct(F.when(over, acc["out"]).otherwise(F.concat(acc["out"], F.lit("## "), s["h"], F.lit("\n"), s["b"], F.lit("\n\n"))).alias("out"), over.alias("over"))

    chosen = F.regexp_replace(F.aggregate(ranked, empty, fit)["out"], r"^\s+|\s+$", "")
    scored = F.array_sort(F.transform(_sentences(t), lambda s, n: F.struct((-_hits(s, terms)).alias("hits"), n.alias("n"), s.alias("s"))))
    picked = F.array_join(F.transform(F.array_sort(F.transform(F.slice(scored, 1, most), lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s")))), lambda x: x["s"]), " ")
    nothing = lambda c: F.when(c == "", start).otherwise(c)
    way = F.when(F.col("pages") < full, "full").when(F.col("pages") <= by_section, "sections").otherwise("sentences")
    out = docs.withColumn("pages", pages).withColumn("way", way)
    return out.select(key, "pages", "way", F.when(F.col("way") == "full", start).when(F.col("way") == "sections", nothing(chosen)).otherwise(nothing(picked)).alias("feeding"))


def batches(rows: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """key, order, batch, number, covers: rows in order, a new batch where the budget of characters would be exceeded; numbers run on over the batches.

    covers names the numbers of a row's batch; with one batch there is nothing to join.  One group is one conversation.
    """
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.length(F.coalesce(text, F.lit(""))).alias("n")))).alias("_x"))
    empty = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        over = (acc["used"] + x["n"] > budget) & (acc["used"] > 0)
        batch = F.when(over, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(batch.alias("batch"), F.when(over, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"), F.concat(acc["out"], F.array(batch)).alias("out"))

    each = lists.select(key, "_x", F.aggregate("_x", empty, step)["out"].alias("_b")).select(key, "_b", F.posexplode(F.arrays_zip("_x", "_b")).alias("_p", "_z"))
    number = F.col("_p") + 1
    first = F.array_position("_b", F.col("_z._b")).cast("int")
    last = first + F.size(F.filter("_b", lambda b: b == F.col("_z._b"))) - 1
    covers = F.concat(F.lit("Batch covering articles "), first.cast("string"), F.lit("–"), last.cast("string"))
    return each.select(key, F.col(f"_z._x.{order}").alias(order), F.col("_z._b").alias("batch"), number.cast("int").alias("number"), F.when(F.array_max("_b") > 0, covers).alias("covers"))


def threads_across(members: DataFrame, terms: DataFrame, a: str, b: str, least: float, duplicate: float = 0.999, most: int = 10) -> DataFrame:
    """thread_a, thread_b, pairs, similarity, mean, shared, duplicates: the pairs of two symbols' threads by their articles' best cosine.

    members: symbol, thread, id, vector; terms: symbol, thread, terms (label terms in order).  One article in both proves nothing; a pair
    with the same content twice is counted (duplicates) and left out; `most` pairs of `least` and more are kept.
    """
    one = members.where(F.col("symbol") == a).select(F.col("thread").alias("thread_a"), F.col("id").alias("_ia"), F.col("vector").alias("_va"), F.lit(0).alias("_k"))
    two = members.where(F.col("symbol") == b).select(F.col("thread").alias("thread_b"), F.col("id").alias("_ib"), F.col("vector").alias("_vb"), F.lit(0).alias("_k"))
    salt = 64
    one = one.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    two = two.withColumn("_s", F.pmod(F.xxhash64("thread_b", "_vb"), F.lit(salt)).cast("int"))
    both = one.join(two, ["_k", "_s"]).where("_ia <> _ib").withColumn("_c", cosine(F.col("_va"), F.col("_vb")))
    rows = both.groupBy("thread_a", "thread_b").agg(F.count("*").alias("pairs"), F.max("_c").alias("_best"), F.avg("_c").alias("_mean"))
    twice = rows.agg(F.count_if(F.col("_best") >= duplicate).alias("duplicates"))
    label = lambda symbol, name: terms.where(F.col("symbol") == symbol).select(F.col("thread").alias(f"thread_{name}"), F.col("terms").alias(f"_t{name}"))
    near = rows.where((F.col("_best") >= least) & (F.col("_best") < duplicate)).withColumn("similarity", F.bround("_best", 3))
    best = near.orderBy(F.col("similarity").desc(), "thread_a", "thread_b").limit(most).join(label(a, "a"), "thread_a", "left").join(label(b, "b"), "thread_b", "left")
    shared = F.slice(F.filter("_ta", lambda t: F.array_contains("_tb", t)), 1, 6)
    return best.join(F.broadcast(twice), F.lit(True)).select("thread_a", "thread_b", "pairs", "similarity", F.bround("_mean", 3).alias("mean"), F.coalesce(F.array_join(shared, ","), F.lit("")).alias("shared"), "duplicates")  # one row


def shared_groups(threads: DataFrame, least: int = 2, most_terms: int = 6) -> DataFrame:
    """request, group, symbol, thread, terms: threads of several symbols that share label terms, grouped greedily in their order.

    threads: request, place, symbol, thread, terms.  A thread joins the first group that has none of its symbol and `least` of its terms, and
    adds its own terms up to `most_terms`; groups of one symbol aren't told.  A request is a few symbols' threads, so it is one task.
    """

    def grouped(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        groups: list[tuple[list[str], list[tuple[str, str]]]] = []
        for r in rows.sort_values("place").itertuples():
            own = list(r.terms)
            for terms, items in groups:
                if all(s != r.symbol for s, _ in items) and len(set(terms) & set(own)) >= least:
                    items.append((r.symbol, r.thread))
                    terms[:] = list(dict.fromkeys([*terms, *own]))[:most_terms]
                    break
            else:
                groups.append((own, [(r.symbol, r.thread)]))
        told = sorted((g for g in groups if len({s for s, _ in g[1]}) >= 2), key=lambda g: -len(g[1]))
        out = [(key[0], k + 1, s, t, ",".join(terms)) for k, (terms, items) in enumerate(told) for s, t in items]
        return pd.DataFrame(out, columns=["request", "group", "symbol", "thread", "terms"])

    return threads.select("request", "place", "symbol", "thread", "terms").groupBy("request").applyInPandas(grouped, "request string, group int, symbol string, thread string, terms string")


def grounding(news: DataFrame, symbols: list[str], terms: list[str], articles: int = 8, budget: int = 60_000, body: int = 1500) -> DataFrame:
    """position, symbol, id, used, heading, body: articles with two of the terms and more, by the symbols' order and the newest first, up to a number and a budget of characters."""
    if not 1 <= len(symbols) <= 4 or not terms:
        raise ValueError("one to four symbols and a term are needed")
    wanted = F.array(*[F.lit(t.lower()) for t in dict.fromkeys(terms)])
    place = F.array_position(F.array(*[F.lit(s) for s in symbols]), F.col("symbol"))
    rows = news.where(F.col("symbol").isin(*symbols)).where(F.size(F.array_intersect(tokens(wording()), wanted)) >= 2)
    first = rows.withColumn("_p", place).orderBy("_p", F.col("published_at").desc(), "id").limit(articles)
    order = W.orderBy("_p", F.col("published_at").desc(), "id")  # of `articles` rows
    heading = F.concat(F.lit("["), "symbol", F.lit("] "), F.coalesce("title", F.lit("")))
    text = F.coalesce("description", F.lit(""))
    out = first.withColumn("position", F.row_number().over(order)).withColumn("used", F.sum(F.length(heading) + 1 + F.length(text)).over(order))
    return out.where(F.col("used") <= budget).select("position", "symbol", "id", "used", heading.alias("heading"), F.substring(text, 1, body).alias("body"))


def chunks(text: Column, size: int = 1000) -> Column:
    """A text in pieces of `size` characters; one piece where it is shorter, whatever it holds."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.ceil(F.length(t) / size).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(t, k * size + 1, F.lit(size)))


def pooled(docs: DataFrame, key: str, text: str, embed, size: int = 1000) -> DataFrame:
    """key, vector: the mean, not scaled, of the vectors of a text's chunks, so that no end of a long text is lost; embed makes an array of a chunk column."""
    v = F.transform(chunks(F.col(text), size), embed)
    add = lambda s, x: F.when(F.size(s) == 0, x).otherwise(F.zip_with(s, x, lambda a, b: a + b))
    mean = lambda v: F.transform(F.array(F.struct(F.aggregate(v, F.array().cast("array<double>"), add).alias("t"), F.size(v).alias("n"))), lambda s: F.transform(s["t"], lambda x: x / s["n"]))[0]
    return docs.select(key, F.transform(F.array(v), mean)[0].alias("vector"))  # bound once: the chunks are cut and embedded once for a text


def expansion(news: DataFrame, verdicts: DataFrame, variations: list[str]) -> DataFrame:
    """variation, hits, candidates (hits without a verdict)."""
    found = news.select("id", F.explode(F.filter(F.array(*[F.lit(v) for v in variations]), lambda v: F.lower(wording()).contains(v))).alias("variation"))
    judged = verdicts.select(F.col("article_id").alias("id"), F.lit(1).alias("_j")).distinct()
    return found.join(judged, "id", "left").groupBy("variation").agg(F.count("*").alias("hits"), F.count_if(F.col("_j").isNull()).alias("candidates"))


def expands(verdicts: DataFrame, source: str, least: int = 5) -> DataFrame:
    """symbol, relevant, expands: whether too few relevant articles ask for more: verdicts exist, fewer than `least` are relevant, and the source can be searched by keyword."""
    rows = verdicts.groupBy("symbol").agg(F.count("*").alias("_n"), F.count_if(F.col("decision").isin("RELEVANT", "USER_APPROVED")).alias("relevant"))
    return rows.select("symbol", "relevant", ((F.col("_n") > 0) & (F.col("relevant") < least) & F.lit(source == "gdelt")).alias("expands"))


def expansion_tally(companies: DataFrame, news: DataFrame, verdicts: DataFrame, judged: DataFrame, failed: DataFrame, variations: list[str], first: Column, most: int = 20) -> DataFrame:
    """symbol, queries, candidates, relevant, failed: what a search by keyword variations brings each symbol.

    news holds what is knowable, of which a query finds the newest `most` since `first`; a candidate has no verdict for its symbol (article_id,
    symbol) and is one however many queries find it; judged: id, decision of the articles; failed: symbol, variation of queries without an answer.
    """
    text = F.lower(wording())
    hits = news.where(F.col("published_at") >= first).select("symbol", "id", "published_at", F.explode(F.filter(F.array(*[F.lit(v) for v in variations]), lambda v: text.contains(v))).alias("variation"))
    hits = hits.join(failed, ["symbol", "variation"], "left_anti")
    newest = W.partitionBy("symbol", "variation").orderBy(F.col("published_at").desc(), "id")
    taken = hits.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= most).select("symbol", "id").distinct()
    known = verdicts.select("symbol", F.col("article_id").alias("id"))
    fresh = taken.join(known, ["symbol", "id"], "left_anti").join(judged.select("id", "decision"), "id", "left")
    counts = fresh.groupBy("symbol").agg(F.count("*").alias("candidates"), F.count_if(F.col("decision") == "RELEVANT").alias("relevant"))
    broken = failed.where(F.col("variation").isin(variations)).groupBy("symbol").agg(F.sort_array(F.collect_set(F.concat_ws(" ", "symbol", "variation"))).alias("failed"))  # of the variations
    out = companies.select("symbol").join(counts, "symbol", "left").join(broken, "symbol", "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))
    return out.select("symbol", (F.lit(len(variations)) - F.size("failed")).alias("queries"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("relevant", F.lit(0)).alias("relevant"), "failed")
