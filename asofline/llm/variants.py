"""Spelling variants by anagram hashing.

A word's key is the sum of its letters, each to the fifth power: an integer that doesn't depend on their order.
Two words that differ by one letter have keys that differ by one letter's value (an addition or removal) or by
the difference of two values (an exchange).  Every word tells its key without each of its letters once.  A word
that has a letter more meets the other's whole key there; of an exchange both words meet at the key without their
own letter.  What differs lies in one half of the words, so the other half, which must be equal, is part of the
join key: words meet that agree in one half and in the letters of the other half but for one, whatever its order.
The order of letters is verified then: `levenshtein` bounded by one.

Forms are followed to the last by doubling: each round looks up the root of a root.  A form has ten times as
many occurrences, so chains are short, and rounds end when no root moves any more.

Defined results: null texts have no words; a null id counts as an empty text in the hash; repeated rows count as
often as they are there; an empty table has no rows; ties are told in the docstrings; columns other than the id and
the text, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import saved, swept

#: Least code points and occurrences of a word, and how many times as many occurrences its form has.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many runs loses a code point.
MISSPELT = 31
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POWER = 5


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, misspelt: int = MISSPELT, at_least: int = LEAST_COUNT) -> DataFrame:
    """word, n: runs of Latin letters in lower case (A-Z alone) and how often they occur; of one run in `misspelt`, by its hash, a code point is left out.

    A word has at least `least` code points after that, and so has its run before.  Counts are partly summed before the shuffle.
    """
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))).alias("_run"))
    runs = runs.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    h = F.crc32(F.concat_ws(":", "_id", "_run").cast("binary"))
    at = F.pmod(h, F.length("_run")).cast("int")
    cut = F.when(F.pmod(h, F.lit(misspelt)) == 0, F.concat(F.expr("substring(_run, 1, _at)"), F.expr("substring(_run, _at + 2)"))).otherwise(F.col("_run"))
    found = runs.withColumn("_at", at).select(cut.alias("word")).where(F.length("word") >= least)
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def _letters(text: Column) -> Column:
    return F.split(text, "")


def anagram_key(text: Column) -> Column:
    """Sum of the letters' code points to the fifth power; long words' sums may wrap round, which only brings more candidates."""
    return F.aggregate(F.filter(_letters(text), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: (s + _value(c)).bitwiseAND(F.lit((1 << 62) - 1)))


def _value(letter: Column) -> Column:
    return F.pow(F.ascii(letter), F.lit(POWER)).cast("long")


def _without(word: str, equal: Column, rest: Column, side: int, size: Column) -> list[Column]:
    """Columns of the row that a word tells for each distinct letter of `rest`, whose other half is `equal`."""
    letters = F.array_distinct(F.filter(_letters(rest), lambda c: c != ""))
    whole = F.col("_key")
    return [F.col(word), size.alias("_size"), F.lit(side).alias("_side"), F.xxhash64(equal).alias("_half"), F.explode(F.transform(letters, lambda c: (whole - _value(c)).bitwiseAND(F.lit((1 << 62) - 1)))).alias("_left")]


def near_pairs(table: DataFrame, word: str = "word") -> DataFrame:
    """a, b: each two distinct words that differ by exactly one inserted, deleted or replaced code point, once, a being the shorter or first one; words are distinct and not null."""
    rows = table.select(F.col(word).alias("w")).withColumns({"_n": F.length("w"), "_key": anagram_key(F.col("w"))})
    rows = saved(rows, "keys")
    n = F.col("_n")
    part = lambda first, size=None: F.expr(f"substring(w, {first}{'' if size is None else f', {size}'})")
    sides = [(part("1", "_n div 2"), part("_n div 2 + 1")), (part("_n div 2 + 1"), part("1", "_n div 2"))]  # the equal half, the other
    told = lambda pairs, size: [rows.select(*_without("w", equal, rest, k, size)) for k, (equal, rest) in enumerate(pairs)]
    union = lambda parts: parts[0].unionByName(parts[1])

    # exchange: both words without one letter each, of one length, with an equal half
    exchange = union(told(sides, n))
    key = ["_size", "_side", "_half", "_left"]
    x, y = exchange.withColumnRenamed("w", "a"), exchange.withColumnRenamed("w", "b")
    replaced = x.join(y, key).where("a < b").where(F.levenshtein("a", "b", 1) == 1).select("a", "b")

    # removal: the longer word without one letter meets the shorter one; halves are those of the shorter
    longer = union(told([(part("1", "(_n - 1) div 2"), part("(_n - 1) div 2 + 1")), (part("(_n - 1) div 2 + 2"), part("1", "(_n - 1) div 2 + 1"))], n - 1))
    shorter = [rows.select(F.col("w").alias("a"), n.alias("_size"), F.lit(k).alias("_side"), F.xxhash64(equal).alias("_half"), F.col("_key").alias("_left")) for k, (equal, _) in enumerate(sides)]
    met = union(shorter).join(longer.withColumnRenamed("w", "b"), key)
    # words that agree in both halves meet twice, once a side
    once = (F.col("_side") == 0) | (F.expr("substring(a, 1, _size div 2)") != F.expr("substring(b, 1, _size div 2)"))
    removed = met.where(once).where(F.levenshtein("a", "b", 1) == 1).select("a", "b")
    return replaced.unionByName(removed)


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the chain word, form, form of the form, ... of each row (word, form) ends; chains have no circles.

    A chain of 2**k steps takes k rounds.
    """
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        seen = Observation("roots")
        up = now.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        now = saved(now.join(up, "root", "left").observe(seen, F.count("_up").alias("moved")).select("word", F.coalesce("_up", "root").alias("root")), "roots")
        if not seen.get.get("moved"):
            return now


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """op12's result: word, n, n_near (words near it), form (the near word of most occurrences, of equal ones the first in code-point order, if it has `times` as many), form_n, root (the last of the chain of forms, or the word)."""
    table = saved(words(docs, key, text), "words")
    pairs = saved(near_pairs(table), "near")
    swept(docs.sparkSession)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    of_b = table.select(F.col("word").alias("b"), F.col("n").alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("b").alias("word")))
    near = both.join(of_b, "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("_best"))
    told = F.col("n") * times <= -F.col("_best.n")
    out = table.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(told, F.col("_best.word")).alias("form"), F.when(told, -F.col("_best.n")).alias("form_n"))
    out = saved(out, "forms")
    return out.join(roots(out.where("form is not null")), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
