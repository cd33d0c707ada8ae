"""SimHash fingerprints and search by permuted block tables, on built-in functions only.

Terms are a text's words in lower case, hashed to 64 bits.  A term votes on every bit with its weight,
the square of its length beyond two characters (one at least), so that short common words count little;
a bit is set where more than half of the weight sets it.  Each bit has a 64-bit sum of its own: a string
holds less than 2^31 characters, so the squares of its words' lengths add up to less than 2^62.

The search splits fingerprints into radius + 3 blocks and keeps a table for every choice of three of
them: two fingerprints within the radius differ in `radius` blocks at most, so they agree on the three
blocks of one table.  Tables hold distinct fingerprints with their number of rows, whatever the size of
a group of copies, and are joined with the blocks of a stated set of queries.

Defined results: a null text is an empty text, whose fingerprint is 0; equal texts have equal
fingerprints; documents are ordered by id, rows that repeat an id by their text's hash; null ids come last;
an empty table has no rows; extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, saved

#: Fingerprints with so many differing bits at most are near.
RADIUS = 3
#: Documents of a bucket of neighbours, about, and buckets at most.
BUCKET_DOCS, BUCKETS = 1000, 16384


def _votes(word: Column) -> list[Column]:
    """64 sums over words; sum j is the weight of the words that set bit j."""
    return [F.sum(F.shiftrightunsigned(word, j).bitwiseAND(F.lit(1)) * F.col("_w")).alias(f"_v{j}") for j in range(64)]


def _fingerprint() -> Column:
    bits = F.lit(0).cast("long")
    for j in range(64):
        bits = bits.bitwiseOR(F.shiftleft((F.col(f"_v{j}") > F.col("_all") - F.col(f"_v{j}")).cast("long"), j))
    return F.coalesce(bits, F.lit(0).cast("long"))


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp (long) of each text; keys tell the rows apart."""
    words = rows.select(*keys, F.explode_outer(F.split(F.lower(text), BLANKS)).alias("_word"))
    words = words.withColumn("_h", F.xxhash64("_word")).withColumn("_n", F.length("_word").cast("long"))
    # blank strings at the ends of a text have no weight
    words = words.withColumn("_w", F.when(F.col("_n") > 0, F.greatest((F.col("_n") - 2) * (F.col("_n") - 2) * (F.col("_n") > 2).cast("long"), F.lit(1))).otherwise(0).cast("long"))
    return words.groupBy(*keys).agg(F.sum("_w").alias("_all"), *_votes(F.col("_h"))).select(*keys, _fingerprint().alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def _buckets(docs: DataFrame) -> DataFrame:
    """docs with _bucket: ranges of ids from the highest down, and with a copy (_ghost) of each following bucket's first document."""
    n = docs.count()
    parts = max(1, min(BUCKETS, n // BUCKET_DOCS))
    cuts: list[int] = []
    if parts > 1:
        share = F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], parts * 4)
        cuts = sorted(set(docs.agg(share).first()[0] or []))  # a number for each bucket, whose number is bounded
    if cuts:
        ends = F.array(*[F.lit(c).cast("long") for c in cuts])
        steps = [2**k for k in reversed(range(len(cuts).bit_length()))]
        below = F.aggregate(
            F.array(*[F.lit(s) for s in steps]),
            F.lit(0),
            lambda at, step: F.when((at + step <= len(cuts)) & (F.try_element_at(ends, at + step) < F.col("doc_id")), at + step).otherwise(at),
        )
        bucket = F.coalesce(below, F.lit(0))
    else:
        bucket = F.lit(0)
    dealt = docs.withColumn("_bucket", bucket).withColumn("_ghost", F.lit(False))
    tops = {r[0]: r[1] for r in dealt.groupBy("_bucket").agg(F.max("doc_id")).collect()}  # one id a bucket
    order = sorted(tops, reverse=True)
    # the first of the bucket below follows a bucket's last; the first of all follows the last of all
    follow = [(tops[order[(k + 1) % len(order)]], b) for k, b in enumerate(order)]
    if not follow:
        return dealt
    spark = docs.sparkSession
    ghosts = spark.createDataFrame(follow, "_top long, _for int")
    copies = docs.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("_top"))).select(*docs.columns, F.col("_for").alias("_bucket"), F.lit(True).alias("_ghost"))
    return dealt.unionByName(copies)


def edited(documents: DataFrame) -> DataFrame:
    """One row a document in _bucket and _rn: doc_id, text, and the text whose last half the next document's beginning replaces."""
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = _buckets(docs)
    w = W.partitionBy("_bucket").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc(), "text")
    rows = rows.withColumn("_next", F.lead("text").over(w)).withColumn("_rn", F.row_number().over(w)).where("not _ghost")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return rows.select("_bucket", "_rn", "doc_id", n.cast("long").alias("n_chars"), "text", F.concat(F.expr("substr(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substr(F.coalesce("_next", F.lit("")), F.lit(1), half)).alias("edited"))


def near_pairs(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, near_fp, distance, n_rows: each distinct fingerprint of prints (fp) within the radius of one of queries, itself included, and its number of rows."""
    blocks = radius + 3
    ends = [64 * k // blocks for k in range(blocks + 1)]
    masks = [sum(((1 << (ends[b + 1] - ends[b])) - 1) << ends[b] for b in chosen) for chosen in combinations(range(blocks), 3)]
    masks = [m - 2**64 if m >= 2**63 else m for m in masks]
    table = F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("_table", "_mask")
    keyed = lambda df, name: df.select("*", table).select(*df.columns, "_table", F.col(name).bitwiseAND(F.col("_mask")).alias("_key"))
    all_ = keyed(prints.groupBy("fp").agg(F.count("*").alias("_rows")), "fp")
    asked = keyed(queries.select(F.col("fp").alias("_q")).distinct(), "_q")
    found = all_.join(asked, ["_table", "_key"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("_q"))) <= radius)
    pairs = found.groupBy("_q", "fp").agg(F.first("_rows").alias("n_rows"))
    return pairs.select(F.col("_q").alias("fp"), F.col("fp").alias("near_fp"), F.bit_count(F.col("fp").bitwiseXOR(F.col("_q"))).alias("distance"), "n_rows")


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp and n_near of each distinct fingerprint of queries: rows of prints (fp) within the radius, itself included."""
    return near_pairs(prints, queries, radius).groupBy("fp").agg(F.sum("n_rows").alias("n_near"))


def members(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """near_fp, doc_id: the documents of each fingerprint that near_pairs() found; copies are listed once a fingerprint, not once a pair."""
    return prints.select(F.col("fp").alias("near_fp"), "doc_id").join(pairs.select("near_fp").distinct(), "near_fp", "left_semi")


def report(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """op6's result; n_near is set for the stated queries, documents whose id is divisible by 100."""
    rows = edited(documents)
    keys = ["_bucket", "_rn", "doc_id", "n_chars", "edited_sha256", "_which"]
    both = rows.select("_bucket", "_rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("_which", "_text"))
    votes = fingerprints(both, keys, "_text")
    prints = votes.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("_which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("_which") == 1, F.col("fp"))).alias("efp"))
    prints = saved(prints, "prints")
    next_first = _next_fp(prints)
    near = near_counts(prints, prints.where("doc_id % 100 = 0"), radius)
    out = next_first.join(near.withColumnRenamed("fp", "_nfp"), (F.col("fp") == F.col("_nfp")) & (F.col("doc_id") % 100 == 0), "left")
    text = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("efp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("_nextfp")).alias("near_next"), "n_near",
    )


def _next_fp(prints: DataFrame) -> DataFrame:
    """prints with _nextfp: the fingerprint of the next row, over the same buckets; a bucket's last row takes the first of the bucket below."""
    w = W.partitionBy("_bucket").orderBy("_rn")
    firsts = {r[0]: r[1] for r in prints.where("_rn = 1").select("_bucket", "fp").collect()}  # one number a bucket
    order = sorted(firsts, reverse=True)
    after = [(b, firsts[order[(k + 1) % len(order)]]) for k, b in enumerate(order)]
    table = prints.sparkSession.createDataFrame(after, "_bucket int, _first long")
    return prints.join(F.broadcast(table), "_bucket", "left").withColumn("_nextfp", F.coalesce(F.lead("fp").over(w), F.col("_first")))
