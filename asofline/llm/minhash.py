"""Near-duplicates by MinHash with tensored banding and exact confirmation.

A document's set are its distinct word shingles.  Two collections of HALVES half keys, each of ROWS
minhashes, are computed; the key of table (i, j) combines half key i of the first with half key j of the
second.  So HALVES**2 tables cost 2 * HALVES * ROWS minhashes instead of 2 * HALVES**2 * ROWS.  A half key
that no other set has can't be part of a shared table key and is left out before keys are combined.

Equal sets are one class, whatever their number.  The search has two phases, whatever the sizes of its groups.
First the least class of each bucket of FIRST**2 tables is compared with the bucket's others, which connects
nearly all that belongs together by a pair a class and bucket.  Then all tables count, but only half keys that
classes of different components have: a pair of a bucket has been compared, is connected already, or is met here.

In the second phase bounds of the overlap leave pairs out before sets are fetched.  Shingles that no other of
these sets has can't be common.  A pair whose frequent shingles (more than LOW sets have them) are too few must
share a rare one; as many rare ones as it still needs, less one, may be left out at the end of the order by
frequency, so it is met at one of the others, found by the shingle itself, of which LOW sets at most have any.
Only pairs that may be near by their frequent shingles alone are met by table: members of a bucket outside its
largest component ask for the bucket's other components, and each pair is met once, at its least shared half key.
These bounds are exact.  Rows of arrays that were taken apart are joined by sorting, for Spark takes them for as few as
their arrays and might broadcast them.  The other pairs are confirmed on the full sets.  A pair at the threshold 0.8 is missed by all
tables with probability 2 * (1 - 0.8**ROWS)**HALVES, 0.0007; one at 0.85 with 0.00001.

Defined results: null or blank texts have no shingles and are linked with nothing; texts with fewer words
than a shingle are one shingle of all words; rows with a null id are kept and in no component; rows that
repeat an id are one document, kept or left out together (so two equal rows with one id both stay); an empty table
has no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cached_by, counted, in_tasks, saved, swept
from .components import components, joined

#: Minhashes of a half key, and half keys of each of the two collections.
ROWS, HALVES = 5, 20
#: Half keys of each collection that the first phase looks at.
FIRST = 8
#: Sets that have a rare shingle, at most.
LOW = 64
#: Ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Words whose hashes a Python worker keeps.
CACHE_WORDS = 200_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_MANY = (np.random.default_rng(20).integers(1, 2**31, 2 * HALVES * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()


def forget() -> None:
    _words.clear()


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text: A-Z in lower case, words between ASCII blanks."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - width + 1)
    h = np.full(n, min(len(w), width), np.uint64)
    for k in range(min(len(w), width)):
        h = (h ^ w[k : k + n]) * _ODD[k % 8]
        h ^= h >> np.uint64(29)
    h *= _ODD[5]
    h ^= h >> np.uint64(32)
    return np.unique(h)


def half_keys(h: np.ndarray) -> np.ndarray:
    """2 * HALVES half keys of a set."""
    small = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_MANY), 2**32 - 1, np.uint32)
    for begin in range(0, len(small), 2048):
        np.minimum(least, (small[None, begin : begin + 2048] * _MANY).min(axis=1), out=least)
    rows = least.reshape(2 * HALVES, ROWS).astype(np.uint64)
    key = np.arange(1, 2 * HALVES + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * _ODD[k]
        key ^= key >> np.uint64(31)
    return key


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def signatures(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, s1, s2 (which identify the set) and halves of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached_by("minhash", forget)
        for b in batches:
            n, s1, s2, halves = [], [], [], []
            for t in b.column(1):
                h = shingles(t.as_py(), width)
                n.append(len(h))
                s1.append(np.add.reduce(h).view(np.int64))
                g = h * _ODD[6]
                s2.append(np.add.reduce(g ^ (g >> np.uint64(32))).view(np.int64))
                halves.append(half_keys(h).view(np.int64) if len(h) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _lists(halves)],
                names=["doc_id", "n_shingles", "s1", "s2", "halves"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_text"))
    return in_tasks(rows, run, "doc_id long, n_shingles long, s1 long, s2 long, halves array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, few: bool, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """node, set (array of shingle hashes) of the documents whose id is in ids (node); few: no more than may be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached_by("minhash", forget)
        for b in batches:
            for begin in range(0, b.num_rows, 500):
                part = b.slice(begin, 500)
                sets = [shingles(t.as_py(), width).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], names=["node", "set"])

    rows = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("_text"))
    return in_tasks(rows.join(F.broadcast(ids) if few else ids.hint("merge"), "node", "left_semi"), run, "node long, set array<long>")


def _lists_of(half: DataFrame) -> DataFrame:
    """node and the half keys (a, b) of the rows (node, pos, half), of the classes with some in both collections."""
    lists = half.groupBy("node").agg(F.collect_list(F.struct("pos", "half")).alias("_h"))  # 2 * HALVES at most
    one, two = F.filter("_h", lambda h: h["pos"] < HALVES), F.filter("_h", lambda h: h["pos"] >= HALVES)
    return lists.select("node", one.alias("a"), two.alias("b")).where("size(a) > 0 and size(b) > 0")


def sharing(classes: DataFrame) -> DataFrame:
    """node, n and the half keys (a, b) that other classes have too, of the classes with some in both collections."""
    half = classes.select("node", F.posexplode("halves").alias("pos", "half"))
    shared = half.groupBy("pos", "half").agg(F.count("*").alias("_c")).where("_c > 1").drop("_c")
    return _lists_of(half.join(shared.hint("merge"), ["pos", "half"])).join(classes.select("node", "n"), "node")


def between(placed: DataFrame) -> DataFrame:
    """placed (node, comp, n, a, b) with only those half keys that classes of two components and more have."""
    half = placed.select("node", "comp", F.explode(F.concat("a", "b")).alias("_e")).select("node", "comp", "_e.pos", "_e.half")
    several = half.groupBy("pos", "half").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("pos", "half")
    return _lists_of(half.join(several.hint("merge"), ["pos", "half"])).join(placed.drop("a", "b"), "node")


def keyed(rows: DataFrame, most: int = HALVES) -> DataFrame:
    """rows with the key of each of their tables, of the first `most` half keys of each collection."""
    others = [c for c in rows.columns if c not in ("a", "b")]
    one, two = F.filter("a", lambda h: h["pos"] < most), F.filter("b", lambda h: h["pos"] < HALVES + most)
    both = rows.select(*others, F.explode(one).alias("_a"), two.alias("_b")).select(*others, "_a", F.explode("_b").alias("_b"))
    return both.select(F.xxhash64("_a.pos", "_a.half", "_b.pos", "_b.half").alias("key"), *others)


def with_shared(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """nodes with m, the number of their shingles that other sets have too; without those that nothing can meet."""
    alone = sets.select("node", F.explode("set").alias("_s")).groupBy("_s").agg(F.count("*").alias("_c"), F.min("node").alias("node")).where("_c = 1").groupBy("node").agg(F.count("*").alias("_alone"))
    out = nodes.join(alone, "node", "left").withColumn("m", F.col("n") - F.coalesce("_alone", F.lit(0))).drop("_alone")
    return out.where(100 * F.col("m") >= percent * F.col("n"))


def _near(percent: int, most, n, other):
    """Whether sets of n and other shingles can meet the threshold with an overlap of `most` at most."""
    return 100 * most >= percent * (n + other - most)


def by_half(rows: DataFrame, most: int) -> DataFrame:
    """rows once for each of their half keys _h among the first `most` of the first collection, with those below it (_below) and those of the second (_two)."""
    others = [c for c in rows.columns if c not in ("a", "b")]
    one = F.array_sort(F.transform(F.filter("a", lambda h: h["pos"] < most), lambda h: h["half"]))
    two = F.transform(F.filter("b", lambda h: h["pos"] < HALVES + most), lambda h: h["half"])
    each = rows.select(*others, one.alias("_one"), two.alias("_two")).select(*others, "_one", "_two", F.posexplode("_one").alias("_p", "_h"))
    return each.select(*others, "_h", F.slice("_one", F.lit(1), F.col("_p")).alias("_below"), "_two")


def meeting(placed: DataFrame, wanted: DataFrame, most: int, near) -> DataFrame:
    """u, node: leaders with the classes of wanted components (u, comp) that share a table with them, each pair once.

    A table is shared where a half key of both collections is; the least shared half key of the first one gives the pair.
    """
    lists = placed.select(F.col("node").alias("u"), "a", "b")
    asked = by_half(wanted.join(lists, "u"), most).withColumnsRenamed({"_below": "_ubelow", "_two": "_utwo"})
    members = by_half(placed.select("node", "comp", "n", "m", "a", "b"), most)
    once = F.arrays_overlap("_two", "_utwo") & ~F.arrays_overlap("_below", "_ubelow")
    return members.join(asked.hint("merge"), ["comp", "_h"]).where(near & once).select("u", "node")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose full sets meet the threshold."""
    one = sets.select(F.col("node").alias("u"), F.col("set").alias("_su"))
    two = sets.select(F.col("node").alias("v"), F.col("set").alias("_sv"))
    both = pairs.join(one, "u").join(two, "v")
    common = F.size(F.array_intersect("_su", "_sv"))
    return both.where(100 * common >= percent * (F.size("_su") + F.size("_sv") - common)).select("u", "v")


def stars(nodes: DataFrame, most: int, percent: int) -> DataFrame:
    """u, v: the least class of each bucket with the bucket's other classes that may be near; copies of a pair are dropped."""
    rows = keyed(nodes.select("node", F.col("n").cast("int"), F.col("m").cast("int"), "a", "b"), most)
    least = rows.groupBy("key").agg(F.min(F.struct("node", "n", "m")).alias("_l"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    near = _near(percent, F.least("m", "_l.m"), F.col("n"), F.col("_l.n"))
    return rows.join(least.hint("merge"), "key").where((F.col("node") != F.col("_l.node")) & near).select(F.col("_l.node").alias("u"), F.col("node").alias("v")).distinct()


def bounded(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rest with m and b, the numbers of their shingles that others of rest have, and more than LOW of them; and rare, the rarest ones.

    Two sets that can't meet the threshold by what is frequent (b) have a shingle of both rare arrays in common.
    """
    own = sets.join(rest.select("node"), "node").select("node", F.explode("set").alias("_s"))
    often = own.groupBy("_s").agg(F.count("*").alias("_df"), F.min("node").alias("_one"))
    alone = often.where("_df = 1").groupBy(F.col("_one").alias("node")).agg(F.count("*").alias("_alone"))
    few = own.join(often.where(F.col("_df").between(2, LOW)).drop("_one").hint("merge"), "_s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("_df", "_s"))).alias("_few"))  # shingles of one text
    zero = F.lit(0).cast("long")
    out = rest.join(alone, "node", "left").join(few, "node", "left")
    out = out.withColumn("m", F.col("n") - F.coalesce("_alone", zero)).withColumn("b", F.col("m") - F.coalesce(F.size("_few"), F.lit(0)))
    need = F.ceil(F.col("n") * percent / 100)
    first = F.when(F.col("b") >= need, F.col("m")).otherwise(F.col("m") - need + 1).cast("int")
    rare = F.transform(F.slice(F.coalesce("_few", F.expr("cast(array() as array<struct<_df: bigint, _s: bigint>>)")), F.lit(1), F.greatest(first, F.lit(0))), lambda e: e["_s"])
    return out.select(*rest.columns, "m", "b", rare.alias("rare")).where(100 * F.col("m") >= percent * F.col("n"))


def by_rare(rest: DataFrame, percent: int) -> DataFrame:
    """u, v: classes of different components with a rare shingle in common; LOW classes at most have it."""
    rows = rest.select("node", "comp", "n", "m", "b", F.explode("rare").alias("_s"))
    two = rows.select("_s", *[F.col(c).alias(f"_{c}") for c in ("node", "comp", "n", "m", "b")])
    usual = _near(percent, F.least("b", "_b"), F.col("n"), F.col("_n"))
    some = (F.col("node") < F.col("_node")) & (F.col("comp") != F.col("_comp")) & _near(percent, F.least("m", "_m"), F.col("n"), F.col("_n")) & ~usual
    return rows.join(two.hint("merge"), "_s").where(some).select(F.col("node").alias("u"), F.col("_node").alias("v")).distinct()


def by_table(rest: DataFrame, percent: int) -> DataFrame:
    """u, v: classes of different components that share a table and may be near by their frequent shingles alone.

    Members of a bucket outside its largest component ask for the bucket's other components.
    """
    rest = rest.where(100 * F.col("b") >= percent * F.col("n")).select("node", "comp", "n", F.col("b").alias("m"), "a", "b_")
    placed = saved(between(rest.withColumnRenamed("b_", "b")), "frequent")
    rows = keyed(placed, HALVES).select("key", "node", "comp", F.col("n").cast("int"), F.col("m").cast("int"))
    of_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("_c"), F.min("n").alias("_least"), F.max("m").alias("_most"))
    largest = of_comp.groupBy("key").agg(F.max(F.struct("_c", "comp")).alias("_m"), F.count("*").alias("_k")).where("_k > 1").select("key", F.col("_m.comp").alias("_largest"))
    lead = rows.join(largest.hint("merge"), "key").where("comp != _largest").select("key", F.col("node").alias("u"), F.col("n").alias("_ln"), F.col("m").alias("_lm"), F.col("comp").alias("_lcomp"))
    least = F.least("_lm", "_most")
    some = (F.col("comp") != F.col("_lcomp")) & _near(percent, least, F.col("_ln"), F.greatest("_least", least))
    wanted = lead.join(of_comp.select("key", "comp", "_least", "_most").hint("merge"), "key").where(some)
    wanted = wanted.groupBy("u", "comp").agg(F.first("_ln").alias("_ln"), F.first("_lm").alias("_lm"))
    near = _near(percent, F.least("m", "_lm"), F.col("n"), F.col("_ln"))
    return meeting(placed, wanted, HALVES, near).select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """node, component of the classes that are linked with others; classes: node, n, halves."""
    spark = docs.sparkSession
    nodes, n = counted(sharing(classes), "sharing")
    sets = saved(full_sets(docs, nodes.select("node"), n <= BROADCAST_IDS, width, key, text), "sets")
    nodes = saved(with_shared(nodes, sets, percent), "nodes")
    labels = components(confirmed(stars(nodes, FIRST, percent), sets, percent))
    swept(spark)
    placed = saved(nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component", "m"), "placed")
    rest = saved(bounded(between(placed).withColumnRenamed("b", "b_"), sets, percent), "rest")
    pairs = saved(by_rare(rest, percent), "rare_pairs").unionByName(saved(by_table(rest, percent), "table_pairs")).distinct()
    new = saved(confirmed(pairs, sets, percent), "links")
    swept(spark)
    return joined(labels, new)


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    sig = saved(signatures(docs, width, key, text), "signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("halves").alias("halves"))
    classes = saved(classes.withColumnRenamed("n_shingles", "n"), "classes")
    labels = links(docs, classes.select("node", "n", "halves"), width, percent, key, text)
    of_set = classes.join(labels, "node", "left").select("s1", "s2", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("_component"))
    out = sig.drop("halves").join(of_set, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
