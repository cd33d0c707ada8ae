"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source, in the order of a hash, are one stream of words that is cut into blocks of equal
length.  A source's quota is its target in blocks.  A tree over the output shards divides the quotas: a node's
blocks of each source are divided among its two halves as a draw without replacement would do it (multivariate
hypergeometric, from a seed of the node), down to single shards, so quotas are kept exactly and shards have equal
numbers of blocks.  Each source's blocks are permuted by a keyed bijection, once for every time that the source is
gone through; a shard owns a range of the permuted places, so draws are disjoint, and blocks are ordered in their
shard by a hash.  Nothing but sums goes through one place: words are added up in hashed parts of a source whose
number follows the rows, and the permutation is computed where the documents are.

Sources take the weights in turn, in code-point order, null last.  All together give `share` times all words; a
target stops at `most` times its source's words, and what is left over goes to the others by weight until none is above.

Defined results: a null or blank text has no words, is part of its source, and nothing of it is taken; sources
without words have target 0; null sources are one source; rows with a null id or of equal ids are rows of their
own, identical rows change places freely; an empty table has no rows; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANKS, counted, in_tasks, saved

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2
#: Output shards of the query, and what its draws follow from.
SHARDS, SEED = 64, 13
#: Words of a block at least (fewer where a source has fewer than LEAST_BLOCKS of them), and blocks at most of a corpus, about: blocks grow with it.
BLOCK_WORDS, LEAST_BLOCKS, MOST_BLOCKS = 256, 256, 1 << 28
#: Rows of a hashed part whose words are added up in one task, about.
PART_ROWS = 20_000
#: Sources whose quotas are sent to every task; more are joined.
FEW_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit("[^" + BLANKS[1:-2] + "]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """Rows without their texts: key, size in words, _k (the source; '' for null), _h (place in its stream); written once."""
    name = F.col(source).cast("string")
    return docs.select(F.col(key), n_words(F.col(text)).alias("size"), F.coalesce(F.concat(F.lit("s"), name), F.lit("")).alias("_k"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_h"))


def ranked(sources: DataFrame) -> DataFrame:
    """sources (_k) with _rank, their place in code-point order, null last: ranges are sorted by themselves and counted."""
    order = [(F.col("_k") == "").asc(), F.col("_k").asc()]
    parts = saved(sources.repartitionByRange(*order).withColumn("_at", F.spark_partition_id()), "sources")
    before, first = 0, {}
    for at, n in sorted(map(tuple, parts.groupBy("_at").count().collect())):  # a row for each range
        first[at] = before
        before += n
    if not first:
        return parts.select("*", F.lit(0).cast("long").alias("_rank")).drop("_at")
    starts = F.create_map(*[F.lit(x) for at, n in first.items() for x in (at, n)])
    return parts.withColumn("_rank", F.row_number().over(W.partitionBy("_at").orderBy(*order)) - 1 + F.element_at(starts, F.col("_at"))).withColumn("_rank", F.col("_rank").cast("long")).drop("_at")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources (source_size, _rank) with target: weights in turn, `share` of all words, none above `most` times its own; each round is one sum over the sources."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows, cap = sources.withColumn("_w", weight), F.col("source_size") * float(most)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while True:
        full = cap <= F.col("_w") * level
        n, caps, open_ = rows.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_w")))).first()
        if n == before or not open_:
            break
        before, level = n, (share * total - (caps or 0.0)) / open_
    return rows.withColumn("target", F.least(cap, F.col("_w") * level)).drop("_w")


def quotas(sources: DataFrame, share: float = SHARE) -> DataFrame:
    """sources with _block (words of a block), _blocks and _quota, the target in blocks."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    words = max(BLOCK_WORDS, -(-int(share * total) // MOST_BLOCKS))
    block = F.greatest(F.lit(1), F.least(F.lit(words), F.ceil(F.col("source_size") / LEAST_BLOCKS))).cast("long")
    out = sources.withColumn("_block", block).withColumn("_blocks", F.ceil(F.col("source_size") / F.col("_block")).cast("long"))
    return out.withColumn("_quota", F.round(F.col("target") / F.col("_block")).cast("long"))


def divided(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """_rank, _ends: where the ranges of permuted places of shards 0, 1, ... end in each source (_rank, _quota).

    A level of the tree is one grouped step; a node has one row a source.
    """
    total = sources.agg(F.sum("_quota")).first()[0] or 0
    bound = lambda shard: total * shard // shards  # noqa: E731  blocks of the shards before
    schema = "_low int, _high int, _rank long, _n long"

    def halves(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        low, high = map(int, key)
        if high - low < 2:
            return rows
        rows, middle = rows.sort_values("_rank"), (low + high) // 2
        n = rows["_n"].to_numpy(np.int64)
        left = np.random.default_rng([seed, low, high]).multivariate_hypergeometric(n, bound(middle) - bound(low), method="marginals")
        parts = [pd.DataFrame({"_low": a, "_high": b, "_rank": rows["_rank"], "_n": x}) for a, b, x in ((low, middle, left), (middle, high, n - left))]
        return pd.concat(parts).astype({"_low": "int32", "_high": "int32"})

    nodes = sources.select(F.lit(0).alias("_low"), F.lit(shards).alias("_high"), "_rank", F.col("_quota").alias("_n"))
    for _ in range((shards - 1).bit_length()):
        nodes = nodes.groupBy("_low", "_high").applyInPandas(halves, schema)
    upto = W.partitionBy("_rank").orderBy("_low")
    ends = saved(nodes, "leaves").withColumn("_end", F.sum("_n").over(upto))
    return ends.groupBy("_rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("_low", "_end"))), lambda x: x["_end"]).alias("_ends"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of whole numbers (splitmix64's finish)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(block: np.ndarray, blocks: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each block under a bijection of [0, blocks) that its key names: a Feistel network of four rounds, walked until it is inside."""
    known = np.unique(blocks)
    half = np.array([(int(n - 1).bit_length() + 1) // 2 for n in known], np.uint64)[np.searchsorted(known, blocks)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = block.astype(np.uint64), np.arange(len(block))
    while len(todo):
        left, right, m, k = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo], key[todo]
        for step in range(4):
            left, right = right, left ^ (_mixed(right + k + np.uint64(step << 56)) & m)
        out[todo] = left << half[todo] | right
        todo = todo[out[todo] >= blocks[todo].astype(np.uint64)]
    return out.astype(np.int64)


PIECES = "array<struct<shard: int, sort: long, epoch: int, block: long, start: long, length: long>>"


def mixed(docs: DataFrame, shards: int = SHARDS, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """key, size, source_size, target, pieces: the runs of words (start in the text, length) that the mix takes of each document, with their shard, their block and its place in the shard's order (sort)."""
    rows, n = counted(sized(docs, key, text, source, seed), "sized")
    rows = rows.withColumn("_part", F.pmod(F.shiftrightunsigned("_h", 8), F.lit(max(1, -(-n // PART_ROWS)))))
    part = ["_k", "_part"]
    sums = saved(rows.groupBy(*part).agg(F.sum("size").alias("_words")), "parts")
    sources = ranked(sums.groupBy("_k").agg(F.sum("_words").alias("source_size")))
    sources = saved(quotas(targets(sources, weights, share, most), share), "quotas")
    found = sources.join(divided(sources, shards, seed), "_rank")
    starts = sums.select(*part, (F.sum("_words").over(W.partitionBy("_k").orderBy("_part")) - F.col("_words")).alias("_start"))
    upto = W.partitionBy(*part).orderBy("_h", key, "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("_upto", F.sum("size").over(upto)).join(starts, part).withColumn("_pos", F.col("_start") + F.col("_upto") - F.col("size"))
    few = sources.count() <= FEW_SOURCES
    out = placed.select("_k", F.col(key).alias("_key"), "size", "_pos").join(F.broadcast(found) if few else found, "_k")
    kind = docs.schema[key].dataType.simpleString()
    out = out.select("_key", "size", "source_size", "target", "_pos", "_rank", "_block", "_blocks", "_quota", "_ends")
    return in_tasks(out, lambda batches: _pieces(batches, seed), f"_key {kind}, size long, source_size long, target double, pieces {PIECES}").withColumnRenamed("_key", key)


def _pieces(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size, pos, rank, block, blocks, quota = (b.column(c).to_numpy() for c in ("size", "_pos", "_rank", "_block", "_blocks", "_quota"))
        first = pos // block
        n = np.where(size > 0, (pos + size - 1) // block - first + 1, 0)
        of = np.repeat(np.arange(len(size)), 2 * n)  # each block twice: two times through the source
        step = np.arange(len(of)) - np.repeat(np.cumsum(2 * n) - 2 * n, 2 * n)
        number, epoch = first[of] + step // 2, step % 2
        key = _mixed((rank[of] * 2 + epoch).astype(np.uint64) + np.uint64(seed << 40))
        place = permuted(number, blocks[of], key) + epoch * blocks[of]
        taken = place < quota[of]
        of, number, epoch, key, place = (x[taken] for x in (of, number, epoch, key, place))
        begin, end = np.maximum(pos[of], number * block[of]), np.minimum(pos[of] + size[of], (number + 1) * block[of])
        shard, ends, lists = np.zeros(len(of), np.int32), b.column("_ends"), rank[of]
        for r in np.unique(lists):
            at = lists == r
            shard[at] = np.searchsorted(ends[int(np.flatnonzero(rank == r)[0])].values.to_numpy(), place[at], "right")
        sort = (_mixed(key ^ number.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
        item = pa.StructArray.from_arrays([pa.array(x) for x in (shard, sort, epoch.astype(np.int32), number, begin - pos[of], end - begin)], names=["shard", "sort", "epoch", "block", "start", "length"])
        until = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(size)))])
        yield pa.RecordBatch.from_arrays([b.column(c) for c in ("_key", "size", "source_size", "target")] + [pa.ListArray.from_arrays(pa.array(until, pa.int32()), item)], names=["_key", "size", "source_size", "target", "pieces"])


def laid_out(mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """shard, place, key, start, length: the shards' contents in their order; blocks are shuffled in their shard."""
    rows = mix.select(F.col(key), F.explode("pieces").alias("_p")).select("_p.shard", "_p.sort", "_p.epoch", "_p.block", F.col(key), "_p.start", "_p.length")
    order = W.partitionBy("shard").orderBy("sort", "epoch", "block", key, "start")
    return rows.select("shard", (F.row_number().over(order) - 1).cast("long").alias("place"), key, "start", "length")


def texts(laid: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """laid_out() with the words of each piece, parted by blanks; ids are unique."""
    words = F.regexp_extract_all(F.col("_text"), F.lit("[^" + BLANKS[1:-2] + "]+"), F.lit(0))
    both = laid.join(docs.select(F.col(key), F.col(text).alias("_text")), key)
    return both.withColumn("words", F.array_join(F.slice(words, (F.col("start") + 1).cast("int"), F.col("length").cast("int")), " ")).drop("_text")


def report(docs: DataFrame) -> DataFrame:
    """op13's result: of each document how many words the mix takes, and its source's size and target."""
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["length"])
    return mixed(docs).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
