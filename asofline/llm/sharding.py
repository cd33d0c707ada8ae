"""Consistent-hash ring with virtual nodes and bounded loads, on built-in functions only.

Every shard owns some virtual nodes on a ring of 2**32 places; a document belongs to the first virtual
node at or after the hash of its id.  A shard takes what its own arcs bring until it is full; what
overflows continues clockwise to the next shard with room.  With slack 0 the capacities differ by one
row at most and add up to the number of rows, so every shard ends exactly full (law ``rows``).  A
larger slack trades balance for fewer moved rows when the ring grows.

Only the counts of the ring's arcs, whose number is shards x virtual nodes x BLOCKS whatever the input,
reach the driver, where the overflow is walked; rows are ranked inside blocks of an arc, never in one
task for all.

Defined results: a null text counts no bytes and has the checksum of an empty text; a null id is hashed
as the text ``null``; rows that repeat an id are told apart by their text, and identical rows by nothing:
they take neighbouring places; an empty table has no rows; extra columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

#: Virtual nodes of a shard on the ring.
VIRTUAL_NODES = 32
#: Parts of an arc that are ranked separately.
BLOCKS = 16


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, clockwise; the places of a shard don't depend on the others."""
    from zlib import crc32

    places: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            place = (crc32(f"shard {shard} node {node}".encode()) * 2654435761) % 2**32
            places.setdefault(place, shard)
    return sorted(places.items())


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("null"))), F.lit(2**32))


def _arc(place: Column, nodes: list[tuple[int, int]]) -> Column:
    """Number of the virtual node at or after a place: a binary search in a constant array."""
    ends = F.array(*[F.lit(p) for p, _ in nodes])
    steps = [2**k for k in reversed(range(len(nodes).bit_length()))]
    below = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(nodes)) & (F.try_element_at(ends, at + step) < place), at + step).otherwise(at),
    )
    return F.pmod(below, F.lit(len(nodes)))


def walk(counts: dict[tuple[int, int], int], nodes: list[tuple[int, int]], shards: int, slack: float = 0.0) -> list[tuple[int, int, int, int, int, int]]:
    """Where ranks of (arc, block) go: (arc, block, first rank, end, shard, slot of the first)."""
    total = sum(counts.values())
    base, more = divmod(total, shards)
    room = [base + (s < more) if not slack else max(base + (s < more), int((1 + slack) * total / shards)) for s in range(shards)]
    used = [0] * shards
    plan, left = [], []

    def give(arc, block, first, end, shard):
        n = min(end - first, room[shard] - used[shard])
        if n > 0:
            plan.append((arc, block, first, first + n, shard, used[shard]))
            used[shard] += n
        return first + max(n, 0)

    for (arc, block), n in sorted(counts.items()):
        first = give(arc, block, 0, n, nodes[arc][1])
        if first < n:
            left.append((arc, block, first, n))
    for arc, block, first, end in left:
        at = arc
        while first < end:
            at = (at + 1) % len(nodes)
            first = give(arc, block, first, end, nodes[at][1])
    return plan


def assign(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0) -> DataFrame:
    """key, size, text_crc32, shard, slot of every row: its shard and its place there, gapless from 0."""
    nodes = ring(shards, virtual_nodes)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_place", _place(F.col(key)))
    rows = rows.withColumn("_arc", _arc(F.col("_place"), nodes)).withColumn("_block", F.pmod(F.xxhash64("_place", "text_crc32", "size"), F.lit(BLOCKS)).cast("int"))
    rows = saved(rows, "ring")  # slim; the texts are read once
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("_arc", "_block").count().collect()}  # shards x virtual_nodes x BLOCKS numbers
    plan = walk(counts, nodes, shards, slack)
    schema = "_arc int, _block int, _runs array<struct<first: long, end: long, shard: int, slot: long>>"
    grouped: dict[tuple[int, int], list] = {}
    for arc, block, *run in plan:
        grouped.setdefault((arc, block), []).append(tuple(run))
    runs = rows.sparkSession.createDataFrame([(a, b, r) for (a, b), r in grouped.items()], schema)
    ranked = rows.withColumn("_rank", F.row_number().over(W.partitionBy("_arc", "_block").orderBy("_place", key, "text_crc32", "size")) - 1)
    run = F.filter("_runs", lambda r: (r["first"] <= F.col("_rank")) & (F.col("_rank") < r["end"]))[0]
    return (
        ranked.join(F.broadcast(runs), ["_arc", "_block"])
        .withColumn("_run", run)
        .select(key, "size", "text_crc32", F.col("_run.shard").alias("shard"), (F.col("_run.slot") + F.col("_rank") - F.col("_run.first")).alias("slot"))
    )


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """op5's result: every document's shard under the law ``rows``."""
    out = assign(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
