"""Chat formatting with cumulative-snapshot collapse.

Logs of a growing conversation hold each snapshot as a conversation of its own.  Every turn gets a hash of
its position, role and text, and the running exclusive-or of these hashes identifies each turn prefix (two
64-bit hashes).  A conversation whose whole is a proper prefix of another one is dropped by an anti-join, of
equal conversations the one with the smallest id stays, and only the turns of those that stay are joined
with their texts and rendered.  Prefixes and wholes are made distinct before the join, so that an opening
shared by many conversations is one row.

Rendering: ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end for each turn; ``<|`` in a role
or a text is written ``< |``, so that no text can open or close a turn.

Defined results: turns are ordered by turn (nulls first), role and text; repeated rows are turns of their own;
a null role is rendered as ``unknown`` and a null text as an empty one; rows with a null conv_id are in no
conversation and make no row; extra columns aren't read; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns so far), p1, p2: the prefix hashes of each conversation; without texts."""
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_t"))
    w = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "_t")
    rows = rows.withColumn("n", F.row_number().over(w))
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("conv_id", "n", F.expr("bit_xor(xxhash64(n, role, _t))").over(run).alias("p1"), F.expr("bit_xor(xxhash64(_t, n, role, 'second'))").over(run).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no other one continues."""
    marks = saved(prefixes(turns), "prefixes")
    ends = marks.groupBy("conv_id").agg(F.max(F.struct("n", "p1", "p2")).alias("_e")).select("conv_id", "_e.*")
    wholes = ends.groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = marks.join(ends.select("conv_id", F.col("n").alias("_last")), "conv_id").where("n < _last").select("n", "p1", "p2").distinct()
    return wholes.join(inner, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies (of the whole conversation) and text of each maximal conversation: op1's result."""
    kept = maximal(turns)
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role, text = F.coalesce("role", F.lit("unknown")), F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.sha2(text, 256).alias("_t"), text.alias("text"))
    one = F.concat(F.lit("<|im_start|>"), safe(F.col("_x.role")), F.lit("\n"), safe(F.col("_x.text")), F.lit("<|im_end|>\n"))
    body = rows.join(kept, "conv_id").withColumn("_x", F.struct("turn", "role", "_t", "text"))
    body = body.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct(F.col("_x.turn"), F.col("_x.role"), F.col("_x._t"), one.alias("one")))).alias("_turns"))  # one conversation, one text
    return body.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("_turns.one"), "").alias("text"))


SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), sha256(coalesce(text, ''))) AS n
    FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, n, string_agg(sha256(n || '|' || sha256(role) || sha256(text)), '') OVER (PARTITION BY conv_id ORDER BY n) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
wholes AS (SELECT prefix, min(conv_id) AS conv_id, any_value(n_turns) AS n_turns, count(*) AS n_copies FROM p WHERE n = n_turns GROUP BY prefix),
kept AS (SELECT * FROM wholes WHERE prefix NOT IN (SELECT prefix FROM p WHERE n < n_turns))
SELECT k.conv_id, k.n_turns, k.n_copies, string_agg('<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY t.n) AS text
FROM kept k JOIN t USING (conv_id) GROUP BY k.conv_id, k.n_turns, k.n_copies
"""
