"""Order statistics over growing prefixes: the k-th smallest value of all rows that are no later than a day.

Values of a key are a tree of ranges.  A node with many rows is cut into ranges by sampled bounds; its rows are
counted by day and range, and running sums over the days say into which range each asked place falls and which
place it has there.  Nodes with few rows, or with one value, are answered exactly.  What is held together is one
node's days times its ranges, which the calendar bounds, or its few rows; no row meets another.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept

#: Distinct (day, value) rows of a node that is answered by itself, and ranges that a larger one is cut into.
FEW_ROWS, RANGES = 20_000, 64


def order_statistics(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """key, at, k, value: for each asked (key, at, k) the k-th smallest value, from 0, of the rows (key, at, value) of its key that are no later; none where there are too few.

    Rows without a key, a day or a value don't count; equal values count as often as they are there.
    """
    rows = rows.select("key", "at", "value").dropna().groupBy("key", "at", "value").agg(F.count("*").alias("n"))
    rows = kept(rows.withColumn("node", F.lit("")), "ranks")
    asked = kept(asked.select("key", "at", "k", F.col("k").alias("place"), F.lit("").alias("node")).where("k >= 0"), "asked")
    done = []
    while True:
        sizes = rows.groupBy("key", "node").agg(F.count("*").alias("_rows"), (F.min("value") == F.max("value")).alias("_one"))
        small = (F.col("_rows") <= FEW_ROWS) | F.col("_one")
        sizes = kept(asked.select("key", "node").distinct().join(sizes, ["key", "node"]), "nodes")
        in_small = sizes.where(small).select("key", "node")
        done.append(_answered(rows.join(in_small, ["key", "node"], "left_semi"), asked.join(in_small, ["key", "node"], "left_semi")))
        large = sizes.where(~small)
        if large.isEmpty():
            break
        cuts = F.percentile_approx("value", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10_000))
        # a bound ends its range; the least value is one, so a node always falls apart
        bounds = rows.join(large, ["key", "node"]).groupBy("key", "node").agg(F.array_distinct(F.concat(F.array(F.min("value")), cuts)).alias("_bounds"))
        at = F.size(F.filter("_bounds", lambda b: b < F.col("value")))
        cut = kept(rows.join(bounds, ["key", "node"]).select("key", "at", "value", "n", "node", at.alias("range")), "ranges")
        asked = kept(_descended(cut, asked.join(large, ["key", "node"], "left_semi")), "asked")
        rows = cut.withColumn("node", F.concat("node", F.lit("."), F.col("range").cast("string"))).drop("range").join(asked.select("key", "node").distinct(), ["key", "node"], "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _descended(cut: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked places in the ranges that they fall into."""
    daily = cut.groupBy("key", "node", "at", "range").agg(F.sum("n").alias("n"))

    def down(daily: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        asked = asked.sort_values("at")
        days, at = np.unique(daily["at"], return_inverse=True)
        counts = np.zeros((len(days) + 1, RANGES + 1), np.int64)
        np.add.at(counts, (at + 1, daily["range"].to_numpy()), daily["n"].to_numpy())
        upto = counts.cumsum(0).cumsum(1)  # by day, of this range and those below
        row = upto[np.searchsorted(days, asked["at"].to_numpy(days.dtype), "right")]
        place = asked["place"].to_numpy()
        to = (row <= place[:, None]).sum(1)
        inside = to <= RANGES
        below = np.where(to > 0, np.take_along_axis(row, np.maximum(to - 1, 0)[:, None], 1)[:, 0], 0)
        out = asked.assign(place=place - below, node=[f"{n}.{t}" for n, t in zip(asked["node"], to)])
        return out[inside]

    return daily.groupBy("key", "node").cogroup(asked.groupBy("key", "node")).applyInPandas(down, asked.schema)


def _answered(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked places of nodes with few rows, day by day: counts of the values so far in a tree of sums."""

    def pick(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        values, rank = np.unique(rows["value"], return_inverse=True)
        rows = rows.assign(_rank=rank).sort_values("at")
        asked = asked.sort_values("at")
        top = 1 << max(len(values) - 1, 0).bit_length()
        tree = [0] * (top + 1)
        total, j, found = 0, 0, []
        told = list(zip(rows["at"], rows["_rank"], rows["n"]))
        for at, place in zip(asked["at"], asked["place"]):
            while j < len(told) and told[j][0] <= at:
                i, n = told[j][1] + 1, told[j][2]
                while i <= top:
                    tree[i] += n
                    i += i & -i
                total += n
                j += 1
            if place >= total:
                found.append(None)
                continue
            at_, step = 0, top
            while step:
                if at_ + step <= top and tree[at_ + step] <= place:
                    at_ += step
                    place -= tree[at_]
                step //= 2
            found.append(float(values[at_]))
        out = asked.assign(value=pd.Series(found, index=asked.index, dtype="float64"))
        return out[out["value"].notna()][["key", "at", "k", "value"]]

    schema = f"key {asked.schema['key'].dataType.simpleString()}, at {asked.schema['at'].dataType.simpleString()}, k long, value double"
    return rows.groupBy("key", "node").cogroup(asked.groupBy("key", "node")).applyInPandas(pick, schema)
