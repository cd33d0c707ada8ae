"""Exact neighbours of vectors by cosine, over cells of sampled pivots that are skipped by certified bounds.

Every vector goes to the cell of its nearest pivot, by its angle; it is kept as it came, and brought to unit length where it is compared.  A cell keeps the least and greatest angle of its
vectors to every pivot.  Angles obey the triangle inequality, so two vectors are at least as far apart as the gap between
their cells' angles to any pivot; pairs of cells whose gap is beyond the asked angle are never joined.  The others meet in
blocks of bounded size, where all cosines of two blocks are one matrix product over Arrow columns.

Where only the best of many pairs is asked, cells are put together in packs, and a task that holds two packs passes on what is best
in them: a vector is exchanged once for each pack, of which there are few, and no pair leaves its task.  Inside a task only cells that may be near are multiplied.

What reaches the driver are the pivots and a row for each two of them; their number is bounded, whatever the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ship import ship
from ..storage import kept

#: Vectors of a cell, about, and pivots at most; vectors of a block that are multiplied at once.
CELL, MOST_PIVOTS, BLOCK = 250, 192, 2000
#: Vectors of a pack at least and at most, and packs of a side below that; rows whose cosines a task holds at once, and how many cosines.
LEAST_PACK, PACK, PACKS, TILE, COSINES = 4000, 120_000, 4, 256, 8_000_000
#: What rounding to nine digits may add to a cosine; pairs of groups that a task keeps before it takes their best.
ROUNDED, HELD = 1e-9, 4_000_000
#: What rounding may add to a bound, as an angle.
SLACK = 1e-6


@dataclass
class Cells:
    """Vectors, as they came, in their cells (id, cell, block, vector), the number of blocks and of vectors of each cell, and the angles of its vectors to the pivots."""

    rows: DataFrame
    blocks: dict[int, int]
    sizes: dict[int, int]
    low: dict[int, np.ndarray]
    high: dict[int, np.ndarray]


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; missing places at the end are zero."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _width(*columns: pa.Array | pa.ChunkedArray) -> int:
    """The length of the longest list of these columns, at least 1."""
    return max(1, *(pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns))


def unit(v: np.ndarray) -> np.ndarray:
    norm = np.sqrt((v * v).sum(1))
    return v / np.where(norm == 0, 1, norm)[:, None]


def _lists(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1)))


def pivots_of(rows: DataFrame) -> np.ndarray:
    """A sample of the rows' vectors at unit length, drawn by a hash of their ids: one for each CELL rows, MOST_PIVOTS at most."""
    n, width = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    take = min(MOST_PIVOTS, max(1, n // CELL))
    found = [r.vector for r in rows.orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(take).select("vector").collect()]
    width = max(width or 1, 1)
    return unit(np.array([[*map(float, v), *[0.0] * (width - len(v))] for v in found] or [[0.0] * width]))


def cells(rows: DataFrame, pivots: np.ndarray, name: str = "id", more: tuple[str, ...] = ()) -> Cells:
    """The rows (id, vector, and `more` columns) in their cells; rows without a vector aren't there."""
    spark, width = rows.sparkSession, pivots.shape[1]
    of = rows.schema["vector"].dataType.elementType.simpleString()
    of = of if of in ("float", "double") else "double"
    ship(spark)
    known = spark.sparkContext.broadcast(pivots)
    kind = rows.schema[name].dataType.simpleString()

    def to_pivots(column: pa.Array) -> np.ndarray:
        return unit(matrix(column, max(width, _width(column))))[:, :width] @ known.value.T  # pivots are zero beyond their width

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = to_pivots(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.argmax(1).astype(np.int32)), *b.columns[1:]], names=["id", "cell", "vector", *more])

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column(0).to_numpy()
            angle = np.arccos(np.clip(to_pivots(b.column(1)), -1, 1))
            found = np.unique(cell)
            ends = [np.stack([f(angle[cell == c], 0) for c in found]) if len(found) else np.zeros((0, len(pivots))) for f in (np.min, np.max)]
            p = np.tile(np.arange(len(pivots), dtype=np.int32), len(found))
            n = np.repeat(np.array([(cell == c).sum() for c in found], np.int64), len(pivots))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(found, len(pivots)), p, *[e.reshape(-1) for e in ends], n)], names=["cell", "pivot", "low", "high", "n"])

    placed = kept(rows.where("vector is not null").select(F.col(name).alias("id"), F.col("vector").cast(f"array<{of}>"), *more).mapInArrow(assign, f"id {kind}, cell int, vector array<{of}>" + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in more)), "cells")
    told = placed.select("cell", "vector").mapInArrow(angles, "cell int, pivot int, low double, high double, n long").groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    low, high, sizes = {}, {}, {}
    for r in told.collect():  # a row for each two pivots
        low.setdefault(r.cell, np.zeros(len(pivots)))[r.pivot] = r.low
        high.setdefault(r.cell, np.zeros(len(pivots)))[r.pivot] = r.high
        sizes[r.cell] = r.n
    blocks = {c: -(-n // BLOCK) for c, n in sizes.items()}
    n_blocks = F.element_at(F.create_map(*[F.lit(x) for c, k in blocks.items() for x in (c, k)]), F.col("cell")) if blocks else F.lit(1)
    return Cells(placed.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int")), blocks, sizes, low, high)


def meeting(q: Cells, r: Cells, least: float | dict[int, float]) -> list[tuple[int, int]]:
    """Pairs of cells that may hold vectors of a cosine of at least `least` (one number, or one for each cell of q)."""
    out = []
    for i in q.sizes:
        angle = np.arccos(np.clip(least[i] if isinstance(least, dict) else least, -1, 1)) + SLACK
        out += [(i, j) for j in r.sizes if max((r.low[j] - q.high[i]).max(), (q.low[i] - r.high[j]).max()) <= angle]
    return out


def compared(q: Cells, r: Cells, pairs: list[tuple[int, int]]) -> int:
    """Cosines that are taken for these pairs of cells."""
    return sum(q.sizes[i] * r.sizes[j] for i, j in pairs)


def _joined(q: Cells, r: Cells, pairs: list[tuple[int, int]], tell: Callable, schema: str) -> DataFrame:
    """tell(ids of q, ids of r, cosines) of each two blocks that meet; each row goes to the blocks that its cell meets."""
    spark = q.rows.sparkSession
    plan = lambda: F.broadcast(spark.createDataFrame([(i, j, q.blocks[i], r.blocks[j]) for i, j in pairs], "_i int, _j int, _qn int, _rn int"))  # noqa: E731  MOST_PIVOTS squared at most
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = q.rows.join(plan(), F.col("cell") == F.col("_i")).select("_i", F.col("block").alias("_a"), "_j", upto("_rn").alias("_b"), "id", "vector")
    right = r.rows.join(plan(), F.col("cell") == F.col("_j")).select("_i", upto("_qn").alias("_a"), "_j", F.col("block").alias("_b"), "id", "vector")

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        two = two.rename_columns(one.schema.names)
        width = _width(one["vector"], two["vector"])
        a, b = (unit(matrix(t["vector"], width)) for t in (one, two))
        return tell(one["id"], two["id"], a @ b.T)

    key = ["_i", "_a", "_j", "_b"]
    left, right = left.toDF("_i", "_a", "_j", "_b", "id", "vector"), right.toDF(*[f"_{c}" for c in ("i", "a", "j", "b", "id", "vector")])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meet, schema)


def near_pairs(queries: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """q, id, similarity of the rows (id, vector) whose cosine with a query (q, vector) is `least` or more, other than those of its own id.

    Vectors may be of different lengths (what is missing is zero); a vector without length has cosine 0.
    """
    pivots = pivots_of(rows.select("id", "vector").where("vector is not null"))
    r = cells(rows, pivots)
    q = cells(queries, pivots, "q")
    kinds = [queries.schema["q"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()]
    schema = f"q {kinds[0]}, id {kinds[1]}, similarity double"

    def tell(a: pa.ChunkedArray, b: pa.ChunkedArray, cosines: np.ndarray) -> pa.Table:
        i, j = np.nonzero(cosines >= least)
        return pa.table({"q": a.take(pa.array(i)), "id": b.take(pa.array(j)), "similarity": cosines[i, j]})

    pairs = meeting(q, r, least)
    if not pairs:
        return rows.sparkSession.createDataFrame([], schema)
    return _joined(q, r, pairs, tell, schema).where("id <> q")


def nearest_other(rows: DataFrame) -> DataFrame:
    """q, similarity: the cosine of each row's (id, vector) nearest other one; none for a single row; ids are unique.

    A cell's own blocks give each vector a first neighbour; the least of these bounds the cells that are looked at then.
    """
    c = cells(rows, pivots_of(rows))
    schema = f"q {rows.schema['id'].dataType.simpleString()}, similarity double, cell int"

    def best(pairs: list[tuple[int, int]]) -> DataFrame:
        def tell(a: pa.ChunkedArray, b: pa.ChunkedArray, cosines: np.ndarray) -> pa.Table:
            own = {x: k for k, x in enumerate(b.to_pylist())}
            for k, x in enumerate(a.to_pylist()):
                if x in own:
                    cosines[k, own[x]] = -np.inf
            top = cosines.max(1) if cosines.shape[1] else np.full(len(cosines), -np.inf)
            some = np.flatnonzero(np.isfinite(top))
            return pa.table({"q": a.take(pa.array(some)), "similarity": top[some], "cell": pa.nulls(len(some), pa.int32())})

        return _joined(c, c, pairs, tell, schema).groupBy("q").agg(F.max("similarity").alias("similarity"))

    if not c.sizes:
        return rows.sparkSession.createDataFrame([], schema).drop("cell")
    first = kept(best([(i, i) for i in c.sizes]), "first")
    least = dict.fromkeys(c.sizes, -1.0)
    in_cell = c.rows.select(F.col("id").alias("q"), "cell").join(first, "q", "left").groupBy("cell").agg(F.min(F.coalesce("similarity", F.lit(-1.0))).alias("least"))
    least |= {r.cell: r.least for r in in_cell.collect()}
    others = [(i, j) for i, j in meeting(c, c, least) if i != j]
    if not others:
        return first
    return first.unionByName(best(others)).groupBy("q").agg(F.max("similarity").alias("similarity"))


def _packs(c: Cells) -> dict[int, range]:
    """The packs of each cell: cells in the order of their angle to a pivot, as many as fit; a cell that is larger than a pack has several."""
    room = min(PACK, max(-(-sum(c.sizes.values()) // PACKS), LEAST_PACK))
    out, at, filled = {}, 0, 0
    for cell in sorted(c.sizes, key=lambda i: (c.low[i][0], i)):
        parts = -(-c.sizes[cell] // room)
        if filled and filled + c.sizes[cell] > room:
            at, filled = at + 1, 0
        out[cell] = range(at, at + parts)
        at, filled = (at + parts, 0) if parts > 1 else (at, filled + c.sizes[cell])
    return out


def _met(q: Cells, r: Cells, least: float, columns: list[str], tell: Callable, schema: str) -> DataFrame | None:
    """tell(table of q, table of r, cells of r that each cell of q may be near) of each two packs that meet; None where none do."""
    spark = q.rows.sparkSession
    near: dict[int, set[int]] = {}
    for i, j in meeting(q, r, least):
        near.setdefault(i, set()).add(j)
    if not near:
        return None
    mine, theirs = _packs(q), _packs(r)
    pairs = sorted({(a, b) for i, js in near.items() for j in js for a in mine[i] for b in theirs[j]})
    plan = lambda: F.broadcast(spark.createDataFrame(pairs, "_a int, _b int"))  # noqa: E731  packs squared

    def side(c: Cells, packs: dict[int, range], key: str) -> DataFrame:
        of = lambda f: F.element_at(F.create_map(*[F.lit(x) for i, p in packs.items() for x in (i, f(p))]), F.col("cell"))
        return c.rows.withColumn(key, (of(lambda p: p.start) + F.pmod(F.xxhash64("id"), of(len))).cast("int")).join(plan(), key).select("_a", "_b", "id", "cell", "vector", *columns)

    left, right = side(q, mine, "_a"), side(r, theirs, "_b").toDF("_c", "_d", *[f"_{c}" for c in ("id", "cell", "vector", *columns)])

    def meet(one: pa.Table, two: pa.Table) -> pa.Table:
        return tell(one, two.rename_columns(one.schema.names), near)

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_c", "_d")).applyInArrow(meet, schema)


def _tiles(one: pa.Table, two: pa.Table, near: dict[int, set[int]], a_order: np.ndarray, b_order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of one, rows of two and their cosines, tile by tile; rows of one by cell, then as in a_order; those of two as in b_order.  A row and one of its own id have none."""
    if not one.num_rows or not two.num_rows:
        return
    width = _width(one["vector"], two["vector"])
    a, b = (unit(matrix(t["vector"], width)) for t in (one, two))
    ids = pd.factorize(pd.concat([t["id"].to_pandas() for t in (one, two)], ignore_index=True), use_na_sentinel=False)[0]
    mine, theirs = pd.DataFrame({"id": ids[: len(a)], "i": np.arange(len(a))}), pd.DataFrame({"id": ids[len(a) :], "j": np.arange(len(b))})
    same = mine.merge(theirs, on="id").sort_values("i")
    same_i, same_j = same["i"].to_numpy(), same["j"].to_numpy()
    a_cell, b_cell = one["cell"].to_numpy(), two["cell"].to_numpy()[b_order]
    for cell in np.unique(a_cell):
        rows, cols = a_order[a_cell[a_order] == cell], b_order[np.isin(b_cell, list(near.get(int(cell), ())))]
        if not len(cols):
            continue
        other, place = b[cols].T, np.full(len(b), -1)
        place[cols] = np.arange(len(cols))
        step = max(1, min(TILE, COSINES // len(cols)))
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            s = a[some] @ other
            low, high = np.searchsorted(same_i, some, "left"), np.searchsorted(same_i, some, "right")
            for x, (u, v) in enumerate(zip(low, high)):
                own = place[same_j[u:v]]
                s[x, own[own >= 0]] = -np.inf
            yield some, cols, s


def _best(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the greatest value of each."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.maximum.reduceat(value, first) if len(first) else value


def _sets(column: pa.ChunkedArray) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's set of groups, and the sets."""
    known: dict[tuple, int] = {}
    return np.array([known.setdefault(tuple(x), len(known)) for x in column.to_pylist()], np.int64), list(known)


def best_of_groups(queries: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """q, case_id, similarity: the greatest cosine, rounded to nine digits, of two vectors of different ids, one of a group of the queries and one of a group of the rows, where it is `least` or more.

    queries and rows: id, vector, of (names of the groups that it belongs to).  Vectors of the same groups are taken together first.
    """
    pivots = pivots_of(rows.select("id", "vector").where("vector is not null"))
    q, r = (cells(d, pivots, more=("of",)) for d in (queries, rows))
    schema = "q string, case_id string, similarity double"

    def tell(one: pa.Table, two: pa.Table, near: dict[int, set[int]]) -> pa.Table:
        (a_set, asked), (b_set, held) = _sets(one["of"]), _sets(two["of"])
        key, value, kept_ = [np.zeros(0, np.int64)], [np.zeros(0)], 0
        for i, j, s in _tiles(one, two, near, np.argsort(a_set, kind="stable"), np.argsort(b_set, kind="stable")):
            ends = [np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) for x in (a_set[i], b_set[j])]
            top = np.maximum.reduceat(np.maximum.reduceat(s, ends[1], axis=1), ends[0], axis=0)
            x, y = np.nonzero(top >= least - ROUNDED)
            key.append(a_set[i][ends[0][x]] * len(held) + b_set[j][ends[1][y]])
            value.append(top[x, y])
            kept_ += len(x)
            if kept_ > HELD:
                k, v = _best(np.concatenate(key), np.concatenate(value))
                key, value, kept_ = [k], [v], 0
        k, v = _best(np.concatenate(key), np.concatenate(value))
        out: dict[tuple, float] = {}
        for x, y, most in zip(k // max(len(held), 1), k % max(len(held), 1), v):
            for g in asked[x]:
                for h in held[y]:
                    out[g, h] = max(out.get((g, h), -2.0), most)
        return pa.table({"q": pa.array([g for g, _ in out], pa.string()), "case_id": pa.array([h for _, h in out], pa.string()), "similarity": pa.array(list(out.values()), pa.float64())})

    found = _met(q, r, least, ["of"], tell, schema)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    return found.groupBy("q", "case_id").agg(F.bround(F.max("similarity"), 9).alias("similarity")).where(F.col("similarity") >= least)


def nearest(queries: DataFrame, rows: DataFrame, least: float, most: int) -> DataFrame:
    """q, id, similarity: of each query (q, vector) the `most` nearest rows (id, vector) of another id whose cosine, rounded to nine digits, is `least` or more; of equal ones the smaller ids."""
    pivots = pivots_of(rows.select("id", "vector").where("vector is not null"))
    r = cells(rows, pivots)
    q = cells(queries, pivots, "q")
    kinds = [queries.schema["q"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()]
    schema = f"q {kinds[0]}, id {kinds[1]}, similarity double"

    def tell(one: pa.Table, two: pa.Table, near: dict[int, set[int]]) -> pa.Table:
        by_id = pc.sort_indices(two["id"]).to_numpy().astype(np.int64)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j, s in _tiles(one, two, near, np.arange(one.num_rows), by_id):
            bar = np.full(len(i), least - ROUNDED)
            if s.shape[1] > most:
                bar = np.maximum(bar, np.partition(s, s.shape[1] - most, axis=1)[:, -most] - 2 * ROUNDED)
            x, y = np.nonzero(s >= bar[:, None])
            value = np.round(s[x, y], 9)
            order = np.lexsort((y, -value, x))  # columns are in the order of ids
            x, y, value = x[order], y[order], value[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            take = (place < most) & (value >= least)
            found.append((i[x[take]], j[y[take]], value[take]))
        a, b, value = (np.concatenate(c) for c in zip(*found))
        return pa.table({"q": one["id"].take(pa.array(a)), "id": two["id"].take(pa.array(b)), "similarity": value})

    found = _met(q, r, least, [], tell, schema)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    order = W.partitionBy("q").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k")
