"""Bound-certified best-fit packing of documents into sequences of a token budget.

Documents become token ids plus an end id; only longer ones than a sequence are cut.  Pieces are dealt
by hash over partitions of bounded size, and each partition runs best-fit decreasing.  Dual feasible
functions give a lower bound of the number of sequences for the partition's pieces: where the packing
meets it, the partition is certified and done.  Partitions with a gap keep their full sequences and
exchange the others, whole with their pieces, over partitions of the same bounded size, dealt anew each
round, where best-fit decreasing runs again on the pooled pieces; a repacking that isn't better is not
taken.  Rounds end when all partitions are certified, no partition got better or one was left alone.

Defined results: a null or empty text is one piece, the end id; repeated rows are packed each; a null
id is kept; an empty table has no sequences; extra columns aren't read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TrieBpe
from .common import cached_by, in_tasks, saved

#: Tokens of a sequence.
BUDGET = 2048
#: Pieces that one partition packs, about.
PARTITION_PIECES = 50_000
#: Rounds of exchange at most; what has a gap after the last one stays as it is packed.
ROUNDS = 6


class FastIds:
    """Ids of whole texts: the vocabulary's word-end symbols are written as the blank after a word, so that a rank encoder can merge them."""

    def __init__(self, path: str):
        self.exact = TrieBpe(path)
        ranks = dict(self.exact.inner) | {w + b" ": i for w, i in self.exact.final.items()}
        self.encoding = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        others = self.exact.words.pattern.replace(r"|[\p{L}]+", "")  # words but runs of letters
        self.apart = regex.compile(f"({others})")
        self.odd = regex.compile(r"[\x1c-\x1f]|Σ")

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.odd.search(text) or "<|" in text and self.exact.specials.search(text):
            return np.frombuffer(self.exact.batch([text], lambda e: b"".join([x[0] for x in e]))[0], np.uint32)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.encoding.encode_to_numpy(self.apart.sub(r" \1 ", " ".join(text.lower().split())) + " ")


@lru_cache(2)
def fast_ids(path: str) -> FastIds:
    return FastIds(path)


def forget() -> None:
    fast_ids.cache_clear()


def pieces(docs: DataFrame, path: str, budget: int = BUDGET, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32 of each piece of each document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached_by("packing", forget)
        encoder = fast_ids(path)
        for batch in batches:
            take, piece, start, length, crc = [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = np.append(encoder.ids(value.as_py()), np.uint32(end_id)).astype("<u4")
                for number, begin in enumerate(range(0, len(ids), budget)):
                    part = ids[begin : begin + budget]
                    take.append(row)
                    piece.append(number)
                    start.append(begin)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(take, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=[key, "piece", "start", "length", "ids_crc32"],
            )

    return in_tasks(docs.select(key, F.col(text).cast("string").alias("_text")), run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: np.ndarray, budget: int = BUDGET) -> int:
    """Sequences that pieces need at least; counts[l]: pieces of length l.  The best of a family of dual feasible functions."""
    lengths = np.nonzero(counts)[0]
    if not len(lengths):
        return 0
    n = counts[lengths].astype(np.int64)
    best = -(-int((lengths * n).sum()) // budget)
    # Those over half a sequence are alone; smaller ones than `small` are left out, and what is over budget - small counts whole.
    for small in sorted({1, *[int(x) for x in lengths if x <= budget // 2], *[budget - int(x) for x in lengths if x > budget // 2]}):
        if not 0 < small <= budget // 2:
            continue
        worth = np.where(lengths > budget - small, budget, np.where(lengths >= small, lengths, 0))
        best = max(best, -(-int((worth * n).sum()) // budget))
    # Rounding to k + 1 equal shares: a length over i shares of k + 1 counts as i of k.
    for k in range(1, 33):
        shares = lengths * (k + 1)
        whole = shares % budget == 0
        worth = np.where(whole, lengths * k, (shares // budget) * budget)
        best = max(best, -(-int((worth * n).sum()) // (k * budget)))
    return best


def best_fit_decreasing(lengths: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, and the tokens used of each sequence."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    open_by_room: list[list[int]] = [[] for _ in range(budget + 1)]
    rooms = 0  # bit r: a sequence with room r is open
    for item, length in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + ((fitting & -fitting).bit_length() - 1)
            bin_ = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, bin_ = budget, len(used)
            used.append(0)
        where[item], offset[item] = bin_, used[bin_]
        used[bin_] += length
        room -= length
        if room:
            open_by_room[room].append(bin_)
            rooms |= 1 << room
    return where, offset, np.array(used, np.int64)


def _packer(key: str, budget: int):
    names = [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "used", "done", "better", "bins", "bound"]

    def pack(group: tuple, table: pa.Table) -> pa.Table:
        lengths = table["length"].to_numpy().astype(np.int64)
        before, offset0, used0 = (table[c].to_numpy() for c in ("sequence_id", "offset", "used"))
        where, offset, used = best_fit_decreasing(lengths, budget)
        bound = lower_bound(np.bincount(lengths, minlength=budget + 1), budget)
        round_, part = int(group[0].as_py()), int(group[1].as_py())
        ids = (round_ << 58) | (part << 26) | where
        fill = used[where]
        bins = len(used)
        better = not round_ or bins < len(np.unique(before))
        if not better:  # it keeps the sequences it got
            ids, offset, fill, bins = before, offset0, used0, len(np.unique(before))
        done = np.full(len(ids), bins <= bound) | (fill == budget)
        columns = [*(table[c] for c in names[:5]), *(pa.array(x.astype(np.int64)) for x in (ids, offset, fill)), pa.array(done), *(pa.array(np.full(len(ids), x)) for x in (better, bins, bound))]
        return pa.Table.from_arrays(columns, names=names)

    return pack


def pack(items: DataFrame, budget: int = BUDGET, key: str = "doc_id", partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """The pieces (as from pieces()) with sequence_id and offset, and the round's number of sequences (bins) and bound of its partition."""
    kind = items.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, used long, done boolean, better boolean, bins long, bound long"
    n = items.count()
    pool = items.select("*", *(F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset", "used")))
    parts = max(1, -(-n // partition_pieces))
    unit = [F.monotonically_increasing_id()]  # by row, so that repeated rows are dealt too; the saved table keeps its order
    finished = []
    for round_ in range(rounds):
        dealt = pool.withColumn("_round", F.lit(round_)).withColumn("_part", F.pmod(F.xxhash64(F.lit(round_), *unit), F.lit(parts)))
        packed = saved(dealt.groupBy("_round", "_part").applyInArrow(_packer(key, budget), schema), f"packed{round_}")
        left, better = packed.agg(F.count_if(~F.col("done")), F.bool_or("better")).first()
        if round_ == rounds - 1 or round_ > 0 and parts == 1 or not left or not better:
            finished.append(packed)
            break
        finished.append(packed.where("done"))
        pool = packed.where("not done").drop("done", "better", "bins", "bound")
        parts = max(1, -(-left // partition_pieces))  # as bounded as at first, however many are left
        unit = ["sequence_id"]  # whole sequences move, so that a partition knows how many it got
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out.drop("done", "better", "used")


def packed_documents(docs: DataFrame, path: str, budget: int = BUDGET) -> DataFrame:
    """op3's result: every piece of every document with its sequence and offset."""
    return pack(saved(pieces(docs, path, budget), "pieces"), budget)
