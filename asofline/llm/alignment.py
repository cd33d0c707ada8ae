"""Alignment of two tokenizers over the same bytes by elementary intervals.

The ends of both token sequences, joined by ``union1d``, cut a text's bytes into elementary intervals; each
interval is one overlap of the two tokens that ``searchsorted`` finds as its owners.  An end that both
sequences share closes a group.  A group's links are the product of its tokens, which is expanded over
distinct ids with their numbers of occurrences, so a long run of one token is a few rows.

A blank between two other characters always begins a token of either vocabulary: the byte-level one splits
there before it merges, and no piece of the other holds a blank after another character (checked when the
vocabulary is loaded).  Texts are cut at such blanks, and each distinct piece of text is encoded and aligned once.

An id pair's corpus-wide count is taken over all documents.  Pairs with more than a 65,536th of all (document,
pair) rows, of which there can be no more than 65,536, are looked up in the tasks that read the documents;
the rest is joined by pair, where no key is hot any more.

Defined results: texts that are null, empty, or not given back by either sequence's bytes have zeros and an empty
digest; equal texts have equal rows, and each row, repeated ones and those with a null id too, counts as a document;
an empty table has no rows; columns other than the id and the text, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _byte_symbols
from .common import cached_by, counted, in_tasks, saved

#: Distinct pieces of text whose alignments a Python worker keeps; beyond it the cache starts anew with the batch's own.
CACHE_PIECES = 300_000
#: Texts that are worked on together, and pieces that are encoded by one call.
BATCH_TEXTS, CALL_PIECES = 256, 500
#: Pairs that hold more than this share of all rows are looked up instead of joined: no more than HEAVY of them exist.
HEAVY = 1 << 16
#: A blank that begins a token for certain: plain characters stand before and after it; and a piece with plain ends.
CUT, PLAIN = re.compile("(?<=[!-~¡-ᙿ]) (?=[!-~¡-ᙿ])"), re.compile("[!-~¡-ᙿ](?:.*[!-~¡-ᙿ])?", re.DOTALL)
#: Place of an A id in a pair's code; B ids are below.
SHIFT = 15
#: What is counted of a piece and of a document.
COUNTS = ("n_a", "n_b", "n_intervals", "n_groups", "n_links")


def _flat(lists: Iterable[list[int]]) -> np.ndarray:
    return np.array(list(chain.from_iterable(lists)), np.int64)


def _by_ranks(path: str) -> Callable[[str], list[int]] | None:
    """A faster encoder of ASCII text with the same ids, from the same file; None where its ids aren't in the order of its merges or its pattern isn't the known one.

    Beyond ASCII the two libraries may know different versions of Unicode, so such texts go by the file's own library.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    special = {t["content"] for t in spec["added_tokens"]}
    byte_of = {c: k for k, c in _byte_symbols().items()}
    known = spec["pre_tokenizer"] and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True) and not spec["pre_tokenizer"]["add_prefix_space"] and not spec["normalizer"]
    if not known or [vocab[a + b] for a, b in merges] != [*range(len(byte_of), len(byte_of) + len(merges))]:
        return None
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Aligner:
    """Both vocabularies and the alignments of pieces of text that a worker has met."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.ranked = _by_ranks(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = {c: k for k, c in _byte_symbols().items()}
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(byte_of.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(pieces) > 1 << SHIFT or size > 1 << (31 - SHIFT):
            raise ValueError("a pair of ids must fit 31 bits")
        #: Whether pieces never hold a blank after another character, so that texts may be cut before blanks.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        #: Ids as text: of A before another one or the bar, of B before another one, the next group or the end of a piece.
        self.text = [f"{i}{end}" for i in range(size) for end in ",|"] + [f"{i}{end}" for i in range(len(pieces)) for end in ",;\n"]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}  # of a piece among the arrays; -1: bytes that aren't given back
        self.told: list[str] = []  # its groups as text
        self.counts = np.zeros((0, len(COUNTS)), np.int64)
        self.pairs = np.zeros(1, np.int64)  # where the pairs of each piece begin, and the last end
        self.codes, self.links = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def cut(self, text: str) -> list[str]:
        """Parts of a text that no token crosses; each is encoded with a blank before it."""
        return CUT.split(text) if self.cuts else [text]

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B of all pieces, each with a blank before it, and where its bytes end; puts the pieces in that order.  None where the bytes of the ids differ."""
        plain = sorted((p for p in pieces if PLAIN.fullmatch(p)), key=str.isascii) if self.cuts else []
        kept = set(plain)
        pieces[:] = plain + [p for p in pieces if p not in kept]  # the others can't stand beside each other
        texts = [" ".join(plain[k : k + CALL_PIECES]) for k in range(0, len(plain), CALL_PIECES)] + pieces[len(plain) :]
        ids: list = [None] * len(texts)
        by_file = [k for k, t in enumerate(texts) if self.ranked is None or not t.isascii()]
        for k, e in zip(by_file, self.a.encode_batch_fast([" " + texts[k] for k in by_file], add_special_tokens=False)):
            ids[k] = e.ids
        a = _flat(self.ranked(" " + t) if x is None else x for t, x in zip(texts, ids))
        b = _flat(self.b.encode(texts, num_threads=1))
        raw = [b" " + p.encode() for p in pieces]
        whole, ends = b"".join(raw), np.cumsum([len(r) for r in raw])
        for ids, table in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(table.__getitem__, ids.tolist())) != whole:
                return None
        return a, b, ends

    def learn(self, pieces: list[str]) -> None:
        """Encode and align pieces of text."""
        found = self.encoded(pieces)
        if found is None:
            good = []
            for p in pieces:
                if self.encoded([p]) is None:
                    self.place[p] = -1
                else:
                    good.append(p)
            if not good:
                return
            pieces, found = good, self.encoded(good)
        a, b, stop = found
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(end_a, end_b)
        owner_a, owner_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)  # the tokens that overlap in each interval
        shared = ends[(end_a[owner_a] == ends) & (end_b[owner_b] == ends)]  # these close groups
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        of_a, links_a = np.unique(group_a << 16 | a, return_counts=True)  # distinct ids of a group, and how often each is there
        of_b, links_b = np.unique(group_b << 16 | b, return_counts=True)
        n_b = np.bincount(of_b >> 16, minlength=len(shared))
        times = n_b[of_a >> 16]
        left = np.repeat(np.arange(len(of_a)), times)
        right = np.repeat((np.cumsum(n_b) - n_b)[of_a >> 16] - np.cumsum(times) + times, times) + np.arange(len(left))
        links = links_a[left] * links_b[right]
        group = of_a[left] >> 16
        # where the tokens, intervals, groups and pairs of each piece end
        last = np.searchsorted(shared, stop)
        stops = [np.searchsorted(end_a, stop) + 1, np.searchsorted(end_b, stop) + 1, np.searchsorted(ends, stop) + 1, last + 1]
        to = np.searchsorted(group, last, "right")
        stops.append(np.concatenate([[0], np.cumsum(links)])[to])
        begin = len(self.told)
        self.place |= {p: begin + k for k, p in enumerate(pieces)}
        self.counts = np.concatenate([self.counts, np.diff(np.stack(stops, 1), axis=0, prepend=0)])
        self.codes = np.concatenate([self.codes, ((of_a[left] & 0xFFFF) << SHIFT | (of_b[right] & 0xFFFF)).astype(np.int32)])
        self.links = np.concatenate([self.links, links])
        self.pairs = np.concatenate([self.pairs, self.pairs[-1] + to])
        # the tokens in the order of the text form: of each group those of A, then those of B
        in_a, in_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a + np.diff(group_a, append=-1).astype(bool)
        ends_group, ends_piece = np.diff(group_b, append=-1).astype(bool), np.isin(end_b, stop)
        order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * len(self.size_a) + 3 * b + ends_group + ends_piece
        self.told += "".join(map(self.text.__getitem__, order.tolist())).split("\n")[:-1]

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: its counts and the digest of its groups; and where its pairs end, their codes and their links."""
        split = [self.cut(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        new = set(flat) - self.place.keys()
        if len(self.place) + len(new) > CACHE_PIECES:
            self.forget()
            new = set(flat)
        if new:
            self.learn(sorted(new))
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        sizes = np.array([len(s) for s in split])
        doc = np.repeat(np.arange(len(texts)), sizes)
        good = (sizes > 0) & (np.bincount(doc, at < 0, len(texts)) == 0)
        doc, at = doc[good[doc]], at[good[doc]]
        counts = np.zeros((len(texts), len(COUNTS)), np.int64)
        np.add.at(counts, doc, self.counts[at])
        ends = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
        places, told = at.tolist(), self.told
        digests = [hashlib.sha256(";".join([told[p] for p in places[x:y]]).encode()).hexdigest() if x < y else "" for x, y in zip([0, *ends], ends)]
        n = self.pairs[at + 1] - self.pairs[at]
        take = np.repeat(self.pairs[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        key = np.repeat(doc, n) << 31 | self.codes[take]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        links = np.add.reduceat(self.links[take][order], first) if len(first) else np.zeros(0, np.int64)
        key = key[first]
        return counts, digests, np.searchsorted(key, np.arange(1, len(texts) + 1) << 31), (key & 0x7FFFFFFF).astype(np.int32), links


@lru_cache(1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def alignments(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: _row, its key, counts of tokens, intervals, groups and links, the digest of its groups, and its distinct linked pairs (codes: A's id times 2**15 plus B's) with their numbers of links."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached_by("alignment", aligner.cache_clear)
        both = aligner(path_a, path_b)
        for b in batches:
            for begin in range(0, b.num_rows, BATCH_TEXTS):
                part = b.slice(begin, BATCH_TEXTS)
                counts, digests, ends, codes, links = both.documents(part.column(2).to_pylist())
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(x)) for x in (codes, links)]
                cols = [part.column(0), part.column(1), *map(pa.array, counts.T), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(cols, names=["_row", key, *COUNTS, "groups_sha256", "codes", "links"])

    schema = f"_row long, `{key}` {docs.schema[key].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, groups_sha256 string, codes array<int>, links array<long>"
    return in_tasks(rows, run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """code, n, best: how many documents hold a pair, and whether no other pair of its A id is held by more; from alignments()."""
    n = saved(aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n")), "pairs")
    a = F.shiftright("code", SHIFT)
    most = n.groupBy(a.alias("_a")).agg(F.max("n").alias("_most"))  # one row for each of A's ids
    return n.join(F.broadcast(most), a == F.col("_a")).select("code", "n", (F.col("n") == F.col("_most")).alias("best"))


def scored(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """op11's result: alignments() with n_best, links whose pair is the commonest of its A id, and count_sum, the pairs' counts added up over the links."""
    aligned, _ = counted(alignments(docs, path_a, path_b, key, text), "alignments")
    spark = docs.sparkSession
    counts = saved(pair_counts(aligned), "pair_counts")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    frequent = counts.where(F.col("n") * HEAVY > rows)
    heavy = sorted(map(tuple, frequent.collect()))  # fewer than HEAVY, whatever the input
    known = spark.sparkContext.broadcast((np.array([r[0] for r in heavy], np.int32), np.array([r[1] for r in heavy], np.int64), np.array([r[2] for r in heavy], bool)))

    def look(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        code, n, best = known.value
        lists = b.column(1)
        codes, links = lists.flatten().to_numpy(), b.column(2).flatten().to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        at = np.minimum(np.searchsorted(code, codes), max(len(code) - 1, 0))
        hit = code[at] == codes if len(code) else np.zeros(len(codes), bool)
        return b.column(0).to_numpy(), np.repeat(np.arange(b.num_rows), sizes), codes, links, at, hit, n, best

    def of_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, of, codes, links, at, hit, n, best = look(b)
            add = lambda values: np.bincount(of[hit], values, len(row)).astype(np.int64)
            sums = [add(links[hit] * best[at[hit]]), _exact(of[hit], links[hit], n[at[hit]], len(row))] if hit.any() else [np.zeros(len(row), np.int64)] * 2
            yield pa.RecordBatch.from_arrays([pa.array(row), *map(pa.array, sums)], names=["_row", "n_best", "count_sum"])

    def of_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, of, codes, links, at, hit, n, best = look(b)
            yield pa.RecordBatch.from_arrays([pa.array(x[~hit]) for x in (row[of], codes, links)], names=["_row", "code", "links"])

    lists = aligned.select("_row", "codes", "links")
    rest = in_tasks(lists, of_rest, "_row long, code int, links long").join(counts.where(F.col("n") * HEAVY <= rows), "code")
    rare = rest.select("_row", (F.col("links") * F.col("best").cast("long")).alias("n_best"), (F.col("links") * F.col("n")).alias("count_sum"))
    both = in_tasks(lists, of_frequent, "_row long, n_best long, count_sum long").unionByName(rare)
    sums = both.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    slim = aligned.select("_row", key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", F.col("n_intervals").alias("n_overlaps"))
    return slim.join(sums, "_row").select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


def _exact(of: np.ndarray, links: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place, without the rounding of weighted bincount."""
    out = np.zeros(size, np.int64)
    np.add.at(out, of, links * n)
    return out
